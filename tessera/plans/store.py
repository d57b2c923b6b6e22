"""Databases of the registered queries, in folders of their own that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..session import Database
from ..sources.scratch import shared_dir


def fresh_folder(spark: SparkSession, nested: bool = False) -> str:
    """A fresh folder that the executors write and the driver lists; ``nested``: in one that has nothing else."""
    name = f"{shared_dir(spark)}/tessera-db-{uuid.uuid4().hex}"
    return f"{name}/db" if nested else name


def fresh_database(spark: SparkSession, nested: bool = False) -> Database:
    return Database.open(fresh_folder(spark, nested), spark)
