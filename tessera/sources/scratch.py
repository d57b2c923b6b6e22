"""The folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from ..errors import InvalidArgument


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder; sets one of its own only where none is set and driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif not spark.sparkContext.master.split("[")[0] == "local":
            raise InvalidArgument("set spark.checkpoint.dir to a folder that the driver and all executors share")
        else:
            root = "file://" + os.path.join(tempfile.gettempdir(), "tessera-scratch")
            spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")
