"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``.  A stage sees all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing_tree, packing_hilbert, pii_boost, simhash_pivots, toxicity_mil
from tessera.llm.queries import TOXIC, vocabulary
from tessera.llm.shared import forget, free_names, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    model = toxicity_mil.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_mil.scored(docs, model).where(F.col("score") < TOXIC).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: of its smallest ``doc_id`` (rows without an id come last), repeated rows once."""
    id_, name, kept_id, kept_name = free_names(docs, 4)
    # plain keys, so that the join's exchange serves both steps: a null id is 0, and its text's name is turned over
    keys = lambda same: (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.when(F.col("doc_id").isNull(), F.bitwise_not(same)).otherwise(same))
    kept = simhash_pivots.similar(docs).where("first").select(*[k.alias(n) for k, n in zip(keys(F.col("same")), (kept_id, kept_name), strict=True)]).distinct()
    rows = docs.withColumns(dict(zip((id_, name), keys(simhash_pivots.text_name()), strict=True)))
    rows = rows.join(kept, (F.col(id_) == F.col(kept_id)) & (F.col(name) == F.col(kept_name)), "left_semi")
    return rows.dropDuplicates([id_, name]).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii_boost.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, by shard."""
    return mixing_tree.mixed(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences."""
    return packing_hilbert.packed(docs, vocabulary("word_bpe_49k.json"), end_id=2)


STAGES = [("toxicity", drop_toxic), ("near_dedup", one_of_each_group), ("pii", redact), ("mix", mix), ("pack", pack)]

#: Trained scores, hashing and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
            if before is not None:  # the stage has read it; what came first is the input and stays
                forget(before)
            before = docs
    return docs
