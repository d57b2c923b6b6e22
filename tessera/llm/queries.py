"""The registered queries of this subpackage, each a thin layer over an operator."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_itq, fingerprint_simhash, html_blocks, license_templates, mixing_tree, packing_hilbert, pii_boost, simhash_pivots, token_files, toxicity_mil

#: Threshold of a document's toxicity.
TOXIC = 0.3


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; the folder is a parameter of the environment."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_pivots.linked(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_mil.train(docs, _read(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    scored = toxicity_mil.scored(docs, model, locate=True)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"), "offending")


def embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_itq.linked(_read(spark, sf_dir, "embeddings"))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_tree.takes(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shards")


def token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(manifest)


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_simhash.compared(_read(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.scanned(_read(spark, sf_dir, "documents")).drop("templates")


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_hilbert.packed(_read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extracted(_read(spark, sf_dir, "pages"))


def pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_boost.found(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_simhash_near_dedup": simhash_near_dedup,
    "op2_toxicity": toxicity,
    "op3_embedding_near_dedup": embedding_near_dedup,
    "op4_mix_sources": mix_sources,
    "op5_token_output": token_output,
    "op6_document_fingerprints": document_fingerprints,
    "op7_license_scan": license_scan,
    "op8_packing": packing,
    "op9_html_extraction": html_extraction,
    "op10_pii": pii,
}

#: All pairs of vectors by their cosine, and what is reachable by links; the other operators' hashes, models and tokenizers are beyond SQL.
_COSINES = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding) AND isfinite(list_max(embedding)) AND isfinite(list_min(embedding))
    AND (list_max(embedding) <> 0 OR list_min(embedding) <> 0)
), links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reached(x, y) AS (
    SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
), counted AS (SELECT x, COUNT(*) AS n FROM links GROUP BY x), lowest AS (SELECT x, MIN(y) AS low FROM reached GROUP BY x)
SELECT vec_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_links, LEAST(vec_id, COALESCE(low, vec_id)) AS component_id, vec_id <= COALESCE(low, vec_id) AS kept
FROM embeddings LEFT JOIN counted ON vec_id = counted.x LEFT JOIN lowest ON vec_id = lowest.x
"""

ORACLE_SQL: dict[str, str] = {"op3_embedding_near_dedup": _COSINES}
