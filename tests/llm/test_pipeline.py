"""The pipeline against brute-force versions of its stages."""

import zlib

import numpy as np

import corpus_pipeline
from tessera.llm import toxicity_mil
from tessera.llm.shared import written

SF = "/root/testdata/sf0.001"


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    clean = written(stages["toxicity"](spark, docs, SF), "t")
    texts = {r.doc_id: r.text for r in docs.collect()}
    own = sorted(i for i in labels if i in texts and zlib.crc32(str(i).encode()) % 4 != 2)
    model = toxicity_mil.fit([texts[i] for i in own], np.array([labels[i] for i in own]))
    kept = {r.doc_id for r in clean.collect()}
    assert clean.columns == names and kept == {i for i, t in texts.items() if model.document(t) < 0.3}

    single = written(stages["near_dedup"](spark, clean, SF), "d")
    left = sorted(r.doc_id for r in single.collect())
    sets = {i: grams(texts[i]) for i in kept}
    near = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert single.columns == names
    assert all(any(near(i, j) for j in kept if j < i) for i in kept - set(left))

    redacted = written(stages["pii"](spark, single, SF), "p")
    assert redacted.columns == names and sorted(r.doc_id for r in redacted.collect()) == left
    assert not any("@mail" in r.text for r in redacted.collect())

    mixed = written(stages["mix"](spark, redacted, SF), "m")
    after = {r.doc_id: r.text for r in redacted.collect()}
    assert mixed.columns == names and all(after[r.doc_id] == r.text for r in mixed.collect())

    pieces = stages["pack"](spark, mixed, SF).collect()
    whole = [p for p in pieces if p.start == 0]
    assert sorted(p.doc_id for p in whole) == sorted(r.doc_id for r in mixed.collect())


def test_no_similar_pair_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = dict(corpus_pipeline.one_of_each_group(spark, docs, SF).select("doc_id", "text").collect())
    sets = {i: grams(t) for i, t in left.items()}
    assert not [(a, b) for a in left for b in left if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 48),
    (2, "one two three four five six seven eight nine ten", "en", "b", 48),
    (2, "one two three four five six seven eight nine ten", "en", "b", 48),
    (2, "quite another text under the same id as before", None, None, None),
    (3, "", "en", None, 0),
    (4, None, None, "a", None),
    (5, "word", "en", "c", 4),
    (None, "a text without an id, mail me@x.org", "en", "c", 35),
    (None, "a text without an id, mail me@x.org", "en", "c", 35),
    (None, "ONE two three four five six seven eight nine ten", "en", "c", 48),
    (6, " ".join(f"w{k % 997}" for k in range(30_000)), "en", "a", 0),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _tables(spark, folder, rows, labels):
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_near_dedup_keeps_one_row_of_each_group(spark):
    """Null ids come last, null counts as empty, repeated rows stay once, columns of any name are kept."""
    docs = spark.createDataFrame(ODD, COLUMNS)
    for name in ("_near0", "same", "component_id", "first"):
        docs = docs.withColumn(name, docs.lang)
    out = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted((-1 if r.doc_id is None else r.doc_id, (r.text or "")[:10]) for r in out.collect())
    assert got == [(-1, "a text wit"), (1, "one two th"), (2, "quite anot"), (3, ""), (5, "word"), (6, "w0 w1 w2 w")]


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    sf = _tables(spark, tmp_path / "odd", ODD, [(1, 0, 0), (5, 1, None), (None, 1, 1)])
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert {p.doc_id for p in pieces if p.doc_tokens > 1} <= {None, 1, 2, 5, 6} and all(p.length > 0 for p in pieces)
    assert any(p.doc_id == 6 for p in pieces)
    empty = _tables(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
    # the inputs are never scratch
    assert spark.read.parquet(f"{sf}/documents.parquet").count() == len(ODD)
