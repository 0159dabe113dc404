from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.scratch import shared_dir
from tests.llm.test_decontamination import brute
from tests.llm.test_near import plain_classes
from tests.llm.test_privacy import plain

def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    left = docs
    stage = dict(corpus_pipeline.STAGES)

    spark.sparkContext.setCheckpointDir(shared_dir(spark))
    mild = stage["toxicity"](spark, left, sf).checkpoint()
    gone = rows.keys() - {r.doc_id for r in mild.collect()}
    assert mild.columns == docs.columns and {d for d in gone if d in labels} == {d for d, t in labels.items() if t}

    one = stage["near_dedup"](spark, mild, sf).checkpoint()
    want = {c for d, c in plain_classes([(r.doc_id, r.text) for r in mild.collect()])}
    assert {r.doc_id for r in one.collect()} == want and one.columns == docs.columns

    fresh = stage["decontamination"](spark, one, sf).checkpoint()
    bad = {d for d, _, _ in brute([(r.doc_id, r.text) for r in one.collect()], items)}
    assert {r.doc_id for r in fresh.collect()} == want - bad and fresh.columns == docs.columns

    safe = stage["pii"](spark, fresh, sf).checkpoint()
    assert safe.columns == docs.columns and safe.count() == fresh.count()
    for r in safe.collect():
        assert not plain(r.text) and ("[" in r.text if plain(rows[r.doc_id].text) else True)

    mixed = stage["mixing"](spark, safe, sf).collect()
    assert len(mixed) == safe.count() and all(0 <= r.taken <= 3 * r.size for r in mixed) and sum(r.taken for r in mixed) > 0

def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_clashing_columns_and_edges_stay(spark, sf):
    """Columns named like those of the operators come back as they were, for repeated, null, empty and very long rows, and for an empty table."""
    extra = ["_hash", "_row", "spans", "terms", "hash", "_d", "_text", "doc", "_id", "size", "root"]
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, "one two three four five six a@b.cc"), (1, "one two three four five six a@b.cc"), (2, None), (None, ""), (None, "seven words of a null id stand here"), (3, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for i, c in enumerate(extra):
        df = df.withColumn(c, F.concat(F.lit(f"{i}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    stage = dict(corpus_pipeline.STAGES)
    for name, n in [("near_dedup", 5), ("decontamination", 6), ("pii", 6)]:
        got = stage[name](spark, df, sf)
        assert got.columns == df.columns
        found = got.collect()
        assert len(found) == n and all(r[c] == f"{i}-{'none' if r.doc_id is None else r.doc_id}" for r in found for i, c in enumerate(extra))
        assert stage[name](spark, df.limit(0), sf).count() == 0
