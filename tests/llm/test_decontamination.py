"""Searches against brute force over all pairs."""

import pytest

from marlstone.llm import decontamination as dc
from marlstone.llm.text import words_of

DOCS = "doc_id long, text string, containment string"
ITEMS = "item_id long, text string"


def brute(docs, items, threshold=0.8):
    out = set()
    for d, t in docs:
        w = words_of(t)
        for i, u in items:
            v = words_of(u)
            n = min(5, len(v))
            own = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            doc = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            if own and len(own & doc) / len(own) >= threshold:
                out.add((d, i, round(len(own & doc) / len(own), 9)))
    return out


def rows(df):
    return {(r.doc_id, r.item_id, round(r.containment, 9)) for r in df.collect()}


@pytest.mark.parametrize("most", [dc.BROADCAST_SHINGLES, 0])
def test_all_pairs_of_the_tables(spark, sf, most):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert want and rows(dc.search(docs, items, most=most)) == want


@pytest.mark.parametrize("most", [dc.BROADCAST_SHINGLES, 0])
def test_edges(spark, most):
    long = " ".join(f"w{i}" for i in range(30_000))
    item = " ".join(f"q{i}" for i in range(12))
    docs = [(1, long + " " + item.upper() + ". " + long), (1, item), (2, item), (3, None), (4, ""), (None, item + " x"), (5, "one two three"), (6, " ".join(item.split()[:8])), (7, "q0 q1")]
    items = [(10, item), (11, None), (12, ""), (13, "two three"), (None, item), (14, "q0 q1 q2"), (10, item)]
    got = dc.search(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, ITEMS), most=most)
    assert rows(got) == brute(docs, items)
    assert (1, 10, 1.0) in rows(got) and (5, 13, 1.0) in rows(got)


def test_empty_and_clean(spark):
    docs = spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f")], ITEMS)
    assert dc.search(docs, items).count() == 0
    docs = spark.createDataFrame([(1, "x a b c d e f", ""), (2, "a b c", ""), (None, None, None)], DOCS)
    assert {r.doc_id for r in dc.clean(docs, items).collect()} == {2, None}
    assert dc.clean(docs, items.limit(0)).count() == 3


@pytest.mark.parametrize("most", [dc.BROADCAST_SHINGLES, 0])
def test_short_items_in_long_documents(spark, most):
    docs = [(k, " ".join(f"w{k}_{i}" for i in range(120))) for k in range(100)]
    items = [(100 * n + k, " ".join(docs[k][1].split()[30 : 30 + n])) for n in (2, 4, 5, 6, 7) for k in range(100)]
    got = dc.search(spark.createDataFrame([(*d, "x") for d in docs], DOCS), spark.createDataFrame(items, ITEMS), most=most)
    assert rows(got) == {(i % 100, i, 1.0) for i, _ in items}


def test_clean_judges_rows_by_their_text(spark):
    item = "one two three four five six seven"
    rows = [(None, f"x {item} y", 1), (None, "clean text", 2), (7, item, 3), (7, "other clean text", 4), (7, "other clean text", 5), (8, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = dc.clean(docs, items)
    assert got.columns == docs.columns and sorted(r.item_id for r in got.collect()) == [2, 4, 5, 6]
