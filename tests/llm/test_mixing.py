import pytest

from marlstone.llm import mixing
from marlstone.llm.queries import op7_mixing
from tests.llm import oracle

SCHEMA = "doc_id long, text string, lang string, source string, size long"


def plain_targets(sizes):
    """Water filling by rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        t = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if t[s] > 3 * sizes[s]}
        if not over:
            return t | {s: 3.0 * sizes[s] for s in full}
        full |= over


def test_same_as_sql(spark, sf):
    assert oracle.same(op7_mixing(spark, sf), sf, mixing.ORACLE)


def test_targets_limits_and_reruns(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", s, 0) for i, s in enumerate(["a"] * 5 + ["b"] * 400 + ["c"] * 90 + [None] * 50 + ["é"] * 20)] + [(None, "x y", None, "a", 1), (7, None, None, "b", 1), (7, "", None, "zz", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 3 * r.size
    want = plain_targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    for s in sizes:
        assert abs(sum(r.taken for r in got if r.source == s) - want[s]) <= 7
    key = lambda r: (r.doc_id or -1, str(r.source), r.size, r.taken)
    assert sorted(map(key, mixing.mix(df.repartition(7)).collect())) == sorted(map(key, got))


def test_empty_and_wordless(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, None, None, 5), (1, " \n", None, "a", 5)], SCHEMA)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
