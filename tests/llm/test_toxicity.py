import numpy as np
from pyspark.sql import functions as F

from marlstone.llm import toxicity

DIR = "/root/testdata/sf0.1"


def test_scorer_same_as_rows():
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)] + ["éa", "x_1"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 30))) for _ in range(40)] + [None, ""]
    labels = np.array([[("w1 " in f"{t} "), ("w2 " in f"{t} ")] for t in texts], float)
    chain = toxicity.Chain(texts, labels, np.arange(len(texts)) % 3)
    x, earlier = toxicity.Rows(texts), np.zeros((len(texts), 0))
    scorer = toxicity.Scorer(chain, most=20)
    got = np.array([scorer(t) for t in texts])
    for k, w in enumerate(chain.weights):
        p = toxicity.sigmoid(chain._logits(x, earlier, w))
        assert np.allclose(p, got[:, k])
        earlier = np.column_stack([earlier, toxicity.EARLIER * p])
    assert chain.weights[1].shape[0] == chain.weights[0].shape[0] + 1


def test_best_limit():
    p, y = np.array([0.9, 0.8, 0.3, 0.1]), np.array([1.0, 1, 0, 0])
    assert 0.3 < toxicity.best_limit(p, y) < 0.8
    assert toxicity.best_limit(p, np.zeros(4)) == 1.0


def test_labelled_documents_not_seen_in_training(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    seen = F.xxhash64("doc_id", F.lit(9)) % 2 == 0
    model = toxicity.fit(docs, labels.where(seen), toxicity.label_columns())
    got = toxicity.score(docs, model).join(labels.where(~seen).select("doc_id", F.col("toxic").alias("t")), "doc_id")
    hit, false, missed = (got.where(c).count() for c in ("toxic AND t = 1", "toxic AND t = 0", "NOT toxic AND t = 1"))
    assert hit > 30 and false <= 0.03 * hit + 1 and missed <= 0.05 * hit + 1, (hit, false, missed)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "a", 0.5), (2, "", None, 0.1), (None, "you idiot", "b", None), (3, "fine words " * 30_000, "b", 1.0), (3, "you idiot", "b", 1.0)], "doc_id long, text string, source string, p_toxic double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.score(docs, toxicity.fit(docs, none, toxicity.label_columns())).collect()
    assert len(got) == 5 and not any(r.toxic for r in got)
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1), (3, 1, 1), (9, 0, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")
    kept = toxicity.clean(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2}
    assert toxicity.clean(docs.limit(0), labels).count() == 0


def test_limit_of_a_capped_sample():
    """The limit of a sample that holds a tenth of the clean rows is that of all rows."""
    rng = np.random.default_rng(1)
    toxic, clean = rng.normal(0.65, 0.15, 400), rng.normal(0.35, 0.15, 400)
    p, y = np.concatenate([toxic, np.repeat(clean, 10)]), np.repeat([1.0, 0.0], [400, 4000])
    part, label = np.concatenate([toxic, clean]), np.repeat([1.0, 0.0], 400)
    shares = toxicity.shares_of(label[:, None], {(1.0,): 400, (0.0,): 4000})
    assert np.isclose(toxicity.best_limit(part, label, shares), toxicity.best_limit(p, y))
    assert toxicity.best_limit(part, label) < toxicity.best_limit(p, y) - 0.05


def test_bound_of_the_sample_reaches_the_limit(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"plain words {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 10)) for i in range(60)], "doc_id long, quality int, toxic int")
    seen = []
    real = toxicity.shares_of
    model = toxicity.fit(docs, labels, toxicity.label_columns(), most=10)
    rows = [(i, f"plain words {i}", 0, False, i < 10) for i in range(20)]
    monkeypatch.setattr(toxicity, "shares_of", lambda *a: seen.append(real(*a)) or seen[-1])
    toxicity._chain_of(rows, 2, {(0.0, 1.0): 10, (0.0, 0.0): 50})
    assert sorted(set(seen[0])) == [1.0, 5.0] and 0 <= model.limit <= 1
