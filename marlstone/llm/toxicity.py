"""Toxicity by classifier chains.

The label columns are predicted one after the other by linear (logistic) models over hashed words and
character 4-grams of words. Each model also sees the earlier columns' probabilities. It is trained with
out-of-fold ones: for every fold, the earlier model is fitted on the other folds and predicts this one, so
that a later model learns how far to trust probabilities like those it will see. For prediction each column's model
is fitted on all folds. The last column's threshold is the one that is best on out-of-fold probabilities,
each weighted by the labelled rows it stands for, so that the sample's bound doesn't shift it.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import WORD, words_of

BITS = 18
FOLDS = 3
DOCS_PER_KIND = 2000  # bound of the training sample, for each combination of labels
LONGEST = 20_000  # characters of a text in the training sample
FEATURES = 1500  # with a weight
L2 = 3e-4
EARLIER = 0.1  # scale of earlier probabilities, so that their weights are held down like those of words
CHAIN = ("low_quality", "toxic")


class Hashed(dict):
    """Number of each feature, kept for features seen lately."""

    def __missing__(self, part: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[part] = h = xxhash.xxh32_intdigest(part.encode("utf-8", "surrogatepass")) >> (32 - BITS)
        return h


def features_of(word: str, hashed: Hashed) -> list[int]:
    """Hashed features of a word: itself, and each run of 4 characters of it with its borders."""
    w = f"<{word}>"
    return [hashed["=" + w], *{hashed[w[i : i + 4]] for i in range(len(w) - 3)}]


def scale_of(words: int) -> float:
    """A row's scale: long texts hold more telling words, but also more that tell nothing."""
    return 0.3 / max(1, words) ** 0.25


class Rows:
    """Documents as sparse rows; each distinct word counts once, and a row is scaled by its number of distinct words."""

    def __init__(self, texts: list[str | None]):
        known: dict[str, np.ndarray] = {}
        hashed = Hashed()
        at, n, self.scale = [], [], []
        for t in texts:
            words = sorted(set(words_of(t)))
            got = [known[w] if w in known else known.setdefault(w, np.array(features_of(w, hashed), np.int32)) for w in words]
            one = np.concatenate(got) if got else np.empty(0, np.int32)
            at.append(one)
            n.append(len(one))
            self.scale.append(scale_of(len(words)))
        self.at = np.concatenate(at) if at else np.empty(0, np.int32)
        self.row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.n, self.scale = len(n), np.array(self.scale)

    def only(self, keep: np.ndarray) -> "Rows":
        """The same rows with the features of ``keep`` (by number) only."""
        out, there = Rows([]), keep[self.at]
        out.at, out.row, out.n, out.scale = self.at[there], self.row[there], self.n, self.scale
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.at], self.n) * self.scale

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, (g * self.scale)[self.row], 1 << BITS)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def telling(x: Rows, y: np.ndarray, on: np.ndarray, most: int = FEATURES) -> np.ndarray:
    """How much each feature may tell: the log ratio of its rates in the two classes, on the rows ``on``, else 0.

    Kept are the ``most`` features whose rates differ most, in standard errors times log ratio.
    """
    plain = Rows([])
    plain.at, plain.row, plain.n, plain.scale = x.at, x.row, x.n, np.ones(x.n)
    a, b = max(1.0, (on * y).sum()), max(1.0, (on * (1 - y)).sum())
    pos, neg = plain.back(on * y), plain.back(on * (1 - y))
    p = np.clip((pos + neg + 1) / (a + b + 2), 0, 1 - 1e-3)  # a feature may occur in several words
    z = (pos / a - neg / b) / np.sqrt(p * (1 - p) * (1 / a + 1 / b))
    ratio = np.log((pos + 0.5) / (a + 1)) - np.log((neg + 0.5) / (b + 1))
    out = np.zeros(1 << BITS)
    best = np.argsort(-z * ratio, kind="stable")[:most]
    out[best] = np.abs(ratio[best]) * (pos + neg > 0)[best]
    return out


def fit_one(x: Rows, earlier: np.ndarray, y: np.ndarray, on: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of features, of earlier probabilities and of the intercept, by L-BFGS on the rows ``on``; classes weigh alike.

    Only the most telling features of these rows get a weight, and the more they tell the less it is held down.
    """
    tells = telling(x, y, on)
    x = x.only(tells > 0)
    pos = max(1, int(y[on].sum()))
    share = on * np.where(y > 0, 0.5 / pos, 0.5 / max(1, int(on.sum()) - pos))
    dim = 1 << BITS

    def loss(w):
        z = x.dot(w[:dim] * tells) + earlier @ w[dim:-1] + w[-1]
        p = sigmoid(z)
        value = -(share * (y * np.log(p + 1e-12) + (1 - y) * np.log(1 - p + 1e-12))).sum() + L2 / 2 * (w[:-1] @ w[:-1])
        g = share * (p - y)
        return value, np.concatenate([x.back(g) * tells, earlier.T @ g, [g.sum()]]) + L2 * np.append(w[:-1], 0)

    w = np.zeros(dim + earlier.shape[1] + 1)
    value, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, t, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * t
        q *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1e-12, np.sqrt(grad @ grad))
        for (s, t, rho), a in zip(past, reversed(alphas)):
            q += s * (a - rho * (t @ q))
        step, slope = 1.0, grad @ q
        while True:
            new = w - step * q
            v, g = loss(new)
            if v <= value - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, t = new - w, g - grad
        if s @ t > 1e-12:
            past = [*past[-6:], (s, t, 1 / (s @ t))]
        done = abs(value - v) < 1e-6
        w, value, grad = new, v, g
        if done:
            break
    w[:dim] *= tells
    return w


class Chain:
    """Fitted models of the label columns, in order."""

    def __init__(self, texts: list[str | None], labels: np.ndarray, folds: np.ndarray, n_folds: int = FOLDS, shares: np.ndarray | None = None):
        x, n = Rows(texts), len(texts)
        self.weights: list[np.ndarray] = []
        self.limit = 0.5
        out_of_fold = np.zeros((n, 0))
        for k in range(labels.shape[1]):
            y = labels[:, k].astype(float)
            p = np.full(n, 0.5)
            for f in range(n_folds):
                if (there := folds == f).any():
                    w = fit_one(x, out_of_fold, y, ~there)
                    p[there] = sigmoid(self._logits(x, out_of_fold, w))[there]
            self.weights.append(fit_one(x, out_of_fold, y, np.ones(n, bool)))
            out_of_fold = np.column_stack([out_of_fold, EARLIER * p])
        if labels.shape[1]:
            self.limit = best_limit(p, y, shares)

    @classmethod
    def of(cls, weights: list[np.ndarray], limit: float) -> "Chain":
        out = cls.__new__(cls)
        out.weights, out.limit = weights, limit
        return out

    @staticmethod
    def _logits(x: Rows, earlier: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x.dot(w[: 1 << BITS]) + earlier @ w[1 << BITS : -1] + w[-1]


def best_limit(p: np.ndarray, y: np.ndarray, shares: np.ndarray | None = None) -> float:
    """The middle of the thresholds whose F1, rows weighted by ``shares``, is within 0.7 % of the best; 1 if there are no positives."""
    if not y.any():
        return 1.0
    order = np.argsort(-p, kind="stable")
    w = np.ones(len(p)) if shares is None else shares
    f1 = 2 * np.cumsum((w * y)[order]) / (np.cumsum(w[order]) + (w * y).sum())
    good = np.flatnonzero(f1 >= 0.993 * f1.max())
    ps = np.append(p[order], 0.0)
    return float((ps[good[0]] + ps[good[-1] + 1]) / 2)


class Scorer(dict):
    """Each word's share of the logits of all columns, kept for words seen lately."""

    def __init__(self, chain: Chain, most: int = 300_000):
        self.most, self.w = most, np.stack([w[: 1 << BITS] for w in chain.weights])
        self.rest = [w[1 << BITS :].tolist() for w in chain.weights]
        self.used = np.abs(self.w).any(axis=0).tolist()
        self.hashed = Hashed()
        self.sums = np.zeros((4096, len(chain.weights)))

    def __missing__(self, word: str) -> int:
        if (i := len(self)) >= len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[i] = 0
        for f in features_of(word, self.hashed):
            if self.used[f]:
                self.sums[i] += self.w[:, f]
        self[word] = i
        return i

    def __call__(self, text: str | None) -> list[float]:
        words = set(words_of(text))
        if len(self) + len(words) > self.most:
            self.clear()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        sums = self.sums[at].sum(axis=0) * scale_of(len(words))
        out: list[float] = []
        for s, rest in zip(sums, self.rest):
            z = s + sum(w * EARLIER * p for w, p in zip(rest, out)) + rest[-1]
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        return out


def fit(docs: DataFrame, labels: DataFrame, chain: dict[str, Column], most: int = DOCS_PER_KIND, longest: int = LONGEST) -> Chain:
    """Train on up to ``most`` labelled documents of each combination of labels, those of the least hash of doc_id.

    ``chain``: the boolean label columns, in order, as expressions over ``labels``. Labels that are null, or are of no document
    of up to ``longest`` characters, aren't used. The sample, 2 ** columns * ``most`` texts at most, goes to one task, which trains and returns the weights.
    """
    known = labels.select("doc_id", *[c.cast("boolean").alias(k) for k, c in chain.items()]).dropna()
    parts = [known.where(" AND ".join(f"{k} = {str(v).lower()}" for k, v in zip(chain, values))).orderBy(F.xxhash64("doc_id")).limit(most) for values in itertools.product((False, True), repeat=len(chain))]
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.union(p)
    # Bounded by ``most``, so safe to broadcast.
    rows = docs.select("doc_id", "text").where(F.length("text") <= longest).join(F.broadcast(sample), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)))
    names = list(chain)
    # A row for each combination of labels.
    totals = {tuple(map(float, r[:-1])): r[-1] for r in known.groupBy(*names).count().collect()}

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted(r for b in batches for r in b[["doc_id", "text", "fold", *names]].itertuples(index=False, name=None))
        chain = _chain_of(got, len(names), totals)
        yield pd.DataFrame({"model": [pickle.dumps((chain.weights, chain.limit))]})

    out = rows.select("doc_id", "text", "fold", *names).repartition(1).mapInPandas(train, "model binary").collect()
    return Chain.of(*pickle.loads(bytes(out[0].model))) if out else _chain_of([], len(names))


def shares_of(labels: np.ndarray, totals: dict[tuple, int]) -> np.ndarray:
    """How many labelled rows each row of the sample stands for, by its combination of labels."""
    kinds = list(map(tuple, labels.tolist()))
    there = Counter(kinds)
    return np.array([totals[k] / there[k] for k in kinds], float)


def _chain_of(rows: list[tuple], n_labels: int, totals: dict[tuple, int] | None = None) -> Chain:
    labels = np.array([r[3:] for r in rows], float).reshape(len(rows), n_labels)
    shares = shares_of(labels, totals) if totals else None
    return Chain([r[1] for r in rows], labels, np.array([r[2] for r in rows]), shares=shares)


def score(docs: DataFrame, model: Chain, names: tuple[str, ...] = CHAIN) -> DataFrame:
    """All columns of ``docs`` (with text), then p_<name> for each label column and the boolean ``<last name>``.

    Whole texts are scored. A null text or one without words has the probabilities of an empty document and is not rejected.
    Nothing learned: probabilities of one half, no document rejected. Columns that clash with the new ones are replaced.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    last = names[-1]
    parts = [f"p_{k}" for k in names]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(known.value)
        for texts in batches:
            p = np.array([scorer(t) for t in texts]).reshape(len(texts), len(names))
            worded = np.array([t is not None and WORD.search(t) is not None for t in texts], bool)
            yield pd.DataFrame({k: p[:, i] for i, k in enumerate(parts)} | {last: worded & (p[:, -1] >= known.value.limit)})

    kind = ", ".join([*(f"{k} double" for k in parts), f"{last} boolean"])
    # Not deterministic, so that a filter on the result doesn't score twice.
    udf = F.pandas_udf(run, kind).asNondeterministic()
    new = [*parts, last]
    kept = [c for c in docs.columns if c.lower() not in new]
    return docs.select(*kept, udf(F.col("text")).alias("_s")).select(*kept, *[F.col(f"_s.{k}").alias(k) for k in new])


def label_columns() -> dict[str, Column]:
    """The chain over the table of labels: whether a document is of low quality, then whether it is toxic."""
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain, trained on ``labels`` (doc_id, quality, toxic), doesn't reject; the columns stay."""
    rows = score(docs, fit(docs, labels, label_columns()))
    return rows.where(~F.col("toxic")).select(*docs.columns)
