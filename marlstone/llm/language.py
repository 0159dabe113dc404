"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of variable order: for every context of 0 .. ``order`` bytes how often each
byte followed. A byte is coded in the longest context that has seen it; each longer context that has
seen other bytes only costs an escape of probability distinct / (total + distinct), and a seen byte has n /
(total + distinct); below order 0 all 256 bytes are alike. The counts are frozen after training,
so the code length of a byte given its ``order`` predecessors is a constant, and a text's code length is
the exact sum over all its bytes. The language with the shortest code wins; the score is its share of
2 ** -length over all languages. Lengths are computed for the contexts that training saw and looked up for whole batches of
bytes at once; other bytes go down the orders, escape by escape.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 4
DOCS_PER_LANGUAGE = 400  # bound of the training sample
LONGEST = 20_000  # characters of a text in the training sample
BLOCK = 1 << 19  # bytes scored at once
PART = 1 << 22  # bytes of texts that are laid out at once
UNKNOWN = "und"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Table:
    """Hash table from 64-bit keys to their positions, probed for whole arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            s = slot[left]
            free = self.at[s] < 0
            first = np.unique(s[free], return_index=True)[1]
            put = left[free][first]
            self.at[slot[put]], self.keys[slot[put]] = put, keys[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & (len(self.at) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it isn't there."""
        slot = self._slot(keys)
        out = self.at[slot]
        todo = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (len(self.at) - 1)
            s = slot[todo]
            out[todo] = self.at[s]
            todo = todo[(out[todo] >= 0) & (self.keys[s] != keys[todo])]
        return out


def grams(padded: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n bytes that end at each place from ``n - 1`` on."""
    out = np.zeros(len(padded) - n + 1, np.uint64)
    for i in range(n):
        out <<= np.uint64(8)
        out |= padded[i : len(padded) - n + 1 + i]
    return out


def low(keys: np.ndarray, n: int) -> np.ndarray:
    return keys & np.uint64((1 << 8 * n) - 1)


class Model:
    """Frozen code lengths, in bits, of all languages."""

    def __init__(self, samples: dict[str, list[bytes]], order: int = ORDER):
        self.order, self.langs = order, sorted(samples)
        self.keys: list[np.ndarray] = []  # by order: the seen grams of order + 1 bytes,
        self.bits: list[np.ndarray] = []  # their lengths by language,
        self.contexts: list[np.ndarray] = []  # the seen contexts,
        self.escapes: list[np.ndarray] = []  # and what an escape from them costs
        for k in range(order + 1):
            counted = [self._count(samples[x], k + 1) for x in self.langs]
            keys = np.unique(np.concatenate([c[0] for c in counted])) if counted else np.empty(0, np.uint64)
            n = np.zeros((len(keys), len(self.langs)))
            for j, (g, c) in enumerate(counted):
                n[np.searchsorted(keys, g), j] = c
            contexts, of = np.unique(keys >> np.uint64(8), return_inverse=True)
            total, distinct = np.zeros((len(contexts), len(self.langs))), np.zeros((len(contexts), len(self.langs)))
            np.add.at(total, of, n)
            np.add.at(distinct, of, n > 0)
            whole = np.maximum(total + distinct, 1)
            escape = np.where(total > 0, -np.log2(np.maximum(distinct, 1) / whole), 0.0)
            lower = self._lookup(low(keys, k), k - 1) if k else np.full(n.shape, 8.0)
            bits = np.where(n > 0, -np.log2(np.maximum(n, 1) / whole[of]), escape[of] + lower)
            for known, new in ((self.keys, keys), (self.bits, bits), (self.contexts, contexts), (self.escapes, escape)):
                known.append(new)
        self.tables: list | None = None

    def _count(self, texts: list[bytes], n: int):
        got = [grams(np.frombuffer(b"\0" * self.order + t, np.uint8)[self.order - n + 1 :], n) for t in texts if t]
        return np.unique(np.concatenate(got), return_counts=True) if got else (np.empty(0, np.uint64), np.empty(0, np.int64))

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def _lookup(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Lengths of grams of k + 1 bytes."""
        if getattr(self, "tables", None) is None or len(self.tables) <= k:
            self.tables = [(Table(a), Table(b)) for a, b in zip(self.keys, self.contexts)]
        at = self.tables[k][0].find(keys)
        out = self.bits[k][at] if len(self.bits[k]) else np.zeros((len(keys), len(self.langs)))
        if len(lost := np.flatnonzero(at < 0)):
            c = self.tables[k][1].find(keys[lost] >> np.uint64(8))
            escape = np.where(c[:, None] >= 0, self.escapes[k][c], 0.0) if len(self.escapes[k]) else 0.0
            out[lost] = escape + (self._lookup(low(keys[lost], k), k - 1) if k else 8.0)
        return out

    def lengths(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Code length of each text data[offsets[i]:offsets[i + 1]] in each language, for a few MB of texts at a time."""
        out = np.zeros((len(offsets) - 1, len(self.langs)))
        s = 0
        while s < len(out):
            e = max(s + 1, int(np.searchsorted(offsets, offsets[s] + PART, side="right")) - 1)
            out[s:e] = self._lengths(offsets[s : e + 1], data)
            s = e
        return out

    def _lengths(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        n, d = len(offsets) - 1, self.order
        size = np.diff(offsets)
        doc = np.repeat(np.arange(n), size)
        padded = np.zeros(int(size.sum()) + d * (n + 1), np.uint8)
        place = np.arange(len(doc)) + d * (doc + 1)
        padded[place] = data[offsets[0] : offsets[-1]]
        out = np.zeros((n, len(self.langs)))
        for s in range(0, len(doc), BLOCK):
            p = place[s : s + BLOCK]
            g = grams(padded[p[0] - d : p[-1] + 1], d + 1)[p - p[0]]
            bits, of = self._lookup(g, d), doc[s : s + BLOCK]
            for j in range(len(self.langs)):
                part = np.bincount(of - of[0], bits[:, j])
                out[of[0] : of[0] + len(part), j] += part
        return out


def held_out() -> F.Column:
    """Documents that training never sees: those whose crc32 of the id, as text, leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, most: int = DOCS_PER_LANGUAGE, longest: int = LONGEST, order: int = ORDER) -> Model:
    """Train on up to ``most`` whole texts of up to ``longest`` characters of each language, those of the least hash of doc_id.

    Rows that are held out or have a null text, lang or doc_id aren't used. One row a language comes to the driver first, then the sample,
    ``most`` * ``longest`` characters a language at most.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out() & F.col("lang").isNotNull() & (F.length("text") > 0) & (F.length("text") <= longest))
    rows = rows.select("lang", F.xxhash64("doc_id").alias("h"), "text")
    # A language's share of the hash range that holds about twice the bound, so that only few rows are ranked.
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model({}, order)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * most / n + 50 / n))])
    near = rows.where((F.col("h") / 2.0**64 + 0.5) < share[F.col("lang")])
    by = Window.partitionBy("lang").orderBy("h", "text")
    got: dict[str, list[bytes]] = {lang: [] for lang in counts}
    for r in near.withColumn("r", F.row_number().over(by)).where(F.col("r") <= most).collect():
        got[r.lang].append(r.text.encode("utf-8", "surrogatepass"))
    return Model({k: v for k, v in got.items() if v}, order)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text).

    Null texts and texts without a letter, and all texts if nothing was learned, are ``und`` with score 0. Equal
    lengths go to the language that comes first in code point order. Repeated rows get equal results; other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = known.value
        names = np.array([*model.langs, UNKNOWN], object)
        for batch in batches:
            text = pc.cast(batch.column(1), pa.large_utf8())
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score = np.full(len(text), -1), np.zeros(len(text))
            if model.langs and len(text):
                whole = text if not text.null_count else pc.fill_null(text, "")
                offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
                data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
                bits = model.lengths(offsets, data)
                least = bits.min(axis=1)
                best = np.where(letters, bits.argmin(axis=1), -1)
                score = np.where(letters, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accuracy(docs: DataFrame, found: DataFrame) -> float:
    """Share of held-out documents, with a known language, of which the prediction is right."""
    truth = docs.where(F.col("lang").isNotNull()).select(F.col("doc_id").alias("_d"), "lang")
    both = found.where("held_out").join(truth, F.col("doc_id") == F.col("_d"))
    return both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
