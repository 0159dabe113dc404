"""Benchmark decontamination: size-partitioned MinHash containment search.

Documents are put in classes by their number of shingles (powers of four). Each class has its own
signature length, so that a signature has about two bins for each shingle of the longest document of the class: one
permutation, ``bins`` bins, the least hash in each. An item's shingles are binned once for
every class. A document is a candidate for an item if one bin holds the same hash in both: of
t shingles that they share each survives in its bin with probability exp(-size / bins) >= 0.6,
so that an item of ten shingles of which eight occur is missed with probability 0.4 ** 8 < 0.001,
however long the document is. Items of fewer than ``FEW`` shingles, whose every shingle counts, are looked up by all shingles
of a document instead, so that none is missed. Candidates are verified by exact containment of the item's shingles (the words
themselves, not their hashes) in the whole document.

Items of up to ``broadcast_items`` shingles in all are sent to all tasks; beyond that the signatures are joined.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.text import WordHashes, shingles_of, words_of

N = 5
THRESHOLD = 0.8
FEW = 10  # items of fewer different shingles are searched by each of them
BROADCAST_SHINGLES = 2_000_000  # 8 bytes each, and about 100 of Python objects for those of candidates
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def size_class(n: int) -> int:
    """Class c holds documents of 4 ** c .. 4 ** (c + 1) - 1 shingles."""
    return max(0, (max(1, n).bit_length() - 1) // 2)


def bins_of(c: int) -> int:
    return 2 * 4 ** (c + 1)


def signature(shingles: np.ndarray, bins: int) -> np.ndarray:
    """Least hash in each bin; empty bins hold the largest value."""
    out = np.full(bins, _TOP)
    np.minimum.at(out, (shingles & np.uint64(bins - 1)).astype(np.int64), shingles)
    return out


def grams(words: list[str], n: int) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return set(zip(*(words[i:] for i in range(n)))) if n else set()


class Index:
    """The items' shingles, and for each size class which (bin, least hash) leads to which items."""

    def __init__(self, items: list[tuple], n: int = N):
        self.n, hashes = n, WordHashes()
        self.items = [(key, words_of(text)) for key, text in items]
        self.by_hash: dict[int, list[int]] = defaultdict(list)
        self.short = sorted({len(w) for _, w in self.items if 0 < len(w) < n})
        self.own = [shingles_of(hashes.of(w), n) for _, w in self.items]
        self.grams: dict[int, set] = {}
        self.classes: dict[int, tuple[np.ndarray, dict[int, list[int]]]] = {}
        #: Of items of few shingles; they need no signature.
        self.few_seen = np.zeros(1 << 20, bool)
        for i, own in enumerate(self.own):
            if len(own := np.unique(own)) < FEW:
                self.own[i] = own[:0]
                self.few_seen[(own >> np.uint64(44)).astype(np.int64)] = True
                for h in own.tolist():
                    self.by_hash[h].append(i)

    def of_class(self, c: int):
        if c not in self.classes:
            least: dict[int, list[int]] = defaultdict(list)
            for i, own in enumerate(self.own):
                sig = signature(own, bins_of(c))
                for h in sig[sig != _TOP].tolist():
                    least[h].append(i)
            keys = np.fromiter(least, np.uint64, len(least))
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.classes[c] = (seen, least)
        return self.classes[c]

    def candidates(self, shingles: np.ndarray) -> set[int]:
        """Items of few shingles that share one, and others of which a signature bin agrees; the bin is a part of the hash, so equal hashes are in equal bins."""
        c = size_class(len(shingles))
        seen, least = self.of_class(c)
        sig = signature(shingles, bins_of(c))
        hit = sig[seen[(sig >> np.uint64(44)).astype(np.int64)]]
        few = shingles[self.few_seen[(shingles >> np.uint64(44)).astype(np.int64)]]
        return {i for h in hit.tolist() for i in least.get(h, ())} | {i for h in few.tolist() for i in self.by_hash.get(h, ())}

    def search(self, text: str | None, hashes: WordHashes, threshold: float) -> list[tuple]:
        words = words_of(text)
        if not words:
            return []
        h = hashes.of(words)
        found: set[int] = set()
        for n in [self.n, *[k for k in self.short if k <= len(words)]]:
            found |= self.candidates(shingles_of(h, n))
        out, sets = [], {}
        for i in found:
            key, own = self.items[i]
            n = min(self.n, len(own))
            if i not in self.grams:
                self.grams[i] = grams(own, n)
            if n not in sets:
                sets[n] = grams(words, n)
            if len(self.grams[i]) and (share := len(self.grams[i] & sets[n]) / len(self.grams[i])) >= threshold:
                out.append((key, share))
        return out


def search(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD, most: int = BROADCAST_SHINGLES) -> DataFrame:
    """Pairs (doc_id, item_id, containment) of items of which ``threshold`` or more of the shingles are in the document.

    ``docs``: doc_id, text; ``items``: item_id, text. Null or wordless texts match nothing; an item of fewer than
    ``n`` words is one shingle and matches where these words follow each other. Repeated items or
    documents each give their own pairs; null ids are kept. Other columns are ignored.
    """
    items = items.select("item_id", "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if size > 4 * most:
        return _joined(docs, items, n, threshold)
    index = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.where(F.col("text").isNotNull()).toLocalIterator()])
    key = items.schema["item_id"].dataType.simpleString()
    name = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, hashes = Index(index.value, n), WordHashes()
        for batch in batches:
            rows = [(d, i, s) for d, t in zip(batch["doc_id"], batch["text"]) for i, s in own.search(t, hashes, threshold)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "containment"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {name}, item_id {key}, containment double")


def _joined(docs: DataFrame, items: DataFrame, n: int, threshold: float) -> DataFrame:
    """The same search for sets of items of any size: signatures (and, as class -1, all shingles for items of few) are joined on (class, hash), then texts on the pairs."""
    key, name = items.schema["item_id"].dataType.simpleString(), docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for b in batches:
            yield pd.DataFrame({"k": [min(len(words_of(t)), n) for t in b["text"]]})

    lengths = [r[0] for r in items.select("text").mapInPandas(count, "k int").where("k > 0").distinct().collect()]  # n at most
    classes = range(0, 16)

    def of_docs(batches):
        hashes = WordHashes()
        for b in batches:
            rows = []
            for d, t in zip(b["doc_id"], b["text"]):
                h = hashes.of(words_of(t))
                for k in lengths:
                    if len(h) >= k:
                        s = shingles_of(h, k)
                        rows += [(d, -1, int(x)) for x in np.unique(s).view(np.int64)]
                        c = size_class(len(s))
                        sig = signature(s, bins_of(c))
                        rows += [(d, c, int(x)) for x in sig[sig != _TOP].view(np.int64)]
            yield pd.DataFrame(rows, columns=["doc_id", "c", "h"])

    def of_items(batches):
        hashes = WordHashes()
        for b in batches:
            rows = []
            for i, t in zip(b["item_id"], b["text"]):
                s = shingles_of(hashes.of(words_of(t)), n)
                if len(few := np.unique(s)) < FEW:
                    rows += [(i, -1, int(x)) for x in few.view(np.int64)]
                    continue
                for c in classes:
                    sig = signature(s, bins_of(c)) if c < 8 else s
                    rows += [(i, c, int(x)) for x in np.unique(sig[sig != _TOP]).view(np.int64)]
            yield pd.DataFrame(rows, columns=["item_id", "c", "h"])

    def verify(batches):
        for b in batches:
            rows = []
            for d, i, t, u in zip(b["doc_id"], b["item_id"], b["text"], b["item_text"]):
                own = grams(words_of(u), n)
                if own and (s := len(own & grams(words_of(t), min(n, len(words_of(u))))) / len(own)) >= threshold:
                    rows.append((d, i, s))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "containment"])

    left = docs.select("doc_id", "text").mapInPandas(of_docs, f"doc_id {name}, c int, h long")
    right = items.mapInPandas(of_items, f"item_id {key}, c int, h long")
    pairs = left.join(right, ["c", "h"]).select("doc_id", "item_id").distinct()
    texts = pairs.join(items.select(F.col("item_id").alias("_i"), F.col("text").alias("item_text")), F.col("item_id").eqNullSafe(F.col("_i")))
    texts = texts.join(docs.select(F.col("doc_id").alias("_d"), "text"), F.col("doc_id").eqNullSafe(F.col("_d")))
    return texts.select("doc_id", "item_id", "text", "item_text").mapInPandas(verify, f"doc_id {name}, item_id {key}, containment double")


def clean(docs: DataFrame, items: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that hold no item. Columns stay.

    Each row is judged by its own text: rows of one doc_id, or of none, with other texts don't share its fate; repeated rows do. A null text holds no item.
    """
    # Rows are told apart by id and text, both ways round, as one string that no other row has.
    name = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.hex(F.xxhash64("text")), F.hex(F.xxhash64(F.lit(1), F.col("text"))))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("doc"), "text", name.alias("_row"))
    hit = search(rows.select(F.col("_row").alias("doc_id"), "text"), items, n, threshold).select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(hit, "_row", "left_anti").select("doc.*")
