"""Cross-tokenizer alignment: byte cuts that two tokenizations share, and the links between tokens that end there.

The ends of a text's tokens are marked in a packed bitset over its bytes, one for each tokenizer. Their AND has the shared cuts; select lists them, and rank, by popcounts of
words and their prefix sums, maps each to the number of tokens that ended until then, so a pair of consecutive cuts is a range of tokens on both sides. No token is compared with another.

Every token has a byte at least, so at a shared cut one token of each side ends, and the two are a link. Of two byte ranges that end together one is a suffix of the
other, so the pairs of ids that can ever be linked follow from the two vocabularies (a few hundred thousand for the given files, whatever the corpus). Counts of pairs are therefore a
table of proven size: they are summed over the corpus in a shuffle of partial sums and go back to all tasks as one array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm import tokens
from marlstone.scratch import Scratch

ROWS = 256  # encoded together
CHARS = 1 << 20


class Aligned(NamedTuple):
    """Token ids of both sides, and for each shared cut how many tokens of each have ended."""

    a: np.ndarray
    b: np.ndarray
    a_upto: np.ndarray
    b_upto: np.ndarray


NONE = Aligned(*[np.empty(0, np.int32)] * 2, *[np.empty(0, np.int64)] * 2)


def packed(ends: np.ndarray, size: int) -> np.ndarray:
    """Bitset of ``size`` bits, in 64-bit words, with the bits ``ends`` set."""
    flags = np.zeros(-(-size // 64) * 64, bool)
    flags[ends] = True
    return np.packbits(flags, bitorder="little").view("<u8")


def select(bits: np.ndarray) -> np.ndarray:
    """Places of all set bits."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def rank(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bits are set up to each place, itself included."""
    ahead = np.append(0, np.cumsum(np.bitwise_count(bits), dtype=np.int64))
    low = (at & 63).astype(np.uint64)
    mask = (np.uint64(2) << low) - np.uint64(1)  # all ones where the shift runs out
    return ahead[at >> 6] + np.bitwise_count(bits[at >> 6] & mask)


class Aligner:
    """Both tokenizers, the bytes of their tokens and the pairs of ids that can be linked."""

    def __init__(self, a: str = tokens.BYTE_BPE, b: str = tokens.PIECE_BPE, ranks: str | None = tokens.BYTE_RANKS):
        self.first, self.second = tokens.byte_bpe(a, ranks, plain=True), tokens.piece_bpe(b)
        self.a_bytes, self.b_bytes = self.first.token_bytes(), self.second.token_bytes()
        self.a_len, self.b_len = (np.array([len(x) for x in part], np.int64) for part in (self.a_bytes, self.b_bytes))
        self.codes = _linkable(self.a_bytes, self.b_bytes)
        self.decimal = np.array([f"{i}{s}".encode() for s in ",|;" for i in range(self.most)], f"S{len(str(self.most)) + 1}").reshape(3, -1)

    @property
    def most(self) -> int:
        return max(len(self.a_bytes), len(self.b_bytes))

    def of(self, texts: list[str | None]) -> Iterator[Aligned]:
        """Null and empty texts, and those whose tokens don't give back the bytes of space + text, have no tokens."""
        there = [t for t in texts if t]
        second = iter(self.second.ids(there)) if there else iter(())
        for t in texts:
            yield self._one(f" {t}", next(second)) if t else NONE

    def _one(self, text: str, second: list[int]) -> Aligned:
        first, data = self.first.ids(text), text.encode()
        if b"".join(map(self.a_bytes.__getitem__, first)) != data or b"".join(map(self.b_bytes.__getitem__, second)) != data:
            return NONE
        a, b = np.array(first, np.int32), np.array(second, np.int32)
        ends_a, ends_b = (packed(np.cumsum(n), len(data) + 1) for n in (self.a_len[a], self.b_len[b]))
        cuts = select(ends_a & ends_b)
        return Aligned(a, b, rank(ends_a, cuts), rank(ends_b, cuts))

    def links(self, x: Aligned) -> np.ndarray:
        """Number of the id pair, in ``codes``, at each shared cut."""
        return np.searchsorted(self.codes, x.a[x.a_upto - 1].astype(np.int64) * len(self.b_bytes) + x.b[x.b_upto - 1])

    def digest(self, x: Aligned) -> str:
        """SHA-256 of ``a1,a2|b1;a3|b2,b3``, or '' without tokens."""
        if not len(x.a):
            return ""
        out = np.empty(len(x.a) + len(x.b), self.decimal.dtype)
        for ids, upto, other, mark in ((x.a, x.a_upto, np.append(0, x.b_upto[:-1]), 1), (x.b, x.b_upto, x.a_upto, 2)):
            own = np.diff(upto, prepend=0)
            sign = np.zeros(len(ids), np.int64)
            sign[upto - 1] = mark
            out[np.arange(len(ids)) + np.repeat(other, own)] = self.decimal[sign, ids]
        return hashlib.sha256(out.tobytes().replace(b"\0", b"")[:-1]).hexdigest()


def _linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Codes a * len(b) + b, in order, of all pairs of ids of which one's bytes end with the other's."""
    found: set[int] = set()
    for mine, other, code in ((a, b, lambda i, j: i * len(b) + j), (b, a, lambda i, j: j * len(b) + i)):
        by: dict[bytes, list[int]] = {}
        for j, x in enumerate(other):
            if x:
                by.setdefault(x, []).append(j)
        for i, x in enumerate(mine):
            for k in range(len(x)):
                found.update(code(i, j) for j in by.get(x[k:], ()))
    return np.array(sorted(found), np.int64)


@lru_cache(maxsize=2)
def aligner(a: str = tokens.BYTE_BPE, b: str = tokens.PIECE_BPE, ranks: str | None = tokens.BYTE_RANKS) -> Aligner:
    """One for each Python worker."""
    return Aligner(a, b, ranks)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in parts of ``ROWS`` and about ``CHARS`` characters at most, or of one longer text."""
    for b in batches:
        size = b["text"].str.len().fillna(0).to_numpy()
        low, held = 0, 0
        for i, n in enumerate(size):
            if i > low and (held + n > CHARS or i - low == ROWS):
                yield b.iloc[low:i]
                low, held = i, 0
            held += n
        if low < len(b):
            yield b.iloc[low:]


def alignments(docs: DataFrame, a: str = tokens.BYTE_BPE, b: str = tokens.PIECE_BPE, ranks: str | None = tokens.BYTE_RANKS) -> DataFrame:
    """doc_id, a and b (ids), a_upto and b_upto of every row of ``docs`` (doc_id, text): group g has the tokens upto[g-1] .. upto[g] - 1 of each side."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(a, b, ranks)
        for p in _parts(batches):
            found = list(both.of(p["text"].tolist()))
            yield pd.DataFrame({"doc_id": p["doc_id"].to_numpy()} | {c: [getattr(x, c) for x in found] for c in Aligned._fields})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, a array<int>, b array<int>, a_upto array<long>, b_upto array<long>")


def report(docs: DataFrame, a: str = tokens.BYTE_BPE, b: str = tokens.PIECE_BPE, ranks: str | None = tokens.BYTE_RANKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of ``docs`` (doc_id, text).

    A text that is null or empty, or whose tokens don't give back its bytes, has zeros and ''. Repeated rows count each; a null id is carried along; other columns are ignored; an
    empty table gives an empty one. Texts are encoded once; a table of linked pairs by text, each pair once with its number, is written and read twice.
    """
    spark = docs.sparkSession
    run = Scratch(spark, "alignment")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = aligner(a, b, ranks)
        for p in _parts(batches):
            found = list(both.of(p["text"].tolist()))
            pairs = [np.unique(both.links(x), return_counts=True) for x in found]
            yield pd.DataFrame(
                {"doc_id": p["doc_id"].to_numpy(), "n_a": [len(x.a) for x in found], "n_b": [len(x.b) for x in found], "n_groups": [len(x.a_upto) for x in found], "groups_sha256": [both.digest(x) for x in found]}
                | {"pair": [x.astype(np.int32) for x, _ in pairs], "times": [n.astype(np.int32) for _, n in pairs]}
            )

    columns = f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pair array<int>, times array<int>"
    rows = run.table("texts", docs.select("doc_id", "text").mapInPandas(count, columns))
    sums = rows.select(F.inline(F.arrays_zip("pair", "times"))).groupBy("pair").agg(F.sum("times").alias("n"))
    both = aligner(a, b, ranks)
    counts = np.zeros(len(both.codes), np.int64)
    told = sums.toPandas()  # len(codes) rows at most, which the two vocabularies bound
    counts[told["pair"]] = told["n"]
    second = both.codes % len(both.b_bytes)
    most = np.zeros(len(both.b_bytes), np.int64)
    np.maximum.at(most, second, counts)
    known = spark.sparkContext.broadcast((counts, counts == most[second]))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, best = known.value
        for p in batches:
            n = np.array([len(x) for x in p["pair"]], np.int64)
            pair, times = (np.concatenate([*p[c], np.empty(0, np.int32)]).astype(np.int64) for c in ("pair", "times"))
            upto = np.append(0, np.cumsum(n))

            def total(x: np.ndarray) -> np.ndarray:
                run = np.append(0, np.cumsum(x))
                return run[upto[1:]] - run[upto[:-1]]

            yield p.drop(columns=["pair", "times"]).assign(n_links=total(times), n_best=total(times * best[pair]), count_sum=total(times * counts[pair]))

    out = rows.mapInPandas(weigh, f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
