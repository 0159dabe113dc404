import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marlstone.llm import language

SCHEMA = "doc_id long, text string, lang string, lang_pred string"


def plain_length(train: list[bytes], text: bytes, order: int) -> float:
    """Code length by walking the contexts one byte at a time."""
    counts = defaultdict(Counter)
    for t in train:
        p = b"\0" * order + t
        for i in range(order, len(p)):
            for k in range(order + 1):
                counts[p[i - k : i]][p[i]] += 1
    total, p = 0.0, b"\0" * order + text
    for i in range(order, len(p)):
        for k in range(order, -1, -1):
            c = counts.get(p[i - k : i])
            if c:
                whole = sum(c.values()) + len(c)
                if p[i] in c:
                    total -= math.log2(c[p[i]] / whole)
                    break
                total -= math.log2(len(c) / whole)
        else:
            total += 8
    return total


def test_lengths_against_plain_walk():
    rng = np.random.default_rng(3)
    make = lambda n, letters: bytes(rng.choice(list(letters), n).tolist())
    train = {"a": [make(300, b"abcd "), b"", make(50, b"abxy")], "b": [make(400, b"bcde \xc3\xa9")]}
    texts = [make(40, b"abcdexyz \xff"), b"", make(3, b"ab"), make(700, b"abcde ")]
    model = language.Model(train, 3)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    for block in (1 << 19, 64):
        language.BLOCK = block
        got = model.lengths(offsets, data)
        want = [[plain_length(train[x], t, 3) for x in model.langs] for t in texts]
        assert got == pytest.approx(np.array(want), abs=1e-6)
    language.BLOCK = 1 << 19


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.fit(docs))
    assert language.accuracy(docs, found) > 0.97
    for r in found.limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1


def test_edges(spark):
    rows = [(i, "the cat sat on the mat " * 3, "en", "x") for i in range(0, 40)] + [(i, "le chat est ici très bien ", "fr", "") for i in range(40, 80)]
    rows += [(100, None, "en", ""), (101, "", None, ""), (102, "12 34 !?", "en", ""), (None, "the cat", None, None), (103, "le chat " * 50_000, None, ""), (103, "le chat", "fr", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = language.identify(docs, language.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and by[None].lang_pred == "en" and not by[None].held_out and by[103].lang_pred == "fr"
    nothing = language.identify(docs, language.fit(docs.limit(0))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language.identify(docs.limit(0), language.fit(docs)).count() == 0
