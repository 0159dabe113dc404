import random
import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import packing, tokens
from marlstone.llm.queries import op13_packing

SCHEMA = "doc_id long, text string, ids string, key long, sequence_id int"


@lru_cache
def _whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.file_of(tokens.BYTE_BPE))


def plain_ids(text):
    t = _whole()
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("a'sre ll\n\t 12é-–一か \x1c", max_size=60))
def test_ids_are_those_of_tokenizers(text):
    whole = tokens.byte_bpe()
    assert whole.ids(text) == whole.whole.encode(text, add_special_tokens=False).ids


def test_special_tokens_and_bytes():
    text = "a <|endoftext|> b"
    assert 50256 in tokens.byte_bpe().ids(text) and tokens.byte_bpe().ids(text) == plain_ids(text)[:-1]
    plain = tokens.byte_bpe(plain=True)
    assert 50256 not in plain.ids(text)
    part = plain.token_bytes()
    for s in (text, "naïve \U0001f600\x00\x7f", "  two  spaces\n\n"):
        assert b"".join(part[i] for i in plain.ids(s)) == s.encode()


def plain_first_fit(lengths, size):
    room, bins = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(size)
            bins.append([])
        room[at] -= lengths[i]
        bins[at].append(i)
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60), st.integers(0, 8))
def test_tree_is_first_fit_and_filling_leaves_little(lengths, slack):
    bins = packing.first_fit(lengths, 64)
    assert bins == plain_first_fit(lengths, 64)
    full = packing.filled([[(i, 0, lengths[i]) for i in b] for b in bins], 64, slack)
    seen = sorted(p for b in full for p in b)
    for i, n in enumerate(lengths):
        own = [(s, e) for k, s, e in seen if k == i]
        assert own[0][0] == 0 and own[-1][1] == n and all(a[1] == b[0] for a, b in zip(own, own[1:])) and all(s < e for s, e in own)
    for b in full:
        n = sum(e - s for _, s, e in b)
        assert n <= 64 and (64 - n <= slack or n & (n - 1) == 0)


def check(rows, docs, slack=packing.SLACK):
    """Each id of each document in exactly one piece, sequences gapless and nearly full."""
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        n = sum(r.length for r in parts)
        assert 0 < n <= 2048 and (2048 - n <= slack or n & (n - 1) == 0)
    want = {}
    for i, text in docs:
        want.setdefault(i, []).append(plain_ids(text))
    assert set(want) == set(by_doc)
    for i, all_ids in want.items():
        if len({len(x) for x in all_ids}) == 1 and all(x == all_ids[0] for x in all_ids):
            ids, parts = all_ids[0], by_doc[i]
            assert sum(r.length for r in parts) == len(ids) * len(all_ids)
            cover = np.zeros(len(ids) + 1, int)
            for r in parts:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
                cover[r.start] += 1
                cover[r.start + r.length] -= 1
            assert set(np.cumsum(cover)[:-1]) == {len(all_ids)}


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(op13_packing(spark, sf).collect(), docs)


@pytest.mark.parametrize("group", [16, 100_000])
def test_odd_rows(spark, group):
    rng = random.Random(5)
    word = lambda: rng.choice(["stone", "ire", "Quarz", "1912", "--", "\n", "über", "<|endoftext|>", "\U0001f600"])
    docs = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 30, 900, 3000])))) for i in range(60)]
    docs += [(100, None), (101, ""), (None, "no id"), (102, "x" * 7_000), (103, " " * 150_000)] + [(200 + i, "long " * 1400) for i in range(40)] + [(300, "same row")] * 50
    df = spark.createDataFrame([(i, t, "clash", 7, 1) for i, t in docs], SCHEMA).repartition(3)
    got = packing.report(df, group=group).collect()
    check(got, docs)
    assert len({(r.doc_id, r.start, r.length) for r in got if r.doc_id in (100, 101)}) == 2


def test_empty_table(spark):
    got = packing.report(spark.createDataFrame([], SCHEMA))
    assert got.count() == 0 and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
