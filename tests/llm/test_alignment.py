import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import alignment, tokens
from marlstone.llm.queries import op12_alignment

SCHEMA = "doc_id long, text string, a string, pair int"


@pytest.fixture(scope="module")
def plain():
    """Both tokenizations by the libraries themselves: lists of (id, begin, end)."""
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(tokens.file_of(tokens.BYTE_BPE))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokens.file_of(tokens.PIECE_BPE))
    byte = tokens.byte_alphabet()

    def spans(ids, parts):
        out, at = [], 0
        for i, p in zip(ids, parts):
            out.append((i, at, at + len(p)))
            at += len(p)
        return out, b"".join(parts)

    def run(text):
        if not text:
            return [], []
        a = first.encode(f" {text}", add_special_tokens=False).ids
        a, a_bytes = spans(a, [bytes(byte[c] for c in first.id_to_token(i)) for i in a])
        b = second.encode(text)
        names = [second.id_to_piece(i) for i in b]
        b, b_bytes = spans(b, [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names)])
        return (a, b) if a_bytes == b_bytes == f" {text}".encode() else ([], [])

    return run


def brute(rows, plain):
    found = [(i, *plain(t)) for i, t in rows]
    links = [[(x, y) for x, _, e in a for y, _, f in b if e == f] for _, a, b in found]
    count = Counter(p for each in links for p in each)
    most = {}
    for (_, y), n in count.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for (i, a, b), own in zip(found, links):
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        part = lambda x, s, e: ",".join(str(t) for t, u, v in x if s <= u and v <= e)
        text = ";".join(f"{part(a, s, e)}|{part(b, s, e)}" for s, e in zip([0, *cuts], cuts))
        out.append((i, len(a), len(b), len(cuts), len(own), sum(count[p] == most[p[1]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def test_same_as_brute_force(spark, sf, plain):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 3000")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert len(rows) > 100
    assert sorted(map(tuple, alignment.report(docs).collect()), key=repr) == brute(rows, plain)


def test_registered_query_takes_whole_table(spark, sf, plain):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op12_alignment(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        a, b = plain(docs[r.doc_id])
        assert (r.n_a, r.n_b) == (len(a), len(b)) and r.n_groups == r.n_links == len({e for _, _, e in a} & {e for _, _, e in b})


def test_odd_rows(spark, plain):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "a <|endoftext|> <s> </s> <unk> <0x41>"), (4, "holds ▁ which is no space"), (5, "\x00\x01 é \U0001f600 か　"), (6, " "), (7, "\n\n  tabs\t\t "), (8, "ab" * 40_000)]
    rows += [(9, "the same row, again and again")] * 30 + [(9, "another text of one id")]
    df = spark.createDataFrame([(i, t, "clash", 3) for i, t in rows], SCHEMA)
    small = [r for r in rows if r[0] != 8]
    for n in (1, 4):
        assert sorted(map(tuple, alignment.report(df.where("doc_id IS NULL OR doc_id <> 8").repartition(n)).collect()), key=repr) == brute(small, plain)
    r = alignment.report(df.where("doc_id = 8")).first()
    assert r.n_groups == r.n_links > 0
    assert {r.doc_id: r.n_a for r in alignment.report(df).collect()}[4] == 0


def test_empty_table(spark):
    assert alignment.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_groups_of_tokens(spark, plain):
    text = "Zorblat naïvely tokenised <|endoftext|>"
    r = alignment.alignments(spark.createDataFrame([(1, text, "", 0)], SCHEMA)).first()
    a, b = plain(text)
    assert r.a == [i for i, _, _ in a] and r.b == [i for i, _, _ in b]
    assert [a[k - 1][2] for k in r.a_upto] == [b[k - 1][2] for k in r.b_upto] and r.a_upto[-1] == len(a) and r.b_upto[-1] == len(b)


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300)), st.sets(st.integers(0, 300)))
def test_bitsets(x, y):
    a, b = (alignment.packed(np.array(sorted(s), int), 301) for s in (x, y))
    both = alignment.select(a & b)
    assert both.tolist() == sorted(x & y)
    assert alignment.rank(a, both).tolist() == [sum(i <= p for i in x) for p in both]
