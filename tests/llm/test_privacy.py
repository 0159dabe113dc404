import hashlib
import math
import re

from pyspark.sql import functions as F

from marlstone.llm import privacy
from marlstone.scratch import Scratch

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end(), kind, m[0]))
    return sorted(out)


def check(df, rows):
    want = []
    for d, t in rows:
        p = plain(t)
        want.append((d, *[sum(x[3] == kind for x in p) for kind in privacy.KINDS], hashlib.sha256(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in p).encode()).hexdigest()))
    got = privacy.report(df).collect()
    assert sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got), key=repr) == sorted(want, key=repr)
    return got


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = check(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert sum(r.n_email for r in got) > 5 and sum(r.n_card for r in got) > 0


def test_edges(spark):
    texts = [None, "", "a@b", "a@b.c_x@e.f", "é😀 a.b+c@d-e.co.uk, x@y.z@q.r.s", "1.2.3.4.5 01.02.003.255 256.1.1.1 1.2.3 0000000000001.2.3.4 1.2.3.4.5.6.7.8", "4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111", "+1 (202) 555-0147 +12 3 +1.2.3", "x" * 300_000, "9" * 100_000, "a@" + "b." * 20_000, "." * 50_000 + "@", "1.1.1.1", "+" * 1000 + "49 30 1234567890 5"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q@w.e"), (3, "q@w.e"), (3, "q@w.e")]
    df = spark.createDataFrame([(*r, "s", "t") for r in rows], "doc_id long, text string, spans string, terms string")
    check(df, rows)
    assert privacy.report(df.limit(0)).count() == 0
    clean = privacy.sanitise(df)
    assert clean.columns == df.columns and clean.where("spans = 's' AND terms = 't'").count() == len(rows)
    assert {r.text for r in clean.where("doc_id = 0 OR doc_id = 12").collect()} == {None, "[IP]"}


def test_revealing_terms_against_plain_counts(spark):
    who = "call Zorblat at zor@blat.org in 4711 today"
    rows = [(i, f"text {i} says {who} number{i}") for i in range(6)] + [(10, "we say call the office today in text"), (11, "Zorblat alone")] + [(20 + i, f"other text {i} with call in today and words at says") for i in range(60)] + [(90 + i, rows_) for i, rows_ in enumerate([f"text 0 says {who} number0"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = sorted({t for _, t in rows})
    n, tokens = len(texts), {t: {w.lower() for w in re.findall(r"[^\W_]+", t)} for t in texts}
    near = {t: tokens[t] - {"zor", "blat", "org"} for t in texts if "zor@blat.org" in t}
    want = set()
    for w in set().union(*near.values()):
        n_te, n_t = sum(w in s for s in near.values()), sum(w in s for s in tokens.values())
        if n_te >= privacy.SUPPORT and math.log2(n_te * n / (n_t * len(near))) / math.log2(n / len(near)) >= privacy.GENERALISE:
            want.add(w)
    assert "zorblat" in want and "4711" in want and "call" not in want
    got = privacy.find(df, Scratch(spark, "t"), ["doc_id", "text"]).collect()
    for r in got:
        assert {r.text[s.start : s.end].lower() for s in r.terms} == want & near.get(r.text, tokens[r.text])
    clean = {r.doc_id: r.text for r in privacy.sanitise(df).collect()}
    assert "[EMAIL]" in clean[3] and "zor" not in clean[3].lower() and "call" in clean[3] and clean[10] == rows[6][1] and clean[11] == "[TERM] alone"


def test_revealing_terms_far_from_the_entity(spark):
    """A term is found at every place of the entity's texts, also when it never stands beside the entity."""
    far = " ".join(f"word{i}" for i in range(250))
    rows = [(i, f"é😀 Zorblat, {far} to zor@blat.org {far} from Quux. zorblat {i}") for i in range(4)] + [(20 + i, f"é other text {i} to {far} from") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in privacy.find(df, Scratch(spark, "t"), ["doc_id", "text"]).collect():
        assert [r.text[s.start : s.end] for s in r.terms] == (["Zorblat", "Quux", "zorblat"] if r.doc_id < 20 else [])
    clean = {r.doc_id: r.text for r in privacy.sanitise(df).collect()}
    assert clean[2] == f"é😀 , {far} to [EMAIL] {far} from .  2" and clean[20] == rows[4][1]


def test_long_texts_take_linear_time(spark):
    """A million numbers and ten thousand entities in one text: positions are those of a plain walk, and what is replaced lies between them."""
    rows = [(1, " ".join(str(i % 97) for i in range(1_000_000)) + " a@b.cc"), (2, ", ".join(f"é😀 user{i}@host.org calls 10.0.{i % 256}.7 x{i}" for i in range(10_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    clean = {r.doc_id: r.text for r in privacy.sanitise(df).collect()}
    assert clean[1] == rows[0][1].replace("a@b.cc", "[EMAIL]")
    assert clean[2] == ", ".join(f"é😀 [EMAIL] calls [IP] x{i}" for i in range(10_000))


def test_overlapping_spans(spark):
    """Spans that begin inside others, touch, or cover the ends of blocks."""
    text = "ab" * 1200
    spans = [(0, 3, "<A>"), (2, 5, "<B>"), (5, 6, "<C>"), (1000, 2100, "<D>"), (1023, 1030, "<E>"), (2399, 2400, "<F>")]
    df = spark.createDataFrame([(text, spans), ("", []), ("xyz", [(1, 2, "-")])], "text string, spans array<struct<start:int,end:int,by:string>>")
    got = [r.t for r in df.select(privacy.replaced(F.col("text"), F.col("spans"), lambda s, p: F.when(s["start"] >= p, s["by"]).otherwise("")).alias("t")).collect()]
    assert got == ["<A><C>" + text[6:1000] + "<D>" + text[2100:2399] + "<F>", "", "x-z"]
    assert [len(r.t) for r in df.select(privacy.masked(F.col("text"), F.col("spans")).alias("t")).collect()] == [2400, 0, 3]
