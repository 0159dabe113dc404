r"""Personal data, and terms that reveal it, with built-in functions only.

Entities (email, ip, card, phone) are found by patterns in whole texts. A term that stands in several different
texts with an entity, and seldom elsewhere, reveals the entity even after that is removed. How strongly is estimated from the
corpus: pointwise mutual information of term and entity over the entity's own information content,

    disclosure = log2(n(t, e) N / (n(t) n(e))) / log2(N / n(e)),

with N the number of different texts, n(t) and n(e) of those with the term or entity, n(t, e) of those with both, wherever they stand. It is 1 where the term occurs with the entity only. Terms from
``REMOVE`` on are removed, terms from ``GENERALISE`` on give way to a class, at every place in every text, whether it holds the entity or not: the term alone tells of it. Copies of a text count once.
Terms are runs of letters and digits outside entities.

Positions are code points. Spark has no function for the positions of all matches, but a text split at a pattern gives the
pieces between its matches, and their lengths add up to the positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: Patterns of the contract. Runs that can't be parted are possessive, and start where a run starts or the last match ended, so that no text takes more than linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What every text with a match of the kind has.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TERM = r"[\p{L}\p{N}]+"
RUN = 256
SUPPORT = 3  # different texts
GENERALISE, REMOVE = 0.8, 0.95
SPAN = "array<struct<start:int,k:int,end:int,hit:string>>"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before(values: Column, op) -> Column:
    """What the associative ``op`` (of 0 and ints) makes of all ``values`` before each one.

    An array that grows by one copies itself, so blocks of ``RUN`` values are summed up first and then gone through: n ints take about n * (RUN + n / RUN**2) steps.
    """

    def through(xs, first):
        zero = F.struct(first.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def blocks(xs):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int")), lambda i: F.slice(xs, i * RUN + 1, F.lit(RUN)))

    def composed(runs):
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), op))
        return F.flatten(F.zip_with(runs, through(sums, F.lit(0)), through))

    return let(values, lambda xs: F.when(F.size(xs) > 0, let(blocks(xs), composed)).otherwise(F.expr("cast(array() as array<int>)")))


def matches(text: Column, pattern: str) -> Column:
    """(start, end, hit) of all matches, leftmost first and not overlapping."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p)), hits, lambda g, h: F.struct(g.alias("gap"), F.coalesce(F.char_length(h), F.lit(0)).alias("size"), h.alias("hit")))

    def placed(xs):
        at = before(F.transform(xs, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
        return F.zip_with(xs, at, lambda x, a: F.struct((a + x["gap"]).alias("start"), (a + x["gap"] + x["size"]).alias("end"), x["hit"].alias("hit")))

    return F.filter(let(pairs, placed), lambda m: m["hit"].isNotNull())


def replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with each of ``spans`` (start, end and more, by start) replaced by ``by`` of the span and the end of those before it.

    A place is looked up in blocks of 1024 code points, as ``substring`` counts from a text's start.
    """

    def block(blocks, k):
        return F.coalesce(F.get(blocks, k), F.lit(""))

    def piece(blocks, low, high):
        i, j, a, b = F.shiftright(low, 10), F.shiftright(high, 10), low.bitwiseAND(1023), high.bitwiseAND(1023)
        middle = F.array_join(F.slice(blocks, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        apart = F.concat(F.substring(block(blocks, i), a + 1, F.lit(1024)), middle, F.substring(block(blocks, j), F.lit(1), b))
        return F.when(high <= low, "").when(i == j, F.substring(block(blocks, i), a + 1, high - low)).otherwise(apart)

    def made(blocks):
        ends = F.transform(spans, lambda s: s["end"])
        parts = F.zip_with(spans, before(ends, lambda a, b: F.greatest(a, b)), lambda s, p: F.concat(piece(blocks, p, s["start"]), by(s, p)))
        return F.concat(F.array_join(parts, ""), piece(blocks, F.coalesce(F.array_max(ends), F.lit(0)), F.char_length(text)))

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,1024}"), F.lit(0)), made)


def masked(text: Column, spans: Column) -> Column:
    """``text`` with spaces for what the spans cover; other places stay where they are."""
    return replaced(text, spans, lambda s, p: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(p, s["start"]))))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))


def luhn(digits: Column) -> Column:
    size = F.char_length(digits)

    def step(acc, i):
        d = F.substring(digits, size - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), step) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return F.char_length(digits).between(14, 19) & luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(10, 15)
    return F.lit(True)


def _valid_of(kind: str):
    return lambda m: valid(kind, m["hit"])


def _numbered(found: Column, k: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), m["hit"].alias("hit")))


def _count(spans: Column, k: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")


def base_spans(text: Column) -> Column:
    """All valid spans, ordered by start, then kind; a null text has none."""
    none = F.expr(f"cast(array() as {SPAN})")
    parts = []
    for k, kind in enumerate(KINDS):
        found = _numbered(F.filter(matches(text, PATTERNS[kind]), _valid_of(kind)), k)
        parts.append(F.when(F.instr(text, "@") > 0 if kind == "email" else text.rlike(HINTS[kind]), found).otherwise(none))
    return F.sort_array(F.concat(*parts))


def label(kind: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, [*KINDS, "term"])), kind + 1)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", label(s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def entity(kind: Column, hit: Column) -> Column:
    """What is the same for all ways to write one entity."""
    return F.concat(label(kind), F.lit(":"), F.when(kind.isin(KINDS.index("card"), KINDS.index("phone")), F.regexp_replace(hit, "[^0-9]", "")).otherwise(F.lower(hit)))


def find(docs: DataFrame, run: Scratch, keep: list[str], support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """The columns ``keep`` of ``docs``, then ``spans`` (of the base kinds) and ``terms``: spans of revealing terms with their ``disclosure``, in every text that holds them.

    Every row has a result: repeated rows and null ids too; null and empty texts have no spans.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*dict.fromkeys([*keep, "text"]), F.xxhash64(text).alias("_text"), base_spans(text).alias("spans"))
    rows = rows.withColumn("_m", F.when(F.size("spans") > 0, masked(text, F.col("spans"))))
    rows = run.table("base", rows.withColumn("_row", F.monotonically_increasing_id()))
    plain = F.coalesce("_m", "text", F.lit(""))
    held = rows.where(F.size("spans") > 0).select("_text", F.explode(F.array_distinct(F.transform("spans", lambda s: entity(s["k"], s["hit"])))).alias("entity")).distinct()
    # No term is in more texts with an entity than the entity itself.
    n_e = run.table("entities", held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= support))
    held = run.table("held", held.join(n_e, "entity").select("_text", "entity"))
    # One row of each text, so that words need no shuffle to be counted once a text: they are summed up by term before they are dealt.
    first = rows.groupBy("_text").agg(F.min("_row").alias("_row"))
    one = run.table("one", rows.join(first.select("_row"), "_row", "left_semi").select("_text", plain.alias("_t")))
    said = one.join(held.groupBy("_text").agg(F.collect_list("entity").alias("_e")), "_text").select("_e", F.explode(terms_of(F.col("_t"))).alias("term"))
    n_te = said.select(F.explode("_e").alias("entity"), "term").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te")).where(F.col("n_te") >= support)
    n_te = run.table("together", n_te)
    n_t = one.select(F.explode(terms_of(F.col("_t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = one.count()
    info = F.log2(F.lit(float(total)) / F.col("n_e"))
    told = F.log2(F.col("n_te") * F.lit(float(total)) / (F.col("n_t") * F.col("n_e")))
    flagged = n_te.join(n_e, "entity").join(n_t, "term").where(info > 0).select("term", (told / info).alias("disclosure")).where(F.col("disclosure") >= generalise)
    flagged = run.table("flagged", flagged.groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    hold = run.table("hold", rows.select("_row", F.explode(terms_of(plain)).alias("term")).join(flagged, "term"))
    # Words whose hash none of the row's terms has are left out before the join; a row has at most 4096 of these hashes, however many terms.
    part = lambda t: F.pmod(F.xxhash64(t), F.lit(4096)).cast("int")
    marks = hold.groupBy("_row").agg(F.collect_set(part("term")).alias("_b"))
    found = F.filter(matches(plain, TERM), lambda m: F.array_contains(F.col("_b"), part(F.lower(m["hit"]))))
    places = rows.join(marks, "_row").select("_row", F.explode(found).alias("m"))
    terms = places.select("_row", F.lower("m.hit").alias("term"), "m.start", "m.end").join(hold, ["_row", "term"])
    terms = terms.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("k"), "end", "disclosure", F.col("term").rlike("^[0-9]+$").alias("number")))).alias("_terms"))
    none = F.expr("cast(array() as array<struct<start:int,k:int,end:int,disclosure:double,number:boolean>>)")
    return rows.join(terms, "_row", "left").select(*keep, "spans", F.coalesce("_terms", none).alias("terms"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base ones and terms) and n_term of every row of ``docs`` (doc_id, text)."""
    found = find(docs, Scratch(docs.sparkSession, "privacy"), ["doc_id"])
    spans, terms = F.col("spans"), F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    base = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    counts = [_count(spans, k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.sort_array(F.concat(base, terms))).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitise(docs: DataFrame, remove: float = REMOVE) -> DataFrame:
    """``docs`` with entities and revealing terms replaced in ``text``; rows and columns stay, null texts stay null.

    Entities become ``[EMAIL]`` and so on; terms become ``[NUMBER]`` or ``[TERM]``, or nothing if their disclosure is ``remove`` or more.
    """
    # Other columns travel as one, so that none can be taken for a column of this operator.
    doc = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"] or [F.lit(0).alias("none")])
    found = find(docs.select("text", doc.alias("doc")), Scratch(docs.sparkSession, "privacy"), ["text", "doc"])
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(label(s["k"])), F.lit("]")).alias("by")))
    word = lambda s: F.when(s["disclosure"] >= remove, "").when(s["number"], "[NUMBER]").otherwise("[TERM]")
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), word(s).alias("by")))
    # A span that begins inside another adds no replacement, but what it covers goes.
    text = replaced(F.col("text"), F.sort_array(F.concat(base, terms)), lambda s, p: F.when(s["start"] >= p, s["by"]).otherwise(""))
    text = F.when(F.size("spans") + F.size("terms") > 0, text).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
