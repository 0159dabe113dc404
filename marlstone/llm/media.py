"""Media columns: interleaved document sequences.

A page's HTML is parsed into items in reading order: text blocks and references to media, each with its position and, for media, the
caption (figcaption, else alt). References carry the digest of what they refer to. Payloads live once, in their
stored form, in a media table; a join on the digest resolves the references, so that a payload is never copied
into the sequences, and a page's items keep their positions and captions whatever becomes of the join.

Bytes are stored as 8-bit grey PGM images of 64 columns, which is lossless.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.scratch import Scratch

COLUMNS = 64
BLOCKS = {"p", "div", "br", "li", "ul", "ol", "tr", "td", "th", "table", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "figure", "figcaption", "blockquote", "pre", "body", "head", "nav", "header", "footer", "main", "title"}
HIDDEN = {"script", "style", "template", "noscript"}
MEDIA = {"img": "image", "audio": "audio", "video": "video", "source": "source", "embed": "embed"}
ITEM = "page_id long, pos int, kind string, text string, ref string, caption string"
PREFIX = "sha256:"


class Items(HTMLParser):
    """Collects (kind, text, ref, caption) in reading order.

    A figure's caption goes to all its media, before or after it; without media it is a text item where it stands. What is in hidden elements is left out, text and media.
    ``shown`` are names of hidden elements that count as shown, as where they are never closed.
    """

    def __init__(self, shown: frozenset = frozenset()):
        super().__init__(convert_charrefs=True)
        self.kinds = HIDDEN - shown
        self.open: list[str] = []
        self.said: tuple[int, str] | None = None
        self.items: list[list] = []
        self.text: list[str] = []
        self.caption: list[str] | None = None
        self.figure: list[int] | None = None

    def _block(self) -> None:
        whole = "".join(self.text)
        if whole.strip():
            self.items.append(["text", whole, None, None])
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.kinds:
            self.open.append(tag)
        if tag in BLOCKS:
            self._block()
        if tag == "figure":
            self._told()
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        named = dict(attrs)
        if tag in MEDIA and named.get("src") and not self.open:
            self._block()
            if self.figure is not None:
                self.figure.append(len(self.items))
            self.items.append([MEDIA[tag], None, named["src"], named.get("alt")])

    def handle_endtag(self, tag):
        if tag in self.open:
            self.open.reverse()
            self.open.remove(tag)
            self.open.reverse()
        elif tag == "figcaption" and self.caption is not None:
            self.said, self.caption = (len(self.items), "".join(self.caption).strip()), None
            if self.figure is None:
                self._told()
        elif tag in BLOCKS:
            self._block()
        if tag == "figure":
            self._told()
            self.figure = None

    def _told(self) -> None:
        """Give the caption that was read to the figure's media, or leave it as text."""
        if self.said is None:
            return
        (at, said), self.said = self.said, None
        for i in self.figure or []:
            self.items[i][3] = said
        if not self.figure and said:
            self.items.insert(at, ["text", said, None, None])

    def handle_data(self, data):
        if self.open:
            return
        (self.text if self.caption is None else self.caption).append(data)

    def close(self):
        super().close()
        if self.caption is not None:  # never closed
            self.said, self.caption = (len(self.items), "".join(self.caption).strip()), None
        self._block()
        self._told()


def items_of(page: str | None) -> list[list]:
    if not page:
        return []
    parser = Items()
    parser.feed(page)
    parser.close()
    if parser.open:  # an element that is never closed hides nothing
        parser = Items(frozenset(parser.open))
        parser.feed(page)
        parser.close()
    return parser.items


def interleave(pages: DataFrame) -> DataFrame:
    """The items of each page (page_id, html): page_id, pos, kind, text, ref, caption; positions count from 0. Null or empty pages have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, *x) for p, h in zip(batch["page_id"], batch["html"]) for i, x in enumerate(items_of(h))]
            out = pd.DataFrame(rows, columns=["page_id", "pos", "kind", "text", "ref", "caption"])
            yield out.astype({"page_id": "Int64", "pos": "int32"})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInPandas(run, ITEM)


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """Add the media table's columns to the items whose ref is ``sha256:`` and its digest; other items have nulls there.

    ``media``: digest and further columns, in any number of rows a digest, all alike; one is kept. All items stay, with their positions and captions.
    Text items aren't dealt by their missing digest, so they meet in no single task.
    """
    rest = [c for c in media.columns if c != "digest"]
    one = media.groupBy("digest").agg(*[F.first(c).alias(c) for c in rest])
    key = F.when(F.col("ref").startswith(PREFIX), F.substring("ref", len(PREFIX) + 1, 64))
    refs = items.where(key.isNotNull()).withColumn("_key", key)
    found = refs.join(one.withColumnRenamed("digest", "_digest"), F.col("_key") == F.col("_digest"), "left").drop("_key", "_digest")
    return found.unionByName(items.where(key.isNull()), allowMissingColumns=True)


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: empty), with bytes 0 up to a positive multiple of 64."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    size = F.greatest(F.lit(1), F.ceil(F.length(raw) / COLUMNS)) * COLUMNS
    return F.rpad(raw, size.cast("int"), F.lit(bytearray(b"\0")))


def stored(payload: Column) -> Column:
    """The payload as a binary PGM image."""
    rows = (F.length(payload) / COLUMNS).cast("int").cast("string")
    return F.concat(F.encode(F.concat(F.lit(f"P5\n{COLUMNS} "), rows, F.lit("\n255\n")), "UTF-8"), payload)


def samples(image: bytes) -> np.ndarray:
    """The samples of a stored image, a row for each 64."""
    kind, size, most, data = bytes(image).split(b"\n", 3)
    w, h = map(int, size.split())
    if kind != b"P5" or most != b"255" or len(data) != w * h:
        raise ValueError("not an image of this store")
    return np.frombuffer(data, np.uint8).reshape(h, w)


def feature(rows: np.ndarray) -> str:
    """Average hash: for each of 64 columns, whether its mean exceeds the mean of all; then mean and deviation in 1/1000."""
    means = rows.mean(axis=0)
    bits = int("".join("1" if m > means.mean() else "0" for m in means), 2)
    return f"{bits:016x}:{round(float(means.mean()) * 1000)}:{round(float(rows.std()) * 1000)}"


READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, feature string"


def describe(media: DataFrame) -> DataFrame:
    """Read stored images back and compute what is kept of each, with the image's own digest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for image in batch["image"]:
                rows = samples(image)
                data = rows.tobytes()
                out.append((hashlib.sha256(image).hexdigest(), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(image), feature(rows)))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in READ.split(", ")])

    return media.select("image").mapInPandas(run, READ)


def text_media(docs: DataFrame) -> DataFrame:
    """Store each document's whole text as an image, and make its page, parse it and resolve what it refers to.

    Returns doc_id, pos, caption, digest (of the stored image) and what ``describe`` gives, one row for each row of ``docs`` (doc_id, text).
    Every document's page holds a text block (its id) and one figure, whose reference ends in the unpadded size as a fragment. Null ids and repeated rows are kept; other columns are ignored.
    """
    run = Scratch(docs.sparkSession, "media")
    payload = payload_of(F.col("text"))
    kept = docs.select(F.col("doc_id").cast("long").alias("page_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), stored(payload).alias("image"))
    kept = run.table("store", kept.withColumn("digest", F.sha2("image", 256)))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    page = F.concat(F.lit("<article><p>document "), name, F.lit(f'</p><figure><img src="{PREFIX}'), F.col("digest"), F.lit("#"), F.col("n_bytes").cast("string"), F.lit('" alt="text"><figcaption>text of '), name, F.lit("</figcaption></figure></article>"))
    items = interleave(kept.select("page_id", page.alias("html")))
    found = resolve(items.where(F.col("kind") == "image"), describe(kept))
    return found.select(F.col("page_id").alias("doc_id"), "pos", "caption", F.substring("ref", len(PREFIX) + 1, 64).alias("digest"), F.substring_index("ref", "#", -1).cast("long").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature")
