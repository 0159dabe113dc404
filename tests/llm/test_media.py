import hashlib
import zlib

import numpy as np

from marlstone.llm import media
from marlstone.llm.queries import op5_media


def plain(text):
    raw = (text or "").encode()
    pay = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
    image = b"P5\n64 %d\n255\n" % (len(pay) // 64) + pay
    return len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), len(image), hashlib.sha256(image).hexdigest(), media.feature(np.frombuffer(pay, np.uint8).reshape(-1, 64))


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature) for r in df.collect()), key=repr)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows(op5_media(spark, sf)) == sorted(((r.doc_id, *plain(r.text)) for r in docs.collect()), key=repr)


def test_edges(spark):
    data = [(1, None, 3), (2, "", 3), (None, "é" * 40, 3), (4, "x" * 64, None), (4, "x" * 64, None), (5, "y" * 1_000_001, 1), (6, "\0", 1), (7, '<p>"&\n', 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_bytes int")
    got = media.text_media(docs).withColumnRenamed("digest", "media_sha256")
    assert rows(got) == sorted(((d, *plain(t)) for d, t, _ in data), key=repr)
    assert {r.caption for r in got.collect()} >= {"text of 1", "text of none"} and {r.pos for r in got.collect()} == {1}
    assert media.text_media(docs.limit(0)).count() == 0


def test_items_stay_aligned(spark):
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><p>one &amp; two<figure><img src="sha256:aa"><img src="x.png" alt="a"><figcaption>Cap <b>1</b></figcaption></figure>three<img src="sha256:bb" alt="B"> four</p><audio></audio><p> </p>'
    assert media.items_of(page) == [["text", "T", None, None], ["text", "one & two", None, None], ["image", None, "sha256:aa", "Cap 1"], ["image", None, "x.png", "Cap 1"], ["text", "three", None, None], ["image", None, "sha256:bb", "B"], ["text", " four", None, None]]
    pages = spark.createDataFrame([(1, page, ""), (2, None, ""), (3, "", ""), (None, "plain", "")], "page_id long, html string, kind string")
    store = spark.createDataFrame([("aa", 7), ("aa", 7), ("zz", 9)], "digest string, size int")
    got = sorted(((r.page_id, r.pos, r.kind, r.caption, r.size) for r in media.resolve(media.interleave(pages), store).collect()), key=repr)
    assert len(got) == 8 and (1, 2, "image", "Cap 1", 7) in got and (1, 5, "image", "B", None) in got and (None, 0, "text", None, None) in got


def test_captions_and_hidden_elements():
    page = '<p>a</p><figure><figcaption>Cap</figcaption><img src="x" alt="alt"><img src="y"></figure><p>b</p><figure><img src="z" alt="q"></figure><figure><figcaption>alone</figcaption></figure><p>c</p>'
    assert media.items_of(page) == [["text", "a", None, None], ["image", None, "x", "Cap"], ["image", None, "y", "Cap"], ["text", "b", None, None], ["image", None, "z", "q"], ["text", "alone", None, None], ["text", "c", None, None]]
    assert media.items_of('<p>a</p><template><img src="x">no</template><p>b</p>') == [["text", "a", None, None], ["text", "b", None, None]]
    assert media.items_of('<p>a</p><noscript>x<p>b</p><img src="y">') == [["text", "a", None, None], ["text", "x", None, None], ["text", "b", None, None], ["image", None, "y", None]]
    assert media.items_of("<figure><img src='x'><figcaption>open") == [["image", None, "x", "open"]]
