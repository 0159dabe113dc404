"""Readers, writers and streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.operators import eventlog
from marlstone.sources import readers, sinks
from marlstone.streaming import inbox


def test_mt3(spark, tmp_path):
    (tmp_path / "a.csv").write_text("2024.01.02,03:04,1,2,0.5,1.5,7,8,9\n2024.01.02,03:05,1,2,0.5,1.5,11\n")
    got = [tuple(r)[1:] for r in readers.mt3_csv(spark, str(tmp_path / "a.csv")).orderBy("ts").collect()]
    assert got == [(1, 2, 0.5, 1.5, 8, 9, 7), (1, 2, 0.5, 1.5, 11, 0, 0)]
    (tmp_path / "b.csv").write_text("2024.01.02,03:04,1\n")
    with pytest.raises(Exception, match="fewer than seven"):
        readers.mt3_csv(spark, str(tmp_path / "b.csv")).collect()


def test_kline_zips(spark, tmp_path):
    row = "{},1,2,0.5,1.5,10,0,20,3,4,5,0\n"
    for name, text in (("a", row.format(1704067200000)), ("b", "open_time,open\n" + row.format(1706745600000000) + row.format(1706745600000000))):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", text)
    got = readers.kline_zips(spark, str(tmp_path / "*.zip"))
    whole = readers.canonical_bars([got], "2024-01-01", "2024-02-10")
    assert [str(r.ts) for r in whole.collect()] == ["2024-01-01 00:00:00", "2024-02-01 00:00:00"] and whole.first().trades == 3
    with pytest.raises(ValueError, match="2024-03"):
        readers.canonical_bars([got], "2024-01-01", "2024-03-10")


def test_legacy_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("[BUY]\r\n1,2,3,4,5,6,7\r\nx\r\n2,2,3,4,5,6,7\r\n[SELL]\r\n3,2,3,4,5,6,7\r\n", encoding="utf-16")
    got = readers.sectioned_text(spark, str(tmp_path / "c.txt")).orderBy("section", "pos").collect()
    assert [(r.section, r.pos, r.cluster) for r in got] == [("BUY", 0, 1), ("BUY", 1, 2), ("SELL", 0, 3)]
    (tmp_path / "two.txt").write_text("[BUY]\r\n1,2,3,4,5,6,7\r\n", encoding="utf-16")
    both = readers.sectioned_text(spark, str(tmp_path / "*.txt")).groupBy("file", "section").count().collect()
    assert sorted((r.file.rsplit("/")[-1], r.section, r["count"]) for r in both) == [("c.txt", "BUY", 2), ("c.txt", "SELL", 1), ("two.txt", "BUY", 1)]
    (tmp_path / "d.csv").write_text("Time,Deal,Symbol,Type,Direction,Volume,Price,a,b,c,Profit,d,Comment\n2024.01.02 03:04:04,6,BTC,buy,in,0.1,42,x\n2024.01.02 03:04:05,7,BTC,buy,in,0.1,42.5,0,0,0,,0,\n2024.01.02 03:04:06,8,BTC,Sell,out,0.1,43,0,0,0,nan,0,tp 1\n2024.01.02 03:04:07,9,BTC,sell,out,0.1,44,0,0,0,3.5,0,\nshort,row\n2024.01.02,5\n")
    got = readers.deals_csv(spark, str(tmp_path / "d.csv")).orderBy("deal").collect()
    assert [(r.deal, r.side, r.direction, r.price, r.profit, r.coerced, r.comment) for r in got] == [(6, "buy", "in", 42.0, None, False, None), (7, "buy", "in", 42.5, None, False, None), (8, "sell", "out", 43.0, 0.0, True, "tp 1"), (9, "sell", "out", 44.0, 3.5, False, "")]


def test_event_log_and_render(spark, tmp_path):
    good = json.dumps({"event_id": "e1", "seq": 1, "ts": "2024-01-01T00:00:00Z", "type": "note", "actor": "x", "event_hash": "abc"})
    (tmp_path / "log.jsonl").write_text(good + "\n" + good[:30])
    log = readers.event_log(spark, str(tmp_path / "log.jsonl"))
    assert sorted((r.torn, r.raw) for r in log.collect()) == [(False, good), (True, good[:30])]
    rows = log.where("NOT torn").withColumn("brief", F.expr("map('b', '2', 'a', '1')"))
    text = sinks.render(rows).first().text
    assert text == "\n## [1] 2024-01-01T00:00:00 · note · x\n`a=1 · b=2`\n`event e1 · hash abc`\n"
    sinks.exports(spark.createDataFrame([("block", "b1", True, "{}"), ("block", "b2", False, "{}")], "kind string, id string, frozen boolean, doc string"), str(tmp_path / "out"))
    assert [r.id for r in spark.read.json(str(tmp_path / "out")).collect()] == ["b1"]
    assert sinks.addressed(spark.createDataFrame([("x",)], "c string"), "c").first().path.startswith("2d/2d7116")


def test_contract_and_resume(spark):
    doc = spark.createDataFrame([(1, "a")], "k long, v string")
    assert readers.checked(doc, {"k": F.col("k") > 0}).count() == 1
    with pytest.raises(Exception, match="contract: k"):
        readers.checked(doc, {"k": F.col("k") > 1}).collect()
    assert readers.resume(doc, doc, "k").count() == 0


def test_inbox_drops_repeats_and_keeps_stacks(spark, tmp_path):
    rows = [("e%d" % i, i, "request" if i % 3 else "void", i % 2, "2024-01-01T00:00:%02dZ" % i, 1.0) for i in range(1, 9)]
    keys = ("event_id", "seq", "type", "lineage", "ts", "value")
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:4], rows[2:6], rows[6:])):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(keys, r))) for r in part))
    seen = []
    q = inbox.drain(inbox.drafts(spark, str(tmp_path / "in")), str(tmp_path / "ck"), lambda df, _: seen.extend(r.event_id for r in df.orderBy("file", "seq").collect()))
    q.awaitTermination(120)
    assert sorted(seen) == sorted(r[0] for r in rows)
    stream = inbox.stream_incumbents(spark.readStream.schema(inbox.DRAFT).json(str(tmp_path / "in")).dropDuplicates(["event_id"]))
    out = []
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend(df.collect())).start()
    q.awaitTermination(120)
    batch = eventlog.incumbents(spark.createDataFrame([r[:4] for r in rows], "event_id string, seq long, type string, lineage long"))
    assert {r.lineage: (r.incumbent, r.depth) for r in out} == {r.lineage: (r.incumbent, r.depth) for r in batch.collect()}
