"""Files that appear whole, content-addressed storage, submissions, bars by suffix and daily fallback."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import scalar
from marlstone.operators import projections as P
from marlstone.sources import readers
from marlstone.sources.files import Folder, cas_get, cas_put, submit


def test_storage_and_submission(spark, tmp_path):
    f = Folder(spark, str(tmp_path / "cas"))
    data = bytes(range(256)) * 3
    sha = cas_put(f, data)
    assert cas_put(f, data) == sha and cas_get(f, sha) == data and f.names(sha[:2]) == [sha]
    with pytest.raises(FileNotFoundError):
        cas_get(f, "0" * 64)
    (tmp_path / "cas" / sha[:2] / f".{sha}.crc").unlink(missing_ok=True)
    (tmp_path / "cas" / sha[:2] / sha).write_bytes(b"other")
    with pytest.raises(ValueError, match="another hash"):
        cas_get(f, sha)
    box = Folder(spark, str(tmp_path / "box"))
    for n in (1, 2):
        submit(box, "d1", {"b": n, "a": "é"})
    assert json.loads((tmp_path / "box" / "pending" / "d1.json").read_bytes()) == {"a": "é", "b": 2} and box.names("pending") == ["d1.json"] and box.names("staging") == []
    with pytest.raises(FileExistsError):
        box.move("pending/d1.json", "pending/d1.json")
    assert scalar.environment_hash() == scalar.environment_hash() and len(scalar.environment_hash()) == 64


def test_bars_by_suffix_and_daily_fallback(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", 1.0, 2.0, 0.5, 1.5), ("2024-01-01 00:03:00", 1.6, 3.0, 1.0, 2.5), ("2024-01-01 00:15:00", 5.0, 5.0, 4.0, 4.5)]
    df = spark.createDataFrame(rows, "ts string, open double, high double, low double, close double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.write.parquet(str(tmp_path / "x.parquet"))
    (tmp_path / "x.csv").write_text("".join(f"{t[:10].replace('-', '.')},{t[11:16]},{o},{h},{low},{c},7\n" for t, o, h, low, c in rows))
    want = [("2024-01-01 00:00:00", 1.0, 3.0, 0.5, 2.5), ("2024-01-01 00:15:00", 5.0, 5.0, 4.0, 4.5)]
    for name in ("x.parquet", "x.csv"):
        signal, raw = readers.price_bars(spark, str(tmp_path / name), "5 minutes")
        assert [(str(r.ts), *r[1:]) for r in signal.orderBy("ts").collect()] == want and raw.count() == 3
    assert readers.price_bars(spark, str(tmp_path / "x.csv"))[0].count() == 3
    at = lambda *t: spark.createDataFrame([(x, 1.0) for x in t], "ts string, open double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = readers.with_daily(at("2024-01-05 00:00:00"), at("2024-01-06 00:00:00", "2024-02-01 00:00:00", "2024-02-03 00:00:00"))
    assert sorted(str(r.ts)[:10] for r in got.collect()) == ["2024-01-05", "2024-02-01", "2024-02-03"]


def test_stage0(spark):
    arm = "struct<arm_id:string,role:string,config_keys:array<string>>"
    b = spark.createDataFrame([(True, False, [("a", "real", ["k2", "k1"]), ("b", "placebo", ["k9"])]), (True, False, [("a", "real", ["k1"])]), (True, True, [("a", "real", ["k3"])]), (False, False, [("a", "real", ["k4"])])], f"frozen boolean, closed boolean, arms array<{arm}>")
    assert sorted(r[0] for r in P.stage0(b).collect()) == ["k1", "k2"]
