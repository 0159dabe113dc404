"""Windows and recurrences of series that span cells, against the same in one cell and against plain Python."""

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from marlstone.functions import catalog, recurrences


def bars(spark, n=900):
    r = random.Random(2)
    out = []
    for series, k in (("a", n), ("b", 40), ("c", 256)):
        p = 100.0
        for i in range(k):
            p *= math.exp(r.gauss(0, 0.01))
            h, low = p * (1 + r.random() / 99), p * (1 - r.random() / 99)
            c = None if series == "a" and 300 <= i < 310 else r.uniform(low, h)
            out.append((series, f"2024-01-01 {0:02d}:00:00", i, p, h, low, c, r.randrange(5), r.random() * 9, r.randrange(3)))
    df = spark.createDataFrame(out, "series string, t string, i int, o double, h double, l double, c double, volume long, quote_volume double, taker_buy long")
    return df.withColumn("ts", F.timestamp_add("MINUTE", F.col("i") * 7 + F.pmod("i", F.lit(3)), F.to_timestamp_ntz("t"))).drop("t", "i")


def test_cells_change_nothing(spark):
    b = bars(spark)
    for made in (catalog.windowed, catalog.recursive):
        whole, parts = (made(b, size).orderBy("series", "ts").toPandas() for size in (4096, 256))
        assert len(whole) == len(parts) == 1196 and whole[["series", "ts"]].equals(parts[["series", "ts"]])
        for c in whole.columns[2:]:
            x, y = (f[c].astype(float).to_numpy() for f in (whole, parts))
            assert np.allclose(x, y, rtol=1e-7, atol=1e-7, equal_nan=True), c
    f = b.select("series", "ts", F.col("h").alias("x"))
    assert sorted(map(tuple, catalog.lagged(f, 10).collect()), key=repr) == sorted(map(tuple, catalog.lagged(f).collect()), key=repr)


def test_maps_compose_to_the_recurrence():
    rng = np.random.default_rng(1)
    for alpha in (1 / 14, 2 / 3):
        for _ in range(200):
            x = rng.normal(size=rng.integers(1, 40))
            x[rng.random(len(x)) < rng.choice([0, 0.3, 0.95])] = np.nan
            want = recurrences.ewm(x, alpha)
            assert np.allclose(want, pd.Series(x).ewm(alpha=alpha, adjust=False).mean(), equal_nan=True)
            cut = sorted(rng.integers(0, len(x) + 1, 4))
            parts = [p for p in np.split(x, cut) if len(p)]
            states = recurrences.begins([recurrences.summary(p, alpha) for p in parts], alpha)
            assert np.allclose(np.concatenate([recurrences.ewm(p, alpha, s, g) for p, (s, g) in zip(parts, states)]), want, equal_nan=True)
