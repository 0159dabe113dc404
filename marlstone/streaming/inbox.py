"""Structured Streaming: an inbox of drafts, bars on a stream, and state by lineage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from marlstone.operators.eventlog import stack_step

DRAFT = "event_id string, seq long, type string, lineage long, ts timestamp, value double"


def drafts(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of a folder, once each; a draft that arrives again within a day is dropped, so that state stays bounded."""
    rows = spark.readStream.schema(DRAFT).option("maxFilesPerTrigger", files_per_trigger).json(folder)
    return rows.withColumn("file", F.col("_metadata.file_name")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])


def drain(rows: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]):
    """Process all that is there, a batch at a time, in the order of file names within a batch."""
    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def stream_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of ticks (series, ts, id, price), emitted once the watermark has passed them."""
    at = F.struct("ts", "id")
    out = ticks.withWatermark("ts", late).groupBy("series", F.window("ts", width))
    return out.agg(F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.count(F.lit(1)).alias("volume")).select("series", F.col("window.start").alias("ts"), "o", "h", "l", "c", "volume")


def stream_incumbents(rows: DataFrame) -> DataFrame:
    """The incumbent stack of each lineage across batches, by the same transition as the batch fold."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stack = list(state.get[0]) if state.exists else []
        for kind, seq in pd.concat(list(batches)).sort_values("seq")[["type", "seq"]].itertuples(index=False):
            stack = stack_step(stack, kind, int(seq))
        state.update((stack,))
        yield pd.DataFrame({"lineage": [key[0]], "incumbent": pd.array([stack[-1] if stack else None], "Int64"), "depth": [len(stack)]})

    return rows.groupBy("lineage").applyInPandasWithState(run, "lineage long, incumbent long, depth long", "stack array<long>", "update", GroupStateTimeout.NoTimeout)
