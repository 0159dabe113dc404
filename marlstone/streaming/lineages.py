"""Slots of lineages on a stream, with keyed state: the transitions of ``projections.lineage_step``, a micro-batch at a time.

State is kept by lineage in RocksDB and checkpointed with the stream's offsets: the budget as one value, the one-shot windows as maps, so that an event reads and writes only the windows that it
names. A query that is killed goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marlstone.operators.projections import NEW_LINEAGE, lineage_step

EVENT = "lineage string, seq long, kind string, generation long, initial long, alarm_at long, diagnostic_at long, month string, readout_id string, keys array<string>, readout boolean"
BUDGET = ["generation", "initial", "consumed", "remaining", "alarm_at", "diagnostic_at", "alarm", "diagnostic"]
STATE = "k_cumulative long, last_seq long, generation long, initial long, consumed long, remaining long, alarm_at long, diagnostic_at long, alarm boolean, diagnostic boolean"
OUT = f"lineage string, {STATE}, months array<string>, one_shot array<string>"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


WHOLE = ("seq", "generation", "initial", "alarm_at", "diagnostic_at")


def _plain(name: str, v: Any) -> Any:
    """A cell as a Python value; pandas gives whole numbers beside missing ones as floats."""
    if name == "keys":
        return [] if v is None else list(v)
    if v is None or v is pd.NA or v != v:
        return None
    return int(v) if name in WHOLE else v.item() if hasattr(v, "item") else v


class Lineages(StatefulProcessor):
    """Events of a lineage in order of seq; one that isn't after the last is left out, so that a file which comes twice counts once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getValueState("slots", STATE)
        self.months = handle.getMapState("months", "month string", "n long")
        self.shots = handle.getMapState("shots", "key string", "readout_id string")
        self.taken = handle.getMapState("taken", "readout_id string", "keys array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STATE.split(", ")]
        held = dict(zip(names, self.slots.get())) if self.slots.exists() else dict.fromkeys(names)
        last = -1 if held["last_seq"] is None else held["last_seq"]
        budget = {k: held[k] for k in BUDGET} if held["generation"] is not None else None
        s = NEW_LINEAGE | {"k_cumulative": held["k_cumulative"] or 0, "budget": budget}
        for e in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            e = {k: _plain(k, v) for k, v in e.items()}
            if e["seq"] <= last:
                continue
            last = e["seq"]
            s = lineage_step(s | {"months": [], "one_shot": {}}, e["kind"], e)
            self._windows(e)
        self.slots.update(tuple({"k_cumulative": s["k_cumulative"], "last_seq": last, **(s["budget"] or dict.fromkeys(BUDGET))}[n] for n in names))
        row = {"lineage": key[0], **dict(zip(names, self.slots.get())), "months": sorted(m[0] for m in self.months.keys()), "one_shot": sorted(k[0] for k in self.shots.keys())}
        whole = [c for c in names if c not in ("alarm", "diagnostic")]
        yield pd.DataFrame([row]).astype(dict.fromkeys(whole, "Int64") | {"alarm": "boolean", "diagnostic": "boolean"})

    def _windows(self, e: dict) -> None:
        if e["kind"] == "request":
            if e["month"] is not None:
                self.months.updateValue((e["month"],), (1,))
            for k in e["keys"]:
                self.shots.updateValue((k,), (e["readout_id"],))
            if e["keys"]:
                before = list(self.taken.getValue((e["readout_id"],))[0]) if self.taken.containsKey((e["readout_id"],)) else []
                self.taken.updateValue((e["readout_id"],), ([*dict.fromkeys([*before, *e["keys"]])],))
        elif e["kind"] == "void" and self.taken.containsKey((e["readout_id"],)):
            for k in self.taken.getValue((e["readout_id"],))[0]:
                if self.shots.containsKey((k,)) and self.shots.getValue((k,))[0] == e["readout_id"]:
                    self.shots.removeKey((k,))
            self.taken.removeKey((e["readout_id"],))

    def close(self) -> None:
        pass


def events(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New files of events (EVENT) of a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def stream_lineages(rows: DataFrame) -> DataFrame:
    """OUT of each lineage that a micro-batch has events of. Sets the state store of the session to RocksDB, which keyed state of this kind needs."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy("lineage").transformWithStateInPandas(Lineages(), OUT, "Update", "None")
