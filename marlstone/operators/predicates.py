"""Named, versioned predicates and score functions: a name leads to a builder of a Column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Named:
    name: str
    version: str
    build: Callable[[], Column]


CLAUSES = ["w4_per_blob", "regime_consistency", "degradation", "persistence", "seed_survival"]
PREDICATES: dict[str, Named] = {}
SCORES: dict[str, Named] = {}


def predicate(name: str, version: str, into: dict[str, Named] = PREDICATES):
    """Register a builder; a name that is registered already is replaced only by another version."""

    def add(build: Callable[[], Column]) -> Callable[[], Column]:
        if name in into and into[name].version == version:
            raise ValueError(f"{name} {version} is registered already")
        into[name] = Named(name, version, build)
        return build

    return add


def stale(pinned: Column, name: str) -> Column:
    """Whether a pinned version isn't the one in use."""
    return ~pinned.eqNullSafe(F.lit(PREDICATES[name].version))


@predicate("budget_floor_alarm", "1")
def budget_floor_alarm() -> Column:
    return F.coalesce(F.col("remaining") <= F.col("floor"), F.lit(False))


@predicate("shadow_qualification", "1")
def shadow_qualification() -> Column:
    """Three of the last four epochs rank well and none loses yield; ``epochs``: array of (spearman, yield), oldest first."""
    tail = F.slice(F.col("epochs"), F.greatest(F.size("epochs") - 3, F.lit(1)), 4)
    return (F.size(tail) == 4) & (F.size(F.filter(tail, lambda e: e["spearman"] >= 0.10)) >= 3) & F.forall(tail, lambda e: e["yield"] >= 0)


@predicate("cert_gate_green", "1")
def cert_gate_green() -> Column:
    """All five clauses are measured to pass or authorised before; ``clauses``: map of clause to stamp, others don't count."""
    return F.forall(F.array(*map(F.lit, CLAUSES)), lambda c: F.coalesce(F.try_element_at("clauses", c).isin("measured_pass", "pre_authorized"), F.lit(False)))


@predicate("g2_and_alignment_green", "1")
def g2_and_alignment_green() -> Column:
    """Both artifacts have a passed stamp of their kind or one that is verified; ``g2`` and ``alignment``: arrays of (kind, passed), null for a missing one."""
    ok = lambda c, kind: F.coalesce(F.exists(F.col(c), lambda s: s["kind"].isin(kind, "verified") & s["passed"]), F.lit(False))
    return ok("g2", "parity") & ok("alignment", "counts")


@predicate("extended_suspend_alarm", "1")
def extended_suspend_alarm() -> Column:
    """Any L2 mark, three L1 among the last twelve marks that aren't void, or a flag; ``marks``: array of (class, voided), oldest first,
    ``flagged``: whether a readout was voided, contested or failed its forensic."""
    live = F.filter("marks", lambda m: ~F.coalesce(m["voided"], F.lit(False)))
    tail = F.slice(live, F.greatest(F.size(live) - 11, F.lit(1)), 12)
    return F.exists("marks", lambda m: m["class"] == "L2") | (F.size(F.filter(tail, lambda m: m["class"] == "L1")) >= 3) | F.coalesce("flagged", F.lit(False))


@predicate("readout_battery_green", "1")
def readout_battery_green() -> Column:
    """Whether the spend check of a request, month apart, finds nothing: ``purpose``, ``spent``, ``velocity``, ``cap``, ``remaining``."""
    from marlstone.operators.eventlog import spend_code

    return spend_code(F.col("purpose"), F.coalesce("spent", F.lit(False)), F.lit(False), F.col("velocity"), F.col("cap"), F.col("remaining")) == "OK"


@predicate("score_v1", "v1", SCORES)
def score_v1() -> Column:
    """By stage: net factor; contributions times coverage; separation above the gate; less haircut; else 0."""
    contrib = F.aggregate("per_blob", F.lit(0.0), lambda s, x: s + x) * F.col("coverage")
    return F.when(F.col("stage") == 1, F.col("net_pf_proxy")).when(F.col("stage") == 2, contrib).when(F.col("stage") == 3, F.col("sep_z") - F.col("gate_ref")).when(F.col("stage") == 4, -F.coalesce(F.col("fidelity_haircut"), F.lit(1.0))).otherwise(0.0)


def constant(entries: Column, key: str) -> Column:
    """The first known value of a key in an array of (key, value, unknown)."""
    return F.get(F.filter(entries, lambda e: (e["key"] == key) & ~F.coalesce(e["unknown"], F.lit(False))), F.lit(0))["value"]


def provisional(entries: Column) -> Column:
    """Whether any known entry is provisional."""
    return F.exists(entries, lambda e: ~F.coalesce(e["unknown"], F.lit(False)) & (e["finality"] == "provisional"))


def fired(name: str, pinned: Column) -> Column:
    """Whether the predicate holds and the pinned version is the one in use; a stale one never fires."""
    return ~stale(pinned, name) & F.coalesce(PREDICATES[name].build(), F.lit(False))
