"""Null, window and quantile conventions that all analytic expressions share.

Missing is null, never NaN; a rolling value exists once its window is full of observations; divisions by zero are null.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def series():
    """Rows of a cell of a series (``recurrences.cells``) in order of time."""
    return Window.partitionBy("series", "_cell").orderBy("ts")


def last(n: int):
    """The row and its n - 1 predecessors."""
    return series().rowsBetween(-(n - 1), 0)


def rolling(agg: Column, n: int, *over: Column) -> Column:
    """``agg`` over the last n rows, null unless each of ``over`` has n observations there."""
    full = F.count(F.when(~_any_null(over), 1)).over(last(n)) == n
    return F.when(full, agg.over(last(n)))


def _any_null(cols) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | c.isNull()
    return out


def floor0(x: Column) -> Column:
    """Negative values become 0; null stays null."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def profit_factor(p: Column, no_loss: Column | None = None, least: float | None = None) -> Column:
    """Gains over losses; a profit of 0 is a loss.

    Without losses: ``no_loss``, which may refer to the gains as an aggregate; or the losses count as ``least`` at least.
    """
    gain = F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0))
    loss = F.coalesce(-F.sum(F.when(p <= 0, p)), F.lit(0.0))
    if least is not None:
        return gain / F.greatest(loss, F.lit(least))
    return F.when(loss > 0, F.try_divide(gain, loss)).otherwise(no_loss if no_loss is not None else F.lit(None))


def hazen(values: Column, q: float) -> Column:
    """Quantile of an array by plotting positions (i - 0.5) / n, clamped at both ends."""
    s = F.sort_array(values)
    n = F.size(s)
    at = n * F.lit(q) + 0.5
    low = F.greatest(F.lit(1), F.least(n, F.floor(at).cast("int")))
    high = F.least(n, low + 1)
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), at - low))
    return F.when(n > 0, F.element_at(s, low) + (F.element_at(s, high) - F.element_at(s, low)) * share)
