"""Scaling and anomalies.

Global statistics come from one aggregate over all variables (one scan,
partial aggregation), never a global window. Statistics of a cell (and
calendar group) are a window over one exchange on these keys: a group holds
the days of one cell, so it is bounded by the time axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ratio
from .resample import CELL, calendar_group


def _stats_row(ref: DataFrame, aggs: list) -> list:
    """All global statistics in ONE aggregate (one scan, partial
    aggregation); the single result row holds a few numbers per variable."""
    return list(ref.agg(*aggs).first())


def minmax(df: DataFrame, values: Sequence[str], reference: DataFrame | None = None) -> DataFrame:
    """``(v - min)/(max - min)`` per variable over all dimensions.

    ``reference`` (e.g. the calibration period) supplies min and max; other
    rows may then leave [0, 1]. Zero range gives missing.
    """
    ref = df if reference is None else reference
    st = _stats_row(ref, [f(F.col(v).cast("double")) for v in values for f in (F.min, F.max)])
    out = {}
    for k, v in enumerate(values):
        lo, hi = st[2 * k], st[2 * k + 1]
        out[v] = ratio(F.col(v) - F.lit(lo), F.lit(None if lo is None else hi - lo).cast("double"))
    return df.withColumns(out)


def standardize(df: DataFrame, values: Sequence[str], ddof: int = 1,
                reference: DataFrame | None = None) -> DataFrame:
    """Mean 0 and std 1 per variable over all dimensions, time, y and x
    together; ``ddof`` 0 gives the whole-period anomalies."""
    ref = df if reference is None else reference
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    st = _stats_row(ref, [f(F.col(v)) for v in values for f in (F.avg, sd)])
    out = {}
    for k, v in enumerate(values):
        mu, s = st[2 * k], st[2 * k + 1]
        out[v] = ratio(F.col(v) - F.lit(mu), F.lit(s).cast("double"))
    return df.withColumns(out)


def _with_group_stats(df: DataFrame, keys: list, stats: dict[str, Column]) -> DataFrame:
    """Attach per-group statistics: one scan and one exchange on the group
    keys serve the statistics and the rows."""
    return df.withColumns({n: c.over(Window.partitionBy(*keys)) for n, c in stats.items()})


def minmax_by(df: DataFrame, values: Sequence[str], keep: Sequence[str] = CELL) -> DataFrame:
    """Min-max scaling along the other axes, separately for every
    combination of ``keep`` (per cell over time by default)."""
    stats = {}
    for v in values:
        stats[f"__lo_{v}"] = F.min(v)
        stats[f"__hi_{v}"] = F.max(v)
    j = _with_group_stats(df, list(keep), stats)
    j = j.withColumns({v: ratio(F.col(v) - F.col(f"__lo_{v}"), F.col(f"__hi_{v}") - F.col(f"__lo_{v}"))
                       for v in values})
    return j.drop(*stats)


def anomalies(df: DataFrame, values: Sequence[str], by: str = "dayofyear", standard: bool = False,
              time: str = "time", cell: Sequence[str] = CELL) -> DataFrame:
    """``v - mean(v)`` over the rows of the same cell and calendar group
    (day-of-year, month, season), divided by the population std when
    ``standard``; rows keep their time labels.

    The (group, cell) statistics are a window over one exchange.
    """
    d = df.withColumn(by, calendar_group(time, by))
    stats = {}
    for v in values:
        stats[f"__mu_{v}"] = F.avg(v)
        if standard:
            stats[f"__sd_{v}"] = F.stddev_pop(v)
    j = _with_group_stats(d, [by, *cell], stats)
    out = {}
    for v in values:
        a = F.col(v) - F.col(f"__mu_{v}")
        out[v] = ratio(a, F.col(f"__sd_{v}")) if standard else a
    return j.withColumns(out).drop(by, *stats)
