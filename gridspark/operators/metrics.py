"""Verification metrics.

Conventions: ``obs`` is the observed column, ``pred`` the predicted one;
both live on the same row (join two grids first with
:func:`gridspark.operators.joins.combine`). Every metric is one
``groupBy().agg`` with partial aggregation, so no group ever has to fit in
one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import guarded_sum, ratio, wet_flag
from .axes import ranked
from .resample import CELL, calendar_group


def valid_pairs(df: DataFrame, obs: str, pred: str) -> DataFrame:
    """rows where both values are present."""
    return df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull())


def r2_expr(obs: str, pred: str) -> Column:
    """A18 as an aggregate: ``1 - SS_res/SS_tot``.

    SS_tot is ``var_pop * n``; ``var_pop`` merges central moments, so it
    does not cancel for large means (Kelvin) the way ``sum(o^2) -
    sum(o)^2/n`` does. Zero variance gives 1 for an exact fit, else 0.
    """
    o, p = F.col(obs), F.col(pred)
    ss_res = F.sum((o - p) * (o - p))
    ss_tot = F.var_pop(o) * F.count(o)
    return (F.when(F.count(o) == 0, F.lit(None).cast("double"))
             .when(ss_tot == 0, F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
             .otherwise(F.lit(1.0) - ss_res / ss_tot))


def skill(df: DataFrame, obs: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """A18, A21, A23-A25 in one pass over valid pairs: n, R², bias, MAE,
    RMSE and Pearson correlation, pooled or per group."""
    d = valid_pairs(df, obs, pred)
    o, p = F.col(obs), F.col(pred)
    return d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        r2_expr(obs, pred).alias("r2"),
        F.avg(p - o).alias("bias"),
        F.avg(F.abs(p - o)).alias("mae"),
        F.sqrt(F.avg((p - o) * (p - o))).alias("rmse"),
        F.corr(p, o).alias("corr"),
    )


def r2(df: DataFrame, obs: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """R² over valid pairs, pooled (``by=()``) or per group."""
    d = valid_pairs(df, obs, pred)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), r2_expr(obs, pred).alias("r2"))


def bias(df: DataFrame, obs: str, pred: str, relative: bool = False) -> Column:
    """A21/A22 per row: ``p - t`` or ``(p - t)/t * 100`` (missing on t = 0)."""
    d = F.col(pred) - F.col(obs)
    return ratio(d, F.col(obs)) * F.lit(100.0) if relative else d


def wet_days(df: DataFrame, obs: str, pred: str, threshold: float, time: str = "time",
             cell: Sequence[str] = CELL) -> DataFrame:
    """Number and frequency (%) of wet days per cell for both series.

    Days where either value is missing are masked (F9) and make the count
    missing, as ``sum(skipna=False)`` does.
    """
    both = F.col(obs).isNotNull() & F.col(pred).isNotNull()
    d = df.select(time, *cell,
                  F.when(both, wet_flag(obs, threshold)).alias("wo"),
                  F.when(both, wet_flag(pred, threshold)).alias("wp"))
    n = F.count(F.lit(1))
    return d.groupBy(*cell).agg(
        guarded_sum("wo").alias("n_wet_obs"), guarded_sum("wp").alias("n_wet_pred"),
        (guarded_sum("wo") / n * F.lit(100.0)).alias("f_wet_obs"),
        (guarded_sum("wp") / n * F.lit(100.0)).alias("f_wet_pred"))


def wet_frequency_by(df: DataFrame, obs: str, pred: str, threshold: float, by: str = "season",
                     time: str = "time", cell: Sequence[str] = CELL) -> DataFrame:
    """Wet-day frequency per calendar group and cell (missing if any
    day of the group is missing)."""
    both = F.col(obs).isNotNull() & F.col(pred).isNotNull()
    d = df.select(calendar_group(time, by), *cell,
                  F.when(both, wet_flag(obs, threshold)).alias("wo"),
                  F.when(both, wet_flag(pred, threshold)).alias("wp"))
    n = F.count(F.lit(1))
    return d.groupBy(by, *cell).agg((guarded_sum("wo") / n * F.lit(100.0)).alias("f_wet_obs"),
                                    (guarded_sum("wp") / n * F.lit(100.0)).alias("f_wet_pred"))


def wet_intensity(df: DataFrame, obs: str, pred: str, threshold: float,
                  cell: Sequence[str] = CELL) -> DataFrame:
    """Mean precipitation of wet days (simple daily intensity index)
    per cell, for both series, and its relative bias."""
    both = F.col(obs).isNotNull() & F.col(pred).isNotNull()
    wo = F.when(both, wet_flag(obs, threshold))
    wp = F.when(both, wet_flag(pred, threshold))
    d = df.select(*cell, wo.alias("wo"), wp.alias("wp"),
                  (F.col(obs) * wo).alias("vo"), (F.col(pred) * wp).alias("vp"))
    out = d.groupBy(*cell).agg(ratio(guarded_sum("vo"), guarded_sum("wo")).alias("sdii_obs"),
                               ratio(guarded_sum("vp"), guarded_sum("wp")).alias("sdii_pred"))
    return out.withColumn("rel_bias", ratio(F.col("sdii_pred") - F.col("sdii_obs"), F.col("sdii_obs")) * 100.0)


def extreme_quantile(df: DataFrame, values: Sequence[str], q: float, by: str = "year",
                     time: str = "time", cell: Sequence[str] = CELL) -> DataFrame:
    """Exact quantile with linear interpolation per calendar group
    and cell (numpy's default method, as ``percentile``).

    The values of a group are ranked by a sort, and the one or two ranks at the
    quantile are kept: no buffer of values is built, merged or shuffled. Rows that are
    partitioned by cell already are not shuffled again.
    """
    part = calendar_group(time, by)
    keys = [by, *cell]
    out, group = df.select(part, *cell, *[F.col(v).cast("double").alias(v) for v in values]), Window.partitionBy(*keys)
    aggs = []
    for v in values:
        rank = F.row_number().over(group.orderBy(F.col(v).asc_nulls_last())) - 1
        out = out.withColumns({f"__r_{v}": rank, f"__at_{v}": (F.count(v).over(group) - 1) * F.lit(float(q))})
        at = F.col(f"__at_{v}")
        low, high = F.floor(at), F.ceil(at)
        one = lambda r, v=v: F.max(F.when(F.col(f"__r_{v}") == r, F.col(v)))
        a, b = one(low), one(high)
        aggs.append(F.when(a == b, a).otherwise((F.max(high) - F.max(at)) * a + (F.max(at) - F.max(low)) * b).alias(v))
    return out.groupBy(*keys).agg(*aggs)


def map_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Median, min, max (and mean) of a map.

    The median is exact: the values are ranked in value buckets, and the one
    or two middle ranks are averaged. No buffer holds a whole map. ``by`` are
    calendar parts.
    """
    v = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__x"))
    size = v.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    order = ranked(v, "__x", "__r", by)
    if by:
        order = order.join(F.broadcast(size), list(by))   # one row per calendar part
    else:
        order = order.withColumn("__n", size.scalar())
    middle = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)
    mid = order.where((F.col("__r") == middle[0]) | (F.col("__r") == middle[1]))
    median = mid.groupBy(*by).agg(F.avg("__x").alias("median"))
    rest = F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean")
    if by:
        return df.groupBy(*by).agg(*rest).join(F.broadcast(median), list(by), "left").select(*by, "median", "min", "max", "mean")
    return df.agg(*rest).select(median.scalar().alias("median"), "min", "max", "mean")


def year_range(df: DataFrame, time: str = "time") -> DataFrame:
    """First and last year."""
    return df.agg(F.min(F.year(time)).alias("start_year"), F.max(F.year(time)).alias("end_year"))


def global_stats(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Min / max / mean / std (ddof=1 and ddof=0) per variable, long
    form. One aggregate computes every variable's statistics in one scan;
    the single row is then unfolded into one row per variable."""
    stats = [F.struct(F.lit(v).alias("variable"), F.min(v).cast("double").alias("min"),
                      F.max(v).cast("double").alias("max"), F.avg(v).alias("mean"),
                      F.stddev_samp(v).alias("std"), F.stddev_pop(v).alias("std_pop")).alias(f"__s{k}")
             for k, v in enumerate(values)]
    row = df.agg(*stats)
    return row.select(F.explode(F.array(*[F.col(f"__s{k}") for k in range(len(values))])).alias("s")).select("s.*")


def histogram(df: DataFrame, value: str, lo: float, hi: float, bins: int,
              by: Sequence[str] = ()) -> DataFrame:
    """Counts per equal-width class 1..bins; values below ``lo``
    fall in class 0 and values at or above ``hi`` in class ``bins + 1``.

    The class is ``floor((v - lo) / (hi - lo) * bins) + 1``, written out so
    that every engine evaluates the same float operations (a value on an
    edge is then classed identically everywhere)."""
    v = F.col(value)
    inner = F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(bins)) + 1
    b = (F.when(v < F.lit(lo), F.lit(0)).when(v >= F.lit(hi), F.lit(bins + 1))
          .otherwise(inner).cast("long").alias("bin"))
    return df.where(v.isNotNull()).groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"))


def kde(df: DataFrame, value: str, lo: float | None = None, hi: float | None = None, points: int = 200,
        bandwidth: float | None = None) -> DataFrame:
    """A29 density curve: Gaussian kernel density at ``points`` places from
    ``lo`` to ``hi``; by default from the least to the largest value, with
    Scott's bandwidth ``std * n ** -0.2``.

    One aggregate with one exact kernel sum for each place, over all values,
    also those outside ``[lo, hi]``; the defaults take one more, of four numbers.
    Without a value or a spread there is no curve.
    """
    if lo is None or hi is None or bandwidth is None:
        n, sd, least, most = df.agg(F.count(value), F.stddev_samp(F.col(value)), F.min(value), F.max(value)).first()
        lo, hi = least if lo is None else lo, most if hi is None else hi
        if bandwidth is None:
            bandwidth = sd * n ** -0.2 if sd else None
        if lo is None or not bandwidth:
            return df.sparkSession.createDataFrame([], "x double, density double")
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    norm = 1.0 / (bandwidth * (2.0 * 3.141592653589793) ** 0.5)
    places = [lo + k * step for k in range(points)]
    z = [(F.lit(x) - F.col(value)) / F.lit(bandwidth) for x in places]
    row = df.where(F.col(value).isNotNull()).agg(*[
        F.avg(F.exp(F.lit(-0.5) * u * u)).alias(f"__d{k}") for k, u in enumerate(z)])
    curve = F.array(*[F.struct(F.lit(x).alias("x"), (F.col(f"__d{k}") * F.lit(norm)).alias("density"))
                      for k, x in enumerate(places)])
    return row.select(F.explode(curve).alias("c")).select("c.x", "c.density")
