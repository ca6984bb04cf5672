"""Statistics of a pair of grids from one table of mergeable moments.

:func:`pair_moments` reads the pair once and keeps, for each cell, year and month,
counts, sums and centred sums of squares of the observed and predicted
values and of their difference (and of wet days). Means, sums, R² and wet-day
indices over years, seasons, months, cells or everything follow by merging its rows,
some thirty times fewer than days. Sums of squares are merged about the
mean of everything, not as differences of large squares, so values in Kelvin lose
nothing.

The pair is masked: a day has both values or neither. A group with a masked
day has no sum and no wet-day count (A5, A13), as it has elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import ratio, wet_flag
from .resample import CELL, calendar_group


def pair_moments(pair: DataFrame, wet_threshold: float | None = None, time: str = "time", cell: Sequence[str] = CELL) -> DataFrame:
    """``(time, *cell, rows, n, so, sp, mo, qo, md, qd)`` by month (``time`` is its last day): sums of ``o`` and ``p``, and
    mean and centred sum of squares of ``o`` and of ``p - o``; with a threshold also wet days (``wo, wp``) and their sums (``vo, vp``)."""
    o, p, d = F.col("o"), F.col("p"), F.col("p") - F.col("o")
    n = F.count(o)
    wet = []
    if wet_threshold is not None:
        flags = {"o": wet_flag("o", wet_threshold), "p": wet_flag("p", wet_threshold)}
        wet = [F.sum(f).alias(f"w{k}") for k, f in flags.items()] + [F.sum(f * F.col(k)).alias(f"v{k}") for k, f in flags.items()]
    return pair.groupBy(F.last_day(time).alias("time"), *cell).agg(
        F.count(F.lit(1)).alias("rows"), n.alias("n"), F.sum(o).alias("so"), F.sum(p).alias("sp"),
        F.avg(o).alias("mo"), (F.var_pop(o) * n).alias("qo"), F.avg(d).alias("md"), (F.var_pop(d) * n).alias("qd"), *wet)


def monthly_sums(m: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """A5 from moments: ``(time, *cell, o, p)``, missing if a day is."""
    whole = F.col("rows") == F.col("n")
    return m.select("time", *cell, F.when(whole, F.col("so")).alias("o"), F.when(whole, F.col("sp")).alias("p"))


def means(m: DataFrame, by: str, cell: Sequence[str] = CELL) -> DataFrame:
    """A7, A9, A10 from moments: means of the days of each calendar part and cell (``cell=()`` pools them)."""
    mean = lambda c: (F.sum(c) / F.sum(F.when(F.col("n") > 0, F.col("n")))).alias(c[1])
    return m.groupBy(calendar_group("time", by), *cell).agg(mean("so"), mean("sp"))


def merged(m: DataFrame, keys: Sequence[str | Column], also: Sequence[Column] = ()) -> DataFrame:
    """``(*keys, n, mo, qo, md, qd)``: the rows of each group as one; with the aggregates ``also``, groups without a valid day stay.

    Squares are taken about the mean of all rows before they are merged and about
    the group's mean after, so large means cancel; a plain aggregate with partial sums.
    """
    valid = m.where("n > 0")
    means_ = F.struct(*[(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in ("mo", "md")])
    d = (m if also else valid).withColumn("__c", valid.select(means_).scalar())
    centre = {c: F.col(f"__c_{c}") for c in ("mo", "md")}
    d = d.withColumns({f"__c_{c}": F.col(f"__c.{c}") for c in centre}).drop("__c")   # numbers: an aggregate of structs would sort
    off = {c: F.col(c) - centre[c] for c in centre}
    n = F.col("n")
    sums = d.groupBy(*keys).agg(*also, F.sum("n").alias("n"), *[F.first(f"__c_{c}").alias(f"__c_{c}") for c in off], *[F.sum(n * off[c]).alias(f"__{c}") for c in off],
                                *[F.sum(F.col(q) + n * off[c] ** 2).alias(f"__{q}") for q, c in (("qo", "mo"), ("qd", "md"))])
    shift = {c: F.try_divide(f"__{c}", n) for c in off}
    names = [c for c in sums.columns if c not in ("n", "__c_mo", "__c_md", "__mo", "__md", "__qo", "__qd")]

    def square(q: str, c: str) -> Column:
        left = F.col(f"__{q}") - n * shift[c] ** 2
        return F.when(left > 1e-12 * F.col(f"__{q}"), left).otherwise(0.0).alias(q)   # below that it is rounding: a constant

    return sums.select(*names, "n", (centre["mo"] + shift["mo"]).alias("mo"), square("qo", "mo"),
                       (centre["md"] + shift["md"]).alias("md"), square("qd", "md"))


def pooled(m: DataFrame, part: str = "month", time: str = "time", cell: Sequence[str] = CELL) -> DataFrame:
    """The moments of each cell and calendar part over all years, with the columns of ``m`` (``time`` is the last one of the part):
    what pools years follows from these fewer rows as well."""
    more = [c for c in ("rows", "so", "sp", "wo", "wp", "vo", "vp") if c in m.columns]
    g = merged(m, [calendar_group(time, part).alias("__part"), *cell], [F.max(time).alias(time), *[F.sum(c).alias(c) for c in more]])
    return g.select(*m.columns)


def r2_of(sums: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R² of the sums of squares ``res`` and ``tot``, with the conventions of :func:`gridspark.operators.metrics.r2_expr`."""
    g = sums.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("res").alias("res"), F.sum("tot").alias("tot"))
    value = (F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(None).cast("double"))
             .when(F.col("tot") == 0, F.when(F.col("res") == 0, 1.0).otherwise(0.0)).otherwise(1 - F.col("res") / F.col("tot")))
    return g.select(*by, "n", value.alias("r2"))


def r2(m: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A18, A19 of the days, from moments (monthly ones, or merged ones)."""
    g = merged(m, by)
    return r2_of(g.select(*by, "n", (F.col("qd") + F.col("n") * F.col("md") ** 2).alias("res"), F.col("qo").alias("tot")), by)


def anomaly_sums(m: DataFrame, part: str = "month", cell: Sequence[str] = CELL) -> DataFrame:
    """``(*cell, n, res, tot)``: sums of squares of the anomalies (W2) from the mean of each cell and calendar part. They have
    mean zero there, so the squares about the group means are the sums needed, and no anomaly is ever written out."""
    g = merged(m, [calendar_group("time", part), *cell])
    return g.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum("qd").alias("res"), F.sum("qo").alias("tot"))


def r2_anomaly(m: DataFrame, by: Sequence[str] = (), part: str = "month", cell: Sequence[str] = CELL) -> DataFrame:
    """A19 of the anomalies, from moments."""
    return r2_of(anomaly_sums(m, part, cell), by)


def _guarded(c: str) -> Column:
    return F.when(F.sum("n") == F.sum("rows"), F.sum(c))


def wet_days(m: DataFrame, by: str | None = None, cell: Sequence[str] = CELL) -> DataFrame:
    """A13, A14 from moments: number and share (%) of wet days by cell (and calendar part)."""
    keys = [calendar_group("time", by)] if by else []
    share = lambda c: _guarded(c) / F.sum("rows") * 100.0
    return m.groupBy(*keys, *cell).agg(
        _guarded("wo").alias("n_wet_obs"), _guarded("wp").alias("n_wet_pred"), share("wo").alias("f_wet_obs"), share("wp").alias("f_wet_pred"))


def wet_intensity(m: DataFrame, cell: Sequence[str] = CELL) -> DataFrame:
    """A15 from moments: mean of the wet days by cell, and its relative bias."""
    out = m.groupBy(*cell).agg(ratio(_guarded("vo"), _guarded("wo")).alias("sdii_obs"), ratio(_guarded("vp"), _guarded("wp")).alias("sdii_pred"))
    return out.withColumn("rel_bias", ratio(F.col("sdii_pred") - F.col("sdii_obs"), F.col("sdii_obs")) * 100.0)
