"""Splits, sampling and ordering.

Random choices are hash-ordered, never ``rand()``: a fixed seed gives the
same rows on every run and after any task retry. Ranking windows run over
the distinct *days* (bounded by the time axis), never over data rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .axes import axis_index, checked_broadcast
from .resample import CELL


def chronological(df: DataFrame, time: str = "time") -> DataFrame:
    """O1: sort by time (a range-partitioned global sort)."""
    return df.orderBy(time)


def seeded_key(seed: int, *cols: str) -> Column:
    """Deterministic pseudo-random order key."""
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in cols])


def stratified_days(df: DataFrame, value: str, threshold: float, valid_size: float, seed: int = 42,
                    time: str = "time", order_key: Column | None = None) -> DataFrame:
    """O2: split the *days* into train/valid, stratified by whether the
    spatial mean of ``value`` reaches ``threshold`` (wet vs dry days).

    Each stratum sends ``ceil(valid_size * n)`` of its days, chosen in seeded
    hash order, to ``valid``. Returns ``(time, stratum, split)``.
    """
    days = df.groupBy(time).agg(F.avg(value).alias("__m"))
    days = days.withColumn("stratum", (F.col("__m") >= F.lit(threshold)).cast("int"))
    key = order_key if order_key is not None else seeded_key(seed, time)
    days = days.withColumn("__k", key)
    w = Window.partitionBy("stratum").orderBy("__k", time)
    n = F.count(F.lit(1)).over(Window.partitionBy("stratum"))
    rn = F.row_number().over(w)
    return days.select(time, "stratum",
                       F.when(rn <= F.ceil(F.lit(valid_size) * n), F.lit("valid")).otherwise(F.lit("train"))
                        .alias("split"))


def chronological_split(df: DataFrame, test_size: float = 0.2, time: str = "time") -> DataFrame:
    """O3: the last ``ceil(test_size * n)`` time labels are ``test``, the rest
    ``train`` (no shuffling). Returns ``(time, split)``."""
    idx = written(axis_index(df, time, "__i"), "axis")
    n = idx.count()
    cut = n - math.ceil(round(test_size * n, 9))
    return idx.select(time, F.when(F.col("__i") >= cut, F.lit("test")).otherwise(F.lit("train")).alias("split"))


def period_split(df: DataFrame, calibration: tuple[str, str], validation: tuple[str, str],
                 time: str = "time") -> DataFrame:
    """Label rows of two half-open periods; rows of neither are dropped."""
    t = F.col(time)
    cal = (t >= F.lit(calibration[0]).cast("date")) & (t < F.lit(calibration[1]).cast("date"))
    val = (t >= F.lit(validation[0]).cast("date")) & (t < F.lit(validation[1]).cast("date"))
    return (df.where(cal | val)
              .withColumn("split", F.when(cal, F.lit("train")).otherwise(F.lit("valid"))))


def attach_split(df: DataFrame, labels: DataFrame, time: str = "time") -> DataFrame:
    """Join day labels (from O2/O3) to the data rows."""
    return df.join(checked_broadcast(labels.select(time, "split")), time)


def sample_positions(df: DataFrame, col: str, n: int, seed: int = 42,
                     order_key: Column | None = None) -> DataFrame:
    """``n`` distinct labels of one axis, seeded; raises if the axis is
    shorter than ``n``. Returns ``(col, i)`` with ``i`` the axis position."""
    idx = written(axis_index(df, col, "i"), "axis")
    size = idx.count()
    if n > size:
        raise ValueError(f"cannot draw {n} distinct positions from an axis of {size}")
    key = order_key if order_key is not None else seeded_key(seed, "i")
    return idx.withColumn("__k", key).orderBy("__k", "i").limit(n).drop("__k")


def sample_cells(df: DataFrame, n_per_axis: int, seed: int = 42, cell: Sequence[str] = CELL,
                 order_keys: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """O5 on a grid: ``n_per_axis`` labels on each axis. The reduced grid is
    their product; it is never materialised: :func:`reduced_grid` keeps the
    data rows whose labels are in both samples."""
    ks = order_keys or {}
    y, x = cell
    sy = sample_positions(df, y, n_per_axis, seed, ks.get(y)).select(y)
    sx = sample_positions(df, x, n_per_axis, seed + 1, ks.get(x)).select(x)
    return sy, sx


def reduced_grid(df: DataFrame, sampled: tuple[DataFrame, DataFrame], cell: Sequence[str] = CELL) -> DataFrame:
    """Data rows of the sampled cells (two semi joins on the sampled
    axis labels, each at most ``n_per_axis`` rows)."""
    sy, sx = sampled
    y, x = cell
    return df.join(F.broadcast(sy), y, "left_semi").join(F.broadcast(sx), x, "left_semi")


def best_trial(scores: DataFrame, metric: str = "rmse", trial: str = "trial") -> DataFrame:
    """The trial with the lowest score (ties: lowest trial id)."""
    return scores.orderBy(F.col(metric).asc_nulls_last(), F.col(trial)).limit(1)
