"""Joins between grids.

Grids join on their key columns. Static fields (one row per cell) and axis
tables are small and are broadcast only after a row count proved it.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .axes import axis_positions, checked_broadcast
from .resample import CELL

KEYS = ("time", *CELL)


def merge(grids: Sequence[DataFrame], keys: Sequence[str] = KEYS, check_conflicts: bool = False) -> DataFrame:
    """Merge variables on shared coordinates (outer join).

    A variable present in two inputs must agree where both have it; with
    ``check_conflicts`` a disagreement raises.
    """
    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in b.columns if c in a.columns and c not in keys]
        if not shared:
            return a.join(b, list(keys), "full")
        b2 = b.withColumnsRenamed({c: f"__r_{c}" for c in shared})
        j = a.join(b2, list(keys), "full")
        if check_conflicts:
            cond = functools.reduce(lambda x, y: x | y,
                                    [F.col(c) != F.col(f"__r_{c}") for c in shared])
            if not j.where(cond).isEmpty():
                raise ValueError(f"conflicting values for {shared}")
        j = j.withColumns({c: F.coalesce(F.col(c), F.col(f"__r_{c}")) for c in shared})
        return j.drop(*[f"__r_{c}" for c in shared])
    return functools.reduce(two, grids)


def concat_time(parts: Sequence[DataFrame]) -> DataFrame:
    """Concatenate along time; no dedupe (as ``xr.concat``)."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def attach_static(df: DataFrame, static: DataFrame, cell: Sequence[str] = CELL,
                  how: str = "left") -> DataFrame:
    """Repeat a static (y, x) field at every time step.

    The static table has one row per cell: a plain join, which the planner
    (or AQE, by the size that it measures) broadcasts or shuffles.
    """
    return df.join(static, list(cell), how)


def sel_labels(df: DataFrame, other: DataFrame, col: str = "time", strict: bool = True) -> DataFrame:
    """Keep the labels of ``col`` found in ``other``; with ``strict`` a
    label of ``other`` missing from ``df`` is an error (as ``.sel``)."""
    labels = checked_broadcast(other.select(col).distinct())   # axis-sized, counted
    if strict:
        missing = labels.join(df.select(col).distinct(), col, "left_anti")
        if not missing.isEmpty():
            raise KeyError(f"labels of {col!r} not found in the dataset")
    return df.join(labels, col, "left_semi")


def align_positional(a: DataFrame, b: DataFrame, axes: Sequence[str] = KEYS) -> DataFrame:
    """Give ``b`` the coordinates of ``a`` by position on each axis
    (``xr.align(join='override')``). Axis lengths must match."""
    (pa, size), (pb, size_b) = axis_positions(a, axes), axis_positions(b, axes)
    for ax in axes:
        if size[ax][0] != size_b[ax][0]:
            raise ValueError(f"axis {ax!r} has {size[ax][0]} labels in the first grid and {size_b[ax][0]} in the second")
    new = pa.select("axis", "i", *[F.col(c).alias(f"__new_{c}") for c in axes])
    relabel = written(pb.join(new, ["axis", "i"]).drop("i"), "axes")
    out = b
    for ax in axes:
        one = relabel.where(F.col("axis") == ax).select(F.col(ax).alias("__old"), F.col(f"__new_{ax}").alias(ax))
        out = (out.withColumnRenamed(ax, "__old")
                  .join(checked_broadcast(one, size[ax][0]), "__old").drop("__old"))
    return out


def combine(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Put two grids on the same rows (inner join on equal keys) so
    that column arithmetic compares them."""
    return a.join(b, list(keys), "inner")
