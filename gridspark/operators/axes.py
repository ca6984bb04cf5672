"""Dataset axes (W5, F6), ranking and size-checked broadcasting.

A grid's axes are the distinct labels of ``time``, ``y`` and ``x``. Operators
that refer to *positions* on an axis (shift, positional align, isel, the
chronological split) rank only the distinct labels, which are bounded by the
grid's extent (days, rows, columns), never by the number of data rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from ..session import written

# Largest axis or weight table that is hinted as broadcast, once it is written
# and counted: rows and an estimate of bytes (8 bytes per column value plus row
# overhead). A century of hours is ~900k labels.
MAX_BROADCAST_ROWS = 2_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """An axis or weight table, broadcast if its row count proves it small;
    else the join is left to the planner (sort-merge, with AQE skew
    splitting). Without a known bound on ``rows`` the table is written once to
    the shared folder and counted there, so it is not computed twice."""
    if rows is None:
        df = written(df, "axis")
        rows = df.count()
    est = rows * (8 * len(df.columns) + 16)
    return F.broadcast(df) if (rows <= MAX_BROADCAST_ROWS and est <= MAX_BROADCAST_BYTES) else df


def axis(df: DataFrame, col: str) -> DataFrame:
    """The distinct labels of one axis (a distributed aggregate)."""
    return df.select(col).where(F.col(col).isNotNull()).distinct()


def numeric_axes(df: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """The distinct labels of several numeric axes as doubles (column ``s``),
    from ONE pass over the data; the written table is axis-sized."""
    pairs = F.array(*[F.struct(F.lit(c).alias("axis"), F.col(c).cast("double").alias("s")) for c in cols])
    every = df.select(F.explode(pairs).alias("p")).select("p.axis", "p.s").where("s is not null").distinct()
    every = written(every, "axes")
    return {c: every.where(F.col("axis") == c).select("s") for c in cols}


def axis_positions(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, dict[str, tuple[int, float, float]]]:
    """W5 for several axes at once: ``(axis, i, *cols)``, the position of every
    label of each axis with the label in the axis' own column; and by axis the
    number of labels and the least and largest one as numbers.

    One pass over the data finds the labels, one job ranks all of them.
    """
    labels = [F.struct(F.lit(c).alias("axis"), _numeric(df, c).alias("s"),
                       *[(F.col(k) if k == c else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in cols]) for c in cols]
    every = df.select(F.explode(F.array(*labels)).alias("p")).select("p.*").where("s is not null").distinct()
    every = written(every, "axes")
    ends = {r.axis: (r.n, r.lo, r.hi) for r in every.groupBy("axis").agg(
        F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).collect()}   # a row for each axis
    order = ranked(every, "s", "i", by=["axis"]).select("axis", "i", *cols)
    return written(order, "axes"), {c: ends.get(c, (0, 0.0, 0.0)) for c in cols}


def _numeric(df: DataFrame, col: str) -> Column:
    t = df.schema[col].dataType
    if isinstance(t, DateType):
        return F.unix_date(F.col(col)).cast("double")
    if isinstance(t, (TimestampType, TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp")).cast("double")
    return F.try_to_number(F.col(col), F.lit("0")).cast("double") if t.typeName() == "string" else F.col(col).cast("double")


def _bucketed(df: DataFrame, col: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """``df`` with ``__b``: the equal-width value bucket of ``col`` between its
    least and largest value (of the group). The groups of ``by`` are calendar
    parts: their least and largest values are a handful of rows."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("__v", _numeric(df, col))
    if by:
        ends = d.groupBy(*by).agg(F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
        d = d.join(F.broadcast(ends), list(by))
        lo, hi = F.col("__lo"), F.col("__hi")
    else:
        d = d.withColumn("__e", d.select(F.struct(F.min("__v").alias("lo"), F.max("__v").alias("hi"))).scalar())
        lo, hi = F.col("__e.lo"), F.col("__e.hi")
    inner = F.floor(F.try_divide(F.col("__v") - lo, hi - lo) * F.lit(n))
    b = F.coalesce(F.least(inner, F.lit(n - 1)), F.lit(0)).cast("int")
    return d.withColumn("__b", b).drop("__v", "__lo", "__hi", "__e")


def ranked(df: DataFrame, col: str, name: str, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Position of every row in the order of ``col``, 0-based, over the whole
    table or within each group of ``by``, without one task ever ordering it all.

    Rows are ranked inside their value bucket and moved up by the number of
    rows in all lower buckets (a table of one row per group and bucket). Every
    step is a pure function of the data, so a recomputed task gives the same
    positions.
    """
    d = _bucketed(df, col, by, buckets)
    local = d.withColumn("__l", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(col)) - 1)
    counts = d.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    below = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "__b", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__o"))
    out = local.join(F.broadcast(offsets), [*by, "__b"])   # at most one row per bucket and group
    return out.withColumn(name, F.col("__o") + F.col("__l")).drop("__b", "__o", "__l")


def neighbours(labels: DataFrame, col: str, buckets: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The labels of an axis (or of each axis of ``by``) with the next lower
    (``p``) and next higher (``n``) one. Inside a value bucket they are the
    rows before and after; at its ends they come from the buckets beside it."""
    d = _bucketed(labels.select(*by, col), col, by, buckets)
    here = Window.partitionBy(*by, "__b").orderBy(col)
    local = d.select(*by, col, "__b", F.lag(col).over(here).alias("p"), F.lead(col).over(here).alias("n"))
    beside = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b")
    ends = d.groupBy(*by, "__b").agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    ends = ends.select(*by, "__b", F.lag("hi").over(beside).alias("__p"), F.lead("lo").over(beside).alias("__n"))
    out = local.join(F.broadcast(ends), [*by, "__b"])   # at most one row per bucket (and axis)
    return out.select(*by, col, F.coalesce("p", "__p").alias("p"), F.coalesce("n", "__n").alias("n"))


def axis_index(df: DataFrame, col: str, name: str = "i", buckets: int | None = None) -> DataFrame:
    """Position of every label on the axis, 0-based, in label order."""
    return ranked(axis(df, col), col, name, buckets=buckets).select(col, name)


def isel(df: DataFrame, col: str, positions: list[int]) -> DataFrame:
    """keep the labels at the given axis positions (negative = from end)."""
    idx = axis_index(df, col, "_pos")
    if any(p < 0 for p in positions):
        idx = written(idx, "axis")
        n = idx.count()
        positions = [p + n if p < 0 else p for p in positions]
    keep = idx.where(F.col("_pos").isin(positions)).select(col)
    return df.join(F.broadcast(keep), col, "left_semi")   # at most one row per position
