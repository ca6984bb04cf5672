"""Regridding of rectilinear grids (J7 bilinear, J8 conservative).

Both methods are separable on a rectilinear source: the weight of source
cell (i, j) for target cell (k, l) is ``wy(k, i) * wx(l, j)``. So the plan
builds two *axis* weight tables (sizes bounded by the axis lengths, never
by the data), joins the data to them by equality on the source labels and
aggregates per (time, target cell):

    data ⋈ wx (on x) ⋈ wy (on y) → groupBy(time, ty, tx).agg(sum(w·v))

No range join or 2-D weight table touches the data. Large data are shuffled
by target into as many parts as their joined rows need, so that no task's
aggregate grows with the input.

A curvilinear source has a 2-D weight table ``[sy, sx, ty, tx, w]``:
:func:`apply_weights` takes one from anywhere, :mod:`.curvilinear` makes them.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .axes import checked_broadcast, neighbours, numeric_axes

# ----------------------------------------------------------------- axes


def target_axis(labels: DataFrame, step: float, pad: float = 0.0) -> DataFrame:
    """A target axis derived from a source axis (column ``s``): from
    ``min - pad`` to ``max + pad`` every ``step`` (labels as double, column
    ``t``)."""
    ext = labels.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    n = F.floor((F.col("hi") - F.col("lo") + F.lit(2 * pad)) / F.lit(step) + F.lit(1e-9)).cast("int")
    k = ext.where("hi is not null").select("lo", F.explode(F.sequence(F.lit(0), n)).alias("k"))
    return k.select((F.col("lo") - F.lit(pad) + F.col("k") * F.lit(step)).alias("t"))


def _labels(df: DataFrame, col: str) -> DataFrame:
    return numeric_axes(df, [col])[col]


# Joined rows that one task aggregates at most, about.
TASK_ROWS = 500_000

# Tables of labels have a column ``axis``, so that one job makes the weights of both axes.
AXIS = ["axis"]


def _ends(*tables: tuple[DataFrame, str, str]) -> DataFrame:
    """``(axis, lo, hi, buckets)``: the extent of labels or cells, and as many buckets as the shortest table has rows."""
    each = [t.groupBy("axis").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi"), F.count(F.lit(1)).alias("n")) for t, lo, hi in tables]
    every = functools.reduce(DataFrame.unionByName, each)
    return every.groupBy("axis").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("n").alias("buckets"))


def _bucket(c: Column) -> Column:
    """Equal-width value bucket between ``lo`` and ``hi``; values beyond them fall in the outer buckets."""
    inner = F.floor(F.try_divide(c - F.col("lo"), F.col("hi") - F.col("lo")) * F.col("buckets"))
    return F.coalesce(F.least(F.greatest(inner, F.lit(0)), F.col("buckets") - 1), F.lit(0)).cast("int")


def _bracket(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """For each target label ``t`` of an axis: the nearest source labels ``a <= t <= b``
    (``a = b = t`` on an exact hit). Below the source range ``a`` is
    missing, above it ``b``.

    Consecutive source labels form intervals. Each interval is listed under every equal-width value bucket
    that it spans, and each target looks up its own bucket, keeping
    ``a <= t < b``. There are as many buckets as source labels.
    """
    ends = F.broadcast(_ends((src, "s", "s")))   # a row for each axis
    iv = neighbours(src, "s", by=AXIS).select("axis", F.col("s").alias("a"), F.col("n").alias("b")).join(ends, "axis")   # b null on the last label
    iv = iv.select(F.col("axis").alias("__axis"), "a", "b", F.explode(F.sequence(_bucket(F.col("a")), _bucket(F.coalesce("b", "a")))).alias("__j"))
    t = tgt.join(ends, "axis").select("axis", "t", "lo", _bucket(F.col("t")).alias("__k"))
    # the last label's interval is open to the right
    hit = (F.col("a") <= F.col("t")) & ((F.col("t") < F.col("b")) | F.col("b").isNull())
    m = t.join(iv, (F.col("axis") == F.col("__axis")) & (F.col("__k") == F.col("__j")) & hit, "left")
    # below the range: b is the first label
    up = F.when(F.col("t") == F.col("a"), F.col("a")).when(F.col("a").isNull() & (F.col("t") <= F.col("lo")), F.col("lo"))
    return m.select("axis", "t", "a", up.otherwise(F.col("b")).alias("b"))


def _bilinear_weights(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """``(axis, t, s, w, k)``: linear interpolation along each axis."""
    br = _bracket(src, tgt)
    br = br.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    same = F.col("a") == F.col("b")
    one = F.array(F.struct(F.col("a").alias("s"), F.lit(1.0).alias("w"), F.lit(1).alias("k")))
    gap = F.col("b") - F.col("a")
    two = F.array(
        F.struct(F.col("a").alias("s"), ((F.col("b") - F.col("t")) / gap).alias("w"), F.lit(2).alias("k")),
        F.struct(F.col("b").alias("s"), ((F.col("t") - F.col("a")) / gap).alias("w"), F.lit(2).alias("k")))
    return br.select("axis", "t", F.explode(F.when(same, one).otherwise(two)).alias("n")).select("axis", "t", "n.s", "n.w", "n.k")


def bilinear_axis_weights(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Linear interpolation weights along one axis: rows ``(t, s, w, k)``,
    ``k`` = number of source nodes used (1 on a node, else 2). Targets
    outside the source range get no rows (missing)."""
    one = F.lit("").alias("axis")
    return _bilinear_weights(src.select(one, "s"), tgt.select(one, "t")).drop("axis")


def _edges(ax: DataFrame, col: str) -> DataFrame:
    """Cell bounds of each axis: midpoints between neighbours; the outer
    bounds extend half a spacing; a lone label is a cell of width 1."""
    d = neighbours(ax, col, by=AXIS)
    after, before = F.coalesce(F.col("n") - F.col(col), F.lit(1.0)), F.coalesce(F.col(col) - F.col("p"), F.lit(1.0))
    lo = F.when(F.col("p").isNull(), F.col(col) - after / 2).otherwise((F.col("p") + F.col(col)) / 2)
    hi = F.when(F.col("n").isNull(), F.col(col) + before / 2).otherwise((F.col(col) + F.col("n")) / 2)
    return d.select("axis", col, lo.alias(f"{col}l"), hi.alias(f"{col}h"))


def _conservative_weights(src: DataFrame, tgt: DataFrame, spherical: str | None = None) -> DataFrame:
    """``(axis, t, s, w, k)`` for every source cell overlapping the target cell on an axis; the axis named
    ``spherical`` (latitude) weighs by ``sin(hi) - sin(lo)`` of the overlap instead of its length.

    Overlapping pairs come from a bucketed equi-join (no range join): both
    cell lists are spread over the equal-width value buckets they span,
    joined on the bucket, and each overlapping pair is kept once, at the
    first bucket the two cells share.
    """
    se, te = _edges(src, "s"), _edges(tgt, "t")
    ends = F.broadcast(_ends((se, "sl", "sh"), (te, "tl", "th")))   # a row for each axis

    def listed(cells: DataFrame, lo: str, hi: str, first: str) -> DataFrame:
        d = cells.join(ends, "axis").withColumns({first: _bucket(F.col(lo)), "__to": _bucket(F.col(hi))})
        return d.withColumn("__k", F.explode(F.sequence(first, "__to"))).drop("__to", "lo", "hi", "buckets")

    a, b = F.greatest("tl", "sl"), F.least("th", "sh")
    pairs = listed(te, "tl", "th", "__t0").join(listed(se, "sl", "sh", "__s0"), ["axis", "__k"])
    pairs = pairs.where((b > a) & (F.col("__k") == F.greatest("__s0", "__t0")))
    w = b - a
    if spherical is not None:
        w = F.when(F.col("axis") == spherical, F.sin(F.radians(b)) - F.sin(F.radians(a))).otherwise(w)
    return pairs.select("axis", "t", "s", w.alias("w"), F.lit(1).alias("k"))


def conservative_axis_weights(src: DataFrame, tgt: DataFrame, spherical: bool = False) -> DataFrame:
    """Overlap weights along one axis: rows ``(t, s, w, k)``; see :func:`_conservative_weights`."""
    one = F.lit("").alias("axis")
    return _conservative_weights(src.select(one, "s"), tgt.select(one, "t"), "" if spherical else None).drop("axis")


# ----------------------------------------------------------------- apply


def _both(axes: dict[str, DataFrame], col: str) -> DataFrame:
    """The labels of both axes as one table."""
    return functools.reduce(DataFrame.unionByName, [d.select(F.lit(c).alias("axis"), F.col(col).cast("double").alias(col)) for c, d in axes.items()])


def _apply(df: DataFrame, values: Sequence[str], weights: DataFrame,
           time: str, y: str, x: str, mode: str, rows: int | None) -> DataFrame:
    # axis-sized weight tables, written and counted together, broadcast once their size allows
    weights = written(weights, "weights")
    counts = weights.groupBy("axis").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("s").alias("s")).collect()   # a row for each axis
    sizes = {r.axis: (r.n, r.s) for r in counts}

    def of(axis: str, c: str) -> DataFrame:
        one = weights.where(F.col("axis") == axis).drop("axis").withColumnsRenamed({k: f"__{k}{c}" for k in "tswk"})
        return checked_broadcast(one, sizes.get(axis, (0, 0))[0])

    wy, wx = of(y, "y"), of(x, "x")
    d = df.select(time, F.col(y).cast("double").alias("__sy"), F.col(x).cast("double").alias("__sx"), *values)
    if rows is None:
        d = written(d, "source")
        rows = d.count()
    j = d.join(wx, "__sx").join(wy, "__sy").withColumn("__w", F.col("__wy") * F.col("__wx"))
    # each source cell meets several targets: the rows are shuffled as they are, as hardly any of one target meet before
    parts = math.ceil(rows * math.prod(n / max(1, s) for n, s in sizes.values()) / TASK_ROWS)
    if parts > d.sparkSession.sparkContext.defaultParallelism:
        j = j.repartition(parts, time, "__ty", "__tx")
    aggs: list[Column] = []
    for v in values:
        if mode == "bilinear":
            # every corner must be present, else the target is missing
            full = F.count(v) == F.max(F.col("__ky") * F.col("__kx"))
            aggs.append(F.when(full, F.sum(F.col("__w") * F.col(v))).alias(v))
        else:
            # area-weighted mean over the valid overlapping source cells
            wv = F.when(F.col(v).isNotNull(), F.col("__w"))
            aggs.append(F.try_divide(F.sum(F.col("__w") * F.col(v)), F.sum(wv)).alias(v))
    return j.groupBy(time, F.col("__ty").alias(y), F.col("__tx").alias(x)).agg(*aggs)


def bilinear(df: DataFrame, values: Sequence[str], target_y: DataFrame, target_x: DataFrame,
             time: str = "time", y: str = "y", x: str = "x", axes: dict | None = None, rows: int | None = None) -> DataFrame:
    """Bilinear regridding onto the target axes (columns ``t``). ``axes``
    are the source's axes (:func:`numeric_axes`) and ``rows`` is the number of its
    rows, where they are known."""
    axes = axes or numeric_axes(df, [y, x])
    weights = _bilinear_weights(_both({y: axes[y], x: axes[x]}, "s"), _both({y: target_y, x: target_x}, "t"))
    return _apply(df, values, weights, time, y, x, "bilinear", rows)


def conservative(df: DataFrame, values: Sequence[str], target_y: DataFrame, target_x: DataFrame,
                 time: str = "time", y: str = "y", x: str = "x", spherical: bool = True,
                 axes: dict | None = None, rows: int | None = None) -> DataFrame:
    """First-order conservative regridding (area-overlap weighted mean).

    With ``spherical`` the y axis is latitude in degrees and the cell area
    is ``Δlon · (sin φ2 − sin φ1)``; otherwise areas are planar.
    """
    axes = axes or numeric_axes(df, [y, x])
    weights = _conservative_weights(_both({y: axes[y], x: axes[x]}, "s"), _both({y: target_y, x: target_x}, "t"), y if spherical else None)
    return _apply(df, values, weights, time, y, x, "conservative", rows)


def apply_weights(df: DataFrame, values: Sequence[str], weights: DataFrame, time: str = "time",
                  y: str = "y", x: str = "x") -> DataFrame:
    """J7 second form: a precomputed 2-D weight table ``[sy, sx, ty, tx, w]``
    (curvilinear sources); missing sources leave the target missing."""
    w = weights.select(F.col("sy").cast("double"), F.col("sx").cast("double"), "ty", "tx", "w")
    d = df.select(time, F.col(y).cast("double").alias("sy"), F.col(x).cast("double").alias("sx"), *values)
    j = d.join(w, ["sy", "sx"])
    n = weights.groupBy("ty", "tx").agg(F.count(F.lit(1)).alias("__n"))
    out = j.groupBy(time, "ty", "tx").agg(
        *[F.sum(F.col("w") * F.col(v)).alias(v) for v in values],
        *[F.count(v).alias(f"__c_{v}") for v in values])
    out = out.join(n, ["ty", "tx"])
    out = out.withColumns({v: F.when(F.col(f"__c_{v}") == F.col("__n"), F.col(v)) for v in values})
    return out.select(time, F.col("ty").alias(y), F.col("tx").alias(x), *values)
