"""Terrain slope and aspect by Horn's 3x3 method.

The 3x3 neighbourhood is built without a self-join per neighbour: every
pixel sends its value to its neighbours in the row, and every triple goes to
the rows above and below (two ``explode`` of fixed size 3, each followed by a
grouped aggregate). Neighbours are found by integer pixel position (rank on the
distinct axes), so non-integer coordinates never meet float equality.

Rows run north to south (descending ``y``) and columns west to east
(ascending ``x``), as in a north-up raster. The window is

    a b c
    d e f
    g h i

Edges are computed: a missing neighbour is extrapolated linearly along the
axis that leaves the raster (``2·b − c``), columns first, then rows, which
is exact for a plane; a raster one pixel wide falls back to ``e``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .axes import axis_positions, checked_broadcast

# window cell names: a b c is the northern row, d e f the row of the pixel
# edge filling: a missing neighbour is extrapolated linearly along the axis
# that leaves the raster, columns first (within a row), then rows
_ROW_FILL = {"a": ("b", "c"), "d": ("e", "f"), "g": ("h", "i"), "c": ("b", "a"), "f": ("e", "d"), "i": ("h", "g")}
_COL_FILL = {"a": ("d", "g"), "b": ("e", "h"), "c": ("f", "i"), "g": ("d", "a"), "h": ("e", "b"), "i": ("f", "c")}


def _fill_edges() -> dict:
    c = F.col
    one = {n: F.coalesce(c(n), 2 * c(near) - c(far)) for n, (near, far) in _ROW_FILL.items()}
    two = {n: F.coalesce(one.get(n, c(n)), 2 * one.get(near, c(near)) - one.get(far, c(far)))
           for n, (near, far) in _COL_FILL.items()}
    merged = {**one, **two}
    # a raster one pixel wide or high has nothing to extrapolate from
    return {n: F.coalesce(merged[n], c("e")) for n in merged}


def _spread(df: DataFrame, at: str, keep: str, values: dict[str, tuple[str, int]]) -> DataFrame:
    """Send columns to the neighbouring positions on one axis: ``values`` maps
    a new name to (column, offset). Three copies of each row, then one
    aggregate by position."""
    offsets = sorted({o for _, o in values.values()})
    sent = df.withColumn("__o", F.explode(F.array(*[F.lit(o) for o in offsets])))
    sent = sent.withColumn(at, F.col(at) - F.col("__o"))
    return sent.groupBy(keep, at).agg(*[F.max(F.when(F.col("__o") == o, F.col(c))).alias(n) for n, (c, o) in values.items()])


def neighbourhood(df: DataFrame, value: str, y: str = "y", x: str = "x", axes: tuple | None = None) -> DataFrame:
    """Every pixel with its 3x3 window as columns ``a .. i`` (edges filled).

    First each pixel's value goes to its left and right neighbours, then each
    row's triples go to the rows above and below: 3 + 3 copies instead of 9.
    A pixel without a value stays, with its neighbours.
    """
    at, size = axes or axis_positions(df, [y, x])
    place = lambda c, name: checked_broadcast(at.where(F.col("axis") == c).select(c, F.col("i").alias(name)), size[c][0])
    d = df.join(place(y, "__r"), y).join(place(x, "__c"), x).select("__r", "__c", y, x, F.col(value).cast("double").alias("__v"))
    here = F.struct(F.col(y).alias("y"), F.col(x).alias("x"))
    row = _spread(d.withColumn("__here", here), "__c", "__r", {
        "w": ("__v", -1), "m": ("__v", 0), "n": ("__v", 1), "__at": ("__here", 0)})
    # row positions grow to the north: the row above is one more
    win = _spread(row, "__r", "__c", {
        "a": ("w", 1), "b": ("m", 1), "c": ("n", 1), "d": ("w", 0), "e": ("m", 0), "f": ("n", 0),
        "g": ("w", -1), "h": ("m", -1), "i": ("n", -1), "__p": ("__at", 0)})
    win = win.where("__p is not null").withColumns(_fill_edges())
    return win.select(F.col("__p.y").alias(y), F.col("__p.x").alias(x), *"abcdefghi")


def _gradients(ew_res: float, ns_res: float):
    a, b, c, d, f, g, h, i = (F.col(n) for n in "abcdfghi")
    dx = ((c + 2 * f + i) - (a + 2 * d + g)) / F.lit(8.0 * ew_res)
    dy = ((g + 2 * h + i) - (a + 2 * b + c)) / F.lit(8.0 * ns_res)
    return dx, dy


def spacing(size: tuple[int, float, float]) -> float:
    """Mean step of an axis (1 for an axis of one label)."""
    n, lo, hi = size
    return (hi - lo) / (n - 1) if n > 1 else 1.0


def slope_aspect(df: DataFrame, value: str = "z", y: str = "y", x: str = "x",
                 ew_res: float | None = None, ns_res: float | None = None) -> DataFrame:
    """``slope`` in degrees and ``aspect`` in compass degrees
    (0 = north, clockwise); a flat window has no aspect, and a pixel without a
    value (or without the neighbours to fill its window from) has neither. The resolutions are taken from the axes
    unless they are given."""
    axes = axis_positions(df, [y, x])
    ew = spacing(axes[1][x]) if ew_res is None else ew_res
    ns = spacing(axes[1][y]) if ns_res is None else ns_res
    w = neighbourhood(df, value, y, x, axes)
    has = F.col("e").isNotNull()
    dx, dy = _gradients(ew, ns)
    slope = F.degrees(F.atan(F.sqrt(dx * dx + dy * dy)))
    ax, ay = _gradients(1.0, 1.0)   # the direction is taken in pixels
    a = F.degrees(F.atan2(ay, -ax))
    compass = F.when(a > 90, F.lit(450.0) - a).otherwise(F.lit(90.0) - a)
    compass = F.when(compass == 360.0, F.lit(0.0)).otherwise(compass)
    flat = (ax == 0) & (ay == 0)
    return w.select(y, x, F.col("e").alias(value), F.when(has, slope).cast("float").alias("slope"),
                    F.when(has & ~flat, compass).cast("float").alias("aspect"))
