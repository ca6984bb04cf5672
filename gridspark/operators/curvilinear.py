"""Regridding of curvilinear sources (J7 bilinear, J8 conservative).

A curvilinear grid has whole-numbered rows and columns, and two coordinates
``u`` and ``v`` of each centre that follow no axis (a rotated or projected
model grid). A table of centres ``(y, x, u, v)`` is all that is needed of it; the
weight tables ``(sy, sx, ty, tx, w)`` made here are applied to the data by
:func:`apply_bilinear` and :func:`apply_conservative`.

Geometry meets geometry through a spatial hash, by equality: a quadrilateral
belongs to the level of its size (the next power of two), where it touches
four squares at most; the other side looks up the squares it touches at each level
that occurs. So cells of very different sizes need no common square, and no range
join is planned. Pairs that meet in several squares are kept in the first one.

A target that is a rectilinear lattice is not listed (:class:`Lattice`): each
source extent looks up the places and cells that it meets by arithmetic, so the
work follows the source, not the extent around it.

* Bilinear weights come from the four centres around a target point: the point's
  place in their quadrilateral solves a quadratic equation, written in columns.
* Conservative weights are areas of overlap: a source cell is clipped by the four
  edges of a target cell (a fold over the edges), and the shoelace sum
  gives the area of what is left. Corners of cells are the means of four
  centres; beyond the outer centres one more row and column continue the grid.

Defined results: a target point outside all quadrilaterals gets no weights; a
point on a common edge or centre takes the first quadrilateral by row and
column (corners of no weight are dropped, so all give the same value); centres
with a missing coordinate take no part; a grid of one row or column has no
quadrilaterals and gives no weights. Coordinates are taken as a plane;
``period`` joins the ends of ``u`` (360 for longitudes) for bilinear weights, and
``equal_area`` maps latitudes to the plane in which areas are true.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .axes import checked_broadcast

EPS = 1e-9
CORNERS = ("a", "b", "c", "d")   # (0, 0), (0, 1), (1, 1), (1, 0) by row and column


@dataclass(frozen=True)
class Lattice:
    """A rectilinear target of ``n`` places along ``u`` and ``v``, ``step`` apart from ``start`` on."""

    start: dict[str, float]
    n: dict[str, int]
    step: float

    def _centre(self, w: str, k: Column) -> Column:
        """The coordinate of place ``k``; one place beyond each end it is continued from the last two."""
        at = lambda i: F.lit(self.start[w]) + i * self.step
        n = self.n[w]
        return F.when(k < 0, 2 * at(F.lit(0)) - at(F.lit(1))).when(k >= n, 2 * at(F.lit(n - 1)) - at(F.lit(n - 2))).otherwise(at(k))

    def _near(self, boxes: DataFrame, reach: float) -> DataFrame:
        """Each extent once for each place at most ``reach`` steps beyond it, as ``tx`` and ``ty``."""
        out = boxes
        for k, w in (("tx", "u"), ("ty", "v")):
            low = F.ceil((F.col(f"lo{w}") - EPS - self.start[w]) / self.step - reach - 1e-6)
            high = F.floor((F.col(f"hi{w}") + EPS - self.start[w]) / self.step + reach + 1e-6)
            out = out.withColumns({"__low": F.greatest(low, F.lit(0)), "__high": F.least(high, F.lit(self.n[w] - 1))}).where("__low <= __high")
            out = out.withColumn(k, F.explode(F.sequence("__low", "__high"))).withColumn(k, F.col(k).cast("int")).drop("__low", "__high")
        return out

    def places(self, boxes: DataFrame) -> DataFrame:
        """Pairs of an extent ``lou … hiv`` and a place ``(ty, tx, u, v)`` in it."""
        d = self._near(boxes, 0.0).withColumns({"u": self._centre("u", F.col("tx")), "v": self._centre("v", F.col("ty"))})
        inside = [F.col(w).between(F.col(f"lo{w}") - EPS, F.col(f"hi{w}") + EPS) for w in "uv"]
        return d.where(inside[0] & inside[1])

    def cells(self, boxes: DataFrame) -> DataFrame:
        """Pairs of an extent and a cell that meets it, with corners ``tau … tdv`` as :func:`cells` makes them."""
        if min(self.n.values()) < 2:   # a lattice of one row or column has no cells
            return boxes.where("false").withColumns({"ty": F.lit(0), "tx": F.lit(0)} | {f"t{k}{w}": F.lit(0.0) for k in CORNERS for w in "uv"})

        def edge(w: str, k: Column) -> Column:   # the mean of four centres, in the order in which cells() adds them
            a, b = self._centre(w, k), self._centre(w, k + 1)
            return (a + b + b + a if w == "u" else a + a + b + b) / 4

        d = self._near(boxes, 0.5).withColumns({f"__{n}{w}": edge(w, F.col(k) + step) for w, k in (("u", "tx"), ("v", "ty")) for n, step in (("lo", -1), ("hi", 0))})
        apart = [(F.col(f"__lo{w}") > F.col(f"hi{w}") + EPS) | (F.col(f"lo{w}") > F.col(f"__hi{w}") + EPS) for w in "uv"]
        ends = {"a": ("lo", "lo"), "b": ("hi", "lo"), "c": ("hi", "hi"), "d": ("lo", "hi")}
        corners = {f"t{k}{w}": F.col(f"__{n}{w}") for k, (u, v) in ends.items() for w, n in (("u", u), ("v", v))}
        return d.where(~(apart[0] | apart[1])).withColumns(corners).drop(*[f"__{n}{w}" for n in ("lo", "hi") for w in "uv"])


def lattice(points: DataFrame, step: float, inset: float = 0.0, row: str = "ty", col: str = "tx", listed: bool = True) -> DataFrame | Lattice:
    """A rectilinear target over the extent of ``points``, as centres ``(row, col, u, v)``; not ``listed`` as a :class:`Lattice`."""
    ext = points.agg(*[f(c).alias(f"{n}{c}") for c in "uv" for n, f in (("lo", F.min), ("hi", F.max))]).where("lou is not null")
    number = lambda c: F.floor((F.col(f"hi{c}") - F.col(f"lo{c}") - 2 * inset) / step + EPS)
    if not listed:   # four numbers go to the driver
        one = ext.select(*[(F.col(f"lo{c}") + inset).alias(c) for c in "uv"], *[number(c).cast("long").alias(f"n{c}") for c in "uv"]).first()
        return Lattice({c: one[c] if one else 0.0 for c in "uv"}, {c: max(0, one[f"n{c}"] + 1) if one else 0 for c in "uv"}, step)
    steps = lambda c: F.sequence(F.lit(0), number(c).cast("int"))
    rows = ext.select("*", F.explode(steps("v")).alias(row))
    every = rows.select("*", F.explode(steps("u")).alias(col))
    return every.select(row, col, (F.col("lou") + inset + F.col(col) * step).alias("u"), (F.col("lov") + inset + F.col(row) * step).alias("v"))


def quads(points: DataFrame, row: str, col: str) -> DataFrame:
    """``(row, col, au, av, … du, dv)``: each two-by-two block of points, named by its first one."""
    own = points.where(F.col("u").isNotNull() & F.col("v").isNotNull())
    places = [("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 1, 0)]
    copies = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(row) - dr).alias("r"), (F.col(col) - dc).alias("c")) for k, dr, dc in places]))
    each = own.select(copies.alias("p"), "u", "v").select("p.*", "u", "v")
    pick = [F.max(F.when(F.col("k") == k, F.col(w))).alias(f"{k}{w}") for k in CORNERS for w in "uv"]
    whole = each.groupBy(F.col("r").alias(row), F.col("c").alias(col)).agg(*pick)
    return whole.where(" and ".join(f"{k}u is not null" for k in CORNERS))


def continued(points: DataFrame, row: str, col: str) -> DataFrame:
    """``points`` with one more row and column on each side, as far beyond the outer one as that is from its neighbour."""
    out = points.select(row, col, "u", "v")
    for axis, other in ((row, col), (col, row)):
        ends = out.groupBy(other).agg(F.min(axis).alias("lo"), F.max(axis).alias("hi"))
        near = out.join(ends.where("hi > lo"), other)
        sides = []
        for end, step in (("lo", 1), ("hi", -1)):
            first, second = F.col(axis) == F.col(end), F.col(axis) == F.col(end) + step
            at = near.where(first | second).groupBy(other, (F.col(end) - step).alias(axis)).agg(
                F.count(F.lit(1)).alias("n"), *[F.sum(F.when(first, 2 * F.col(c)).otherwise(-F.col(c))).alias(c) for c in "uv"])
            sides.append(at.where("n = 2").select(row, col, "u", "v"))
        out = out.unionByName(sides[0]).unionByName(sides[1])
    return out


def cells(points: DataFrame, row: str, col: str) -> DataFrame:
    """The quadrilateral cells around centres, as :func:`quads` returns them; named by their centre."""
    blocks = quads(continued(points.where("u is not null and v is not null"), row, col), row, col)
    mean = lambda w: sum((F.col(f"{k}{w}") for k in CORNERS[1:]), F.col(f"a{w}")) / 4
    corners = blocks.select(row, col, mean("u").alias("u"), mean("v").alias("v"))
    return quads(corners, row, col).withColumns({row: F.col(row) + 1, col: F.col(col) + 1})


# ----------------------------------------------------------------- spatial hash


def _box(df: DataFrame) -> DataFrame:
    """Extent of the quadrilaterals and the level of their size."""
    d = df.withColumns({f"{n}{w}": f(*[F.col(f"{k}{w}") for k in CORNERS]) for n, f in (("lo", F.least), ("hi", F.greatest)) for w in "uv"})
    size = F.greatest(F.col("hiu") - F.col("lou"), F.col("hiv") - F.col("lov"), F.lit(2.0 ** -500))
    return d.withColumn("level", F.ceil(F.log2(size)).cast("int"))


def _square(c: Column, level: Column) -> Column:
    return F.floor(c * F.pow(F.lit(2.0), -level)).cast("long")


def _touched(level: Column, margin: float = 0.0) -> list[Column]:
    """First and last square of an extent in both directions."""
    return [_square(F.col(f"{n}{w}") + (margin if n == "hi" else -margin), level) for w in "uv" for n in ("lo", "hi")]


def _listed(df: DataFrame, margin: float = 0.0) -> DataFrame:
    """Each row once for each square of its level that it touches: columns ``bu`` and ``bv``, and the first ones ``fu`` and ``fv``."""
    fu, lu, fv, lv = _touched(F.col("level"), margin)
    d = df.withColumns({"fu": fu, "lu": lu, "fv": fv, "lv": lv})
    return (d.withColumn("hu", F.explode(F.sequence("fu", "lu"))).withColumn("hv", F.explode(F.sequence("fv", "lv"))).drop("lu", "lv"))


def meeting(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of rows whose extents meet. Both have ``lou, hiu, lov, hiv``; ``sources`` also have ``level``.

    The levels that occur go to the driver: they are the binary exponents of the sizes.
    """
    levels = sorted(r.level for r in sources.select("level").distinct().collect())
    if not levels:
        levels = [0]
    s = _listed(sources, EPS).withColumnsRenamed({"fu": "sfu", "fv": "sfv", "lou": "slou", "hiu": "shiu", "lov": "slov", "hiv": "shiv"})
    t = _listed(targets.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]))), EPS)
    first = (F.col("hu") == F.greatest("fu", "sfu")) & (F.col("hv") == F.greatest("fv", "sfv"))
    apart = (F.col("slou") > F.col("hiu") + EPS) | (F.col("lou") > F.col("shiu") + EPS) | (F.col("slov") > F.col("hiv") + EPS) | (F.col("lov") > F.col("shiv") + EPS)
    return t.join(s, ["level", "hu", "hv"]).where(first & ~apart)


# ----------------------------------------------------------------- bilinear


def _place(pairs: DataFrame) -> DataFrame:
    """``pairs`` of a point (u, v) and corners, with ``p``: the places (s, t) between them that lie inside, for each
    root ``t`` of ``k2 t² + k1 t + k0``. The roots become rows, so what follows reads them as columns and
    no filter is pushed below with the whole formula in it."""
    c = F.col
    side = {f"e{w}": c(f"b{w}") - c(f"a{w}") for w in "uv"} | {f"f{w}": c(f"d{w}") - c(f"a{w}") for w in "uv"}
    side |= {f"h{w}": c(w) - c(f"a{w}") for w in "uv"} | {f"g{w}": c(f"a{w}") - c(f"b{w}") + c(f"c{w}") - c(f"d{w}") for w in "uv"}
    cross = lambda p, q: side[f"{p}u"] * side[f"{q}v"] - side[f"{p}v"] * side[f"{q}u"]
    terms = pairs.withColumns({"k2": cross("g", "f"), "k1": cross("e", "f") + cross("h", "g"), "k0": cross("h", "e")})
    disc = c("k1") * c("k1") - 4 * c("k0") * c("k2")
    q = F.when(disc >= 0, -0.5 * (c("k1") + F.when(c("k1") < 0, -1.0).otherwise(1.0) * F.sqrt(disc)))
    d = terms.withColumn("q", q).select(*pairs.columns, F.posexplode(F.array(F.try_divide("q", "k2"), F.try_divide("k0", "q"))).alias("root", "t"))
    d = d.where(c("t").between(-EPS, 1 + EPS))
    du, dv = (side[f"e{w}"] + side[f"g{w}"] * c("t") for w in "uv")
    along = lambda w, length: F.try_divide(side[f"h{w}"] - side[f"f{w}"] * c("t"), length)
    s = F.when(F.abs(du) >= F.abs(dv), along("u", du)).otherwise(along("v", dv))
    return d.withColumn("s", s).where(c("s").between(-EPS, 1 + EPS)).withColumn("p", F.struct("root", _snap(c("s")).alias("s"), _snap(c("t")).alias("t")))


def _snap(c: Column) -> Column:
    return F.when(c < EPS, F.lit(0.0)).when(c > 1 - EPS, F.lit(1.0)).otherwise(c)


def _periodic(q: DataFrame, period: float) -> DataFrame:
    """Quadrilaterals with their corners next to the first one; those beyond an end of [0, period) are listed at the other end as well."""
    first = F.col("au") - F.floor(F.col("au") / period) * period
    turn = lambda c: c - F.round((c - F.col("au")) / period) * period - F.col("au") + first
    near = q.withColumns({f"{k}u": turn(F.col(f"{k}u")) for k in CORNERS})
    us = [F.col(f"{k}u") for k in CORNERS]
    shifts = F.filter(F.array(
        F.lit(0.0), F.when(F.least(*us) < 0, F.lit(period)), F.when(F.greatest(*us) >= period, F.lit(-period))), lambda x: x.isNotNull())
    return near.withColumn("turn", F.explode(shifts)).withColumns({f"{k}u": F.col(f"{k}u") + F.col("turn") for k in CORNERS}).drop("turn")


def bilinear_weights(points: DataFrame, targets: DataFrame | Lattice, y: str = "y", x: str = "x", period: float | None = None) -> DataFrame:
    """``(sy, sx, ty, tx, w)`` for targets ``(ty, tx, u, v)`` from centres ``(y, x, u, v)``."""
    blocks = quads(points, y, x)
    if isinstance(targets, Lattice):
        if period is not None:
            raise ValueError("a lattice on a periodic axis has to be listed")
        pairs = targets.places(_box(blocks.withColumnsRenamed({y: "qy", x: "qx"})))
    else:
        at = targets.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select("ty", "tx", "u", "v")
        if period is not None:
            blocks = _periodic(blocks.withColumns({y: F.col(y).cast("long"), x: F.col(x).cast("long")}), period)
            at = at.withColumn("u", F.col("u") - F.floor(F.col("u") / period) * period)
        source = written(_box(blocks.withColumnsRenamed({y: "qy", x: "qx"})), "quads")
        pairs = meeting(source, at.withColumns({"lou": F.col("u"), "hiu": F.col("u"), "lov": F.col("v"), "hiv": F.col("v")}))
    one = _place(pairs).groupBy("ty", "tx").agg(F.min(F.struct("qy", "qx", "p")).alias("m")).select("ty", "tx", "m.qy", "m.qx", "m.p.s", "m.p.t")
    s, t = F.col("s"), F.col("t")
    corners = [(0, 0, (1 - s) * (1 - t)), (0, 1, s * (1 - t)), (1, 1, s * t), (1, 0, (1 - s) * t)]
    four = F.array(*[F.struct((F.col("qy") + dy).alias("sy"), (F.col("qx") + dx).alias("sx"), w.alias("w")) for dy, dx, w in corners])
    return one.select("ty", "tx", F.explode(four).alias("k")).select("k.sy", "k.sx", "ty", "tx", "k.w").where("w > 0")


def apply_bilinear(df: DataFrame, values: Sequence[str], weights: DataFrame, time: str = "time", y: str = "y", x: str = "x") -> DataFrame:
    """The weighted sums by (time, target); a target with a missing centre is missing."""
    w = checked_broadcast(weights.withColumn("__k", F.count(F.lit(1)).over(Window.partitionBy("ty", "tx"))))
    d = df.select(time, F.col(y).alias("sy"), F.col(x).alias("sx"), *values).join(w, ["sy", "sx"])
    full = lambda v: F.when(F.count(v) == F.max("__k"), F.sum(F.col("w") * F.col(v)))
    return d.groupBy(time, F.col("ty").alias(y), F.col("tx").alias(x)).agg(*[full(v).alias(v) for v in values])


# ----------------------------------------------------------------- conservative


def equal_area(points: DataFrame) -> DataFrame:
    """Degrees of latitude in ``v`` mapped to the cylinder on which areas are true."""
    return points.withColumn("v", F.degrees(F.sin(F.radians("v"))))


def _polygon(prefix: str, u0: Column, v0: Column) -> Column:
    """The corners relative to a point, as an array."""
    return F.array(*[F.struct((F.col(f"{prefix}{k}u") - u0).alias("u"), (F.col(f"{prefix}{k}v") - v0).alias("v")) for k in CORNERS])


def shoelace(polygon: Column) -> Column:
    """Signed area: positive for corners in counter-clockwise order."""
    n = F.size(polygon)
    turns = F.transform(polygon, lambda p, i: p["u"] * F.get(polygon, (i + 1) % n)["v"] - p["v"] * F.get(polygon, (i + 1) % n)["u"])
    return F.aggregate(turns, F.lit(0.0), lambda acc, t: acc + t) / 2


def clipped(subject: Column, clip: Column) -> Column:
    """What of the polygon ``subject`` lies in the convex, counter-clockwise polygon ``clip``: one edge after the other cuts it."""
    def cut(poly: Column, edge: Column) -> Column:
        side = lambda p: edge["du"] * (p["v"] - edge["v"]) - edge["dv"] * (p["u"] - edge["u"])

        def kept(p: Column, i: Column) -> Column:
            before = F.get(poly, (i + F.size(poly) - 1) % F.size(poly))
            a, b = side(before), side(p)
            share = F.try_divide(a, a - b)
            crossing = F.struct((before["u"] + share * (p["u"] - before["u"])).alias("u"), (before["v"] + share * (p["v"] - before["v"])).alias("v"))
            return (F.when((a < 0) & (b > 0) | (a > 0) & (b < 0), F.when(b >= 0, F.array(crossing, p)).otherwise(F.array(crossing)))
                    .when(b >= 0, F.array(p)).otherwise(F.slice(F.array(p), 1, 0)))

        return F.flatten(F.transform(poly, kept))

    n = F.size(clip)
    edges = F.transform(clip, lambda p, i: F.struct(
        p["u"].alias("u"), p["v"].alias("v"), (F.get(clip, (i + 1) % n)["u"] - p["u"]).alias("du"), (F.get(clip, (i + 1) % n)["v"] - p["v"]).alias("dv")))
    return F.aggregate(edges, subject, cut)


def conservative_weights(points: DataFrame, targets: DataFrame | Lattice, y: str = "y", x: str = "x") -> DataFrame:
    """``(sy, sx, ty, tx, w)``, the areas that the cells around ``(y, x, u, v)`` share with those around ``(ty, tx, u, v)``."""
    source = _box(cells(points, y, x).withColumnsRenamed({y: "sy", x: "sx"}))
    if isinstance(targets, Lattice):
        pairs = targets.cells(source)
    else:
        target = _box(cells(targets, "ty", "tx")).drop("level").withColumnsRenamed({f"{k}{w}": f"t{k}{w}" for k in CORNERS for w in "uv"})
        pairs = meeting(written(source, "cells"), target)
    origin = F.col("tau"), F.col("tav")
    both = pairs.select("sy", "sx", "ty", "tx", _polygon("", *origin).alias("s"), _polygon("t", *origin).alias("t"))
    turned = F.when(shoelace(F.col("t")) < 0, F.reverse("t")).otherwise(F.col("t"))
    both = both.withColumn("t", turned).withColumn("left", clipped(F.col("s"), F.col("t")))
    # the area becomes a row, so no filter on it is pushed below with the whole fold in it
    return both.select("sy", "sx", "ty", "tx", F.explode(F.array(F.abs(shoelace(F.col("left"))))).alias("w")).where(F.col("w") > EPS * EPS)


def apply_conservative(df: DataFrame, values: Sequence[str], weights: DataFrame, time: str = "time", y: str = "y", x: str = "x") -> DataFrame:
    """The area-weighted means by (time, target) over the cells that are not missing."""
    d = df.select(time, F.col(y).alias("sy"), F.col(x).alias("sx"), *values).join(checked_broadcast(weights), ["sy", "sx"])
    mean = lambda v: F.try_divide(F.sum(F.col("w") * F.col(v)), F.sum(F.when(F.col(v).isNotNull(), F.col("w"))))
    return d.groupBy(time, F.col("ty").alias(y), F.col("tx").alias(x)).agg(*[mean(v).alias(v) for v in values])
