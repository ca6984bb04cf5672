"""Regridding of curvilinear grids: fields that a method must reproduce, odd grids, clipping against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridspark.operators import curvilinear as C


def grid(spark, rows, cols, place):
    """Centres of a grid of rows x cols at place(y, x)."""
    return spark.createDataFrame([(y, x, *map(float, place(y, x))) for y in range(rows) for x in range(cols)], "y int, x int, u double, v double")


def bent(y, x):
    return 0.8 * x - 0.6 * y + 0.02 * x * x, 0.6 * x + 0.8 * y + 0.01 * x * x


def test_bilinear_keeps_what_it_must(spark):
    """Weights sum to one and give the target's own coordinates; on a centre there is one weight."""
    centres = grid(spark, 12, 9, bent)
    targets = C.lattice(centres, 0.7, 0.1)
    w = C.bilinear_weights(centres, targets)
    back = w.join(centres, [F.col("sy") == F.col("y"), F.col("sx") == F.col("x")]).groupBy("ty", "tx").agg(
        F.sum("w").alias("w"), F.sum(F.col("w") * F.col("u")).alias("bu"), F.sum(F.col("w") * F.col("v")).alias("bv"), F.min("w").alias("least"))
    rows = back.join(targets, ["ty", "tx"]).collect()
    assert len(rows) > 100
    for r in rows:
        assert abs(r.w - 1) < 1e-9 and abs(r.bu - r.u) < 1e-7 and abs(r.bv - r.v) < 1e-7 and r.least > 0
    own = C.bilinear_weights(centres, centres.select(F.col("y").alias("ty"), F.col("x").alias("tx"), "u", "v")).collect()
    assert sorted((r.ty, r.tx) for r in own) == sorted((r.sy, r.sx) for r in own) and len(own) == 108
    assert all((r.sy, r.sx, r.w) == (r.ty, r.tx, 1.0) for r in own)


def test_bilinear_finds_every_target_inside(spark):
    """Targets placed at known (s, t) of quadrilaterals of very different sizes are found."""
    size = lambda k: 1.6 ** k
    centres = grid(spark, 14, 14, lambda y, x: (size(x) + 0.1 * y, size(y) - 0.05 * x))
    rng, want = random.Random(1), {}
    at = {(r.y, r.x): (r.u, r.v) for r in centres.collect()}
    for i in range(300):
        y, x, s, t = rng.randrange(13), rng.randrange(13), rng.random(), rng.random()
        a, b, c, d = at[y, x], at[y, x + 1], at[y + 1, x + 1], at[y + 1, x]
        p = [(1 - s) * (1 - t) * a[k] + s * (1 - t) * b[k] + s * t * c[k] + (1 - s) * t * d[k] for k in (0, 1)]
        want[i] = (y, x, s, t, *p)
    targets = spark.createDataFrame([(i, 0, w[4], w[5]) for i, w in want.items()], "ty int, tx int, u double, v double")
    got = {}
    for r in C.bilinear_weights(centres, targets).collect():
        got.setdefault(r.ty, {})[r.sy, r.sx] = r.w
    for i, (y, x, s, t, *_) in want.items():
        for key, w in {(y, x): (1 - s) * (1 - t), (y, x + 1): s * (1 - t), (y + 1, x + 1): s * t, (y + 1, x): (1 - s) * t}.items():
            assert abs(got[i].get(key, 0) - w) < 1e-6


def test_periodic_longitudes(spark):
    """A grid around the globe: a point between the last and the first column has weights of both."""
    centres = grid(spark, 3, 13, lambda y, x: (x % 12 * 30 - 180, y * 10))
    targets = spark.createDataFrame([(0, 0, 165.0, 5.0), (0, 1, -195.0, 5.0), (0, 2, 525.0, 5.0), (0, 3, 0.0, 15.0), (0, 4, 359.0, 20.0)], "ty int, tx int, u double, v double")
    got = {}
    for r in C.bilinear_weights(centres, targets, period=360.0).collect():
        got.setdefault(r.tx, {})[r.sy, r.sx] = round(r.w, 6)
    seam = {(0, 11): 0.25, (0, 12): 0.25, (1, 11): 0.25, (1, 12): 0.25}
    assert got[0] == got[1] == got[2] == seam
    assert got[3] == {(1, 6): 0.5, (2, 6): 0.5} and got[4] == {(2, 5): 0.033333, (2, 6): 0.966667}


def test_conservative_keeps_constants_and_integral(spark):
    """Overlaps fill each target inside the source, and together the area of the source where the target covers it."""
    centres = grid(spark, 9, 8, bent)
    cover = C.lattice(centres, 1.1, -3.0)
    w = C.conservative_weights(centres, cover)
    area = C.cells(centres, "y", "x").select("y", "x", F.abs(C.shoelace(C._polygon("", F.lit(0.0), F.lit(0.0)))).alias("area"))
    own = w.groupBy(F.col("sy").alias("y"), F.col("sx").alias("x")).agg(F.sum("w").alias("w")).join(area, ["y", "x"]).collect()
    assert len(own) == 72 and all(abs(r.w - r.area) < 1e-9 for r in own)
    data = centres.select(F.lit(1).alias("time"), "y", "x", F.lit(7.0).alias("c"), F.when((F.col("y") + F.col("x")) % 3 > 0, F.col("u")).alias("holes"))
    out = C.apply_conservative(data, ["c", "holes"], w).collect()
    assert out and all(abs(r.c - 7) < 1e-9 for r in out)
    total = sum(r.w * u for r in w.collect() for u in [bent(r.sy, r.sx)[0]])
    assert abs(total - sum(r.area * bent(r.y, r.x)[0] for r in own)) < 1e-6


def plain_clip(subject, clip):
    """Area of the overlap of two convex polygons by sampling edges: plain half-plane cuts."""
    poly = subject
    for k in range(len(clip)):
        (pu, pv), (qu, qv) = clip[k], clip[(k + 1) % len(clip)]
        side = lambda p: (qu - pu) * (p[1] - pv) - (qv - pv) * (p[0] - pu)  # noqa: E731,B023
        out = []
        for i, p in enumerate(poly):
            o = poly[i - 1]
            if side(o) * side(p) < 0:
                s = side(o) / (side(o) - side(p))
                out.append((o[0] + s * (p[0] - o[0]), o[1] + s * (p[1] - o[1])))
            if side(p) >= 0:
                out.append(p)
        poly = out
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(poly, poly[1:] + poly[:1]))) / 2


def test_clipping(spark):
    rng, rows = random.Random(4), []
    for i in range(200):
        def quad(size):
            u, v, turn = rng.uniform(-2, 2), rng.uniform(-2, 2), rng.uniform(0, 6)
            return [(u + size * math.cos(turn + k), v + size * math.sin(turn + k)) for k in (0, 1.4, 3.1, 4.9)]  # noqa: B023
        rows.append((i, quad(rng.choice([0.5, 1, 3])), quad(rng.choice([0.5, 1, 3]))))
    rows += [(200, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(1.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0)]),
             (201, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])]
    kind = "array<struct<u:double,v:double>>"
    got = spark.createDataFrame(rows, f"i int, s {kind}, t {kind}").select("i", F.abs(C.shoelace(C.clipped(F.col("s"), F.col("t")))).alias("w")).collect()
    for r in got:
        assert abs(r.w - plain_clip(rows[r.i][1], rows[r.i][2])) < 1e-9
    assert [r.w for r in got if r.i >= 200] == [0.0, 1.0]


def test_equal_area_of_the_globe(spark):
    """Cells of a global grid share the sphere as sines of latitude do."""
    centres = grid(spark, 6, 4, lambda y, x: (x * 90, y * 30 - 75))
    flat = C.cells(centres, "y", "x").select("y", "x", *[F.col(f"{k}{w}") for k in C.CORNERS for w in "uv"])
    corners = {(r.y, r.x): (r.av, r.cv) for r in flat.collect()}
    assert corners[0, 0] == (-90.0, -60.0) and corners[5, 3] == (60.0, 90.0)
    band = C.equal_area(spark.createDataFrame([(0, 0, 0.0, 30.0)], "y int, x int, u double, v double")).first().v
    assert abs(band - math.degrees(0.5)) < 1e-12


@pytest.mark.parametrize("rows, cols", [(1, 5), (5, 1), (0, 0)])
def test_thin_and_empty_grids(spark, rows, cols):
    centres = grid(spark, rows, cols, bent)
    targets = spark.createDataFrame([(0, 0, 0.1, 0.1), (0, 1, 1.1, 0.1), (1, 0, 0.1, 1.1), (1, 1, 1.1, 1.1), (2, 2, None, 1.0)], "ty int, tx int, u double, v double")
    assert C.bilinear_weights(centres, targets).count() == 0
    assert C.conservative_weights(centres, targets).count() == 0


def test_missing_centres_and_values(spark):
    centres = grid(spark, 3, 3, lambda y, x: (x, y)).withColumn("u", F.when((F.col("y") < 2) | (F.col("x") < 2), F.col("u")))
    targets = spark.createDataFrame([(0, 0, 0.5, 0.5), (1, 1, 1.5, 1.5), (2, 2, 9.0, 9.0)], "ty int, tx int, u double, v double")
    w = C.bilinear_weights(centres, targets)
    assert {(r.ty, r.tx) for r in w.collect()} == {(0, 0)}
    data = centres.select(F.explode(F.array(F.lit(1), F.lit(2))).alias("time"), "y", "x").withColumn("o", F.when((F.col("time") == 1) | (F.col("x") != 1), F.lit(3.0)))
    assert {(r.time, r.y, r.x): r.o for r in C.apply_bilinear(data, ["o"], w).collect()} == {(1, 0, 0): 3.0, (2, 0, 0): None}


@pytest.mark.parametrize("place, step, inset", [(bent, 0.7, 0.1), (bent, 1.3, -2.0), (bent, 30.0, 0.1), (lambda y, x: (x, y), 1.0, 0.0), (lambda y, x: (x, y), 0.5, 0.25)])
def test_lattice_looked_up_equals_the_listed_one(spark, place, step, inset):
    centres = grid(spark, 9, 8, place)
    listed, looked_up = (C.lattice(centres, step, inset, listed=k) for k in (True, False))
    for weights in (C.bilinear_weights, C.conservative_weights):
        want, got = ({(r.sy, r.sx, r.ty, r.tx): r.w for r in weights(centres, t).collect()} for t in (listed, looked_up))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_lattice_of_a_wide_extent_is_not_listed(spark):
    """Two patches far apart: the extent around them has 10 ** 14 places, the patches have a few."""
    far = 10 ** 7
    centres = grid(spark, 3, 3, lambda y, x: (x, y)).unionByName(
        grid(spark, 3, 3, lambda y, x: (far + x, far + y)).withColumns({"y": F.col("y") + 100, "x": F.col("x") + 100}))
    target = C.lattice(centres, 1.0, 0.0, listed=False)
    own = {(y + k, x + k, y + m, x + m) for k, m in ((0, 0), (100, far)) for y in range(3) for x in range(3)}
    assert {(r.sy, r.sx, r.ty, r.tx): r.w for r in C.bilinear_weights(centres, target).collect()} == dict.fromkeys(own, 1.0)
    area = {(r.sy, r.sx, r.ty, r.tx): r.w for r in C.conservative_weights(centres, target).collect()}
    assert area.keys() == own and all(abs(w - 1) < 1e-6 for w in area.values())
    assert C.bilinear_weights(centres.where("y < 0"), C.lattice(centres.where("y < 0"), 1.0, listed=False)).count() == 0
