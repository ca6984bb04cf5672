"""Property tests on small hand-made grids (plane, constant, NaN, leap year,
offset axes), complementing the oracle checks on the driver tables."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions import scalar as X
from gridspark.operators import axes, grid, joins, metrics, regrid, resample, scale, split, terrain


def plane(spark, n=10, f=lambda x, y: 2 * x + 3 * y + 1, days=1):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), float(y), float(x), float(f(x, y)))
            for d in range(days) for y in range(n) for x in range(n)]
    return spark.createDataFrame(rows, "time date, y double, x double, v double")


def with_nan(spark):
    nan = float("nan")
    rows = []
    for c in range(3):
        for d in range(4):
            v = float(c * 10 + d)
            if c == 1 and d == 2:
                v = nan          # one missing day
            if c == 2:
                v = nan          # an all-missing cell
            rows.append((dt.date(2021, 1, 1) + dt.timedelta(days=d), 0.0, float(c), v))
    df = spark.createDataFrame(rows, "time date, y double, x double, v double")
    return X.nan_to_null_all(df)


def axis_df(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "t double")


# ------------------------------------------------------------------ missing data

def test_nan_becomes_null_and_guarded_sum(spark):
    d = with_nan(spark)
    assert d.where(F.col("v").isNull()).count() == 5
    m = {r["x"]: r["v"] for r in resample.monthly(d, ["v"]).collect()}
    assert m[0.0] == 0 + 1 + 2 + 3
    assert m[1.0] is None and m[2.0] is None


def test_complete_cells_drops_cells_with_any_missing(spark):
    d = with_nan(spark)
    kept = {r["x"] for r in grid.complete_cells(d, ["v"]).select("x").distinct().collect()}
    assert kept == {0.0}


def test_fill_gaps_emits_missing_days(spark):
    d = spark.createDataFrame([(dt.date(2020, 1, 1), 0, 0, 1.0), (dt.date(2020, 1, 4), 0, 0, 4.0)],
                              "time date, y int, x int, v double")
    out = resample.fill_gaps(d).orderBy("time").collect()
    assert [r["v"] for r in out] == [1.0, None, None, 4.0]
    more = d.unionByName(spark.createDataFrame([(dt.date(2020, 1, 3), 0, 1, 3.0)], d.schema))
    assert resample.fill_gaps(more).count() == 8   # every cell has every day of the dataset


def test_last_day_with_six_steps_is_kept_by_the_shift(spark):
    from gridspark.plans import jobs
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), 0, 0, float(h)) for h in range(54)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, y int, x int, v double")
    out = sorted((r["time"].day, r["v"]) for r in jobs.shifted_daily_predictor(df, "v", steps=-6).collect())
    assert out == [(1, sum(range(6, 30)) / 24), (2, sum(range(30, 54)) / 24)]


def test_observed_precipitation_drops_the_missing_day_only(spark):
    from gridspark.plans import jobs
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(hours=3 * h), 0, 0, float(h)) for h in range(40)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, y int, x int, tp double")
    out = sorted((r["time"].day, r["tp"]) for r in jobs.observed_precipitation(df).collect())
    assert out == [(1, 8.0), (2, 16.0), (3, 24.0), (4, 32.0)]


def test_density_counts_values_outside_the_range(spark):
    d = spark.createDataFrame([(0.0,), (100.0,), (200.0,)], "v double")
    got = {round(r["x"], 3): r["density"] for r in metrics.kde(d, "v", -1.0, 1.0, 3, 0.5).collect()}
    norm = 1 / (0.5 * math.sqrt(2 * math.pi)) / 3
    assert got[1.0] == pytest.approx(norm * math.exp(-2)) and got[0.0] == pytest.approx(norm)


def test_median_of_a_map_is_exact(spark):
    for values in ([1.0], [1.0, 2.0], [5.0, 1.0, 1.0, 1e9, 3.0], [2.0] * 7, list(map(float, range(100)))):
        d = spark.createDataFrame([("a", v) for v in values] + [("a", None)], "g string, v double")
        want = sorted(values)[(len(values) - 1) // 2] / 2 + sorted(values)[len(values) // 2] / 2
        assert metrics.map_summary(d, "v").first()["median"] == want
        assert metrics.map_summary(d, "v", ["g"]).first()["median"] == want


def test_conservative_takes_a_lone_label_as_a_unit_cell(spark):
    d = plane(spark, n=1)
    out = regrid.conservative(d, ["v"], axis_df(spark, [0.0]), axis_df(spark, [0.25]), spherical=False).collect()
    assert [r["v"] for r in out] == [1.0]


def test_report_masks_and_does_not_drop(spark):
    """One missing day: its month and its cell's wet days are missing, other months count."""
    from gridspark.plans import jobs
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=d), 0.0, float(c), float((d * 7 + c) % 11), float((d * 5 + c) % 11)) for c in range(2) for d in range(91)]
    df = spark.createDataFrame(rows, "time date, y double, x double, o double, p double")
    df = df.withColumn("o", F.when((F.col("x") == 1) & (F.col("time") == dt.date(2020, 2, 3)), None).otherwise(F.col("o")))
    grids = [df.select("time", "y", "x", F.col(c).alias("v")) for c in ("o", "p")]
    out = {(r["part"], r["x"], r["metric"]): r["value"] for r in jobs.verification_report(*grids, "v", wet_threshold=5.0).collect()}
    assert out["wet_days_map", 0.0, "n_wet_obs"] is not None and out["wet_days_map", 1.0, "n_wet_obs"] is None
    late = df.select("time", "y", "x", F.col("p").alias("v")).withColumn("time", F.date_add("time", 1000))
    with pytest.raises(KeyError):
        jobs.verification_report(grids[0], late, "v")


# ------------------------------------------------------------------ regridding

def test_bilinear_reproduces_a_plane(spark):
    d = plane(spark)
    t = axis_df(spark, [0.0, 0.5, 3.25, 8.75, 9.0])
    out = regrid.bilinear(d, ["v"], t, t).collect()
    assert len(out) == 25
    for r in out:
        assert r["v"] == pytest.approx(2 * r["x"] + 3 * r["y"] + 1, abs=1e-9)


def test_bilinear_outside_hull_is_missing(spark):
    d = plane(spark)
    t = axis_df(spark, [-0.5, 4.5, 9.5])
    out = regrid.bilinear(d, ["v"], t, t).collect()
    assert {(r["y"], r["x"]) for r in out} == {(4.5, 4.5)}


def test_regridding_keeps_constants(spark):
    d = plane(spark, f=lambda x, y: 7.0)
    t = axis_df(spark, [0.5, 2.5, 4.5, 6.5, 8.5])
    for fn in (regrid.bilinear, regrid.conservative):
        vals = {round(r["v"], 9) for r in fn(d, ["v"], t, t).collect()}
        assert vals == {7.0}


def test_conservative_keeps_area_integral(spark):
    d = plane(spark, f=lambda x, y: x * x + y)
    t = axis_df(spark, [0.5, 2.5, 4.5, 6.5, 8.5])   # target cells cover the source exactly
    src = d.agg(F.sum("v")).first()[0]                # unit source cells
    out = regrid.conservative(d, ["v"], t, t, spherical=False)
    tgt = out.agg(F.sum(F.col("v") * 4.0)).first()[0]  # 2 x 2 target cells
    assert tgt == pytest.approx(src, rel=1e-12)


def test_conservative_spherical_weights(spark):
    d = plane(spark, f=lambda x, y: y)
    t = axis_df(spark, [2.0, 7.0])          # cell bounds -0.5..4.5 and 4.5..9.5
    out = {(r["y"], r["x"]): r["v"] for r in regrid.conservative(d, ["v"], t, t, spherical=True).collect()}
    w = [math.sin(math.radians(y + 0.5)) - math.sin(math.radians(y - 0.5)) for y in range(5)]
    expect = sum(wi * y for wi, y in zip(w, range(5))) / sum(w)
    assert out[(2.0, 2.0)] == pytest.approx(expect, rel=1e-9)
    assert out[(2.0, 7.0)] == pytest.approx(expect, rel=1e-9)


# ------------------------------------------------------------------ terrain

def test_slope_of_a_plane_is_exact_including_edges(spark):
    d = plane(spark, f=lambda x, y: 2 * x + 3 * y + 1).select("y", "x", F.col("v").alias("z"))
    out = terrain.slope_aspect(d, "z").collect()
    assert len(out) == 100
    expect = math.degrees(math.atan(math.sqrt(2 ** 2 + 3 ** 2)))
    for r in out:
        assert r["slope"] == pytest.approx(expect, abs=1e-4)
    # terrain rises to the north-east: it faces south-west
    face = math.degrees(math.atan2(-3, -2))
    expect_aspect = 450 - face if face > 90 else 90 - face
    assert out[0]["aspect"] == pytest.approx(expect_aspect % 360, abs=1e-3)


def test_slope_takes_the_spacing_from_the_axes(spark):
    rows = [(0.5 * r, 0.5 * c, 2 * 0.5 * c + 3 * 0.5 * r) for r in range(8) for c in range(8)]
    d = spark.createDataFrame([*rows[:-1], (*rows[-1][:2], None)], "y double, x double, z double")
    out = {(r["y"], r["x"]): r["slope"] for r in terrain.slope_aspect(d, "z").collect()}
    assert len(out) == 64 and out[3.5, 3.5] is None
    assert out[1.0, 1.0] == pytest.approx(math.degrees(math.atan(math.sqrt(13))), abs=1e-4)


def test_flat_terrain_has_no_aspect(spark):
    d = plane(spark, f=lambda x, y: 5.0).select("y", "x", F.col("v").alias("z"))
    out = terrain.slope_aspect(d, "z").collect()
    assert all(r["slope"] == 0 and r["aspect"] is None for r in out)


# ------------------------------------------------------------------ scaling and anomalies

def test_anomalies_average_to_zero(spark):
    d = plane(spark, days=60)
    d = d.withColumn("v", F.col("v") + F.dayofmonth("time"))
    a = scale.anomalies(d, ["v"], by="month")
    worst = (a.groupBy(F.month("time"), "y", "x").agg(F.abs(F.avg("v")).alias("m"))
              .agg(F.max("m")).first()[0])
    assert worst < 1e-9


def test_minmax_within_unit_interval(spark):
    d = plane(spark)
    r = scale.minmax(d, ["v"]).agg(F.min("v"), F.max("v")).first()
    assert r[0] == 0.0 and r[1] == 1.0


def test_minmax_zero_range_is_missing(spark):
    d = plane(spark, f=lambda x, y: 3.0)
    assert scale.minmax(d, ["v"]).where(F.col("v").isNotNull()).count() == 0


def test_r2_zero_variance(spark):
    d = plane(spark, f=lambda x, y: 3.0).withColumn("p", F.lit(3.0))
    assert metrics.r2(d, "v", "p").first()["r2"] == 1.0
    d2 = d.withColumn("p", F.lit(4.0))
    assert metrics.r2(d2, "v", "p").first()["r2"] == 0.0


# ------------------------------------------------------------------ calendar

def test_day_366_encodes_like_day_1(spark):
    d = spark.createDataFrame([(dt.date(2016, 12, 31),), (dt.date(2017, 1, 1),)], "time date")
    s, c = X.doy_encoding("time")
    r = d.select(s.alias("s"), c.alias("c")).collect()
    assert r[0]["s"] == pytest.approx(r[1]["s"], abs=1e-6)
    assert r[0]["c"] == pytest.approx(r[1]["c"], abs=1e-6)


def test_seasons(spark):
    d = spark.createDataFrame([(dt.date(2020, m, 1),) for m in range(1, 13)], "time date")
    got = [r[0] for r in d.select(X.season("time")).collect()]
    assert got == ["DJF", "DJF", "MAM", "MAM", "MAM", "JJA", "JJA", "JJA", "SON", "SON", "SON", "DJF"]


# ------------------------------------------------------------------ axes, shift, align

def test_shift_is_over_the_dataset_axis(spark):
    # cell (0,1) lacks day 2: the shift still moves by dataset positions
    rows = [(dt.date(2020, 1, d), 0, 0, float(d)) for d in (1, 2, 3)] + \
           [(dt.date(2020, 1, d), 0, 1, float(10 + d)) for d in (1, 3)]
    df = spark.createDataFrame(rows, "time date, y int, x int, v double")
    out = {(r["time"].day, r["x"]): r["v"] for r in resample.shift(df, ["v"], -1).collect()}
    assert out == {(1, 0): 2.0, (2, 0): 3.0, (2, 1): 13.0, (3, 0): None, (3, 1): None}


def test_align_positional_takes_first_coordinates(spark):
    a = plane(spark, n=3)
    b = plane(spark, n=3).withColumns({"x": F.col("x") + 100, "y": F.col("y") * 2 + 50})
    out = joins.align_positional(a, b).select("time", "y", "x", "v")
    assert sorted(out.collect()) == sorted(a.collect())


def test_align_positional_rejects_size_mismatch(spark):
    with pytest.raises(ValueError):
        joins.align_positional(plane(spark, n=3), plane(spark, n=4))


def test_sel_labels_strict(spark):
    a = plane(spark, n=2, days=3)
    b = plane(spark, n=2, days=5)
    with pytest.raises(KeyError):
        joins.sel_labels(a, b)
    assert joins.sel_labels(b, a).count() == a.count()


def test_isel_negative_positions(spark):
    d = plane(spark, n=2, days=5)
    got = sorted({r["time"].day for r in axes.isel(d, "time", [0, -1]).collect()})
    assert got == [1, 5]


# ------------------------------------------------------------------ splits

def test_stratified_split_disjoint_complete_and_deterministic(spark):
    d = plane(spark, n=2, days=50).withColumn("v", F.col("v") + F.dayofmonth("time") % 3)
    a = split.stratified_days(d, "v", 4.0, 0.2, seed=7)
    b = split.stratified_days(d, "v", 4.0, 0.2, seed=7)
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.count() == 50 and a.select("time").distinct().count() == 50
    for r in a.groupBy("stratum").agg(F.count("*").alias("n"),
                                      F.sum((F.col("split") == "valid").cast("int")).alias("v")).collect():
        assert r["v"] == math.ceil(0.2 * r["n"])


def test_chronological_split(spark):
    d = plane(spark, n=2, days=10)
    lab = {r["time"].day: r["split"] for r in split.chronological_split(d, 0.2).collect()}
    assert [lab[i] for i in range(1, 11)] == ["train"] * 8 + ["test"] * 2


def test_sample_positions_raises_when_too_many(spark):
    with pytest.raises(ValueError):
        split.sample_positions(plane(spark, n=3), "x", 4)


# ------------------------------------------------------------------ tiles

def test_tiles_pad_and_divisibility(spark):
    d = plane(spark, n=5).select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")
    with pytest.raises(ValueError):
        grid.tiles(d, 2)
    t = grid.tiles(d, 2, pad=True, value="v", cval=-1.0)
    assert t.count() == 36
    assert t.where(F.col("v") == -1.0).count() == 11
    assert t.select("tile_id").distinct().count() == 9


def test_samples_have_tile_shape(spark):
    d = plane(spark, n=4, days=2).select("time", F.col("y").cast("int").alias("y"),
                                         F.col("x").cast("int").alias("x"), "v")
    s = grid.samples(d, ["v"], 2, target="v").collect()
    assert len(s) == 8
    for r in s:
        assert len(r["x_sample"]) == 1 and len(r["x_sample"][0]) == 2 and len(r["x_sample"][0][0]) == 2


def test_samples_have_every_pixel(spark):
    d = plane(spark, n=4).select("time", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")
    d = d.where((F.col("y") != 1) | (F.col("x") != 2))
    got = {r["tile_id"]: r["x_sample"][0] for r in grid.samples(d, ["v"], 2).collect()}
    assert got[0] == [[1.0, 3.0], [4.0, 6.0]] and got[1] == [[5.0, 7.0], [None, 10.0]]


def test_tile_samples_have_both_scalings(spark):
    from conftest import SF0001
    from gridspark.plans import catalog
    from gridspark.sources import fixtures
    grid_rows = {(r["time"], r["y"], r["x"]): r["p"] for r in fixtures.pair_daily(spark, SF0001).collect()}
    lo, hi = min(grid_rows.values()), max(grid_rows.values())
    seen = 0
    for r in catalog.q_tile_samples(spark, SF0001).collect():
        for at, (scaled, standard) in enumerate(zip(r["x_minmax"].split(","), r["x_sample"].split(","))):
            key = (r["time"], r["tile_id"] // 2 * 2 + at // 2, r["tile_id"] % 2 * 2 + at % 2)
            assert (scaled == "none") == (standard == "none") == (key not in grid_rows)
            if key in grid_rows:
                assert int(scaled) == pytest.approx(1000 * (grid_rows[key] - lo) / (hi - lo), abs=0.501)
                seen += 1
    assert seen == len(grid_rows)


def test_sample_set_has_planes_for_each_scaling(spark):
    d = plane(spark, n=4).select("time", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v", (-2 * F.col("v")).alias("w"))
    both = grid.sample_set(d, ["v", "w"], 2, target="v", scaling=["standard", "minmax"], anomalies=False).collect()
    for kind, at in (("standard", 0), ("minmax", 2)):
        one = grid.sample_set(d, ["v", "w"], 2, target="v", scaling=kind, anomalies=False).collect()
        assert {r["tile_id"]: (r["x_sample"], r["y_sample"]) for r in one} == {
            r["tile_id"]: (r["x_sample"][at:at + 2], r["y_sample"]) for r in both}
    flat = [v for r in both for line in r["x_sample"][2] for v in line]
    assert len(flat) == 16 and min(flat) == 0 and max(flat) == 1


def test_ranks_do_not_hang_on_the_buckets(spark):
    rows = [(dt.datetime(2020, 1, 1) + dt.timedelta(hours=h), 0, 0, float(h)) for h in range(0, 500, 3)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, y int, x int, v double")
    want = [(r[0], i) for i, r in enumerate(sorted(df.select("time").distinct().collect()))]
    for buckets in (1, 7, 1000):
        assert sorted(map(tuple, axes.axis_index(df, "time", buckets=buckets).collect())) == want
    assert axes.axis_index(df.where("v < 0"), "time").count() == 0
    labels = [-3.0, 0.0, 0.5, 2.0, 100.0]
    for buckets in (1, 3, 50):
        got = sorted(map(tuple, axes.neighbours(axis_df(spark, labels), "t", buckets).collect()))
        assert got == list(zip(labels, [None, *labels], [*labels[1:], None]))


def test_pivot_levels_skips_absent_levels(spark):
    rows = [(dt.date(2020, 1, 1), 0, 0, lv, float(lv)) for lv in (500, 850)]
    df = spark.createDataFrame(rows, "time date, y int, x int, level int, z double")
    out = grid.pivot_levels(df, ["z"], [500, 700, 850], skip_absent=True)
    assert out.columns == ["time", "y", "x", "z_500", "z_850"]
    kept = grid.pivot_levels(df, ["z"], [500, 700])
    assert kept.first()["z_700"] is None


def test_apply_weights_matches_separable_bilinear(spark):
    d = plane(spark, n=6)
    t = axis_df(spark, [0.5, 2.25, 4.75])
    wy = regrid.bilinear_axis_weights(regrid._labels(d, "y"), t).select(
        F.col("t").alias("ty"), F.col("s").alias("sy"), F.col("w").alias("wy"))
    wx = regrid.bilinear_axis_weights(regrid._labels(d, "x"), t).select(
        F.col("t").alias("tx"), F.col("s").alias("sx"), F.col("w").alias("wx"))
    # a user-supplied 2-D table (as for a curvilinear source): here the outer
    # product of the two small axis tables, built in the test itself
    rows = [(a["sy"], b["sx"], a["ty"], b["tx"], a["wy"] * b["wx"]) for a in wy.collect() for b in wx.collect()]
    w2 = spark.createDataFrame(rows, "sy double, sx double, ty double, tx double, w double")
    got = {(r["y"], r["x"]): r["v"] for r in regrid.apply_weights(d, ["v"], w2).collect()}
    ref = {(r["y"], r["x"]): r["v"] for r in regrid.bilinear(d, ["v"], t, t).collect()}
    assert got.keys() == ref.keys()
    for k in got:
        assert got[k] == pytest.approx(ref[k], abs=1e-9)
