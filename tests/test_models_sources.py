"""Model invariants (M1-M6), sources/sinks (S1-S12) and streaming."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF0001
from gridspark.functions import naming
from gridspark.operators import models, split
from gridspark.sources import files, sinks
from gridspark.streaming.daily import daily_stream


def cells(spark, n_cells=3, days=120, const=None):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(n_cells):
        for d in range(days):
            x1 = float(rng.normal())
            y = const if const is not None else 2 * x1 + c + float(rng.normal()) * 0.1
            rows.append((dt.date(2000, 1, 1) + dt.timedelta(days=d), 0.0, float(c), x1, y))
    df = spark.createDataFrame(rows, "time date, y double, x double, f1 double, t double")
    return split.period_split(df, ("2000-01-01", "2000-03-21"), ("2000-03-21", "2001-01-01"))


def test_constant_target_gives_constant_prediction(spark):
    out = models.fit_predict_pooled(cells(spark, const=4.0), ["f1"], "t", model="RandomForestRegressor", numTrees=3)
    assert {round(r["prediction"], 9) for r in out.collect()} == {4.0}


def test_every_valid_row_is_returned_and_fits_are_deterministic(spark):
    d = cells(spark).withColumn("f1", F.when((F.col("x") == 1.0) & (F.dayofyear("time") == 90), None).otherwise(F.col("f1")))
    a, b = (models.fit_predict_pooled(d, ["f1"], "t", maxIter=5).collect() for _ in range(2))
    assert len(a) == d.where(F.col("split") == "valid").count()
    assert sorted(a, key=str) == sorted(b, key=str)
    missing = [r for r in a if r["prediction"] is None]
    assert [(r["x"], r["time"].timetuple().tm_yday) for r in missing] == [(1.0, 90)]


def test_model_beats_the_mean(spark):
    d = cells(spark)
    out = models.fit_predict_pooled(d, ["f1"], "t", maxIter=20)
    err = out.agg(F.sqrt(F.avg((F.col("t") - F.col("prediction")) ** 2))).first()[0]
    base = d.where(F.col("split") == "valid").agg(F.stddev_pop("t")).first()[0]
    assert err < base


def test_search_and_best_trial(spark):
    d = cells(spark).drop("split")
    scores = models.search(d, ["f1"], "t", [{"maxIter": 1, "maxDepth": 1}, {"maxIter": 15, "maxDepth": 4}])
    assert scores.count() == 2
    assert split.best_trial(scores).first()["trial"] == 1


def test_predictor_names_are_checked(spark):
    with pytest.raises(ValueError):
        models.assemble_predictors(cells(spark), ["bogus"], [500], [], [])
    with pytest.raises(ValueError):
        naming.run_key(["bogus"])


# ------------------------------------------------------------------ naming

def test_run_key(spark):
    m = naming.run_matrix(spark, ["pr", "tasmean"], [0.0, 0.5], ["GBTRegressor"])
    names = ["geopotential", "temperature", "mean_sea_level_pressure", "total_precipitation"]
    keys = [r[0] for r in m.select(naming.run_key(names, [500, 850], dem=True, doy=True)).collect()]
    assert keys == ["GBTRegressor_pr_zt_500_850_mslppr_0mm_dem_doy", "GBTRegressor_pr_zt_500_850_mslppr_0.5mm_dem_doy"] + \
        ["GBTRegressor_tasmean_zt_500_850_mslppr_dem_doy"] * 2


def test_run_matrix(spark):
    m = naming.run_matrix(spark, ["tasmean", "pr"], [0.0], naming.MODELS)
    assert m.count() == 4
    assert m.where("stratify").select("predictand").distinct().collect()[0][0] == "pr"
    with pytest.raises(ValueError):
        naming.run_matrix(spark, ["bogus"], [0.0], naming.MODELS)


def test_short_names(spark):
    d = spark.createDataFrame([("geopotential",), ("2m_temperature",), ("bogus",)], "n string")
    assert [r[0] for r in d.select(naming.short_name("n")).collect()] == ["z", "t2m", None]


# ------------------------------------------------------------------ sources and sinks

def test_write_list_read_roundtrip(spark):
    from gridspark.sources import fixtures as fx
    out = tempfile.mkdtemp(prefix="gridspark-test-")
    d = fx.pair_daily(spark, SF0001)
    sinks.write_grid(d, os.path.join(out, "o"), partition_by=("year",))
    sinks.write_grid(d.limit(1), os.path.join(out, "o"), partition_by=("year",), if_exists="skip")
    back = files.read_files(spark, os.path.join(out, "o"), glob="*.parquet")
    assert back.count() == d.count()
    listed = files.list_files(spark, os.path.join(out, "o"), glob="*.parquet")
    assert listed.count() >= 1
    yr = files.year_range(listed.withColumn("file_name", F.regexp_extract("path", "year=([0-9]{4})", 1)))
    r = yr.first()
    assert r["first_year"] == 1995


def test_dry_run_groups_by_variable(spark):
    root = tempfile.mkdtemp(prefix="gridspark-test-")
    for var in ("t2m", "tp"):
        for y in (2001, 2002):
            p = os.path.join(root, var)
            os.makedirs(p, exist_ok=True)
            open(os.path.join(p, f"ERA5_{var}_{y}.parquet"), "wb").write(b"x")
    dr = files.dry_run(files.list_files(spark, root, glob="*.parquet", pattern="ERA5_.*"))
    got = {r["variable"]: (r["first_year"], r["last_year"], r["files"]) for r in dr.collect()}
    assert got == {"t2m": (2001, 2002, 2), "tp": (2001, 2002, 2)}


def test_a_broken_write_is_done_again(spark):
    out = tempfile.mkdtemp(prefix="gridspark-test-") + "/run"
    os.makedirs(f"{out}/_temporary")   # what a crashed run leaves
    d = spark.createDataFrame([(dt.date(2020, 1, 1), 0, 0, 1.0)], "time date, y int, x int, v double")
    assert not sinks.finished(spark, out)
    sinks.write_grid(d, out)
    assert sinks.finished(spark, out) and spark.read.parquet(out).count() == 1
    sinks.write_grid(d.unionByName(d), out)   # finished: left as it is
    assert spark.read.parquet(out).count() == 1


def test_stage_checkpoints(spark):
    d = spark.range(10).withColumn("v", F.col("id") * 2)
    assert sinks.staged(d).count() == 10


# ------------------------------------------------------------------ streaming

def test_daily_stream(spark):
    from gridspark.sources import fixtures as fx
    src = tempfile.mkdtemp(prefix="gridspark-src-")
    h = fx.hourly(spark, SF0001)
    h.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(h.schema).parquet(src)
    q = (daily_stream(stream, {"v": ("mean", "v")}).writeStream.format("memory").queryName("daily_out")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select count(*) from daily_out").first()[0]
    days = h.select(F.to_date("time")).distinct().count()
    # the last day stays open under the watermark
    assert 0 < got <= h.select(F.to_date("time"), "y", "x").distinct().count()
    assert days > 1


# ------------------------------------------------------------------ jobs C6, C7 and small helpers

def _grids(spark, days=400):
    rng = np.random.default_rng(5)
    pred, obs = [], []
    for y in range(2):
        for x in range(2):
            for d in range(days):
                t = dt.date(2000, 1, 1) + dt.timedelta(days=d)
                a = float(rng.normal())
                pred.append((t, float(y), float(x), a))
                obs.append((t, float(y), float(x), max(0.0, 2 * a + y + float(rng.normal()) * 0.2)))
    p = spark.createDataFrame(pred, "time date, y double, x double, a double")
    o = spark.createDataFrame(obs, "time date, y double, x double, pr double")
    return p, o


@pytest.mark.parametrize("mode", ["period", "stratified"])
def test_downscale_job(spark, mode):
    from gridspark.plans import jobs
    p, o = _grids(spark)
    out = jobs.downscale(p, o, "pr", ["a"], model="GBTRegressor", split_mode=mode,
                         calibration=("2000-01-01", "2000-11-01"), validation=("2000-11-01", "2001-03-01"),
                         wet_threshold=0.5, params={"maxIter": 5})
    rows = out.collect()
    assert rows and all(r["prediction"] is not None for r in rows)
    if mode == "period":
        assert {r["time"] >= dt.date(2000, 11, 1) for r in rows} == {True}


def test_tune_job(spark):
    from gridspark.plans import jobs
    p, o = _grids(spark, days=200)
    best = jobs.tune(p, o, "pr", ["a"], [{"maxIter": 1, "maxDepth": 1}, {"maxIter": 10}], n_per_axis=2).collect()
    assert len(best) == 1 and best[0]["trial"] == 1


def test_read_bands_and_keep_known_and_concat(spark):
    from gridspark.operators import grid, joins
    root = tempfile.mkdtemp(prefix="gridspark-test-")
    rows = [(b, y, x, float(b * 100 + y * 10 + x)) for b in (1, 2, 3) for y in range(2) for x in range(2)]
    spark.createDataFrame(rows, "band int, y int, x int, v double").write.parquet(os.path.join(root, "r"))
    got = files.read_bands(spark, os.path.join(root, "r"), bands=[2])
    assert got.count() == 4 and {r["band"] for r in got.collect()} == {2}
    kept = grid.keep_known(got.withColumn("junk", F.lit(1)), ["v"], ["band", "y", "x"])
    assert kept.columns == ["band", "y", "x", "v"]
    both = joins.concat_time([got, got.withColumn("extra", F.lit(1.0))])
    assert both.count() == 8 and "extra" in both.columns


def test_sweep_writes_one_folder_per_run(spark):
    from gridspark.plans import sweep
    p, o = _grids(spark, days=300)
    m = naming.run_matrix(spark, ["pr"], [0.5], ["GBTRegressor", "RandomForestRegressor"])
    out = tempfile.mkdtemp(prefix="gridspark-sweep-")
    keys = sweep.sweep(p, {"pr": o}, ["a"], m, out, predictor_names=["total_precipitation"],
                      calibration=("2000-01-01", "2000-08-01"), validation=("2000-08-01", "2001-01-01"),
                      params={"maxDepth": 3})
    assert keys == ["GBTRegressor_pr_pr_0.5mm_doy", "RandomForestRegressor_pr_pr_0.5mm_doy"]
    for k in keys:
        assert spark.read.parquet(os.path.join(out, k)).count() > 0
    # a second sweep finds the outputs and leaves them as they are
    assert sweep.sweep(p, {"pr": o}, ["a"], m, out, predictor_names=["total_precipitation"],
                      params={"maxDepth": 3}) == keys


def test_daily_stream_to_parquet(spark):
    from gridspark.sources import fixtures as fx
    from gridspark.streaming.daily import start_to_table
    src = tempfile.mkdtemp(prefix="gridspark-src-")
    out = tempfile.mkdtemp(prefix="gridspark-out-")
    ckpt = tempfile.mkdtemp(prefix="gridspark-ckpt-")
    h = fx.hourly(spark, SF0001)
    h.write.mode("overwrite").parquet(src)
    stream = spark.readStream.schema(h.schema).parquet(src)
    q = start_to_table(daily_stream(stream, {"v": ("max", "v")}), os.path.join(out, "daily"), ckpt)
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(out, "daily"))
    expect = {(r[0], r[1], r[2]): r[3] for r in
              h.groupBy(F.to_date("time"), "y", "x").agg(F.max("v")).collect()}
    rows = got.collect()
    assert rows, "closed days are written"
    for r in rows:
        assert r["v"] == pytest.approx(expect[(r["time"], r["y"], r["x"])])
