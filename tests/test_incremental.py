"""Yearly jobs that redo only what changed, staging that ends, and sweeps that go on after a crash."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from gridspark.operators import resample
from gridspark.plans import incremental, jobs, sweep
from gridspark.session import checkpoint_dir, staging_scope, written

HOUR = dt.timedelta(hours=1)


def put_year(spark, root, year, factor=1.0, days=4):
    """Hourly rows of the last two and the first two days of a year, in a folder of that name."""
    rows = []
    for day in (dt.datetime(year, 1, 1), dt.datetime(year, 12, 32 - days // 2)):
        rows += [(day + k * HOUR, 0, x, factor * (day.day + k / 100 + x)) for k in range(24 * (days // 2)) for x in range(2)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, y int, x int, v double")
    df.coalesce(1).write.mode("overwrite").parquet(f"{root}/v_{year}")


@pytest.fixture()
def job(spark):
    root = tempfile.mkdtemp(prefix="gridspark-years-")
    for year in (2001, 2002, 2003):
        put_year(spark, f"{root}/in", year)
    return incremental.YearlyJob(f"{root}/in", f"{root}/out", lambda d: jobs.shifted_daily_predictor(d, "v"), glob="*.parquet", year_part=-2, reach=1)


def stamps(job):
    return {y: sorted(os.listdir(f"{job.target}/{y}")) for y in sorted(os.listdir(job.target)) if y.startswith("year=")}


def content(df):
    return sorted((str(r.time), r.y, r.x, None if r.v is None else round(r.v, 9)) for r in df.select("time", "y", "x", "v").collect())


def whole(spark, job, years):
    """What one job over all files gives."""
    return content(job.build(spark.read.parquet(*[f"{job.root}/v_{y}" for y in years])))


def test_only_changed_years_are_rewritten(spark, job):
    assert {(r.year, r.action) for r in incremental.plan(spark, job).collect()} == {(y, "write") for y in (2001, 2002, 2003)}
    assert not os.path.exists(job.target), "a dry run writes nothing"
    assert incremental.run(spark, job) == [(y, "write") for y in (2001, 2002, 2003)]
    assert content(spark.read.parquet(job.target)) == whole(spark, job, (2001, 2002, 2003))
    first = stamps(job)

    assert incremental.run(spark, job) == [(y, "keep") for y in (2001, 2002, 2003)] and stamps(job) == first

    put_year(spark, job.root, 2003, factor=2.0)
    assert incremental.run(spark, job) == [(2001, "keep"), (2002, "write"), (2003, "write")]
    second = stamps(job)
    assert second["year=2001"] == first["year=2001"] and second["year=2002"] != first["year=2002"] and second["year=2003"] != first["year=2003"]
    assert content(spark.read.parquet(job.target)) == whole(spark, job, (2001, 2002, 2003))

    put_year(spark, job.root, 2004)
    assert incremental.run(spark, job)[2:] == [(2003, "write"), (2004, "write")]
    assert content(spark.read.parquet(job.target)) == whole(spark, job, (2001, 2002, 2003, 2004))


def test_a_year_that_is_gone_goes(spark, job):
    incremental.run(spark, job)
    os.rename(f"{job.root}/v_2003", f"{job.root}/../v_2003.away")
    assert incremental.run(spark, job) == [(2001, "keep"), (2002, "write"), (2003, "drop")]
    assert sorted(stamps(job)) == ["year=2001", "year=2002"]
    assert content(spark.read.parquet(job.target)) == whole(spark, job, (2001, 2002))


def test_a_broken_run_is_redone_and_leaves_nothing(spark, job):
    incremental.run(spark, job)
    before, staged = stamps(job), set(os.listdir(checkpoint_dir(spark)))
    put_year(spark, job.root, 2002, factor=3.0)
    good, job.build = job.build, lambda d: d.withColumn("v", F.raise_error(F.lit("broken")).cast("double"))
    with pytest.raises(Exception, match="broken"):
        incremental.run(spark, job)
    assert stamps(job) == before and set(os.listdir(checkpoint_dir(spark))) == staged
    job.build = good
    assert incremental.run(spark, job) == [(2001, "write"), (2002, "write"), (2003, "keep")]
    assert set(os.listdir(checkpoint_dir(spark))) == staged, "staged tables are dropped"
    assert content(spark.read.parquet(job.target)) == whole(spark, job, (2001, 2002, 2003))


def test_jobs_without_a_look_ahead(spark, job):
    job.build, job.reach = lambda d: resample.to_daily(d, {"v": ("mean", "v")}), 0
    incremental.run(spark, job)
    put_year(spark, job.root, 2003, factor=2.0)
    assert incremental.run(spark, job) == [(2001, "keep"), (2002, "keep"), (2003, "write")]
    assert content(spark.read.parquet(job.target)) == whole(spark, job, (2001, 2002, 2003))


def test_staging_scope(spark):
    folder = checkpoint_dir(spark)
    before = set(os.listdir(folder))
    outer = written(spark.range(3), "outer")
    with staging_scope(spark):
        inner = written(spark.range(5), "inner")
        with staging_scope(spark):
            written(spark.range(2), "innermost")
        assert inner.count() == 5 and len(set(os.listdir(folder)) - before) == 2
    assert outer.count() == 3 and {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"outer"}
    with pytest.raises(ValueError):
        with staging_scope(spark):
            written(spark.range(5), "inner")
            raise ValueError
    assert {x.split("-")[0] for x in set(os.listdir(folder)) - before} == {"outer"}


def test_sweep_goes_on_where_it_broke(spark):
    out, calls = tempfile.mkdtemp(prefix="gridspark-runs-"), []

    def result(key, fail=False):
        calls.append(key)
        d = written(spark.range(4).select(F.make_date(F.lit(2000), F.lit(1), F.col("id").cast("int") + 1).alias("time"), F.lit(0).alias("y"), F.col("id").alias("x")), "part")
        return d.withColumn("x", F.raise_error(F.lit("no luck")).cast("long")) if fail else d

    staged = set(os.listdir(checkpoint_dir(spark)))
    runs = {k: (lambda k=k: result(k, fail=k == "b")) for k in "abc"}
    got = {r.run_key: (r.state, r.detail) for r in sweep.run_all(runs, spark, out).collect()}
    assert got["a"][0] == got["c"][0] == "done" and got["b"][0] == "failed" and "no luck" in got["b"][1]
    assert spark.read.parquet(f"{out}/a").count() == spark.read.parquet(f"{out}/c").count() == 4
    sweep.record(spark, out, "d", "crashed", "started")   # a driver that died after this

    calls.clear()
    runs = {k: (lambda k=k: result(k)) for k in "abcd"}
    got = {r.run_key: r.state for r in sweep.run_all(runs, spark, out, workers=3).collect()}
    assert sorted(calls) == ["b", "d"] and got == {k: "done" for k in "abcd"}
    assert spark.read.parquet(f"{out}/b").count() == 4
    states = [(r.run_key, r.state) for r in sweep.history(spark, out).orderBy("at").collect()]
    assert states.count(("b", "started")) == 2 and states.count(("a", "started")) == 1
    assert set(os.listdir(checkpoint_dir(spark))) == staged, "each run drops what it staged"
