"""Queries of file sources and sinks (S4, S5, S9, S10), of run names (S11, J9), of the sorted scan (O1), of the density
with the data's own bandwidth (A29) and of a yearly job in two runs (C2 with S1, S9, S12). Files are written to the shared folder
from the given tables and discovered there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import naming
from ..operators import joins, metrics, split
from ..session import checkpoint_dir
from ..sources import files, sinks
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures
from . import incremental, jobs
from .catalog import _shift_sql, register


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("read_bands", with_fixtures("select time, level as band, y, x, v from levels where level in (2, 5, 7)", "levels"), ("v",))
def q_read_bands(spark, sf):
    """A raster of seven bands, of which three are read."""
    path = _folder(spark, "raster")
    fx.levels(spark, sf).withColumnRenamed("level", "band").write.partitionBy("band").parquet(path)
    return files.read_bands(spark, path, [2, 5, 7]).select("time", F.col("band").cast("int").alias("band"), "y", "x", "v")


@register("files_by_year", with_fixtures("""select cast(min(year(time)) as int) as first_year, cast(max(year(time)) as int) as last_year,
    count(distinct year(time)) as years from pair_daily""", "pair_daily"))
def q_files_by_year(spark, sf):
    """The years found in the names of the folders of a written grid; no file is read."""
    path = _folder(spark, "grid")
    sinks.write_grid(fx.pair_daily(spark, sf), path, if_exists="error")
    listed = files.list_files(spark, path, "*.parquet")
    named = listed.withColumn("file_name", F.element_at(F.split("path", "/"), -2))
    ends = files.year_range(named)
    return ends.select("first_year", "last_year", named.agg(F.count_distinct("file_name").alias("n")).scalar().alias("years"))


@register("written_once", with_fixtures("select time, y, x, o from pair_daily", "pair_daily"), ("o",))
def q_written_once(spark, sf):
    """A finished target is left as it is, whatever a second write brings."""
    path, d = _folder(spark, "once"), fx.pair_daily(spark, sf).select("time", "y", "x", "o")
    sinks.write_grid(d, path, if_exists="skip")
    sinks.write_grid(d.withColumn("o", F.lit(-1.0)), path, if_exists="skip")
    return spark.read.parquet(path).drop("year")


@register("run_names", """with m as (select p_partkey, case p_partkey % 2 when 0 then 'pr' else 'tas' end as predictand,
      case p_size % 3 when 0 then 0.5 when 1 then 1.0 else 2.5 end as t, case p_partkey % 3 when 0 then 'AdaBoostRegressor' else 'LGBMRegressor' end as model from part)
    select p_partkey, model || '_' || predictand || '_zt_500_850_mslp' ||
      case when predictand = 'pr' then '_' || case t when 1.0 then '1' else cast(cast(t as double) as varchar) end || 'mm' else '' end || '_dem_doy' as run_key
    from m""")
def q_run_names(spark, sf):
    """The key of a run for each part (runs dealt to the parts)."""
    key, size = F.col("p_partkey"), F.col("p_size")
    runs = spark.read.parquet(f"{sf.rstrip('/')}/part.parquet").select(
        "p_partkey", F.when(key % 2 == 0, "pr").otherwise("tas").alias("predictand"),
        F.when(size % 3 == 0, 0.5).when(size % 3 == 1, 1.0).otherwise(2.5).alias("wet_day_threshold"),
        F.when(key % 3 == 0, "AdaBoostRegressor").otherwise("LGBMRegressor").alias("model"), (key % 2 == 0).alias("stratify"))
    name = naming.run_key(["geopotential", "temperature", "mean_sea_level_pressure"], [500, 850], dem=True, doy=True)
    return runs.select("p_partkey", name.alias("run_key"))


@register("chronological", with_fixtures(
    "select time, y, x, o, p from pair_daily union all select cast(time as date), y, x, v, v from hourly", "pair_daily", "hourly"), ("o", "p"))
def q_chronological(spark, sf):
    """O1: two datasets, one after the other, then in order of time."""
    h = fx.hourly(spark, sf).select(F.col("time").cast("date").alias("time"), "y", "x", F.col("v").alias("o"), F.col("v").alias("p"))
    return split.chronological(joins.concat_time([h, fx.pair_daily(spark, sf)]))


@register("bias_kde_data", with_fixtures("""with b as (select p - o as b from pair_daily),
    s as (select stddev_samp(b) * power(count(b), -0.2e0) as h, min(b) as lo, max(b) as hi from b),
    g as (select cast(unnest(range(0, 60)) as double) as k),
    pts as (select lo + k * ((hi - lo) / 59) as x, h from s, g)
    select x, avg(exp(-0.5e0 * ((x - b) / h) * ((x - b) / h))) / (h * sqrt(2 * pi())) as density from pts, b group by x, h""", "pair_daily"), ("x", "density"))
def q_bias_kde_data(spark, sf):
    """The density curve over the range of the data, with their own bandwidth."""
    d = fx.pair_daily(spark, sf).select((F.col("p") - F.col("o")).alias("b"))
    return metrics.kde(d, "b", points=60)


@register("job_yearly_incremental", with_fixtures(
    f"""with src as (select time, y, x, case when year(time) = (select max(year(time)) from hourly) then 2 * v else v end as v from hourly),
    {_shift_sql('src', -6, 'v')},
    d as (select cast(time as date) as time, y, x, avg(v) as v from s group by 1, 2, 3)
    select * from d where time < (select max(time) from d)""", "hourly"), ("v",))
def q_job_yearly_incremental(spark, sf):
    """C2 in two runs: all years, then, when the files of the last year have changed, what depends on it."""
    root, h = _folder(spark, "years"), fx.hourly(spark, sf).withColumn("year", F.year("time"))
    job = incremental.YearlyJob(f"{root}/in", f"{root}/out", lambda d: jobs.shifted_daily_predictor(d.select("time", "y", "x", "v"), "v"),
                                glob="*.parquet", year_part=-2, reach=1)
    h.write.partitionBy("year").parquet(job.root)
    incremental.run(spark, job)
    last = F.col("year") == h.select(F.max("year")).scalar()
    (h.where(last).withColumn("v", 2 * F.col("v")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year").parquet(job.root))
    incremental.run(spark, job)
    return spark.read.parquet(job.target).select("time", "y", "x", "v")
