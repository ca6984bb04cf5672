"""Registered queries: one Spark query per operator plus its ANSI oracle.

Each entry maps a name to ``(build(spark, sf_dir) -> DataFrame, sql | None,
rounded_columns)``. Double results are rounded to 4 decimals on both sides
(``round(v + 1e-9, 4)``) so engines that sum in a different order agree.
Every query reads the driver tables through the fixture builders, so its
work grows with the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as X
from ..operators import axes, grid, joins, metrics, regrid, resample, scale
from ..session import written
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures

Build = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Build, str | None, tuple[str, ...]]] = {}


def register(name: str, sql: str | None, rnd: tuple[str, ...] = ()):
    def deco(fn: Build) -> Build:
        REGISTRY[name] = (fn, sql, rnd)
        return fn
    return deco


def wrap_sql(sql: str, rnd: tuple[str, ...]) -> str:
    if not rnd:
        return sql
    rep = ", ".join(f"round({c} + 1e-9, 4) + 0.0 as {c}" for c in rnd)
    return f"select * replace ({rep}) from ({sql}) as q"


def spark_queries() -> dict[str, Build]:
    def finish(fn: Build) -> Build:
        return lambda spark, sf_dir: X.round_doubles(fn(spark, sf_dir))
    return {k: finish(fn) for k, (fn, _, _) in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    return {k: wrap_sql(sql, rnd) for k, (_, sql, rnd) in REGISTRY.items() if sql is not None}


def on_fixture(name: str, fixture: str, build: Build) -> None:
    """Register the query ``name`` again over another fixture with the columns
    of ``pair_daily``."""
    sql, rnd = REGISTRY[name][1:]
    suffix = fixture.rsplit("_", 1)[-1]
    REGISTRY[f"{name}_{suffix}"] = (build, sql.replace(fx.PAIR_DAILY_SQL, fx.FIXTURE_SQL[fixture]), rnd)


# ------------------------------------------------------------------ SQL bits

def r2_sql(o: str, p: str) -> str:
    ss_res = f"sum(({o} - {p}) * ({o} - {p}))"
    ss_tot = f"(var_pop({o}) * count({o}))"
    return (f"case when count({o}) = 0 then null when {ss_tot} = 0 then "
            f"(case when {ss_res} = 0 then 1.0 else 0.0 end) else 1 - {ss_res} / {ss_tot} end")


SEASON_SQL = ("case cast(floor((month(time) % 12) / 3) as int) when 0 then 'DJF' when 1 then 'MAM' "
              "when 2 then 'JJA' else 'SON' end")


def guarded(fn: str, v: str) -> str:
    return f"case when count({v}) = count(*) then {fn}({v}) end"


MONTHLY_SQL = f"""select last_day(time) as time, y, x, {guarded('sum', 'o')} as o, {guarded('sum', 'p')} as p
from pair_daily group by 1, 2, 3"""

YEARLY_SQL = """select cast(year(time) as int) as year, y, x, avg(o) as o, avg(p) as p
from pair_daily group by 1, 2, 3"""

ANOM_SQL = """select d.time, d.y, d.x, d.o - s.mo as o, d.p - s.mp as p
from pair_daily d join (select cast(month(time) as int) as month, y, x, avg(o) as mo, avg(p) as mp
                        from pair_daily group by 1, 2, 3) s
  on cast(month(d.time) as int) = s.month and d.y = s.y and d.x = s.x"""

WET = 25.0


def _pd(spark, sf):
    return fx.pair_daily(spark, sf)


# ------------------------------------------------------------------ fixtures / scans

@register("fixture_pair_daily", with_fixtures("select * from pair_daily", "pair_daily"), ("o", "p"))
def q_fixture_pair_daily(spark, sf):
    return _pd(spark, sf)


@register("fixture_hourly", with_fixtures("select * from hourly", "hourly"), ("v",))
def q_fixture_hourly(spark, sf):
    return fx.hourly(spark, sf)


@register("fixture_elevation", with_fixtures("select * from elevation", "elevation"), ("z",))
def q_fixture_elevation(spark, sf):
    return fx.elevation(spark, sf)


@register("fixture_levels", with_fixtures("select * from levels", "levels"), ("v",))
def q_fixture_levels(spark, sf):
    return fx.levels(spark, sf)


# ------------------------------------------------------------------ daily resampling (A1-A4, C4)

@register("daily_mean", with_fixtures(
    "select cast(time as date) as time, y, x, avg(v) as v from hourly group by 1, 2, 3", "hourly"), ("v",))
def q_daily_mean(spark, sf):
    return resample.to_daily(fx.hourly(spark, sf), {"v": ("mean", "v")})


@register("daily_sum_mm", with_fixtures(
    "select cast(time as date) as time, y, x, coalesce(sum(v), 0) * 1000 as v from hourly group by 1, 2, 3",
    "hourly"), ("v",))
def q_daily_sum_mm(spark, sf):
    return resample.to_daily(fx.hourly(spark, sf), {"v": ("sum", "v")}, scale={"v": 1000.0})


@register("daily_mean_max_min", with_fixtures(
    "select cast(time as date) as time, y, x, avg(v) as v_mean, max(v) as v_max, min(v) as v_min "
    "from hourly group by 1, 2, 3", "hourly"), ("v_mean", "v_max", "v_min"))
def q_daily_stats(spark, sf):
    return resample.to_daily(fx.hourly(spark, sf), {"v_mean": ("mean", "v"), "v_max": ("max", "v"),
                                                    "v_min": ("min", "v")})


@register("daily_first", with_fixtures(
    "select cast(time as date) as time, y, x, arg_min(v, case when v is not null then time end) as v "
    "from hourly group by 1, 2, 3", "hourly"), ("v",))
def q_daily_first(spark, sf):
    return resample.to_daily(fx.hourly(spark, sf), {"v": ("first", "v")})


# ------------------------------------------------------------------ calendar aggregates

@register("monthly_sum", with_fixtures(MONTHLY_SQL, "pair_daily"), ("o", "p"))
def q_monthly_sum(spark, sf):
    return resample.monthly(_pd(spark, sf), ["o", "p"])


@register("month_climatology", with_fixtures(
    "select cast(month(time) as int) as month, y, x, avg(o) as o, avg(p) as p from pair_daily group by 1, 2, 3",
    "pair_daily"), ("o", "p"))
def q_month_climatology(spark, sf):
    return resample.climatology(_pd(spark, sf), ["o", "p"], by="month")


@register("annual_cycle_pooled", with_fixtures(
    f"with m as ({MONTHLY_SQL}) select cast(month(time) as int) as month, avg(o) as o, avg(p) as p "
    "from m group by 1", "pair_daily"), ("o", "p"))
def q_annual_cycle_pooled(spark, sf):
    return resample.pooled_cycle(resample.monthly(_pd(spark, sf), ["o", "p"]), ["o", "p"], by="month")


@register("annual_cycle_cells", with_fixtures(
    "with c as (select cast(month(time) as int) as month, y, x, avg(o) as o, avg(p) as p "
    "from pair_daily group by 1, 2, 3) select month, avg(o) as o, avg(p) as p from c group by 1",
    "pair_daily"), ("o", "p"))
def q_annual_cycle_cells(spark, sf):
    clim = resample.climatology(_pd(spark, sf), ["o", "p"], by="month")
    return resample.mean_over(clim, ["o", "p"], keep=["month"])


@register("yearly_mean", with_fixtures(YEARLY_SQL, "pair_daily"), ("o", "p"))
def q_yearly_mean(spark, sf):
    return resample.climatology(_pd(spark, sf), ["o", "p"], by="year")


@register("seasonal_mean", with_fixtures(
    f"select {SEASON_SQL} as season, y, x, avg(o) as o, avg(p) as p from pair_daily group by 1, 2, 3",
    "pair_daily"), ("o", "p"))
def q_seasonal_mean(spark, sf):
    return resample.climatology(_pd(spark, sf), ["o", "p"], by="season")


@register("spatial_mean", with_fixtures(
    "select time, avg(o) as o, avg(p) as p from pair_daily group by 1", "pair_daily"), ("o", "p"))
def q_spatial_mean(spark, sf):
    return resample.mean_over(_pd(spark, sf), ["o", "p"], keep=["time"])


@register("mean_of_yearly", with_fixtures(
    f"with yr as ({YEARLY_SQL}) select y, x, avg(o) as o, avg(p) as p from yr group by 1, 2",
    "pair_daily"), ("o", "p"))
def q_mean_of_yearly(spark, sf):
    yr = resample.climatology(_pd(spark, sf), ["o", "p"], by="year")
    return resample.mean_over(yr, ["o", "p"], keep=["y", "x"])


# ------------------------------------------------------------------ wet days

@register("wet_flag", with_fixtures(
    f"select time, y, x, case when o is not null then cast(o >= {WET} as double) end as wo from pair_daily",
    "pair_daily"), ("wo",))
def q_wet_flag(spark, sf):
    return _pd(spark, sf).select("time", "y", "x", X.wet_flag("o", WET).alias("wo"))


_WD = f"""select time, y, x,
  case when o is not null and p is not null then cast(o >= {WET} as double) end as wo,
  case when o is not null and p is not null then cast(p >= {WET} as double) end as wp, o, p
from pair_daily"""


@register("wet_days", with_fixtures(
    f"""with w as ({_WD}) select y, x, {guarded('sum', 'wo')} as n_wet_obs, {guarded('sum', 'wp')} as n_wet_pred,
    {guarded('sum', 'wo')} / count(*) * 100 as f_wet_obs, {guarded('sum', 'wp')} / count(*) * 100 as f_wet_pred
    from w group by 1, 2""", "pair_daily"), ("n_wet_obs", "n_wet_pred", "f_wet_obs", "f_wet_pred"))
def q_wet_days(spark, sf):
    return metrics.wet_days(_pd(spark, sf), "o", "p", WET)


@register("wet_freq_season", with_fixtures(
    f"""with w as ({_WD}) select {SEASON_SQL} as season, y, x,
    {guarded('sum', 'wo')} / count(*) * 100 as f_wet_obs, {guarded('sum', 'wp')} / count(*) * 100 as f_wet_pred
    from w group by 1, 2, 3""", "pair_daily"), ("f_wet_obs", "f_wet_pred"))
def q_wet_freq_season(spark, sf):
    return metrics.wet_frequency_by(_pd(spark, sf), "o", "p", WET, by="season")


@register("wet_intensity", with_fixtures(
    f"""with w as ({_WD}), s as (select y, x,
      case when {guarded('sum', 'wo')} = 0 then null else {guarded('sum', 'o * wo')} / {guarded('sum', 'wo')} end as sdii_obs,
      case when {guarded('sum', 'wp')} = 0 then null else {guarded('sum', 'p * wp')} / {guarded('sum', 'wp')} end as sdii_pred
    from w group by 1, 2)
    select *, case when sdii_obs = 0 then null else (sdii_pred - sdii_obs) / sdii_obs end * 100 as rel_bias from s""",
    "pair_daily"), ("sdii_obs", "sdii_pred", "rel_bias"))
def q_wet_intensity(spark, sf):
    return metrics.wet_intensity(_pd(spark, sf), "o", "p", WET)


# ------------------------------------------------------------------ extremes

@register("extreme_year", with_fixtures(
    "select cast(year(time) as int) as year, y, x, quantile_cont(o, 0.98) as o, quantile_cont(p, 0.98) as p "
    "from pair_daily group by 1, 2, 3", "pair_daily"), ("o", "p"))
def q_extreme_year(spark, sf):
    return metrics.extreme_quantile(_pd(spark, sf), ["o", "p"], 0.98, by="year")


@register("extreme_season", with_fixtures(
    f"select {SEASON_SQL} as season, y, x, quantile_cont(o, 0.02) as o, quantile_cont(p, 0.02) as p "
    "from pair_daily group by 1, 2, 3", "pair_daily"), ("o", "p"))
def q_extreme_season(spark, sf):
    return metrics.extreme_quantile(_pd(spark, sf), ["o", "p"], 0.02, by="season")


# ------------------------------------------------------------------ skill scores

@register("r2_pooled", with_fixtures(
    f"select count(*) as n, {r2_sql('o', 'p')} as r2 from pair_daily where o is not null and p is not null",
    "pair_daily"), ("r2",))
def q_r2_pooled(spark, sf):
    return metrics.r2(_pd(spark, sf), "o", "p")


R2_MONTHLY_CELLS_SQL = with_fixtures(
    f"with m as ({MONTHLY_SQL}) select y, x, count(*) as n, {r2_sql('o', 'p')} as r2 "
    "from m where o is not null and p is not null group by y, x", "pair_daily")


def r2_monthly_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: R² of monthly sums per cell (A5 -> A19)."""
    m = resample.monthly(_pd(spark, sf), ["o", "p"])
    return metrics.r2(m, "o", "p", by=["y", "x"])


register("r2_monthly_cells", R2_MONTHLY_CELLS_SQL, ("r2",))(r2_monthly_cells)


@register("r2_cells", with_fixtures(
    f"""with m as ({MONTHLY_SQL}), a as ({ANOM_SQL})
    select 'monthly' as metric, y, x, count(*) as n, {r2_sql('o', 'p')} as r2 from m
      where o is not null and p is not null group by y, x
    union all
    select 'anomaly' as metric, y, x, count(*) as n, {r2_sql('o', 'p')} as r2 from a
      where o is not null and p is not null group by y, x""", "pair_daily"), ("r2",))
def q_r2_cells(spark, sf):
    pdly = _pd(spark, sf)
    m = metrics.r2(resample.monthly(pdly, ["o", "p"]), "o", "p", by=["y", "x"])
    a = metrics.r2(scale.anomalies(pdly, ["o", "p"], by="month"), "o", "p", by=["y", "x"])
    return (m.select(F.lit("monthly").alias("metric"), "*")
             .unionByName(a.select(F.lit("anomaly").alias("metric"), "*")))


@register("r2_mean", with_fixtures(
    f"with m as ({MONTHLY_SQL}), c as (select y, x, {r2_sql('o', 'p')} as r2 from m "
    "where o is not null and p is not null group by y, x) select avg(r2) as r2_mean from c", "pair_daily"),
    ("r2_mean",))
def q_r2_mean(spark, sf):
    return r2_monthly_cells(spark, sf).agg(F.avg("r2").alias("r2_mean"))


@register("skill_daily", with_fixtures(
    f"""select count(*) as n, {r2_sql('o', 'p')} as r2, avg(p - o) as bias, avg(abs(p - o)) as mae,
    sqrt(avg((p - o) * (p - o))) as rmse, corr(p, o) as corr
    from pair_daily where o is not null and p is not null""", "pair_daily"),
    ("r2", "bias", "mae", "rmse", "corr"))
def q_skill_daily(spark, sf):
    return metrics.skill(_pd(spark, sf), "o", "p")


@register("bias_yearly", with_fixtures(
    f"""with yr as ({YEARLY_SQL}) select year, y, x, p - o as bias,
    case when o = 0 then null else (p - o) / o end * 100 as rel_bias from yr""", "pair_daily"),
    ("bias", "rel_bias"))
def q_bias_yearly(spark, sf):
    yr = resample.climatology(_pd(spark, sf), ["o", "p"], by="year")
    return yr.select("year", "y", "x", metrics.bias(yr, "o", "p").alias("bias"),
                     metrics.bias(yr, "o", "p", relative=True).alias("rel_bias"))


@register("skill_yearly", with_fixtures(
    f"""with yr as ({YEARLY_SQL}) select avg(p - o) as bias,
    avg(case when o = 0 then null else (p - o) / o end * 100) as rel_bias,
    avg(abs(p - o)) as mae, sqrt(avg((p - o) * (p - o))) as rmse, corr(p, o) as corr from yr
    where o is not null and p is not null""", "pair_daily"), ("bias", "rel_bias", "mae", "rmse", "corr"))
def q_skill_yearly(spark, sf):
    yr = metrics.valid_pairs(resample.climatology(_pd(spark, sf), ["o", "p"], by="year"), "o", "p")
    return yr.agg(F.avg(metrics.bias(yr, "o", "p")).alias("bias"),
                  F.avg(metrics.bias(yr, "o", "p", relative=True)).alias("rel_bias"),
                  F.avg(F.abs(F.col("p") - F.col("o"))).alias("mae"),
                  F.sqrt(F.avg((F.col("p") - F.col("o")) ** 2)).alias("rmse"),
                  F.corr("p", "o").alias("corr"))


@register("corr_yearly", with_fixtures(
    f"""with yr as ({YEARLY_SQL}) select year, corr(p, o) as corr from yr
    where o is not null and p is not null group by year""", "pair_daily"), ("corr",))
def q_corr_yearly(spark, sf):
    yr = metrics.valid_pairs(resample.climatology(_pd(spark, sf), ["o", "p"], by="year"), "o", "p")
    return yr.groupBy("year").agg(F.corr("p", "o").alias("corr"))


@register("corr_summary", with_fixtures(
    f"""with yr as ({YEARLY_SQL}), v as (select * from yr where o is not null and p is not null),
    c as (select year, corr(p, o) as corr from v group by year)
    select (select avg(corr) from c) as corr_mean_of_years, (select corr(p, o) from v) as corr_pooled""",
    "pair_daily"), ("corr_mean_of_years", "corr_pooled"))
def q_corr_summary(spark, sf):
    yr = metrics.valid_pairs(resample.climatology(_pd(spark, sf), ["o", "p"], by="year"), "o", "p")
    per = yr.groupBy("year").agg(F.corr("p", "o").alias("corr"))
    pooled = yr.agg(F.corr("p", "o").alias("corr_pooled"))
    return per.agg(F.avg("corr").alias("corr_mean_of_years")).select(
        "corr_mean_of_years", pooled.select("corr_pooled").scalar().alias("corr_pooled"))


@register("map_summary", with_fixtures(
    f"""with yr as ({YEARLY_SQL}), b as (select y, x, avg(case when o = 0 then null else (p - o) / o end * 100)
    as rel_bias from yr group by 1, 2)
    select median(rel_bias) as median, min(rel_bias) as min, max(rel_bias) as max, avg(rel_bias) as mean
    from b""", "pair_daily"), ("median", "min", "max", "mean"))
def q_map_summary(spark, sf):
    yr = resample.climatology(_pd(spark, sf), ["o", "p"], by="year")
    b = yr.select("y", "x", metrics.bias(yr, "o", "p", relative=True).alias("rel_bias"))
    return metrics.map_summary(resample.mean_over(b, ["rel_bias"], keep=["y", "x"]), "rel_bias")


@register("year_range", with_fixtures(
    "select cast(min(year(time)) as int) as start_year, cast(max(year(time)) as int) as end_year from pair_daily",
    "pair_daily"))
def q_year_range(spark, sf):
    return metrics.year_range(_pd(spark, sf))


@register("global_stats", with_fixtures(
    """select 'o' as variable, min(o) as min, max(o) as max, avg(o) as mean, stddev_samp(o) as std,
    stddev_pop(o) as std_pop from pair_daily
    union all select 'p', min(p), max(p), avg(p), stddev_samp(p), stddev_pop(p) from pair_daily""",
    "pair_daily"), ("min", "max", "mean", "std", "std_pop"))
def q_global_stats(spark, sf):
    return metrics.global_stats(_pd(spark, sf), ["o", "p"])


# bins whose edges no 3-decimal value can hit
_LO, _HI, _NB = -10.00005, 10.00005, 20


@register("bias_histogram", with_fixtures(
    f"""with b as (select round(p - o + 1e-9, 3) as d from pair_daily where o is not null and p is not null)
    select cast(case when d < {_LO} then 0 when d >= {_HI} then {_NB + 1}
           else floor((d - ({_LO})) / {_HI - _LO} * {_NB}) + 1 end as bigint) as bin, count(*) as n
    from b group by 1""", "pair_daily"))
def q_bias_histogram(spark, sf):
    d = _pd(spark, sf)
    b = metrics.valid_pairs(d, "o", "p").select(F.round(F.col("p") - F.col("o") + F.lit(1e-9), 3).alias("d"))
    return metrics.histogram(b, "d", _LO, _HI, _NB)


_KDE_PTS, _KDE_BW = 41, 0.5


@register("bias_kde", with_fixtures(
    f"""with b as (select p - o as d from pair_daily where o is not null and p is not null),
    e as (select d, {_LO} + k * {(_HI - _LO) / (_KDE_PTS - 1)} as x from b, range(0, {_KDE_PTS}) t(k))
    select x, avg(exp(-0.5 * power((x - d) / {_KDE_BW}, 2))) * {1.0 / (_KDE_BW * (2.0 * 3.141592653589793) ** 0.5)} as density
    from e group by x""", "pair_daily"), ("x", "density"))
def q_bias_kde(spark, sf):
    d = metrics.valid_pairs(_pd(spark, sf), "o", "p").select((F.col("p") - F.col("o")).alias("d"))
    return metrics.kde(d, "d", _LO, _HI, _KDE_PTS, _KDE_BW)


_CLO, _CHI, _CN = -30.00005, 30.00005, 12


@register("map_classes", with_fixtures(
    f"""with yr as ({YEARLY_SQL}), b as (select y, x, round(avg(case when o = 0 then null else (p - o) / o end * 100) + 1e-9, 3)
    as rb from yr group by 1, 2)
    select cast(case when rb < {_CLO} then 0 when rb >= {_CHI} then {_CN + 1}
           else floor((rb - ({_CLO})) / {_CHI - _CLO} * {_CN}) + 1 end as bigint) as bin, count(*) as n
    from b where rb is not null group by 1""", "pair_daily"))
def q_map_classes(spark, sf):
    yr = resample.climatology(_pd(spark, sf), ["o", "p"], by="year")
    b = yr.select("y", "x", metrics.bias(yr, "o", "p", relative=True).alias("rb"))
    m = resample.mean_over(b, ["rb"], keep=["y", "x"]).withColumn("rb", F.round(F.col("rb") + F.lit(1e-9), 3))
    return metrics.histogram(m, "rb", _CLO, _CHI, _CN)


# ------------------------------------------------------------------ windows

def _axis_sql(table: str) -> str:
    return f"(select time, row_number() over (order by time) - 1 as i from (select distinct time from {table}))"


def _shift_sql(table: str, steps: int, *values: str) -> str:
    """``s``: every label of the axis takes the value ``-steps`` labels away;
    labels without one are missing in every cell."""
    cols = ", ".join(f"h.{v}" for v in values)
    none = ", ".join(f"cast(null as double) as {v}" for v in values)
    return f"""ax as {_axis_sql(table)},
    s as (select b.time, h.y, h.x, {cols} from {table} h join ax a on h.time = a.time join ax b on b.i = a.i + ({steps})
          union all
          select b.time, c.y, c.x, {none} from (select distinct y, x from {table}) c, ax b
          where b.i - ({steps}) not in (select i from ax))"""


@register("shift_hourly", with_fixtures(
    f"with {_shift_sql('hourly', -6, 'v')} select * from s", "hourly"), ("v",))
def q_shift_hourly(spark, sf):
    # ds.shift(time=-6): the value 6 steps later moves to the current label
    return resample.shift(fx.hourly(spark, sf), ["v"], -6)


@register("shift_daily", with_fixtures(
    f"with {_shift_sql('pair_daily', -1, 'o', 'p')} select * from s", "pair_daily"), ("o", "p"))
def q_shift_daily(spark, sf):
    return resample.shift(_pd(spark, sf), ["o", "p"], -1)


@register("anomalies_month", with_fixtures(ANOM_SQL, "pair_daily"), ("o", "p"))
def q_anomalies_month(spark, sf):
    return scale.anomalies(_pd(spark, sf), ["o", "p"], by="month")


@register("anomalies_standard", with_fixtures(
    """select d.time, d.y, d.x, case when s.so = 0 then null else (d.o - s.mo) / s.so end as o,
    case when s.sp = 0 then null else (d.p - s.mp) / s.sp end as p
    from pair_daily d join (select cast(dayofyear(time) as int) as doy, y, x, avg(o) as mo, avg(p) as mp,
                            stddev_pop(o) as so, stddev_pop(p) as sp from pair_daily group by 1, 2, 3) s
      on cast(dayofyear(d.time) as int) = s.doy and d.y = s.y and d.x = s.x""", "pair_daily"), ("o", "p"))
def q_anomalies_standard(spark, sf):
    return scale.anomalies(_pd(spark, sf), ["o", "p"], by="dayofyear", standard=True)


@register("axis_index", with_fixtures(f"select * from {_axis_sql('pair_daily')}", "pair_daily"))
def q_axis_index(spark, sf):
    return axes.axis_index(_pd(spark, sf), "time", "i").withColumn("i", F.col("i").cast("long"))


# ------------------------------------------------------------------ selections

@register("isel_time", with_fixtures(
    f"""with ax as {_axis_sql('hourly')}
    select h.* from hourly h join ax on h.time = ax.time
    where ax.i in (0, 10, (select max(i) from ax))""", "hourly"), ("v",))
def q_isel_time(spark, sf):
    return axes.isel(fx.hourly(spark, sf), "time", [0, 10, -1])


@register("calibration_period", with_fixtures(
    "select * from pair_daily where time >= date '1996-01-01' and time < date '1999-01-01'", "pair_daily"),
    ("o", "p"))
def q_calibration_period(spark, sf):
    return resample.period(_pd(spark, sf), "1996-01-01", "1999-01-01")


@register("drop_last_step", with_fixtures(
    "select * from hourly where time < (select max(time) from hourly)", "hourly"), ("v",))
def q_drop_last_step(spark, sf):
    return resample.drop_last_step(fx.hourly(spark, sf))


@register("masked", with_fixtures(
    "select time, y, x, o, case when o >= 10 then p end as p from pair_daily", "pair_daily"), ("o", "p"))
def q_masked(spark, sf):
    d = _pd(spark, sf)
    return d.withColumn("p", X.mask("p", F.col("o") >= 10))


_HOLEY = """select time, y, x, case when o < 49.5 or (y + x) % 2 = 0 then o end as o, p from pair_daily"""


@register("complete_cells", with_fixtures(
    f"""with h as ({_HOLEY})
    select * from h where (y, x) not in (select y, x from h where o is null or p is null)""", "pair_daily"),
    ("o", "p"))
def q_complete_cells(spark, sf):
    d = _pd(spark, sf).withColumn("o", X.mask("o", (F.col("o") < 49.5) | ((F.col("y") + F.col("x")) % 2 == 0)))
    return grid.complete_cells(d, ["o", "p"])


@register("stack_long", with_fixtures(
    "select time, y, x, variable, value from pair_daily unpivot (value for variable in (o, p))", "pair_daily"),
    ("value",))
def q_stack_long(spark, sf):
    return grid.to_long(_pd(spark, sf), ["o", "p"], ["time", "y", "x"])


# ------------------------------------------------------------------ joins

@register("level_pivot", with_fixtures(
    """select time, y, x, max(case when level = 1 then v end) as v_1, max(case when level = 2 then v end) as v_2,
    max(case when level = 3 then v end) as v_3 from levels where level in (1, 2, 3) group by 1, 2, 3""",
    "levels"), ("v_1", "v_2", "v_3"))
def q_level_pivot(spark, sf):
    return grid.pivot_levels(fx.levels(spark, sf), ["v"], [1, 2, 3])


@register("merge_variables", with_fixtures(
    f"""select coalesce(a.time, b.time) as time, coalesce(a.y, b.y) as y, coalesce(a.x, b.x) as x, a.o, {', '.join(f'b.v_{k}' for k in range(1, 8))}
    from (select time, y, x, o from pair_daily) a full join
         (select time, y, x, {', '.join(f'max(case when level = {k} then v end) as v_{k}' for k in range(1, 8))} from levels group by 1, 2, 3) b
    on a.time = b.time and a.y = b.y and a.x = b.x""", "pair_daily", "levels"), ("o", *(f"v_{k}" for k in range(1, 8))))
def q_merge_variables(spark, sf):
    lv = grid.pivot_levels(fx.levels(spark, sf), ["v"], list(range(1, 8)))
    return joins.merge([_pd(spark, sf).select("time", "y", "x", "o"), lv])


@register("attach_elevation", with_fixtures(
    "select d.*, e.z from pair_daily d left join elevation e on d.y = e.y and d.x = e.x",
    "pair_daily", "elevation"), ("o", "p", "z"))
def q_attach_elevation(spark, sf):
    return joins.attach_static(_pd(spark, sf), fx.elevation(spark, sf))


@register("sel_times", with_fixtures(
    "select * from pair_daily where time in (select time from levels where level = 7)",
    "pair_daily", "levels"), ("o", "p"))
def q_sel_times(spark, sf):
    other = fx.levels(spark, sf).where(F.col("level") == 7)
    return joins.sel_labels(_pd(spark, sf), other, "time")


_SHIFTED = """select cast(l_shipdate as date) + interval 3 day as time, l_suppkey % 4 + 10 as x,
    l_partkey % 4 * 2 + 100 as y, avg(l_tax) as q from lineitem group by 1, 2, 3"""


def _shifted(spark, sf):
    li = spark.read.parquet(f"{sf.rstrip('/')}/lineitem.parquet")
    return (li.groupBy(F.date_add(F.col("l_shipdate").cast("date"), 3).alias("time"),
                       (F.col("l_suppkey") % 4 + 10).alias("x"), (F.col("l_partkey") % 4 * 2 + 100).alias("y"))
              .agg(F.avg("l_tax").alias("q")))


@register("align_positional", with_fixtures(
    f"""with b as ({_SHIFTED}),
    ta as (select time, dense_rank() over (order by time) as r from (select distinct time from pair_daily)),
    tb as (select time, dense_rank() over (order by time) as r from (select distinct time from b)),
    ya as (select y, dense_rank() over (order by y) as r from (select distinct y from pair_daily)),
    yb as (select y, dense_rank() over (order by y) as r from (select distinct y from b)),
    xa as (select x, dense_rank() over (order by x) as r from (select distinct x from pair_daily)),
    xb as (select x, dense_rank() over (order by x) as r from (select distinct x from b))
    select ta.time, ya.y, xa.x, b.q from b
      join tb on b.time = tb.time join ta on ta.r = tb.r
      join yb on b.y = yb.y join ya on ya.r = yb.r
      join xb on b.x = xb.x join xa on xa.r = xb.r""", "pair_daily"), ("q",))
def q_align_positional(spark, sf):
    return joins.align_positional(_pd(spark, sf), _shifted(spark, sf)).select("time", "y", "x", "q")


@register("grid_difference", with_fixtures(
    """select a.time, a.y, a.x, b.v - a.o as diff from pair_daily a
    join (select time, y, x, avg(v) as v from levels group by 1, 2, 3) b on a.time = b.time and a.y = b.y and a.x = b.x""",
    "pair_daily", "levels"), ("diff",))
def q_grid_difference(spark, sf):
    b = fx.levels(spark, sf).groupBy("time", "y", "x").agg(F.avg("v").alias("v"))
    j = joins.combine(_pd(spark, sf), b)
    return j.select("time", "y", "x", (F.col("v") - F.col("o")).alias("diff"))


@register("stack_maps", with_fixtures(
    f"""with yr as ({YEARLY_SQL}), m as (select y, x, avg(o) as o, avg(p) as p from yr group by 1, 2)
    select y, x, o as value, 0 as number from m union all select y, x, p, 1 from m""", "pair_daily"),
    ("value",))
def q_stack_maps(spark, sf):
    yr = resample.climatology(_pd(spark, sf), ["o", "p"], by="year")
    m = resample.mean_over(yr, ["o", "p"], keep=["y", "x"])
    return grid.stack_maps([m.select("y", "x", F.col("o").alias("value")),
                            m.select("y", "x", F.col("p").alias("value"))])


# ------------------------------------------------------------------ scalar functions

@register("doy_features", with_fixtures(
    """select time, y, x, cast(sin(2 * pi() * dayofyear(time) / 365.0) as float) as sin_doy,
    cast(cos(2 * pi() * dayofyear(time) / 365.0) as float) as cos_doy from pair_daily""", "pair_daily"),
    ("sin_doy", "cos_doy"))
def q_doy_features(spark, sf):
    d = _pd(spark, sf)
    s, c = X.doy_encoding("time")
    return d.select("time", "y", "x", s.alias("sin_doy"), c.alias("cos_doy"))


@register("time_parts", with_fixtures(
    f"""select distinct time, cast(year(time) as int) as year, cast(month(time) as int) as month,
    cast(dayofyear(time) as int) as dayofyear, {SEASON_SQL} as season from pair_daily""", "pair_daily"))
def q_time_parts(spark, sf):
    d = _pd(spark, sf).select("time").distinct()
    return d.select("time", X.year("time").alias("year"), X.month("time").alias("month"),
                    X.day_of_year("time").alias("dayofyear"), X.season("time").alias("season"))


@register("units", with_fixtures(
    "select time, y, x, o - 273.15 as o_c, p * 1000 as p_mm, abs(p - o) as ad, sqrt(o) as so, "
    "power(p - o, 2) as sq from pair_daily", "pair_daily"), ("o_c", "p_mm", "ad", "so", "sq"))
def q_units(spark, sf):
    d = _pd(spark, sf)
    return d.select("time", "y", "x", X.kelvin_to_celsius("o").alias("o_c"), X.metres_to_mm("p").alias("p_mm"),
                    F.abs(F.col("p") - F.col("o")).alias("ad"), F.sqrt("o").alias("so"),
                    F.pow(F.col("p") - F.col("o"), 2).alias("sq"))


@register("minmax_scaled", with_fixtures(
    """select time, y, x, (o - (select min(o) from pair_daily)) / nullif((select max(o) - min(o) from pair_daily), 0) as o,
    (p - (select min(p) from pair_daily)) / nullif((select max(p) - min(p) from pair_daily), 0) as p
    from pair_daily""", "pair_daily"), ("o", "p"))
def q_minmax_scaled(spark, sf):
    return scale.minmax(_pd(spark, sf), ["o", "p"])


@register("minmax_calibration", with_fixtures(
    """with r as (select * from pair_daily where time < date '1998-01-01')
    select time, y, x, (o - (select min(o) from r)) / nullif((select max(o) - min(o) from r), 0) as o
    from pair_daily""", "pair_daily"), ("o",))
def q_minmax_calibration(spark, sf):
    d = _pd(spark, sf)
    return scale.minmax(d.select("time", "y", "x", "o"), ["o"],
                        reference=resample.period(d, "1900-01-01", "1998-01-01"))


@register("standardized", with_fixtures(
    """select time, y, x, (o - (select avg(o) from pair_daily)) / (select stddev_samp(o) from pair_daily) as o,
    (p - (select avg(p) from pair_daily)) / (select stddev_samp(p) from pair_daily) as p
    from pair_daily""", "pair_daily"), ("o", "p"))
def q_standardized(spark, sf):
    return scale.standardize(_pd(spark, sf), ["o", "p"])


@register("standardized_period", with_fixtures(
    """select time, y, x, (o - (select avg(o) from pair_holes)) / (select stddev_pop(o) from pair_holes) as o,
    (p - (select avg(p) from pair_holes)) / (select stddev_pop(p) from pair_holes) as p
    from pair_holes""", "pair_holes"), ("o", "p"))
def q_standardized_period(spark, sf):
    """X6, whole-period anomalies: each variable over time, y and x together."""
    return scale.standardize(fx.pair_holes(spark, sf), ["o", "p"], ddof=0)


@register("minmax_cells", with_fixtures(
    """select d.time, d.y, d.x, (d.o - s.lo) / nullif(s.hi - s.lo, 0) as o, (d.p - s.pl) / nullif(s.ph - s.pl, 0) as p from pair_daily d
    join (select y, x, min(o) as lo, max(o) as hi, min(p) as pl, max(p) as ph from pair_daily group by 1, 2) s on d.y = s.y and d.x = s.x""",
    "pair_daily"), ("o", "p"))
def q_minmax_cells(spark, sf):
    return scale.minmax_by(_pd(spark, sf), ["o", "p"])


@register("tiles", with_fixtures(
    """select y, x, z, cast(floor(y / 2) * 25 + floor(x / 2) as bigint) as tile_id,
    cast(y % 2 as int) as tile_row, cast(x % 2 as int) as tile_col from elevation""", "elevation"), ("z",))
def q_tiles(spark, sf):
    return grid.tiles(fx.elevation(spark, sf), 2)


# ------------------------------------------------------------------ regridding

def _target_axis_sql(col: str, step: float, pad: float, table: str = "pair_daily") -> str:
    return (f"select lo - ({pad}) + unnest(generate_series(0, cast(floor((hi - lo + {2 * pad}) / {step} + 1e-9) "
            f"as bigint))) * {step} as t from (select cast(min({col}) as double) as lo, "
            f"cast(max({col}) as double) as hi from {table})")


def _bilinear_weights_sql(ax: str, table: str = "pair_daily", step: float = 0.25, pad: float = 0.5) -> str:
    return f"""s{ax} as (select distinct cast({ax} as double) as s from {table}),
    t{ax} as ({_target_axis_sql(ax, step, pad, table)}),
    br{ax} as (select t, (select max(s) from s{ax} where s <= t) as a, (select min(s) from s{ax} where s >= t) as b
              from t{ax}),
    w{ax} as (select t, a as s, case when a = b then 1.0 else (b - t) / (b - a) end as w,
                     case when a = b then 1 else 2 end as k from br{ax} where a is not null and b is not null
              union all
              select t, b as s, (t - a) / (b - a) as w, 2 as k from br{ax}
              where a is not null and b is not null and a <> b)"""


@register("regrid_bilinear", with_fixtures(
    f"""with {_bilinear_weights_sql('x')}, {_bilinear_weights_sql('y')}
    select d.time, wy.t as y, wx.t as x,
           case when count(d.o) = max(wx.k * wy.k) then sum(wx.w * wy.w * d.o) end as o
    from pair_daily d join wx on cast(d.x as double) = wx.s join wy on cast(d.y as double) = wy.s
    group by 1, 2, 3""", "pair_daily"), ("o", "y", "x"))
def q_regrid_bilinear(spark, sf):
    d = _pd(spark, sf).select("time", "y", "x", "o")
    ax = axes.numeric_axes(d, ["y", "x"])
    return regrid.bilinear(d, ["o"], regrid.target_axis(ax["y"], 0.25, 0.5), regrid.target_axis(ax["x"], 0.25, 0.5), axes=ax)


def _edges_sql(name: str, src: str, col: str) -> str:
    return f"""{name} as (select {col}, case when p is null then {col} - (n - {col}) / 2 else (p + {col}) / 2 end as lo,
       case when n is null then {col} + ({col} - p) / 2 else ({col} + n) / 2 end as hi
       from (select {col}, lag({col}) over (order by {col}) as p, lead({col}) over (order by {col}) as n from {src}))"""


def _conservative_weights_sql(ax: str, spherical: bool) -> str:
    a, b = "greatest(te.lo, se.lo)", "least(te.hi, se.hi)"
    w = f"sin(radians({b})) - sin(radians({a}))" if spherical else f"{b} - {a}"
    return f"""s{ax} as (select distinct cast({ax} as double) as s from pair_daily),
    t{ax} as ({_target_axis_sql(ax, 2.0, -0.5)}),
    {_edges_sql(f'se{ax}', f's{ax}', 's')},
    {_edges_sql(f'te{ax}', f't{ax}', 't')},
    w{ax} as (select te.t, se.s, {w} as w from te{ax} te join se{ax} se on {b} > {a})"""


@register("regrid_conservative", with_fixtures(
    f"""with {_conservative_weights_sql('x', False)}, {_conservative_weights_sql('y', True)}
    select d.time, wy.t as y, wx.t as x,
           sum(wx.w * wy.w * d.o) / sum(case when d.o is not null then wx.w * wy.w end) as o
    from pair_daily d join wx on cast(d.x as double) = wx.s join wy on cast(d.y as double) = wy.s
    group by 1, 2, 3""", "pair_daily"), ("o", "y", "x"))
def q_regrid_conservative(spark, sf):
    d = _pd(spark, sf).select("time", "y", "x", "o")
    ax = axes.numeric_axes(d, ["y", "x"])
    return regrid.conservative(d, ["o"], regrid.target_axis(ax["y"], 2.0, -0.5),
                               regrid.target_axis(ax["x"], 2.0, -0.5), spherical=True, axes=ax)


# ------------------------------------------------------------------ terrain

_NEIGHBOURS = {"a": (1, -1), "b": (1, 0), "c": (1, 1), "d": (0, -1), "f": (0, 1), "g": (-1, -1), "h": (-1, 0), "i": (-1, 1)}
_ROW_FILL = {"a": ("b", "c"), "d": ("e", "f"), "g": ("h", "i"), "c": ("b", "a"), "f": ("e", "d"), "i": ("h", "g")}
_COL_FILL = {"a": ("d", "g"), "b": ("e", "h"), "c": ("f", "i"), "g": ("d", "a"), "h": ("e", "b"), "i": ("f", "c")}
_ASPECT = "degrees(atan2(dy, -dx))"


def _fill_sql() -> str:
    one = {n: f"coalesce({n}, 2 * {a} - {b})" for n, (a, b) in _ROW_FILL.items()}
    w1 = ", ".join(f"{one.get(n, n)} as {n}1" for n in "abcdefghi")
    two = {n: f"coalesce({n}1, 2 * {a}1 - {b}1)" for n, (a, b) in _COL_FILL.items()}
    w2 = ", ".join(f"coalesce({two.get(n, n + '1')}, e1) as {n}" for n in "abcdefghi")
    return f"w1 as (select y, x, {w1} from n), w as (select y, x, {w2} from w1)"


def _terrain_sql(table: str, step: float = 1.0) -> str:
    """Horn slope/aspect over ``table(y, x, z)`` whose axes are regular with
    spacing ``step`` (neighbours by coordinate offsets), edges extrapolated."""
    return ("n as (select e.y, e.x, e.z as e, "
            + ", ".join(f"{k}.z as {k}" for k in _NEIGHBOURS)
            + f" from {table} e "
            + " ".join(f"left join {table} {k} on {k}.y = e.y + ({dy * step}) and {k}.x = e.x + ({dx * step})"
                       for k, (dy, dx) in _NEIGHBOURS.items())
            + "), " + _fill_sql()
            + ", g as (select y, x, e, ((c + 2 * f + i) - (a + 2 * d + g)) / 8.0 as dx, "
            "((g + 2 * h + i) - (a + 2 * b + c)) / 8.0 as dy from w) "
            "select y, x, e as z, case when e is not null then "
            f"cast(degrees(atan(sqrt(dx * dx + dy * dy) / {step})) as float) end as slope, "
            f"cast(case when e is null or (dx = 0 and dy = 0) then null else (case when (case when {_ASPECT} > 90 then 450 - {_ASPECT} "
            f"else 90 - {_ASPECT} end) = 360 then 0 else (case when {_ASPECT} > 90 then 450 - {_ASPECT} "
            f"else 90 - {_ASPECT} end) end) end as float) as aspect from g")


TERRAIN_SQL = with_fixtures("with " + _terrain_sql("elevation"), "elevation")


@register("terrain_slope_aspect", TERRAIN_SQL, ("z", "slope", "aspect"))
def q_terrain(spark, sf):
    from ..operators import terrain
    return terrain.slope_aspect(fx.elevation(spark, sf), "z")


# ------------------------------------------------------------------ splits and sampling

def _int_hash(c, seed: int = 0):
    return (c * 7919 + seed) % 10007


@register("split_stratified", with_fixtures(
    """with days as (select time, avg(o) as m from pair_daily group by 1),
    s as (select time, cast(m >= 25 as int) as stratum,
                 (date_diff('day', date '1970-01-01', time) * 7919) % 10007 as k from days),
    r as (select time, stratum, row_number() over (partition by stratum order by k, time) as rn,
                 count(*) over (partition by stratum) as n from s)
    select time, stratum, case when rn <= ceil(0.2 * n) then 'valid' else 'train' end as split from r""",
    "pair_daily"))
def q_split_stratified(spark, sf):
    from ..operators import split
    key = _int_hash(F.datediff(F.col("time"), F.lit("1970-01-01").cast("date")).cast("long"))
    return split.stratified_days(_pd(spark, sf), "o", 25.0, 0.2, order_key=key)


@register("split_chronological", with_fixtures(
    """with ax as (select time, row_number() over (order by time) - 1 as i, count(*) over () as n
                from (select distinct time from pair_daily))
    select time, case when i >= n - ceil(0.2 * n) then 'test' else 'train' end as split from ax""", "pair_daily"))
def q_split_chronological(spark, sf):
    from ..operators import split
    return split.chronological_split(_pd(spark, sf), 0.2)


@register("split_period", with_fixtures(
    """select *, case when time < date '1999-01-01' then 'train' else 'valid' end as split from pair_daily
    where time >= date '1995-01-01' and time < date '2001-01-01'""", "pair_daily"), ("o", "p"))
def q_split_period(spark, sf):
    from ..operators import split
    return split.period_split(_pd(spark, sf), ("1995-01-01", "1999-01-01"), ("1999-01-01", "2001-01-01"))


@register("reduced_grid", with_fixtures(
    """with ay as (select y, row_number() over (order by y) - 1 as i from (select distinct y from pair_daily)),
    sy as (select y from ay order by (i * 7919 + 42) % 10007, i limit 2),
    ax as (select x, row_number() over (order by x) - 1 as i from (select distinct x from pair_daily)),
    sx as (select x from ax order by (i * 7919 + 43) % 10007, i limit 2)
    select * from pair_daily where y in (select y from sy) and x in (select x from sx)""", "pair_daily"),
    ("o", "p"))
def q_reduced_grid(spark, sf):
    from ..operators import split
    d = _pd(spark, sf)
    cells = split.sample_cells(d, 2, seed=42, order_keys={"y": _int_hash(F.col("i"), 42),
                                                          "x": _int_hash(F.col("i"), 43)})
    return split.reduced_grid(d, cells)


# ------------------------------------------------------------------ models (M1-M8), rows-only checks

FEATURES = ["p", "sin_doy", "cos_doy", "z"]
CALIBRATION = ("1990-01-01", "2000-01-01")
VALIDATION = ("2000-01-01", "2010-01-01")


def model_input(spark: SparkSession, sf: str) -> DataFrame:
    """M7 on the fixtures: predictor ``p``, elevation (J2) and day-of-year
    (X2); predictand ``o``; fixed calibration/validation periods (O4)."""
    from ..operators import models, split
    feat = models.assemble_features(_pd(spark, sf), fx.elevation(spark, sf), doy=True)
    return split.period_split(feat, CALIBRATION, VALIDATION)


@register("feature_table", with_fixtures(
    f"""select d.time, d.y, d.x, d.o, d.p, cast(sin(2 * pi() * dayofyear(d.time) / 365.0) as float) as sin_doy,
    cast(cos(2 * pi() * dayofyear(d.time) / 365.0) as float) as cos_doy, e.z,
    case when d.time < date '{CALIBRATION[1]}' then 'train' else 'valid' end as split
    from pair_daily d left join elevation e on d.y = e.y and d.x = e.x
    where d.time >= date '{CALIBRATION[0]}' and d.time < date '{VALIDATION[1]}'""", "pair_daily", "elevation"),
    ("o", "p", "sin_doy", "cos_doy", "z"))
def q_feature_table(spark, sf):
    """M7: predictors, static field, day-of-year encoding and split as one table."""
    return model_input(spark, sf)


@register("predictor_table", with_fixtures(
    f"""with lv as (select time, y, x, {', '.join(f"max(case when level = {k} then v end) as z_{k}" for k in (1, 3, 7))}
                from levels group by 1, 2, 3)
    select coalesce(lv.time, s.time) as time, coalesce(lv.y, s.y) as y, coalesce(lv.x, s.x) as x, z_1, z_3, z_7, s.p as mslp, e.z
    from lv full join pair_daily s on lv.time = s.time and lv.y = s.y and lv.x = s.x
    left join elevation e on coalesce(lv.y, s.y) = e.y and coalesce(lv.x, s.x) = e.x""", "levels", "pair_daily", "elevation"),
    ("z_1", "z_3", "z_7", "mslp", "z"))
def q_predictor_table(spark, sf):
    """M7 from its parts: pressure variables by level (X12), surface variables
    (J1) and a static field (J2), with the vocabulary checked."""
    from ..operators import models
    pressure = fx.levels(spark, sf).withColumnRenamed("v", "geopotential")
    surface = _pd(spark, sf).select("time", "y", "x", F.col("p").alias("mean_sea_level_pressure"))
    return models.assemble_predictors(pressure, ["geopotential"], [1, 3, 7], [surface], ["mean_sea_level_pressure"],
                                      static=fx.elevation(spark, sf))


# ------------------------------------------------------------------ composite jobs

@register("job_shifted_daily", with_fixtures(
    f"""with {_shift_sql('hourly', -6, 'v')},
    d as (select cast(time as date) as time, y, x, avg(v) as v from s group by 1, 2, 3)
    select * from d where time < (select max(time) from d)""", "hourly"), ("v",))
def q_job_shifted_daily(spark, sf):
    from . import jobs
    return jobs.shifted_daily_predictor(fx.hourly(spark, sf), "v", steps=-6)


@register("job_observed_precipitation", with_fixtures(
    f"""with d as (select cast(time as date) as time, y, x, arg_min(v, case when v is not null then time end) as v
                from hourly group by 1, 2, 3),
    {_shift_sql('d', -1, 'v')}
    select * from s where time < (select max(time) from s)""", "hourly"), ("v",))
def q_job_observed_precipitation(spark, sf):
    from . import jobs
    return jobs.observed_precipitation(fx.hourly(spark, sf), "v")


def _report_sql(celsius: bool, wet: float | None) -> str:
    shift = " - 273.15" if celsius else ""
    both = "o is not null and p is not null"
    rb = "case when o = 0 then null else (p - o) / o end * 100"
    errors = {"bias": "avg(p - o)", "rel_bias": f"avg({rb})", "mae": "avg(abs(p - o))", "rmse": "sqrt(avg((p - o) * (p - o)))"}
    summary = {k: f"{k}({{}})" for k in ("median", "min", "max")}
    ctes = [
        f"pair as (select time, y, x, case when {both} then o{shift} end as o, case when {both} then p{shift} end as p from pair_holes)",
        """an as (select d.time, d.y, d.x, d.o - s.mo as o, d.p - s.mp as p
              from pair d join (select month(time) as m, y, x, avg(o) as mo, avg(p) as mp from pair group by 1, 2, 3) s
              on month(d.time) = s.m and d.y = s.y and d.x = s.x)""",
        "yr as (select year(time) as year, y, x, avg(o) as o, avg(p) as p from pair group by 1, 2, 3)",
        f"se as (select {SEASON_SQL} as season, y, x, avg(o) as o, avg(p) as p from pair group by 1, 2, 3)",
        "ex as (select year(time) as year, y, x, quantile_cont(o, 0.98) as o, quantile_cont(p, 0.98) as p from pair group by 1, 2, 3)",
        f"es as (select {SEASON_SQL} as season, y, x, quantile_cont(o, 0.98) as o, quantile_cont(p, 0.98) as p from pair group by 1, 2, 3)",
        f"ym as (select y, x, avg(p - o) as bias, avg({rb}) as rel_bias from yr group by 1, 2)",
    ]
    base = "pair"
    if wet is not None:
        base = "mo"
        ctes += [
            f"mo as (select last_day(time) as time, y, x, {guarded('sum', 'o')} as o, {guarded('sum', 'p')} as p from pair group by 1, 2, 3)",
            f"""w as (select time, y, x, o, p, cast(o >= {wet} as double) as wo, cast(p >= {wet} as double) as wp from pair)""",
            f"""wd as (select y, x, {guarded('sum', 'wo')} as n_wet_obs, {guarded('sum', 'wp')} as n_wet_pred,
                    {guarded('sum', 'wo')} / count(*) * 100 as o, {guarded('sum', 'wp')} / count(*) * 100 as p from w group by 1, 2)""",
            f"""ws as (select {SEASON_SQL} as season, y, x, {guarded('sum', 'wo')} / count(*) * 100 as o,
                    {guarded('sum', 'wp')} / count(*) * 100 as p from w group by 1, 2, 3)""",
            f"""si as (select y, x, {guarded('sum', 'o * wo')} / nullif({guarded('sum', 'wo')}, 0) as o,
                    {guarded('sum', 'p * wp')} / nullif({guarded('sum', 'wp')}, 0) as p from w group by 1, 2)""",
        ]
    rows: list[str] = []

    def part(name, exprs, source, period=None, cells=False, where=None):
        keys = [f"cast({period} as varchar)" if period else "cast(null as varchar)", *(f"cast({c} as double)" if cells else "cast(null as double)" for c in "yx")]
        group = [k for k in ([period] if period else []) + (["y", "x"] if cells else [])]
        for metric, e in exprs.items():
            rows.append(f"select '{name}' as part, {keys[0]} as period, {keys[1]} as y, {keys[2]} as x, '{metric}' as metric, "
                        f"cast({e} as double) as value from {source}" + (f" where {where}" if where else "")
                        + (f" group by {', '.join(group)}" if group else ""))
    r2 = {"r2": r2_sql("o", "p")}
    part("annual_cycle", {"o": "avg(o)", "p": "avg(p)"}, base, "month(time)")
    part("r2", r2, base, where=both)
    part("r2_map", r2, base, cells=True, where=both)
    part("r2_anomaly", r2, "an", where=both)
    part("r2_anomaly_map", r2, "an", cells=True, where=both)
    part("yearly", errors | {"corr": "corr(p, o)"}, "yr")
    part("yearly", {"corr": "corr(p, o)"}, "yr", "year", where=both)
    part("yearly_map", {"bias": "max(bias)", "rel_bias": "max(rel_bias)"}, "ym", cells=True)
    part("yearly_map_summary", {k: v.format("rel_bias") for k, v in summary.items()}, "ym")
    part("seasonal", errors, "se", "season")
    part("seasonal_map_summary", {k: v.format("p - o") for k, v in summary.items()}, "se", "season")
    part("extreme_yearly", errors, "ex")
    part("extreme_seasonal", errors, "es", "season")
    if wet is not None:
        part("wet_days_map", {k: f"max({k})" for k in ("n_wet_obs", "n_wet_pred")}, "wd", cells=True)
        part("wet_days", errors, "wd")
        part("wet_days_seasonal", errors, "ws", "season")
        part("wet_intensity", {"rel_bias": errors["rel_bias"]}, "si")
    return with_fixtures("with " + ",\n".join(ctes) + "\n" + "\nunion all\n".join(rows), "pair_holes")


def _report(spark, sf, fixture=fx.pair_holes, **options):
    from . import jobs
    d = written(fixture(spark, sf), "grid")   # read for the axes, the labels and the values of both grids
    return jobs.verification_report(d.select("time", "y", "x", F.col("o").alias("v")),
                                    d.select("time", "y", "x", F.col("p").alias("v")), "v", **options)


@register("job_precipitation_report", _report_sql(False, WET), ("value", "y", "x"))
def q_job_precipitation_report(spark, sf):
    return _report(spark, sf, wet_threshold=WET)


@register("job_temperature_report", _report_sql(True, None), ("value", "y", "x"))
def q_job_temperature_report(spark, sf):
    return _report(spark, sf, wet_threshold=None, celsius=True)


# ------------------------------------------------------------------ file discovery scan

@register("scan_discovered_files", with_fixtures("select * from pair_daily", "pair_daily"), ("o", "p"))
def q_scan_discovered_files(spark, sf):
    """Find the table files by glob and name pattern under the
    data folder, scan them as one table, then grid them (as pair_daily)."""
    from ..sources import files
    li = files.read_files(spark, sf, glob="lineitem*.parquet", pattern="^lineitem")
    return (li.groupBy(F.col("l_shipdate").cast("date").alias("time"),
                       (F.col("l_suppkey") % 4).alias("x"), (F.col("l_partkey") % 4).alias("y"))
              .agg(F.avg("l_quantity").alias("o"),
                   F.avg(F.col("l_quantity") * (1 + F.col("l_tax") - F.col("l_discount"))).alias("p")))


_SCALED_SQL = """with a as (select time, y, x, o, (p - (select avg(p) from pair_daily)) / nullif((select stddev_pop(p) from pair_daily), 0) as p
          from pair_daily),
    sc as (select time, cast(y as int) as y, cast(x as int) as x, o,
                  (p - (select avg(p) from a)) / nullif((select stddev_samp(p) from a), 0) as p,
                  cast((p - (select min(p) from a)) / nullif((select max(p) - min(p) from a), 0) as real) as q from a),
    full_px as (select t.time, g.y, g.x from (select distinct time, y // 2 as ty, x // 2 as tx from sc) t
                join (select distinct y, x from sc) g on g.y // 2 = t.ty and g.x // 2 = t.tx),
    px as (select f.time, f.y, f.x, sc.p, sc.q, sc.o from full_px f left join sc on sc.time = f.time and sc.y = f.y and sc.x = f.x)
    select time, cast((y // 2) * 2 + x // 2 as bigint) as tile_id,
      string_agg(coalesce(cast(cast(round(p * 1000 + 1e-6, 0) as bigint) as varchar), 'none'), ',' order by y, x) as x_sample,
      string_agg(coalesce(cast(cast(round(cast(q as double) * 1000 + 1e-6, 0) as bigint) as varchar), 'none'), ',' order by y, x) as x_minmax,
      string_agg(coalesce(cast(cast(round(o * 1000 + 1e-6, 0) as bigint) as varchar), 'none'), ',' order by y, x) as y_sample
    from px group by 1, 2"""


@register("tile_samples", with_fixtures(_SCALED_SQL, "pair_daily"))
def q_tile_samples(spark, sf):
    """F15 and the sample data set: whole-period anomalies (ddof 0), then
    standard scaling (ddof 1) as ``x_sample`` and min-max scaling as ``x_minmax``, all over time, y and x, as
    (time, tile) tensors of 2 x 2 tiles; the tensors are written as
    thousandths in row order, so that engines can be compared."""
    d = _pd(spark, sf).select("time", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "o", "p")
    s = grid.sample_set(d, ["p"], 2, target="o", scaling=["standard", "minmax"])

    def text(plane):
        one = lambda v: F.coalesce(F.round(v.cast("double") * 1000 + 1e-6, 0).cast("long").cast("string"), F.lit("none"))
        return F.array_join(F.transform(F.flatten(plane), one), ",")
    return s.select("time", "tile_id", text(F.get("x_sample", F.lit(0))).alias("x_sample"),
                    text(F.get("x_sample", F.lit(1))).alias("x_minmax"), text(F.col("y_sample")).alias("y_sample"))


@register("model_pooled_gbt", None)
def q_model_pooled_gbt(spark, sf):
    """M2 pooled alternative: one distributed MLlib GBT over all cells."""
    from ..operators import models
    return models.fit_predict_pooled(model_input(spark, sf), FEATURES, "o", model="GBTRegressor", maxIter=20)


@register("job_daily_regridded", with_fixtures(
    f"""with d as (select cast(time as date) as time, y, x, avg(v) as v from hourly group by 1, 2, 3),
    {_bilinear_weights_sql('x', 'd', 0.5, 0.0)}, {_bilinear_weights_sql('y', 'd', 0.5, 0.0)}
    select d.time, wy.t as y, wx.t as x,
           case when count(d.v) = max(wx.k * wy.k) then sum(wx.w * wy.w * d.v) end as v
    from d join wx on cast(d.x as double) = wx.s join wy on cast(d.y as double) = wy.s
    group by 1, 2, 3""", "hourly"), ("v", "y", "x"))
def q_job_daily_regridded(spark, sf):
    """Hourly -> daily mean -> bilinear regridding to a grid twice as fine."""
    from . import jobs
    h = fx.hourly(spark, sf)
    ax = axes.numeric_axes(h, ["y", "x"])
    return jobs.daily_predictor(h, "v", target=(regrid.target_axis(ax["y"], 0.5), regrid.target_axis(ax["x"], 0.5)), axes=ax)


@register("job_terrain_regridded", with_fixtures(
    f"""with {_bilinear_weights_sql('x', 'elevation', 0.5, 0.0)}, {_bilinear_weights_sql('y', 'elevation', 0.5, 0.0)},
    r as (select wy.t as y, wx.t as x, case when count(e.z) = max(wx.k * wy.k) then sum(wx.w * wy.w * e.z) end as z
          from elevation e join wx on cast(e.x as double) = wx.s join wy on cast(e.y as double) = wy.s
          group by 1, 2),
    {_terrain_sql('r', 0.5)}""", "elevation"), ("z", "slope", "aspect", "y", "x"))
def q_job_terrain_regridded(spark, sf):
    """The elevation raster regridded (bilinear) to a grid of half the
    spacing, then slope and aspect on the target grid."""
    from . import jobs
    e = fx.elevation(spark, sf)
    ax = axes.numeric_axes(e, ["y", "x"])
    return jobs.terrain_fields(e, "z", target=(regrid.target_axis(ax["y"], 0.5), regrid.target_axis(ax["x"], 0.5)), axes=ax)


# ------------------------------------------------------------------ dense calendar and seasonal maps

_FILLED_SQL = """select c.y, c.x, t.time from (select distinct y, x from pair_daily) c,
    (select cast(unnest(generate_series(min(time), max(time), interval 1 day)) as date) as time from pair_daily) t"""


@register("daily_fill_gaps", with_fixtures(
    f"""with f as ({_FILLED_SQL})
    select f.time, f.y, f.x, d.o, d.p from f left join pair_daily d on f.time = d.time and f.y = d.y and f.x = d.x""",
    "pair_daily"), ("o", "p"))
def q_daily_fill_gaps(spark, sf):
    """Every day of the dataset in every cell; absent ones are missing rows."""
    return resample.fill_gaps(_pd(spark, sf))


@register("monthly_sum_dense", with_fixtures(
    f"""with f as ({_FILLED_SQL}),
    g as (select f.time, f.y, f.x, d.o, d.p from f left join pair_daily d
          on f.time = d.time and f.y = d.y and f.x = d.x)
    select last_day(time) as time, y, x, {guarded('sum', 'o')} as o, {guarded('sum', 'p')} as p
    from g group by 1, 2, 3""", "pair_daily"), ("o", "p"))
def q_monthly_sum_dense(spark, sf):
    """A5 on a dense calendar: a month with any absent day is missing."""
    return resample.monthly(resample.fill_gaps(_pd(spark, sf)), ["o", "p"])


@register("seasonal_map_summary", with_fixtures(
    f"""with s as (select {SEASON_SQL} as season, y, x, avg(p - o) as bias from pair_daily group by 1, 2, 3)
    select season, median(bias) as median, min(bias) as min, max(bias) as max, avg(bias) as mean
    from s group by 1""", "pair_daily"), ("median", "min", "max", "mean"))
def q_seasonal_map_summary(spark, sf):
    """A26 per season: median, min and max of the seasonal bias map."""
    d = _pd(spark, sf).withColumn("bias", F.col("p") - F.col("o"))
    m = resample.climatology(d, ["bias"], by="season")
    return metrics.map_summary(m, "bias", by=["season"])


@register("written_grid_roundtrip", with_fixtures("select * from pair_daily", "pair_daily"), ("o", "p"))
def q_written_grid_roundtrip(spark, sf):
    """S7/S8/S9 + S1/S3: write the daily grid as zstd Parquet in year
    folders under the shared checkpoint folder, then discover and scan it
    back (year partition column dropped)."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources import files, sinks
    path = f"{checkpoint_dir(spark).rstrip('/')}/grid-{uuid.uuid4().hex}"
    sinks.write_grid(_pd(spark, sf), path, partition_by=("year",), compression="zstd", if_exists="error")
    back = files.read_files(spark, path, glob="*.parquet")
    return back.select("time", "y", "x", "o", "p")


# ------------------------------------------------------------------ the same operators where values are missing, and on a grid that grows

_HOLES, _WIDE = fx.pair_holes, fx.grid_wide

on_fixture("monthly_sum", "pair_holes", lambda s, d: resample.monthly(_HOLES(s, d), ["o", "p"]))
on_fixture("wet_days", "pair_holes", lambda s, d: metrics.wet_days(_HOLES(s, d), "o", "p", WET))
on_fixture("wet_freq_season", "pair_holes", lambda s, d: metrics.wet_frequency_by(_HOLES(s, d), "o", "p", WET, by="season"))
on_fixture("wet_intensity", "pair_holes", lambda s, d: metrics.wet_intensity(_HOLES(s, d), "o", "p", WET))
on_fixture("skill_daily", "pair_holes", lambda s, d: metrics.skill(_HOLES(s, d), "o", "p"))
on_fixture("r2_monthly_cells", "pair_holes", lambda s, d: metrics.r2(resample.monthly(_HOLES(s, d), ["o", "p"]), "o", "p", by=["y", "x"]))
on_fixture("anomalies_month", "pair_holes", lambda s, d: scale.anomalies(_HOLES(s, d), ["o", "p"], by="month"))

on_fixture("r2_monthly_cells", "grid_wide", lambda s, d: metrics.r2(resample.monthly(_WIDE(s, d), ["o", "p"]), "o", "p", by=["y", "x"]))
on_fixture("anomalies_month", "grid_wide", lambda s, d: scale.anomalies(_WIDE(s, d), ["o", "p"], by="month"))
on_fixture("shift_daily", "grid_wide", lambda s, d: resample.shift(_WIDE(s, d), ["o", "p"], -1))
on_fixture("map_summary", "grid_wide", lambda s, d: metrics.map_summary(resample.mean_over(
    _relative(resample.climatology(_WIDE(s, d), ["o", "p"], by="year")), ["rel_bias"], keep=["y", "x"]), "rel_bias"))


def _relative(yr: DataFrame) -> DataFrame:
    return yr.select("y", "x", metrics.bias(yr, "o", "p", relative=True).alias("rel_bias"))


def _regrid_wide(spark, sf, method, step, pad, **options):
    d = written(_WIDE(spark, sf).select("time", "y", "x", "o"), "grid")
    ax = axes.numeric_axes(d, ["y", "x"])
    return method(d, ["o"], regrid.target_axis(ax["y"], step, pad), regrid.target_axis(ax["x"], step, pad), axes=ax, rows=d.count(), **options)


REGISTRY["regrid_bilinear_wide"] = (
    lambda s, d: _regrid_wide(s, d, regrid.bilinear, 1.0, -0.5),
    with_fixtures(f"""with {_bilinear_weights_sql('x', 'grid_wide', 1.0, -0.5)}, {_bilinear_weights_sql('y', 'grid_wide', 1.0, -0.5)}
    select d.time, wy.t as y, wx.t as x,
           case when count(d.o) = max(wx.k * wy.k) then sum(wx.w * wy.w * d.o) end as o
    from grid_wide d join wx on cast(d.x as double) = wx.s join wy on cast(d.y as double) = wy.s
    group by 1, 2, 3""", "grid_wide"), ("o", "y", "x"))
on_fixture("regrid_conservative", "grid_wide", lambda s, d: _regrid_wide(s, d, regrid.conservative, 2.0, -0.5, spherical=True))
REGISTRY["regrid_conservative_wide"] = (
    REGISTRY["regrid_conservative_wide"][0],
    with_fixtures(f"""with {_conservative_weights_sql('x', False).replace('pair_daily', 'grid_wide')},
    {_conservative_weights_sql('y', True).replace('pair_daily', 'grid_wide')}
    select d.time, wy.t as y, wx.t as x,
           sum(wx.w * wy.w * d.o) / sum(case when d.o is not null then wx.w * wy.w end) as o
    from grid_wide d join wx on cast(d.x as double) = wx.s join wy on cast(d.y as double) = wy.s
    group by 1, 2, 3""", "grid_wide"), ("o", "y", "x"))
REGISTRY["job_precipitation_report_wide"] = (
    lambda s, d: _report(s, d, _WIDE, wet_threshold=WET),
    REGISTRY["job_precipitation_report"][1].replace(fx.PAIR_HOLES_SQL, fx.GRID_WIDE_SQL), ("value", "y", "x"))


# ------------------------------------------------------------------ more operators of the survey over the given tables

@register("concat_time", with_fixtures(
    "select time, y, x, o, p from pair_daily union all select cast(time as date), y, x, v as o, v as p from hourly", "pair_daily", "hourly"), ("o", "p"))
def q_concat_time(spark, sf):
    """Two datasets, one after the other."""
    h = fx.hourly(spark, sf).select(F.col("time").cast("date").alias("time"), "y", "x", F.col("v").alias("o"), F.col("v").alias("p"))
    return joins.concat_time([_pd(spark, sf), h])


@register("keep_known", with_fixtures("select time, y, x, o from pair_daily", "pair_daily"), ("o",))
def q_keep_known(spark, sf):
    """variables of a vocabulary only."""
    return grid.keep_known(_pd(spark, sf), ["o", "t2m"], ["time", "y", "x"])


@register("short_names", """select p_partkey,
    case p_partkey % 4 when 0 then 'z' when 1 then 't2m' when 2 then 'pr' end as short from part""")
def q_short_names(spark, sf):
    """X11: long variable names (dealt to the parts) to short names."""
    from ..functions import naming
    names = F.array(*[F.lit(n) for n in ("geopotential", "2m_temperature", "total_precipitation", "unknown")])
    pt = spark.read.parquet(f"{sf.rstrip('/')}/part.parquet")
    return pt.select("p_partkey", naming.short_name(F.get(names, (F.col("p_partkey") % 4).cast("int"))).alias("short"))


@register("regrid_weight_table", with_fixtures(
    """select d.time, cast(floor(d.y / 2) as bigint) as y, cast(floor(d.x / 2) as bigint) as x,
    case when count(d.o) = 4 then avg(d.o) end as o from pair_holes d group by 1, 2, 3""", "pair_holes"), ("o",))
def q_regrid_weight_table(spark, sf):
    """J7, second form: a weight table (the mean of 2 x 2 cells) given from outside."""
    d = _HOLES(spark, sf)
    cells = d.select("y", "x").distinct()
    w = cells.select(F.col("y").alias("sy"), F.col("x").alias("sx"), F.floor(F.col("y") / 2).alias("ty"),
                     F.floor(F.col("x") / 2).alias("tx"), F.lit(0.25).alias("w"))
    return regrid.apply_weights(d, ["o"], w)


@register("split_tail", with_fixtures(
    """with ax as (select time, row_number() over (order by time) - 1 as i, count(*) over () as n
                from (select distinct time from hourly))
    select time, case when i >= n - ceil(0.1 * n) then 'test' else 'train' end as split from ax""", "hourly"))
def q_split_tail(spark, sf):
    """O1/O3: the last tenth of the steps is held out."""
    from ..operators import split
    return split.chronological_split(fx.hourly(spark, sf), 0.1)


# the queries of these modules register themselves
from . import queries_curvilinear, queries_files, queries_models  # noqa: E402,F401
