"""Queries of the per-cell models and their search (M1, M3-M6) and of the boosted ones (M2, M8), with the oracles SQL can express."""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import boosting, models, ridge, split
from ..sources import fixtures as fx
from ..sources.fixtures import with_fixtures
from . import jobs
from .catalog import FEATURES, model_input, register

PERIODS = (("1990-01-01", "1997-01-01"), ("1997-01-01", "2010-01-01"))
RIDGE_FEATURES = ["p", "yday"]
PENALTY = 2.5
SPACE = {"penalty": ("log", 1e-3, 10.0), "columns": ("choice", [1, 2]), "min_rows": ("int", 1, 60)}
TRIALS, SEED = 50, 42


def ridge_input(pairs: DataFrame) -> DataFrame:
    """Predictors ``p`` and day of the year, predictand ``o``, labelled by period."""
    return split.period_split(pairs.withColumn("yday", F.dayofyear("time").cast("double")), *PERIODS)


def _moments_sql(table: str) -> str:
    """Rows of both periods, and the centred sums of products by cell and period."""
    sums = {"s11": "x1, x1", "s12": "x1, x2", "s22": "x2, x2", "s1y": "x1, yy", "s2y": "x2, yy", "syy": "yy, yy"}
    return f"""data as (
  select time, y, x, o, p, cast(dayofyear(time) as double) as yday, case when time < date '{PERIODS[0][1]}' then 'train' else 'valid' end as split
  from {table} where time >= date '{PERIODS[0][0]}' and time < date '{PERIODS[1][1]}'),
whole as (
  select *, case when o is not null and p is not null then p end as x1, case when o is not null and p is not null then yday end as x2,
         case when p is not null then o end as yy from data),
mom as (
  select y, x, split, count(*) as rows, count(x1) as n, avg(x1) as m1, avg(x2) as m2, avg(yy) as my,
         {', '.join(f'count(x1) * covar_pop({c}) as {k}' for k, c in sums.items())}
  from whole group by y, x, split)"""


_MODEL_SQL = f"""sys as (select *, s11 + {PENALTY}e0 as a, s22 + {PENALTY}e0 as d from mom where split = 'train' and n = rows and n > 0),
beta as (select y, x, m1, m2, my, (s1y * d - s2y * s12) / (a * d - s12 * s12) as b1, (s2y * a - s1y * s12) / (a * d - s12 * s12) as b2 from sys),
model as (select y, x, b1, b2, my - b1 * m1 - b2 * m2 as b0 from beta),
pred as (select v.time, v.y, v.x, v.o, b0 + b1 * v.p + b2 * v.yday as prediction from data v left join model m on v.y = m.y and v.x = m.x where v.split = 'valid')"""


def _ridge(pairs: DataFrame) -> DataFrame:
    d = ridge_input(pairs)
    model = ridge.fit(d.where("split = 'train'"), RIDGE_FEATURES, "o", PENALTY)
    return ridge.predict(d.where("split = 'valid'"), RIDGE_FEATURES, model).select("time", "y", "x", "o", "prediction")


@register("model_ridge_cells", with_fixtures(f"""with {_moments_sql('pair_holes')}, {_MODEL_SQL},
ends as (select min(time) as lo, max(time) as hi from pred),
days as (select c.y, c.x, cast(unnest(generate_series(lo, hi, interval 1 day)) as date) as time from (select distinct y, x from pair_holes) c, ends)
select d.time, d.y, d.x, p.prediction from days d left join pred p on d.time = p.time and d.y = p.y and d.x = p.x""", "pair_holes"), ("prediction",))
def q_model_ridge_cells(spark, sf):
    """M1, M4: a model of its own for each complete cell; every cell and day of the validation period, missing where there is none."""
    pairs = fx.pair_holes(spark, sf)
    return ridge.full_grid(_ridge(pairs), pairs, ["prediction"])


@register("model_ridge_cells_wide", with_fixtures(f"""with {_moments_sql('grid_wide')}, {_MODEL_SQL}
select time, y, x, o, prediction from pred""", "grid_wide"), ("o", "prediction"))
def q_model_ridge_cells_wide(spark, sf):
    """M1 over the grid that grows with the table."""
    return _ridge(fx.grid_wide(spark, sf))


_SCORES_SQL = """, both_ as (select * from pred where o is not null and prediction is not null),
sums as (select y, x, count(*) as n, sum((o - prediction) * (o - prediction)) as res, var_pop(o) * count(o) as tot from both_ group by 1, 2)
select y, x, n, case when tot > 0 then 1 - res / tot when res = 0 then 1e0 else 0e0 end as r2, sqrt(res / n) as rmse from sums"""


@register("model_cell_scores", with_fixtures(f"with {_moments_sql('pair_holes')}, {_MODEL_SQL}{_SCORES_SQL}", "pair_holes"), ("r2", "rmse"))
def q_model_cell_scores(spark, sf):
    """M3: R² and RMSE of the predictions of each cell."""
    return ridge.cell_scores(_ridge(fx.pair_holes(spark, sf)), "o")


def _uniform_sql(k: int) -> str:
    x = f"((trial * 1000003 + {k * 7919 + SEED}) % 4294967296)"
    for _ in range(2):
        x = f"((xor({x}, {x} >> 16) * {ridge.MIX}) % 4294967296)"
    return f"(xor({x}, {x} >> 16) / 4294967296e0)"


_SEARCH_SQL = f"""with {_moments_sql('grid_wide')},
trials as (
  select trial, exp({_uniform_sql(0)} * ({log(10.0)!r}e0 - ({log(1e-3)!r}e0)) + ({log(1e-3)!r}e0)) as penalty,
         case when {_uniform_sql(1)} < 0.5 then 1 else 2 end as columns, cast(floor({_uniform_sql(2)} * 60) + 1 as int) as min_rows
  from (select unnest(range(0, {TRIALS})) as trial) r),
sys as (
  select t.*, m.y, m.x, m.m1, m.m2, m.my, s1y, s2y, s12, s11 + penalty as a, s22 + penalty as d
  from mom m, trials t where split = 'train' and n = rows and n >= min_rows),
beta as (
  select *, case when columns = 1 then s1y / a else (s1y * d - s2y * s12) / (a * d - s12 * s12) end as b1,
         case when columns = 1 then 0e0 else (s2y * a - s1y * s12) / (a * d - s12 * s12) end as b2 from sys),
model as (select *, my - b1 * m1 - b2 * m2 as b0 from beta),
errors as (
  select trial, penalty, columns, min_rows, m.y, m.x, sqrt(avg((o - b0 - b1 * p - b2 * yday) * (o - b0 - b1 * p - b2 * yday))) as rmse
  from model m join data v on v.y = m.y and v.x = m.x where v.split = 'valid' group by all)
select trial, penalty, columns, min_rows, count(*) as cells, avg(rmse) as rmse from errors group by all"""


@register("search_ridge_cells", with_fixtures(_SEARCH_SQL, "grid_wide"), ("penalty", "rmse"))
def q_search_ridge_cells(spark, sf):
    """M5, M6: fifty drawn parameter sets, each scored by the mean over cells of the RMSE on the validation days."""
    return ridge.search(ridge_input(fx.grid_wide(spark, sf)), RIDGE_FEATURES, "o", TRIALS, SPACE, seed=SEED)


@register("search_ridge_best", with_fixtures(f"select * from ({_SEARCH_SQL}) s order by rmse, trial limit 1", "grid_wide"), ("penalty", "rmse"))
def q_search_ridge_best(spark, sf):
    """The best of them."""
    return ridge.tuned(ridge_input(fx.grid_wide(spark, sf)), RIDGE_FEATURES, "o", n_trials=TRIALS, space=SPACE, seed=SEED)


@register("job_downscale_cells", with_fixtures(f"""with {_moments_sql('pair_holes')}, {_MODEL_SQL}
select time, y, x, o, prediction from pred where o is not null or time is not null""", "pair_holes"), ("o", "prediction"))
def q_job_downscale_cells(spark, sf):
    """Predictors and predictand joined, split by period, a ridge model for each complete cell."""
    d = fx.pair_holes(spark, sf)
    p = d.select("time", "y", "x", "p", F.dayofyear("time").cast("double").alias("yday"))
    return jobs.downscale(p, d.select("time", "y", "x", "o"), "o", RIDGE_FEATURES, model="Ridge", doy=False,
                          calibration=PERIODS[0], validation=PERIODS[1], params={"penalty": PENALTY})


_REDUCED_SQL = """ay as (select y, row_number() over (order by y) - 1 as i from (select distinct y from pair_daily)),
sy as (select y from ay order by (i * 7919 + 42) % 10007, i limit 2),
ax as (select x, row_number() over (order by x) - 1 as i from (select distinct x from pair_daily)),
sx as (select x from ax order by (i * 7919 + 43) % 10007, i limit 2),
small as (select * from pair_daily where y in (select y from sy) and x in (select x from sx)),
"""


@register("job_tune_cells", with_fixtures(
    f"with {_REDUCED_SQL}{_SEARCH_SQL.replace('from grid_wide where', 'from small where')[5:]} order by rmse, trial limit 1", "pair_daily"), ("penalty", "rmse"))
def q_job_tune_cells(spark, sf):
    """A sampled sub-grid, fifty drawn parameter sets, the best of them."""
    d = ridge_input(fx.pair_daily(spark, sf))
    sampled = split.sample_cells(d, 2, order_keys={"y": (F.col("i") * 7919 + 42) % 10007, "x": (F.col("i") * 7919 + 43) % 10007})
    return jobs.tune_cells(d, RIDGE_FEATURES, "o", sampled, n_trials=TRIALS, space=SPACE, seed=SEED)


@register("model_adaboost_r2", None)
def q_model_adaboost_r2(spark, sf):
    """M2: AdaBoost.R2 over all cells."""
    return models.fit_predict_pooled(model_input(spark, sf), FEATURES, "o", model="AdaBoostR2", rounds=5, maxDepth=3)


@register("model_boosted_stop", None)
def q_model_boosted_stop(spark, sf):
    """M8: boosting that stops when the validation error no longer falls."""
    return models.fit_predict_pooled(model_input(spark, sf), FEATURES, "o", model="EarlyStopBoosting", rounds=12, patience=2, rate=0.5, maxDepth=3)


assert set(boosting.MODELS) == {"AdaBoostR2", "EarlyStopBoosting"}
