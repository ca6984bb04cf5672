"""User-level jobs (C1-C9), composed from the operators.

Every job returns DataFrames (lazy plans); the caller writes them with
:func:`gridspark.sources.sinks.write_grid` or collects small reports.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import REGRID_MODES, validate_names
from ..functions.scalar import kelvin_to_celsius
from ..operators import joins, metrics, models, moments, regrid, resample, ridge, split
from ..operators.resample import CELL
from ..session import written


def _regrid(df: DataFrame, values: Sequence[str], target: tuple[DataFrame, DataFrame] | None,
            mode: str, axes: dict | None = None) -> DataFrame:
    if target is None:
        return df
    validate_names([mode], REGRID_MODES, "regridding mode")
    return (regrid.bilinear if mode == "bilinear" else regrid.conservative)(df, values, *target, axes=axes)


def daily_predictor(hourly: DataFrame, variable: str, accumulated: bool = False,
                    target: tuple[DataFrame, DataFrame] | None = None, mode: str = "bilinear",
                    axes: dict | None = None) -> DataFrame:
    """Hourly field -> daily mean (or daily sum in mm for accumulated
    fields such as precipitation) -> optional regridding. One job over all
    yearly files at once (the concat is the scan). ``axes``: see
    :func:`gridspark.operators.regrid.bilinear`."""
    how = ("sum", variable) if accumulated else ("mean", variable)
    d = resample.to_daily(hourly, {variable: how}, scale={variable: 1000.0} if accumulated else None)
    return _regrid(d, [variable], target, mode, axes)


def shifted_daily_predictor(hourly: DataFrame, variable: str, steps: int = -6, accumulated: bool = False,
                            target: tuple[DataFrame, DataFrame] | None = None,
                            mode: str = "bilinear") -> DataFrame:
    """Shift the hourly axis (``steps`` positions, -6 h by default),
    aggregate to days, drop the last day (its hours are incomplete after
    the shift), regrid."""
    s = resample.shift(hourly, [variable], steps)
    d = daily_predictor(s, variable, accumulated)
    d = resample.drop_last_step(d)
    return _regrid(d, [variable], target, mode)


def observed_precipitation(steps_3h: DataFrame, variable: str = "tp",
                           target: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Regrid, first valid value of each day, shift one day back (the
    accumulation reported at 00 UTC belongs to the previous day), drop the
    last day."""
    r = steps_3h if target is None else regrid.bilinear(steps_3h, [variable], *target)
    d = resample.to_daily(r, {variable: ("first", variable)})
    d = resample.shift(d, [variable], -1)
    return resample.drop_last_step(d)


def observed_temperature(steps: DataFrame, variable: str = "t2m") -> DataFrame:
    """C4: one scan -> daily mean, max and min together."""
    return resample.to_daily(steps, {"tasmean": ("mean", variable), "tasmax": ("max", variable),
                                     "tasmin": ("min", variable)})


def terrain_fields(dem: DataFrame, value: str = "elevation", target: tuple[DataFrame, DataFrame] | None = None,
                   rename: dict[str, str] | None = None, axes: dict | None = None) -> DataFrame:
    """DEM regridded to the target grid, axes renamed (e.g. lat/lon);
    slope and aspect with the spacing of the grid that results."""
    d = dem.withColumnsRenamed(rename) if rename else dem
    if target is not None:
        d = regrid.bilinear(d.withColumn("time", F.lit(0)), [value], *target, axes=axes).drop("time")
    from ..operators.terrain import slope_aspect
    return slope_aspect(d, value)


def downscale(predictors: DataFrame, predictand: DataFrame, target: str, features: Sequence[str],
              model: str = "GBTRegressor", static: DataFrame | None = None, doy: bool = True,
              split_mode: str = "period", calibration=("1985-01-01", "2016-01-01"),
              validation=("2016-01-01", "2020-12-31"), wet_threshold: float = 0.0, valid_size: float = 0.2,
              params: dict | None = None, seed: int = 42) -> DataFrame:
    """Features (M7) + split (O4 fixed periods, or O2 wet-day stratified
    inside the calibration period) + a model -> the prediction grid (M4). The
    model is one distributed tree model over all cells (M2), or with
    ``model="Ridge"`` one of its own for each complete cell (M1; ``params`` has
    its ``penalty``)."""
    feat = models.assemble_features(predictors, static, doy=doy)
    data = joins.combine(feat, predictand.select("time", *CELL, target))
    feats = list(features) + (["sin_doy", "cos_doy"] if doy else [])
    if split_mode == "period":
        data = split.period_split(data, calibration, validation)
    elif split_mode == "stratified":
        cal = resample.period(data, *calibration)
        labels = split.stratified_days(cal, target, wet_threshold, valid_size, seed=seed)
        data = split.attach_split(cal, labels)
    else:
        raise ValueError(f"unknown split {split_mode!r}")
    if model == "Ridge":
        cells = ridge.fit(data.where("split = 'train'"), feats, target, **(params or {}))
        return ridge.predict(data.where("split = 'valid'"), feats, cells).select("time", *CELL, target, "prediction")
    return models.fit_predict_pooled(data, feats, target, model=model, seed=seed, **(params or {}))


def tune(predictors: DataFrame, predictand: DataFrame, target: str, features: Sequence[str],
         trials: Sequence[dict], n_per_axis: int = 10, model: str = "GBTRegressor", seed: int = 42) -> DataFrame:
    """Sampled sub-grid (O5, J10) -> score of each parameter set (M5, M8)
    -> the best one (O6). ``trials`` is a short list; each trial is one
    distributed fit."""
    feat = models.assemble_features(predictors, None, doy=True)
    data = joins.combine(feat, predictand.select("time", *CELL, target))
    sub = split.reduced_grid(data, split.sample_cells(data, n_per_axis, seed=seed))
    return split.best_trial(models.search(sub, [*features, "sin_doy", "cos_doy"], target, trials, model=model, seed=seed))


def tune_cells(data: DataFrame, features: Sequence[str], target: str, sampled: tuple[DataFrame, DataFrame] | None = None,
               n_per_axis: int = 10, seed: int = 42, **options) -> DataFrame:
    """C7 with a model for each cell: sampled sub-grid (O5, J10) -> drawn
    parameter sets, scored from moments by their mean RMSE over its cells
    (M5, M6) -> the best one (O6). ``data`` has the split as a column."""
    sampled = sampled or split.sample_cells(data, n_per_axis, seed=seed)
    return ridge.tuned(split.reduced_grid(data, sampled), features, target, seed=seed, **options)


def _part(df: DataFrame, part: str, names: Sequence[str], period: str | None = None,
          cells: bool = False) -> DataFrame:
    """Rows (part, period, y, x, metric, value) of the columns ``names``."""
    keys = [F.lit(part).alias("part"),
            (F.col(period) if period else F.lit(None)).cast("string").alias("period"),
            *[(F.col(c) if cells else F.lit(None)).cast("double").alias(c) for c in CELL]]
    return (df.select(*keys, *[F.col(n).cast("double").alias(n) for n in names])
              .unpivot(["part", "period", *CELL], list(names), "metric", "value"))


def _errors(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean bias, relative bias, MAE and RMSE of the rows of ``o`` and ``p``."""
    d = F.col("p") - F.col("o")
    return df.groupBy(*by).agg(
        F.avg(d).alias("bias"), F.avg(metrics.bias(df, "o", "p", relative=True)).alias("rel_bias"),
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"))


ERRORS = ("bias", "rel_bias", "mae", "rmse")


def verification_report(obs: DataFrame, pred: DataFrame, value: str, wet_threshold: float | None = 1.0,
                        quantile: float = 0.98, celsius: bool = False) -> DataFrame:
    """The verification of a prediction grid against the observations,
    as one long table ``(part, period, y, x, metric, value)``; ``period`` is a
    month, year or season, and ``y, x`` are set for maps.

    The prediction takes the observations' coordinates by position (J4) and
    the observations the predicted times (J3; a time without observations
    raises). Days on which either value is missing are masked (F9), not
    dropped, so sums and counts over a group with such a day are missing.
    Precipitation (``wet_threshold`` set) is scored on monthly sums and on wet
    days, temperature (``celsius`` converts from Kelvin) on days.

    The masked pair is staged once in the shared folder and read three times:
    for its monthly moments (:mod:`gridspark.operators.moments`), from which all
    means, sums, R² and wet-day parts are merged (those over all years from the
    moments of the twelve months), and for the quantiles of years and of seasons.
    """
    o = obs.select("time", *CELL, F.col(value).alias("o"))
    p = pred.select("time", *CELL, F.col(value).alias("p"))
    if celsius:
        o, p = o.withColumn("o", kelvin_to_celsius("o")), p.withColumn("p", kelvin_to_celsius("p"))
    p = joins.align_positional(o, p, axes=CELL)
    o = joins.sel_labels(o, p, "time")
    both = F.col("o").isNotNull() & F.col("p").isNotNull()
    pair = joins.combine(o, p).withColumns({c: F.when(both, F.col(c)) for c in ("o", "p")})
    pair = written(pair.select("time", *CELL, "o", "p"), "pair")
    wet = wet_threshold is not None

    by_cell = pair.repartition(*CELL)   # one shuffle for both quantiles, and one without partial sums for the moments: a cell has few days a month
    month = written(moments.pair_moments(by_cell, wet_threshold), "moments")
    months = written(moments.pooled(month), "months")   # over all years
    sums = moments.monthly_sums(month)
    r2 = (lambda by: metrics.r2(sums, "o", "p", by)) if wet else (lambda by: moments.r2(month, by))
    # what several parts read is small and written once
    year, season = (written(moments.means(m, by), by) for m, by in ((month, "year"), (months, "season")))
    anomaly = written(moments.anomaly_sums(months), "anomaly")
    extreme = metrics.extreme_quantile(by_cell, ["o", "p"], quantile, by="year")
    extreme_season = metrics.extreme_quantile(by_cell, ["o", "p"], quantile, by="season")
    year_map = written(_errors(year, CELL), "year-map")
    valid_year = metrics.valid_pairs(year, "o", "p")
    parts = [
        _part(resample.pooled_cycle(sums, ["o", "p"]) if wet else moments.means(month, "month", ()), "annual_cycle", ["o", "p"], "month"),
        _part(r2(()), "r2", ["r2"]),
        _part(r2(CELL), "r2_map", ["r2"], cells=True),
        _part(moments.r2_of(anomaly), "r2_anomaly", ["r2"]),
        _part(moments.r2_of(anomaly, CELL), "r2_anomaly_map", ["r2"], cells=True),
        _part(_errors(year), "yearly", ERRORS),
        _part(valid_year.agg(F.corr("p", "o").alias("corr")), "yearly", ["corr"]),
        _part(valid_year.groupBy("year").agg(F.corr("p", "o").alias("corr")), "yearly", ["corr"], "year"),
        _part(year_map, "yearly_map", ["bias", "rel_bias"], cells=True),
        _part(metrics.map_summary(year_map, "rel_bias"), "yearly_map_summary", ["median", "min", "max"]),
        _part(_errors(season, ["season"]), "seasonal", ERRORS, "season"),
        _part(metrics.map_summary(season.withColumn("bias", F.col("p") - F.col("o")), "bias", ["season"]),
              "seasonal_map_summary", ["median", "min", "max"], "season"),
        _part(_errors(extreme), "extreme_yearly", ERRORS),
        _part(_errors(extreme_season, ["season"]), "extreme_seasonal", ERRORS, "season"),
    ]
    if wet:
        named = lambda d, *more: d.select(*more, F.col("f_wet_obs").alias("o"), F.col("f_wet_pred").alias("p"))
        days = moments.wet_days(months)
        parts += [
            _part(days, "wet_days_map", ["n_wet_obs", "n_wet_pred"], cells=True),
            _part(_errors(named(days)), "wet_days", ERRORS),
            _part(_errors(named(moments.wet_days(months, "season"), "season"), ["season"]), "wet_days_seasonal", ERRORS, "season"),
            _part(moments.wet_intensity(months).agg(F.avg("rel_bias").alias("rel_bias")), "wet_intensity", ["rel_bias"]),
        ]
    return functools.reduce(DataFrame.unionByName, parts)
