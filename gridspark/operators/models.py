"""Predictor tables and models (M1-M8).

Models are Spark's own distributed trees: one model is trained over the rows
of all cells, the cell coordinates joining the predictors. Training is a
distributed histogram aggregation, so no cell's rows ever meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import PRESSURE_VARIABLES, SURFACE_VARIABLES, validate_names
from ..functions.scalar import doy_encoding
from . import boosting
from .grid import pivot_levels
from .joins import attach_static, merge
from .resample import CELL
from .split import chronological_split


def assemble_features(predictors: DataFrame, static: DataFrame | None = None, doy: bool = True,
                      time: str = "time", cell: Sequence[str] = CELL) -> DataFrame:
    """M7: predictors (+ static terrain fields, J2) (+ day-of-year, X2)."""
    d = predictors
    if static is not None:
        d = attach_static(d, static, cell)
    if doy:
        s, c = doy_encoding(time)
        d = d.withColumns({"sin_doy": s, "cos_doy": c})
    return d


def assemble_predictors(pressure: DataFrame, variables: Sequence[str], levels: Sequence[int],
                        surface: Sequence[DataFrame], surface_variables: Sequence[str],
                        static: DataFrame | None = None, level: str = "level") -> DataFrame:
    """M7 from its parts: long pressure-level rows become ``short_level``
    columns (X12), surface grids are merged on their coordinates (J1) under
    their short names (X11), a static field is attached (J2). Unknown variable
    names raise."""
    validate_names(list(variables), PRESSURE_VARIABLES, "pressure variables")
    validate_names(list(surface_variables), SURFACE_VARIABLES, "surface variables")
    wide = pivot_levels(pressure.withColumnsRenamed({v: PRESSURE_VARIABLES[v] for v in variables}),
                        [PRESSURE_VARIABLES[v] for v in variables], levels, level=level)
    short = [g.withColumnsRenamed({v: SURFACE_VARIABLES[v] for v in surface_variables}) for g in surface]
    return assemble_features(merge([wide, *short]), static, doy=False)


def fit_predict_pooled(df: DataFrame, features: Sequence[str], target: str, model: str = "GBTRegressor",
                       split: str = "split", time: str = "time", cell: Sequence[str] = CELL, seed: int = 42,
                       **params) -> DataFrame:
    """M1/M2/M4: fit on the ``train`` rows, predict the ``valid`` rows.

    Rows with a missing predictor or target are left out of training. Every
    ``valid`` row is returned; one with a missing predictor has a missing
    prediction.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    estimators = {"GBTRegressor": GBTRegressor, "RandomForestRegressor": RandomForestRegressor, **boosting.MODELS}
    cols = [*features, *cell]
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    va = VectorAssembler(inputCols=cols, outputCol="__features")
    filled = df.withColumn("__whole", whole).withColumns({c: F.when(F.col("__whole"), F.col(c).cast("double")).otherwise(0.0) for c in features})
    train = va.transform(filled.where((F.col(split) == "train") & F.col("__whole") & F.col(target).isNotNull()))
    est = estimators[model](featuresCol="__features", labelCol=target, predictionCol="__p", seed=seed, **params)
    valid = va.transform(filled.where(F.col(split) == "valid"))
    out = est.fit(train).transform(valid)
    return out.select(time, *cell, F.col(target).cast("double").alias(target), F.when(F.col("__whole"), F.col("__p")).alias("prediction"))


def search(df: DataFrame, features: Sequence[str], target: str, trials: Sequence[dict], model: str = "GBTRegressor",
           test_size: float = 0.2, time: str = "time", seed: int = 42) -> DataFrame:
    """M5: ``(trial, rmse)`` of each parameter set: fitted on the first days,
    scored on the last ``test_size`` of them (O3) by the mean over cells of
    their RMSE. The list of trials is short; each one is a distributed fit, and
    the scores are one row each."""
    labels = chronological_split(df, test_size, time)
    data = df.join(labels.withColumn("split", F.when(F.col("split") == "test", "valid").otherwise("train")), time)
    out = []
    for k, params in enumerate(trials):
        p = fit_predict_pooled(data, features, target, model, time=time, seed=seed, **params)
        by_cell = p.groupBy(*CELL).agg(F.sqrt(F.avg((F.col(target) - F.col("prediction")) ** 2)).alias("rmse"))
        rmse = by_cell.agg(F.avg("rmse")).first()[0]
        out.append((k, rmse))
    return df.sparkSession.createDataFrame(out, "trial int, rmse double")
