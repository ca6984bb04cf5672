"""Variable vocabularies and run keys.

The short names and vocabularies below are fixed values: the result keys and
the pressure-level column names follow these conventions exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------
# Pressure-level variables and their short names, in this order.
PRESSURE_VARIABLES = {
    "geopotential": "z",
    "temperature": "t",
    "u_component_of_wind": "u",
    "v_component_of_wind": "v",
    "specific_humidity": "q",
    "temperature_max": "t",
    "temperature_min": "t",
}
# Single-level (surface) variables and their short names, in this order.
SURFACE_VARIABLES = {
    "mean_sea_level_pressure": "mslp",
    "2m_temperature": "t2m",
    "total_precipitation": "pr",
    "surface_pressure": "p",
    "2m_dewpoint_temperature": "t2d",
    "2m_tasmax": "t2m",
    "2m_tasmin": "t2m",
}
# Pressure levels (hPa).
PRESSURE_LEVELS = [1000, 975, 950, 925, 900, 875, 850, 825, 800, 775, 750,
                   700, 650, 600, 550, 500, 450, 400, 350, 300, 250, 225,
                   200, 175, 150, 125, 100, 70, 50, 30, 20, 10, 7, 5, 3, 2, 1]
PREDICTANDS = ["tasmin", "tasmax", "pr", "tasmean"]
MODELS = ["RandomForestRegressor", "GBTRegressor"]
REGRID_MODES = ["bilinear", "conservative"]
# ---------------------------------------------------------------------------

VARIABLE_NAMES = {**PRESSURE_VARIABLES, **SURFACE_VARIABLES}


def short_name(long_name: Column | str) -> Column:
    """X11: long variable name -> short name, missing for unknown names."""
    pairs = []
    for k, v in VARIABLE_NAMES.items():
        pairs += [F.lit(k), F.lit(v)]
    c = F.col(long_name) if isinstance(long_name, str) else long_name
    return F.element_at(F.create_map(*pairs), c)


def run_key(predictors: Sequence[str] = (), levels: Sequence[int] = (), dem: bool = False,
            dem_features: bool = False, doy: bool = False) -> Column:
    """The name of each run of a run matrix (columns ``model``,
    ``predictand``, ``wet_day_threshold``, ``stratify``), as a column.

    ``concat_ws`` leaves out the parts that are missing: level-dependent and
    surface predictors by their short names, the threshold of stratified runs
    in millimetres, and the switches.
    """
    validate_names(list(predictors), VARIABLE_NAMES, "predictors")
    validate_names(list(levels), PRESSURE_LEVELS, "levels")
    on_levels = [PRESSURE_VARIABLES[p] for p in predictors if p in PRESSURE_VARIABLES]
    surface = [SURFACE_VARIABLES[p] for p in predictors if p in SURFACE_VARIABLES]
    threshold = F.regexp_replace(F.col("wet_day_threshold").cast("string"), r"\.0$", "")
    part = lambda present, text: F.lit(text if present else None).cast("string")
    return F.concat_ws(
        "_", "model", "predictand",
        part(on_levels, "_".join(["".join(on_levels), *map(str, levels)])), part(surface, "".join(surface)),
        F.when(F.col("stratify"), F.concat(threshold, F.lit("mm"))),
        part(dem, "dem"), part(dem_features, "sa"), part(doy, "doy"))


def run_matrix(spark: SparkSession, predictands: list[str], thresholds: list[float],
               models: list[str]) -> DataFrame:
    """Every (predictand, threshold, model) run; stratified only for ``pr``.

    Built from the parameter lists with ``explode`` (a handful of rows),
    not from data.
    """
    validate_names(predictands, PREDICTANDS, "predictands")
    validate_names(models, MODELS, "models")
    df = spark.range(1).select(
        F.explode(F.array(*[F.lit(p) for p in predictands])).alias("predictand"))
    df = df.select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("wet_day_threshold"))
    df = df.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return df.withColumn("stratify", F.col("predictand") == F.lit("pr"))


def validate_names(names: list[str], vocabulary, what: str) -> None:
    """Raise on names outside a fixed vocabulary."""
    bad = [n for n in names if n not in vocabulary]
    if bad:
        raise ValueError(f"unknown {what}: {bad}")
