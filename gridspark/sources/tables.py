"""Table scans (S2, S6) over a directory of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalar import nan_to_null_all


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Open one table; the schema comes from the Parquet footer."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def grid_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """S2 + S6: open a grid table (long or wide rows) and turn NaN into NULL."""
    df = spark.read.format(fmt).options(**options).load(path)
    return nan_to_null_all(df)
