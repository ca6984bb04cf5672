"""File discovery and multi-file scans.

File listing is Spark's own (``recursiveFileLookup``, ``pathGlobFilter``,
the ``_metadata`` column, the ``binaryFile`` source without its content
column), so it runs against any file system the cluster mounts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null_all

YEAR_PATTERN = "[0-9]{4}"


def list_files(spark: SparkSession, root: str, glob: str = "*", pattern: str | None = None) -> DataFrame:
    """Files under ``root`` (recursively) whose name matches ``glob``
    and, optionally, the regular expression ``pattern``. Returns ``(path,
    file_name, length, modification_time)``; file contents are never read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
          .option("pathGlobFilter", glob).load(root)
          .select("path", "length", "modificationTime"))
    df = df.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    if pattern:
        df = df.where(F.col("file_name").rlike(pattern))
    return df.select("path", "file_name", "length", F.col("modificationTime").alias("modification_time"))


def read_files(spark: SparkSession, root: str, fmt: str = "parquet", glob: str = "*",
               pattern: str | None = None, **options) -> DataFrame:
    """S1 + S3: scan every matching file under ``root`` as one grid table,
    with the source file name as a column (``source_file``); NaN -> NULL."""
    r = (spark.read.format(fmt).option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
         .options(**options).load(root))
    r = r.withColumn("source_file", F.col("_metadata.file_name"))
    if pattern:
        r = r.where(F.col("source_file").rlike(pattern))
    return nan_to_null_all(r)


def read_paths(spark: SparkSession, paths: Sequence[str], fmt: str = "parquet") -> DataFrame:
    """S3: concatenate several files along time in one scan (no dedupe)."""
    return nan_to_null_all(spark.read.format(fmt).load(list(paths)))


def year_range(files: DataFrame, name_col: str = "file_name") -> DataFrame:
    """First and last year found in the file names (first 4-digit run)."""
    y = F.regexp_extract(F.col(name_col), YEAR_PATTERN, 0)
    return (files.where(y != "").agg(F.min(y.cast("int")).alias("first_year"),
                                     F.max(y.cast("int")).alias("last_year")))


def dry_run(files: DataFrame, variable_from: str = "parent") -> DataFrame:
    """The files that would be read, per variable (parent folder name)
    with their year span, count and the first and last name."""
    parts = F.split("path", "/")
    var = F.element_at(parts, -2) if variable_from == "parent" else F.col(variable_from)
    y = F.regexp_extract("file_name", YEAR_PATTERN, 0)
    return (files.select(var.alias("variable"), "file_name", F.when(y != "", y.cast("int")).alias("year"))
                 .groupBy("variable")
                 .agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"),
                      F.count(F.lit(1)).alias("files"), F.min("file_name").alias("first_name"), F.max("file_name").alias("last_name")))


def read_bands(spark: SparkSession, path: str, bands: Sequence[int] | None = None,
               fmt: str = "parquet") -> DataFrame:
    """A raster stored as ``[band, y, x, v]`` rows; ``bands`` selects
    bands (pushed down to the scan)."""
    df = spark.read.format(fmt).load(path)
    if bands is not None:
        df = df.where(F.col("band").isin(list(bands)))
    return nan_to_null_all(df)
