"""Preprocessing of yearly source files that redoes only what changed (C1-C3 with S1, S5, S9, S10, S12).

A job reads files that carry a year in their path, makes a daily grid of
them and keeps it in folders by year. Beside the target lies a manifest: for each
source year the number of files, their bytes and an order-free fingerprint of path,
length and time of change. The next run lists the files (never reading one),
compares, and rewrites only the years that differ:

* ``reach`` years before a changed year are rewritten as well, where the job
  looks ahead (a shift by hours takes the end of a year from the next one's files);
* a year whose files are gone loses its folder;
* :func:`plan` is the dry run: one row for each year with what would happen.

The result is staged completely before the target is touched, and the manifest is written
last: a run that breaks leaves the old manifest, so the next one redoes
the same years. Folders are replaced by Spark's dynamic partition overwrite; staged
tables are dropped at the end, well or not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import nan_to_null_all
from ..session import delete, staging_scope, written
from ..sources.files import YEAR_PATTERN, list_files
from ..sources.sinks import finished

MANIFEST = "year int, files long, bytes long, mark decimal(38,0)"


@dataclass
class YearlyJob:
    """``build`` makes the daily grid of the rows of some years; ``year_part`` counts the
    parts of a file's path from the end: -1 is the file name, -2 its folder."""

    root: str
    target: str
    build: Callable[[DataFrame], DataFrame]
    glob: str = "*"
    pattern: str | None = None
    fmt: str = "parquet"
    year_part: int = -1
    reach: int = 0
    time: str = "time"

    @property
    def manifest(self) -> str:
        return f"{self.target.rstrip('/')}.manifest"


def source_files(spark: SparkSession, job: YearlyJob) -> DataFrame:
    """``(path, length, modification_time, year)`` of the files with a year."""
    name = F.element_at(F.split("path", "/"), job.year_part)
    year = F.regexp_extract(name, YEAR_PATTERN, 0)
    files = list_files(spark, job.root, job.glob, job.pattern)
    return files.where(year != "").select("path", "length", "modification_time", year.cast("int").alias("year"))


def fingerprints(files: DataFrame) -> DataFrame:
    """One row for each year; the mark is a sum, so the order of the files does not matter."""
    each = F.xxhash64("path", "length", "modification_time").cast("decimal(38,0)")
    return files.groupBy("year").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum(each).cast("decimal(38,0)").alias("mark"))


def last_manifest(spark: SparkSession, job: YearlyJob) -> DataFrame:
    """The manifest of the last run that came to its end; empty before the first one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(job.manifest)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    whole = [v for v in versions if finished(spark, f"{job.manifest}/{v}")]
    return spark.read.schema(MANIFEST).parquet(f"{job.manifest}/{whole[-1]}") if whole else spark.createDataFrame([], MANIFEST)


def plan(spark: SparkSession, job: YearlyJob) -> DataFrame:
    """``(year, action, files, bytes)``; the action is ``write``, ``keep`` or ``drop``."""
    now = fingerprints(source_files(spark, job))
    was = last_manifest(spark, job).select("year", F.col("mark").alias("was"), F.col("files").alias("had"))
    both = now.join(was, "year", "full")
    changed = ~F.col("mark").eqNullSafe(F.col("was")) | ~F.col("files").eqNullSafe(F.col("had"))
    touched = both.where(changed).select(F.explode(F.sequence(F.col("year") - job.reach, F.col("year"))).alias("year")).distinct()
    known = both.join(touched.withColumn("touched", F.lit(True)), "year", "left")
    action = F.when(F.col("files").isNull(), "drop").when(F.col("touched"), "write").otherwise("keep")
    return known.select("year", action.alias("action"), F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def _write_manifest(spark: SparkSession, job: YearlyJob, now: DataFrame) -> None:
    """A new version; older ones go once it is whole."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(job.manifest)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    old = sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []
    number = 1 + max([int(v.split("-")[0]) for v in old], default=0)
    now.coalesce(1).write.parquet(f"{job.manifest}/{number:08d}-{uuid.uuid4().hex}")
    for v in old:
        delete(spark, f"{job.manifest}/{v}")


def run(spark: SparkSession, job: YearlyJob) -> list[tuple[int, str]]:
    """Bring the target up to date; ``(year, action)`` of every year, in order.

    The list of years and the paths of the files to be read go through the
    driver, which holds the index of the files of a scan anyway.
    """
    with staging_scope(spark):
        files = written(source_files(spark, job), "files")   # one listing decides and is recorded
        steps = [(r.year, r.action) for r in plan(spark, job).orderBy("year").collect()]
        write = [y for y, a in steps if a == "write"]
        gone = [y for y, a in steps if a == "drop"]
        if write:
            needed = sorted({y + k for y in write for k in range(job.reach + 1)})
            paths = [r.path for r in files.where(F.col("year").isin(needed)).select("path").collect()]
            rows = nan_to_null_all(spark.read.format(job.fmt).load(paths))
            made = job.build(rows).withColumn("year", F.year(job.time))
            made = written(made.where(F.col("year").isin(write)), "years")
            present = {r.year for r in made.select("year").distinct().collect()}
            keys = [c for c in ("y", "x", job.time) if c in made.columns]
            n = int(spark.conf.get("spark.sql.shuffle.partitions"))
            ordered = made.repartitionByRange(n, "year", *keys).sortWithinPartitions("year", *keys)
            (ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
             .partitionBy("year").parquet(job.target))
            gone += [y for y in write if y not in present]   # nothing is left of a year that now yields no row
        for y in gone:
            delete(spark, f"{job.target.rstrip('/')}/year={y}")
        if write or gone:
            _write_manifest(spark, job, fingerprints(files))
        return steps
