"""Grid sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

# bounds file sizes whatever the partition sizes are
MAX_RECORDS_PER_FILE = 20_000_000
MODES = {"skip": "ignore", "overwrite": "overwrite", "error": "errorifexists", "append": "append"}


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to ``path`` came to its end: the marker of the last
    commit is there. A folder that a crashed run left has none."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def write_grid(df: DataFrame, path: str, partition_by: Sequence[str] = ("year",), time: str = "time",
               compression: str = "zstd", if_exists: str = "skip", fmt: str = "parquet") -> None:
    """Write a grid table.

    ``partition_by=('year',)`` derives the year from ``time`` so a later
    period filter prunes whole folders. ``if_exists='skip'`` leaves a
    finished target untouched; one that a crashed run left is overwritten.
    Rows are clustered by cell within each file, which keeps min/max
    statistics tight for cell filters.
    """
    if if_exists == "skip":
        if finished(df.sparkSession, path):
            return
        if_exists = "overwrite"
    out = df
    if "year" in partition_by and "year" not in df.columns:
        out = out.withColumn("year", F.year(time))
    keys = [c for c in ("y", "x", time) if c in out.columns]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # range partitioning splits a large year over many tasks (never one task
    # per folder) while each task still writes to few folders
    out = out.repartitionByRange(n, *partition_by, *keys) if (partition_by or keys) else out
    out = out.sortWithinPartitions(*partition_by, *keys) if keys else out
    w = (out.write.mode(MODES[if_exists]).option("compression", compression)
         .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).format(fmt))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def staged(df: DataFrame) -> DataFrame:
    """Cut a long lineage (checkpoint in ``spark.checkpoint.dir``)."""
    return stage(df)
