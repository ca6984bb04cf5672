"""Scans, staged tables and batch helpers shared by the operators of this folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridspark.session import checkpoint_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Staged:
    """Intermediate tables written as Parquet under ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor costs its running tasks
    only. ``drop`` removes a table that no later step reads; the tables behind
    a returned (lazy) DataFrame stay in the folder.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame, shuffles: bool = True) -> DataFrame:
        """``df``, written and read again; its shuffle files are removed then, unless ``shuffles`` are kept for another use."""
        self._n += 1
        path = f"{self.root}/{self._n}"
        before = self.spark.conf.get(CLEANUP)
        if not shuffles:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            if not shuffles:
                self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t._staged_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that no step holds many long texts."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column as Python strings; null is the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and every other character unchanged.

    ``lower`` is the fast way where a string is plain ASCII; elsewhere
    ``translate`` leaves letters such as É alone.
    """
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, lower))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int) -> pa.Table:
    """(text, y) of labelled documents to fit a classifier on.

    The documents of the ``max_rows`` labels that come first by a hash of their
    id, at most ``max_rows`` rows, as long as their texts together have at most
    ``max_chars`` characters (whole texts only). Rows held out (crc32 of the id
    as text divisible by 5) and rows without a label are never taken. The
    labels sent to the executors are bounded by ``max_rows`` as well.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(order, "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    few = rows.select("text", "y", order.alias("o")).orderBy("o", F.xxhash64("text")).limit(max_rows)
    return few.withColumn(
        "sum", F.sum(F.char_length("text")).over(Window.orderBy("o", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0))
    ).where(F.col("sum") <= max_chars).select("text", "y").toArrow()


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no model is fitted on."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
