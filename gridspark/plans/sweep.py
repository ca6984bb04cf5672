"""The sweep over all runs of the run matrix (J9, S9, S11, C6), from a table of run states.

Each (predictand, threshold, model) row of the matrix is one downscaling job,
written under its run key. Every change of a run's state is a row of a small
table beside the results (``started``, ``done``, ``failed`` with the reason), so what
happened outlives the driver. A sweep that is started again skips the runs whose
last state is ``done`` and whose output is finished, and redoes all others, the ones
that a crash left at ``started`` included.

Several runs go on at a time, each from a thread of its own and in a fair pool
of its own, so that the tail of one run does not leave the cluster idle.
Staged tables go when their run has been written. A failing run does not stop
the others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.naming import run_key
from ..session import staging_scope
from ..sources.sinks import finished, write_grid
from . import jobs

STATE = "run_key string, sweep string, state string, at timestamp, detail string"


def _folder(out_root: str) -> str:
    return f"{out_root.rstrip('/')}/_states"


def record(spark: SparkSession, out_root: str, key: str, sweep: str, state: str, detail: str = "") -> None:
    """One more row of the table of states, in a folder of its own: runs of one sweep record at the same time."""
    row = spark.range(1).select(
        F.lit(key).alias("run_key"), F.lit(sweep).alias("sweep"), F.lit(state).alias("state"),
        F.current_timestamp().alias("at"), F.lit(detail[:2000]).alias("detail"))
    row.coalesce(1).write.parquet(f"{_folder(out_root)}/{uuid.uuid4().hex}")


def history(spark: SparkSession, out_root: str) -> DataFrame:
    """All states of all runs; none before the first sweep."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_folder(out_root))
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).option("recursiveFileLookup", "true").parquet(_folder(out_root))


def states(spark: SparkSession, out_root: str) -> DataFrame:
    """The last state of each run: ``(run_key, sweep, state, at, detail)``."""
    order = {"started": 0, "failed": 1, "done": 2}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("state")]
    last = Window.partitionBy("run_key").orderBy(F.desc("at"), rank.desc())
    return history(spark, out_root).withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def run_all(runs: dict[str, Callable[[], DataFrame]], spark: SparkSession, out_root: str, workers: int = 2) -> DataFrame:
    """Run what is not done yet: each value makes the result of its run key. Returns :func:`states`."""
    done = {r.run_key for r in states(spark, out_root).where("state = 'done'").collect()}   # one row for each run of the matrix
    sweep = uuid.uuid4().hex
    waiting = [k for k in runs if not (k in done and finished(spark, f"{out_root.rstrip('/')}/{k}"))]

    def one(key: str) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", key)
        record(spark, out_root, key, sweep, "started")
        try:
            with staging_scope(spark):
                write_grid(runs[key](), f"{out_root.rstrip('/')}/{key}", if_exists="overwrite")
        except Exception as error:   # the others go on; the reason is kept
            record(spark, out_root, key, sweep, "failed", f"{type(error).__name__}: {error}")
        else:
            record(spark, out_root, key, sweep, "done")
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        list(pool.map(inheritable_thread_target(spark)(one), waiting))
    return states(spark, out_root)


def sweep(predictors: DataFrame, predictands: dict[str, DataFrame], features: Sequence[str], matrix: DataFrame, out_root: str,
          predictor_names: Sequence[str] = (), levels: Sequence[int] = (), static: DataFrame | None = None, doy: bool = True,
          calibration=("1985-01-01", "2016-01-01"), validation=("2016-01-01", "2020-12-31"), params: dict | None = None,
          workers: int = 2) -> list[str]:
    """Every row of the run matrix (:func:`gridspark.functions.naming.run_matrix`) as one
    downscaling job. The matrix has a handful of rows, bounded by the lists it
    is made of. Returns the run keys; raises if a run failed."""
    named = matrix.withColumn("run_key", run_key(predictor_names, levels, dem=static is not None, doy=doy))
    runs = {}
    for r in named.orderBy("predictand", "wet_day_threshold", "model").collect():
        runs[r["run_key"]] = lambda r=r: jobs.downscale(
            predictors, predictands[r["predictand"]], r["predictand"], features, model=r["model"], static=static, doy=doy,
            split_mode="stratified" if r["stratify"] else "period", calibration=calibration, validation=validation,
            wet_threshold=r["wet_day_threshold"], params=params)
    after = run_all(runs, predictors.sparkSession, out_root, workers)
    failed = [f"{r.run_key}: {r.detail}" for r in after.where(F.col("run_key").isin(list(runs)) & (F.col("state") != "done")).collect()]
    if failed:
        raise RuntimeError("; ".join(failed))
    return list(runs)
