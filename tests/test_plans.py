"""Plan shapes that the design relies on at scale, read from ``explain()``."""

import contextlib
import io
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF001

Q = E.queries()


import pytest


@pytest.fixture(autouse=True)
def _fresh_cache(spark):
    # cached grids of earlier tests would replace scans in these plans
    spark.catalog.clearCache()


def plan(df, mode: str = "simple") -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def test_period_filter_reaches_the_scan(spark):
    p = plan(Q["calibration_period"](spark, SF001), "formatted")
    pushed = " ".join(re.findall(r"PushedFilters: \[(.*)\]", p))
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "LessThan(l_shipdate" in pushed, p


def test_flagship_prunes_columns_and_aggregates_partially(spark):
    p = plan(Q["r2_monthly_cells"](spark, SF001), "formatted")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    cols = {c.split(":")[0] for c in schema.split(",")}
    assert cols == {"l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_shipdate"}
    assert p.count("partial_") >= 3
    assert "Window" not in p


def test_group_statistics_need_one_scan_and_one_exchange(spark):
    for name in ("anomalies_standard", "minmax_cells"):
        p = plan(Q[name](spark, SF001))
        assert p.count("Scan parquet") == 1, name
        assert "Join" not in p and p.count("Exchange") == 2, name   # the fixture's aggregate, and the cells


def test_axes_cost_one_pass_over_the_data(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("axes", "jobs before the action")
    df = Q["regrid_bilinear"](spark, SF001)
    jobs = len(tracker.getJobIdsForGroup("axes"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    scans = re.findall(r"FileScan parquet .*?(?=\n)", plan(df))
    assert len([s for s in scans if "lineitem" in s]) == 1
    assert jobs <= 20, jobs   # each stage of a small axis table counts as a job


def test_regridding_broadcasts_counted_axis_weights(spark):
    p = plan(Q["regrid_bilinear"](spark, SF001))
    assert p.count("BroadcastHashJoin") >= 2
    assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p


def test_no_cross_products_anywhere(spark):
    for name in ("terrain_slope_aspect", "regrid_conservative", "reduced_grid", "job_precipitation_report"):
        p = plan(Q[name](spark, SF001))
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


SLOW = {"model_pooled_gbt", "model_adaboost_r2", "model_boosted_stop"}


def test_no_registered_query_plans_a_cross_product(spark):
    """Every registered query (models aside, which are checked above) plans
    without nested-loop or cartesian joins."""
    from conftest import SF0001
    bad = {}
    for name in sorted(n for n in set(Q) - SLOW if not re.match("op[0-9]+_|pipeline", n)):
        p = plan(Q[name](spark, SF0001))
        flags = [f for f in ("BroadcastNestedLoopJoin", "CartesianProduct") if f in p]
        if flags:
            bad[name] = flags
    assert not bad, bad


def test_regridding_of_many_rows_is_cut_by_their_number(spark, monkeypatch):
    """The parts that aggregate the targets grow with the joined rows, so that none of them does."""
    from gridspark.operators import regrid
    df = spark.range(4000).selectExpr("id div 40 as time", "id div 8 % 5 as y", "id % 8 as x", "cast(id % 37 as double) as o")
    axis = lambda c, step: regrid.target_axis(df.selectExpr(f"cast({c} as double) as s").distinct(), step)
    made = lambda rows: regrid.bilinear(df, ["o"], axis("y", 0.5), axis("x", 0.5), rows=rows)
    want = {(r.time, r.y, r.x): r.o for r in made(None).collect()}
    monkeypatch.setattr(regrid, "TASK_ROWS", 500)
    for rows in (4000, None):
        out = made(rows)
        assert int(re.search(r"__tx#\d+, (\d+)\), REPARTITION_BY_NUM", plan(out)).group(1)) > 16
        got = {(r.time, r.y, r.x): r.o for r in out.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_report_quantiles_share_a_shuffle_and_build_no_buffers(spark):
    """Ranks of sorted groups: no aggregate of objects, and rows partitioned by cell are not shuffled again."""
    from gridspark.operators import metrics
    df = spark.range(500).selectExpr("date_add(date '1999-11-01', cast(id * 37 % 900 as int)) as time", "id % 3 as y", "id % 2 as x",
                                     "case when id % 11 > 0 and id % 3 < 2 then id * 7919 % 101 / 3.0 end as o")
    for by in ("year", "season"):
        for q in (0.98, 0.02, 0.5, 0.0, 1.0):
            got = metrics.extreme_quantile(df.repartition("y", "x"), ["o"], q, by)
            p = plan(got)
            assert "ObjectHashAggregate" not in p and p.count("Exchange") == 1, p
            exact = df.groupBy(metrics.calendar_group("time", by), "y", "x").agg(F.percentile("o", F.lit(q)).alias("o"))
            assert {tuple(r) for r in got.collect()} == {tuple(r) for r in exact.collect()}
