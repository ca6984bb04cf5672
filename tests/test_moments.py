"""Statistics merged from moments equal those of the days, for large means, holes and single days."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import metrics, moments, resample, scale

WET = 280.0


@pytest.fixture(scope="module")
def pair(spark):
    rng, rows = np.random.default_rng(2), []
    for y in range(2):
        for x in range(3):
            for k in range(0, 900, 1 + (y + x) % 2):
                o = 280 + 1e-3 * rng.normal() + y
                p = o + 1e-4 * rng.normal() + 1e-3 * x
                hole = (x == 2 and k % 50 == 7) or (y, x) == (1, 1)
                rows.append((dt.date(2001, 1, 15) + dt.timedelta(k), y, x, *((None, None) if hole else (float(o), float(p)))))
    rows.append((dt.date(2001, 1, 1), 9, 9, 281.0, 281.0))
    return spark.createDataFrame(rows, "time date, y int, x int, o double, p double")


def rows(df, keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def same(a, b, keys, names, tol=1e-9):
    a, b = rows(a, keys), rows(b, keys)
    assert a.keys() == b.keys() and a
    for k in a:
        for n in names:
            x, y = a[k][n], b[k][n]
            assert (x is None) == (y is None) and (x is None or abs(x - y) <= tol * max(1, abs(y))), (k, n, x, y)


def test_means_and_sums(pair):
    m = moments.pair_moments(pair)
    for by in ("year", "season", "month"):
        same(moments.means(m, by), resample.climatology(pair, ["o", "p"], by=by), [by, "y", "x"], ["o", "p"])
        same(moments.means(m, by, ()), resample.pooled_cycle(pair, ["o", "p"], by), [by], ["o", "p"])
    same(moments.monthly_sums(m), resample.monthly(pair, ["o", "p"]), ["time", "y", "x"], ["o", "p"])


def test_r2_of_days_and_anomalies(pair):
    m, cell = moments.pair_moments(pair), ["y", "x"]
    same(moments.r2(m), metrics.r2(pair, "o", "p"), [], ["n", "r2"], 1e-6)
    same(moments.r2(m, cell), metrics.r2(pair, "o", "p", cell), cell, ["n", "r2"], 1e-5)
    anomaly = scale.anomalies(pair, ["o", "p"], by="month")
    same(moments.r2_anomaly(m), metrics.r2(anomaly, "o", "p"), [], ["n", "r2"], 1e-5)
    same(moments.r2_anomaly(m, cell), metrics.r2(anomaly, "o", "p", cell), cell, ["n", "r2"], 1e-5)


def test_constant_cells_have_no_spread(spark):
    """A constant of many days has variance zero, whatever the rounding: 1 if predicted exactly, else 0."""
    days = [(dt.date(2001, 1, 1) + dt.timedelta(k), k) for k in range(70)]
    rows_ = [(t, 0, 0, 281.3, 281.3 + 0.1 * (k % 2)) for t, k in days] + [(t, 0, 1, 281.3, 281.3) for t, _ in days] + [(t, 0, 2, 250.0 + k, 250.5 + k) for t, k in days]
    m = moments.pair_moments(spark.createDataFrame(rows_, "time date, y int, x int, o double, p double"))
    for got in (moments.r2(m, ["x"]), moments.r2_anomaly(m, ["x"])):
        r = {k[0]: v["r2"] for k, v in rows(got, ["x"]).items()}
        assert r[0] == 0.0 and r[1] == 1.0 and 0.99 < r[2] <= 1.0


def test_wet_days(pair):
    m, names = moments.pair_moments(pair, WET), ["f_wet_obs", "f_wet_pred"]
    same(moments.wet_days(m), metrics.wet_days(pair, "o", "p", WET), ["y", "x"], ["n_wet_obs", "n_wet_pred", *names])
    same(moments.wet_days(m, "season"), metrics.wet_frequency_by(pair, "o", "p", WET), ["season", "y", "x"], names)
    same(moments.wet_intensity(m), metrics.wet_intensity(pair, "o", "p", WET), ["y", "x"], ["sdii_obs", "sdii_pred", "rel_bias"])


def test_empty(pair):
    m = moments.pair_moments(pair.limit(0), WET)
    assert moments.r2(m).collect()[0].r2 is None and moments.r2(m, ["y"]).count() == moments.wet_days(m).count() == 0


def test_report_reads_the_pair_three_times(spark, pair, monkeypatch):
    from gridspark.plans import jobs
    kept = {}
    real = jobs.written
    monkeypatch.setattr(jobs, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    o, p = (pair.select("time", "y", "x", F.col(c).alias("v")).where("y < 9") for c in "op")
    report = jobs.verification_report(o, p, "v", wet_threshold=WET)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    path = kept["pair"].inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[1]
    scans = report._jdf.queryExecution().executedPlan().toString().count(path)
    assert "moments" in kept and scans <= 2, plan[:500]


def test_moments_pooled_over_years_serve_what_pools_years(spark):
    """Cells with a masked day, a month without a valid day and values near 300 give the same from the twelve months' rows."""
    rows = spark.range(6000).selectExpr("date_add(date '1999-01-01', cast(id div 6 as int)) as time", "id % 3 as y", "id % 2 as x", "id")
    pair = rows.selectExpr("time", "y", "x", "case when y < 2 or (month(time) <> 2 and id % 997 > 0) then 280 + id * 7919 % 1013 / 50.0 end as o",
                           "case when y < 2 or (month(time) <> 2 and id % 997 > 0) then 281 + id * 104729 % 1009 / 50.0 end as p")
    month = moments.pair_moments(pair, 290.0)
    months = moments.pooled(month)
    assert months.columns == month.columns and months.count() == 6 * 12
    for of in (lambda m: moments.means(m, "season"), moments.wet_days, lambda m: moments.wet_days(m, "season"), moments.wet_intensity,
               lambda m: moments.r2_of(moments.anomaly_sums(m), ["y", "x"])):
        want, got = of(month).toPandas(), of(months).toPandas()
        keys = [c for c in want.columns if c in ("season", "y", "x")]
        want, got = want.set_index(keys).sort_index().astype(float), got.set_index(keys).sort_index().astype(float)
        assert want.index.equals(got.index) and ((want - got).abs().fillna(0) < 1e-8).all(axis=None) and (want.isna() == got.isna()).all(axis=None)
    for m in (month, months):   # numbers only in the aggregates: they hash, nothing is sorted
        assert "SortAggregate" not in moments.anomaly_sums(m)._jdf.queryExecution().toString()
