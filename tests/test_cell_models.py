"""Per-cell ridge models and their search against numpy; boosting loops against a plain replay."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from gridspark.operators import boosting, ridge

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def cells(spark):
    """Rows (time, y, x, split, a, b, c, d, o) of twelve cells; cell (0, 1) has a hole in training, (0, 2) one in validation."""
    rng, rows = np.random.default_rng(5), []
    for y in range(3):
        for x in range(4):
            beta = rng.normal(size=4)
            for k in range(40):
                f = rng.normal(size=4) * [1, 10, 0.1, 1000] + [0, 5, 100, 1e5]
                o = float(f @ beta + rng.normal() + y)
                rows.append([dt.date(2000, 1, 1) + dt.timedelta(k), y, x, "train" if k < 28 else "valid", *map(float, f), o])
    for r in rows:
        if (r[1], r[2]) == (0, 1) and r[0].day == 5:
            r[5] = None
        if (r[1], r[2]) == (0, 2) and r[3] == "valid" and r[0].day == 1:
            r[4] = float("nan")
    return spark.createDataFrame(rows, "time date, y int, x int, split string, a double, b double, c double, d double, o double"), rows


def arrays(rows, cell, split, k=4):
    own = [r for r in rows if (r[1], r[2]) == cell and r[3] == split]
    whole = [r for r in own if all(v is not None and not math.isnan(v) for v in r[4:])]
    return np.array([r[4 : 4 + k] for r in whole]), np.array([r[8] for r in whole]), len(own) == len(whole)


def numpy_ridge(f, o, penalty):
    c = f - f.mean(0)
    beta = np.linalg.solve(c.T @ c + penalty * np.eye(f.shape[1]), c.T @ (o - o.mean()))
    return beta, o.mean() - beta @ f.mean(0)


def test_coefficients_and_predictions(cells):
    df, rows = cells
    model = ridge.fit(df.where("split = 'train'"), NAMES, "o", 0.7)
    got = {(r.y, r.x): r for r in model.collect()}
    assert len(got) == 12 and got[0, 1].coef is None and got[0, 1].intercept is None
    for cell, r in got.items():
        if cell != (0, 1):
            beta, start = numpy_ridge(*arrays(rows, cell, "train")[:2], 0.7)
            assert np.allclose(r.coef, beta, rtol=1e-6, atol=1e-9) and abs(r.intercept - start) < 1e-4 * max(1, abs(start))
    out = {(r.time, r.y, r.x): r.prediction for r in ridge.predict(df.where("split = 'valid'"), NAMES, model).collect()}
    assert len(out) == 12 * 12
    for r in rows:
        if r[3] == "valid":
            p = out[r[0], r[1], r[2]]
            if (r[1], r[2]) == (0, 1):
                assert p is None
            elif math.isnan(r[4]):
                assert math.isnan(p)
            else:
                beta, start = numpy_ridge(*arrays(rows, (r[1], r[2]), "train")[:2], 0.7)
                assert abs(p - (np.array(r[4:8]) @ beta + start)) < 1e-5


def test_singular_cells_have_no_model(spark):
    same = spark.createDataFrame([(0, 0, float(k), 2.0 * k, float(k * k)) for k in range(9)] + [(0, 1, 1.0, float(k), 3.0) for k in range(9)], "y int, x int, a double, b double, o double")
    assert [r.coef for r in ridge.fit(same, ["a", "b"], "o", 0.0).collect()] == [None, None]
    assert all(r.coef is not None for r in ridge.fit(same, ["a", "b"], "o", 0.1).collect())
    assert ridge.fit(same.limit(0), ["a", "b"], "o").count() == 0


def test_search_equals_fits_of_every_trial(cells):
    df, rows = cells
    space = {"penalty": ("log", 1e-2, 10.0), "columns": ("choice", [1, 2, 4]), "min_rows": ("int", 20, 36)}
    got = ridge.search(df, NAMES, "o", 12, space).collect()
    trials = {r.trial: r for r in got}
    drawn = df.sparkSession.range(12).select("id", *[c.alias(n) for n, c in ridge.draws(F.col("id"), space).items()]).collect()
    assert {d.id for d in drawn if d.min_rows <= 28} == set(trials) and len(trials) < 12
    for d in drawn:
        if d.min_rows > 28:
            continue
        rmse = []
        for y in range(3):
            for x in range(4):
                f, o, whole = arrays(rows, (y, x), "train")
                v, w, _ = arrays(rows, (y, x), "valid")
                if whole:
                    beta, start = numpy_ridge(f[:, : d.columns], o, d.penalty)
                    rmse.append(np.sqrt(np.mean((w - v[:, : d.columns] @ beta - start) ** 2)))
        r = trials[d.id]
        assert (r.penalty, r.columns, r.min_rows, r.cells) == (d.penalty, d.columns, d.min_rows, len(rmse))
        assert abs(r.rmse - np.mean(rmse)) < 1e-5 * max(1, np.mean(rmse))
    best = min(trials.values(), key=lambda r: (r.rmse, r.trial))
    assert ridge.tuned(df, NAMES, "o", n_trials=12, space=space).first().trial == best.trial


def test_draws_cover_their_ranges(spark):
    space = {"l": ("log", 1e-3, 10.0), "c": ("choice", [3, 5, 9]), "i": ("int", -2, 2)}
    rows = spark.range(3000).select(*[c.alias(n) for n, c in ridge.draws(F.col("id"), space, seed=7).items()]).collect()
    logs = sorted(math.log10(r.l) for r in rows)
    assert -3 <= logs[0] < -2.98 and 0.98 < logs[-1] < 1 and abs(logs[1500] + 1) < 0.1
    for name, values in (("c", [3, 5, 9]), ("i", [-2, -1, 0, 1, 2])):
        count = [sum(r[name] == v for r in rows) for v in values]
        assert sum(count) == 3000 and min(count) > 0.8 * 3000 / len(values)
    assert abs(np.corrcoef([r.l for r in rows], [r.i for r in rows])[0, 1]) < 0.06
    with pytest.raises(ValueError):
        ridge.draws(F.col("id"), {"x": ("normal", 0, 1)})


def test_full_grid_and_scores(cells):
    df, rows = cells
    model = ridge.fit(df.where("split = 'train'"), NAMES, "o", 0.7)
    p = ridge.predict(df.where("split = 'valid' and day(time) <> 3"), NAMES, model).withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction")))
    grid = ridge.full_grid(p, df, ["prediction"]).collect()
    assert len(grid) == 12 * 12 and sum(r.prediction is None for r in grid) == 12 + 11 + 1
    scores = {(r.y, r.x): r for r in ridge.cell_scores(p, "o").collect()}
    assert len(scores) == 11 and (0, 1) not in scores
    own = [(r.o, r.prediction) for r in p.where("y = 2 and x = 3").collect()]
    o, q = map(np.array, zip(*own))
    assert scores[2, 3].n == 11 and abs(scores[2, 3].rmse - np.sqrt(np.mean((o - q) ** 2))) < 1e-9
    assert abs(scores[2, 3].r2 - (1 - np.sum((o - q) ** 2) / np.sum((o - o.mean()) ** 2))) < 1e-9


# ----------------------------------------------------------------- boosting


def data(spark, f, n=400, noise=0.0):
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (n, 2))
    return spark.createDataFrame([(k, Vectors.dense(*map(float, v)), float(f(*v) + noise * rng.normal())) for k, v in enumerate(x)], ["id", "features", "label"]).repartition(4)


def test_adaboost_reweights_as_stated(spark):
    df = data(spark, lambda a, b: 3 * a * a + b, noise=0.3)
    model = boosting.AdaBoostR2(rounds=6, maxDepth=2).fit(df)
    assert len(model.trees) == 6 == len(set(model.betas))
    rows = df.orderBy("id").collect()
    y, w, by_tree = np.array([r.label for r in rows]), np.ones(len(rows)), []
    for tree, beta, weight in zip(model.trees, model.betas, model.weights):
        t = np.array([tree.predict(r.features) for r in rows])
        by_tree.append(t)
        e = np.abs(t - y) / np.abs(t - y).max()
        mean = (w * e).sum() / w.sum()
        assert abs(beta - mean / (1 - mean)) < 1e-9 and abs(weight - math.log(1 / beta)) < 1e-9
        w = w * beta ** (1 - e)
    got = [r.prediction for r in model.transform(df).orderBy("id").collect()]
    for k, p in enumerate(got):
        pairs = sorted((t[k], m) for t, m in zip(by_tree, model.weights))
        run = np.cumsum([m for _, m in pairs])
        assert p == pairs[int(np.searchsorted(run, run[-1] / 2 - 1e-12))][0]


def test_adaboost_of_a_step_is_exact(spark):
    df = data(spark, lambda a, b: 2.0 if a > 0 else -1.0)
    model = boosting.AdaBoostR2(rounds=6, maxDepth=2, maxBins=200).fit(df)
    out = model.transform(df).collect()
    assert len(model.trees) < 6 and np.mean([abs(r.prediction - r.label) < 1e-9 for r in out]) > 0.98
    assert boosting.AdaBoostR2(rounds=2).fit(df.limit(0)).trees == []


def test_weighted_median(spark):
    kind = "array<struct<value:double,weight:double>>"
    cases = [([(3.0, 1.0), (1.0, 1.0), (2.0, 1.0)], 2.0), ([(3.0, 5.0), (1.0, 1.0), (2.0, 1.0)], 3.0), ([(1.0, 1.0), (2.0, 1.0)], 1.0), ([], None)]
    df = spark.createDataFrame([(k, c) for k, (c, _) in enumerate(cases)], f"k int, c {kind}")
    assert [r.m for r in df.orderBy("k").select(boosting.weighted_median(F.col("c")).alias("m")).collect()] == [m for _, m in cases]


def test_boosting_stops_and_keeps_the_best_round(spark):
    """Noise alone: the validation error soon rises, long before the last round."""
    df = data(spark, lambda a, b: 0.0, noise=1.0).withColumn("held", F.col("id") % 4 == 0)
    model = boosting.EarlyStopBoosting(rounds=30, patience=3, rate=0.8, validationCol="held", maxDepth=4).fit(df)
    assert len(model.errors) < 30 and len(model.trees) == int(np.argmin(model.errors)) + 1 == len(model.errors) - 3
    replay = {r.id: (r.label, r.prediction) for r in model.transform(df.where("held")).collect()}
    rmse = np.sqrt(np.mean([(a - b) ** 2 for a, b in replay.values()]))
    assert abs(rmse - min(model.errors)) < 1e-9


def test_boosting_goes_on_while_it_helps(spark):
    df = data(spark, lambda a, b: 4 * a + b)
    model = boosting.EarlyStopBoosting(rounds=7, patience=3, rate=0.5, maxDepth=3).fit(df)
    assert len(model.trees) == len(model.errors) == 7 and all(a > b for a, b in zip(model.errors, model.errors[1:]))


def test_early_stop_predicts_into_the_callers_column(spark):
    """The pooled fit asks for the predictions as ``__p``, a name that the boosting loop uses itself."""
    df = data(spark, lambda a, b: 4 * a + b)
    fitted = {n: boosting.EarlyStopBoosting(rounds=3, rate=0.5, maxDepth=2, predictionCol=n).fit(df) for n in ("__p", "prediction")}
    own, plain = ({r.id: r[n] for r in m.transform(df).select("id", n).collect()} for n, m in fitted.items())
    assert own.keys() == plain.keys() and all(abs(own[i] - plain[i]) < 1e-9 for i in own) and len(set(own.values())) > 1
