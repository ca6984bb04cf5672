"""The chain against enumeration of all paths; toxic scores on rows held out."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from conftest import SF001
from gridspark.llm import crf, entries, toxicity

SF01 = "/root/testdata/sf0.1"


def paths(e, start, trans):
    score = {}
    for y in itertools.product((0, 1), repeat=len(e)):
        score[y] = start[y[0]] + sum(trans[a, b] for a, b in zip(y, y[1:])) + sum(x for x, k in zip(e, y) if k)
    return score


def test_marginals_and_best_paths_equal_enumeration():
    rng = np.random.default_rng(2)
    sizes = [1, 2, 7, 3, 9, 1, 5]
    e, start, trans = rng.normal(size=sum(sizes)) * 2, rng.normal(size=2), rng.normal(size=(2, 2))
    first = np.zeros(len(e), bool)
    begins = np.cumsum([0, *sizes[:-1]])
    first[begins] = True
    p, y = crf.marginals(e, first, start, trans), crf.viterbi(e, first, start, trans)
    for b, n in zip(begins, sizes):
        score = paths(e[b : b + n], start, trans)
        z = sum(np.exp(s) for s in score.values())
        want = [sum(np.exp(s) for k, s in score.items() if k[t]) / z for t in range(n)]
        assert np.allclose(p[b : b + n], want)
        assert tuple(y[b : b + n]) == max(score, key=score.get)


def test_long_chains_do_not_overflow():
    e = np.tile([25.0, -25.0], 50_000)
    first = np.zeros(len(e), bool)
    first[0] = True
    p = crf.marginals(e, first, np.zeros(2), np.array([[3.0, -3], [-3, 3]]))
    assert np.isfinite(p).all() and ((0 <= p) & (p <= 1)).all()


def test_fit_recovers_labels():
    rng = np.random.default_rng(3)
    x = np.c_[np.ones(4000), rng.normal(size=4000)]
    y = (x[:, 1] > 0.5).astype(int)
    first = np.arange(4000) % 20 == 0
    w, start, trans = crf.fit(x, 2, y, first, 100)
    assert (crf.viterbi(x @ w, first, start, trans) == y).mean() > 0.97


def test_toxic_scores_on_rows_held_out(spark):
    out = entries.op3_toxicity(spark, SF01).join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((out.score >= 0) & (out.score <= 1)).all()
    assert ((out.score >= 0.5) == (out.predicted == 1)).all()
    assert (out.predicted == out.toxic).mean() > 0.96
    assert out[out.toxic == 0].predicted.mean() < 0.02


def test_toxic_spans_point_at_words(spark):
    bad = ["idiota", "moronic"]
    data = [(i, f"fine words number {i} here and {bad[i % 2]} there é " + "calm " * (i % 7), 1) for i in range(60)] + [(100 + i, f"fine words number {i} here and there é " + "calm " * (i % 7), 0) for i in range(200)]
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in data] + [(None, None, None), (1000, "", "x"), (1001, "calm " * 30_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    by_id, text = {r.doc_id: r for r in out}, {i: t for i, t, _ in data}
    assert len(out) == 263
    for i, t, y in data:
        assert by_id[i].predicted == y
        assert [text[i][s.start : s.end] for s in by_id[i].spans] == ([bad[i % 2]] if y else [])
    assert by_id[None].predicted == by_id[1000].predicted == by_id[1001].predicted == 0


def test_without_labels_or_with_one_kind(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.predicted for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [0, 0]
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (3, None)], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()} == {1}
    assert toxicity.score(docs.where(F.lit(False)), toxicity.fit(docs, one)).count() == 0
    assert spark.read.parquet(f"{SF001}/labels.parquet").count() > 0
