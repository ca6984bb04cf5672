"""Hard negatives against brute force."""

import math
import random

import numpy as np

from conftest import SF001
from gridspark.llm import entries, hard_negatives
from pyspark.sql import functions as F

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95, scale=256):
    """Rows (id, label, vector) by nested loops."""
    kept = [(i, y, [math.floor(scale * x) for x in v]) for i, y, v in rows
            if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    firsts = {}
    for i, y, v in kept:
        if anchor(i):
            firsts[i] = min(firsts.get(i, (v, y)), (v, y))
    for i, (v, y) in firsts.items():
        other = sorted((-score(v, w), j, z) for j, z, w in kept if j != i)
        for s, j, z in [o for o in other if o[2] == y][:positives]:
            fits = [o for o in other if o[2] != y and low * -s <= 100 * -o[0] <= high * -s]
            out += [(i, j, r, o[1], -s, -o[0]) for r, o in enumerate(fits[:negatives], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    assert rows_of(entries.op11_hard_negatives(spark, SF001)) == brute(rows, lambda i: i % 50 == 0) != []


def test_small_blocks_ties_and_repeated_rows(spark):
    rng = random.Random(4)
    base = [[rng.choice([-1.5, -0.25, 0.0, 0.5, 1.0, 2.0]) for _ in range(rng.choice([3, 20, 20]))] for _ in range(40)]
    rows = [(rng.randrange(150), rng.choice([0, 0, 0, 1, 2]), rng.choice(base)) for _ in range(400)]
    rows += [(500, 1, [1e30] * 4), (501, 2, [1e6] * 20), (502, 2, [])]
    rows = [r for r in rows if r[0] != 500]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = rows_of(hard_negatives.mine(df, F.col("vec_id") % 10 == 0, block=64, anchor_block=4))
    assert got == brute(rows, lambda i: i % 10 == 0) != []


def test_odd_rows(spark):
    rows = [(10, 1, [1.0, 2.0], 0), (11, 1, [1.0, 1.0], 0), (12, 2, [1.0, 0.5], 0), (13, 2, None, 0), (14, None, [1.0, 1.0], 0), (None, 2, [1.0, 1.0], 0),
            (15, 2, [1.0, None], 0), (16, 2, [1.0, float("nan")], 0), (17, 2, [float("inf"), 1.0], 0), (18, 2, [1.0], 0), (20, 3, [1.0, 1.0], 0), (30, 1, [-5.0, -5.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, rank int")
    got = rows_of(hard_negatives.mine(df, F.col("vec_id") % 10 == 0))
    assert got == brute([r[:3] for r in rows], lambda i: i % 10 == 0) != []
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_save_products():
    """On vectors in clusters the scan reads fewer products than brute force and finds the same."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 64)) * 400
    labels = rng.integers(0, 8, 4000)
    vectors = np.floor(centres[labels] + rng.normal(size=(4000, 64)) * 25)
    block = hard_negatives.Columns(vectors, labels, np.arange(4000))
    read = 0
    for a in range(20):
        score = vectors @ vectors[a]
        rows, got, n = hard_negatives.find_positives(vectors[a], a, labels[a], block, 5)
        same = [i for i in np.lexsort((np.arange(4000), -score)) if labels[i] == labels[a] and i != a][:5]
        assert list(block.ids[rows]) == same and list(got) == list(score[same])
        windows = [(int(s) // 20, int(s) * 95 // 100) for s in got]
        found, m = hard_negatives.find_negatives(vectors[a], a, labels[a], windows, block, 3)
        for (low, high), (at, _) in zip(windows, found):
            want = [i for i in np.lexsort((np.arange(4000), -score)) if labels[i] != labels[a] and low <= score[i] <= high][:3]
            assert list(block.ids[at]) == want
        read += n + m
    assert read < 0.75 * 20 * 4000 * 64
