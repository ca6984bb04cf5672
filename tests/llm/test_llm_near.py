"""Near-dups against brute force."""

import random

import brute

import corpus_pipeline
from conftest import SF001
from gridspark.llm import entries, minhash
from pyspark.sql import functions as F


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def expected(docs):
    return {i: (n, c, i == c) for i, (n, c) in brute.near_components(docs).items()}


def copies(rng, n, size, edits):
    """Copies of one text, each with some words changed."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    assert result(entries.op10_minhash_dedup(spark, SF001)) == expected(docs)


def test_large_group_of_half_similar_texts(spark):
    rng = random.Random(5)
    texts = copies(rng, 150, 80, 5) + copies(rng, 60, 300, 12) + copies(rng, 40, 60, 1)
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert result(minhash.near_dups(df, split_above=8)) == expected(docs)
    assert result(minhash.near_dups(df, split_above=10_000)) == expected(docs)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one\ttwo "), (6, "one two three four five"), (7, "ONE two three four FIVE"),
            (8, "É b c d e"), (9, "é b c d e"), (10, "w " * 30_000), (11, "w " * 9)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, kept string")
    assert result(minhash.near_dups(df)) == expected(docs)


def test_repeated_and_missing_ids(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven"
    df = spark.createDataFrame([(5, a), (5, a), (7, b), (3, b), (5, b), (None, a)], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.component_id, r.kept) for r in minhash.near_dups(df).collect()), key=str)
    assert [r[:2] for r in rows] == [(0, None), (3, 3), (5, 3), (5, 3), (5, 3), (7, 3)]
    left = sorted((r.doc_id or 0, r.text) for r in minhash.drop_near_dups(df).collect())
    assert left == [(0, a), (3, b)]


def test_every_text_of_a_repeated_id_links(spark):
    """What is near one text of an id is linked with all that is near another one."""
    rng = random.Random(2)
    x, q, a, b = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(4))
    near = lambda t: t + " more"
    for docs, want in (
        ([(1, x), (1, q), (5, near(x)), (6, near(q))], {1: {1}, 5: {1}, 6: {1}}),
        ([(1, a), (2, b), (9, a), (9, b)], {1: {1}, 2: {1}, 9: {1}}),
        ([(4, a), (4, b), (4, x), (3, near(b)), (7, near(x)), (8, q)], {3: {3}, 4: {3}, 7: {3}, 8: {8}}),
        ([(5, a), (5, b), (6, b), (6, q), (7, q), (7, x), (9, near(x))], {i: {5} for i in (5, 6, 7, 9)}),
    ):
        got = {}
        for r in minhash.near_dups(spark.createDataFrame(docs, "doc_id long, text string")).collect():
            got.setdefault(r.doc_id, set()).add(r.component_id)
        assert got == want


def test_empty_table(spark):
    assert minhash.near_dups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_prune_limits_keep_what_reaches_the_threshold():
    limits = minhash.prune_limits(120, 24, 0.85, 1e-6)
    rng = random.Random(1)
    lost = 0
    for _ in range(2000):
        equal, done, alive = 0, 0, True
        for n, least in limits:
            equal += sum(rng.random() < 0.85 for _ in range(n - done))
            done = n
            alive &= equal >= least
        lost += not alive
    assert lost == 0


def test_bandings_follow_the_threshold():
    assert (minhash.bands_for(0.85, 5, 1e-6), minhash.rows_for(0.85, 300, 1e-5)) == (24, 20)
    for t in (0.5, 0.8, 0.85, 0.95):
        rows2 = minhash.rows_for(t, 300, 1e-5)
        assert (1 - t**5) ** minhash.bands_for(t, 5, 1e-6) <= 1e-6 < (1 - t**5) ** (minhash.bands_for(t, 5, 1e-6) - 1)
        assert (1 - t**rows2) ** 300 <= 1e-5 < (1 - t ** (rows2 + 1)) ** 300


def test_pipeline_drops_near_copies_of_four_fifths(spark):
    base = [f"w{i}" for i in range(104)]  # 100 shingles
    pair = lambda changed: " ".join(base[:-changed] + [f"x{i}" for i in range(changed)])
    docs = [(1, " ".join(base)), (2, pair(10)), (3, pair(11)), (4, pair(12))]  # 90, 89 and 88 shared: 0.82, 0.80 and 0.79 to the first
    df = spark.createDataFrame([(*d, "en", "s", len(d[1])) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    for some in ([1, 2], [1, 3], [1, 4]):
        part = [d for d in docs if d[0] in some]
        want = {i for i, (_, c) in brute.near_components(part, 80).items() if i == c}
        assert want == ({1} if some[1] < 4 else {1, 4})
        assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, df.where(F.col("doc_id").isin(some)), SF001).collect()} == want


def test_large_group_at_the_threshold_of_the_pipeline(spark):
    rng = random.Random(6)
    texts = copies(rng, 150, 80, 5) + copies(rng, 60, 300, 16) + copies(rng, 40, 60, 1)
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = {i: (n, c, i == c) for i, (n, c) in brute.near_components(docs, 80).items()}
    assert result(minhash.near_dups(df, threshold_pct=80, split_above=8)) == want


def test_pipeline_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    pairs = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    kept = {i for i, (_, c) in brute.near_components(pairs, 80).items() if i == c}
    assert kept < {i for i, (_, c) in brute.near_components(pairs).items() if i == c}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF001).collect()} == kept
