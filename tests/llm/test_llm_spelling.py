"""Spelling variants against brute force."""

import random

import brute

from conftest import SF001
from gridspark.llm import entries, spelling


def result(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    want = brute.spelling_variants(brute.spelling_words(docs))
    rows = entries.op13_spelling_variants(spark, SF001).collect()
    assert len(rows) == len(want) > 1000
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == want


def test_any_vocabulary_and_depth(spark):
    """Short words, anagrams, accented letters, ties; nodes of any size, so with and without blocks."""
    rng = random.Random(3)
    count = {"".join(rng.choice("abéÿ") for _ in range(rng.randint(1, 6))): rng.choice([1, 2, 30, 30, 400, 5000]) for _ in range(1500)}
    count |= {"".join(rng.sample("abcdefgh", 8)): rng.choice([1, 10, 100]) for _ in range(400)}
    count |= {"x" * 5000: 1, "x" * 4999: 12, "x" * 2500 + "y" + "x" * 2499: 3}
    df = spark.createDataFrame(list(count.items()), "word string, n long")
    want = brute.spelling_variants(count)
    assert any(v[1] not in (v[0], w) for w, v in want.items()), "a chain of two forms"
    for cap in (40, 16_384):
        assert result(spelling.variants(df, cap=cap)) == want


def test_search_reaches_all_within_the_budget():
    import numpy as np

    rng = np.random.default_rng(2)
    vectors = np.unique(rng.integers(0, 3, (3000, spelling.N_GROUPS)) * (rng.random((3000, spelling.N_GROUPS)) < 0.2), axis=0).astype(np.int32)
    index, probes = np.arange(0, len(vectors), 2), np.arange(0, len(vectors), 3)
    got = {(int(u), int(v)) for a, b in spelling.search(index, probes, vectors) for u, v in zip(a, b)}
    d = vectors[probes][:, None, :] - vectors[index][None, :, :]
    fits = (np.maximum(d, 0).sum(2) <= 1) & (np.maximum(-d, 0).sum(2) <= 1)
    want = {(int(probes[i]), int(index[j])) for i, j in zip(*np.nonzero(fits)) if probes[i] >= index[j]}
    assert got == want and len(want) > len(probes) / 4


def test_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", "a"), (None, "Straßenbahn STRAßENBAHN straßenbahn", "a"), (4, "Straßenbahm " * 3, "b"), (4, "Straßenbahm " * 3, "b"),
            (5, "ÉCOLIÈRE écolière " * 2, "c"), (6, "word1word2 seven77 sevenletters×sevenletters", "c"), (7, "a" * 100_000, "d"), (8, "a" * 100_000, "d")]
    df = spark.createDataFrame(docs, "doc_id long, text string, word string")
    count = brute.spelling_words([d[:2] for d in docs])
    assert result(spelling.variants(spelling.words(df, 31, 7, 2))) == brute.spelling_variants(count) != {}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.words(docs, 31, 7, 2)).count() == 0
