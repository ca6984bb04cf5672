"""The pipeline against brute force of its stages, and all queries on empty tables."""

import zlib

import brute
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import SF001
from gridspark.llm import entries, quality, secrets
from gridspark.llm.common import DOC_COLUMNS
from pyspark.sql import functions as F

TABLES = "documents embeddings labels conversations".split()


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_follow_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    before = rows(docs)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality rules", "line dedup", "minhash near-dedup", "secret scans", "packing"]

    good = stage["quality rules"](spark, docs, SF001).cache()
    assert tuple(good.columns) == DOC_COLUMNS
    verdict = quality.judge(docs, quality.fit(docs, spark.read.parquet(f"{SF001}/labels.parquet"))).where("kept")
    kept = rows(good)
    assert set(kept) == {r.doc_id for r in verdict.select("doc_id").collect()}
    assert all(kept[i] == before[i] for i in kept)
    assert not any(brute.base_quality(r.text)[5] for r in kept.values())

    lines = stage["line dedup"](spark, good, SF001).cache()
    want = {i: t for i, _, _, t in brute.kept_lines([(r.doc_id, r.text) for r in kept.values()])}
    got = rows(lines)
    assert tuple(lines.columns) == DOC_COLUMNS
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) and (r.lang, r.source) == (before[i].lang, before[i].source) for i, r in got.items())

    near = stage["minhash near-dedup"](spark, lines, SF001).cache()
    component = brute.near_components([(r.doc_id, r.text) for r in got.values()], corpus_pipeline.NEAR_PCT)
    assert set(rows(near)) == {i for i, (_, c) in component.items() if i == c}
    assert all(got[i] == r for i, r in rows(near).items())

    clean = stage["secret scans"](spark, near, SF001).cache()
    assert set(rows(clean)) == set(rows(near))
    found = {r.doc_id: r.spans for r in secrets.scan(near, F.concat_ws("/", "source", "lang"), F.col("source")).collect()}
    for i, r in rows(clean).items():
        text, out, at = got[i].text, "", 0
        for s in found[i] or []:
            out += text[at : s.start] + "<secret>" if s.start >= at else ""
            at = max(at, s.end)
        assert r.text == (out + text[at:] if found[i] else text)
        assert not brute.base_secrets(r.text)

    word = Tokenizer.from_file(entries.tokenizer_file("word_bpe_49k.json"))
    ids = {i: [*word.encode(r.text, add_special_tokens=False).ids, 1] for i, r in rows(clean).items()}
    placed = {i: 0 for i in ids}
    for p in sorted(stage["packing"](spark, clean, SF001).collect(), key=lambda p: (p.doc_id, p.start)):
        assert p.start == placed[p.doc_id]
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        placed[p.doc_id] += p.length
    assert placed == {i: len(x) for i, x in ids.items()}

    whole = corpus_pipeline.run(spark, SF001).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in whole} == placed


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    for t in TABLES:
        spark.read.parquet(f"{SF001}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{root}/{t}.parquet")
    return root


@pytest.mark.parametrize("name", [*entries.QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    build = entries.QUERIES.get(name, corpus_pipeline.run)
    out = build(spark, empty).collect()
    assert len(out) == (1 if name == "op4_chat_format" else 0)  # its own conversation -7
