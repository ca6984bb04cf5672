"""Secret scan, line dedup and quality rules against brute force."""

import random
import re
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from conftest import SF001, SF0001
from gridspark.llm import entries, line_dedup, quality, secrets

ODD = [None, "", " ", "\n", "\n\n", "a\n\nb\n", "é" * 30, "x" * 70_000, "\x0b tab\x0c\r\n"]


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def texts(n, seed, parts):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


PARTS = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "=", ":", " ", "  ", '"', "'", "abcdef", "abc", "12", "AKIA", "ABCDEFGHIJKLMNOP1234", "0123456789abcdef", "é", "😀", "\n", ".", "ſecret", "toKen"]


def test_base_spans_equal_brute_force(spark):
    docs = list(enumerate(texts(400, 1, PARTS)))
    df = spark.createDataFrame([(i, t, f"s{i % 5}", "en") for i, t in docs], "doc_id long, text string, source string, lang string")
    out = {r.doc_id: r for r in secrets.digest(secrets.scan(df, F.col("lang"), F.col("source"))).collect()}
    for i, t in docs:
        spans = brute.base_secrets(t)
        assert out[i].base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)), t
        assert [out[i].n_assign, out[i].n_access, out[i].n_hex] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
        every = out[i].spans.split(",") if out[i].spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in spans} <= set(every)
        assert every == sorted(every, key=lambda s: (int(s.split(":")[1]), secrets.KINDS.index(s.split(":")[0]), int(s.split(":")[2])))


def test_query_equals_brute_force_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    out = {r.doc_id: r.base_sha256 for r in entries.op1_secret_scan(spark, SF001).collect()}
    assert out == {d.doc_id: brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in brute.base_secrets(d.text))) for d in docs}


def test_long_tokens_mix_wherever_their_first_digit_or_letter_is(spark):
    tokens = ["Q" * 65 + "7", "12/" * 30 + "Q", "Qq+/" * 30 + "1Z", "Q" * 70_000 + "7", "Q" * 64 + "7"]
    plain = ["Q" * 90, "12/" * 40, "Q" * 70_000]
    docs = list(enumerate([f"my {t} é" for t in tokens + plain]))
    df = spark.createDataFrame([(i, t, f"s{i}") for i, t in docs], "doc_id long, text string, source string")
    out = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(df, F.col("source"), F.col("source"))).collect()}
    red = {r.doc_id: r.text for r in secrets.redact(df, F.col("source"), F.col("source")).collect()}
    for i, t in docs:
        mixes = i < len(tokens)
        assert out[i] == (f"mixed:3:{len(t) - 2}" if mixes else "")
        assert red[i] == ("my <secret> é" if mixes else t)


def test_ownership_separates_copied_from_live(spark):
    example, live = "ghp_" + "Ab1" * 8, "ghp_" + "Zy9" * 8
    data = [(i, f"use {example} here", f"owner{i}", 1, "clash") for i in range(4)] + [(9, f"my {live} é", "owner0", 2, "clash"), (9, f"my {live} é", "owner0", 2, "clash"), (None, None, None, None, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string, hash int, spans string")
    out = secrets.scan(df, F.col("hash"), F.col("source"), copied_owners=3)
    assert "hash" in out.columns
    spans = {r.doc_id: r.spans for r in out.collect()}
    assert not spans[0] and not spans[3] and not spans[None]
    assert [(s.start, s.end, s.copied, s.n_owners, s.n_matches) for s in spans[9]][0] == (3, 31, False, 1, 2)
    assert out.count() == len(data)
    red = {r.doc_id: r.text for r in secrets.redact(df, F.col("hash"), F.col("source")).collect()}
    assert red[9] == "my <secret> é" and red[0] == f"use {example} here" and red[None] is None


def test_redaction_removes_the_base_secrets(spark):
    docs = [(i, t, "s", "en") for i, t in enumerate(texts(200, 2, PARTS))]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, lang string")
    out = {r.doc_id: r.text for r in secrets.redact(df, F.col("lang"), F.col("source")).collect()}
    spans = {r.doc_id: r.spans for r in secrets.scan(df, F.col("lang"), F.col("source")).collect()}
    for i, t, *_ in docs:
        want, at = "", 0
        for s in spans[i] or []:
            if s.start >= at:
                want += t[at : s.start] + "<secret>"
            at = max(at, s.end)
        assert out[i] == (want + t[at:] if spans[i] else t)


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    pool = ["", "  ", "short", "A line that is long enough " * 2, "\tÉa line that is long enough É ", "ÉA LINE THAT IS LONG ENOUGH é"] + [f"line number {i} of the pool" for i in range(12)]
    docs = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    docs += [(None, pool[3]), (100, docs[9][1])]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n_lines int, _pos int")
    out = line_dedup.dedup_lines(df, batches=3, fanout=2)
    assert "_pos" in out.columns
    got = sorted(rows(out, "doc_id", "n_lines", "n_dropped", "text"), key=str)
    assert got == sorted(brute.kept_lines(docs), key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (5, 3)])
def test_line_dedup_does_not_hang_on_the_batches(spark, batches, fanout):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text")
    out = sorted(rows(line_dedup.dedup_lines(docs, batches=batches, fanout=fanout), "doc_id", "n_lines", "n_dropped", "text"))
    assert out == sorted(brute.kept_lines(rows(docs, "doc_id", "text")))


def test_a_line_hash_is_in_one_run_only(spark):
    """The anti-join decides what a batch adds: fresh hashes become its run, known ones update counts."""
    from collections import Counter

    from gridspark.llm.common import Staged
    docs = [(i, "\n".join(f"a line of the pool with number {k}" for k in range(40) if (i * 7 + k) % (1 + k % 9) == 0)) for i in range(60)]
    staged = Staged(spark, "test-runs")
    lines = staged.write(line_dedup.line_hashes(spark.createDataFrame(docs, "doc_id long, text string"), 20, 6))
    runs, updates = line_dedup.runs_of(lines, staged, 6, 2)
    key = lambda r: (r._ld_h1, r._ld_h2)
    held = Counter(key(r) for run in runs for r in run.collect())
    changed = [[key(r) for r in u.collect()] for u in updates]
    assert set(held.values()) == {1} and len(held) > 30 and len(runs) == 2  # six batches of fanout 2: levels of 4 and 2 batches
    assert len(changed) == 5 and all(changed) and all(k in held for u in changed for k in u)
    n = Counter(key(r) for r in lines.select("_ld_doc", *line_dedup.KEY).distinct().collect())
    assert {key(r): r.n_docs for r in line_dedup.totals(runs, updates).collect()} == n


def test_quality_counts_equal_brute_force(spark):
    docs = list(enumerate(texts(300, 4, ["a", "b ", " c ", "word ", "word ", "\n", "#", "*", "line one\n", "\x1c", "\xa0", "é ", "\t"])))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(*d, True) for d in docs], "doc_id long, text string, kept boolean")
    out = quality.judge(df, quality.fit(df, labels))
    got = {r.doc_id: r for r in out.collect()}
    for i, t in docs:
        want = brute.base_quality(t)
        assert tuple(got[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want, t
        assert got[i].kept == (not want[5])  # without labels every line is content


def test_quality_keeps_the_good_and_drops_the_bad(spark):
    out = entries.op8_quality_rules(spark, SF001).join(spark.read.parquet(f"{SF001}/labels.parquet"), "doc_id").toPandas()
    held = out[out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0) & ~out.base_failed]
    assert held[held.quality == 1].kept.mean() > 0.98
    assert held[held.quality == 0].kept.mean() < 0.5


def test_keywords_have_ascii_letters_only():
    assert not re.search(brute.ASSIGN, "ſecret=abcdefgh")
