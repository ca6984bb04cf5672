"""Packing, token counts, chat formatting and top-k search against the libraries and brute force."""

import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import SF001
from gridspark.llm import chat, entries, packing, tokens, topk

WORD, BYTE = (public_tokenizers.path(f"{n}.json") for n in ("word_bpe_49k", "byte_bpe_50k"))
PIECES = ["a", "b", "the ", " ", "  ", "\n", "\x1c", "\x85", "é", "!", "1", "'s", "<|endoftext|>", "<|startoftext|>", "　", "word", "É", "é", "́", "İ", "Σ", "你", "\t", "😀"]


def mixed(rng, n, blanks=True):
    return "".join(rng.choice(PIECES if blanks else ["a", "b", "é", "!"]) for _ in range(n))


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


def test_counts_equal_the_library_whatever_the_chunks(byte):
    rng = random.Random(1)
    for chunk, overlap in ((50, 5), (200, 20), (1000, 64)):
        counter = tokens.Counter(BYTE, chunk, overlap)
        for n in (10, 60, 400, 3000):
            for blanks in (True, False):
                for _ in range(8):
                    t = mixed(rng, n, blanks)
                    assert counter.count(t) == len(byte.encode(t, add_special_tokens=False).ids), t


def test_counts_of_plain_and_odd_stretches_of_one_batch(byte):
    """Words that are learned together and stretches that are learned alone."""
    texts = ["A plain text, of words.", "word", "", " word1 x_y <|endoftext|>", "the  end\n", "12 \x1c 34"]
    assert tokens.Counter(BYTE, 65_536, 1024).count_all(texts) == [len(byte.encode(t, add_special_tokens=False).ids) for t in texts]


def test_count_query(spark, byte):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in entries.op6_token_counts(spark, SF001).collect():
        n = len(byte.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 1024)


def test_word_ids_equal_the_library():
    word, ids, rng = Tokenizer.from_file(WORD), tokens.WordIds(WORD), random.Random(2)
    for _ in range(400):
        t = mixed(rng, rng.randint(0, 60))
        assert list(np.frombuffer(ids.encode(t), "<u4")) == word.encode(t, add_special_tokens=False).ids, t


def test_word_ids_of_simple_texts_and_small_caches(monkeypatch):
    """Texts of plain words and marks take the short way; with a small cache words move between its halves."""
    monkeypatch.setattr(tokens, "MAX_CACHED", 60)
    word, ids, rng = Tokenizer.from_file(WORD), tokens.WordIds(WORD), random.Random(3)
    parts = ["Word", "word", "École", "ÿß", "e-mail", "1990", "x", ".", ",", "..", ".,", "a.b", "(", "\"", " ", " ", " ", "\n", "Ünder.", "end,", "A1.", "x" * 70]
    for _ in range(600):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert list(np.frombuffer(ids.encode(t), "<u4")) == word.encode(t, add_special_tokens=False).ids, t


def check_packing(rows, want, limits):
    """Every id is in one piece, offsets have no gap, limits hold. Returns the share of padding."""
    at, used = defaultdict(int), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert list(r.ids) == want[r.doc_id][r.start : r.start + r.length]
        at[r.doc_id] += r.length
        used[r.sequence_id].append(r)
    assert at == {i: len(w) for i, w in want.items()}
    real = padded = 0
    for pieces in used.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == list(np.cumsum([0, *[p.length for p in pieces]])[:-1])
        n = sum(p.length for p in pieces)
        assert n <= limits[0] and len(pieces) <= limits[1] and sum(p.loss_tokens for p in pieces) <= limits[2]
        real, padded = real + n, padded + (n if n & (n - 1) == 0 else limits[0])
    return 1 - real / max(1, padded)


@pytest.mark.parametrize("limits", [(64, 8, 64), (64, 3, 40), (32, 32, 10)])
def test_packing_keeps_the_limits(spark, limits):
    rng, word = random.Random(3), Tokenizer.from_file(WORD)
    docs = [(i, mixed(rng, rng.choice([0, 3, 20, 400]))) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame([(*d, "p q r s", 1) for d in docs], "doc_id long, text string, prompt string, length int").repartition(3)
    want = {i: [*word.encode("p q r s").ids, *word.encode(t or "", add_special_tokens=False).ids, 1] for i, t in docs}
    out = packing.pack(df, WORD, 1, *limits, pool=40, prompt="prompt").collect()
    check_packing(out, want, limits)
    assert sum(r.loss_tokens for r in out) == sum(len(w) - 4 for w in want.values())


def test_packing_query(spark):
    word = Tokenizer.from_file(WORD)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    want = {r.doc_id: [*word.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs.collect()}
    assert check_packing(packing.pack(docs, WORD, 1).collect(), want, (2048, 256, 2048)) < 0.01
    for r in entries.op2_packing(spark, SF001).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_chat_round_trip(spark):
    rng = random.Random(4)
    bits = ["\\", "### ", "</turn>", "\n", ": ", ":", "é", "ok", "\\\\", "<", "/turn>", "#", "</turn>\n### user: ", "😀", " "]
    say = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
    data = [(c, t, rng.choice(["user", "assistant", "system", "a:b### ", "", None]), rng.choice([say(), None, ""])) for c in [None, *range(80)] for t in range(rng.randint(1, 6))]
    data += [(500, 0, "assistant", "w " * 50_000), (500, 1, "assistant", "x"), (501, 0, "user", "same"), (501, 0, "user", "same")]
    df = spark.createDataFrame([(*d, "clash") for d in data], "conv_id long, turn long, role string, text string, formatted string")
    for batch in ("2", "10000"):  # conversations that go on in the next batch
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            out = {r.conv_id: r for r in chat.format_chats(df.repartition(4)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(out) == {d[0] for d in data}
        for conv, r in out.items():
            turns = sorted(((t, x or "", y or "", x is not None, y is not None) for c, t, x, y in data if c == conv), key=lambda t: (t[0], t[3], t[1], t[4], t[2]))
            assert chat.parse(r.formatted) == [(x, y) for _, x, y, *_ in turns]
            assert [chat.unescape(r.formatted[s.start : s.end]) for s in r.loss] == [y for _, x, y, *_ in turns if x == "assistant"]
            assert r.n_turns == len(turns)


def best(vectors, k):
    """Brute-force answer for (id, vector) rows."""
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out, asked = [], {}
    for (i, v), (_, raw) in zip(ok, [(i, v) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]):
        if i % 20 == 0 and (i not in asked or raw < asked[i][0]):
            asked[i] = (raw, v)
    for i, (_, q) in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    v = [(int(i), [float(np.float32(x)) for x in rng.normal(size=12) / 3]) for i in range(300)]
    same = [float(np.float32(x)) for x in rng.normal(size=12)]
    v += [(1000 + i, same) for i in range(120)] + [(2000, None), (2001, [1.0, None]), (2020, [float("nan")] * 12), (2040, [float("inf")] * 12), (2060, []), (2080, [0.5]), (40, same), (41, same), (None, same)]
    df = spark.createDataFrame([(*x, 1) for x in v], "vec_id long, embedding array<float>, score int").repartition(5)
    for block, q_block in ((64, 8), (8192, 1024)):
        out = topk.search(df, F.col("vec_id") % 20 == 0, block=block, query_block=q_block)
        assert sorted(map(tuple, out.select("query_id", "rank", "vec_id", "score").collect())) == best(v, 20)


def test_topk_with_few_candidates_and_large_numbers(spark):
    v = [(0, [1e9, -1e9]), (20, [1e9, 1e9]), (1, [-1e9, 3.0])]
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>")
    out = topk.search(df, F.col("vec_id") % 20 == 0)
    assert sorted((r.query_id, r.rank, r.vec_id) for r in out.collect()) == [(q, r, j) for q, r, j, _ in best(v, 20)]
    assert topk.search(df.where("vec_id > 5 and vec_id < 7"), F.col("vec_id") % 20 == 0).count() == 0


def test_sha_helper():
    assert brute.sha("") == chat._sha("")
