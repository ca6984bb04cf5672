"""SentencePiece lattice against the library, enumeration and the round trip."""

import random

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from conftest import SF0001
from gridspark.llm import entries, lattice

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BITS = ["the", "tion", "er", "a", "b", " ", "  ", "\n", "é", "ñ", "你", "😀", ",", ".", "!!", "\t", "ing", "AKIA", "0", "x" * 70, "▁"]


@pytest.fixture(scope="module")
def pieces(spark):
    return lattice.read_pieces(spark, MODEL)


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def texts(n, seed):
    rng = random.Random(seed)
    return [None, "", " ", "\n", "word", "x" * 3000] + ["".join(rng.choice(BITS) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def ids_of(spark, words, pieces):
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    return {r.word: list(r.ids) for r in lattice.encode_words(df, pieces).collect()}


def test_ids_equal_the_library(spark, pieces, library):
    docs = texts(150, 1)
    words = sorted({u for t in docs for u in lattice.units(t)})
    ids = ids_of(spark, words, pieces)
    assert set(ids) == set(words)
    for t in docs:
        assert [i for u in lattice.units(t) for i in ids[u]] == library.encode(t or ""), t


def test_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    out = {r.doc_id: r for r in entries.op7_sentencepiece(spark, SF0001).collect()}
    check(docs, out, library)


def check(docs, out, library):
    for d in docs:
        ids, digest, at = library.encode(d.text or ""), 0, 0
        unit = lattice.units(d.text)
        for place, u in enumerate(unit):
            alone = library.encode(u.replace("▁", " ")[1:]) if u.startswith("▁") and len(u) > 1 else None
            n = len(alone) if alone is not None else next(k for k in range(1, len(ids) - at + 1) if library.decode(ids[at : at + k]) and _text(library, ids[at : at + k]) == u.replace("▁", " "))
            h = np.array([xxhash.xxh3_64_intdigest(np.array(ids[at : at + n], "<u4").tobytes())], np.uint64).view(np.int64)
            digest ^= int(lattice.at_place(h, np.array([place]))[0])
            at += n
        assert at == len(ids)
        assert (out[d.doc_id].n_units, out[d.doc_id].n_pieces, out[d.doc_id].ids_digest, out[d.doc_id].lossless) == (len(unit), len(ids), digest, True)


def _text(library, ids):
    out = b"".join(bytes([int(library.id_to_piece(i)[3:-1], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in ids)
    return out.decode(errors="replace")


def test_rare_words_give_the_same(spark, pieces):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts(60, 2))] + [(None, "a b", "x"), (1, "", "x")], "doc_id long, text string, n_pieces string")
    some, none = (sorted(map(tuple, lattice.encode_texts(df, pieces, k).collect()), key=str) for k in (20, 0))
    assert some == none and len(some) == df.count()


def test_decoding(spark, pieces, library):
    docs = [(i, library.encode(t)) for i, t in enumerate(texts(60, 3)[4:])]
    out = {r.key: r.text for r in lattice.decode(spark.createDataFrame(docs, "key long, ids array<int>"), "key", pieces).collect()}
    for i, ids in docs:
        assert out[i][1:] == library.decode(ids), ids


def best(word, score):
    """Best sum over all ways to cut a word; characters without a piece cost a million."""
    top = [0.0] + [-np.inf] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            top[e] = max(top[e], top[s] + score.get(word[s:e], -1e6 if e == s + 1 else -np.inf))
    return top[-1]


def test_unigram_fold_finds_the_best_path(spark):
    rng = random.Random(4)
    score = {p: -rng.random() * 10 for p in {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(40)}}
    score.pop("c", None)
    rows = [(p, i, s, p.encode()) for i, (p, s) in enumerate(score.items(), 300)] + [(None, b, 0.0, bytes([b])) for b in range(256)]
    table = lattice.piece_table(spark, rows, False, 0)
    by_id = {i: (p, s) for p, i, s, _ in rows}
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 12))) for _ in range(80)})
    for w, ids in ids_of(spark, words, table).items():
        assert b"".join(by_id[i][0].encode() if by_id[i][0] else bytes([i]) for i in ids).decode() == w
        cost, k = 0.0, 0
        while k < len(ids):  # a character without a piece is as many bytes as it has
            lone = by_id[ids[k]][0] is None
            cost += -1e6 if lone else by_id[ids[k]][1]
            k += 2 if lone and ids[k] >= 0xC0 else 1
        assert abs(cost - best(w, score)) < 1e-6, w


def test_empty_table(spark, pieces):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lattice.encode_texts(docs, pieces).count() == 0
    assert docs.where(F.lit(True)).count() == 0


def test_documents_have_their_ids_and_decoded_text(spark, pieces, library):
    docs = list(enumerate(texts(80, 5)))
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, ids string")
    for hot in (0, 20, 200_000):
        out = {r.doc_id: r for r in lattice.encode_texts(df, pieces, hot).collect()}
        assert len(out) == len(docs)
        for i, t in docs:
            assert list(out[i].ids) == library.encode(t or ""), t
            assert out[i].decoded == library.decode(out[i].ids), t
            assert len(out[i].ends) == len(lattice.units(t)) and (out[i].ends[-1] if out[i].ends else 0) == len(out[i].ids)
            assert out[i].lossless == ((t or "") == out[i].decoded) == ("▁" not in (t or ""))


def test_digest_comes_from_the_ids_of_the_document(spark, pieces):
    df = spark.createDataFrame(list(enumerate(["a b", "a▁b", None])), "doc_id long, text string")
    out = {r.doc_id: r for r in lattice.digest(lattice.encode_texts(df, pieces)).collect()}
    assert out[0].ids_digest == out[1].ids_digest and [out[i].lossless for i in range(3)] == [True, False, True]
    assert (out[2].n_units, out[2].n_pieces, out[2].ids_digest) == (0, 0, 0)


def test_ids_and_texts_meet_packed(spark, pieces):
    df = spark.createDataFrame(list(enumerate(texts(20, 6))), "doc_id long, text string")
    plan = lattice.encode_texts(df, pieces)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan  # no id is exploded, shuffled or joined for its text
    assert plan.count("RepartitionByExpression [chunk") == 2


def test_merges_of_late_pieces(spark):
    rng = random.Random(7)
    found = 0
    for seed in range(3):
        made = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(40)})
        rng.shuffle(made)
        rows = [(c, 300 + i, 0.0, c.encode()) for i, c in enumerate("abc")] + [(p, 400 + i, -float(i), p.encode()) for i, p in enumerate(made)]
        table = lattice.piece_table(spark, rows + [(None, b, 0.0, bytes([b])) for b in range(256)], True, 0)
        cost, ids = {p: -score for p, _, score, _ in rows if len(p) > 1}, {p: i for p, i, _, _ in rows}
        found += len(lattice.late_pieces(cost))
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 20))) for _ in range(150)})
        out = ids_of(spark, words, table)
        for w in words:
            parts = list(w)
            while ways := [(cost[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in cost]:
                k = min(ways)[1]
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert out[w] == [ids[p] for p in parts], w
    assert found


def test_rows_in_another_order_are_no_wrong_ids(spark, pieces):
    docs = [(i, f"word{i} other{i}") for i in range(6)]
    order = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    moved = order.orderBy(F.desc("doc_id")).coalesce(1)
    found = lattice.packed_rows(order, 1000).select("chunk").first()
    assert found != lattice.packed_rows(moved, 1000).select("chunk").first()
