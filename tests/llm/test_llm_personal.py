"""Personal data: base spans against plain patterns, the rest by invariants and built cases."""

import random

import brute

from conftest import SF001
from gridspark.llm import entries, pii
from pyspark.sql import functions as F


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def check(rows, texts):
    """Base counts, digests and spans of digest rows; the added spans by row."""
    added = []
    for r, t in zip(rows, texts, strict=True):
        base = brute.base_personal(t)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.BASE], t[:200]
        assert r.base_sha256 == brute.sha(joined(base))
        spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)]
        assert [s for s in spans if s[0] in pii.BASE] == base
        more = [s for s in spans if s[0] not in pii.BASE]
        assert r.n_added == len(more) and all(b[2] <= s <= e or e <= b[1] for _, s, e in more for b in base)
        added.append([(k, t[s:e]) for k, s, e in more])
    return added


def test_query_follows_the_plain_patterns(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    rows = sorted(entries.op12_personal_data(spark, SF001).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == sorted(texts)
    check(rows, [texts[r.doc_id] for r in rows])
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 50


def test_random_texts(spark):
    """Strings of the patterns' own characters: overlaps, chains, failing matches without retries."""
    rng = random.Random(8)
    parts = ["1", "4", "255", "256", "007", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b-c", "x.y", "%", "é", "\n", "4111111111111111", "49927398716", "1.2.3.4"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    texts += ["a@b.c+x@e.f@g.h", "1.2.3.4.5.6.7.8", "1.2.3.4.5", "+1-+12345678", "0000000255.1.1.1", "9" * 50_000, "a" * 60_000 + "@b.c", "1 " * 40_000, "a." * 30_000 + "@x." + "b." * 9_000 + "c", "1." * 20_000 + "1", "+" + "1(" * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(sorted(pii.digest(pii.scan(df)).collect(), key=lambda r: r.doc_id), texts)


def corpus(n=1500):
    """Texts with base spans, with look-alikes in the same places and with other numbers."""
    rng, texts = random.Random(9), []
    number = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    for i in range(n):
        card = "4" + number(14)
        card += next(c for c in "0123456789" if brute.luhn(card + c))
        phone = f"({200 + rng.randrange(700)}) 555-{number(4)}"
        ip = ".".join(str(rng.randrange(256)) for _ in range(4))
        mail = f"{rng.choice('abcdef')}{rng.choice('ghij')}.{number(2)}@mail{rng.randrange(9)}"
        texts += [f"pay by {card} now", f"call +1 {phone} today", f"host {ip} is up", f"write to {mail}.example.com soon", f"in 20{number(2)} there were {number(3)} of {number(1)}.{number(2)}"]
        texts += [f"order 7{number(7)} came" if i % 2 else f"on 2{number(3)}-0{number(1)}-1{number(1)} it was"]
        if i % 40 == 0:
            bad = card[:-1] + str((int(card[-1]) + 1) % 10)
            texts += [f"pay by {bad} now", f"call {phone} today", f"host {rng.choice([260, 300, 499, 777, 999])}.{ip.split('.', 1)[1]} is up", f"write to {mail} soon", f"write to {mail.replace('@', ' [at] ')} [dot] example [dot] com soon"]
    return texts


def test_look_alikes_are_found_and_plain_numbers_left(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(pii.digest(pii.scan(df)).collect(), key=lambda r: r.doc_id)
    added = check(rows, texts)
    look_alike = [i for i, t in enumerate(texts) if not brute.base_personal(t) and t.split()[0] in ("pay", "call", "host", "write")]
    plain = [i for i, t in enumerate(texts) if t.split()[0] in ("in", "order", "on")]
    by_kind = {k: [bool(added[i]) for i in look_alike if texts[i].startswith(k)] for k in ("pay", "call", "host", "write")}
    assert all(sum(v) >= 0.8 * len(v) for v in by_kind.values()), {k: (sum(v), len(v)) for k, v in by_kind.items()}
    assert sum(bool(added[i]) for i in plain) <= 0.01 * len(plain)
    assert any(k == "written" for a in added for k, _ in a)


def test_redaction_and_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", "b"), (None, "to a.b@c.de or 1.2.3.4, Grüße", "c"), (4, "a.b@c.de a.b@c.de", "d"), (4, "a.b@c.de a.b@c.de", "d"), (5, "+49 (30) 1234567 / 4111111111111111", "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, spans string").withColumn("n_email", F.lit("x"))
    scanned = pii.scan(df)
    assert scanned.columns == ["doc_id", "n_email", "spans"]
    rows = sorted(pii.digest(scanned).collect(), key=lambda r: (r.doc_id or 3, r.base_sha256))
    check(rows, [d[1] or "" for d in docs])
    spans = lambda t: F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for _, s, e in brute.base_personal(t)])
    text = docs[2][1]
    one = df.where("doc_id is null").select(pii.redact(F.col("text"), spans(text)).alias("x")).first()
    assert one.x == "to <private> or <private>, Grüße"
    both = df.where("doc_id = 5").select(pii.redact(F.col("text"), spans(docs[5][1])).alias("x")).first()
    assert both.x == "<private> / <private>" and len(brute.base_personal(docs[5][1])) == 2
    assert pii.scan(df.limit(0)).count() == 0
    over = F.array(*[F.struct(F.lit(s).alias("start"), F.lit(e).alias("end")) for s, e in ((0, 5), (3, 8), (4, 6), (10, 12))])
    assert df.where("doc_id = 5").select(pii.redact(F.lit("abcdefghijklmn"), over).alias("x")).first().x == "<private>ij<private>mn"
