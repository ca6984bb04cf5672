"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of five-word shingles (64-bit hashes); texts with
   the same set form a class, and one row stands for the class.
2. The signature of a class (``bands * rows`` minima) is cut into bands; rows
   with an equal band share a bucket. Each member of a bucket is paired with
   the bucket's hub (the class with the most copies) and never with all others.
3. A pair is compared signature batch by batch. After each batch it is dropped
   if the posterior probability of a similarity of the threshold or more is
   below ``miss`` (uniform prior on the similarity). Survivors are verified on
   their full sets.
4. Verified links join classes into components. What is left are pairs of a
   bucket whose members are in different components: members outside the
   bucket's largest component are paired with the members of other components.
   Members of buckets above ``split_above`` rows get a second, far more
   selective banding first (``rows2`` minima to a band), so that a large group
   of half-similar texts yields few pairs. A pair of a bucket is left out only
   where it cannot be a link: two members of one hub share at most what either
   of them shares with the hub, unless they share a shingle beyond it; members
   that do so meet in a bucket of that shingle.
5. The same verification, and the components of all links.

Defined results: null or empty text, or one without words: empty set, linked
with nothing; fewer words than a shingle: the whole sequence is the one
shingle; rows without an id are linked with nothing and have a null component;
rows that repeat an id count as one document: each of its different texts is
compared, and whatever is linked with one of them is in one component (a row
without words stays by itself, also beside other texts of its id);
an empty table gives an empty table; other columns of the input are ignored.

Scale: nothing is broadcast and nothing is collected. Equal sets are merged by
a partial aggregate before any pair is made, so a group of copies that holds a
third of all rows costs one row per task. Signatures are kept for one row of a
class; sets are made again from the texts of the paired rows only. The bandings
follow from the threshold: the chance to miss a link of similarity exactly the
threshold is at most ``miss`` (1e-6) in the first banding and ``miss2`` (1e-5)
in the second. At 0.85 these are 24 bands of 5 and 300 of 20, at 0.8 35 bands
of 5 and 300 of 14.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, slices, texts_of

MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    mixed = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        mixed = _mix(mixed * MIX + h[k : k + n])
    return np.unique(mixed)


def _constants(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, count, dtype=np.uint64), rng.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray], count: int, seed: int, block: int = 16384) -> np.ndarray:
    """Signature matrix: for each non-empty set the least of its hashes under ``count`` permutations."""
    xor, mul = _constants(count, seed)
    out = np.empty((len(sets), count), np.uint32)
    i = 0
    while i < len(sets):  # as many sets at a time as fit the cache
        j, size = i + 1, len(sets[i])
        while j < len(sets) and size + len(sets[j]) <= block:
            size, j = size + len(sets[j]), j + 1
        flat = np.concatenate(sets[i:j])
        starts = np.cumsum([0, *map(len, sets[i : j - 1])])
        for k in range(count):
            out[i:j, k] = np.minimum.reduceat((flat ^ xor[k]) * mul[k], starts) >> np.uint64(32)
        i = j
    return out


def bands_for(threshold: float, rows: int, miss: float) -> int:
    """The fewest bands of ``rows`` minima that miss a pair of similarity ``threshold`` with a probability of at most ``miss``."""
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows))) if threshold < 1 else 1


def rows_for(threshold: float, bands: int, miss: float) -> int:
    """The most minima to a band with which ``bands`` bands miss a pair of similarity ``threshold`` with a probability of at most ``miss``."""
    return max(1, math.floor(math.log(-math.expm1(math.log(miss) / bands)) / math.log(threshold))) if threshold < 1 else 32


def band_keys(signature: np.ndarray, bands: int, salt: int) -> np.ndarray:
    """A 64-bit key for each row and band."""
    parts = signature.reshape(len(signature), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + np.uint64(salt), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = _mix(key * MIX + parts[:, :, k])
    return key


def _wide(values: np.ndarray, kind: pa.DataType, width: int) -> pa.Array:
    """A list array with ``width`` values in each row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width), pa.int32()), pa.array(values.ravel(), kind))


def with_text_key(docs: DataFrame) -> DataFrame:
    """(id, t, text): the id and a hash of the text tell the rows of a repeated id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")


def describe(docs: DataFrame, bands: int, rows: int, width: int, seed: int) -> DataFrame:
    """id, t, n_shingles, 128-bit hash of the set and signature (null for the empty set) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in texts_of(b)]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig: list = [None] * len(sets)
            for i, s in zip(full, minima([sets[i] for i in full], bands * rows, seed)):
                sig[i] = s.tobytes()
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                b.column("id"), b.column("t"), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())],
                names=["id", "t", "n_shingles", "digest", "sig"])

    return with_text_key(docs).mapInArrow(run, "id long, t long, n_shingles long, digest binary, sig binary")


def first_bands(nodes: DataFrame, bands: int) -> DataFrame:
    """(key, id, copies): the buckets of the first banding."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            if b.num_rows:
                sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("copies"), _wide(band_keys(sig, bands, 0).view(np.int64), pa.int64(), bands)],
                    names=["id", "copies", "keys"])

    keys = nodes.select("id", "copies", "sig").mapInArrow(run, "id long, copies long, keys array<long>")
    return keys.select(F.explode("keys").alias("key"), "id", "copies")


def second_bands(sets: DataFrame, bands: int, rows: int, seed: int) -> DataFrame:
    """(key, id, copies) of the selective banding, from full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            if b.num_rows:
                arrays = [np.asarray(s.values).view(np.uint64) for s in b.column("s")]
                keys = band_keys(minima(arrays, bands * rows, seed + 1), bands, 1 << 32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), b.column("copies"), _wide(keys.view(np.int64), pa.int64(), bands)], names=["id", "copies", "keys"])

    keys = sets.select("id", "copies", "s").mapInArrow(run, "id long, copies long, keys array<long>")
    return keys.select(F.explode("keys").alias("key"), "id", "copies")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, copies, s) of the rows in ``wanted`` (doc, t, id, copies), their sets made again from the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t, width) for t in texts_of(b)]
            ends = np.cumsum([0, *map(len, sets)])
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("copies"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                names=["id", "copies", "s"])

    texts = with_text_key(docs).withColumnRenamed("id", "doc").join(wanted.hint("shuffle_hash"), ["doc", "t"]).dropDuplicates(["id", "t"])
    return texts.select("id", "copies", "text").mapInArrow(run, "id long, copies long, s array<long>")


def prune_limits(count: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(compared, least number of equal minima to go on) after each batch.

    With a uniform prior, ``m`` equal of ``n`` gives the posterior Beta(m + 1,
    n - m + 1); a pair is dropped where its mass above ``threshold`` is below
    ``miss``. Summed on a grid of 20,000 points.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    limits = []
    for n in [*range(batch, count, batch), count]:
        least = 0
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            mass = np.exp(log - log.max())
            if mass[grid >= threshold].sum() / mass.sum() >= miss:
                least = m
                break
        limits.append((n, least))
    return limits


def sequential(pairs: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """The pairs (a, b, sig_a, sig_b) that no batch of the signature rules out, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, -1) for c in ("sig_a", "sig_b"))
                alive, equal, done = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), 0
                for n, least in limits:
                    equal = equal + (x[alive, done:n] == y[alive, done:n]).sum(1)
                    alive, equal, done = alive[equal >= least], equal[equal >= least], n
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(alive)) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, staged: Staged) -> DataFrame:
    """(id, component): the smallest id that each linked id reaches.

    Each round gives every node the smallest label among its neighbours and
    itself and then the label of that label, until nothing changes; both are
    partial minima, so a hub with many links is no hot task.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged.write(both.distinct())
    label = staged.write(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")))
    while True:
        near = both.join(label, both["b"] == label["id"]).groupBy("a").agg(F.min("component").alias("near"))
        step = label.join(near, label["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("low"))
        jump = label.select(F.col("id").alias("low"), F.col("component").alias("lower"))
        moved = step.join(jump, "low", "left").select("id", F.col("component").alias("was"), F.least("low", "lower").alias("component"))
        new = staged.write(moved)
        changed = new.where("component <> was").limit(1).count()
        staged.drop(label)
        label = new
        if not changed:
            staged.drop(both)
            return label.select("id", "component")


def numbered(known: DataFrame, staged: Staged) -> tuple[DataFrame, DataFrame]:
    """``known`` with ``doc`` (its id) and an ``id`` that stands for one set only; and the ids that have several sets.

    An id keeps its number for its least digest; its other sets get numbers
    above all ids, from a written table, so a task that runs again sees the same.
    """
    top = known.agg(F.max("id")).first()[0]
    sets = known.groupBy("id").agg(F.min("digest").alias("least"), F.max("digest").alias("most"))
    several = staged.write(sets.where("least <> most").select(F.col("id").alias("doc"), "least"))
    own = known.withColumn("doc", F.col("id"))
    if several.isEmpty():
        return own, several.select("doc")
    more = staged.write(own.select("doc", "digest").join(several, "doc").where("digest <> least").select("doc", "digest").distinct())
    more = staged.write(more.withColumn("extra", F.lit(top) + 1 + F.monotonically_increasing_id()))
    given = own.join(more, ["doc", "digest"], "left")
    return given.withColumn("id", F.coalesce("extra", "id")).drop("extra"), several.select("doc")


def near_dups(
    docs: DataFrame, *, threshold_pct: int = 85, width: int = 5, bands: int | None = None, rows: int = 5, split_above: int = 32,
    bands2: int = 300, rows2: int | None = None, batch: int = 24, miss: float = 1e-6, miss2: float = 1e-5, seed: int = 7,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (doc_id, text).

    ``bands`` and ``rows2`` follow from the threshold, ``miss`` and ``miss2`` unless they are given.
    """
    staged = Staged(docs.sparkSession, "minhash")
    bands = bands or bands_for(threshold_pct / 100, rows, miss)
    rows2 = rows2 or rows_for(threshold_pct / 100, bands2, miss2)
    limits = prune_limits(bands * rows, batch, threshold_pct / 100, miss)
    rows_ = staged.write(describe(docs, bands, rows, width, seed))
    known, several = numbered(rows_.where("digest is not null and id is not null"), staged)
    classes = staged.write(known.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    in_class = known.join(classes, "digest")
    reps = in_class.where("id = rep").select("id", "doc", "t", "n_shingles", "sig", "copies")
    reps = staged.write(reps.dropDuplicates(["id"]))   # rows of one number have one set
    # the classes of all texts of an id are one component
    texts_of_id = known.select("doc", "digest").join(several, "doc", "left_semi").distinct().join(classes, "digest").select("doc", "rep").distinct()
    low = texts_of_id.groupBy("doc").agg(F.min("rep").alias("a"))
    same_id = staged.write(texts_of_id.join(low, "doc").where("rep <> a").select("a", F.col("rep").alias("b")).distinct())

    def heads(bands_of: DataFrame) -> DataFrame:
        """Size and hub of each bucket of two or more."""
        best = F.max(F.struct("copies", (-F.col("id")).alias("neg")))
        found = bands_of.groupBy("key").agg(F.count(F.lit(1)).alias("size"), best.alias("top")).where("size > 1")
        return found.select("key", "size", (-F.col("top.neg")).alias("hub"))

    def bucketed(bands_of: DataFrame) -> DataFrame:
        rows_of = staged.write(bands_of)
        head = staged.write(heads(rows_of))
        out = staged.write(rows_of.join(head, "key").select("key", "id", "size", "hub"))
        staged.drop(rows_of, head)
        return out

    in_bucket = bucketed(first_bands(reps, bands))
    crowded = in_bucket.where(F.col("size") > split_above).select("id").distinct()
    crowded = full_sets(docs, reps.join(crowded, "id", "left_semi").select("doc", "t", "id", "copies"), width)
    in_second = bucketed(second_bands(crowded, bands2, rows2, seed))

    def compared(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(a, b, both, n_a, n_b) of the pairs (a < b) that pass the sequential test, from full sets; and these sets."""
        sig_a, sig_b = (reps.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}")) for c in ("a", "b"))
        near = pairs.join(sig_a, "a").join(sig_b, "b").where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold_pct)
        alive = staged.write(sequential(near, limits))
        wanted = alive.select(F.col("a").alias("id")).union(alive.select("b")).distinct()
        wanted = reps.join(wanted, "id", "left_semi").select("doc", "t", "id", "copies")
        sets = staged.write(full_sets(docs, wanted, width).select("id", "s"))
        set_a, set_b = (sets.select(F.col("id").alias(c), F.col("s").alias(f"s_{c}")) for c in ("a", "b"))
        out = staged.write(alive.join(set_a, "a").join(set_b, "b").select(
            "a", "b", F.size(F.array_intersect("s_a", "s_b")).alias("both"), F.size("s_a").alias("n_a"), F.size("s_b").alias("n_b")))
        staged.drop(alive)
        return out, sets

    enough = lambda both, n_a, n_b: both * 100 >= (n_a + n_b - both) * threshold_pct
    linked = lambda t: t.where(enough(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))

    stars = [t.where("id <> hub").select("id", "hub", *ordered("id", "hub")) for t in (in_bucket, in_second)]
    star = staged.write(reduce(DataFrame.union, stars).distinct())
    tried = star.select("a", "b").distinct()
    exact, sets = compared(tried)
    links = linked(exact)
    label = components(links.union(same_id), staged)

    # the hub most like each member, and the shingles that they share
    own = F.when(F.col("id") == F.col("a"), F.col("n_a")).otherwise(F.col("n_b"))
    like = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both"))
    best = F.max(F.struct(like.alias("j"), (-F.col("hub")).alias("neg"), "both", own.alias("n"))).alias("m")
    centre = star.join(exact, ["a", "b"]).groupBy("id").agg(best).select("id", (-F.col("m.neg")).alias("hub"), "m.both", "m.n")
    centre = staged.write(centre.join(label, "id", "left").select("id", "hub", "both", "n", F.coalesce("component", "id").alias("c")))
    # members of one hub in several components: the shingles that they do not share with it are further buckets
    split = centre.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("hub")
    beyond = staged.write(centre.join(split, "hub").select("id", "hub")).join(sets, "id")
    beyond = beyond.join(sets.select(F.col("id").alias("hub"), F.col("s").alias("s_hub")), "hub")
    beyond = beyond.select("id", F.explode(F.array_except("s", "s_hub")).alias("shingle"), "hub")
    beyond = beyond.select(F.xxhash64("hub", "shingle").alias("key"), "id", F.lit(False).alias("plain"))

    buckets = in_bucket.where(F.col("size") <= split_above).select("key", "id").union(in_second.select("key", "id"))
    buckets = buckets.withColumn("plain", F.lit(True)).union(beyond)
    member = staged.write(buckets.join(label, "id", "left").select("key", "id", "plain", F.coalesce("component", "id").alias("c")))
    group = staged.write(member.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")))
    top = group.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "c")).alias("t")).where("groups > 1").select("key", F.col("t.c").alias("top"))
    mixed = staged.write(member.join(top, "key").join(centre.drop("c"), "id", "left"))
    x = mixed.where("c <> top").select("key", *[F.col(c).alias(f"x_{c}") for c in ("id", "c", "hub", "both", "n", "plain")])
    y = mixed.select("key", "top", *[F.col(c).alias(f"y_{c}") for c in ("id", "c", "hub", "both", "n")])
    once = (F.col("x_c") != F.col("y_c")) & ((F.col("y_c") == F.col("top")) | (F.col("x_id") < F.col("y_id")))
    # unless they meet beyond their hub, two of its members share at most what either shares with it
    most = F.least("x_both", "y_both")
    apart = F.col("x_plain") & (F.col("x_hub") == F.col("y_hub")) & ~enough(most, F.col("x_n"), F.col("y_n"))
    cross = x.join(y, "key").where(once & ~F.coalesce(apart, F.lit(False))).select(*ordered("x_id", "y_id")).distinct()
    more, more_sets = compared(cross.join(tried, ["a", "b"], "left_anti"))
    label = components(links.union(same_id).union(linked(more)), staged)
    staged.drop(sets, more_sets, member)

    node = classes.select("digest", "rep").join(label, classes["rep"] == label["id"], "left").select("digest", F.coalesce("component", "rep").alias("of"))
    node = staged.write(node)
    out = rows_.select("id", "n_shingles", "digest").join(node, "digest", "left").select(
        F.col("id").alias("doc_id"), "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("of", "id")).alias("component_id"))
    staged.drop(in_bucket, in_second, star, group, mixed)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_dups(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each component, and all rows without an id.

    A repeated row of a kept document goes, too: of rows with one id one stays
    (the first by its text).
    """
    near = near_dups(docs.select("doc_id", "text"), **options)
    gone = near.where("not kept").select("doc_id").distinct()
    rest = docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
    twice = near.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    first = Window.partitionBy("doc_id").orderBy("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    several = rest.join(twice.hint("shuffle_hash"), "doc_id", "left_semi")
    several = several.withColumn("_nd_rank", F.row_number().over(first)).where("_nd_rank = 1").drop("_nd_rank")
    return rest.join(twice.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns).unionByName(several.select(*docs.columns))
