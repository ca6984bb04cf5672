"""Spelling variants: words one edit apart, found by a trie over letter-group counts.

The letters fall into ``len(GROUPS)`` groups (a letter outside the list goes
by its code). A word's vector counts its letters by group, and the trie
arranges the words by successive counts. One inserted, deleted or replaced
letter changes the vector by a surplus of one in at most one group and a
deficit of one in at most one group; so a depth-first search that may spend one
of each reaches every near word. The words at the leaves it reaches are
verified letter by letter.

The upper part of the trie is the way the work is dealt out: a node at depth
``p`` is a key, each word is listed under its own node and, as a probe, under
the nodes within the budget that are not greater than its own. ``p`` is the
least depth at which no node holds more than ``cap`` words; where the full
depth does not reach that, both sides of a node are dealt into blocks and every
block of the one meets every block of the other. A task builds the rest of the
trie for the words of a node and searches it for all its probes together.

``words`` makes the vocabulary: maximal runs of letters, A-Z in lower case. Each
result row has the word's form (its near word of the largest count, the
smaller one of equal counts, if that count is at least ``ratio`` times its
own) and its root, the end of the chain of forms.

Defined results: null and empty texts have no words; a null id counts as an
empty id; repeated rows count as often as they occur; other columns are
ignored; an empty table gives an empty table; words of any length are compared
whole.

Scale: words are counted with partial sums before the shuffle; everything
later works on distinct words. Nothing is broadcast by hand or collected but
the largest node of each depth. Memory of a task: ``cap`` words, their probes
(about as many for each neighbouring node) and a bounded slice of candidates.
Near words of one word are bounded by its length and the alphabet, so no
aggregate by word has a hot key. Chains grow by ``ratio`` in each step, so
the roots take a few joins that halve the chains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, ascii_lower

#: Runs of letters that words come from.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Letter groups: the letters by frequency, dealt in turn.
N_GROUPS = 16
FREQUENT = "etaoinshrdlcumwfgypbvkjxqz"
GROUPS = [
    "".join(c for c in FREQUENT + "".join(map(chr, range(0xC0, 0x100)))
            if (FREQUENT.index(c) if c in FREQUENT else ord(c)) % N_GROUPS == g)
    for g in range(N_GROUPS)]
#: Pairs that are compared by their whole remaining vectors instead of going down further, and candidates verified at once.
FEW, SLICE = 2000, 1 << 20


def words(docs: DataFrame, drop_every: int | None = None, min_length: int = 1, min_count: int = 1) -> DataFrame:
    """(word, n) of the runs of letters in ``text`` with at least ``min_length`` letters and ``min_count`` occurrences.

    With ``drop_every``, a run whose crc32 of ``<doc_id>:<run>`` it divides loses
    the letter at that crc32 modulo its length: misspellings by a fixed rule.
    """
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))).alias("run"))
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    word = F.col("run")
    if drop_every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.char_length("run")).cast("int")
        word = F.when(h % drop_every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= min_count)


def group_count(word: Column, letters: str) -> Column:
    return F.char_length(word) - F.char_length(F.translate(word, letters, ""))


def path(counts: list[Column]) -> Column:
    return F.concat_ws(".", *[c.cast("string") for c in counts])


def probes_of(counts: list[Column]) -> Column:
    """Paths within a surplus and a deficit of one each that are not greater than the word's own."""
    def moved(**by: int) -> Column:
        change = {int(k[1:]): v for k, v in by.items()}
        some = path([c + change[i] if i in change else c for i, c in enumerate(counts)])
        least = [counts[i] > 0 for i, v in change.items() if v < 0]
        return F.when(least[0], some) if least else some

    down = [moved(**{f"_{i}": -1}) for i in range(len(counts))]
    both = [moved(**{f"_{i}": -1, f"_{j}": 1}) for i in range(len(counts)) for j in range(i + 1, len(counts))]
    return F.filter(F.array(moved(), *down, *both), lambda x: x.isNotNull())


class Words:
    """Words of a batch as one run of bytes, with their vectors."""

    GROUP_OF = np.zeros(256, np.int64)
    for _g, _letters in enumerate(GROUPS):
        GROUP_OF[[ord(c) for c in _letters]] = _g

    def __init__(self, tables: list[pa.Table]):
        lists = [t.column("letters").cast(pa.binary()).combine_chunks() for t in tables]
        lists = pa.concat_arrays([c for x in lists for c in (x.chunks if isinstance(x, pa.ChunkedArray) else [x])])
        offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
        data = lists.buffers()[2]
        flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.at, self.length = offsets[:-1] - offsets[0], np.diff(offsets)
        self.flat = np.concatenate([flat, np.zeros(int(self.length.max(initial=0)) + 4, np.uint8)])
        #: Three letters at either end: near words of six letters and more share three at one end at least.
        three = lambda at: (self.flat[at].astype(np.int32) << 16) | (self.flat[at + 1].astype(np.int32) << 8) | self.flat[at + 2]
        self.head, self.tail = three(self.at), three(self.at + np.maximum(self.length - 3, 0))
        row = np.repeat(np.arange(len(lists)), self.length)
        cells = np.bincount(row * N_GROUPS + self.GROUP_OF[flat], minlength=len(lists) * N_GROUPS)
        counts = cells.reshape(-1, N_GROUPS).astype(">u4")
        distinct, self.vector = np.unique(counts.view(f"V{4 * N_GROUPS}").ravel(), return_inverse=True)
        #: The distinct vectors in ascending order, and the number of each word's vector.
        self.vectors = distinct.view(">u4").reshape(-1, N_GROUPS).astype(np.int32)

    def common(self, a: np.ndarray, b: np.ndarray, backward: bool) -> np.ndarray:
        """Number of equal letters at the beginning or the end of the words ``a`` and ``b``."""
        start = (lambda x: self.at[x] + self.length[x] - 1) if backward else (lambda x: self.at[x])
        step, least = (-1 if backward else 1), np.minimum(self.length[a], self.length[b])
        i, j, same, alive, k = start(a), start(b), np.zeros(len(a), np.int64), np.arange(len(a)), 0
        while len(alive):
            alive = alive[least[alive] > k]
            alive = alive[self.flat[i[alive] + step * k] == self.flat[j[alive] + step * k]]
            same[alive] += 1
            k += 1
        return same

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether exactly one letter is inserted, deleted or replaced, for words whose lengths differ by one at most."""
        longest = np.maximum(self.length[a], self.length[b])
        head = self.common(a, b, False)
        return (head < longest) & (head + self.common(a, b, True) >= longest - 1)


def search(index: np.ndarray, probes: np.ndarray, vectors: np.ndarray):
    """Pairs (probe vector, index vector) within the budget, probe not smaller, by depth-first search; numbers of sorted vectors."""
    tree = vectors[index]
    one = np.ones(len(probes), np.int32)
    stack = [(0, 0, len(index), probes, one, one)]
    while stack:
        level, low, high, alive, surplus, deficit = stack.pop()
        if level == N_GROUPS or (high - low) * len(alive) <= FEW:
            change = vectors[alive, level:][:, None, :] - tree[None, low:high, level:]
            total, moved = change.sum(2), np.abs(change).sum(2)
            fits = (moved + total <= 2 * surplus[:, None]) & (moved - total <= 2 * deficit[:, None])
            i, j = np.nonzero(fits & (alive[:, None] >= index[None, low:high]))
            if len(i):
                yield alive[i], index[low + j]
            continue
        column = tree[low:high, level]
        starts = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        own = vectors[alive, level]
        for s, e in zip(starts, np.append(starts[1:], len(column))):
            change = own - column[s]
            go = np.flatnonzero((change <= surplus) & (-change <= deficit))
            if len(go):
                more, less = np.maximum(change[go], 0), np.maximum(-change[go], 0)
                stack.append((level + 1, low + s, low + e, alive[go], surplus[go] - more, deficit[go] - less))


def repeated(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


OUT = pa.schema([("a", pa.binary()), ("n_a", pa.int64()), ("b", pa.binary()), ("n_b", pa.int64()), ("both", pa.bool_())])
OUT_SCHEMA = "a binary, n_a long, b binary, n_b long, both boolean"


def near_in_node(index: pa.Table, probes: pa.Table) -> pa.Table:
    """Near words of the probes among the index words; ``both`` if the pair is not met the other way round."""
    if not index.num_rows or not probes.num_rows:
        return OUT.empty_table()
    w, n_index = Words([index, probes]), index.num_rows
    sides = []
    for rows in (np.arange(n_index), np.arange(n_index, len(w.vector))):
        order = rows[np.argsort(w.vector[rows], kind="stable")]
        distinct, first, count = np.unique(w.vector[order], return_index=True, return_counts=True)
        start, size = np.zeros(len(w.vectors), np.int64), np.zeros(len(w.vectors), np.int64)
        start[distinct], size[distinct] = first, count
        sides.append((order, distinct, start, size))
    (i_order, i_vectors, i_start, i_size), (p_order, p_vectors, p_start, p_size) = sides
    found_a, found_b = [], []

    def verify(u: np.ndarray, v: np.ndarray) -> None:
        """The words of the vectors ``u`` and ``v``, slice by slice."""
        a = p_order[repeated(p_start[u], p_size[u])]
        v = np.repeat(v, p_size[u])
        cuts = np.searchsorted(np.cumsum(i_size[v]), np.arange(SLICE, i_size[v].sum() + SLICE, SLICE), side="right")
        low = 0
        for high in [*np.unique(cuts[cuts > 0]), len(v)]:
            b = i_order[repeated(i_start[v[low:high]], i_size[v[low:high]])]
            x = np.repeat(a[low:high], i_size[v[low:high]])
            some = np.flatnonzero((w.head[x] == w.head[b]) | (w.tail[x] == w.tail[b]) | ((w.length[x] < 6) & (w.length[b] < 6)))
            x, b = x[some], b[some]
            near = w.near(x, b)
            found_a.append(x[near])
            found_b.append(b[near])
            low = high

    waiting, n = [], 0
    for u, v in search(i_vectors, p_vectors, w.vectors):
        waiting.append((u, v))
        n += int((p_size[u] * i_size[v]).sum())
        if n >= SLICE:
            verify(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]))
            waiting, n = [], 0
    if waiting:
        verify(np.concatenate([x for x, _ in waiting]), np.concatenate([x for _, x in waiting]))
    a = np.concatenate(found_a) if found_a else np.zeros(0, np.int64)
    b = np.concatenate(found_b) if found_b else np.zeros(0, np.int64)
    left, right = probes.take(pa.array(a - n_index)), index.take(pa.array(b))
    both = pa.array(w.vector[a] != w.vector[b])
    columns = [left.column("letters"), left.column("n"), right.column("letters"), right.column("n"), both]
    return pa.table([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=OUT)


def near_pairs(vocabulary: DataFrame, staged: Staged, cap: int = 16_384) -> DataFrame:
    """(word, near, n_word, n_near_word) of all words of (word, n) that are one edit apart, each pair both ways."""
    counts = [F.col(f"c{g}") for g in range(N_GROUPS)]
    listed = vocabulary.select(
        F.encode("word", "ISO-8859-1").alias("letters"), "n", *[group_count(F.col("word"), s).alias(f"c{g}") for g, s in enumerate(GROUPS)])
    listed = staged.write(listed)
    vectors = staged.write(listed.groupBy(*counts).agg(F.count(F.lit(1)).alias("size")))
    tops = vectors.rollup(*counts).agg(F.sum("size").alias("size"), F.grouping_id().alias("g"))
    largest = {r.g.bit_length(): r.size for r in tops.groupBy("g").agg(F.max("size").alias("size")).collect()}
    depth = next((p for p in range(1, N_GROUPS) if (largest.get(N_GROUPS - p) or 0) <= cap), N_GROUPS)

    top = counts[:depth]
    nodes = vectors.groupBy(path(top).alias("node")).agg(F.ceil(F.sum("size") / cap).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("letters"), F.col("blocks")).cast("int")
    to_all = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    index = listed.select(path(top).alias("node"), "letters", "n").join(nodes, "node").select("node", block.alias("i"), to_all.alias("j"), "letters", "n")
    probes = listed.select(F.explode(probes_of(top)).alias("node"), "letters", "n").join(nodes, "node")
    probes = probes.select("node", to_all.alias("i"), block.alias("j"), F.col("letters").alias("letters"), F.col("n").alias("n"))
    found = index.groupBy("node", "i", "j").cogroup(probes.groupBy("node", "i", "j")).applyInArrow(near_in_node, OUT_SCHEMA)
    one = lambda a, b: F.struct(F.col(a).alias("w"), F.col(b).alias("v"), F.col(f"n_{a}").alias("n_w"), F.col(f"n_{b}").alias("n_v"))
    each = found.select(F.explode(F.when(F.col("both"), F.array(one("a", "b"), one("b", "a"))).otherwise(F.array(one("a", "b")))).alias("p"))
    text = lambda c: F.decode(F.col(c), "ISO-8859-1")
    return each.select(text("p.w").alias("word"), text("p.v").alias("near"), F.col("p.n_w").alias("n_word"), F.col("p.n_v").alias("n_near_word"))


def variants(vocabulary: DataFrame, ratio: int = 10, cap: int = 16_384) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of (word, n)."""
    staged = Staged(vocabulary.sparkSession, "spelling")
    vocabulary = staged.write(vocabulary)
    best = near_pairs(vocabulary, staged, cap).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_near_word")).alias("less"), F.col("near").alias("form"))).alias("best"))
    own = vocabulary.join(best, "word", "left")
    strong = -F.col("best.less") >= ratio * F.col("n")
    rows = staged.write(own.select(
        "word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(strong, -F.col("best.less")).alias("form_n")))

    chain = rows.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken; a step multiplies the count by the ratio at least
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("last"))
        longer = staged.write(chain.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root"), F.col("last").isNotNull().alias("moved")))
        chain = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return rows.join(chain, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
