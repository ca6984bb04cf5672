"""SentencePiece encoding and decoding with a relational lattice.

1. Texts are cut into units: before a blank that follows another character, and
   around line feeds. Units are cut further into words, between characters that
   no piece of the table joins. No piece crosses either cut.
2. The substrings of a distinct word, up to the length of the longest piece,
   are exploded and equi-joined to the piece table: the matches are the edges.
3. The edges are grouped by word and folded with a higher-order ``aggregate``.
   For a unigram table the fold is Viterbi's recursion over the edge scores.
   For a BPE table the best sum of scores is not what the library returns, so
   the fold takes the merges instead, the best score first (the leftmost, if it
   occurs twice). An edge joins two neighbouring parts. The edges are sorted
   once and each is looked at once, unless a piece in the word can become
   possible after a merge of a worse score (``late_pieces``): then each merge is
   chosen from all edges. Words above ``MAX_BITS`` characters, whose cuts do not
   fit a long, take the same merges by a heap in Python.
4. The edges between neighbouring cuts have the ids; a character without a
   piece becomes the pieces of its UTF-8 bytes.
5. The ids of a text are those of its words, gathered by chunk: a chunk is some
   consecutive rows of a task, and its words are numbered as they occur first.
6. Decoding takes the bytes of each id from the table, in order, and joins them;
   the result is compared with the text.

Defined results: null and empty texts have no unit and no piece; other texts
get the blank that the library puts before them; repeated rows are encoded
alike; an empty table gives an empty table; other columns pass through unless
a column of the result has their name. A text with the mark ``▁`` itself
decodes to a blank there and is not lossless, as in the library.

Scale: each distinct word is encoded once. The piece table is broadcast; its
size is the vocabulary's. The words of each chunk are shuffled by word once;
exploding, joining, grouping and folding need no further shuffle. The ids go
back to their chunk as packed blocks, written once, and the texts of a chunk
meet them there, packed as well: texts are shuffled compressed and ids are not
shuffled for the texts at all. Texts are read twice, so ``docs`` must give its
rows in the same order each time, as a table does; the key of a chunk has a
checksum of its texts, and a chunk that differs ends the task with an error.
SHA-256 stands for the text in the comparison.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, slices, texts_of
from .minhash import MIX, _mix

BLANK = "▁"
UNIT = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")
PLAIN_UNIT = re.compile(" *[^ \n]+| +|\n")
#: Characters of a word whose cuts fit the bits of a long.
MAX_BITS = 61
#: Characters of the texts of a chunk, and of a block of them.
CHUNK_CHARS, BLOCK_CHARS = 12_000_000, 1_000_000
#: Rows whose ids are packed together.
PACKED_ROWS = 500_000


@dataclass
class Pieces:
    """The piece table of a model file: (piece, id, score, bytes, late), ids of single characters, bytes (hex) of all ids in order, and how words are cut and encoded."""

    rows: DataFrame
    chars: dict[str, int]
    by_id: list[str]
    word: re.Pattern
    longest: int
    bpe: bool
    byte0: int


def read_pieces(spark: SparkSession, model_file: str, bpe: bool = True) -> Pieces:
    """The normal and byte pieces of a sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=model_file)
    normal = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
    rows = [(m.id_to_piece(i), i, float(m.get_score(i)), m.id_to_piece(i).replace(BLANK, " ").encode()) for i in normal]
    byte = {int(m.id_to_piece(i)[3:-1], 16): i for i in range(m.get_piece_size()) if m.is_byte(i)}
    rows += [(None, i, 0.0, bytes([b])) for b, i in byte.items()]
    return piece_table(spark, rows, bpe, byte[0])


def piece_table(spark: SparkSession, rows: list[tuple], bpe: bool, byte0: int) -> Pieces:
    """A table from (piece, id, score, bytes); the piece of a byte is null, and the ids of bytes follow one another from ``byte0``."""
    late = late_pieces({p: -score for p, _, score, _ in rows if p is not None and len(p) > 1}) if bpe else set()
    columns = list(zip(*((*r, r[0] in late) for r in rows)))
    kinds = (pa.string(), pa.int32(), pa.float64(), pa.binary(), pa.bool_())
    table = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["piece", "id", "score", "bytes", "late"])
    code = dict(zip(columns[1], columns[3]))
    by_id = [code.get(i, b"").hex() for i in range(max(code) + 1)]
    pieces = [p for p in columns[0] if p is not None]
    chars = {p: i for p, i in zip(columns[0], columns[1]) if p is not None and len(p) == 1}
    return Pieces(spark.createDataFrame(table), chars, by_id, word_pattern(pieces), max(map(len, pieces)), bpe, byte0)


def late_pieces(cost: dict[str, float]) -> set[str]:
    """The pieces that a merge of the same or a higher cost may make possible.

    Such a piece is a left and a right part, one of which (made last, by a merge
    of two parts) costs as much as the piece or more. It is not late if the
    inner one of those two parts would rather have been merged with the other
    side: both stood there, and that merge is a piece of lower cost.
    """
    def made(p: str) -> list[tuple[str, str]]:
        return [(p[:k], p[k:]) for k in range(1, len(p)) if all(len(x) == 1 or x in cost for x in (p[:k], p[k:]))]

    def rather(p: str, than: str) -> bool:
        return p in cost and cost[p] < cost[than]

    out = set()
    for p, c in cost.items():
        for x, y in made(p):
            if len(x) > 1 and cost[x] >= c and not all(rather(inner + y, x) for _, inner in made(x)):
                out.add(p)
            if len(y) > 1 and cost[y] >= c and not all(rather(x + inner, y) for inner, _ in made(y)):
                out.add(p)
    return out


def word_pattern(pieces: list[str]) -> re.Pattern:
    """The words of a text: runs of characters of one group, with the blanks before them; pieces join characters of a group only."""
    group: dict[str, str] = {}

    def top(c: str) -> str:
        while (up := group.setdefault(c, c)) != c:
            group[c] = group[up]
            c = up
        return c

    for p in pieces:
        for a, b in zip(p, p[1:]):
            if not {a, b} & {BLANK, "\n"}:
                group[top(a)] = top(b)
    groups: dict[str, list[str]] = {}
    for c in group:
        groups.setdefault(top(c), []).append(c)
    runs = ["[" + "".join(map(re.escape, sorted(g))) + "]+" for g in sorted(groups.values(), key=lambda g: (-len(g), g))]
    return re.compile(f"{BLANK}*(?:" + "|".join([*runs, f"[^{BLANK}\n]"]) + f")|{BLANK}+|\n")


def units(text: str | None) -> list[str]:
    """The stretches of a text that are encoded by themselves."""
    return UNIT.findall(BLANK + text.replace(" ", BLANK)) if text else []


def plain_units(text: str) -> list[str]:
    """The same with plain blanks for the marks, which take less room."""
    return PLAIN_UNIT.findall(" " + text.replace(BLANK, " ")) if text else []


class Numbered:
    """The distinct units of some texts and their words, numbered as they occur first."""

    def __init__(self, pattern: re.Pattern):
        self.pattern, self.units, self.words = pattern, {}, {}

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The units of the texts, where the units of each text end, the numbers of the words of the new units, and where those of each new unit end."""
        known, units, words = len(self.units), self.units, self.words
        found = [plain_units(t) for t in texts]
        at = np.array([units.setdefault(u, len(units)) for us in found for u in us], np.int64)
        cut = [self.pattern.findall(u.replace(" ", BLANK)) for u in islice(units, known, None)]
        numbers = np.array([words.setdefault(w, len(words)) for ws in cut for w in ws], np.int64)
        return at, np.cumsum([0, *map(len, found)]), numbers, np.cumsum([len(ws) for ws in cut], dtype=np.int64)


def edges(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` with edges, the lattice of each word as (cost, s, e, id), and whether one of them is late.

    Pieces are found by a hash and then compared. Merges make pieces of two
    characters or more, so for a BPE table shorter ones are no edges. The edges
    of a word are grouped by its number first, which they are almost sorted by.
    """
    keep, n, least = [c for c in words.columns if c != "word"], F.char_length("word"), 2 if pieces.bpe else 1
    table = pieces.rows.where("piece is not null").select(F.xxhash64("piece").alias("_sp_h"), "piece", (-F.col("score")).alias("cost"), "id", "late")
    table = table.where(F.char_length("piece") >= least)
    s, e, part = F.col("s"), F.col("e"), F.col("_sp_part")
    numbered = words.withColumn("_sp_k", F.monotonically_increasing_id())
    starts = numbered.select("*", F.explode(F.sequence(F.lit(0), F.greatest(n - least, F.lit(0)))).alias("s"))
    first = F.when(s > 0, s + least).otherwise(1)  # a word has a row at least
    spans = starts.select("*", F.explode(F.sequence(first, F.least(s + pieces.longest, n))).alias("e"))
    spans = spans.withColumn("_sp_part", F.col("word").substr(s + 1, e - s))
    same = (F.xxhash64("_sp_part") == F.col("_sp_h")) & (part <= F.col("piece")) & (part >= F.col("piece"))
    found = spans.join(F.broadcast(table), same, "left").where(F.col("id").isNotNull() | ((s == 0) & (e == 1)))
    edge = F.collect_list(F.when(F.col("id").isNotNull(), F.struct("cost", "s", "e", "id"))).alias("edges")  # null values are not collected
    late = F.coalesce(F.max("late"), F.lit(False)).alias("late")
    return found.groupBy("_sp_k", "word").agg(*(F.first(c).alias(c) for c in keep), edge, late).drop("_sp_k")


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: as the variable of a lambda it is not put in place of its uses."""
    return F.transform(F.array(value), use)[0]


def merged_ids(word: Column, edge: Column, late: Column, pieces: Pieces) -> Column:
    """The ids of a word of at most ``MAX_BITS`` characters after all merges.

    The cuts are the bits of a long. An edge joins two parts if both its ends
    are cuts and exactly one cut is between them. Sorted by cost and place, one
    look at each edge is enough, unless an edge is late.
    """
    one, n = F.lit(1).cast("long"), F.char_length(word)
    bit = lambda p: F.call_function("shiftleft", one, p)
    edge = F.sort_array(F.transform(edge, lambda x: F.struct(
        x["cost"].alias("cost"), x["s"].alias("s"), x["id"].alias("id"),
        (bit(x["e"]) - bit(x["s"] + 1)).alias("inside"), (bit(x["s"]) + bit(x["e"])).alias("ends"))))
    fits = lambda cuts, x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (F.bit_count(cuts.bitwiseAND(x["inside"])) == 1)
    joined = lambda cuts, x: cuts.bitwiseAND(F.bitwise_not(x["inside"]))
    all_cuts = bit(n + 1) - 1

    def once(ready: Column) -> Column:
        return F.aggregate(ready, all_cuts, lambda cuts, x: F.when(fits(cuts, x), joined(cuts, x)).otherwise(cuts))

    def chosen(ready: Column) -> Column:
        merges = F.sequence(F.lit(1), F.greatest(F.least(n - 1, F.size(ready)), F.lit(1)))

        def step(cuts: Column, _: Column) -> Column:
            best = F.get(F.filter(ready, lambda x: fits(cuts, x)), F.lit(0))
            return F.coalesce(joined(cuts, best), cuts)

        return F.aggregate(merges, all_cuts, step)

    def ids(ready: Column, cuts: Column) -> Column:
        kept = F.filter(ready, lambda x: (cuts.bitwiseAND(x["ends"]) == x["ends"]) & (cuts.bitwiseAND(x["inside"]) == 0))
        both = lambda p: F.call_function("shiftright", cuts, p).bitwiseAND(F.lit(3)) == 3
        alone = F.transform(F.filter(F.sequence(F.lit(0), n - 1), both), lambda p: F.struct(p.alias("s"), char_ids(F.substring(word, p + 1, F.lit(1)), pieces).alias("ids")))
        parts = F.concat(F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.array(x["id"]).alias("ids"))), alone)
        return F.flatten(F.transform(F.sort_array(parts), lambda x: x["ids"]))

    return bound(edge, lambda ready: bound(F.when(late, chosen(ready)).otherwise(once(ready)), lambda cuts: ids(ready, cuts)))


def char_ids(c: Column, pieces: Pieces) -> Column:
    """The ids of a character: its piece, or those of its UTF-8 bytes."""
    known = {ord(p): i for p, i in pieces.chars.items()}
    table = F.split(F.lit(",".join(str(known.get(p, -1)) for p in range(max(known, default=0) + 1))), ",").cast("array<int>")
    as_bytes = F.transform(
        F.sequence(F.lit(1), F.octet_length(c)), lambda i: F.conv(F.hex(F.substring(F.encode(c, "utf-8"), i, F.lit(1))), 16, 10).cast("int") + pieces.byte0)
    return bound(F.get(table, F.ascii(c)), lambda i: F.when(i >= 0, F.array(i)).otherwise(as_bytes))


def viterbi_ends(word: Column, edge: Column, unknown: float = -1e6) -> Column:
    """Ends of the parts on the path of the best score, from the last to the first; a character without an edge costs ``unknown``.

    The state holds, for each place, the best score up to it and where the last
    part of that path begins; of equal scores the longest last part wins.
    """
    n = F.char_length(word)
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("neg")))

    def step(best: Column, place: Column) -> Column:
        into = F.filter(edge, lambda x: x["e"] == place)
        ways = F.transform(into, lambda x: F.struct((F.get(best, x["s"])["score"] - x["cost"]).alias("score"), (-x["s"]).alias("neg")))
        alone = F.array(F.struct((F.get(best, place - 1)["score"] + unknown).alias("score"), (1 - place).alias("neg")))
        return F.concat(best, F.array(F.array_max(F.concat(ways, alone))))

    first = F.struct(n.alias("at"), F.array(n).alias("ends"))

    def back(path: Column, _: Column, best: Column) -> Column:
        before = -F.get(best, path["at"])["neg"]
        return F.when(path["at"] > 0, F.struct(before.alias("at"), F.concat(path["ends"], F.array(before)).alias("ends"))).otherwise(path)

    places = F.sequence(F.lit(1), n)
    return bound(F.aggregate(places, start, step), lambda best: F.aggregate(places, first, lambda p, _: back(p, _, best), lambda p: p["ends"]))


def merge_long(n: int, edge: list[tuple[float, int, int]]) -> list[int]:
    """Starts of the parts of a long word after all merges of its edges (cost, start, end), with a heap."""
    cost = {(s, e): c for c, s, e in edge}
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple] = []

    def offer(s: int) -> None:
        """The merge of the part at ``s`` with the next one."""
        m = after[s]
        if m < n and (s, after[m]) in cost:
            heapq.heappush(heap, (cost[s, after[m]], s, m, after[m]))

    for s in range(n):
        offer(s)
    while heap:
        _, s, m, e = heapq.heappop(heap)
        if alive[s] and m < n and alive[m] and after[s] == m and after[m] == e:
            alive[m], after[s] = False, e
            if e < n:
                before[e] = s
            offer(s)
            if before[s] >= 0:
                offer(before[s])
    return [s for s in range(n) if alive[s]]


def ids_between(word: Column, edge: Column, places: Column, pieces: Pieces) -> Column:
    """The ids of the parts of a word between some cuts."""
    code = lambda s, e: F.shiftleft(s.cast("long"), 32).bitwiseOR(e.cast("long"))

    def ids(at: Column) -> Column:
        by_part = F.map_from_entries(F.transform(edge, lambda x: F.struct(code(x["s"], x["e"]), F.array(x["id"]))))
        part = F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda s, e: F.coalesce(
            F.try_element_at(by_part, code(s, e)), char_ids(F.substring(word, s + 1, F.lit(1)), pieces)))
        return F.flatten(part)

    return bound(places, ids)


def long_ids(lattice: DataFrame, chars: dict[str, int], byte0: int) -> DataFrame:
    """``lattice`` with the ids of the words that have none yet, by merges of their edges; without the edges."""
    keep = [c for c in lattice.columns if c != "edges"]

    def ids_of(word: str, edge: list[dict]) -> list[int]:
        by_place = {(x["s"], x["e"]): x["id"] for x in edge}
        starts = merge_long(len(word), [(x["cost"], x["s"], x["e"]) for x in edge])
        out: list[int] = []
        for s, e in zip(starts, [*starts[1:], len(word)]):
            i = by_place.get((s, e), chars.get(word[s]))
            out += [i] if i is not None else [byte0 + b for b in word[s:e].encode()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            if ids.null_count:
                rows = np.flatnonzero(np.asarray(ids.is_null()))
                found, missing = ids.to_pylist(), b.select(["word", "edges"]).take(pa.array(rows)).to_pylist()
                for row, x in zip(rows, missing):
                    found[row] = ids_of(x["word"], x["edges"])
                ids = pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([ids if c == "ids" else b.column(c) for c in keep], names=keep)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lattice.select(*keep).schema)
    return lattice.mapInArrow(run, schema)


def decode(encoded: DataFrame, key: str, pieces: Pieces) -> DataFrame:
    """(key, text): the bytes of the ids (array column ``ids``) of each row in order, as UTF-8, blanks as the pieces have them."""
    return encoded.select(key, decoded(F.col("ids"), pieces).alias("text"))


def decoded(ids: Column, pieces: Pieces) -> Column:
    """The bytes of the pieces of some ids, in order; the table is a constant of the plan, as it has the vocabulary's size."""
    table = F.split(F.lit(",".join(pieces.by_id)), ",")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")).cast("string")


def lattice_tasks(spark: SparkSession) -> int:
    """Tasks that encode words: a small row becomes many edges, which are sorted in memory."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """``words`` (distinct words in the column ``word``) with ids.

    One shuffle by word; exploding, joining, grouping and folding keep it.
    """
    keep = words.columns
    lattice = edges(words.repartition(lattice_tasks(words.sparkSession), "word"), pieces)
    word, edge = F.col("word"), F.col("edges")
    if not pieces.bpe:
        return lattice.select(*keep, ids_between(word, edge, F.reverse(viterbi_ends(word, edge)), pieces).alias("ids"))
    short = F.char_length("word") <= MAX_BITS
    ids = F.when(short, merged_ids(word, edge, F.col("late"), pieces))
    return long_ids(lattice.select(*keep, ids.alias("ids"), F.when(~short, edge).alias("edges")), pieces.chars, pieces.byte0)


def at_place(h: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A unit's share of the digest of its text: hash of its ids and its place."""
    return _mix(h.view(np.uint64) + (place.astype(np.uint64) + np.uint64(1)) * MIX).view(np.int64)


def flat_lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, values) of a column of int lists; the list of row i ends at ``ends[i]``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), dtype=np.int64)
    return np.cumsum(sizes), np.asarray(column.flatten(), dtype=np.int32)


def gathered(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions first[i] .. first[i] + size[i] - 1 of each i, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.RecordBatch, list[str], int | None]]:
    """Blocks of the rows of a task with their texts, and the key of the chunk at its last block.

    A chunk has some consecutive rows: as many as its texts need to have
    ``most`` characters. Its key has the task, the chunk's number and a checksum
    of the texts.
    """
    part, number, size, crc = TaskContext.get().partitionId(), 0, 0, 0
    waiting: list[tuple[pa.RecordBatch, list[str]]] = []
    for b in slices(batches):
        texts, first, block = texts_of(b), 0, 0
        for row, t in enumerate(texts):
            crc = zlib.crc32(t.encode() + b"\xff", crc)
            size, block = size + len(t), block + len(t)
            if size >= most or block >= BLOCK_CHARS or row + 1 == len(texts):
                yield from ((*w, None) for w in waiting)
                waiting, first, block = [(b.slice(first, row + 1 - first), texts[first : row + 1])], row + 1, 0
                if size >= most:
                    yield (*waiting.pop(), part << 44 | number << 32 | crc)
                    number, size, crc = number + 1, 0, 0
    if waiting:  # the last chunk is as long as it is
        yield (*waiting.pop(), part << 44 | number << 32 | crc)


def squeezed(*parts: np.ndarray) -> bytes:
    """Arrays of ints, compressed; their bytes are sorted by significance."""
    head = np.array([len(parts), *map(len, parts)], "<i4")
    return pa.Codec("zstd", 3).compress(np.concatenate([p.astype("<i4") for p in (*parts, head[::-1])]).view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True)


def expanded(blob: bytes, size: int) -> list[np.ndarray]:
    """The arrays that ``squeezed`` got; they have ``size`` ints in all."""
    flat = np.frombuffer(pa.Codec("zstd").decompress(blob, 4 * size, asbytes=True), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()
    sizes = flat[-2 : -2 - flat[-1] : -1]
    return np.split(flat[: sizes.sum()], np.cumsum(sizes)[:-1])


def word_rows(docs: DataFrame, pattern: re.Pattern, most: int) -> DataFrame:
    """(word, chunk, number): the distinct words of each chunk, numbered as they occur first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Numbered(pattern)
        for _, texts, key in chunks(batches, most):
            seen.add(texts)
            if key is not None:
                words = list(seen.words)
                for i in range(0, len(words), 20_000):
                    some = pa.array(words[i : i + 20_000], pa.string())
                    yield pa.RecordBatch.from_arrays([some, pa.array([key] * len(some), pa.int64()), pa.array(np.arange(i, i + len(some)), pa.int32())], names=["word", "chunk", "number"])
                seen = Numbered(pattern)

    return docs.select("text").mapInArrow(run, "word string, chunk long, number int")


def packed_ids(found: DataFrame) -> DataFrame:
    """(chunk, size, blob) from (chunk, number, ids): the ids of many words of a chunk in a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PACKED_ROWS:
                yield from out(pa.Table.from_batches(held))
                held, n = [], 0
        if held:
            yield from out(pa.Table.from_batches(held))

    def out(t: pa.Table) -> Iterator[pa.RecordBatch]:
        chunk, number = (t.column(c).to_numpy() for c in ("chunk", "number"))
        ends, flat = flat_lists(t.column("ids"))
        sizes = np.diff(ends, prepend=0)
        order = np.lexsort((number, chunk))
        for rows in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
            parts = np.diff(number[rows], prepend=0), sizes[rows], flat[gathered(ends[rows] - sizes[rows], sizes[rows])]
            size = sum(map(len, parts)) + len(parts) + 1
            yield pa.RecordBatch.from_arrays([pa.array([chunk[rows[0]]], pa.int64()), pa.array([size], pa.int32()), pa.array([squeezed(*parts)], pa.binary())], names=["chunk", "size", "blob"])

    return found.mapInArrow(run, "chunk long, size int, blob binary")


def packed_rows(docs: DataFrame, most: int) -> DataFrame:
    """(chunk, place, size, blob): the rows of a chunk in compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        for b, _, key in chunks(batches, most):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as writer:
                writer.write_batch(b)
            raw = sink.getvalue()
            held.append((raw.size, pa.Codec("zstd", 3).compress(raw, asbytes=True)))
            if key is not None:
                for place, (size, blob) in enumerate(held):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([place], pa.int32()), pa.array([size], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "place", "size", "blob"])
                held = []

    return docs.mapInArrow(run, "chunk long, place int, size long, blob binary")


def encode_texts(docs: DataFrame, pieces: Pieces, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``docs`` (without text) with ids, ends, decoded and lossless.

    ``ids`` are the ids of the whole text, and unit k of the text has those up
    to place ``ends[k]``; ``decoded`` is the text that ``decode`` makes of the
    ids, without the blank put before it; ``lossless`` tells whether it is the
    text again (by SHA-256 of both).
    """
    spark = docs.sparkSession
    staged = Staged(spark, "lattice")
    keep = [c for c in docs.columns if c not in ("text", "ids", "ends", "decoded", "lossless")]
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))  # rows of few bytes become many: not to be coalesced
    pattern = pieces.word
    words = word_rows(docs, pattern, chunk_chars).repartition(lattice_tasks(spark), "word").groupBy("word").agg(F.collect_list(F.struct("chunk", "number")).alias("at"))
    found = encode_words(words, pieces).select(F.explode("at").alias("at"), "ids").select("at.chunk", "at.number", "ids")
    found = staged.write(packed_ids(found), shuffles=False)
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    schema = ", ".join([*own, "_sp_sha string, ids array<int>, ends array<int>"])

    def encode(rows: pa.Table, blobs: pa.Table) -> pa.Table:
        """The ids of the words of a chunk, put in the place of the words of its texts."""
        parts = [expanded(x["blob"], x["size"]) for x in blobs.to_pylist()]
        none = np.empty(0, np.int64)
        number = np.concatenate([none, *(np.cumsum(x[0]) for x in parts)])
        size, flat = (np.concatenate([none, *(x[k] for x in parts)]) for k in (1, 2))
        order = np.argsort(number)
        first, size = (np.cumsum(size) - size)[order], size[order]
        seen, out = Numbered(pattern), []
        word_of, word_to = np.empty(0, np.int64), np.zeros(1, np.int64)  # the words of the units so far
        for x in sorted(rows.to_pylist(), key=lambda x: x["place"]):
            block = pa.ipc.open_stream(pa.Codec("zstd").decompress(x["blob"], x["size"])).read_next_batch()
            texts = texts_of(block)
            unit, unit_to, numbers, to = seen.add(texts)
            word_of, word_to = np.append(word_of, numbers), np.append(word_to, len(word_of) + to)
            if len(seen.words) > len(number):
                raise RuntimeError("the rows of docs came in another order when they were read again")
            n = np.diff(word_to)[unit]
            word = word_of[gathered(word_to[unit], n)]
            ids_to = np.append(0, np.cumsum(size[word]))  # after each word
            ends = ids_to[np.append(0, np.cumsum(n))]  # after each unit
            of_row = ends[unit_to]
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32())) for at, values in (
                (of_row, flat[gathered(first[word], size[word])]), (unit_to, ends[1:] - np.repeat(of_row[:-1], np.diff(unit_to))))]
            sha = pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())
            out.append(pa.RecordBatch.from_arrays([*[block.column(c) for c in keep], sha, *lists], names=[*keep, "_sp_sha", "ids", "ends"]))
        if not out or len(seen.words) < len(number):
            raise RuntimeError("the rows of docs came in another order when they were read again")
        return pa.Table.from_batches(out)

    rows = packed_rows(docs.select(*keep, "text"), chunk_chars).repartition(parallel, "chunk").groupBy("chunk")
    encoded = rows.cogroup(found.repartition(parallel, "chunk").groupBy("chunk")).applyInArrow(encode, schema)
    encoded = encoded.withColumn("decoded", F.substring(decoded(F.col("ids"), pieces), 2, 2**31 - 1))
    return encoded.select(*keep, "ids", "ends", "decoded", (F.sha2(F.col("decoded").cast("binary"), 256) == F.col("_sp_sha")).alias("lossless"))


def digest(encoded: DataFrame) -> DataFrame:
    """n_units, n_pieces, ids_digest and lossless in place of ids, ends and decoded.

    ``ids_digest`` is the exclusive or, over the units of the text, of a hash of
    the unit's place and ids.
    """
    keep = [c for c in encoded.columns if c not in ("ids", "ends", "decoded", "lossless", "n_units", "n_pieces", "ids_digest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_units, n_pieces, out = [], [], []
            for row in range(b.num_rows):
                ids, ends = np.asarray(b.column("ids")[row].values).astype("<u4"), np.asarray(b.column("ends")[row].values)
                code, at = ids.tobytes(), [0, *(4 * ends).tolist()]
                h = np.array([xxhash.xxh3_64_intdigest(code[i:j]) for i, j in zip(at, at[1:])], np.uint64)
                n_units.append(len(ends))
                n_pieces.append(len(ids))
                out.append(int(np.bitwise_xor.reduce(at_place(h, np.arange(len(ends))), initial=0)))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], *(pa.array(x, pa.int64()) for x in (n_units, n_pieces, out)), b.column("lossless")],
                names=[*keep, "n_units", "n_pieces", "ids_digest", "lossless"])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*keep).schema]
    schema = ", ".join([*schema, "n_units long, n_pieces long, ids_digest long, lossless boolean"])
    return encoded.select(*keep, "ids", "ends", "lossless").mapInArrow(run, schema)
