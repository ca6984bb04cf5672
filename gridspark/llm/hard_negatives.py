"""Hard-negative mining by a vertical scan with branch and bound (BOND).

The vectors of a block are kept as columns, one run of numbers for each
dimension, ordered by label. For an anchor the dimensions are read in
descending magnitude of its components. After each few columns a candidate has
a partial score, and what the unread columns can still add lies between the
sums of the smallest and of the largest contributions, taken from the minimum
and maximum of each column within the candidate's label. Candidates that these
bounds rule out leave the bitmap, and later columns are read for the rest only:

* positives (rows of the anchor's label): a candidate goes when its upper bound
  is below the ``positives``-th largest lower bound;
* negatives (rows of another label): each positive has a window of scores; a
  candidate goes when it cannot fall into any window, or when in each one the
  lower bounds of ``negatives`` certain members exceed its upper bound.

What is left when all columns are read has exact scores.

Defined results: rows with a null id, label or vector, or with a null, NaN or
infinite component, take no part; a shorter vector counts as filled up with
zeros; an anchor id that repeats is one anchor, with its least (vector, label);
rows with the anchor's id are neither its positives nor its negatives;
repeated rows of other ids are entries of their own; equal scores are ranked
by id; an anchor without positives, and a positive whose window is empty, give
no row (the window of a negative score is empty); an empty table gives an empty
table; other columns are ignored.

Scale: anchors meet all candidates in pairs of blocks; a candidate is copied
once for each ``anchor_block`` anchors, an anchor once for each ``block``
candidates. Candidates are dealt by row, so equal vectors or a label that holds
a third of all rows make no large block. A task holds one block of either side
and returns at most ``positives`` rows of an anchor, or ``negatives`` rows of a
window. Nothing is broadcast; two counts go to the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged
from .topk import exact, matrix

#: Columns that are read before the bitmap is looked at again.
STEP = 8


class Columns:
    """A block of candidates by dimension, ordered by label and id, with the bounds of each dimension within each label."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray):
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.by_dim = np.ascontiguousarray(vectors[order].T)
        self.zone_labels, starts = np.unique(self.labels, return_index=True)
        self.bounds = np.append(starts, len(ids))
        self.zone = np.repeat(np.arange(len(starts)), np.diff(self.bounds))
        self.low = np.minimum.reduceat(self.by_dim, starts, axis=1) if len(ids) else np.zeros((len(vectors.T), 0))
        self.high = np.maximum.reduceat(self.by_dim, starts, axis=1) if len(ids) else self.low


def vertical(anchor: np.ndarray, block: Columns, alive: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of ``alive`` that ``prune`` leaves, their exact scores, and the number of products read.

    ``prune`` gets the lower and upper bounds of the rows that are left and
    returns which of them stay.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    ends = anchor[order, None] * block.low[order], anchor[order, None] * block.high[order]
    rest = [np.cumsum(f(*ends)[::-1], axis=0)[::-1] for f in (np.minimum, np.maximum)]  # of the columns from each place on
    score, read = np.zeros(len(alive), block.by_dim.dtype), 0
    for i in range(0, len(order), STEP):
        dims = order[i : i + STEP]
        if not len(alive) or not anchor[dims[0]]:  # nothing is left, or the columns that are left add nothing
            break
        part = block.by_dim[dims]
        score = score + anchor[dims] @ (part if len(alive) == part.shape[1] else part[:, alive])
        read += len(dims) * len(alive)
        if i + STEP < len(order):
            zone = block.zone[alive]
            stay = prune(score + rest[0][i + STEP][zone], score + rest[1][i + STEP][zone])
            if not stay.all():
                alive, score = alive[stay], score[stay]
    return alive, score, read


def largest(values: np.ndarray, k: int) -> float:
    """The k-th largest value; minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -math.inf


def find_positives(anchor: np.ndarray, own_id: int, label: int, block: Columns, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` best rows of the anchor's label in the block, their scores, and the number of products read."""
    z = np.searchsorted(block.zone_labels, label)
    if z == len(block.zone_labels) or block.zone_labels[z] != label:
        return np.zeros(0, np.int64), np.zeros(0), 0
    rows = np.arange(block.bounds[z], block.bounds[z + 1])
    rows, score, read = vertical(anchor, block, rows[block.ids[rows] != own_id], lambda low, high: high >= largest(low, k))
    top = np.lexsort((block.ids[rows], -score))[:k]
    return rows[top], score[top], read


def find_negatives(anchor: np.ndarray, own_id: int, label: int, windows: list[tuple[int, int]], block: Columns, k: int) -> tuple[list, int]:
    """For each window (least and greatest score) its ``k`` best rows of other labels and their scores; the number of products read."""
    rows = np.flatnonzero((block.labels != label) & (block.ids != own_id))

    def may_matter(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), bool)
        for least, most in windows:
            inside = low[(low >= least) & (high <= most)]
            stay |= (low <= most) & (high >= max(least, largest(inside, k)))
        return stay

    rows, score, read = vertical(anchor, block, rows, may_matter)
    found = []
    for least, most in windows:
        fits = np.flatnonzero((score >= least) & (score <= most))
        top = fits[np.lexsort((block.ids[rows[fits]], -score[fits]))[:k]]
        found.append((rows[top], score[top]))
    return found, read


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


def integers(t: pa.Table, name: str) -> np.ndarray:
    return np.asarray(t.column(name), np.int64)


def sides(anchors: pa.Table, candidates: pa.Table, scale: int) -> tuple[np.ndarray, Columns]:
    width = max(pc.max(pc.list_value_length(t.column("v"))).as_py() for t in (anchors, candidates))
    a, c = exact(matrix(anchors, width, scale), matrix(candidates, width, scale))
    return a, Columns(c, integers(candidates, "label"), integers(candidates, "vec_id"))


POSITIVES = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64())])
NEGATIVES = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def table_of(parts: list[tuple], schema: pa.Schema) -> pa.Table:
    """One table of the columns of all parts."""
    columns = [np.concatenate([np.atleast_1d(p[i]) for p in parts]) if parts else np.zeros(0) for i in range(len(schema))]
    return pa.table([pa.array(c.astype(np.int64)).cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def mine(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 3, low_pct: int = 50, high_pct: int = 95,
         scale: int = 256, block: int = 4096, anchor_block: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``is_anchor`` holds. Scores are inner products
    of floor(scale * x). A negative of a positive has a score between
    ``low_pct`` and ``high_pct`` percent of the positive's.
    """
    staged = Staged(vectors.sparkSession, "negatives")
    rows = valid(vectors)
    n_rows, n_anchors = rows.agg(F.count(F.lit(1)), F.count_distinct(F.when(is_anchor, F.col("vec_id")))).first()
    n_blocks, n_anchor_blocks = max(1, math.ceil(n_rows / block)), max(1, math.ceil(n_anchors / anchor_block))
    one = rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("a"))
    anchors = staged.write(one.select(
        F.col("vec_id").alias("anchor_id"), "a.v", "a.label", F.pmod(F.xxhash64("vec_id"), F.lit(n_anchor_blocks)).cast("int").alias("ab")))
    dealt = rows.withColumn("cb", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)).cast("int"))
    dealt = dealt.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(n_anchor_blocks - 1)))).groupBy("ab", "cb")
    to_all = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))

    def local_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a, columns = sides(left, right, scale)
            for v, own, label in zip(a, integers(left, "anchor_id"), integers(left, "label")):
                at, score, _ = find_positives(v, own, label, columns, positives)
                out.append((np.full(len(at), own), columns.ids[at], score))
        return table_of(out, POSITIVES)

    def local_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            a, columns = sides(left, right, scale)
            for v, own, label, scores in zip(a, integers(left, "anchor_id"), integers(left, "label"), left.column("scores").to_pylist()):
                windows = [(-(-low_pct * s // 100), high_pct * s // 100) for s in scores]
                for place, (at, score) in enumerate(find_negatives(v, own, label, windows, columns, negatives)[0]):
                    out.append((np.full(len(at), own), np.full(len(at), place), columns.ids[at], score))
        return table_of(out, NEGATIVES)

    asked = anchors.withColumn("cb", to_all).groupBy("ab", "cb")
    found = asked.cogroup(dealt).applyInArrow(local_positives, "anchor_id long, positive_id long, positive_score long")
    best = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    chosen = staged.write(found.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives))

    scores = chosen.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    asked = anchors.join(scores, "anchor_id").withColumn("cb", to_all).groupBy("ab", "cb")
    near = asked.cogroup(dealt).applyInArrow(local_negatives, "anchor_id long, place int, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.join(chosen, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
