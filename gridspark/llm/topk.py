"""Exact top-k search by inner product, with a three-phase uniform threshold.

The components are cut into ``groups``; a candidate's score is the sum of its
partial scores, one for each group. Queries and candidates are dealt into
blocks, and a task works on one pair of blocks.

1. For each query the local lists give the ``k`` candidates with the largest
   partial score of each group. Their scores are gathered; the ``k``-th
   largest over all blocks is a safe cutoff, as ``k`` candidates reach it.
2. The cutoff goes with the query to all blocks. A candidate can reach it only
   if one of its partial scores is at least the cutoff divided by the number
   of groups (the uniform threshold): these entries are collected.
3. The remaining partial scores of the collected entries are added, exactly,
   and the entries that reach the cutoff are ranked.

Defined results: vectors that are null or hold null, NaN or infinite
components take no part; a shorter vector counts as filled up with zeros; a
query id that repeats is searched once, with its least vector; a candidate
with the query's id is never a result; repeated rows of other candidates are
entries of their own; equal scores are ranked by id; rows without an id take
no part; fewer candidates than ``k`` are all returned.

Scale: every query meets every candidate, in blocks; nothing is broadcast. A
task sends at most ``k`` entries of each query, however many candidates tie.
Candidates are dealt by row, not by id or value, so equal vectors are no hot
block. Scores are exact: products of integers are added in 64-bit floats where
no sum can pass 2^53, and in 64-bit integers elsewhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def matrix(t: pa.Table, width: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the vectors, filled up with zeros to ``width`` components."""
    lists = t.column("v").combine_chunks()
    lists = lists if isinstance(lists, pa.ListArray) else pa.concat_arrays(lists.chunks)
    at = np.asarray(lists.offsets, np.int64)
    flat = np.floor(scale * np.asarray(lists.values, np.float64))
    sizes = np.diff(at)
    out = np.zeros((len(sizes), width))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(at[0], at[-1]) - np.repeat(at[:-1], sizes)] = flat[at[0] : at[-1]]
    return out


def exact(queries: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as floats where their inner products are exact so, else as integers."""
    top = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    return (queries, candidates) if top < 2**53 else (queries.astype(np.int64), candidates.astype(np.int64))


def partials(q: np.ndarray, c: np.ndarray, groups: int) -> list[np.ndarray]:
    """A score matrix for each group of components."""
    cuts = np.linspace(0, q.shape[1], groups + 1).astype(int)
    return [q[:, i:j] @ c[:, i:j].T for i, j in zip(cuts, cuts[1:])]


def pairs_of(left: pa.Table, right: pa.Table, scale: int, rows: int = 128):
    """Slices of the queries of a block with all candidates of a block: ids, matrices, and where both have one id."""
    width = max((max(np.diff(np.asarray(pa.concat_arrays(t.column("v").chunks).offsets)), default=0) for t in (left, right)), default=0)
    q, c = exact(matrix(left, width, scale), matrix(right, width, scale))
    q_id, c_id = (np.asarray(t.column("vec_id"), np.int64) for t in (left, right))
    for i in range(0, len(q_id), rows):
        yield slice(i, i + rows), q_id[i : i + rows], q[i : i + rows], c_id, c


def best(row: np.ndarray, col: np.ndarray, score: np.ndarray, c_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the entries that are among the ``k`` best of their row, ties to the smaller id."""
    order = np.lexsort((c_id[col], -score, row))
    r = row[order]
    starts = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.zeros(0, np.int64)
    rank = np.arange(len(r)) - np.repeat(starts, np.diff(np.append(starts, len(r))))
    return order[rank < k]


OUT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def entries(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.Table:
    columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3)]
    return pa.table([pa.array(x.astype(np.int64)) for x in columns], schema=OUT)


def search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, groups: int = 4, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best candidates of each row for which ``is_query`` holds."""
    staged = Staged(vectors.sparkSession, "topk")
    rows = valid(vectors)
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_rows, n_queries = rows.agg(F.count(F.lit(1)), F.count_distinct(F.when(is_query, F.col("vec_id")))).first()
    n_blocks, n_query_blocks = max(1, math.ceil(n_rows / block)), max(1, math.ceil(n_queries / query_block))
    q_block = F.pmod(F.xxhash64("vec_id"), F.lit(n_query_blocks)).cast("int")
    queries = staged.write(queries.withColumn("qb", q_block))
    dealt = rows.withColumn("cb", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)).cast("int"))
    dealt = dealt.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))).groupBy("qb", "cb")
    to_all = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))

    def local_lists(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            for _, q_id, q, c_id, c in pairs_of(left, right, scale):
                parts = partials(q, c, groups)
                own = q_id[:, None] == c_id[None, :]
                listed = np.zeros(own.shape, bool)
                for p in parts:
                    top = np.argpartition(-p, min(k, p.shape[1] - 1), axis=1)[:, : k + 1]
                    listed[np.arange(len(q_id))[:, None], top] = True
                row, col = np.nonzero(listed & ~own)
                score = sum(p[row, col] for p in parts)
                at = best(row, col, score, c_id, k)
                out.append((q_id[row[at]], c_id[col[at]], score[at]))
        return entries(out)

    def sufficient(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            cutoff = np.array([-(2**62) if x is None else x for x in left.column("cutoff").to_pylist()], np.int64)
            for at, q_id, q, c_id, c in pairs_of(left, right, scale):
                parts = partials(q, c, groups)
                least = cutoff[at]
                uniform = -((-least) // groups)[:, None]  # an integer partial score of at least cutoff / groups
                some = parts[0] >= uniform
                for p in parts[1:]:
                    some |= p >= uniform
                some &= q_id[:, None] != c_id[None, :]
                row, col = np.nonzero(some)
                score = sum(p[row, col] for p in parts).astype(np.int64)
                reach = score >= least[row]
                row, col, score = row[reach], col[reach], score[reach]
                top = best(row, col, score, c_id, k)
                out.append((q_id[row[top]], c_id[col[top]], score[top]))
        return entries(out)

    schema = "query_id long, vec_id long, score long"
    asked = queries.withColumn("cb", to_all).groupBy("qb", "cb")
    lists = asked.cogroup(dealt).applyInArrow(local_lists, schema)
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cutoffs = lists.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") == k)
    cutoffs = staged.write(cutoffs.select(F.col("query_id").alias("vec_id"), F.col("score").alias("cutoff")))
    asked = queries.join(cutoffs, "vec_id", "left").withColumn("cb", to_all).groupBy("qb", "cb")
    found = asked.cogroup(dealt).applyInArrow(sufficient, schema)
    ranked = found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
