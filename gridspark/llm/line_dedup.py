"""Line dedup by levelled sorted runs of line hashes.

Documents are taken in batches, and the line hashes of a batch are counted:
``(h1, h2, n_docs, max_doc)``. A merge-anti-join with the runs so far gives the
hashes that none of them holds; these, sorted, are the batch's own run, so a hash is
in one run only. Hashes that a run holds are updates of its count. Runs are
kept in levels: when a level holds ``fanout`` runs they are compacted into one
run of the next level. After the last batch the runs with the sums of their
updates tell which lines are in at least ``min_docs`` documents.

Defined results:

* null or empty text: one empty line; nothing is dropped;
* the key of a line is the line without ``[\\x20\\x09-\\x0D]`` at both ends and
  with A-Z in lower case; keys shorter than ``min_key`` code points stay;
* a key in at least ``min_docs`` documents keeps its lines (all of them) only
  in the document with the largest id;
* rows that repeat an id count as one document; rows without an id are kept
  as they are and count for nothing;
* a text of which all lines go becomes the empty text; an empty table gives
  an empty table; other columns pass through, whatever their names.

Scale: texts are shuffled once, for the join with the lines to drop. Line
hashes are 128 bits and are aggregated before they are shuffled by key, so a
line that a third of all documents hold costs a row for each task. The join
of lines with duplicate keys reads both sides from written tables, so Spark
can split a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged, ascii_lower

SPACE = " \t\n\x0b\x0c\r"
KEY = ["_ld_h1", "_ld_h2"]
ROW = ["_ld_doc", "_ld_text"]


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def line_hashes(docs: DataFrame, min_key: int, batches: int) -> DataFrame:
    """A row for each line long enough: document, place in it, 128-bit hash of the key, batch."""
    text = F.coalesce("text", F.lit(""))
    lines = docs.where("doc_id is not null").select(
        F.col("doc_id").alias("_ld_doc"),
        F.xxhash64(text).alias("_ld_text"),
        F.posexplode(F.split(text, "\n", -1)).alias("_ld_pos", "_ld_line"),
    )
    keyed = lines.withColumn("_ld_key", line_key(F.col("_ld_line"))).where(F.char_length("_ld_key") >= min_key)
    return keyed.select(
        *ROW, "_ld_pos",
        F.xxhash64("_ld_key").alias("_ld_h1"),
        F.xxhash64(F.lit("second"), "_ld_key").alias("_ld_h2"),
        F.pmod(F.xxhash64("_ld_doc"), F.lit(batches)).cast("int").alias("_ld_batch"),
    )


def compacted(runs: list[DataFrame]) -> DataFrame:
    """One sorted run of several; no hash is in two of them."""
    return reduce(DataFrame.unionByName, runs).repartition(*KEY).sortWithinPartitions(*KEY)


def runs_of(lines: DataFrame, staged: Staged, batches: int, fanout: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The sorted runs left after all batches, level by level, and the updates of their counts."""
    levels: list[list[DataFrame]] = [[]]
    updates = []
    for b in range(batches):
        new = staged.write(
            lines.where(F.col("_ld_batch") == b)
            .groupBy(*KEY)
            .agg(F.count_distinct("_ld_doc").alias("n_docs"), F.max("_ld_doc").alias("max_doc"))
        )
        before = [r.select(*KEY) for level in levels for r in level]
        fresh = new
        if before:
            known = reduce(DataFrame.unionByName, before).hint("merge")
            fresh = new.join(known, KEY, "left_anti")
            updates.append(staged.write(new.join(known, KEY, "left_semi")))
        levels[0].append(staged.write(fresh.sortWithinPartitions(*KEY)))
        staged.drop(new)
        k = 0
        while len(levels[k]) >= fanout:
            if k + 1 == len(levels):
                levels.append([])
            levels[k + 1].append(staged.write(compacted(levels[k])))
            staged.drop(*levels[k])
            levels[k] = []
            k += 1
    return [r for level in levels for r in level], updates


def totals(runs: list[DataFrame], updates: list[DataFrame]) -> DataFrame:
    """(h1, h2, n_docs, max_doc) over all batches: each run's row with the updates of its hash."""
    rows = reduce(DataFrame.unionByName, runs)
    if not updates:
        return rows
    more = reduce(DataFrame.unionByName, updates).groupBy(*KEY).agg(F.sum("n_docs").alias("_ld_more"), F.max("max_doc").alias("_ld_max"))
    return rows.join(more, KEY, "left").select(
        *KEY, (F.col("n_docs") + F.coalesce("_ld_more", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "_ld_max").alias("max_doc"))


def dedup_lines(docs: DataFrame, min_key: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and ``n_lines`` and ``n_dropped``."""
    spark = docs.sparkSession
    staged = Staged(spark, "line-dedup")
    lines = staged.write(line_hashes(docs, min_key, batches))
    runs, updates = runs_of(lines, staged, batches, fanout)
    often = staged.write(totals(runs, updates).where(F.col("n_docs") >= min_docs).select(*KEY, "max_doc"))
    drops = staged.write(
        lines.join(often, KEY)
        .where(F.col("_ld_doc") != F.col("max_doc"))
        .groupBy(*ROW)
        .agg(F.array_sort(F.collect_set("_ld_pos")).alias("_ld_drop"))
    )
    staged.drop(lines, often, *runs, *updates)
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"_ld_doc": F.col("doc_id"), "_ld_text": F.xxhash64(text)})
    joined = rows.join(drops.hint("shuffle_hash"), ROW, "left").withColumn("_ld_lines", F.split(text, "\n", -1))
    cut = F.col("_ld_drop")
    starts = F.concat(F.array(F.lit(0)), F.transform(cut, lambda x: x + 1))
    ends = F.concat(cut, F.array(F.size("_ld_lines")))
    parts = F.zip_with(starts, ends, lambda s, e: F.slice(F.col("_ld_lines"), s + 1, e - s))
    return joined.select(
        *[c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")],
        F.when(cut.isNull(), text).otherwise(F.array_join(F.flatten(parts), "\n")).alias("text"),
        F.size("_ld_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_dropped"),
    )
