"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Each text is searched for three base kinds and for wider candidates (tokens
of a known form, and long tokens that mix letters and digits). The value of
each match is hashed with its kind, and the hashes are aggregated over the
whole corpus: how often, in how many repositories and with how many owners
does the value occur? A value that at least ``copied_owners`` owners hold is a
copied example; a value with fewer owners looks live. Base spans stay whatever their frequency; a wider
candidate becomes a span only if it looks live.

Defined results:

* null or empty text: no span; an empty table gives an empty table;
* matches are leftmost and do not overlap within a kind; positions are code
  points, the end is exclusive;
* letters of the ``assign`` keywords match A-Z in either case and nothing else;
* a null repository or owner counts as one repository or owner of its own;
* repeated rows each give a row; they add no owner; other columns of the
  input pass through unless one of the result's names clashes with theirs,
  in which case the result's column is returned.

Scale: one scan of the texts writes the spans (no text) to the shared folder;
only candidates are shuffled. Frequencies are summed by (value, owner,
repository), then by (value, owner), then by value, each with partial sums
before the shuffle, so a value that a third of all rows hold is no hot task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base kinds in their order: pattern, group of the value, least length of the value. A run of {24,} is a run of + that is long enough.
BASE = {
    "assign": (ASSIGN, 2, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: Wider candidates; they become spans only by their ownership.
WIDER = {
    "prefixed": (r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|eyJ)[A-Za-z0-9_.-]{16,}", 0, 20),
    "mixed": (r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 0, 20),
}
KINDS = [*BASE, *WIDER]


def found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, kind number, end, value) of the matches whose value is long enough.

    The pieces between the matches come from ``split`` and the matches from
    ``regexp_extract_all``; both walk the text in the same way, so the running
    sum of their lengths gives the positions.
    """
    lit = F.lit(pattern)
    number = KINDS.index(kind)
    return F.when(F.regexp_like(text, lit), F.filter(_placed(text, lit, pattern, group, number), lambda m: F.char_length(m["value"]) >= least))


def _placed(text: Column, lit: Column, pattern: str, group: int, number: int) -> Column:
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, lit, F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, lit, F.lit(group))
    matches = F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), value.alias("value"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["piece"])
        end = start + F.char_length(m["whole"])
        one = F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end"), m["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["got"], F.array(one)).alias("got"))

    some = F.filter(matches, lambda m: m["whole"].isNotNull())
    return F.aggregate(some, F.struct(F.lit(0).alias("at"), empty.alias("got")), step, lambda acc: acc["got"])


def scan(docs: DataFrame, repo: Column, owner: Column, copied_owners: int = 3) -> DataFrame:
    """``docs`` without text, with ``spans`` as an array of (start, kind, end, base, copied, n_matches, n_repos, n_owners).

    ``copied`` tells whether at least ``copied_owners`` owners hold the value.
    """
    staged = Staged(docs.sparkSession, "secrets")
    keep = [c for c in docs.columns if c not in ("text", "spans")]
    text = F.coalesce("text", F.lit(""))
    kinds = {k: found(text, k, *v) for k, v in (BASE | WIDER).items()}
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    every = F.concat(*[F.coalesce(k, none) for k in kinds.values()])
    hashed = F.transform(every, lambda m: F.struct(
        m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end"), F.sha2(F.concat_ws(":", m["kind"].cast("string"), m["value"]), 256).alias("hash")))
    rows = staged.write(docs.select(
        *keep, F.monotonically_increasing_id().alias("_ss_row"),
        F.coalesce(repo.cast("string"), F.lit("")).alias("_ss_repo"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("_ss_owner"),
        F.array_sort(hashed).alias("_ss_found")))

    one = rows.select("_ss_row", "_ss_repo", "_ss_owner", F.explode("_ss_found").alias("m"))
    one = one.select("_ss_row", "_ss_repo", "_ss_owner", "m.start", "m.kind", "m.end", "m.hash")
    per_doc = one.groupBy("hash", "_ss_owner", "_ss_repo").agg(F.count(F.lit(1)).alias("n"))
    per_owner = per_doc.groupBy("hash", "_ss_owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    often = per_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_matches"))
    often = staged.write(often)  # a plain table, so that Spark can split the join of a hot value
    judged = one.join(often, "hash").withColumn("copied", F.col("n_owners") >= copied_owners)
    base = F.col("kind") < len(BASE)
    spans = (
        judged.where(base | ~F.col("copied"))
        .groupBy("_ss_row")
        .agg(F.array_sort(F.collect_list(F.struct(
            "start", "kind", "end", base.alias("base"), "copied", "n_matches", "n_repos", "n_owners"))).alias("spans"))
    )
    return rows.drop("_ss_found", "_ss_repo", "_ss_owner").join(spans, "_ss_row", "left").drop("_ss_row")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found_spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    none = F.array().cast(found_spans.schema["spans"].dataType)
    rows = found_spans.select("doc_id", F.coalesce("spans", none).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id", *[count(k) for k in BASE],
        F.sha2(joined(F.filter("s", lambda x: x["base"])), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: x["copied"])).cast("long").alias("n_copied"),
        F.size(F.filter("s", lambda x: ~x["copied"])).cast("long").alias("n_live"),
    )


def redact(docs: DataFrame, repo: Column, owner: Column, copied_owners: int = 3, mark: str = "<secret>") -> DataFrame:
    """``docs`` with each span that looks live, and each base span, replaced by ``mark`` in the text.

    Overlapping spans are replaced as one. The document stays; its other
    columns are unchanged. Rows are told apart by a row number that the staged
    spans carry beside the text, so repeated rows are safe.
    """
    staged = Staged(docs.sparkSession, "redact")
    names = docs.columns
    numbered = staged.write(docs.withColumn("_ss_id", F.monotonically_increasing_id()))
    spans = scan(numbered.select("_ss_id", "text", repo.alias("_ss_r"), owner.alias("_ss_o")), F.col("_ss_r"), F.col("_ss_o"), copied_owners)
    spans = spans.where("spans is not null").select("_ss_id", F.col("spans").alias("_ss_spans"))
    text = F.coalesce("text", F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        """Text up to the span and the mark; a span that begins before the end of the last one only moves that end."""
        more = F.concat(acc["out"], F.substring(F.col("_ss_text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when((s["start"] < acc["at"]), acc["out"]).otherwise(more).alias("out"))

    out = numbered.withColumn("_ss_text", text).join(spans.hint("shuffle_hash"), "_ss_id", "left")
    cleaned = F.aggregate("_ss_spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("_ss_text"), acc["at"] + 1, F.char_length("_ss_text"))))
    return out.withColumn("text", F.when(F.col("_ss_spans").isNull(), F.col("text")).otherwise(cleaned)).select(*names)
