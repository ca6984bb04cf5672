"""Personal data by candidate gradient boosting, in DataFrame functions and Spark's boosted trees only.

1. *Base kinds* (e-mail, IP address, card, phone) have exact patterns and checks;
   their spans always count.
2. *Generators* of high recall propose further, overlapping spans: runs of
   digits, digits joined by dots or dashes, digits spaced out in groups, and
   e-mail addresses that lack a domain's end or are written out (``[at]``,
   `` dot ``).
3. Each candidate gets whole-numbered features of its format and its context. It
   counts as positive if it overlaps a base span. The marks that tell
   base spans (a leading plus sign, a checksum, a range of parts, a domain) are no features, so what looks like personal data but misses a
   check, or lacks the mark, scores as its equals do. Written-out addresses,
   which no base span can overlap, are scored but never learned from.
4. Boosted trees are fitted on the counts of all distinct (features, positive)
   of the documents that are not held out.
5. Thresholds are calibrated on the held-out fifth (crc32 of the id mod 5 = 0), for
   each generator: the least score from which on the candidates are positive
   with at least ``precision``, overall and, at that score alone, with half of it. A
   generator with fewer than ``least`` held-out positives selects nothing;
   written-out addresses take the threshold of the ``mail`` generator.
6. Candidates from their threshold on that do not overlap a base span become
   spans as well.

Defined results: null or empty text has no span; matches are leftmost and do not
overlap within a kind; positions are code points, the end is exclusive;
selected candidates of different generators may overlap each other; a null id
is never held out; repeated rows each give a row and count as often as they
occur; without positives or negatives no candidate is selected; an empty table gives an
empty table; other columns pass through, except where their name is ``spans``.

Scale: one scan of the texts writes spans and features (no text). Only
candidates are shuffled, by row; a row's spans are compared in a sorted window,
so many spans of a long text cost no pairs. The trees are fitted on counts
summed by features before and after the shuffle, so repeated candidates are one
row; the bins of the features bound the number of rows (at most the product of
``LEVELS``, some hundreds in practice). Thresholds go through the driver: a
row for each generator.
"""

from __future__ import annotations

from math import prod

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, held_out

LOCAL, LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
#: The base kinds in their order. Possessive runs that begin where no match could have begun before: equal to the plain patterns, in linear time.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
AT, DOT = r"(?:\x20?[\[({]at[\])}]\x20?|\x20at\x20)", r"(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20)"
#: The generators. ``written`` has no base span to learn from.
GENERATORS = {
    "mail": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)*+",
    "written": rf"(?<!{LOCAL}){LOCAL}++{AT}{LABEL}++(?:(?:{DOT}|\.)[A-Za-z]++)++",
    "digits": r"(?<![0-9])[0-9]{7,}+",
    "joined": r"(?<![0-9])(?<![0-9][.-])[0-9]++(?:[.-][0-9]++)++",
    "spaced": r"(?<![0-9])(?:\([0-9]{1,5}\)|[0-9]++)(?:[\x20.-]{1,2}(?:\([0-9]{1,5}\)|[0-9]++)){2,6}+",
}
UNTAUGHT = {"written": "mail"}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "mail": "@", "phone": r"\+[0-9]", "written": r"[\])}\x20]dot[\[({\x20]|[\[({]at[\])}]"}
DIGITS = "[0-9]"
KINDS = [*BASE, *GENERATORS]
BYTE_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Words before a candidate that tell what it is.
CONTEXT = [r"(?i)mail|contact|write", r"(?i)phone|tel|call|fax|mobil", r"(?i)card|visa|credit|account|iban", r"(?i)\bip\b|host|server|address",
           r"(?i)version|section|page|chapter|licen[sc]e|\bno\b|[#$€£]"]
#: Features and the number of values each can have; larger values count as the last one.
LEVELS = {"digits": 24, "groups": 8, "longest": 20, "marks": 8, "first": 11, "letters": 16, "dotted": 2, "before": 6, "after": 6, "context": 6, "at": 3}


def luhn(digits: Column) -> Column:
    """Whether the checksum of a card number holds."""
    n = F.char_length(digits)

    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


CHECKS = {
    "ip": lambda v: F.regexp_like(v, F.lit(rf"^{BYTE_PART}(?:\.{BYTE_PART}){{3}}$")),
    "card": lambda v: luhn(only_digits(v)),
    "phone": lambda v: F.char_length(only_digits(v)).between(9, 15),
}


def side(text: Column) -> Column:
    """Kind of the character next to a candidate: none or space, letter, digit, stop or comma, quote or sign of assignment, other."""
    kinds = [r"^[\s]?$", r"^[A-Za-zÀ-ÿ_]$", "^[0-9]$", "^[.,;!?]$", "^[\"'=:`]$"]
    out = F.when(F.regexp_like(text, F.lit(kinds[0])), 0)
    for i, p in enumerate(kinds[1:], 1):
        out = out.when(F.regexp_like(text, F.lit(p)), i)
    return out.otherwise(5)


def features(m: Column) -> Column:
    """Array of the features of a match (value, before, after), in the order of ``LEVELS``."""
    at = F.when(F.contains(m["value"], F.lit("@")), 1).when(F.regexp_like(m["value"], F.lit(AT)), 2).otherwise(0)
    v = F.when(at > 0, F.regexp_extract(m["value"], rf"^{LOCAL}+", 0)).otherwise(m["value"])  # of an address the part before the sign
    runs = F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))
    context = F.lit(0)
    for i, p in reversed([*enumerate(CONTEXT, 1)]):
        context = F.when(F.regexp_like(m["before"], F.lit(p)), i).otherwise(context)
    some = {
        "digits": F.char_length(only_digits(v)),
        "groups": F.size(runs),
        "longest": F.coalesce(F.array_max(F.transform(runs, F.char_length)), F.lit(0)),
        "marks": F.char_length(F.regexp_replace(v, r"[^\x20().-]", "")),
        "first": F.coalesce(F.left(only_digits(v), F.lit(1)).try_cast("int"), F.lit(10)),
        "letters": F.char_length(F.regexp_replace(v, "[^A-Za-z]", "")),
        "dotted": F.regexp_like(v, F.lit("[0-9][.][0-9]")).cast("int"),
        "before": side(F.right(m["before"], F.lit(1))),
        "after": side(F.left(m["after"], F.lit(1))),
        "context": context,
        "at": at,
    }
    return F.array(*[F.least(some[k], F.lit(n - 1)).cast("int") for k, n in LEVELS.items()])


SPAN = "array<struct<start:int,kind:int,end:int,f:array<int>>>"


def found(text: Column, kind: str) -> Column:
    """Array of (start, kind, end, features) of the matches of a kind that pass its check; base kinds have no features.

    ``split`` and ``regexp_extract_all`` walk the text alike, so the running sum
    of the lengths of pieces and matches gives the positions, and the pieces
    around a match its context.
    """
    pattern = (BASE | GENERATORS)[kind]
    pieces = F.split(text, pattern, -1)
    after = F.slice(pieces, F.lit(2), F.size(pieces))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    matches = F.filter(F.arrays_zip(pieces.alias("before"), whole.alias("value"), after.alias("after")), lambda m: m["value"].isNotNull())
    empty = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.char_length(m["before"])
        end = start + F.char_length(m["value"])
        one = F.struct(start.alias("start"), end.alias("end"), m["value"].alias("value"), F.right(m["before"], F.lit(30)).alias("before"), m["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["got"], F.array(one)).alias("got"))

    placed = F.aggregate(matches, F.struct(F.lit(0).alias("at"), empty.alias("got")), step, lambda acc: acc["got"])
    if kind in CHECKS:
        placed = F.filter(placed, lambda m: CHECKS[kind](m["value"]))
    f = (lambda m: F.lit(None).cast("array<int>")) if kind in BASE else features
    spans = F.transform(placed, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end"), f(m).alias("f")))
    none = F.array().cast(SPAN)
    return F.when(F.regexp_like(text, F.lit(NEEDS.get(kind, DIGITS))), F.coalesce(spans.cast(SPAN), none)).otherwise(none)


def fit(candidates: DataFrame, rounds: int = 12, depth: int = 4) -> GBTClassificationModel | None:
    """Boosted trees on (features, positive, n); none where all candidates are alike."""
    kinds = candidates.agg(F.count_distinct("positive")).first()[0]
    if kinds < 2:
        return None
    rows = candidates.select(array_to_vector(F.col("f").cast("array<double>")).alias("features"), F.col("positive").cast("double").alias("label"), F.col("n").cast("double").alias("weight"))
    return GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, minWeightFractionPerNode=1e-4, weightCol="weight", seed=1).fit(rows)


def scored(candidates: DataFrame, model: GBTClassificationModel) -> DataFrame:
    """``candidates`` with ``score``, the probability of being personal data."""
    out = model.transform(candidates.withColumn("features", array_to_vector(F.col("f").cast("array<double>"))))
    return out.withColumn("score", vector_to_array("probability")[1]).select(*candidates.columns, "score")


def thresholds(checked: DataFrame, precision: float, least: int) -> dict[int, float]:
    """kind: least score from which on scored (kind, positive, n, score) have at least ``precision``."""
    binned = checked.withColumn("bin", F.floor(F.col("score") * 1000).cast("int"))
    sums = binned.groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("positive"), F.col("n")).otherwise(0)).alias("hits"))
    down = Window.partitionBy("kind").orderBy(F.desc("bin"))
    run = sums.select("kind", "bin", (F.col("hits") / F.col("n")).alias("here"), F.sum("hits").over(down).alias("hits"), F.sum("n").over(down).alias("n"))
    good = run.where((F.col("hits") >= precision * F.col("n")) & (F.col("here") >= precision / 2) & (F.col("hits") >= least))
    return {r.kind: r.bin / 1000 for r in good.groupBy("kind").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, precision: float = 0.9, least: int = 10) -> DataFrame:
    """``docs`` without text, with ``spans`` as an array of (start, kind, end, score); base spans have no score."""
    assert prod(LEVELS.values()) < 2**63
    staged = Staged(docs.sparkSession, "pii")
    keep = [c for c in docs.columns if c not in ("text", "spans")]
    text = F.coalesce("text", F.lit(""))
    rows = staged.write(docs.select(
        *keep, F.monotonically_increasing_id().alias("_pii_row"), held_out(F.col("doc_id")).alias("_pii_held"),
        F.concat(*[found(text, k) for k in KINDS]).alias("_pii_found")))

    one = rows.select("_pii_row", F.col("_pii_held").alias("held"), F.inline("_pii_found"))
    base = F.col("kind") < len(BASE)
    by_start = Window.partitionBy("_pii_row").orderBy("start", "kind", "end")
    reach = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(0, Window.unboundedFollowing))
    overlaps = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    spans = staged.write(one.withColumn("positive", overlaps))

    taught = spans.where(~base & ~F.col("kind").isin([KINDS.index(k) for k in UNTAUGHT]))
    counts = staged.write(taught.groupBy("held", "kind", "f", "positive").agg(F.count(F.lit(1)).alias("n")))
    model = fit(counts.where(~F.col("held")).groupBy("f", "positive").agg(F.sum("n").alias("n")))
    chosen = spans.where(base).select("_pii_row", "start", "kind", "end", F.lit(None).cast("double").alias("score"))
    if model is not None:
        limits = thresholds(scored(counts.where("held"), model), precision, least)
        limits |= {KINDS.index(k): limits[KINDS.index(v)] for k, v in UNTAUGHT.items() if KINDS.index(v) in limits}
        limit = F.lit(2.0)
        for kind, at in sorted(limits.items()):
            limit = F.when(F.col("kind") == kind, at).otherwise(limit)
        more = scored(spans.where(~base & ~F.col("positive")), model).where(F.col("score") >= limit)
        chosen = chosen.unionByName(more.select("_pii_row", "start", "kind", "end", "score"))
    listed = chosen.groupBy("_pii_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "score"))).alias("spans"))
    return rows.select(*keep, "_pii_row").join(listed, "_pii_row", "left").drop("_pii_row")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    rows = scanned.select("doc_id", F.coalesce("spans", F.array().cast(scanned.schema["spans"].dataType)).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return rows.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(joined(F.filter("s", lambda x: x["kind"] < len(BASE))), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"), F.size(F.filter("s", lambda x: x["kind"] >= len(BASE))).cast("long").alias("n_added"))


def redact(text: Column, spans: Column, mark: str = "<private>") -> Column:
    """The text with each span replaced by ``mark``; overlapping spans are replaced as one."""
    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(more).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cleaned = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))
    return F.when(spans.isNull(), text).otherwise(cleaned)
