"""Queries of this folder for the driver, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hard_negatives, lattice, line_dedup, minhash, packing, pii, quality, secrets, spelling, tokens, topk, toxicity
from .common import held_out, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    repo = F.concat_ws("/", "source", "lang")
    return secrets.digest(secrets.scan(docs.select("doc_id", "text", "source", "lang"), repo, F.col("source")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.format_chats(turns.unionByName(extra)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; every machine has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, digest=True)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, tokenizer_file("byte_bpe_50k.json"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lattice.digest(lattice.encode_texts(docs, lattice.read_pieces(spark, tokenizer_file("piece_bpe_32k.model"))))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).drop("text")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(vectors, F.col("vec_id") % 50 == 0)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling.variants(spelling.words(docs, drop_every=31, min_length=7, min_count=2))


QUERIES = {f.__name__: f for f in (
    op1_secret_scan, op2_packing, op3_toxicity, op4_chat_format, op5_line_dedup, op6_token_counts, op7_sentencepiece,
    op8_quality_rules, op9_topk_search, op10_minhash_dedup, op11_hard_negatives, op12_personal_data, op13_spelling_variants)}

ORACLES: dict[str, str] = {}
ORACLES["op4_chat_format"] = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') as body,
         replace(replace(replace(replace(role, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>'), ':', '\:') as head
  from turns)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(head) + length(body) + 14) as bigint) as formatted_chars
from sized group by conv_id
"""
ORACLES["op9_topk_search"] = r"""
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as double) for x in embedding] as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len([1 for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""
ORACLES["op5_line_dedup"] = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
often as (
  select key, max(doc_id) as max_doc from keyed
  where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
marked as (
  select k.doc_id, k.pos, k.line, coalesce(o.max_doc <> k.doc_id, false) as dropped
  from keyed k left join often o on k.key = o.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""
ORACLES["op11_hard_negatives"] = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [cast(floor(256 * cast(x as double)) as double) for x in embedding] as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([1 for x in embedding if x is null or isnan(x) or isinf(x)]) = 0),
scored as (
  select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, cast(list_inner_product(a.e, c.e) as bigint) as score
  from v a, v c where a.vec_id % 50 = 0 and a.vec_id <> c.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score,
         row_number() over (partition by anchor_id order by score desc, vec_id) as place
  from scored where same),
negatives as (
  select p.*, n.vec_id as negative_id, n.score as negative_score,
         row_number() over (partition by p.anchor_id, p.place order by n.score desc, n.vec_id) as rank
  from positives p join scored n on n.anchor_id = p.anchor_id
  where p.place <= 5 and not n.same
    and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score
from negatives where rank <= 3
"""
