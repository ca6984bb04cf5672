"""Corpus pipeline: stages over ``documents``, each written and read again before the next.

Each stage works on all documents that the stage before it kept, and all but
the last return the columns of ``documents``:

* quality rules drop the documents that they reject;
* line dedup replaces the text by its kept lines (``n_chars`` follows);
* MinHash near-dedup keeps the smallest id of each group of near copies (a
  similarity of 0.8 or more on shingles of five words);
* the secret scan replaces secrets in the text by a mark (``n_chars`` follows);
* packing returns the pieces of the documents in sequences of 2048 tokens.

Rows without an id stay. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm import line_dedup, minhash, packing, quality, secrets
from gridspark.llm.common import DOC_COLUMNS, Staged, table
from gridspark.llm.entries import tokenizer_file


#: Least similarity of near copies, in percent, on shingles of five words (``op10_minhash_dedup`` alone has 85).
NEAR_PCT = 80


def documents(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``, with ``n_chars`` as the text has them."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")).select(*DOC_COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs.select(*DOC_COLUMNS), model).where("kept").select(*DOC_COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return documents(line_dedup.dedup_lines(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_dups(docs, threshold_pct=NEAR_PCT, width=5).select(*DOC_COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return documents(secrets.redact(docs, F.concat_ws("/", "source", "lang"), F.col("source")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end_id=1, digest=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", near_dedup),
    ("secret scans", secret_scan),
    ("packing", pack),
]
#: The first stage is a trained model and the last one a heuristic over tokens: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole ``documents`` table."""
    docs, staged = table(spark, sf_dir, "documents"), Staged(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged.write(docs)
    return docs
