"""From raw documents to encoded training text, as stages that each keep a written table.

Toxic documents go, then all but one of each group of near copies, then
documents with benchmark passages; personal data is replaced by its kind, and
what is left is encoded. Each stage works on all that the one before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parterre.llm import bpe_chunks, decontam, ngram_join, pii, toxicity
from parterre.llm.common import row_key, store, table
from parterre.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.7


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``TOXIC``."""
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), keep=tuple(COLUMNS))
    return scored.where(F.col("score") < TOXIC).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that links join, once if rows repeat it.

    Documents without words are groups of their own, and those without an id stay. Where rows share an id but not
    the text, they stay if one of them does.
    """
    found = ngram_join.components(docs)
    first = store(found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("first")).distinct(), "pipeline-firsts")
    kept = docs.join(first.hint("merge"), F.col("doc_id") == F.col("first"))
    single = kept.withColumn("key", row_key(kept)).groupBy("doc_id", "key").agg(*[F.first(c).alias(c) for c in COLUMNS[1:]])
    return single.select(*COLUMNS).unionByName(docs.where(F.col("doc_id").isNull()).select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; a contaminated one goes."""
    judged = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS))
    return judged.where(~F.col("contaminated")).select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; ``n_chars`` follows the text."""
    found = pii.personal_data(docs, keep=tuple(COLUMNS))
    text = pii.redacted(F.col("text"), F.col("spans"))
    return found.withColumn("text", text).withColumn(
        "n_chars", F.when(F.size("spans") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document as 4-byte integers, and their number, after a round trip."""
    ids = bpe_chunks.encode_documents(docs, tokenizer_path(), keep=("doc_id", "lang", "source"))
    return ids.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("ngram_join", without_copies),
    ("benchmark_decontamination", decontaminated),
    ("pii", redacted),
    ("bpe_encoding", encoded),
]

#: Toxicity scores and discovered identifiers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
