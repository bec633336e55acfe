"""Corpus pipeline: documents through five stages to packed training sequences.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all that its
predecessor kept; its result is written as Parquet and read back for the next.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outagelens.llm import jaccard_join, ngram_lm, pairwise_rank, queries, secret_scan
from outagelens.llm._common import quoted, ship, stored
from outagelens.session import configure


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or leave the perplexity band of their language go."""
    ship(configure(spark))
    return ngram_lm.quality_rules(docs, keep=docs.columns, name="stage-rules").where("_q_kept").select(*quoted(docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents under the score threshold go; the ranking is learned from ``labels``."""
    ship(configure(spark))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ranked = pairwise_rank.rank_documents(docs, labels, keep=docs.columns, name="stage-ranking")
    return ranked.where("_r_predicted = 1").select(*quoted(docs.columns))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Rows without an id stay; repeated rows (equal id and text) become one. An id
    that is removed from a group is removed with all its rows.
    """
    ship(configure(spark))
    groups = jaccard_join.similar_documents(docs)
    removed = groups.where("doc_id <> component_id").select("doc_id").distinct()
    kept = docs.join(removed, "doc_id", "left_anti")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(
        kept.where("doc_id is null")).select(*quoted(docs.columns))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    ship(configure(spark))
    found = secret_scan.scan_secrets(docs, keep=docs.columns)
    clean = found.withColumn("text", secret_scan.redact(F.col("text"), F.col("_s_spans")))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*quoted(docs.columns))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    ship(configure(spark))
    return queries.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scans", secret_scans),
    ("packing", packing),
]

#: language model, ranking, tokenizer and redaction are beyond SQL; the tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
