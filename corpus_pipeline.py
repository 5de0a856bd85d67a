"""The corpus pipeline: `documents` filtered, cleaned, deduplicated, mixed and encoded.

Each stage takes (spark, docs, sf_dir), with docs the rows its predecessor left, and returns documents' columns; the last adds the
pieces' ids. Stages are judged on their own input: counts, shingles and sizes are those of the rows they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import line_dedup, mixing, ngram_join, quality, sentencepieces
from tidewater.llm.common import free, shared_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. The classifier learns from the labelled ones among docs."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = free(docs.columns, "score")
    scored = quality.score_documents(docs, weights, to=score)
    return scored.where(quality.predicted(F.col(score)) == 1).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share go, and n_chars follows the text."""
    lines, dropped = free(docs.columns, "lines", "dropped")
    kept = line_dedup.drop_lines(docs, lines=lines, dropped=dropped)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents one row stays, the one with the smallest doc_id.

    Rows are judged by doc_id and text: rows that share a doc_id with different texts stay or go by their own. Of rows that repeat both one stays. Rows without
    a doc_id take part, and stay only where no other of their group has one. Rows with an empty set of shingles are in no group and all stay.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    by, gone, n = free(docs.columns, "key", "gone", "n")
    groups = ngram_join.similar_groups(docs.select(key.alias("doc_id"), "text")).where("n_shingles > 0")
    # rows of one key have one text, so one component; what is neither gone nor repeated needs no verdict
    verdicts = groups.groupBy("doc_id").agg((F.min("component_id") != F.col("doc_id")).alias(gone), F.count("*").alias(n)).where(F.col(gone) | (F.col(n) > 1))
    verdicts = shared_table(verdicts.withColumnRenamed("doc_id", by), "verdicts")
    sized = F.broadcast(verdicts) if verdicts.count() <= ngram_join.BROADCAST_ROWS else verdicts
    met = docs.withColumn(by, key).join(sized, by, "left").where(~F.coalesce(F.col(gone), F.lit(False)))
    left = met.where(F.col(n).isNull())
    if verdicts.where(~F.col(gone)).head(1):
        left = left.unionByName(met.where(F.col(n).isNotNull()).dropDuplicates([by]))
    return left.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(docs, to="ids")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]

#: SQL can't express the classifier, the rounding or the encoding; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each leaves is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs, f"stage{i}")
    return docs
