"""A corpus pipeline: quality, line dedup, near duplicates, benchmark passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm import decontamination, line_dedup, ngram_join, packing, quality
from quizlake.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or over; it learns from the labels of the stage's documents.

    Each text's statistics are taken once and written beside it; the model and the scores read those.
    """
    stats = materialize(quality.statistics_of(docs.select(*COLUMNS), list(COLUMNS)), "statistics", spark)
    model = quality.fit_statistics(stats, quality.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.score_statistics(stats, model, list(COLUMNS)).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that came earlier; one that loses every line goes."""
    out = line_dedup.drop_repeated_lines(docs.select(*COLUMNS))
    kept = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class; documents without an id or words are classes of their own.

    Rows that share a doc_id are one document here: they stay or go together.
    """
    docs = docs.select(*COLUMNS)
    classes = ngram_join.join(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(classes, F.col("doc_id") == F.col("_id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontamination.find_contamination(docs.select(*COLUMNS), items, keep=["text", *COLUMNS[2:]])
    return found.where("n_hit = 0").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with the checksum of their ids."""
    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_lines), ("n-gram join", drop_near_copies), ("decontamination", drop_contaminated), ("packing", pack)]

#: SQL can express neither the classifier nor the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
