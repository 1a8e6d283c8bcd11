"""Verdicts as a stream with state: of each key what its records say so far, whatever the batches they come in.

The state is a streaming aggregate, so it stays in Spark's state store, in partitions by key, and each batch touches only the
keys it has records of. Every part of it is the same in any order of arrival: whether the absorbing status was ever said, the
last status by the records' own order, and the last one that leaves a doubt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quizlake import schemas
from quizlake.operators import load
from quizlake.sources.scratch import materialize


def latest(records: DataFrame, keys: list[str], status: Column, order: Column, held: str, settled: list[str]) -> DataFrame:
    """keys, held, last, doubt of every key: for a stream, of the keys of a batch, over all batches so far (output mode update).

    held: whether any record has that status; last: the status of the last record by order, of those that have one; doubt:
    the last one that isn't among settled, or null.
    """
    doubt = status.isNotNull() & ~status.isin(*settled)
    return records.groupBy(*keys).agg(
        F.coalesce(F.bool_or(status == held), F.lit(False)).alias("held"),
        F.max_by(status, F.when(status.isNotNull(), order)).alias("last"),
        F.max_by(status, F.when(doubt, order)).alias("doubt"),
    )


def verification_lines(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of verification records with ord, their file and line. A file is one row until it is split, so its size is a task's."""
    reader = spark.readStream.format("text").option("wholetext", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.load(folder).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text")).where(F.trim("text") != "")
    return lines.select(F.from_json("text", schemas.struct_type(schemas.VERIFICATION_RECORD), {"mode": "FAILFAST"}).alias("r"), F.struct("path", "line").alias("ord")).select("r.*", "ord")


def of_versions(records: DataFrame) -> DataFrame:
    """The verdicts that records give on each version of a question that their runs solved."""
    rows = records.select("paper_id", "section", "q_no", "official_answer", "status", "ord", F.explode(F.array_distinct(F.transform("verifications", lambda v: v["question_version"]))).alias("question_version"))
    keys = ["paper_id", "section", "q_no", "official_answer", "question_version"]
    return latest(rows.where("question_version is not null"), keys, F.col("status"), F.col("ord"), load.REVIEWED, list(load.CONFIRMED))


def stream_verdicts(spark: SparkSession, folder: str, bank_root: str, checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Sets key statuses and review items from the verdicts of new files, and what of mocks is published.

    However the files come, in whatever order and batches, the bank ends as after one load of all their verdicts, as long as
    its questions stay the same; a verdict on a version that isn't current when it comes waits for a load. A batch reads and
    writes only partitions of papers it has verdicts of, but for the publishing; one that is run again changes nothing, and a
    malformed record fails it. Runs are loaded by ``stream_verifications`` or a load, and verdicts aren't withdrawn here.
    """

    def one(batch: DataFrame, _: int) -> None:
        verdicts = materialize(batch, "verdicts", batch.sparkSession)

        def work(state: load.State) -> None:
            load.set_verdicts(state, verdicts)
            load.publish_mocks(state)

        load.into(batch.sparkSession, bank_root, work)

    stream = of_versions(verification_lines(spark, folder, files_per_batch)).writeStream.outputMode("update")
    return stream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
