"""Continuous intake of verification files: each micro-batch is a load of its records into the current snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quizlake import schemas
from quizlake.operators import load


def stream_verifications(spark: SparkSession, folder: str, bank_root: str, checkpoint: str) -> StreamingQuery:
    """Loads new files of a folder as they come; a batch that is run again changes nothing, and a malformed record fails it.

    Verdicts aren't withdrawn here, as a batch doesn't see all. Only partitions that changed are written.
    """
    stream = spark.readStream.schema(schemas.VERIFICATION_RECORD).option("mode", "FAILFAST").json(folder)
    stream = stream.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"))

    def one(batch: DataFrame, _: int) -> None:
        place = F.struct(F.col("_path").alias("path"), F.col("_block").alias("block"), F.monotonically_increasing_id().alias("line"))
        records = batch.withColumn("ord", place).drop("_path", "_block").persist()

        def work(state: load.State) -> None:
            load.load_verifications(state, records)
            load.publish_mocks(state)

        load.into(batch.sparkSession, bank_root, work)
        records.unpersist()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
