"""Helpers shared by the corpus operators: scratch tables, Arrow batches, sizes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.sources.scratch import materialize, shared_dir

__all__ = ["arrow_map", "dealt_numbers", "estimated_bytes", "fold_of", "free_name", "materialize", "prepare", "shards_for", "shared_dir", "slices", "spark_hash", "text_bytes", "texts"]

ROWS_PER_BATCH = 1000
BATCH_BYTES = 4_000_000
ARROW_BYTES = 8_000_000


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of very long texts must fit a Python worker.

    Spark reads both settings when a plan runs, after an operator has returned, so they stay; smaller ones of the caller's do too.
    """
    for key, most in (("maxRecordsPerBatch", ROWS_PER_BATCH), ("maxBytesPerBatch", ARROW_BYTES)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df: for a scan, the size of the files. Where it has none, by a count of rows.

    It sets numbers of shards only; results don't depend on it.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 2000 * df.count()


def shards_for(df: DataFrame, per_shard: int, least: int = 16) -> int:
    return max(least, math.ceil(estimated_bytes(df) / per_shard))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it; Spark takes names of either case as one."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold_of(doc_id, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def spark_hash(x: np.ndarray) -> np.ndarray:
    """The hash by which Spark deals an int: 32-bit Murmur3 of one block with seed 42."""
    turn = lambda v, n: (v << np.uint32(n)) | (v >> np.uint32(32 - n))
    k = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).astype(np.int32)


def dealt_numbers(keys: int, tasks: int) -> np.ndarray:
    """As many numbers as keys that Spark's hash deals to all tasks alike. Were they dealt otherwise, only the balance would suffer."""
    each = -(-keys // tasks)
    tried = np.arange(4 * keys + 64 * tasks, dtype=np.int32)
    task = spark_hash(tried).astype(np.int64) % tasks
    order = np.argsort(task, kind="stable")
    cut = np.searchsorted(task[order], np.arange(tasks + 1))
    rows = [tried[order[a : min(b, a + each)]] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    dealt = np.concatenate([x[k : k + 1] for k in range(each) for x in rows])[:keys]  # one to every task, then a second one
    spare = np.arange(len(tried), len(tried) + keys - len(dealt), dtype=np.int32)  # where some task found too few
    return np.concatenate([dealt, spare])


def slices(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most about ``limit`` bytes; a longer row is a part by itself."""
    if batch.num_rows < 2 or batch.nbytes <= limit:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from slices(batch.slice(0, half), limit)
        yield from slices(batch.slice(half), limit)


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch | None], Iterable[pa.RecordBatch]]], limit: int = BATCH_BYTES, last: bool = False) -> DataFrame:
    """mapInArrow with per-task state: make() runs once in each task and returns the function of a batch of about ``limit`` bytes.

    last: the function is called with None after a task's last batch, for what it held back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for part in slices(batch, limit) if batch.num_rows else ():
                yield from step(part)
        if last:
            yield from step(None)

    return df.mapInArrow(run, schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings, a null as the empty one."""
    return ["" if x is None else x for x in column.to_pylist()]


def text_bytes(column: pa.Array) -> list[bytes]:
    return ["".encode() if x is None else x for x in column.cast(pa.binary()).to_pylist()]
