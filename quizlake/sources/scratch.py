"""Tables of a run's own, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its own kind."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a local master, whose executors share the driver's disk, gets one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quizlake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one; it goes when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quizlake-{spark.sparkContext.applicationId}"
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return path


def materialize(df: DataFrame, name: str, spark: SparkSession | None = None, **options: str) -> DataFrame:
    """Writes df as Parquet in the scratch folder and reads it again: a lost executor then costs a read, not a rerun."""
    spark = spark or df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, **options)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, counted: dict[str, Column]) -> tuple[DataFrame, dict[str, int]]:
    """As materialize; and how many of the rows meet each condition, counted while they are written."""
    seen = Observation()
    where = [f"c{i}" for i in range(len(counted))]
    out = materialize(df.observe(seen, *[F.count_if(c).alias(x) for x, c in zip(where, counted.values(), strict=True)]), name)
    got = seen.get
    return out, {k: got.get(x) or 0 for k, x in zip(counted, where, strict=True)}


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Jobs of DataFrames that begin in here delete their shuffles' files as they end; otherwise those wait for the driver's garbage collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def small_tasks(spark: SparkSession):
    """Tasks of jobs that begin in here read 8 MB of a shuffle at most, unless one key has more: for rows that take many times their bytes."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "8m")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def at_once(*work: Callable[[], object]) -> list:
    """Runs jobs that don't wait for each other side by side; all have ended when the first failure is raised."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [x.result() for x in [pool.submit(f) for f in work]]
