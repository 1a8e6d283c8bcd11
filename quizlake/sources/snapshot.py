"""Snapshots of the bank, in partitions: changed partitions in new folders, then a pointer that names the folder of every one.

A table's rows lie in as many partitions as the bank was made with, by a hash of their paper, so that a load writes the
partitions of the papers that it changes and no others. Pointers are numbered. One is written aside and renamed to its number
only if that number is free, so of two writers that started from one snapshot the later one fails, and readers see all of a
load or nothing. The store's rename must be atomic and refuse an existing target: HDFS and local disks do that, object
stores don't without a lock of their own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake import schemas
from quizlake.sources.readers import exists
from quizlake.sources.scratch import at_once, file_system

POINTER = "CURRENT"
#: Partitions of a bank that doesn't say otherwise when it is made.
PARTS = 16
PART, FOLDER = "part", "v"


class Conflict(RuntimeError):
    """Another load became current since this one read the bank."""


@dataclass
class Pointer:
    """How many partitions a bank has, the folder of each partition of each table (an empty one isn't there), and the last
    step of its migrations."""

    parts: int = PARTS
    where: dict[str, dict[str, str]] = field(default_factory=dict)
    step: int = 0


def part_of(paper_id: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(paper_id), F.lit(parts)).cast("int")


def paper_of(mock_id: Column) -> Column:
    """A mock's id is its paper's and its section's."""
    return F.regexp_replace(mock_id, r"_[^_]*\z", "")


def version(spark: SparkSession, root: str) -> int:
    """The number of the current snapshot; -1 where there is none."""
    if not exists(spark, f"{root}/{POINTER}-*"):
        return -1
    fs, p = file_system(spark, f"{root}/{POINTER}-*")
    return max(int(x.getPath().getName().rpartition("-")[2]) for x in fs.globStatus(p))


def _pointer(root: str, number: int) -> str:
    return f"{root}/{POINTER}-{number:012d}"


def pointer(spark: SparkSession, root: str, number: int) -> Pointer:
    if number < 0:
        return Pointer()
    return Pointer(**json.loads("".join(r.value for r in spark.read.text(_pointer(root, number)).collect())))  # a line for each load


def folders(spark: SparkSession, root: str, number: int) -> dict[str, dict[str, str]]:
    """Of each table in a snapshot the folder of each partition."""
    return pointer(spark, root, number).where


def _path(root: str, table: str, folder: str, part: str) -> str:
    return f"{root}/{table}/{FOLDER}={folder}/{PART}={part}"


def read(spark: SparkSession, root: str, number: int | None = None, parts: bool = False) -> dict[str, DataFrame]:
    """Every table of the current snapshot, or of the one numbered; empty tables where there is none yet.

    parts: whether rows say in which partition they are.
    """
    where, out = folders(spark, root, version(spark, root) if number is None else number), {}
    for t, ddl in schemas.TABLES.items():
        stored = f"{ddl}, {PART} int"
        if where.get(t):
            df = spark.read.schema(f"{stored}, {FOLDER} string").option("basePath", f"{root}/{t}").parquet(*[_path(root, t, f, p) for p, f in where[t].items()]).drop(FOLDER)
        else:
            df = spark.createDataFrame([], schemas.struct_type(stored))
        out[t] = df if parts else df.drop(PART)
    return out


def stored(spark: SparkSession, root: str, number: int) -> dict[str, DataFrame]:
    """Every table of a snapshot in the columns that it was written in, and each row's partition; an empty table in the declared ones."""
    where, out = folders(spark, root, number), read(spark, root, number, parts=True)
    for t, folder in where.items():
        if folder:  # all partitions of a table have one schema
            out[t] = spark.read.option("basePath", f"{root}/{t}").parquet(*[_path(root, t, f, p) for p, f in folder.items()]).drop(FOLDER)
    return out


def with_parts(tables: dict[str, DataFrame], parts: int) -> dict[str, DataFrame]:
    """The tables with each row's partition, that of its paper; rows that lead to no paper are in the first.

    Versions find their paper by their question, assets and runs by their version, so those tables must be given too.
    """
    zero = F.lit(0)
    own = {"papers": "id", "mocks": "paper_id", "review_queue": "paper_id", "questions": "mock_id"}
    up = {"question_versions": ("question_id", "questions"), "question_assets": ("question_version_id", "question_versions"), "answer_verifications": ("question_version_id", "question_versions")}
    out: dict[str, DataFrame] = {}
    for t in (x for x in schemas.TABLES if x in tables):
        df = tables[t].drop(PART)
        if t in own and own[t] in df.columns:
            paper = F.col(own[t])
            out[t] = df.withColumn(PART, F.coalesce(part_of(paper_of(paper) if own[t] == "mock_id" else paper, parts), zero))
        elif t in up and up[t][1] in out:
            column, parent = up[t]
            of = out[parent].select(F.col("id").alias("_id"), F.col(PART)).dropDuplicates(["_id"])
            out[t] = df.join(of, F.col(column) == F.col("_id"), "left").drop("_id").withColumn(PART, F.coalesce(PART, zero))
        else:
            out[t] = df.withColumn(PART, zero)
    return out


def commit(spark: SparkSession, root: str, base: int, changed: dict[str, DataFrame], replaced: dict[str, Iterable[int]] | None = None, parts: int | None = None, check: Callable[[], None] = lambda: None, step: int | None = None, declared: bool = True) -> int:
    """Writes rows (with their partitions) and makes them current; the number of the new snapshot.

    base: the number of the snapshot that they were made from. replaced: of each table the partitions whose rows these are;
    all, if not told. Other partitions stay in their folders. check: runs beside the writes; if it raises, nothing is published.
    step: of the migrations that the bank is at now, if that changes; declared: whether rows are written in the declared columns.
    """
    now, name = pointer(spark, root, base), uuid.uuid4().hex
    now.parts = parts or now.parts
    now.step = now.step if step is None else step

    def put(t: str) -> None:
        columns = [f.name for f in schemas.struct_type(schemas.TABLES[t])] if declared else [c for c in changed[t].columns if c != PART]
        changed[t].select(*columns, PART).hint("rebalance", PART).write.partitionBy(PART).parquet(f"{root}/{t}/{FOLDER}={name}")

    published = False
    try:
        at_once(check, *(lambda t=t: put(t) for t in changed))  # a small table is mostly the time of a job's start
        for t in changed:
            gone = set(now.where.get(t, {})) if replaced is None else {str(p) for p in replaced[t]}
            fs, p = file_system(spark, _path(root, t, name, "*"))
            here = {x.getPath().getName().partition("=")[2]: name for x in fs.globStatus(p) or ()}
            now.where[t] = {p: f for p, f in now.where.get(t, {}).items() if p not in gone} | here
        for t in schemas.TABLES:
            now.where.setdefault(t, {})
        published = True  # a rename that fails otherwise than by a conflict may have been done
        _publish(spark, f"{root}/.{name}", _pointer(root, base + 1), json.dumps(now.__dict__))
    except Exception as e:
        if not published or isinstance(e, Conflict):  # no pointer names the folders
            for path in (f"{root}/.{name}", *(f"{root}/{t}/{FOLDER}={name}" for t in changed)):
                fs, p = file_system(spark, path)
                fs.delete(p, True)
        raise
    return base + 1


def write(spark: SparkSession, root: str, tables: dict[str, DataFrame], base: int | None = None, changed: set[str] | None = None, parts: int | None = None) -> int:
    """Writes whole tables (the changed ones, or all) and makes them current; the number of the new snapshot.

    parts: the number of the bank's partitions, for a bank that is made by this.
    """
    base = version(spark, root) if base is None else base
    now = pointer(spark, root, base)
    number = parts or now.parts
    known = with_parts({**(read(spark, root, base) if base >= 0 else {}), **tables}, number)
    return commit(spark, root, base, {t: known[t] for t in known if t in tables and (changed is None or t in changed or t not in now.where)}, None, number)


def affected(deltas: dict[str, DataFrame]) -> dict[str, list[int]]:
    """Of each table the partitions that hold rows of it; a number for each partition."""
    if not deltas:
        return {}
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(t).alias("t"), PART).distinct() for t, df in deltas.items()]).collect()
    return {t: sorted(r[PART] for r in rows if r.t == t) for t in deltas}


def _publish(spark: SparkSession, aside: str, target: str, content: str) -> None:
    """Creates the target with its content in one step, or raises Conflict if it is there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, a = file_system(spark, aside)
    out = fs.create(a, False)
    out.write(bytearray(content.encode()))
    out.close()
    never_over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    never_over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(a.toUri(), conf).rename(a, jvm.org.apache.hadoop.fs.Path(target), never_over)
    except Exception as e:
        if "already exists" in str(e) or "FileAlreadyExists" in str(e):
            raise Conflict(target) from None
        raise


def create(spark: SparkSession, root: str, parts: int | None = None) -> set[str]:
    """Creates the tables that aren't there and rewrites those of another schema than the declared one; the names of both.

    A column that a stored table lacks becomes null, one that isn't declared goes, and one of another type is cast; a value
    that doesn't fit fails, and the bank stays as it was. Where all tables are as declared nothing is written. parts: the
    number of partitions of a new bank.
    """
    base = version(spark, root)
    where, tables, found = folders(spark, root, base), {}, stored(spark, root, base)
    for t, ddl in schemas.TABLES.items():
        declared = schemas.struct_type(ddl)
        have = {f.name: f.dataType.simpleString() for f in found[t].schema if f.name != PART}
        if t not in where:
            tables[t] = spark.createDataFrame([], declared)
        elif list(have.items()) != [(f.name, f.dataType.simpleString()) for f in declared]:
            tables[t] = found[t].select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared], PART)
    if tables:
        commit(spark, root, base, {t: df if PART in df.columns else df.withColumn(PART, F.lit(0)) for t, df in tables.items()}, None, parts)
    return set(tables)


def drop(spark: SparkSession, root: str) -> None:
    """Drops all tables: a snapshot without any becomes current, then the folders of earlier ones are deleted."""
    base = version(spark, root)
    if base < 0:
        return
    now = pointer(spark, root, base)
    _publish(spark, f"{root}/.{uuid.uuid4().hex}", _pointer(root, base + 1), json.dumps({"parts": now.parts, "step": now.step}))
    for t in schemas.TABLES:
        fs, p = file_system(spark, f"{root}/{t}")
        fs.delete(p, True)
