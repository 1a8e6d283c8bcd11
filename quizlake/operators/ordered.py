"""Work in one order over all rows, by many tasks: a range sort deals the rows out in segments, and what a segment needs to know
of those before it is one row for each segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quizlake.sources.scratch import materialize

_AT = (1 << 33) - 1


def segments(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df with seg (segments in the order's order) and at (the row's place in its segment), written once.

    Rows that are alike in all of ``order`` may lie in two segments, one after the other.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # the lower bits of the id count a partition's rows
    return materialize(ranged.withColumns({"seg": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(_AT)}), "segments")


def numbered(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df with row: each row's number from 0 in the order."""
    rows = segments(df, order)
    sizes = rows.groupBy("seg").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each segment
    return rows.join(F.broadcast(sizes.select("seg", before.alias("_before"))), "seg").withColumn("row", F.col("_before") + F.col("at")).drop("seg", "at", "_before")


def filled(df: DataFrame, group: str, order: list[str | Column], value: Column, name: str, part: str | None = None, tasks: int = 1, at: str | None = None, totals: list[Column] | None = None) -> DataFrame:
    """df with place (the row's number from 1 in its group) and ``name``: the last value that isn't null up to the row in its
    group. A group of any size is filled by as many tasks as it has segments.

    part: the whole number that leads the order, if a group's rows of one such number fit a task. Then these are the segments, dealt
    over so many tasks by a hash, and no range sort samples, deals and writes the rows beforehand.
    at: the row's place from 1 in its part, where value is filled within parts already; then no row is sorted.
    totals: sums and counts, by name; then a row for each group and ``name`` with the first place and these, and no row is dealt.
    """
    if at is not None:
        return _filled_parts(df, group, value, name, part, at, totals)
    if part is None:
        rows, order, key = segments(df, [group, *order]), ["at"], ["seg", group]
    else:
        seg = F.coalesce(part, F.lit(-(1 << 31)))  # null comes first in the order, too
        key = ["_hash", group, "seg"]  # names that begin alike are slow to sort by, so their hash comes first
        rows = df.withColumns({"seg": seg, "_hash": F.xxhash64(group, seg)})
    rows = rows.withColumn("_value", value)
    here = Window.partitionBy(*key).orderBy(*order)
    last = rows.where("_value is not null").groupBy(*key).agg(F.max_by("_value", F.struct(*order)).alias("last"))
    ends = rows.groupBy(*key).agg(F.count("*").alias("n")).join(last, key, "left")  # a row for each group and segment
    earlier = Window.partitionBy(group).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"), F.last("last", ignorenulls=True).over(earlier).alias("_carried"))
    dealt = rows if part is None else rows.repartition(tasks, *key)
    own = dealt.withColumns({"_n": F.row_number().over(here), "_own": F.last("_value", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, 0))})
    out = own.join(carried, key)
    return out.select(*df.columns, (F.col("_before") + F.col("_n")).alias("place"), F.coalesce("_own", "_carried").alias(name))


def _filled_parts(df: DataFrame, group: str, value: Column, name: str, part: str, at: str, totals: list[Column] | None) -> DataFrame:
    seg = F.coalesce(F.col(part).cast("long"), F.lit(-(1 << 31) - 1))  # null comes first in the order
    rows = df.withColumns({"_seg": seg, "_value": value})
    key = [group, "_seg", "_value"]
    runs = rows.groupBy(*key).agg(F.count("*").alias("_n"), F.min(at).alias("_first"), F.max(at).alias("_last"), *(totals or []))
    earlier = Window.partitionBy(group).orderBy("_seg").rangeBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy(group).orderBy("_seg", "_last").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), name: F.last("_value", ignorenulls=True).over(here)})
    if totals is not None:
        own = [c for c in runs.columns if c not in (*key, "_n", "_first", "_last", "_before", name)]
        return runs.groupBy(group, name).agg(F.min(F.col("_before") + F.col("_first")).alias("place"), *[F.sum(c).cast(runs.schema[c].dataType).alias(c) for c in own])
    runs = runs.select(*[F.col(c).alias(f"{c}_") for c in key], "_before", name)
    same = (F.col(group) == F.col(f"{group}_")) & (F.col("_seg") == F.col("_seg_")) & F.col("_value").eqNullSafe(F.col("_value_"))
    return rows.join(runs, same).select(*df.columns, (F.col("_before") + F.col(at)).alias("place"), name)
