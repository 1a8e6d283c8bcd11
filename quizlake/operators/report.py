"""Accounting of changes: rows (change, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Counted for information; a rerun that only meets stale runs again changes nothing.
INFORMATIONAL = ("stale solver runs skipped",)


def counted(rows: DataFrame, change: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(change).alias("change"), "n")


def total(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("change").agg(F.sum("n").alias("n")).orderBy("change")


def of_counts(spark: SparkSession, counts: dict[str, int]) -> DataFrame:
    """The report of numbers that are known; a report has a dozen kinds at most."""
    return spark.createDataFrame(sorted((k, n) for k, n in counts.items() if n), "change string, n long")


def changed(report: DataFrame) -> int:
    return report.where(~F.col("change").isin(*INFORMATIONAL)).agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]


def text(report: DataFrame) -> str:
    """One line for each kind of change; a report has a dozen kinds at most."""
    if not changed(report):
        return "No changes."
    return "\n".join(f"{r.change}: {r.n}" for r in report.orderBy("change").collect())
