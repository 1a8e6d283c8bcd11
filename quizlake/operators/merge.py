"""Merge policies as set logic over whole tables: each gives the next state and says what changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_key(df: DataFrame) -> DataFrame:
    """df as a side of a join that deals both sides out by key. Sides that Spark would broadcast go through the driver, and how
    many are small enough for that changes with the bank's size; these don't, at any size."""
    return df.hint("merge")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of incoming whose key isn't there yet; incoming has a key once."""
    return incoming.join(by_key(existing.select(*keys)), keys, "left_anti")


def last_by(rows: DataFrame, keys: list[str], values: list[str], ord_: str = "ord") -> DataFrame:
    """Of each key the values of its last record."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), ord_).alias("_v")).select(*keys, "_v.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], allowed: Column | None = None) -> DataFrame:
    """Every row of either side with incoming's values where it has the key; change is 'added', 'updated' or null.

    allowed: a condition on the existing row without which it stays as it is. Columns besides keys and values are kept from
    existing, and null in a new row.
    """
    may = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    old = existing.withColumn("_old", F.lit(True)).withColumn("_may", may)
    new = incoming.select(*keys, *[F.col(v).alias(f"_new_{v}") for v in values], F.lit(True).alias("_in"))
    both = old.join(new, keys, "full")
    differs = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"_new_{v}")) for v in values])
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_in").isNotNull() & F.col("_may") & differs, "updated")
    out = both.withColumn("change", change)
    take = F.col("change").isNotNull()
    return out.select(*[F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in existing.columns], "change")


def delta(existing: DataFrame, incoming: DataFrame, keys: list[str], values: list[str], allowed: Column | None = None) -> DataFrame:
    """The rows that upsert would add or update, and no others, in existing's columns; change is 'added' or 'updated', and was
    holds the values before.

    Existing rows that incoming has no key of aren't read beyond their keys. Columns of incoming besides keys and values are
    taken in new rows only. An update that isn't allowed is none.
    """
    more = [c for c in incoming.columns if c not in keys and c not in values]
    new = incoming.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in [*values, *more]])
    both = new.join(by_key(existing.withColumn("_old", F.lit(True))), keys, "left")
    may = F.lit(True) if allowed is None else F.coalesce(allowed, F.lit(False))
    differs = reduce(lambda a, b: a | b, [~F.col(v).eqNullSafe(F.col(f"_new_{v}")) for v in values], F.lit(False))
    both = both.withColumn("change", F.when(F.col("_old").isNull(), "added").when(may & differs, "updated")).where("change is not null")
    take = lambda c: F.col(f"_new_{c}") if c in values else F.when(F.col("change") == "added", F.col(f"_new_{c}")).otherwise(F.col(c)) if c in more else F.col(c)
    return both.select(*[take(c).alias(c) for c in existing.columns], "change", F.struct(*[F.col(v) for v in values or keys]).alias("was"))


def over(existing: DataFrame, rows: DataFrame, key: str, few: bool = False) -> DataFrame:
    """existing with rows in place of those of their keys; few: whether rows are known to be so few that all tasks may have their keys."""
    keys = rows.select(key)
    return existing.join(F.broadcast(keys) if few else by_key(keys), key, "left_anti").select(*existing.columns).unionByName(rows.select(*existing.columns))


def sticky(old: Column, held: str, statuses: Column, last: Column) -> Column:
    """A status with an absorbing value: once old or any of statuses is it, it stays; else the last, if there is one."""
    return F.when((old == held) | F.array_contains(statuses, held), F.lit(held)).otherwise(F.coalesce(last, old))
