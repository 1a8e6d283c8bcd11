"""Migrations of a bank: numbered steps, each with its way back; the number reached is kept in the pointer.

A step is a function of the stored tables, as lazy as they are. Steps that are due are put one after the other, and what they
change is written and published once, so a bank is never between two of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quizlake.sources import snapshot

Change = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


class Unknown(ValueError):
    """The bank is at a step that isn't among those given, or is asked to go to one."""


@dataclass(frozen=True)
class Step:
    """up and down: from all tables (rows with their partition, ``part``, which must stay) to those that change."""

    name: str
    up: Change
    down: Change


def migrate(spark: SparkSession, root: str, steps: Sequence[Step], to: int | None = None) -> list[str]:
    """Brings the bank to step ``to`` (the last one, if not told; 0 is before the first) and gives the names of the steps taken.

    Each step is taken once: a bank that is there already isn't written. A step that fails, or another writer, leaves it as it was.
    """
    base = snapshot.version(spark, root)
    at, to = snapshot.pointer(spark, root, base).step, len(steps) if to is None else to
    if not (0 <= at <= len(steps) and 0 <= to <= len(steps)):
        raise Unknown(f"the bank is at step {at} and is to go to {to}; {len(steps)} are known")
    way = [(s.name, s.up) for s in steps[at:to]] or [(s.name, s.down) for s in reversed(steps[to:at])]
    tables, changed = snapshot.stored(spark, root, base), set()
    for _, change in way:
        new = change(dict(tables))
        tables |= new
        changed |= new.keys()
    if way:
        snapshot.commit(spark, root, base, {t: tables[t] for t in changed}, step=to, declared=False)
    return [name for name, _ in way]
