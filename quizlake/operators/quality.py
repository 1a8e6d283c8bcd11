"""Constraints of the bank: as queries over whole tables whose results must be empty, and as what a load must pass.

What a load adds or changes is judged before it is published. Rules of single rows are counted while those rows are written;
keys and references are looked up for the changed rows only. As in a database, a key that holds a null is like no other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.operators.merge import by_key
from quizlake.sources.scratch import materialize

UNIQUE = {
    "exam_pattern": [["section"]], "papers": [["id"], ["sha256"]], "mocks": [["id"], ["paper_id", "section"]], "questions": [["id"], ["mock_id", "q_no"]],
    "question_versions": [["id"], ["question_id", "version"], ["question_id", "content_hash", "official_answer"]], "question_assets": [["id"], ["question_version_id", "kind"]],
    "answer_verifications": [["id"], ["question_version_id", "solver_id", "prompt_version"]], "review_queue": [["id"], ["paper_id", "section", "q_no", "source"]],
}
FOREIGN = [
    ("mocks", "paper_id", "papers"), ("questions", "mock_id", "mocks"), ("question_versions", "question_id", "questions"), ("questions", "current_version_id", "question_versions"), ("review_queue", "paper_id", "papers"),
    ("review_queue", "question_id", "questions"), ("answer_verifications", "question_version_id", "question_versions"), ("question_assets", "question_version_id", "question_versions"),
]
NOT_NULL = {
    "exam_pattern": ["section", "questions", "marks_correct", "marks_wrong", "default_timer_sec"], "papers": ["id", "exam_date", "time_slot", "source_filename", "stored_path", "sha256", "key_status"],
    "mocks": ["id", "paper_id", "section", "timer_sec", "status"], "questions": ["id", "mock_id", "q_no", "status"], "question_versions": ["id", "question_id", "version", "content_hash", "stem_text", "stem_text_complete", "options", "key_status", "has_visual"],
    "question_assets": ["id", "question_version_id", "kind", "path", "shows_answer"], "answer_verifications": ["id", "question_version_id", "solver_id", "prompt_version", "valid"], "review_queue": ["id", "paper_id", "section", "q_no", "source", "reasons", "status"],
}
MAX_LENGTH = {("exam_pattern", "section"): 16, ("question_versions", "content_hash"): 16, ("question_versions", "official_answer"): 1}
CHECKS = {"mocks": "section in ('QUANT', 'REASONING')"}
PRIMARY = {t: sets[0][0] for t, sets in UNIQUE.items()}
#: Refused rows that the message of a load names.
NAMED = 20


class Refused(ValueError):
    """Rows of a load break constraints of the bank. rules: how many break each; found: what ``refused`` gives of that load."""

    def __init__(self, rules: dict[str, int], rows: list[str], found: DataFrame | None = None):
        self.rules, self.found = rules, found
        super().__init__("; ".join(f"{rule}: {n}" for rule, n in sorted(rules.items())) + "".join(f"\n{row}" for row in rows))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    return df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")


def orphan_count(df: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """n: how many rows orphans has. Both sides are counted by key, so neither is sent to the driver for a broadcast."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("k"), F.lit(False).alias("known")).unionByName(parent.select(F.col(parent_key).alias("k"), F.lit(True).alias("known")))
    return rows.groupBy("k").agg(F.count_if(~F.col("known")).alias("n"), F.max("known").alias("known")).where("not known").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.where(" or ".join(f"{c} is null" for c in columns))


def too_long(df: DataFrame, column: str, most: int) -> DataFrame:
    return df.where(F.length(column) > most)


def broken(df: DataFrame, check: str) -> DataFrame:
    return df.where(f"not ({check})")


def violations(bank: dict[str, DataFrame]) -> DataFrame:
    """rule, n of every constraint that rows of the bank break."""
    found = []
    say = lambda df, rule: found.append(df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n"))
    for t, sets in UNIQUE.items():
        for keys in sets:
            say(repeated(bank[t], keys), f"unique {t}({', '.join(keys)})")
    for t, column, parent in FOREIGN:
        found.append(orphan_count(bank[t], column, bank[parent]).select(F.lit(f"foreign key {t}({column})").alias("rule"), "n"))
    for t, columns in NOT_NULL.items():
        say(nulls(bank[t], columns), f"not null {t}")
    for (t, column), most in MAX_LENGTH.items():
        say(too_long(bank[t], column, most), f"length {t}({column})")
    for t, check in CHECKS.items():
        say(broken(bank[t], check), f"check {t}: {check}")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out.where("n > 0").orderBy("rule")


def row_rules(table: str, columns: list[str]) -> dict[str, Column]:
    """Of each rule of single rows the condition that breaks it; columns: those that the rows have."""
    out = {f"not null {table}({c})": F.col(c).isNull() for c in NOT_NULL[table] if c in columns}
    out |= {f"length {t}({c})": F.length(c) > most for (t, c), most in MAX_LENGTH.items() if t == table and c in columns}
    out |= {f"check {t}: {check}": ~F.coalesce(F.expr(check), F.lit(True)) for t, check in CHECKS.items() if t == table}
    return out


#: Keys of rows that may lie in any partition; all others are those of rows of one paper, which lie in one.
ANYWHERE = {("papers", "sha256")}


def _keys(rows: DataFrame, table: str, sets: list[list[str]]) -> DataFrame:
    """rule, table, row (the key as JSON), changed of each row and key of a table; a key that holds a null is none."""
    one = lambda keys: F.struct(F.lit(f"unique {table}({', '.join(keys)})").alias("rule"), F.lit(table).alias("table"), F.when(reduce(Column.__and__, [F.col(c).isNotNull() for c in keys]), F.to_json(F.struct(*keys))).alias("row"), F.col("changed"))
    return rows.select(F.inline(F.array(*map(one, sets)))).where("row is not null")


def _key_breaches(state, parts: dict[str, list[int]] | None = None) -> DataFrame | None:
    """rule, table, row: keys of changed rows that other rows have too, and changed rows that refer to nothing; None if no row
    changed. All keys are counted at once, and all references looked up at once.

    parts: of each changed table the partitions that its changed rows are in; no others are looked at.
    """
    keys, children, parents = [], [], {}
    for t, rows in state.deltas.items():
        within = None if parts is None else parts[t]
        near = [k for k in UNIQUE[t] if not any((t, c) in ANYWHERE for c in k)]
        for sets, place in ((near, within), ([k for k in UNIQUE[t] if k not in near], None)):
            if sets:
                keys.append(_keys(state.table(t, place, marked=True), t, sets))
        for child, column, parent in FOREIGN:
            if child == t:
                known = lambda c, of=parent: F.struct(F.lit(of).alias("of"), F.col(c).cast("string").alias("key"))
                children.append(rows.where(F.col(column).isNotNull()).select(F.lit(f"foreign key {t}({column})").alias("rule"), F.lit(t).alias("table"), F.to_json(F.struct(PRIMARY[t], column)).alias("row"), known(column).alias("parent")))
                parents.setdefault(parent, set()).update(within or [])
    if not keys:
        return None
    out = reduce(DataFrame.unionByName, keys).groupBy("rule", "table", "row").agg(F.count("*").alias("n"), F.count_if(F.col("changed")).alias("own")).where("n > 1 and own > 0").select("rule", "table", "row")
    if children:
        have = [state.table(t, None if parts is None else sorted(p)).select(F.struct(F.lit(t).alias("of"), F.col(PRIMARY[t]).cast("string").alias("key")).alias("parent")) for t, p in parents.items()]
        out = out.unionByName(reduce(DataFrame.unionByName, children).join(by_key(reduce(DataFrame.unionByName, have)), "parent", "left_anti").drop("parent"))
    return out


def refused(state, keys: DataFrame | None = None) -> DataFrame:
    """rule, table, row (as JSON: its primary key, or the key that the rule names) of every changed row that breaks a rule.

    state: a load that isn't published (its changed rows in ``deltas``, every table as it leaves it by name); keys: its breaches
    of keys and references, where they are known.
    """
    keys = _key_breaches(state) if keys is None else keys
    out = [] if keys is None else [keys]
    for t, rows in state.deltas.items():
        rules = row_rules(t, rows.columns)
        broken = F.filter(F.array(*[F.when(c, F.lit(rule)) for rule, c in rules.items()]), lambda x: x.isNotNull())
        each = rows.select(PRIMARY[t], F.explode(broken).alias("rule"))
        out.append(each.select("rule", F.lit(t).alias("table"), F.to_json(F.struct(PRIMARY[t]), {"ignoreNullFields": "false"}).alias("row")))
    return reduce(DataFrame.unionByName, out)


def require(state, parts: dict[str, list[int]] | None = None) -> None:
    """Raises Refused where changed rows break a rule. The rules of single rows were counted as the rows were written; parts as
    for keys and references: the partitions that hold changed rows."""
    rules = dict(state.broken)
    keys = _key_breaches(state, parts)
    if keys is not None:
        keys = materialize(keys, "breaches")  # to count, name and give them; the tables' keys are gone through once
        rules |= {r.rule: r["count"] for r in keys.groupBy("rule").count().collect()}  # a row for each rule at most
    if rules:
        found = materialize(refused(state, keys), "refused")
        raise Refused(rules, [f"{r.rule}: {r.table} {r.row}" for r in found.orderBy("rule", "row").limit(NAMED).collect()], found)
