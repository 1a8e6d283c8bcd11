"""The load: manifest, question records, review items and solver runs go into the bank, idempotently.

Each step is one plan that ends in the state a record-by-record load would reach, and writes only the rows that it adds or
changes, once; the report's numbers are counted while they are written. Ids are hashes of natural keys, so a rerun gives the
same. Rows that break a constraint of the bank refuse the whole load; what passes is published in the partitions of the papers
that changed. Where another load was published meanwhile, the load is done again over that.
"""

from __future__ import annotations

import random
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quizlake import schemas
from quizlake.functions import scalars as S
from quizlake.operators import quality
from quizlake.operators import report as R
from quizlake.operators.merge import by_key, delta, insert_if_absent, last_by, over, sticky
from quizlake.settings import Settings
from quizlake.settings import read as read_settings
from quizlake.sources import readers, snapshot
from quizlake.sources.scratch import at_once, materialize, materialize_counted

# Fixed values.
SECTIONS = ("QUANT", "REASONING")
CONFIRMED = ("KEY_CONFIRMED_CODE", "KEY_CONFIRMED_DUAL", "KEY_CONFIRMED_REVIEW")
REVIEWED = "KEY_CONFIRMED_REVIEW"
DEFAULT_PATTERN = {"questions": 25, "marks_correct": 2, "marks_wrong": 0.5, "default_timer_sec": 900}
TOPICS = ["topic", "subtopic", "topic_source"]
VERSION_FIELDS = ["stem_text", "stem_text_complete", "stem_image", "options", "option_ids", "answer_text_layer", "answer_page_image", "key_status", "has_visual", "source_page", "source_bbox", "question_crop"]


#: How often a load is done again where others were published meanwhile, and the seconds before the first time.
ATTEMPTS = 5
PAUSE = 0.5
#: Changed rows whose keys go to every task that reads the table; more are joined by key.
FEW = 10_000


@dataclass
class Inputs:
    sources: DataFrame
    questions: DataFrame
    review: DataFrame
    verifications: DataFrame


def read_inputs(spark: SparkSession, data_dir: str) -> Inputs:
    """Everything of a data folder; files that aren't there have no records, but the manifest must be."""
    sources, _, _ = readers.manifest(spark, f"{data_dir}/intake_manifest.json")
    return Inputs(
        sources,
        readers.optional(spark, f"{data_dir}/questions/questions.jsonl", schemas.QUESTION_RECORD),
        readers.optional(spark, f"{data_dir}/questions/review_queue.json", schemas.REVIEW_RECORD, readers.json_array),
        readers.optional(spark, f"{data_dir}/solver/verifications/*.jsonl", schemas.VERIFICATION_RECORD),
    )


def _as_table(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns and types, and the row's partition; a column that df lacks is null."""
    fields = schemas.struct_type(schemas.TABLES[table]).fields
    kept = [c for c in ("part", "change", "was") if c in df.columns]
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], *kept)


class State:
    """A bank as it was read, with the rows that a load has added or changed so far over it.

    bank: tables with each row's partition (``part``), in the first one where they don't say; parts: how many there are;
    empty: tables that are known to hold nothing.
    """

    def __init__(self, bank: dict[str, DataFrame], parts: int = 1, empty: set[str] = frozenset()):
        self.parts, self.empty = parts, empty
        self.base = {t: df if "part" in df.columns else df.withColumn("part", F.lit(0)) for t, df in bank.items()}
        self.deltas: dict[str, DataFrame] = {}
        self.added: set[str] = set()  # tables whose deltas hold new keys only
        self.sizes: Counter[str] = Counter()  # rows of the deltas
        self.counts: Counter[str] = Counter()
        self.broken: Counter[str] = Counter()

    def table(self, table: str, within: list[int] | None = None, marked: bool = False) -> DataFrame:
        """A table as it is now; within: of these partitions only; marked: with whether the load changed the row (``changed``)."""
        base, rows = self.base[table], self.deltas.get(table)
        if within is not None:
            base, rows = (df if df is None else df.where(F.col("part").isin(within)) for df in (base, rows))
        if marked:
            base, rows = base.withColumn("changed", F.lit(False)), None if rows is None else rows.withColumn("changed", F.lit(True))
        if rows is None:
            return base
        if table in self.empty:
            return rows.select(*base.columns)
        return base.unionByName(rows.select(*base.columns)) if table in self.added else over(base, rows, quality.PRIMARY[table], self.sizes[table] <= FEW)

    def __getitem__(self, table: str) -> DataFrame:
        return self.table(table)

    def put(self, table: str, rows: DataFrame, says: dict[str, Column], new: bool = False) -> DataFrame:
        """Takes rows (with change) into the table; says: kinds of change, and which of the rows are of that kind; new: whether
        none has a key that is in the table. Where all are new, the table is read without a join."""
        rules = quality.row_rules(table, rows.columns)
        old = F.lit(not new) if "change" not in rows.columns else F.col("change") != "added"
        rows, n = materialize_counted(rows, table, {**says, **rules, "": F.lit(True), "old": old})
        self.counts.update({k: n[k] for k in says})
        self.broken.update({k: n[k] for k in rules if n[k]})
        if n[""]:
            before = self.deltas.get(table)
            plain = rows.drop("change", "was")
            self.sizes[table] += n[""]
            if not n["old"]:
                self.deltas[table] = plain if before is None else before.unionByName(plain)
                self.added |= {table} if before is None else set()
            else:
                self.deltas[table] = plain if before is None else over(before, plain, quality.PRIMARY[table], n[""] <= FEW)
                self.added -= {table}
        return rows

    def tables(self) -> dict[str, DataFrame]:
        """Every table as the load leaves it."""
        return {t: self[t].drop("part") for t in self.base}

    def report(self, spark: SparkSession) -> DataFrame:
        return R.of_counts(spark, self.counts)


def _added_or_updated(what: str) -> dict[str, Column]:
    return {f"{what} {c}": F.col("change") == c for c in ("added", "updated")}


def load_exam_pattern(state: State, spark: SparkSession) -> None:
    """Sections that have no pattern get the default one; configured values stay."""
    default = spark.createDataFrame([(s, *map(float, DEFAULT_PATTERN.values()), 0) for s in SECTIONS], "section string, " + ", ".join(f"{k} double" for k in DEFAULT_PATTERN) + ", part int")
    new = insert_if_absent(state["exam_pattern"], _as_table(default, "exam_pattern"), ["section"])
    state.put("exam_pattern", new, {"exam_pattern added": F.lit(True)}, new=True)


def load_papers(state: State, sources: DataFrame) -> None:
    """Accepted sources as papers; a paper that is no longer accepted stays."""
    values = ["exam_date", "time_slot", "source_filename", "stored_path", "sha256", "key_status"]
    rows = sources.where("accepted").select(S.paper_id(F.col("date"), F.col("time_slot")).alias("id"), S.paper_date(F.col("date")).alias("exam_date"), "time_slot", F.col("filename").alias("source_filename"), "stored_path", "sha256", "key_status", "ord")
    rows = last_by(rows, ["id"], values).withColumn("part", snapshot.part_of(F.col("id"), state.parts))
    state.put("papers", _as_table(delta(state["papers"], rows, ["id"], values), "papers"), _added_or_updated("papers"))


def _mock_id():
    return F.concat_ws("_", "paper_id", "section")


def question_id(mock_id, q_no):
    return F.xxhash64(mock_id, q_no)


def version_id(question, content_hash, answer):
    """The key of a version is its question, content and answer, where no answer is one too."""
    return F.xxhash64(question, content_hash, answer.isNull(), answer)


def load_questions(state: State, records: DataFrame) -> None:
    """Mocks, question slots, versions, assets and current pointers. A version is never changed but for its topic tags."""
    rec = records.where(F.col("section").isin(*SECTIONS)).withColumn("mock_id", _mock_id()).withColumn("part", snapshot.part_of(F.col("paper_id"), state.parts))
    rec = rec.withColumn("question_id", question_id(F.col("mock_id"), F.col("q_no"))).withColumn("content_hash", S.content_hash(F.col("ssc_question_id"), F.col("stem_text"), F.col("stem_image"), F.col("options")))
    rec = materialize(rec.withColumn("version_id", version_id(F.col("question_id"), F.col("content_hash"), F.col("official_answer"))), "question-records")

    at_once(lambda: _mocks(state, rec), lambda: _versions(state, rec), lambda: _slots(state, rec))


def _mocks(state: State, rec: DataFrame) -> None:
    mocks = insert_if_absent(state["mocks"], rec.select(F.col("mock_id").alias("id"), "paper_id", "section", "part").distinct(), ["id"])
    mocks = mocks.join(F.broadcast(state["exam_pattern"].select("section", F.col("default_timer_sec").alias("timer_sec"))), "section").withColumn("status", F.lit("DRAFT"))  # a row for each section
    state.put("mocks", _as_table(mocks, "mocks"), {"mocks added": F.lit(True)}, new=True)


def _versions(state: State, rec: DataFrame) -> None:
    added = F.col("change") == "added"
    pairs = rec.groupBy("version_id").agg(F.min("ord").alias("first"), F.first("question_id").alias("question_id"), F.first("content_hash").alias("content_hash"), F.first("official_answer").alias("official_answer"), F.first("part").alias("part"), F.min_by(F.struct(*VERSION_FIELDS), "ord").alias("body"), F.max_by(F.struct(*TOPICS), "ord").alias("tags"))
    pairs = pairs.select(F.col("version_id").alias("id"), "question_id", "content_hash", "official_answer", "part", "first", "body.*", "tags.*")
    history = state["question_versions"]
    fresh = pairs.join(by_key(history.select("id")), "id", "left_anti").select("id", "question_id", "first")
    counts = history.join(by_key(fresh.select("question_id").distinct()), "question_id", "left_semi").groupBy("question_id").agg(F.max("version").alias("have"))
    number = F.coalesce("have", F.lit(0)) + F.row_number().over(Window.partitionBy("question_id").orderBy("first", "id"))
    numbered = fresh.join(by_key(counts), "question_id", "left").select("id", number.alias("version"))
    pairs = pairs.drop("first").join(by_key(numbered), "id", "left").withColumn("created_at", F.current_timestamp())
    versions = state.put("question_versions", delta(history, pairs, ["id"], TOPICS), {"question versions added": added, "topic tags updated": ~added})

    maybe = F.filter(
        F.concat(F.array(F.struct(F.lit("review_crop").alias("kind"), F.col("question_crop").alias("path"), F.lit(True).alias("shows_answer")), F.struct(F.lit("stem").alias("kind"), F.col("stem_image").alias("path"), F.lit(False).alias("shows_answer"))), F.transform("options", lambda o: F.struct(F.concat(F.lit("option_"), o["label"]).alias("kind"), o["image"].alias("path"), F.lit(False).alias("shows_answer")))),
        lambda a: a["path"].isNotNull() & (a["path"] != ""),
    )
    assets = versions.where(added).select(F.col("id").alias("question_version_id"), "part", F.explode(maybe).alias("a")).select("question_version_id", "part", "a.*").withColumn("id", F.xxhash64("question_version_id", "kind"))
    state.put("question_assets", _as_table(assets, "question_assets"), {"assets added": F.lit(True)})


def _slots(state: State, rec: DataFrame) -> None:
    added = F.col("change") == "added"
    values = ["ssc_question_id", "status", "current_version_id"]
    slots = last_by(rec.withColumns({"id": F.col("question_id"), "current_version_id": F.col("version_id")}), ["id", "mock_id", "q_no", "part"], values)
    same = F.col("ssc_question_id").eqNullSafe(F.col("was.ssc_question_id")) & F.col("status").eqNullSafe(F.col("was.status"))
    says = {"questions added": added, "questions updated": ~added & ~same, "current versions moved": ~F.col("current_version_id").eqNullSafe(F.col("was.current_version_id"))}
    state.put("questions", _as_table(delta(state["questions"], slots, ["id", "mock_id", "q_no"], values), "questions"), says)


def queue(state: State, items: DataFrame) -> None:
    """Review items (paper_id, section, q_no, source, reasons, ord): added, or updated while open; resolved ones stay."""
    key = ["paper_id", "section", "q_no", "source"]
    last = last_by(items, key, ["reasons"])
    known = state["questions"].select(F.col("mock_id").alias("_m"), F.col("q_no").alias("_n"), F.col("id").alias("question_id"))
    rows = last.join(by_key(known), (_mock_id() == F.col("_m")) & (F.col("q_no") == F.col("_n")), "left").select(*key, "question_id", "reasons")
    rows = rows.withColumns({"id": F.xxhash64(*key), "status": F.lit("OPEN"), "created_at": F.current_timestamp(), "part": snapshot.part_of(F.col("paper_id"), state.parts)})
    state.put("review_queue", delta(state["review_queue"], rows, key, ["question_id", "reasons"], F.col("status") == "OPEN"), _added_or_updated("review items"))


def load_review_queue(state: State, records: DataFrame) -> None:
    queue(state, records.where(F.col("section").isin(*SECTIONS)).withColumn("source", F.lit("extract")))


def load_verifications(state: State, records: DataFrame) -> DataFrame:
    """Runs go to the version they solved; verdicts set the status of current versions. Gives the questions covered."""
    versions = state["question_versions"]
    current = versions.select(F.col("id").alias("current_version_id"), F.col("content_hash").alias("_h"), F.col("official_answer").alias("_a"))
    rec = records.withColumn("question_id", question_id(_mock_id(), F.col("q_no"))).join(by_key(state["questions"].select(F.col("id").alias("question_id"), "current_version_id", "part")), "question_id").join(by_key(current), "current_version_id", "left")
    counts = F.coalesce(F.col("official_answer").eqNullSafe(F.col("_a")) & F.exists("verifications", lambda v: v["question_version"] == F.col("_h")), F.lit(False))
    rec = materialize(rec.withColumn("on_current", counts).drop("_h", "_a"), "verdict-records")

    on = rec.where("on_current")
    at_once(lambda: _runs(state, rec, versions), lambda: _statuses(state, on, versions), lambda: _doubts(state, on))
    return on.select("question_id").distinct()


def _runs(state: State, rec: DataFrame, versions: DataFrame) -> None:
    runs = rec.select("question_id", "official_answer", "ord", "part", F.posexplode("verifications").alias("place", "run"))
    runs = runs.withColumn("question_version_id", version_id(F.col("question_id"), F.col("run.question_version"), F.col("official_answer")))
    found = runs.join(by_key(versions.select(F.col("id").alias("question_version_id"), F.lit(True).alias("known"))), "question_version_id", "left").drop("question_id", "official_answer")
    found, n = materialize_counted(found, "runs", {"stale": F.col("known").isNull()})
    state.counts["stale solver runs skipped"] += n["stale"]
    key = ["question_version_id", "solver_id", "prompt_version"]
    placed = found.where("known").select("question_version_id", "part", "run.*", F.struct("ord", "place").alias("ord")).drop("question_version")
    placed = placed.withColumn("steps", F.coalesce("steps", F.array().cast("array<string>"))).withColumn("valid", F.coalesce("valid", F.lit(True)))
    first = placed.groupBy(*key).agg(F.min_by(F.struct(*[c for c in placed.columns if c not in (*key, "ord")]), "ord").alias("b")).select(*key, "b.*")
    new = insert_if_absent(state["answer_verifications"], first, key).withColumn("id", F.xxhash64(*key)).withColumn("created_at", F.current_timestamp())
    state.put("answer_verifications", _as_table(new, "answer_verifications"), {"solver runs added": F.lit(True)}, new=True)


def _statuses(state: State, on: DataFrame, versions: DataFrame) -> None:
    verdicts = on.groupBy(F.col("current_version_id").alias("id")).agg(F.collect_set("status").alias("all"), F.max_by("status", F.when(F.col("status").isNotNull(), F.col("ord"))).alias("last"))  # a record without a status says nothing
    set_ = versions.select("id", "key_status").join(by_key(verdicts), "id").select("id", sticky(F.col("key_status"), REVIEWED, F.col("all"), F.col("last")).alias("key_status"))
    state.put("question_versions", delta(versions, set_, ["id"], ["key_status"]), {"key statuses set": F.lit(True)})


def _doubts(state: State, on: DataFrame) -> None:
    queue(state, on.where(~F.col("status").isin(*CONFIRMED)).select("paper_id", "section", "q_no", F.lit("solver").alias("source"), F.array("status").alias("reasons"), "ord"))


def set_verdicts(state: State, verdicts: DataFrame) -> None:
    """Takes what is known of versions (held, last, doubt by paper, section, number, answer and content hash) where they are current.

    Only the partitions of the papers in verdicts are read.
    """
    rows = verdicts.withColumn("question_id", question_id(_mock_id(), F.col("q_no"))).withColumn("current_version_id", version_id(F.col("question_id"), F.col("question_version"), F.col("official_answer")))
    parts = [r.part for r in rows.select(snapshot.part_of(F.col("paper_id"), state.parts).alias("part")).distinct().collect()]  # as many as the bank has, at most
    current = state.table("questions", parts).select(F.col("id").alias("question_id"), "current_version_id")
    on = materialize(rows.join(current, ["question_id", "current_version_id"]), "verdicts-on-current")
    versions = state.table("question_versions", parts)
    said = versions.select("id", "key_status").join(on.select(F.col("current_version_id").alias("id"), "held", "last"), "id")
    said = said.select("id", sticky(F.col("key_status"), REVIEWED, F.array(F.when(F.col("held"), REVIEWED).otherwise("")), F.col("last")).alias("key_status"))
    state.put("question_versions", delta(versions, said, ["id"], ["key_status"]), {"key statuses set": F.lit(True)})
    queue(state, on.where("doubt is not null").select("paper_id", "section", "q_no", F.lit("solver").alias("source"), F.array("doubt").alias("reasons"), F.lit(0).alias("ord")))


def withdraw_verdicts(state: State, covered: DataFrame) -> None:
    """Verdicts of current versions that no record gives any more; a reviewed key stays."""
    open_ = state["questions"].select(F.col("id").alias("question_id"), F.col("current_version_id").alias("id")).join(by_key(covered), "question_id", "left_anti")
    versions = state["question_versions"]
    rows = versions.where(~F.col("key_status").isin("UNVERIFIED", REVIEWED)).select("id").join(by_key(open_.select("id")), "id", "left_semi").select("id", F.lit("UNVERIFIED").alias("key_status"))
    state.put("question_versions", delta(versions, rows, ["id"], ["key_status"]), {"key statuses withdrawn": F.lit(True)})


def publishable(bank: State | dict[str, DataFrame]) -> DataFrame:
    """id, ready of every mock: as many questions as its pattern wants, and every one fit with a confirmed key."""
    current = bank["question_versions"].select(F.col("id").alias("current_version_id"), "key_status")
    q = bank["questions"].select(F.col("id").alias("q_id"), "mock_id", "status", "current_version_id").withColumnRenamed("status", "q_status").join(by_key(current), "current_version_id", "left")
    fit = F.coalesce((F.col("q_status") != "REJECTED") & F.col("key_status").isin(*CONFIRMED), F.lit(False))
    per = q.groupBy("mock_id").agg(F.count("q_id").alias("n"), F.every(fit).alias("fit"))
    rows = bank["mocks"].join(F.broadcast(bank["exam_pattern"].select("section", "questions")), "section").join(by_key(per), F.col("id") == F.col("mock_id"), "left")
    return rows.select("id", ((F.coalesce("n", F.lit(0)) == F.col("questions")) & F.coalesce("fit", F.lit(True))).alias("ready"))


def publish_mocks(state: State) -> None:
    ready = publishable(state).select("id", F.when(F.col("ready"), "PUBLISHED").otherwise("DRAFT").alias("status"))
    state.put("mocks", delta(state["mocks"], ready, ["id"], ["status"]), {f"mocks set {s}": F.col("status") == s for s in ("DRAFT", "PUBLISHED")})


def load_all(state: State, inputs: Inputs) -> State:
    """Loads everything of the inputs; nothing is published, and rows that break a constraint are in the state."""
    at_once(lambda: load_exam_pattern(state, inputs.sources.sparkSession), lambda: load_papers(state, inputs.sources))
    load_questions(state, inputs.questions)
    load_review_queue(state, inputs.review)
    withdraw_verdicts(state, load_verifications(state, inputs.verifications))
    publish_mocks(state)
    return state


def commit(spark: SparkSession, root: str, base: int, state: State) -> int:
    """Publishes what the load changed; the number of the snapshot. Refused, the bank stays as it is and no folder is left."""
    replaced = snapshot.affected(state.deltas)
    check = lambda: quality.require(state, replaced)
    if not replaced:
        check()
        return base
    return snapshot.commit(spark, root, base, {t: state.table(t, p) for t, p in replaced.items()}, replaced, state.parts, check)


def into(spark: SparkSession, root: str, work: Callable[[State], object], attempts: int = ATTEMPTS) -> DataFrame:
    """Does ``work`` on the current bank, publishes what it changed, all or nothing, and gives the report.

    Where another load became current meanwhile, it is done again over that one, as if it had come after it.
    """
    for attempt in range(attempts):
        base = snapshot.version(spark, root)
        at = snapshot.pointer(spark, root, base)
        state = State(snapshot.read(spark, root, base, parts=True), at.parts, {t for t in schemas.TABLES if not at.where.get(t)})
        work(state)
        try:
            commit(spark, root, base, state)
            break
        except snapshot.Conflict:
            if attempt + 1 == attempts:
                raise
            time.sleep(PAUSE * 2**attempt * random.uniform(0.5, 1.5))
    return state.report(spark)


def load_into(spark: SparkSession, root: str, inputs: Inputs, attempts: int = ATTEMPTS) -> DataFrame:
    """Loads the inputs into the bank at root and gives the report; quality.Refused where rows break a constraint."""
    return into(spark, root, lambda state: load_all(state, inputs), attempts)


def load_configured(spark: SparkSession, settings: Settings | None = None) -> DataFrame:
    """The load that the settings name, into tables of the declared schemas."""
    settings = settings or read_settings()
    snapshot.create(spark, settings.bank_root)
    return load_into(spark, settings.bank_root, read_inputs(spark, settings.data_dir))
