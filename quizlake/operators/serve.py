"""Read views of the bank: filtered, ordered, nested, and by role."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.functions import scalars as S

Bank = dict[str, DataFrame]
PUBLIC = ["id", "version_id", "q_no", "stem_text", "stem_text_complete", "stem_image_url", "options", "has_visual"]
ADMIN = [*PUBLIC, "ssc_question_id", "status", "version", "official_answer", "answer_text_layer", "answer_page_image", "key_status", "review_crop_url", "source_page", "topic", "subtopic", "verifications"]


class NotFound(LookupError):
    """No such mock or question (404)."""


class NotPublished(RuntimeError):
    """The mock can't be played yet (409)."""


def health(bank: Bank) -> DataFrame:
    return bank["questions"].agg(F.count("id").alias("questions"))


def exam_pattern(bank: Bank) -> DataFrame:
    return bank["exam_pattern"].select("section", "questions", F.col("marks_correct").cast("double").alias("marks_correct"), F.col("marks_wrong").cast("double").alias("marks_wrong"), "default_timer_sec").orderBy("section")


def papers(bank: Bank) -> DataFrame:
    """Papers with their mocks by section; a paper without mocks has an empty list."""
    nested = bank["mocks"].groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "id", "paper_id", "timer_sec", "status"))), lambda m: F.struct(m["id"].alias("id"), m["paper_id"].alias("paper_id"), m["section"].alias("section"), m["timer_sec"].alias("timer_sec"), m["status"].alias("status"))).alias("mocks"))
    rows = bank["papers"].join(nested, F.col("id") == F.col("paper_id"), "left")
    empty = F.array().cast("array<struct<id:string,paper_id:string,section:string,timer_sec:int,status:string>>")
    return rows.select("id", "exam_date", "time_slot", "key_status", F.coalesce("mocks", empty).alias("mocks")).orderBy("id")


def mocks(bank: Bank, section: str | None = None, status: str | None = None) -> DataFrame:
    """An empty or absent parameter filters nothing; case doesn't matter."""
    out = bank["mocks"]
    for column, value in (("section", section), ("status", status)):
        if value:
            out = out.where(F.col(column) == value.upper())
    return out.orderBy("id")


def _current(bank: Bank, questions: DataFrame) -> DataFrame:
    v = bank["question_versions"].withColumnRenamed("id", "version_id").drop("question_id", "created_at")
    rows = F.broadcast(questions).join(v, F.col("current_version_id") == F.col("version_id"))
    return rows.withColumns({"stem_image_url": S.asset_url(F.col("stem_image")), "review_crop_url": S.asset_url(F.col("question_crop")), "options": S.option_urls(F.col("options"))})


def _admin(bank: Bank, questions: DataFrame) -> DataFrame:
    fields = ["solver_id", "prompt_version", "model", "method", "solver_answer", "matches_key", "check_passed", "confidence", "steps", "check_code"]
    shown = questions.select(F.col("current_version_id").alias("question_version_id"))
    runs = bank["answer_verifications"].join(F.broadcast(shown), "question_version_id", "left_semi").groupBy("question_version_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("verifications"))
    rows = _current(bank, questions).join(runs, F.col("version_id") == F.col("question_version_id"), "left")
    kind = runs.schema["verifications"].dataType
    return rows.withColumn("verifications", F.coalesce("verifications", F.array().cast(kind))).select(*ADMIN)


def _mock(bank: Bank, mock_id: str):
    row = bank["mocks"].where(F.col("id") == mock_id).select("status").head()
    if row is None:
        raise NotFound("No such mock")
    return row


def mock_questions(bank: Bank, mock_id: str) -> DataFrame:
    """What a test-taker sees of a published mock: no key, no crop that shows one."""
    if _mock(bank, mock_id).status != "PUBLISHED":
        raise NotPublished("Mock isn't published")
    return _current(bank, bank["questions"].where(F.col("mock_id") == mock_id)).select(*PUBLIC).orderBy("q_no")


def admin_mock_questions(bank: Bank, mock_id: str) -> DataFrame:
    _mock(bank, mock_id)
    return _admin(bank, bank["questions"].where(F.col("mock_id") == mock_id)).orderBy("q_no")


def admin_question(bank: Bank, question_id: int) -> DataFrame:
    one = bank["questions"].where(F.col("id") == question_id)
    if one.head() is None:
        raise NotFound("No such question")
    return _admin(bank, one)


def question_versions(bank: Bank) -> DataFrame:
    """Each question with its versions in order and their assets."""
    assets = bank["question_assets"].groupBy("question_version_id").agg(F.array_sort(F.collect_list(F.struct("kind", "path", "shows_answer"))).alias("assets"))
    v = bank["question_versions"].join(assets, F.col("id") == F.col("question_version_id"), "left")
    return v.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("version", "id", "content_hash", "official_answer", "key_status", "assets"))).alias("versions"))


def review_queue(bank: Bank, status: str = "OPEN") -> DataFrame:
    """Items of a status; an empty status is a status that no item has."""
    rows = bank["review_queue"].where(F.col("status") == status.upper())
    return rows.select("id", "question_id", "paper_id", "section", "q_no", "source", "reasons", "status").orderBy("paper_id", "section", "q_no", "source")


def home(bank: Bank) -> tuple[DataFrame, DataFrame]:
    """(rows, totals) of the start page: mocks with a label each, and ready of all by section."""
    rows = bank["mocks"].select("id", "section", S.shift_label(F.col("paper_id")).alias("shift"), F.when(F.col("status") == "PUBLISHED", "Ready").otherwise("Answers being verified").alias("label"))
    totals = bank["mocks"].groupBy("section").agg(F.count_if(F.col("status") == "PUBLISHED").alias("ready"), F.count("*").alias("total"))
    return rows.orderBy("id"), totals.orderBy("section")
