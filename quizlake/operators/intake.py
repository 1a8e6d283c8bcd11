"""Intake: sheets are deduplicated by content, their layout spans become ordered events, and ten rules accept or reject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions import scalars as S
from quizlake.operators.ordered import filled
from quizlake.sources.readers import document_text
from quizlake.sources.scratch import materialize_counted, small_tasks

# Fixed values of the acceptance rules.
QUESTIONS_PER_SHEET = 100
QUESTIONS_PER_SECTION = 25
CLIPPED_X1 = 540
AD_PAGE_CHARS = 20
KNOWN_SECTIONS = ["ENGLISH", "GA", "QUANT", "REASONING"]

#: Events that a task sorts, and by what.
EVENTS_PER_TASK = 200_000
LAYOUT = ["page_no", "y0", "x0", "kind", "value"]


def dedup_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates) of rows (name, sha256, others): an original name comes before its browser copies.

    Survivors are found before the shuffle, so a content that many files share is one row of it. A folder has a name once.
    """
    place = F.struct(S.base_name(F.col("name")), S.is_copy(F.col("name")), "name")
    first = files.groupBy("sha256").agg(F.min_by(F.struct(*[c for c in files.columns if c != "sha256"]), place).alias("k"))
    kept = first.select(*[F.col("sha256") if c == "sha256" else F.col(f"k.{c}") for c in files.columns])
    same = files.select(F.col("name").alias("filename"), "sha256").join(first.select("sha256", F.col("k.name").alias("same_as")), "sha256")
    return kept, same.where("filename <> same_as").select("filename", "sha256", "same_as")


def events(spans: DataFrame) -> DataFrame:
    """file, page, y0, x0, kind, value of every line that says something, and of every marked answer span; and at, the event's place
    in its page in layout order, and head, the last section header of its page up to there.

    The spans of a page are gathered in one row, as its text is one, and read once for all of this.
    """
    number = lambda c, name: F.col(c).cast("double").alias(name)
    event = lambda y0, x0, kind, value: F.struct(y0.alias("y0"), x0.alias("x0"), kind.alias("kind"), value.alias("value"))
    green = S.is_green(F.col("color")) & F.col("text").rlike(r"(?U)^[\s\x1c-\x1f]*[1-4]\.")
    span = F.struct("line_no", "span_no", "text", number("line_y0", "y0"), number("line_x0", "x0"), number("line_x1", "x1"))
    mark = event(number("span_y0", "y0"), number("span_x0", "x0"), F.lit("answer"), F.col("text"))
    page = spans.groupBy("file", "page_no").agg(F.sort_array(F.collect_list(span)).alias("s"), F.collect_list(F.when(green, mark)).alias("marks"))
    begins = lambda x, i: ~F.get("s", i - 1)["line_no"].eqNullSafe(x["line_no"])
    said = lambda x: F.coalesce(F.replace(x["text"], F.lit("\0"), F.lit("\0.")), F.lit(""))
    # a page's lines as one text with a cut between two of them, which no span holds as its own zeros have a point behind them
    cut = F.array_join(F.transform("s", lambda x, i: F.when((i > 0) & begins(x, i), F.concat(F.lit("\0\n"), said(x))).otherwise(said(x))), "")
    page = page.select("file", "page_no", "marks", F.filter("s", lambda x, i: (i == 0) | begins(x, i)).alias("first"), F.split(cut, "\0\n").alias("raw"))
    # arrays beside each other, as a struct for each step costs more than the step; half the lines need no pattern
    said = lambda x: S.strip(S.plain_spaces(F.replace(x, F.lit("\0."), F.lit("\0"))))
    page = page.select("file", "page_no", "marks", "first", F.transform("raw", lambda x: F.when(x.contains("Q") | x.contains("Section"), said(x))).alias("text"))
    page = page.withColumn("id", F.transform("text", lambda t: F.when(t.contains("Question ID"), F.regexp_extract(t, S.QUESTION_ID, 1))))
    title = lambda t: S.strip(F.substring(t, F.lit(len("Section :") + 1), F.length(t)))
    line = lambda i, kind, value: event(F.get("first", i)["y0"], F.get("first", i)["x0"], kind, value)
    clipped = lambda i: F.when(F.get("first", i)["x1"] > CLIPPED_X1, "clipped").otherwise("qid")
    found = F.transform("text", lambda t, i: F.when(t.startswith("Section :"), line(i, F.lit("section"), title(t))).when(t.startswith("Q.") & t.rlike(r"^Q\.\d+"), line(i, F.lit("label"), t)).when(F.get("id", i) != "", line(i, clipped(i), F.get("id", i))))
    page = page.select("file", "page_no", F.sort_array(F.concat(F.filter(found, lambda x: x.isNotNull()), "marks")).alias("e"))
    # the page's events are cut at its headers, and those before the first one have none
    headers = F.filter(F.transform("e", lambda x, i: F.when(x["kind"] == "section", F.struct(i.alias("i"), S.section_code(x["value"]).alias("head")))), lambda x: x.isNotNull())
    page = page.withColumn("runs", F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("head"))), headers))
    run = lambda r, j: F.slice("e", r["i"] + 1, F.coalesce(F.get("runs", j + 1)["i"], F.size("e")) - r["i"])
    runs = page.select("file", "page_no", F.inline(F.transform("runs", lambda r, j: F.struct(r["i"].alias("i"), r["head"].alias("head"), run(r, j).alias("e")))))
    return runs.select("file", "page_no", "i", "head", F.posexplode("e").alias("k", "x")).select("file", "page_no", "x.*", (F.col("i") + F.col("k") + 1).alias("at"), "head")


def _written(ev: DataFrame) -> tuple[DataFrame, int]:
    """Events written once, else they would be made again to find what a page carries on to the next; and tasks to sort them by."""
    with small_tasks(ev.sparkSession):
        ev, n = materialize_counted(ev, "events", {"rows": F.lit(True)})
    return ev, max(-(-n["rows"] // EVENTS_PER_TASK), ev.sparkSession.sparkContext.defaultParallelism)


def with_section(ev: DataFrame) -> DataFrame:
    """Each event with its place in the file and the section in force there: the last header before it in layout order."""
    ev, tasks = _written(ev)
    if "at" in ev.columns:
        return filled(ev, "file", LAYOUT, F.col("head"), "section", "page_no", tasks, "at").drop("at", "head")
    return filled(ev, "file", LAYOUT, F.when(F.col("kind") == "section", S.section_code(F.col("value"))), "section", "page_no", tasks)


def _counted() -> list[Column]:
    return [F.count_if(F.col("kind") == kind).cast("int").alias(name) for kind, name in (("answer", "questions"), ("qid", "qids"), ("label", "labels"))]


def _sections() -> Column:
    found = F.collect_list(F.when(F.col("section").isNotNull(), F.struct("place", "section", "questions", "qids", "labels")))
    return F.map_from_entries(F.transform(F.array_sort(found), lambda x: F.struct(x["section"], F.struct(x["questions"].alias("questions"), x["qids"].alias("qids"), x["labels"].alias("labels")))))


def section_counts(ev: DataFrame) -> DataFrame:
    """file, sections: counts by section, an empty section included, in the order of first appearance."""
    counts = ev.where("section is not null").groupBy(F.xxhash64("file", "section").alias("_hash"), "file", "section").agg(F.min("place").alias("place"), *_counted())
    return counts.groupBy("file").agg(_sections().alias("sections"))


def scan(docs: DataFrame, pages: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each file with all that the rules look at."""
    ev, tasks = _written(events(spans))
    sections = filled(ev, "file", LAYOUT, F.col("head"), "section", "page_no", tasks, "at", _counted()).groupBy("file").agg(_sections().alias("sections"))
    listed = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("page_no", "at", "value")))), lambda x: x["value"])
    ids = ev.where("kind in ('qid', 'clipped')").groupBy(F.xxhash64("file").alias("_hash"), "file").agg(listed("qid").alias("qids"), listed("clipped").alias("clipped_qids")).drop("_hash")
    clean = pages.withColumn("text", S.plain_spaces(F.col("text")))
    t = F.col("text")
    ad = F.when(~S.has_chars(t, AD_PAGE_CHARS), F.col("page_no"))
    text = document_text(clean, F.array_sort(F.collect_list(ad)).alias("ad_pages")).select(
        "file", "ad_pages", t.contains(S.HEADER).alias("header"), S.header_date(t).alias("header_date"), S.header_slot(t).alias("header_hhmm"),
        F.regexp_count(t, F.lit(r"Option [1-4] ID\s*:\s*\d+")).alias("option_ids"), F.regexp_count(t, F.lit(r"Status\s*:")).alias("statuses"), F.regexp_count(t, F.lit(r"Chosen Option\s*:")).alias("chosen"),
    )
    out = docs.join(text, "file", "left").join(sections, "file", "left").join(ids, "file", "left")
    none = F.array().cast("array<string>")
    return out.select(
        "file", "sha256", F.col("page_count").alias("pages"), F.coalesce("producer", F.lit("")).alias("producer"), "annotations", F.coalesce("header", F.lit(False)).alias("header"), "header_date", "header_hhmm", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("option_ids", "statuses", "chosen")],
        F.coalesce("ad_pages", F.array().cast("array<int>")).alias("ad_pages"), F.coalesce("qids", none).alias("qids"), F.coalesce("clipped_qids", none).alias("clipped_qids"), F.coalesce("sections", F.create_map().cast("map<string,struct<questions:int,qids:int,labels:int>>")).alias("sections"),
    )


def _deficit(field: str) -> Column:
    return F.aggregate(F.map_values("sections"), F.lit(0), lambda n, v: n + S.clamped(v["questions"] - v[field]))


def overflow_count() -> Column:
    """Questions without a whole question id."""
    return _deficit("qids")


def unlabeled_count() -> Column:
    """Questions whose label has no text."""
    return _deficit("labels")


def _shown(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]"))


def reasons(file_date: Column, file_slot: Column) -> Column:
    """The rules that a scan breaks, in their order; none means accepted. The texts are fixed values."""
    c = F.col
    n_ids = F.size("qids")
    expected = n_ids + F.size("clipped_qids")
    say = F.format_string
    bad = F.filter("qids", lambda q: ~F.length(q).between(10, 13))
    found = F.array_sort(F.map_keys("sections"))
    known = F.array(*[F.lit(x) for x in KNOWN_SECTIONS])
    text = lambda x: F.coalesce(x, F.lit("None"))
    rules = [
        F.when(~c("header"), F.lit("SSC header missing")),
        F.when(~(c("header_date").eqNullSafe(file_date) & c("header_hhmm").eqNullSafe(file_slot)), say("header %s %s != filename %s %s", text(c("header_date")), text(c("header_hhmm")), text(file_date), text(file_slot))),
        F.when(F.size(bad) > 0, F.concat(F.lit("Question IDs outside 10-13 digits: "), _shown(bad))),
        F.when(n_ids + overflow_count() != QUESTIONS_PER_SHEET, say("%d Question IDs + %d overflowed != 100", n_ids, overflow_count())),
        F.when(c("option_ids") < 4 * n_ids, say("%d Option IDs for %d questions", c("option_ids"), n_ids)),
        F.when((c("statuses") != expected) | (c("chosen") != expected), say("Status/Chosen Option counts %d/%d != %d", c("statuses"), c("chosen"), expected)),
        F.when(found != known, F.concat(F.lit("sections found: "), _shown(found))),
        *[F.when(F.coalesce(c("sections")[s]["questions"], F.lit(0)) != QUESTIONS_PER_SECTION, say(f"{s} has %d questions", F.coalesce(c("sections")[s]["questions"], F.lit(0)))) for s in ("QUANT", "REASONING")],
        F.when(c("annotations") > 0, say("%d PDF annotations added", c("annotations"))),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def notes() -> Column:
    """What is known of an accepted or rejected scan, as text. The texts are fixed values."""
    say, joined = F.format_string, lambda x: F.array_join(x, ", ")
    ads = F.coalesce(F.nullif(joined(F.transform("ad_pages", lambda p: p.cast("string"))), F.lit("")), F.lit("none"))
    short = F.filter(F.map_entries("sections"), lambda e: e["value"]["questions"] > e["value"]["qids"])
    where = joined(F.transform(short, lambda e: F.concat_ws(" ", e["key"], (e["value"]["questions"] - e["value"]["qids"]).cast("string"))))
    return F.concat_ws(
        "; ",
        say("Adda247 re-publication (%s); branding header/watermark and ad page(s) %s accepted as known noise", S.strip(F.col("producer")), ads),
        F.when(overflow_count() > 0, say("%d question(s) overflow the page with Question ID box cut off (%s); to review queue in Phase 2", overflow_count(), where)),
        F.when(F.size("clipped_qids") > 0, say("clipped Question ID(s) %s (truncated at page edge)", joined(F.col("clipped_qids")))),
        F.when(unlabeled_count() > 0, say("%d Quant stem(s) with no readable text layer (math typeset); crop-only", unlabeled_count())),
    )


def sources(kept: DataFrame, scans: DataFrame, stored_dir: str = "data/raw/2024") -> DataFrame:
    """A manifest record for each kept file (name, sha256). A name out of pattern is rejected unread."""
    name = F.col("name")
    parsed = kept.withColumn("date", S.file_date(name)).withColumn("time_slot", S.file_slot(name))
    rows = parsed.join(scans.drop("sha256").withColumnRenamed("file", "name"), "name", "left")
    bad = F.col("date").isNull()
    why = F.when(bad, F.array(F.lit("filename not in expected pattern"))).otherwise(reasons(F.col("date"), F.col("time_slot")))
    rows = rows.withColumn("why", why).withColumn("accepted", F.size("why") == 0)
    good = lambda x: F.when(~bad, x)
    path = F.concat(F.lit(stored_dir + "/"), F.col("date"), F.lit("_"), F.col("time_slot"), F.lit("/"), name)
    return rows.select(
        "date", "time_slot", F.col("name").alias("filename"), "sha256", good(F.lit("unknown")).alias("key_status"), "accepted", F.col("why").alias("reasons"), good(notes()).alias("notes"),
        good(overflow_count()).alias("overflow_questions"), good(unlabeled_count()).alias("unlabeled_questions"), good(F.col("clipped_qids")).alias("clipped_qids"), good(F.col("sections")).alias("sections"), F.when(F.col("accepted"), path).alias("stored_path"),
    )


def date_order() -> list[Column]:
    """Year, month, day, slot, then names as files are listed; records without a date come first."""
    d, name = F.coalesce("date", F.lit("")), F.col("filename")
    return [F.substring(d, 7, 4), F.substring(d, 4, 2), F.substring(d, 1, 2), F.coalesce("time_slot", F.lit("")), S.base_name(name), S.is_copy(name), name]


def in_date_order(records: DataFrame) -> DataFrame:
    return records.orderBy(*date_order())


def to_copy(records: DataFrame, stored: DataFrame) -> DataFrame:
    """Accepted records whose bytes aren't at their path yet; stored: path, sha256."""
    return records.where("accepted").join(stored.select(F.col("path").alias("stored_path"), "sha256"), ["stored_path", "sha256"], "left_anti")


def summary(records: DataFrame, duplicates: DataFrame, excluded: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    counts = records.agg(F.count_if("accepted").alias("ok"), F.count("*").alias("n"), zero.alias("d"), zero.alias("e"))
    counts = counts.union(duplicates.agg(zero, zero, F.count("*"), zero)).union(excluded.agg(zero, zero, zero, F.count("*")))
    return counts.agg(*[F.sum(c).alias(c) for c in ("ok", "n", "d", "e")]).select(F.format_string("accepted %d/%d, duplicates %d, excluded %d", "ok", "n", "d", "e").alias("line"))
