"""Intake, load and read views run as they are over sheets and records made of the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake import schemas
from quizlake.functions import scalars as S
from quizlake.operators import intake, load, quality, report, serve
from quizlake.operators.merge import by_key, last_by
from quizlake.operators.ordered import numbered
from quizlake.plans import inputs as I
from quizlake.plans.demo import ORACLE_SQL as _DEMO_SQL
from quizlake.plans.demo import QUERIES as _DEMO
from quizlake.sources import migrations, readers, scratch, sinks, snapshot

QUERIES, ORACLE_SQL = dict(_DEMO), dict(_DEMO_SQL)


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, I.for_duckdb(sql)
        return f

    return register


def joined(items: Column, sep: str = ",") -> Column:
    """A list as one string, so that rows of any engine compare."""
    return F.array_join(items, sep, "-")


# ---- intake

_EVENTS = rf"""
    SELECT file, page_no, y0, x0, kind, CASE kind WHEN 'section' THEN trim(substr(text, strpos(text, ':') + 1)) WHEN 'label' THEN text ELSE regexp_extract(text, 'Question ID\s*:\s*(\d+)', 1) END AS value
    FROM (SELECT *, CASE WHEN starts_with(text, 'Section :') THEN 'section' WHEN regexp_matches(text, '^Q\.\d+') THEN 'label' WHEN regexp_matches(text, 'Question ID\s*:\s*\d+') THEN CASE WHEN x1 > 540 THEN 'clipped' ELSE 'qid' END END AS kind
        FROM (SELECT file, page_no, line_no, trim(replace(string_agg(text, '' ORDER BY span_no), chr(160), ' ')) AS text, min(line_y0) AS y0, min(line_x0) AS x0, min(line_x1) AS x1 FROM ({I.SPANS}) GROUP BY file, page_no, line_no))
    WHERE kind IS NOT NULL
    UNION ALL SELECT file, page_no, span_y0, span_x0, 'answer', text FROM ({I.SPANS}) WHERE regexp_matches(replace(text, chr(160), ' '), '^\s*[1-4]\.') AND (color >> 8) & 255 > (color >> 16) + 40
"""
_CODES = " ".join(f"WHEN '{name}' THEN '{code}'" for name, code in S.SECTION_CODES.items())
_PLACED = f"""
    SELECT *, row_number() OVER w AS place, last_value(CASE WHEN kind = 'section' THEN CASE value {_CODES} ELSE value END END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS section FROM ({_EVENTS}) WINDOW w AS (PARTITION BY file ORDER BY page_no, y0, x0, kind, value)
"""
_COUNTS = f"SELECT file, section, min(place) AS p, count_if(kind = 'answer') AS questions, count_if(kind = 'qid') AS qids, count_if(kind = 'label') AS labels FROM ({_PLACED}) WHERE section IS NOT NULL GROUP BY file, section"
_SCAN = rf"""
    WITH counts AS MATERIALIZED ({_COUNTS}), ev AS MATERIALIZED ({_PLACED}),
    text AS (SELECT file, string_agg(replace(text, chr(160), ' '), chr(10) ORDER BY page_no) AS t, coalesce(string_agg(CAST(page_no AS VARCHAR), ', ' ORDER BY page_no) FILTER (length(trim(replace(replace(text, chr(160), ' '), chr(10), ' '))) < 20), '') AS ads FROM ({I.PAGES}) GROUP BY file)
    SELECT d.file, d.sha256, d.page_count AS pages, coalesce(d.producer, '') AS producer, d.annotations, contains(t, '{S.HEADER}') AS header, regexp_replace(nullif(regexp_extract(t, 'Exam Date\s*(\d\d/\d\d/\d{{4}})', 1), ''), '/', '.', 'g') AS header_date,
        lpad(CAST(CAST(regexp_extract(t, 'Exam Time\s*(\d+):', 1) AS INTEGER) % 12 + CASE WHEN regexp_extract(t, 'Exam Time\s*\d+:\d\d\s*(AM|PM)', 1) = 'PM' THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || regexp_extract(t, 'Exam Time\s*\d+:(\d\d)', 1) AS header_hhmm,
        len(regexp_extract_all(t, 'Option [1-4] ID\s*:\s*\d+')) AS option_ids, len(regexp_extract_all(t, 'Status\s*:')) AS statuses, len(regexp_extract_all(t, 'Chosen Option\s*:')) AS chosen, ads AS ad_pages,
        (SELECT coalesce(string_agg(value, ',' ORDER BY place), '') FROM ev WHERE ev.file = d.file AND kind = 'qid') AS qids, (SELECT coalesce(string_agg(value, ', ' ORDER BY place), '') FROM ev WHERE ev.file = d.file AND kind = 'clipped') AS clipped_qids,
        (SELECT count(*) FROM ev WHERE ev.file = d.file AND kind = 'qid') AS n_qids, (SELECT count(*) FROM ev WHERE ev.file = d.file AND kind = 'clipped') AS n_clipped,
        (SELECT string_agg('''' || value || '''', ', ' ORDER BY place) FROM ev WHERE ev.file = d.file AND kind = 'qid' AND length(value) NOT BETWEEN 10 AND 13) AS bad,
        (SELECT string_agg(section || '=' || questions || '/' || qids || '/' || labels, ',' ORDER BY p) FROM counts c WHERE c.file = d.file) AS sections, (SELECT string_agg('''' || section || '''', ', ' ORDER BY section) FROM counts c WHERE c.file = d.file) AS found,
        (SELECT CAST(sum(greatest(0, questions - qids)) AS BIGINT) FROM counts c WHERE c.file = d.file) AS overflow, (SELECT CAST(sum(greatest(0, questions - labels)) AS BIGINT) FROM counts c WHERE c.file = d.file) AS unlabeled,
        (SELECT string_agg(section || ' ' || (questions - qids), ', ' ORDER BY p) FROM counts c WHERE c.file = d.file AND questions > qids) AS short, coalesce((SELECT questions FROM counts c WHERE c.file = d.file AND section = 'QUANT'), 0) AS quant, coalesce((SELECT questions FROM counts c WHERE c.file = d.file AND section = 'REASONING'), 0) AS reasoning
    FROM ({I.DOCS}) d JOIN text ON d.file = text.file
"""
_NAMED = rf"""
    SELECT *, regexp_matches(file, '{S.FILE_NAME}') AS named, regexp_extract(file, 'English_(\d\d\.\d\d\.\d{{4}})_', 1) AS date_, lpad(CAST(TRY_CAST(regexp_extract(file, '_(\d+)\.\d\d-[AP]M-', 1) AS INTEGER) % 12 + CASE WHEN contains(file, '-PM-') THEN 12 ELSE 0 END AS VARCHAR), 2, '0') || '30' AS slot_
    FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY replace(file, ' (1).pdf', '.pdf'), file LIKE '% (1).pdf', file) AS r, first_value(file) OVER (PARTITION BY sha256 ORDER BY replace(file, ' (1).pdf', '.pdf'), file LIKE '% (1).pdf', file) AS same_as FROM ({_SCAN}))
"""
_RECORDS = f"""
    SELECT CASE WHEN named THEN date_ END AS date, CASE WHEN named THEN slot_ END AS time_slot, file AS filename, sha256, CASE WHEN named THEN 'unknown' END AS key_status, why = '' AS accepted, why AS reasons,
        CASE WHEN named THEN concat_ws('; ', 'Adda247 re-publication (' || trim(replace(producer, chr(160), ' ')) || '); branding header/watermark and ad page(s) ' || coalesce(nullif(ad_pages, ''), 'none') || ' accepted as known noise', CASE WHEN overflow > 0 THEN overflow || ' question(s) overflow the page with Question ID box cut off (' || short || '); to review queue in Phase 2' END,
            CASE WHEN n_clipped > 0 THEN 'clipped Question ID(s) ' || clipped_qids || ' (truncated at page edge)' END, CASE WHEN unlabeled > 0 THEN unlabeled || ' Quant stem(s) with no readable text layer (math typeset); crop-only' END) END AS notes,
        CASE WHEN named THEN overflow END AS overflow_questions, CASE WHEN named THEN unlabeled END AS unlabeled_questions, CASE WHEN named THEN clipped_qids END AS clipped_qids, CASE WHEN named THEN sections END AS sections,
        CASE WHEN why = '' THEN 'data/raw/2024/' || date_ || '_' || slot_ || '/' || file END AS stored_path
    FROM (SELECT *, CASE WHEN NOT named THEN 'filename not in expected pattern' ELSE concat_ws('|', CASE WHEN NOT header THEN 'SSC header missing' END, CASE WHEN header_date || header_hhmm <> date_ || slot_ THEN 'header ' || header_date || ' ' || header_hhmm || ' != filename ' || date_ || ' ' || slot_ END,
            'Question IDs outside 10-13 digits: [' || bad || ']', CASE WHEN n_qids + overflow <> 100 THEN n_qids || ' Question IDs + ' || overflow || ' overflowed != 100' END, CASE WHEN option_ids < 4 * n_qids THEN option_ids || ' Option IDs for ' || n_qids || ' questions' END,
            CASE WHEN statuses <> n_qids + n_clipped OR chosen <> n_qids + n_clipped THEN 'Status/Chosen Option counts ' || statuses || '/' || chosen || ' != ' || (n_qids + n_clipped) END, CASE WHEN found <> '''ENGLISH'', ''GA'', ''QUANT'', ''REASONING''' THEN 'sections found: [' || found || ']' END,
            CASE WHEN quant <> 25 THEN 'QUANT has ' || quant || ' questions' END, CASE WHEN reasoning <> 25 THEN 'REASONING has ' || reasoning || ' questions' END, CASE WHEN annotations > 0 THEN annotations || ' PDF annotations added' END) END AS why FROM ({_NAMED}) WHERE r = 1)
"""
_DUPLICATES = f"SELECT file AS filename, sha256, same_as FROM ({_NAMED}) WHERE r > 1"
_ORDER = "coalesce(substr(date, 7, 4), ''), coalesce(substr(date, 4, 2), ''), coalesce(substr(date, 1, 2), ''), coalesce(time_slot, ''), replace(filename, ' (1).pdf', '.pdf'), filename LIKE '% (1).pdf', filename"


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates) of the suppliers' sheets, of which no content is read."""
    return intake.dedup_files(I.rows(spark, d, I.DOCS).select(F.col("file").alias("name"), "sha256"))


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return intake.scan(*(I.rows(spark, d, sql) for sql in (I.DOCS, I.PAGES, I.SPANS)))


def _intake(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(records, duplicates) of the suppliers' sheets."""
    kept, duplicates = _files(spark, d)
    return intake.sources(kept, _scans(spark, d)), duplicates


def _counts(c: str) -> Column:
    return joined(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), F.concat_ws("/", *[e["value"][x].cast("string") for x in ("questions", "qids", "labels")]))))


def _excluded(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name"))


@query(_EVENTS)
def sheet_events(spark, d):
    return intake.events(I.rows(spark, d, I.SPANS)).drop("at", "head")


@query(f"SELECT file, CAST(place AS INTEGER) AS place, kind, value, section FROM ({_PLACED})")
def sheet_sections(spark, d):
    return intake.with_section(intake.events(I.rows(spark, d, I.SPANS))).select("file", "place", "kind", "value", "section")


@query(f"SELECT file, string_agg(section || '=' || questions || '/' || qids || '/' || labels, ',' ORDER BY p) AS sections FROM ({_COUNTS}) GROUP BY file")
def sheet_counts(spark, d):
    return intake.section_counts(intake.with_section(intake.events(I.rows(spark, d, I.SPANS)))).select("file", _counts("sections").alias("sections"))


@query(f"SELECT file, sha256, pages, producer, annotations, header, header_date, header_hhmm, CAST(option_ids AS INTEGER) AS option_ids, CAST(statuses AS INTEGER) AS statuses, CAST(chosen AS INTEGER) AS chosen, ad_pages, qids, clipped_qids, sections, CAST(overflow AS INTEGER) AS overflow, CAST(unlabeled AS INTEGER) AS unlabeled FROM ({_SCAN})")
def sheet_scans(spark, d):
    scans = _scans(spark, d)
    return scans.select(*[c for c in scans.columns if c not in ("ad_pages", "qids", "clipped_qids", "sections")], joined(F.col("ad_pages").cast("array<string>"), ", ").alias("ad_pages"), joined(F.col("qids")).alias("qids"), joined(F.col("clipped_qids"), ", ").alias("clipped_qids"), _counts("sections").alias("sections"), intake.overflow_count().alias("overflow"), intake.unlabeled_count().alias("unlabeled"))


@query(f"SELECT date, time_slot, filename, sha256, key_status, accepted, reasons, notes, CAST(overflow_questions AS INTEGER) AS overflow_questions, CAST(unlabeled_questions AS INTEGER) AS unlabeled_questions, clipped_qids, sections, stored_path FROM ({_RECORDS})")
def sheet_records(spark, d):
    r = _intake(spark, d)[0]
    return r.withColumns({"reasons": joined(F.col("reasons"), "|"), "clipped_qids": joined(F.col("clipped_qids"), ", "), "sections": _counts("sections")})


@query(_DUPLICATES)
def sheet_duplicates(spark, d):
    return _files(spark, d)[1]


@query(f"""WITH r AS MATERIALIZED ({_RECORDS})
    SELECT 'source' AS kind, '| ' || coalesce(date, '') || ' | ' || coalesce(time_slot, '') || ' | `' || filename || '` | `' || coalesce(stored_path, '-') || '` | `' || sha256 || '` | ' || coalesce(key_status, 'unknown') || ' | ' || CASE WHEN accepted THEN 'accepted' ELSE 'rejected: ' || replace(reasons, '|', '; ') END || ' | ' || coalesce(notes, '') || ' |' AS line FROM r
    UNION ALL SELECT 'rejected', '- `' || filename || '`: ' || replace(reasons, '|', '; ') FROM r WHERE NOT accepted UNION ALL SELECT 'overflow', '- ' || date || ' ' || time_slot || ': ' || overflow_questions FROM r WHERE overflow_questions > 0
    UNION ALL SELECT 'unlabeled', '- ' || date || ' ' || time_slot || ': ' || unlabeled_questions FROM r WHERE unlabeled_questions > 0 UNION ALL SELECT 'duplicate', '- `' || filename || '` is identical to `' || same_as || '` (SHA-256 `' || substr(sha256, 1, 16) || '…`)' FROM ({_DUPLICATES})
    UNION ALL SELECT 'totals', CAST(sum(unlabeled_questions) AS BIGINT) || ' in ' || count(*) FROM r WHERE unlabeled_questions > 0""")
def sheet_listings(spark, d):
    r, dup = _intake(spark, d)
    r = scratch.materialize(r, "records")
    line = lambda df, kind, column: df.select(F.lit(kind).alias("kind"), column.alias("line"))
    out = line(r, "source", sinks.source_line()).union(line(r.where("not accepted"), "rejected", sinks.rejected_line())).union(line(dup, "duplicate", sinks.duplicate_line()))
    for kind in ("overflow", "unlabeled"):
        out = out.union(line(r.where(f"{kind}_questions > 0"), kind, sinks.count_line(f"{kind}_questions")))
    return out.union(line(sinks.unlabeled_totals(r), "totals", F.format_string("%d in %d", "n", "sheets")))


def _document_sql(*blocks: str) -> str:
    """The numbered lines of blocks, each a text of SQL for rows (i, line) with i from 1."""
    return "SELECT CAST(row_number() OVER (ORDER BY b, i) - 1 AS BIGINT) AS row, line FROM (" + " UNION ALL ".join(f"SELECT {k} AS b, i, line FROM ({x})" for k, x in enumerate(blocks)) + ")"


def _head_sql(text: str, values: str = "", args: int = 0) -> str:
    """The lines of a head; values: a query of one row with the columns a and b for its numbers."""
    quoted = "'" + text.removeprefix("\n").removesuffix("\n").replace("'", "''") + "'"
    for name in ("a", "b")[:args]:
        quoted = f"regexp_replace({quoted}, '%d', CAST({name} AS VARCHAR))"
    return f"SELECT unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT string_split({quoted}, chr(10)) AS x{f' FROM ({values})' if values else ''})"


def _items_sql(rows: str, line: str, order: str) -> str:
    """The lines of rows, or that there are none."""
    return f"SELECT row_number() OVER (ORDER BY {order}) AS i, {line} AS line FROM ({rows}) UNION ALL SELECT 1, '- none' WHERE NOT EXISTS ({rows})"


_SOURCE_LINE = "'| ' || coalesce(date, '') || ' | ' || coalesce(time_slot, '') || ' | `' || filename || '` | `' || coalesce(stored_path, '-') || '` | `' || sha256 || '` | ' || coalesce(key_status, 'unknown') || ' | ' || CASE WHEN accepted THEN 'accepted' ELSE 'rejected: ' || replace(reasons, '|', '; ') END || ' | ' || coalesce(notes, '') || ' |'"
_COUNT_LINE = "'- ' || date || ' ' || time_slot || ': ' || {}_questions"


def _document(doc):
    return numbered(doc, sinks.DOCUMENT_ORDER).select("row", "line")


@query(f"WITH r AS MATERIALIZED ({_RECORDS}) " + _document_sql(
    _head_sql(sinks.SOURCES_HEAD, "SELECT count_if(accepted) AS a, count(*) AS b FROM r", 2), f"SELECT row_number() OVER (ORDER BY {_ORDER}) AS i, {_SOURCE_LINE} AS line FROM r",
))
def sheet_source_document(spark, d):
    """The whole source listing, line by line."""
    return _document(sinks.source_document(scratch.materialize(_intake(spark, d)[0], "records")))


@query(f"WITH r AS MATERIALIZED ({_RECORDS}) " + _document_sql(
    _head_sql(sinks.MISSING_HEAD), _items_sql(_DUPLICATES, "'- `' || filename || '` is identical to `' || same_as || '` (SHA-256 `' || substr(sha256, 1, 16) || '…`)'", "filename"),
    _head_sql(sinks.EXCLUDED_HEAD), _items_sql("SELECT r_name FROM region", "'- `' || r_name || '`'", "r_name"),
    _head_sql(sinks.REJECTED_HEAD), _items_sql("SELECT * FROM r WHERE NOT accepted", "'- `' || filename || '`: ' || replace(reasons, '|', '; ')", _ORDER),
    _head_sql(sinks.OVERFLOW_HEAD), _items_sql("SELECT * FROM r WHERE overflow_questions > 0", _COUNT_LINE.format("overflow"), _ORDER),
    _head_sql(sinks.UNLABELED_HEAD, "SELECT CAST(coalesce(sum(unlabeled_questions), 0) AS BIGINT) AS a, count(*) AS b FROM r WHERE unlabeled_questions > 0", 2), _items_sql("SELECT * FROM r WHERE unlabeled_questions > 0", _COUNT_LINE.format("unlabeled"), _ORDER),
))
def sheet_missing_document(spark, d):
    """The whole listing of what is missing, doubled, excluded or to be looked at, line by line."""
    (records, dup), excluded = _intake(spark, d), _excluded(spark, d)
    return _document(sinks.missing_document(scratch.materialize(records, "records"), dup, excluded))


@query(f"""SELECT filename, CAST(row_number() OVER (ORDER BY {_ORDER}) - 1 AS INTEGER) AS ord, date, accepted, reasons, stored_path, sections, (SELECT count(*) FROM ({_DUPLICATES})) AS n_duplicates, (SELECT string_agg(r_name, ',' ORDER BY r_name) FROM region) AS excluded FROM ({_RECORDS})""")
def sheet_manifest(spark, d):
    """The manifest written as a document and read again, in its order."""
    records, dup = _intake(spark, d)
    path = f"{scratch.scratch_dir(spark)}/manifest-{uuid.uuid4().hex}"
    sinks.write_manifest(sinks.manifest_document(scratch.materialize(records, "records"), dup, _excluded(spark, d)), path)
    sources, dup, ex = readers.manifest(spark, path)
    totals = dup.agg(F.count("*").alias("n_duplicates")).join(ex.agg(joined(F.array_sort(F.collect_list("name"))).alias("excluded")), F.lit(True))  # a row each
    return sources.join(F.broadcast(totals), F.lit(True)).select("filename", "ord", "date", "accepted", joined(F.col("reasons"), "|").alias("reasons"), "stored_path", _counts("sections").alias("sections"), "n_duplicates", "excluded")


@query(f"SELECT 'accepted ' || count_if(accepted) || '/' || count(*) || ', duplicates ' || (SELECT count(*) FROM ({_DUPLICATES})) || ', excluded ' || (SELECT count(*) FROM region) AS line FROM ({_RECORDS})")
def sheet_summary(spark, d):
    records, duplicates = _intake(spark, d)
    return intake.summary(records, duplicates, _excluded(spark, d))


@query(f"SELECT filename, stored_path FROM ({_RECORDS}) WHERE accepted AND NOT CAST(sha256 AS BIGINT) % 3 = 0")
def sheet_copies(spark, d):
    """What is to be copied where a third of the files is there already, and others lie there with other bytes."""
    records = scratch.materialize(_intake(spark, d)[0], "records")
    stored = records.where("accepted").select(F.col("stored_path").alias("path"), F.when(F.col("sha256").cast("long") % 3 == 0, F.col("sha256")).otherwise("x").alias("sha256"))
    return intake.to_copy(records, stored).select("filename", "stored_path")


@query("SELECT sha256(r_name || chr(10)) AS sha256, count(*) OVER () AS n_names FROM region")
def file_digests(spark, d):
    """Files written, listed by a pattern, and hashed; the listing of names reads no content."""
    root = f"{scratch.scratch_dir(spark)}/files-{uuid.uuid4().hex}"
    spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name").write.partitionBy("r_regionkey").text(root)
    n = readers.excluded_files(spark, f"{root}/r_regionkey=*", "part-*.txt").agg(F.count("*").alias("n_names"))
    return readers.sheet_files(spark, f"{root}/r_regionkey=*", "part-*.txt").join(F.broadcast(n), F.lit(True)).select("sha256", "n_names")


@query("SELECT r_regionkey, sha256(CASE WHEN r_regionkey = 4 THEN r_name ELSE r_name || chr(10) END) AS sha256, CASE WHEN r_regionkey < 3 THEN 'there' WHEN r_regionkey = 3 THEN 'copied' ELSE 'failed' END AS status, CASE WHEN r_regionkey = 3 THEN length(r_name) + 1 ELSE 0 END AS bytes FROM region")
def sheet_copied(spark, d):
    """Files copied by tasks: some were copied before, one has another hash than it should."""
    root = f"{scratch.scratch_dir(spark)}/copied-{uuid.uuid4().hex}"
    region = spark.read.parquet(f"{d}/region.parquet").select("r_regionkey", "r_name")
    region.write.partitionBy("r_regionkey").text(f"{root}/from")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.txt").load(f"{root}/from").select(F.col("path").alias("source"), F.sha2("content", 256).alias("sha256"), "r_regionkey")
    files = files.withColumn("target", F.format_string(f"{root}/to/%d.txt", "r_regionkey"))
    assert sinks.copy_files(files.where("r_regionkey < 3")).where("status = 'copied'").count() == 3
    wrong = region.where("r_regionkey = 4").select("r_regionkey", F.sha2("r_name", 256).alias("other"))
    files = files.join(F.broadcast(wrong), "r_regionkey", "left").withColumn("sha256", F.coalesce("other", "sha256"))  # a row
    done = sinks.copy_files(files)
    return done.select(F.regexp_extract("target", "([0-9]+).txt", 1).cast("int").alias("r_regionkey"), "sha256", "status", "bytes")


# ---- load and read views

_BANKS: dict[tuple[str, str], tuple[str, DataFrame]] = {}


def _write_inputs(spark: SparkSession, d: str, number: int, folder: str) -> None:
    """A data folder of one load: manifest, question records, review items, verdicts."""
    none = F.lit(None).cast("string")
    src = I.rows(spark, d, I.SOURCES[number]).withColumns({"reasons": F.array().cast("array<string>"), "notes": none, "overflow_questions": F.lit(0), "unlabeled_questions": F.lit(0), "clipped_qids": F.array().cast("array<string>"), "sections": F.create_map().cast("map<string,struct<questions:int,qids:int,labels:int>>")})
    doc = sinks.manifest_document(src, spark.createDataFrame([], "filename string, sha256 string, same_as string"), spark.createDataFrame([], "name string"))
    q = I.rows(spark, d, I.QUESTIONS[number])
    option = lambda label, text, image: F.struct(F.lit(label).alias("label"), text.alias("text"), image.alias("image"))
    options = F.array(option("A", F.col("p_brand"), none), option("B", F.col("p_type"), F.col("b_image")))
    records = q.select(
        "paper_id", "mock_id", "q_no", "section", F.col("qid").alias("ssc_question_id"), F.col("stem").alias("stem_text"), F.lit(True).alias("stem_text_complete"), "stem_image", options.alias("options"), F.col("answer").alias("official_answer"), F.lit("UNVERIFIED").alias("key_status"),
        F.lit(1).alias("source_page"), F.col("crop").alias("question_crop"), F.lit(False).alias("has_visual"), "status", "topic", F.col("p_brand").alias("subtopic"), F.lit("rule").alias("topic_source"),
    )
    items = I.rows(spark, d, I.REVIEWS[number]).select("paper_id", "section", "q_no", F.split("reason", ",").alias("reasons"))
    array = items.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))  # one array is the file's form
    v = I.rows(spark, d, I.VERDICTS[number]).withColumn("own", S.content_hash(F.col("qid"), F.col("stem"), F.col("stem_image"), options))
    own = F.col("own")
    run = lambda solver, version, more: F.struct(version.alias("question_version"), F.lit(solver).alias("solver_id"), F.lit("p1").alias("prompt_version"), F.col("answer").alias("solver_answer"), F.lit(True).alias("matches_key"), *[x.cast(t).alias(n) for n, t, x in zip(("steps", "valid"), ("array<string>", "boolean"), more, strict=True)])
    runs = F.array(run("a", own, (F.array(F.lit("one"), F.lit("two")), F.lit(None))), run("b", F.when(F.col("stale"), "old").otherwise(own), (F.lit(None), F.lit(False))))
    runs = F.when(F.col("third"), F.concat(runs, F.array(run("c", own, (F.lit(None), F.lit(True)))))).otherwise(runs)
    verdicts = v.select("paper_id", "section", "q_no", F.col("answer").alias("official_answer"), F.col("verdict").alias("status"), runs.alias("verifications"))
    writes = [
        lambda: sinks.write_manifest(doc, f"{folder}/intake_manifest.json"), lambda: records.write.json(f"{folder}/questions/questions.jsonl"), lambda: array.write.text(f"{folder}/questions/review_queue.json"),
        lambda: verdicts.write.json(f"{folder}/solver/verifications/v.jsonl"),
    ]
    with ThreadPoolExecutor(len(writes)) as pool:
        list(pool.map(lambda write: write(), writes))


def _loaded(spark: SparkSession, d: str) -> tuple[str, DataFrame]:
    """The root of a bank after both loads and the second one's report; made once in a session for each folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BANKS:
        root = f"{scratch.scratch_dir(spark)}/bank-{uuid.uuid4().hex}"
        for number in (1, 2):
            _write_inputs(spark, d, number, f"{root}/input-{number}")
            changes = load.load_into(spark, f"{root}/bank", load.read_inputs(spark, f"{root}/input-{number}"))
        _BANKS[key] = f"{root}/bank", changes
    return _BANKS[key]


def _bank(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return snapshot.read(spark, _loaded(spark, d)[0])


_JSON = "'[' || to_json({qid}) || ', ' || to_json({stem}) || ', ' || coalesce(to_json(stem_image), 'null') || ', [[' || to_json(p_brand) || ', null], [' || to_json(p_type) || ', ' || coalesce(to_json(b_image), 'null') || ']]]'"
_HASH = lambda **k: f"substr(sha256({_JSON.format(**k)}), 1, 16)"

#: What both loads must leave of every question: changed ones have a second, unverified version; verdicts of the second load
#: apply to unchanged ones only; those it lacks are withdrawn, but for reviewed keys.
_FINAL = f"""
    SELECT a.*, b.qid AS qid2, b.stem AS stem2, b.topic AS topic2, {_HASH(qid="a.qid", stem="a.stem").replace("stem_image", "a.stem_image").replace("p_brand", "a.p_brand").replace("p_type", "a.p_type").replace("b_image", "a.b_image")} AS hash1, {_HASH(qid="b.qid", stem="b.stem").replace("stem_image", "a.stem_image").replace("p_brand", "a.p_brand").replace("p_type", "a.p_type").replace("b_image", "a.b_image")} AS hash2,
        coalesce(v1.verdict, 'UNVERIFIED') AS status1, v1.k IS NOT NULL AS has1, v2.k IS NOT NULL AS has2, coalesce(v1.stale, false) AS stale, coalesce(v2.third, false) AS third,
        CASE WHEN a.changed THEN coalesce(v1.verdict, 'UNVERIFIED') WHEN v1.verdict = 'KEY_CONFIRMED_REVIEW' THEN v1.verdict WHEN v2.k IS NOT NULL THEN v2.verdict ELSE 'UNVERIFIED' END AS status_of_1
    FROM ({I.QUESTIONS[1]}) a JOIN ({I.QUESTIONS[2]}) b ON a.k = b.k LEFT JOIN ({I.VERDICTS[1]}) v1 ON a.k = v1.k LEFT JOIN ({I.VERDICTS[2]}) v2 ON a.k = v2.k WHERE a.section <> 'GA'
"""
_CURRENT = f"SELECT *, CASE WHEN changed THEN 2 ELSE 1 END AS version, CASE WHEN changed THEN hash2 ELSE hash1 END AS content_hash, CASE WHEN changed THEN 'UNVERIFIED' ELSE status_of_1 END AS key_status, CASE WHEN changed THEN stem2 ELSE stem END AS stem_text FROM ({_FINAL})"
_MOCKS = f"SELECT mock_id AS id, any_value(paper_id) AS paper_id, any_value(section) AS section, 900 AS timer_sec, CASE WHEN count(*) = 25 AND bool_and(status <> 'REJECTED' AND key_status LIKE 'KEY_CONFIRMED%') THEN 'PUBLISHED' ELSE 'DRAFT' END AS status, count(*) = 25 AND bool_and(status <> 'REJECTED' AND status1 LIKE 'KEY_CONFIRMED%') AS before FROM ({_CURRENT}) GROUP BY mock_id"
_PAPERS = f"SELECT a.date AS d, a.time_slot, substr(a.date, 7, 4) || '-' || substr(a.date, 4, 2) || '-' || substr(a.date, 1, 2) || '_' || a.time_slot AS id, CASE WHEN b.accepted THEN b.key_status ELSE a.key_status END AS key_status, b.accepted AND b.key_status <> a.key_status AS updated FROM ({I.SOURCES[1]}) a JOIN ({I.SOURCES[2]}) b ON a.sha256 = b.sha256 WHERE a.accepted"
_URL = lambda c: f"CASE WHEN {c} <> '' THEN '/assets/' || regexp_replace({c}, '^{S.ASSET_PREFIX}', '') END"


@query(f"WITH m AS ({_MOCKS}) SELECT id, strptime(d, '%d.%m.%Y')::DATE AS exam_date, time_slot, key_status, coalesce((SELECT string_agg(section || ' ' || m.id || ' ' || timer_sec || ' ' || status, ',' ORDER BY section) FROM m WHERE m.paper_id = p.id), '') AS mocks FROM ({_PAPERS}) p")
def bank_papers(spark, d):
    return serve.papers(_bank(spark, d)).withColumn("mocks", joined(F.transform("mocks", lambda m: F.concat_ws(" ", m["section"], m["id"], m["timer_sec"].cast("string"), m["status"]))))


@query(f"SELECT id, paper_id, section, timer_sec, status FROM ({_MOCKS}) WHERE section = 'QUANT'")
def bank_mocks(spark, d):
    return serve.mocks(_bank(spark, d), "quant", "")


@query(f"SELECT id, section FROM ({_MOCKS}) WHERE status = 'PUBLISHED'")
def bank_published(spark, d):
    return serve.mocks(_bank(spark, d), None, "published").select("id", "section")


@query(f"SELECT id, section, paper_id[:10] || ' ' || paper_id[12:13] || ':' || paper_id[14:15] AS shift, CASE status WHEN 'PUBLISHED' THEN 'Ready' ELSE 'Answers being verified' END AS label FROM ({_MOCKS})")
def bank_home(spark, d):
    return serve.home(_bank(spark, d))[0]


@query(f"SELECT section, CAST(count_if(status = 'PUBLISHED') AS BIGINT) AS ready, count(*) AS total FROM ({_MOCKS}) GROUP BY section")
def bank_totals(spark, d):
    return serve.home(_bank(spark, d))[1]


@query("SELECT section, 25 AS questions, CAST(2 AS DOUBLE) AS marks_correct, CAST(0.5 AS DOUBLE) AS marks_wrong, 900 AS default_timer_sec FROM (VALUES ('QUANT'), ('REASONING')) v(section)")
def bank_pattern(spark, d):
    return serve.exam_pattern(_bank(spark, d))


@query(f"SELECT count(*) AS questions FROM ({_FINAL})")
def bank_health(spark, d):
    return serve.health(_bank(spark, d))


@query(f"SELECT mock_id, q_no, qid2 AS ssc_question_id, status, version, content_hash, key_status FROM ({_CURRENT})")
def bank_questions(spark, d):
    """Slots with the versions that their pointers lead to."""
    b = _bank(spark, d)
    v = b["question_versions"].select(F.col("id").alias("current_version_id"), "version", "content_hash", "key_status")
    return b["questions"].join(v, "current_version_id", "left").select("mock_id", "q_no", "ssc_question_id", "status", "version", "content_hash", "key_status")


@query(f"""SELECT mock_id, q_no, '1 ' || hash1 || ' ' || coalesce(answer, '-') || ' ' || status_of_1 || ' ' || (1 + (stem_image <> '' AND stem_image IS NOT NULL)::INT + (b_image IS NOT NULL)::INT) || CASE WHEN changed THEN ',2 ' || hash2 || ' ' || coalesce(answer, '-') || ' UNVERIFIED ' || (1 + (stem_image <> '' AND stem_image IS NOT NULL)::INT + (b_image IS NOT NULL)::INT) ELSE '' END AS versions FROM ({_FINAL})""")
def bank_versions(spark, d):
    b = _bank(spark, d)
    each = F.transform("versions", lambda v: F.concat_ws(" ", v["version"].cast("string"), v["content_hash"], F.coalesce(v["official_answer"], F.lit("-")), v["key_status"], F.size(v["assets"]).cast("string")))
    return serve.question_versions(b).join(b["questions"].select(F.col("id").alias("question_id"), "mock_id", "q_no"), "question_id").select("mock_id", "q_no", joined(each).alias("versions"))


@query(f"SELECT mock_id, q_no, version, CASE WHEN changed AND version = 1 THEN topic ELSE topic2 END AS topic, p_brand AS subtopic FROM (SELECT *, unnest(CASE WHEN changed THEN [1, 2] ELSE [1] END) AS version FROM ({_FINAL}))")
def bank_topics(spark, d):
    b = _bank(spark, d)
    return b["question_versions"].join(b["questions"].select(F.col("id").alias("question_id"), "mock_id", "q_no"), "question_id").select("mock_id", "q_no", "version", "topic", "subtopic")


@query(f"""WITH v AS (SELECT *, unnest(CASE WHEN changed THEN [1, 2] ELSE [1] END) AS version FROM ({_FINAL}))
    SELECT mock_id, q_no, version, 'review_crop' AS kind, crop AS path, true AS shows_answer FROM v UNION ALL SELECT mock_id, q_no, version, 'stem', stem_image, false FROM v WHERE stem_image <> '' UNION ALL SELECT mock_id, q_no, version, 'option_B', b_image, false FROM v WHERE b_image IS NOT NULL""")
def bank_assets(spark, d):
    b = _bank(spark, d)
    v = b["question_versions"].select(F.col("id").alias("question_version_id"), "question_id", "version").join(b["questions"].select(F.col("id").alias("question_id"), "mock_id", "q_no"), "question_id")
    return b["question_assets"].join(v, "question_version_id").select("mock_id", "q_no", "version", "kind", "path", "shows_answer")


@query(f"""SELECT mock_id, q_no, 1 AS version, solver_id, solver_answer, steps, valid FROM (SELECT *, answer AS solver_answer, 'a' AS solver_id, 'one,two' AS steps, true AS valid FROM ({_FINAL}) WHERE has1
    UNION ALL SELECT *, answer, 'b', '', false FROM ({_FINAL}) WHERE has1 AND NOT stale UNION ALL SELECT *, answer, 'c', '', true FROM ({_FINAL}) WHERE has2 AND third)""")
def bank_runs(spark, d):
    """Runs lie at the version they solved; those of an unknown version aren't there."""
    b = _bank(spark, d)
    v = b["question_versions"].select(F.col("id").alias("question_version_id"), "question_id", "version").join(b["questions"].select(F.col("id").alias("question_id"), "mock_id", "q_no"), "question_id")
    return b["answer_verifications"].join(v, "question_version_id").select("mock_id", "q_no", "version", "solver_id", "solver_answer", joined(F.col("steps")).alias("steps"), "valid")


@query(f"""SELECT paper_id, section, q_no, 'solver' AS source, 'KEY_DISPUTED' AS reasons, 'OPEN' AS status, true AS known FROM ({_FINAL}) WHERE has1 AND status1 = 'KEY_DISPUTED'
    UNION ALL SELECT paper_id, section, q_no, 'extract', reason, 'OPEN', q_no <> 99 FROM ({I.REVIEWS[2]}) WHERE section <> 'GA'""")
def bank_reviews(spark, d):
    return serve.review_queue(_bank(spark, d)).select("paper_id", "section", "q_no", "source", joined(F.col("reasons")).alias("reasons"), "status", F.col("question_id").isNotNull().alias("known"))


@query(f"""WITH q AS MATERIALIZED ({_FINAL}), m AS MATERIALIZED ({_MOCKS}), r AS (
    SELECT 'papers updated' AS change, (SELECT count(*) FROM ({_PAPERS}) WHERE updated) AS n UNION ALL SELECT 'questions updated', (SELECT count(*) FROM q WHERE qid <> qid2) UNION ALL SELECT 'question versions added', (SELECT count(*) FROM q WHERE changed)
    UNION ALL SELECT 'assets added', (SELECT CAST(sum(1 + coalesce(stem_image <> '', false)::INT + (b_image IS NOT NULL)::INT) AS BIGINT) FROM q WHERE changed) UNION ALL SELECT 'topic tags updated', (SELECT count(*) FROM q WHERE topic <> topic2 AND NOT changed) UNION ALL SELECT 'current versions moved', (SELECT count(*) FROM q WHERE changed)
    UNION ALL SELECT 'stale solver runs skipped', (SELECT count(*) FROM q WHERE has2 AND stale) UNION ALL SELECT 'solver runs added', (SELECT count(*) FROM q WHERE has2 AND third) UNION ALL SELECT 'key statuses set', (SELECT count(*) FROM q WHERE has2 AND NOT changed AND status_of_1 <> status1)
    UNION ALL SELECT 'key statuses withdrawn', (SELECT count(*) FROM q WHERE has1 AND NOT has2 AND NOT changed AND status1 <> 'KEY_CONFIRMED_REVIEW') UNION ALL SELECT 'review items updated', (SELECT count(*) FROM ({I.REVIEWS[2]}) WHERE section <> 'GA' AND reason <> 'crop')
    UNION ALL SELECT 'mocks set ' || s, (SELECT count(*) FROM m WHERE status = s AND before <> (status = 'PUBLISHED')) FROM (VALUES ('DRAFT'), ('PUBLISHED')) v(s)) SELECT * FROM r WHERE n > 0""")
def bank_report(spark, d):
    """What the second load changed."""
    return _loaded(spark, d)[1]


_ONE = "2000-01-02_1600"


@query(f"SELECT q_no, stem_text, true AS stem_text_complete, {_URL('stem_image')} AS stem_image_url, 'A ' || p_brand || ' -,B ' || p_type || ' ' || coalesce('/assets/' || b_image, '-') AS options, false AS has_visual FROM ({_CURRENT}) WHERE mock_id = '{_ONE}_REASONING'")
def bank_public(spark, d):
    """What a test-taker sees of a published mock."""
    q = serve.mock_questions(_bank(spark, d), f"{_ONE}_REASONING").drop("id", "version_id")
    return q.withColumn("options", joined(F.transform("options", lambda o: F.concat_ws(" ", o["label"], o["text"], F.coalesce(o["image_url"], F.lit("-"))))))


@query(f"""SELECT q_no, stem_text, qid2 AS ssc_question_id, status, version, answer AS official_answer, key_status, {_URL("crop")} AS review_crop_url, 1 AS source_page, topic2 AS topic, p_brand AS subtopic,
    CASE WHEN changed THEN '' ELSE concat_ws(',', CASE WHEN has1 THEN 'a p1 ' || coalesce(answer, '-') || ' one/two' END, CASE WHEN has1 AND NOT stale THEN 'b p1 ' || coalesce(answer, '-') || ' ' END, CASE WHEN third THEN 'c p1 ' || coalesce(answer, '-') || ' ' END) END AS verifications FROM ({_CURRENT}) WHERE mock_id = '{_ONE}_QUANT'""")
def bank_admin(spark, d):
    """What an editor sees of a mock that isn't published."""
    runs = F.transform("verifications", lambda v: F.concat_ws(" ", v["solver_id"], v["prompt_version"], F.coalesce(v["solver_answer"], F.lit("-")), F.concat_ws("/", v["steps"])))
    rows = serve.admin_mock_questions(_bank(spark, d), f"{_ONE}_QUANT").withColumn("verifications", joined(runs))
    return rows.select("q_no", "stem_text", "ssc_question_id", "status", "version", "official_answer", "key_status", "review_crop_url", "source_page", "topic", "subtopic", "verifications")


@query(f"SELECT q_no, key_status FROM ({_CURRENT}) WHERE mock_id = '{_ONE}_QUANT' AND q_no = 8")
def bank_question(spark, d):
    one = spark.range(1).select(load.question_id(F.lit(f"{_ONE}_QUANT"), F.lit(8))).head()[0]
    return serve.admin_question(_bank(spark, d), one).select("q_no", "key_status")


@query(f"""WITH q AS MATERIALIZED ({_CURRENT}), r AS (
    SELECT 'foreign key mocks(paper_id)' AS rule, (SELECT count(*) FROM ({_MOCKS}) m JOIN ({_PAPERS}) p ON m.paper_id = p.id WHERE p.time_slot = '1600') AS n UNION ALL SELECT 'foreign key review_queue(paper_id)', (SELECT count(*) FROM (SELECT paper_id FROM q WHERE has1 AND status1 = 'KEY_DISPUTED' UNION ALL SELECT paper_id FROM ({I.REVIEWS[2]}) WHERE section <> 'GA') WHERE paper_id LIKE '%_1600')
    UNION ALL SELECT 'not null questions', (SELECT count(*) FROM q WHERE q_no = 3) UNION ALL SELECT 'check mocks: section in (''QUANT'', ''REASONING'')', (SELECT count(*) FROM ({_MOCKS}) WHERE status = 'DRAFT') UNION ALL SELECT 'unique mocks(paper_id, section)', (SELECT count(*) FROM (SELECT paper_id FROM ({_MOCKS}) WHERE status = 'DRAFT' GROUP BY 1 HAVING count(*) > 1))
    UNION ALL SELECT 'length question_versions(official_answer)', (SELECT CAST(sum(version) AS BIGINT) FROM q WHERE answer = 'A')) SELECT * FROM r WHERE n > 0""")
def bank_violations(spark, d):
    """The bank with faults put in: papers taken away, statuses nulled, sections of drafts renamed, answers lengthened."""
    b = _bank(spark, d)
    bad = dict(b, papers=b["papers"].where("time_slot <> '1600'"), questions=b["questions"].withColumn("status", F.when(F.col("q_no") != 3, F.col("status"))))
    bad["mocks"] = b["mocks"].withColumn("section", F.when(F.col("status") == "DRAFT", "ODD").otherwise(F.col("section")))
    bad["question_versions"] = b["question_versions"].withColumn("official_answer", F.when(F.col("official_answer") == "A", "AA").otherwise(F.col("official_answer")))
    return quality.violations(bad)


#: A third load with faults: papers that share a hash or lack a path, questions of papers that aren't there, without a stem, or with a long answer.
_BAD_SOURCES = f"SELECT date, time_slot, filename, CASE WHEN n % 3 = 0 THEN sha256 ELSE repeat('7', 64) END AS sha256, 'late' AS key_status, accepted, CASE WHEN n % 3 <> 0 THEN stored_path END AS stored_path, n FROM (SELECT *, CAST(replace(replace(filename, 'sheet ', ''), '.pdf', '') AS BIGINT) AS n FROM ({I.SOURCES[1]}) WHERE accepted)"
_BAD_QUESTIONS = f"SELECT k, n, idx, CASE WHEN idx = 3 THEN 'none-' || CAST(n AS STRING) ELSE paper_id END AS paper_id, section, q_no, qid, CASE WHEN idx <> 4 THEN stem END AS stem, CASE WHEN idx = 5 THEN 'ABC' ELSE answer END AS answer, crop, status, p_brand FROM ({I.QUESTIONS[1]}) WHERE idx IN (3, 4, 5)"


@query(f"""SELECT 'unique papers(sha256)' AS rule, 'papers' AS "table", '{{"sha256":"' || sha256 || '"}}' AS what FROM ({_BAD_SOURCES}) GROUP BY sha256 HAVING count(*) > 1
    UNION ALL SELECT 'not null papers(stored_path)', 'papers', '{{"id":"' || strftime(strptime(date, '%d.%m.%Y'), '%Y-%m-%d') || '_' || time_slot || '"}}' FROM ({_BAD_SOURCES}) WHERE stored_path IS NULL
    UNION ALL SELECT 'foreign key mocks(paper_id)', 'mocks', '{{"id":"' || paper_id || '_QUANT","paper_id":"' || paper_id || '"}}' FROM ({_BAD_QUESTIONS}) WHERE idx = 3
    UNION ALL SELECT 'not null question_versions(stem_text)', 'question_versions', paper_id || '_QUANT ' || q_no FROM ({_BAD_QUESTIONS}) WHERE idx = 4 UNION ALL SELECT 'length question_versions(official_answer)', 'question_versions', paper_id || '_QUANT ' || q_no FROM ({_BAD_QUESTIONS}) WHERE idx = 5""")
def bank_refused(spark, d):
    """What of a load with faults the bank refuses; versions by mock and number."""
    at = _loaded(spark, d)[0]
    pointer = snapshot.pointer(spark, at, snapshot.version(spark, at))
    state = load.State(snapshot.read(spark, at, parts=True), pointer.parts)
    load.load_papers(state, I.rows(spark, d, _BAD_SOURCES).withColumn("ord", F.col("n")))
    none = F.lit(None).cast("string")
    options = F.array(F.struct(F.lit("A").alias("label"), F.col("p_brand").alias("text"), none.alias("image")))
    more = {c: none for c in ("stem_image", "answer_text_layer", "answer_page_image", "topic", "subtopic", "topic_source")} | {"option_ids": F.lit(None).cast("map<string,string>"), "source_bbox": F.lit(None).cast(schemas.BOXES)}
    records = I.rows(spark, d, _BAD_QUESTIONS).withColumnsRenamed({"qid": "ssc_question_id", "stem": "stem_text", "answer": "official_answer", "crop": "question_crop"})
    records = records.withColumns({**more, "options": options, "stem_text_complete": F.lit(True), "key_status": F.lit("UNVERIFIED"), "has_visual": F.lit(False), "source_page": F.lit(1), "ord": F.col("k")})
    load.load_questions(state, records)
    try:
        quality.require(state, snapshot.affected(state.deltas))
        found = quality.refused(state)
    except quality.Refused as e:
        assert len(e.rules) == 5, e.rules
        found = e.found
    found = found.withColumn("version", F.when(F.col("table") == "question_versions", F.get_json_object("row", "$.id").cast("long")))
    names = state["question_versions"].select(F.col("id").alias("version"), "question_id").join(by_key(state["questions"].select(F.col("id").alias("question_id"), "mock_id", "q_no")), "question_id")
    return found.join(by_key(names), "version", "left").select("rule", "table", F.coalesce(F.concat(F.col("mock_id"), F.lit(" "), F.col("q_no").cast("string")), F.col("row")).alias("what"))


def _with_date(tables):
    of = tables["papers"].select(F.col("id").alias("paper_id"), F.col("exam_date").alias("held"))
    return {"mocks": tables["mocks"].join(of, "paper_id", "left")}


def _seconds_to_minutes(tables):
    return {"mocks": tables["mocks"].withColumn("timer_min", (F.col("timer_sec") / 60).cast("int")).drop("timer_sec")}


#: Two steps beyond the declared tables: mocks learn their paper's date, and their timers are in minutes.
_STEPS = [
    migrations.Step("dates of mocks", _with_date, lambda tables: {"mocks": tables["mocks"].drop("held")}),
    migrations.Step("timers in minutes", _seconds_to_minutes, lambda tables: {"mocks": tables["mocks"].withColumn("timer_sec", F.col("timer_min") * 60).drop("timer_min")}),
]


@query(f"SELECT m.id, m.paper_id, m.section, m.status, 15 AS timer_min, strptime(p.d, '%d.%m.%Y')::DATE AS held FROM ({_MOCKS}) m LEFT JOIN ({_PAPERS}) p ON m.paper_id = p.id")
def bank_migrated(spark, d):
    """Mocks after two migrations, taken, taken back and taken again on a bank of its own."""
    bank, root = _bank(spark, d), f"{scratch.scratch_dir(spark)}/migrated-{uuid.uuid4().hex}"
    snapshot.write(spark, root, {t: bank[t] for t in ("papers", "mocks")}, parts=4)
    for to, taken in ((2, 2), (0, 2), (None, 2), (2, 0)):
        assert len(migrations.migrate(spark, root, _STEPS, to)) == taken
    return snapshot.stored(spark, root, snapshot.version(spark, root))["mocks"].drop("part")


@query(f"""WITH v AS (SELECT k % 7 AS file, k AS line, mock_id, q_no, CASE WHEN k % 3 = 0 THEN 'KEY_DISPUTED' ELSE verdict END AS status FROM ({I.VERDICTS[1]}) UNION ALL SELECT (k + 3) % 7, k + 1000000, mock_id, q_no, verdict FROM ({I.VERDICTS[2]})),
    n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line) AS place, row_number() OVER (PARTITION BY mock_id, q_no ORDER BY file DESC, line DESC) AS latest FROM v)
    SELECT mock_id, q_no, status, file, place FROM n WHERE latest = 1""")
def bank_record_order(spark, d):
    """The last record of each question over seven files of lines, in the order of paths and lines, and its line number."""
    root = f"{scratch.scratch_dir(spark)}/lines-{uuid.uuid4().hex}"
    one = I.rows(spark, d, I.VERDICTS[1]).select((F.col("k") % 7).alias("file"), F.col("k").alias("line"), "mock_id", "q_no", F.when(F.col("k") % 3 == 0, "KEY_DISPUTED").otherwise(F.col("verdict")).alias("status"))
    two = I.rows(spark, d, I.VERDICTS[2]).select(((F.col("k") + 3) % 7).alias("file"), (F.col("k") + 1000000).alias("line"), "mock_id", "q_no", F.col("verdict").alias("status"))
    # each file's lines in order: a file is written by one task here, as its writer would
    one.union(two).repartition("file").sortWithinPartitions("file", "line").select("file", "mock_id", "q_no", "status").write.partitionBy("file").json(root)
    rows = readers.numbered_lines(spark, f"{root}/file=*", "mock_id string, q_no int, status string")
    rows = rows.withColumn("file", F.regexp_extract("path", "file=([0-9]+)", 1).cast("long"))
    return last_by(rows.withColumn("ord", F.struct("path", "place")), ["mock_id", "q_no"], ["status", "file", "place"])


@query("SELECT 'No changes.' AS line")
def bank_reload(spark, d):
    """A load that is run again changes nothing, whatever stale runs it meets."""
    root, _ = _loaded(spark, d)
    state = load.load_all(load.State(snapshot.read(spark, root)), load.read_inputs(spark, f"{root[: -len('/bank')]}/input-2"))
    return spark.range(1).select(F.lit(report.text(state.report(spark))).alias("line"))
