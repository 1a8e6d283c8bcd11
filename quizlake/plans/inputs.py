"""Sheets and question records made of the driver's tables, by SQL that Spark and DuckDB read alike.

A supplier is a sheet of four sections with 25 questions each; its key says what is wrong with it. A part is a question of a
paper: 25 each of three sections. Records come twice, the second time with corrections.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions import scalars as S


def for_spark(sql: str) -> str:
    """EACH(a, b): a row for each whole number from a to below b."""
    return re.sub(r"EACH\((-?\d+), (\d+)\)", lambda m: f"explode(sequence({m[1]}L, {int(m[2]) - 1}L))", sql)


def for_duckdb(sql: str) -> str:
    return re.sub(r"EACH\((-?\d+), (\d+)\)", r"unnest(range(\1, \2))", sql).replace("{supplier}", "supplier").replace("{part}", "part")


SHEETS = """
    SELECT k, dd, yyyy, h, mer, lpad(CAST(k - CASE WHEN k % 15 = 1 THEN 1 ELSE 0 END AS STRING), 64, '0') AS sha256,
        CASE WHEN k % 11 = 5 THEN 'odd-' || CAST(k AS STRING) || '.pdf' ELSE 'English_' || dd || '.09.' || yyyy || '_' || h || '.30-' || mer || '-2.00-' || mer || CASE WHEN k % 6 = 4 THEN ' (1)' ELSE '' END || '.pdf' END AS file
    FROM (SELECT s_suppkey AS k, lpad(CAST(1 + s_suppkey % 28 AS STRING), 2, '0') AS dd, CAST(1000 + CAST(floor(s_suppkey / 168) AS BIGINT) AS STRING) AS yyyy, CAST(1 + s_suppkey % 12 AS STRING) AS h, CASE WHEN s_suppkey % 24 < 12 THEN 'AM' ELSE 'PM' END AS mer FROM {supplier})
"""

DOCS = f"SELECT file, sha256, 5 AS page_count, CASE WHEN k % 4 = 0 THEN NULL ELSE ' Word ' || chr(160) END AS producer, CASE WHEN k % 23 = 8 THEN 2 ELSE 0 END AS annotations FROM ({SHEETS})"

PAGES = f"""
    SELECT file, CAST(p AS INT) AS page_no, CASE WHEN p = 4 THEN chr(160) || 'ad ' || chr(10) WHEN p > 0 THEN 'page of questions without any advert, number ' || CAST(p AS STRING)
        ELSE CASE WHEN k % 19 = 7 THEN 'Other paper' ELSE '{S.HEADER}' END || chr(160) || 'Exam Date ' || dd || '/09/' || yyyy || ' Exam Time' || chr(160) || h || ':' || CASE WHEN k % 21 = 3 THEN '45' ELSE '30' END || ' ' || mer
            || repeat(' Option 1 ID : 12', 400 - CASE WHEN k % 18 = 10 THEN 100 ELSE 0 END) || repeat(' Status : x', 100 - CASE WHEN k % 16 = 9 THEN 1 ELSE 0 END) || repeat(' Chosen Option : 1', 100) END AS text
    FROM (SELECT *, EACH(0, 5) AS p FROM ({SHEETS}))
"""

_NAMES = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(S.SECTION_CODES))

SPANS = f"""
    SELECT file, CAST(s AS INT) AS page_no, CAST(4 * (q + 1) + l AS INT) AS line_no, CAST(p AS INT) AS span_no,
        CASE WHEN q < 0 AND l = 0 THEN 'Section :' || chr(160) || CASE WHEN s = 3 AND k % 13 = 5 THEN 'Odd Part' ELSE CASE s {_NAMES} END END || ' ' WHEN q < 0 THEN 'Question ID : 630680400000' WHEN l = 0 THEN 'Q.' || CAST(q + 1 AS STRING) || ' stem'
            WHEN l = 1 THEN CASE WHEN k % 2 = 0 THEN chr(160) ELSE ' ' END || '1. answer' WHEN l = 2 THEN '2. other' WHEN p = 0 THEN 'Question ID'
            ELSE ' : ' || CASE WHEN k % 17 = 6 AND q = 0 THEN '77' ELSE CAST(630000000000 + 100 * k + 25 * s + q AS STRING) END END AS text,
        CASE WHEN l = 1 AND q >= 0 THEN 65280 WHEN l = 2 THEN 16711680 ELSE 0 END AS color, CAST(10 + p AS DOUBLE) AS span_x0, y AS span_y0, CAST(10 AS DOUBLE) AS line_x0, y AS line_y0, CAST(CASE WHEN l = 3 AND k % 8 = 2 AND s = 1 AND q = 3 THEN 600 ELSE 500 END AS DOUBLE) AS line_x1
    FROM (SELECT *, CAST(CASE WHEN q < 0 AND l = 1 THEN -1 ELSE 4 * (q + 1) + l END AS DOUBLE) AS y FROM (SELECT *, EACH(0, 2) AS p FROM (SELECT *, EACH(0, 4) AS l FROM (SELECT *, EACH(-1, 25) AS q FROM (SELECT *, EACH(0, 4) AS s FROM ({SHEETS}))))))
    WHERE (p = 0 OR (l = 3 AND q >= 0)) AND (q >= 0 OR l = 0 OR (l = 1 AND s = 0 AND k % 10 = 1)) AND NOT (s = 1 AND k % 29 = 7)
        AND NOT (l = 0 AND q = 4 AND s = 2 AND k % 7 = 3) AND NOT (l = 1 AND q = 24 AND s = 2 AND k % 9 = 4) AND NOT (l = 3 AND q = 7 AND s = 1 AND k % 14 = 9)
"""


def _questions(load: int) -> str:
    """k, n (paper), idx (in the paper) and the flat fields of every part's record in the first or second load."""
    return f"""
    SELECT *, CASE WHEN ({load} = 2) AND changed THEN stem_0 || ' (corrected)' ELSE stem_0 END AS stem, CASE WHEN ({load} = 2) AND n % 6 = 5 AND idx = 3 THEN 'X' || CAST(k AS STRING) ELSE CAST(k AS STRING) END AS qid, CASE WHEN ({load} = 2) AND n % 4 = 1 THEN p_type || '!' ELSE p_type END AS topic,
        paper_id || '_' || section AS mock_id
    FROM (SELECT *, n % 3 = 0 AND idx % 10 = 2 OR n % 6 = 5 AND idx = 3 AS changed, yyyy || '-' || mm || '-' || dd || '_' || slot AS paper_id, dd || '.' || mm || '.' || yyyy AS date_text, CASE WHEN idx < 25 THEN 'QUANT' WHEN idx < 50 THEN 'REASONING' ELSE 'GA' END AS section, CAST(1 + idx % 25 AS INT) AS q_no,
            p_name || CASE WHEN k % 10 = 0 THEN ' "é' || chr(9) || chr(92) ELSE '' END AS stem_0, CASE WHEN k % 12 = 5 THEN 'data/questions/assets/' || CAST(k AS STRING) || '/stem.png' WHEN k % 12 = 6 THEN '' END AS stem_image, CASE WHEN k % 9 = 2 THEN 'other/' || CAST(k AS STRING) || '.png' END AS b_image,
            CASE p_size % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' END AS answer, 'data/questions/assets/' || CAST(k AS STRING) || '/crop.png' AS crop, CASE WHEN n % 8 = 6 AND idx = 30 THEN 'REJECTED' ELSE 'EXTRACTED' END AS status
        FROM (SELECT *, lpad(CAST(1 + n % 28 AS STRING), 2, '0') AS dd, lpad(CAST(1 + CAST(floor(n / 28) AS BIGINT) % 12 AS STRING), 2, '0') AS mm, CAST(2000 + CAST(floor(n / 336) AS BIGINT) AS STRING) AS yyyy, CASE WHEN n % 2 = 0 THEN '0900' ELSE '1600' END AS slot
            FROM (SELECT p_partkey AS k, CAST(floor(p_partkey / 75) AS BIGINT) AS n, p_partkey % 75 AS idx, p_name, p_brand, p_type, p_size FROM {{part}})))
"""


QUESTIONS = {load: _questions(load) for load in (1, 2)}

#: Of each load the verdicts: which there are, what they say, and which solvers ran.
VERDICTS = {
    1: f"SELECT *, CASE WHEN n % 4 = 1 AND idx = 7 THEN 'KEY_DISPUTED' WHEN n % 5 IN (2, 3) AND idx = 11 THEN 'KEY_CONFIRMED_REVIEW' ELSE 'KEY_CONFIRMED_DUAL' END AS verdict, k % 13 = 4 AS stale, false AS third FROM ({QUESTIONS[1]}) WHERE n % 9 <> 8",
    2: f"SELECT *, CASE WHEN n % 4 = 1 AND idx = 7 THEN 'KEY_DISPUTED' WHEN n % 6 = 1 AND idx = 5 THEN 'KEY_CONFIRMED_CODE' ELSE 'KEY_CONFIRMED_DUAL' END AS verdict, k % 13 = 4 AS stale, n % 2 = 1 AS third FROM ({QUESTIONS[1]}) WHERE n % 9 <> 8 AND n % 5 <> 3",
}

#: Of each load a source for each paper, and a rejected one.
SOURCES = {
    load: f"SELECT date_text AS date, CASE WHEN idx = 0 THEN slot ELSE '2300' END AS time_slot, 'sheet ' || CAST(n AS STRING) || CASE WHEN idx = 0 THEN '' ELSE ' (1)' END || '.pdf' AS filename, lpad(CAST(k AS STRING), 64, '0') AS sha256, CASE WHEN ({load} = 2) AND n % 3 = 0 THEN 'final' ELSE 'unknown' END AS key_status, "
    f"idx = 0 AND NOT (({load} = 2) AND n % 7 = 3) AS accepted, 'data/raw/' || CAST(n AS STRING) || '.pdf' AS stored_path FROM ({QUESTIONS[load]}) WHERE idx < 2"
    for load in (1, 2)
}

#: Of each load the review items of the extract; some are for questions that don't exist.
REVIEWS = {
    load: f"SELECT paper_id, section, CASE WHEN k % 194 = 0 THEN CAST(99 AS INT) ELSE q_no END AS q_no, CASE WHEN ({load} = 2) AND n % 2 = 0 THEN 'crop,again' ELSE 'crop' END AS reason FROM ({QUESTIONS[load]}) WHERE k % 97 = 0" for load in (1, 2)
}


#: A supplier's row becomes some 600 of spans and pages, so tasks share the suppliers and not their bytes: beyond so many in all, and
#: so many to a task at most, as each task of a shuffle writes a piece for each of the next.
SUPPLIERS_OF_ONE_TASK = 500
SUPPLIERS_PER_TASK = 2000


def _dealt(df: DataFrame) -> DataFrame:
    """The suppliers over as many tasks as there are cores, and more where there are many; a file of them is one split."""
    n = df.count()  # of the files' footers
    return df if n <= SUPPLIERS_OF_ONE_TASK else df.repartition(max(-(-n // SUPPLIERS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism), F.col("s_suppkey"))


def rows(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """The rows of one of the texts above over the tables in folder d."""
    tables = {name: spark.read.parquet(f"{d}/{name}.parquet") for name in ("supplier", "part") if "{" + name + "}" in sql}
    if "supplier" in tables:
        tables["supplier"] = _dealt(tables["supplier"].select("s_suppkey"))
    return spark.sql(for_spark(sql), **tables)
