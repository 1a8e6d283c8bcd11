"""The engine's operators over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.functions import scalars as S
from quizlake.operators import intake, load, merge, quality, report, serve
from quizlake.sources import scratch
from quizlake.streaming import verdicts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def n(c: str | None = None):
    return F.count(c or "*")


def _slices(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    old = o.where("o_orderkey % 3 <> 0")
    new = o.where("o_orderkey % 4 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return old, new


_UPSERT = """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders), a AS (SELECT * FROM o WHERE o_orderkey % 3 <> 0),
    b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM o WHERE o_orderkey % 4 <> 0)
    SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, coalesce(b.o_orderpriority, a.o_orderpriority) AS o_orderpriority,
           CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NOT NULL AND (a.o_orderstatus <> b.o_orderstatus OR a.o_orderpriority <> b.o_orderpriority) THEN 'updated' END AS change
    FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey"""


@query(_UPSERT)
def upsert_diff(spark, d):
    old, new = _slices(spark, d)
    return merge.upsert(old, new, ["o_orderkey"], ["o_orderstatus", "o_orderpriority"])


@query(f"SELECT change, count(*) AS n FROM ({_UPSERT}) WHERE change IS NOT NULL GROUP BY change")
def change_report(spark, d):
    out = upsert_diff(spark, d)
    return report.total([report.counted(out.where(F.col("change") == c), c) for c in ("added", "updated")])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 3 = 0")
def insert_if_absent(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    old = o.where("o_orderkey % 3 <> 0")
    return old.unionByName(merge.insert_if_absent(old, o.withColumn("o_orderstatus", F.lit("N")), ["o_orderkey"]))


@query("SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'purchase' ELSE max_by(event_type, row(ts, event_id)) END AS status FROM events GROUP BY user_id")
def sticky_status(spark, d):
    g = t(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("all"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return g.select("user_id", merge.sticky(F.lit(None).cast("string"), "purchase", F.col("all"), F.col("last")).alias("status"))


@query("SELECT user_id, bool_or(event_type = 'purchase') AS held, max_by(event_type, row(ts, event_id)) AS last, max_by(event_type, row(ts, event_id)) FILTER (WHERE event_type NOT IN ('click', 'purchase')) AS doubt FROM events GROUP BY user_id")
def stream_latest(spark, d):
    """The same state as a stream keeps it, over files that come in batches and out of order; of each key the last change is read."""
    root = f"{scratch.scratch_dir(spark)}/events-{uuid.uuid4().hex}"
    events = t(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    events.repartition(6, "event_id").write.parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    state = verdicts.latest(stream, ["user_id"], F.col("event_type"), F.struct("ts", "event_id"), "purchase", ["click", "purchase"])
    write = lambda rows, i: rows.write.mode("overwrite").parquet(f"{root}/out/batch={i}")
    state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    changes = spark.read.schema(f"user_id {events.schema['user_id'].dataType.simpleString()}, held boolean, last string, doubt string, batch long").parquet(f"{root}/out")
    return merge.last_by(changes, ["user_id"], ["held", "last", "doubt"], "batch")


@query("SELECT user_id, max_by(event_id, row(ts, event_id)) AS event_id, max_by(event_type, row(ts, event_id)) AS event_type FROM events GROUP BY user_id")
def last_wins(spark, d):
    return merge.last_by(t(spark, d, "events").withColumn("ord", F.struct("ts", "event_id")), ["user_id"], ["event_id", "event_type"])


@query("SELECT o_custkey, CAST(sum(greatest(0, 5 - n)) AS BIGINT) AS deficit FROM (SELECT o_custkey, o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) GROUP BY o_custkey")
def deficit_sum(spark, d):
    per = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(n().alias("n"))
    rows = t(spark, d, "orders").select("o_custkey", "o_orderkey").join(per, "o_orderkey", "left")
    return rows.groupBy("o_custkey").agg(F.sum(S.clamped(F.lit(5) - F.coalesce("n", F.lit(0)))).alias("deficit"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) || '…' AS digest FROM documents")
def hash_prefix(spark, d):
    return t(spark, d, "documents").select("doc_id", S.short_digest(S.file_digest(F.col("text").cast("binary"))).alias("digest"))


@query("SELECT doc_id, substr(sha256('[' || to_json(CAST(doc_id AS VARCHAR)) || ', ' || to_json(lang) || ', null, [[' || to_json(source) || ', null]]]'), 1, 16) AS content_hash FROM documents")
def content_hashes(spark, d):
    options = F.array(F.struct(F.lit("A").alias("label"), F.col("source").alias("text"), F.lit(None).cast("string").alias("image")))
    return t(spark, d, "documents").select("doc_id", S.content_hash(F.col("doc_id").cast("string"), F.col("lang"), F.lit(None).cast("string"), options).alias("content_hash"))


@query("SELECT event_id, ((c >> 8) & 255) > (c >> 16) + 40 AS is_green FROM (SELECT event_id, CAST((event_id * 7919) % 16777216 AS INTEGER) AS c FROM events)")
def color_bits(spark, d):
    return t(spark, d, "events").select("event_id", S.is_green(((F.col("event_id") * 7919) % 16777216).cast("int")).alias("is_green"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d_%H%M') AS paper_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def paper_key(spark, d):
    return t(spark, d, "events").select("event_id", S.paper_id(F.date_format("ts", "dd.MM.yyyy"), F.date_format("ts", "HHmm")).alias("paper_id"), F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT event_id, lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || strftime(ts, '%M') AS slot FROM events")
def hhmm_slot(spark, d):
    ts = F.col("ts")
    return t(spark, d, "events").select("event_id", S.to_hhmm(F.date_format(ts, "hh"), F.date_format(ts, "mm"), F.when(F.hour(ts) >= 12, "PM").otherwise("AM")).alias("slot"))


@query("SELECT n_nationkey, n_regionkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)")
def fk_check(spark, d):
    return quality.orphans(t(spark, d, "nation"), "n_regionkey", t(spark, d, "region"), "r_regionkey").select("n_nationkey", "n_regionkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def unique_check(spark, d):
    return quality.repeated(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O') OR length(o_orderpriority) > 8 OR o_custkey IS NULL")
def domain_checks(spark, d):
    o = t(spark, d, "orders")
    parts = [quality.broken(o, "o_orderstatus in ('F', 'O')"), quality.too_long(o, "o_orderpriority", 8), quality.nulls(o, ["o_custkey"])]
    return parts[0].union(parts[1]).union(parts[2]).select("o_orderkey").distinct()


@query("SELECT o_orderkey, count(l_orderkey) = 4 AND coalesce(bool_and(l_returnflag <> 'R'), true) AS ready FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def publishable_orders(spark, d):
    """The publish gate: orders as mocks that want four questions, lines as questions, return flags as versions with or without a confirmed key."""
    orders, lines = t(spark, d, "orders"), t(spark, d, "lineitem")
    bank = {
        "exam_pattern": orders.select(F.col("o_orderpriority").alias("section")).distinct().withColumn("questions", F.lit(4)), "mocks": orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("section")),
        "questions": lines.select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("mock_id"), F.lit("EXTRACTED").alias("status"), F.ascii("l_returnflag").alias("current_version_id")),
        "question_versions": spark.createDataFrame([(ord(x), "UNVERIFIED" if x == "R" else "KEY_CONFIRMED_DUAL") for x in "ANR"], "id int, key_status string"),
    }
    return load.publishable(bank).withColumnRenamed("id", "o_orderkey")


_DIGEST = "SELECT doc_id, sha256(text) AS digest, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS r, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS same_as FROM documents"


def _files(spark, d):
    """Documents as files whose names sort as their ids do."""
    return t(spark, d, "documents").select("doc_id", F.concat(F.lpad(F.col("doc_id").cast("string"), 18, "0"), F.lit(".pdf")).alias("name"), S.file_digest(F.col("text").cast("binary")).alias("sha256"))


@query(f"SELECT doc_id, digest FROM ({_DIGEST}) WHERE r = 1")
def dedup_first(spark, d):
    return intake.dedup_files(_files(spark, d))[0].select("doc_id", F.col("sha256").alias("digest"))


@query(f"SELECT doc_id, digest, same_as FROM ({_DIGEST}) WHERE r > 1")
def dedup_same_as(spark, d):
    number = lambda c: F.substring(c, 1, 18).cast("long")
    return intake.dedup_files(_files(spark, d))[1].select(number("filename").alias("doc_id"), F.col("sha256").alias("digest"), number("same_as").alias("same_as"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, string_split(url, '?')[1] AS base, contains(url, '?') AS is_copy FROM pages)
    SELECT host, page_id, is_copy FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY base, is_copy) AS r FROM p) WHERE r = 1""")
def original_first(spark, d):
    """Pages as files and hosts as contents: names before their copies."""
    u, copy = F.col("url"), F.contains("url", F.lit("?"))
    name = F.concat(F.split(u, r"\?")[0], F.when(copy, " (1)").otherwise(""), F.lit(".pdf"))
    files = t(spark, d, "pages").select(name.alias("name"), F.regexp_extract(u, "://([^/?#]*)", 1).alias("sha256"), "page_id")
    return intake.dedup_files(files)[0].select(F.col("sha256").alias("host"), "page_id", S.is_copy(F.col("name")).alias("is_copy"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS file, CAST(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS section FROM events")
def section_fill(spark, d):
    """Events of a user as a sheet in time order, signups as its section headers."""
    signup = F.col("event_type") == "signup"
    ev = t(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("file"), F.lit(0).alias("page_no"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("y0"), F.col("event_id").cast("double").alias("x0"), F.when(signup, "section").otherwise("label").alias("kind"), F.col("event_id").cast("string").alias("value"))
    return intake.with_section(ev).select("event_id", "file", "section")


@query("""WITH x AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 0 THEN 'GA' ELSE 'Other' END END AS head FROM conversations),
    y AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM x), z AS (SELECT conv_id, section, min(turn) AS p, count_if(role = 'assistant') AS n FROM y WHERE section IS NOT NULL GROUP BY 1, 2)
    SELECT CAST(conv_id AS VARCHAR) AS file, string_agg(section || '=' || n, ',' ORDER BY p) AS sections FROM z GROUP BY conv_id""")
def section_counts(spark, d):
    """Conversations as sheets: users' turns as headers, answers counted by section."""
    user = F.col("role") == "user"
    ev = t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file"), F.lit(0).alias("page_no"), F.col("turn").cast("double").alias("y0"), F.lit(0.0).alias("x0"), F.when(user, "section").otherwise("answer").alias("kind"), F.when(F.col("turn") % 4 == 0, "General Awareness").otherwise("Other").alias("value"), "role")
    ev = ev.where("role in ('user', 'assistant')").drop("role")
    out = intake.section_counts(intake.with_section(ev))
    return out.select("file", F.array_join(F.transform(F.map_entries("sections"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["questions"].cast("string"))), ",").alias("sections"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'KEY_CONFIRMED_REVIEW' WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'KEY_CONFIRMED_DUAL' ELSE 'UNVERIFIED' END AS key_status FROM documents")
def withdraw_anti(spark, d):
    """Verdicts of documents without a label are withdrawn, but for reviewed ones."""
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 7 == 0, "KEY_CONFIRMED_REVIEW").otherwise("KEY_CONFIRMED_DUAL").alias("key_status"))
    bank = {"questions": docs.select("id", F.col("id").alias("current_version_id")), "question_versions": docs}
    state = load.State(bank)
    load.withdraw_verdicts(state, t(spark, d, "labels").select(F.col("doc_id").alias("question_id")))
    return state["question_versions"].select(F.col("id").alias("doc_id"), "key_status")


def _order_mocks(spark, d):
    return t(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("paper_id"), F.col("o_orderpriority").alias("section"), F.lit(900).alias("timer_sec"), F.when(F.col("o_orderstatus") == "F", "PUBLISHED").otherwise("DRAFT").alias("status"))


@query("SELECT o_orderpriority AS section, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS ready, count(*) AS total FROM orders GROUP BY o_orderpriority")
def ready_of_total(spark, d):
    return serve.home({"mocks": _order_mocks(spark, d)})[1]


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(string_agg(o_orderkey || ':' || CASE o_orderstatus WHEN 'F' THEN 'PUBLISHED' ELSE 'DRAFT' END, ',' ORDER BY o_orderpriority, CAST(o_orderkey AS VARCHAR)), '') AS mocks FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def nested_orders(spark, d):
    """Customers as papers with their orders as mocks; those without any keep an empty list."""
    none = F.lit(None).cast("string")
    papers = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), none.alias("exam_date"), none.alias("time_slot"), none.alias("key_status"))
    rows = serve.papers({"papers": papers, "mocks": _order_mocks(spark, d)})
    return rows.select("id", F.array_join(F.transform("mocks", lambda m: F.concat_ws(":", m["id"], m["status"])), ",").alias("mocks"))


@query(r"""SELECT page_id, CAST(length(regexp_replace(regexp_replace(t, '\A\s+', ''), '\s+\z', '')) AS BIGINT) AS n_chars, CASE WHEN url LIKE 'data/questions/assets/%' THEN '/assets/' || substr(url, 23) WHEN url <> '' THEN '/assets/' || url END AS path FROM (SELECT page_id, url, replace(html, chr(160), ' ') AS t FROM pages)""")
def text_probe(spark, d):
    return t(spark, d, "pages").select("page_id", F.length(S.strip(S.plain_spaces(F.col("html")))).cast("long").alias("n_chars"), S.asset_url(F.col("url")).alias("path"))


@query("SELECT c_custkey AS id, c_mktsegment AS section, CAST(c_nationkey AS VARCHAR) AS status FROM customer WHERE c_mktsegment = 'BUILDING'")
def listing(spark, d):
    """Customers as mocks, filtered by one of two parameters."""
    return serve.mocks({"mocks": t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("section"), F.col("c_nationkey").cast("string").alias("status"))}, "building", "")


@query("SELECT count(o_orderkey) AS questions FROM orders")
def count_all(spark, d):
    return serve.health({"questions": t(spark, d, "orders").select(F.col("o_orderkey").alias("id"))})
