"""The registered queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake.llm import decontamination, fingerprints, html_text, language, lexical_search, line_dedup, ngram_join, packing, phrases, quality, substring_dedup, token_files, vector_search
from quizlake.llm.common import fold_of, materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    stats = materialize(quality.statistics_of(docs, ["doc_id"]), "statistics", spark)
    model = quality.fit_statistics(stats, quality.learnable(table(spark, sf_dir, "labels")))
    out = quality.score_statistics(stats, model)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.search(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(20)) == 0)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(language.learnable(docs))
    return language.identify(docs, model, ["doc_id"]).select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), decontamination.items_digest(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_quality, op3_token_files, op4_vector_search, op5_ngram_join, op6_line_dedup, op7_language, op8_substring_dedup, op9_decontamination, op10_html_text, op11_lexical_search, op12_fingerprints, op13_phrases)}

ORACLE_SQL = {
    "op4_vector_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op5_ngram_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda w: w <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
        e AS (SELECT x, y FROM p JOIN n AS i ON x = i.doc_id JOIN n AS j ON y = j.doc_id WHERE c >= 0.8 * (i.n + j.n - c) - 1e-9),
        r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
        SELECT doc_id, min(root) AS class_id, (SELECT count(*) FROM e WHERE e.x = r.doc_id) AS n_links FROM r GROUP BY doc_id
    """,
    "op6_line_dedup": """
        WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
        x AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM l),
        w AS (SELECT doc_id, i, line, lead(line, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(line, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c, row_number() OVER (ORDER BY doc_id, i) AS place FROM x),
        f AS (SELECT *, min(place) OVER (PARTITION BY line, b, c) AS earliest FROM w WHERE c IS NOT NULL),
        gone AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM f WHERE place > earliest),
        k AS (SELECT x.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(x.line, chr(10) ORDER BY x.i) FILTER (gone.i IS NULL), '') AS kept
              FROM x LEFT JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY x.doc_id)
        SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM k
    """,
    "op8_substring_dedup": """
        WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
        w AS (SELECT doc_id, a, substr(h, 2 * a + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS a FROM d)),
        f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
        hit AS (SELECT w.doc_id, w.a FROM w JOIN f ON w.s = f.s WHERE w.doc_id > f.first),
        g AS (SELECT doc_id, a, CASE WHEN a <= lag(a) OVER (PARTITION BY doc_id ORDER BY a) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
        n AS (SELECT doc_id, a, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS k FROM g),
        r AS (SELECT doc_id, k, min(a) AS a, max(a) + 50 AS b, coalesce(lag(max(a) + 50) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM n GROUP BY doc_id, k),
        p AS (SELECT r.doc_id, sum(r.b - r.a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) AS kept, max(b) AS last FROM r JOIN d ON r.doc_id = d.doc_id GROUP BY r.doc_id)
        SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256
        FROM d LEFT JOIN p ON d.doc_id = p.doc_id
    """,
    "op9_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
        p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
        x AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p))),
        m AS (SELECT x.doc_id, x.i, x.n, p.item_id FROM x JOIN p ON x.n = p.n AND x.s = p.s),
        h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, i + unnest(range(0, n)) AS j FROM m) GROUP BY doc_id),
        o AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items, sha256(coalesce(o.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN o ON d.doc_id = o.doc_id
    """,
    "op11_lexical_search": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        c AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d WHERE len(w) > 0),
        q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, t),
        f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY doc_id, t),
        n AS (SELECT t, count(*) AS df FROM f GROUP BY t),
        m AS (SELECT doc_id, 75 + (25 * len(w) * docs) // terms AS m FROM d, c WHERE len(w) > 0),
        i AS (SELECT f.doc_id, f.t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS impact FROM f JOIN n ON f.t = n.t JOIN m ON f.doc_id = m.doc_id, c),
        s AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM q JOIN i ON q.t = i.t GROUP BY item_id, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 20
    """,
    "op13_phrases": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
        x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
        g AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM x, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY lang, k, phrase),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
        c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k >= 2 AND f >= 10),
        b AS (SELECT c.lang, c.phrase, c.a, cut, y.f AS l, z.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(y.f AS HUGEINT) * z.f) AS BIGINT) AS score
              FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) AS c JOIN g AS y ON c.lang = y.lang AND y.phrase = array_to_string(w[1 : cut], ' ') JOIN g AS z ON c.lang = z.lang AND z.phrase = array_to_string(w[cut + 1 :], ' ')),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS best FROM b),
        i AS (SELECT lang, array_to_string(w[j : j + 1], ' ') AS phrase, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS j FROM c WHERE k = 3) GROUP BY ALL),
        e AS (SELECT o.lang, o.phrase, a, l, r, score, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, o.phrase) AS rank FROM o LEFT JOIN i ON o.lang = i.lang AND o.phrase = i.phrase WHERE best = 1 AND (longer IS NULL OR 100 * longer < 50 * a))
        SELECT e.lang, rank, phrase, a, l, r, n, score FROM e JOIN n ON e.lang = n.lang WHERE rank <= 2000
    """,
}
