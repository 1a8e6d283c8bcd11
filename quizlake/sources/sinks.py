"""Sinks of the intake: manifest JSON, the two listings, and copies of accepted files."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quizlake.functions import scalars as S
from quizlake.operators.intake import date_order
from quizlake.sources.scratch import materialize

#: Bytes of a file that a task holds, how often it tries a copy, and failed ones that an error names.
CHUNK = 1 << 22
TRIES = 3
NAMED = 20
# Fixed texts of the listings.
SOURCES_HEAD = """# Sources

Generated by the intake. Do not edit by hand.

%d of %d unique 2024 response sheets accepted. Answer keys are `unknown` (tentative vs final is not stated) until verified in Phase 2.

Accepted with agreed relaxations: Adda247 branding (logo header, watermark, ad page) is known noise; Question IDs of 10-13 digits are valid; questions whose Question ID box is cut off by an overflowing math stem are counted from their answer marker and go to the review queue.

| Date | Slot | Original filename | Stored path | SHA-256 | Key | Status | Notes |
|---|---|---|---|---|---|---|---|
"""
MISSING_HEAD = "# Missing, duplicate and excluded files\n\nGenerated by the intake. For information only.\n\n## Duplicates (byte-identical, skipped)\n\n"
EXCLUDED_HEAD = '\n\n## Excluded: 2025 "Similar Paper" reconstructions\n\nAuthored in MS Word with no Question IDs; excluded by the spec.\n\n'
REJECTED_HEAD = "\n\n## Rejected\n\n"
OVERFLOW_HEAD = "\n\n## Questions to review (accepted files)\n\nMath-typeset stems that run off the page, cutting off the Question ID box. This is why some sheets show 99 Question IDs or `Ans` labels for 100 questions: every sheet has exactly 100 green correct-option markers.\n\n"
UNLABELED_HEAD = "\n\n## Stems without a text layer (accepted files)\n\n%d Quant questions across %d sheets have their stem and `Q.n` label typeset as math with no extractable text. Their answer markers are intact; Phase 2 stores them as crops.\n\n"


def manifest_document(records: DataFrame, duplicates: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row, json: the manifest. A listing of files, so it fits a row."""
    r = records.select(F.struct(F.struct(*date_order()).alias("o"), F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias("v")).alias("x"), F.lit("sources").alias("k"))
    by = lambda c: F.struct(*[F.lit("")] * 5, F.lit(False), F.col(c)).alias("o")
    dup = duplicates.select(F.struct(by("filename"), F.to_json(F.struct(*duplicates.columns)).alias("v")).alias("x"), F.lit("duplicates").alias("k"))
    ex = excluded.select(F.struct(by("name"), S.json_string(F.col("name")).alias("v")).alias("x"), F.lit("excluded").alias("k"))
    rows = r.union(dup).union(ex)
    part = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("x")))), lambda x: x["v"]), ", ")
    return rows.agg(F.concat(F.lit('{"sources": ['), part("sources"), F.lit('], "duplicates": ['), part("duplicates"), F.lit('], "excluded": ['), part("excluded"), F.lit("]}")).alias("json"))


def write_manifest(doc: DataFrame, path: str) -> None:
    doc.select("json").write.mode("overwrite").text(path)


def source_line() -> Column:
    """A record's line of the source listing."""
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    status = F.when(F.col("accepted"), "accepted").otherwise(F.concat(F.lit("rejected: "), F.array_join("reasons", "; ")))
    return F.format_string("| %s | %s | `%s` | `%s` | `%s` | %s | %s | %s |", c("date"), c("time_slot"), "filename", S.or_dash(F.col("stored_path")), "sha256", F.coalesce("key_status", F.lit("unknown")), status, c("notes"))


def duplicate_line() -> Column:
    return F.format_string("- `%s` is identical to `%s` (SHA-256 `%s`)", "filename", "same_as", S.short_digest(F.col("sha256")))


def rejected_line() -> Column:
    return F.format_string("- `%s`: %s", "filename", F.array_join("reasons", "; "))


def count_line(column: str) -> Column:
    return F.format_string("- %s %s: %d", "date", "time_slot", column)


def unlabeled_totals(records: DataFrame) -> DataFrame:
    """One row: n questions without a text label, and the sheets that have any."""
    return records.where("unlabeled_questions > 0").agg(F.coalesce(F.sum("unlabeled_questions"), F.lit(0)).alias("n"), F.count("*").alias("sheets"))


def _in_order(df: DataFrame, block: int, order: list[Column], line: Column) -> DataFrame:
    """block, o, line: the lines of a block of a document, and what they are sorted by."""
    fill = [*order, *[F.lit("")] * (5 - len(order)), F.lit(False), F.lit("")] if len(order) < 7 else order
    return df.select(F.lit(block).alias("block"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(fill)]).alias("o"), line.alias("line"))


def _head(one: DataFrame, block: int, text: Column) -> DataFrame:
    """A text's lines; one: a single row, of which the text may be made."""
    lines = one.select(F.posexplode(F.split(text, "\n")).alias("i", "line"))
    return _in_order(lines, block, [F.lpad(F.col("i").cast("string"), 9, "0")], F.col("line"))


def _or_none(lines: DataFrame, block: int) -> DataFrame:
    empty = lines.agg(F.count("*").alias("n")).where("n = 0")
    return lines.unionByName(_in_order(empty, block, [F.lit("")], F.lit("- none")))


def source_document(records: DataFrame) -> DataFrame:
    """block, o, line of the source listing, one row for each line."""
    totals = records.agg(F.count_if(F.col("accepted")).alias("n"), F.count("*").alias("of"))
    head = F.format_string(SOURCES_HEAD.removesuffix("\n"), "n", "of")
    return _head(totals, 0, head).unionByName(_in_order(records, 1, date_order(), source_line()))


def missing_document(records: DataFrame, duplicates: DataFrame, excluded: DataFrame) -> DataFrame:
    """block, o, line of the listing of what is missing, one row for each line; a part without any says so."""
    one = records.sparkSession.range(1)
    text = lambda head: F.lit(head.removeprefix("\n").removesuffix("\n"))
    totals = unlabeled_totals(records)
    items = [
        (_head(one, 0, text(MISSING_HEAD)), _in_order(duplicates, 1, [F.col("filename")], duplicate_line())),
        (_head(one, 2, text(EXCLUDED_HEAD)), _in_order(excluded, 3, [F.col("name")], F.format_string("- `%s`", "name"))),
        (_head(one, 4, text(REJECTED_HEAD)), _in_order(records.where("not accepted"), 5, date_order(), rejected_line())),
        (_head(one, 6, text(OVERFLOW_HEAD)), _in_order(records.where("overflow_questions > 0"), 7, date_order(), count_line("overflow_questions"))),
        (_head(totals, 8, F.format_string(UNLABELED_HEAD.removeprefix("\n").removesuffix("\n"), "n", "sheets")), _in_order(records.where("unlabeled_questions > 0"), 9, date_order(), count_line("unlabeled_questions"))),
    ]
    out = None
    for k, (head, lines) in enumerate(items):
        block = head.unionByName(_or_none(lines, 2 * k + 1))
        out = block if out is None else out.unionByName(block)
    return out


DOCUMENT_ORDER = ["block", "o", "line"]


def write_document(doc: DataFrame, path: str) -> None:
    """A document's lines as text files; in the order of their names they are the document."""
    doc.repartitionByRange(*DOCUMENT_ORDER).sortWithinPartitions(*DOCUMENT_ORDER).select("line").write.mode("overwrite").text(path)


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; the path is taken as it is, with any sign in it."""
    scheme, found, rest = uri.partition("://")
    if not found or scheme == "file":
        return fs.LocalFileSystem(), (rest if found else uri.removeprefix("file:"))
    authority, _, path = rest.partition("/")
    store, root = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    return store, f"{root.rstrip('/')}/{path}"


def _digest(store: fs.FileSystem, path: str) -> str | None:
    """SHA-256 of a file, read in chunks; None where there is none."""
    if store.get_file_info(path).type != fs.FileType.File:
        return None
    digest = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while chunk := f.read(CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def _copy(source: str, target: str, wanted: str) -> tuple[str, int, str | None]:
    """Status, bytes written and what went wrong. A copy is written aside, read again, and put in place only if it is as wanted."""
    wrong = None
    for _ in range(TRIES):
        aside = None
        try:
            (a_store, a), (b_store, b) = _store(source), _store(target)
            if _digest(b_store, b) == wanted:
                return "there", 0, None
            b_store.create_dir(b.rpartition("/")[0], recursive=True)
            aside, n = f"{b}.{uuid.uuid4().hex}", 0
            with a_store.open_input_stream(a) as f, b_store.open_output_stream(aside) as g:
                while chunk := f.read(CHUNK):
                    n += g.write(chunk)
            if (got := _digest(b_store, aside)) == wanted:
                if b_store.get_file_info(b).type == fs.FileType.File:
                    b_store.delete_file(b)  # some stores don't move over a file
                b_store.move(aside, b)
                return "copied", n, None
            wrong = f"SHA-256 {got}"
            b_store.delete_file(aside)
        except OSError as e:
            wrong = str(e)
            if aside and b_store.get_file_info(aside).type == fs.FileType.File:
                b_store.delete_file(aside)
    return "failed", 0, wrong


def copy_files(files: DataFrame) -> DataFrame:
    """Copies files (source, target: URIs; sha256: of the content) by tasks, a file at a time in chunks; a row for each.

    status: 'copied', 'there' (the target had that content), or 'failed' after some tries, with what went wrong; a target with
    other content stays as it is then. A task that is run again finds what it has copied. The result is written once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            done = [_copy(*r) for r in rows]
            columns = [*batch.columns, *(pa.array([d[k] for d in done], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.string())))]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "target", "sha256", "status", "bytes", "wrong"])

    spread = files.select("source", "target", "sha256").repartition("target")
    return materialize(spread.mapInArrow(run, "source string, target string, sha256 string, status string, bytes long, wrong string"), "copies")


def copy_accepted(to_copy: DataFrame, source_root: str, target_root: str) -> int:
    """Copies accepted files (filename, stored_path, sha256); the count of those that are in place. IOError where one isn't."""
    at = lambda root, column: F.concat(F.lit(root.rstrip("/") + "/"), column)
    done = copy_files(to_copy.select(at(source_root, F.col("filename")).alias("source"), at(target_root, F.col("stored_path")).alias("target"), "sha256"))
    if lost := done.where("status = 'failed'").limit(NAMED).collect():
        raise OSError("\n".join(f"{r.source}: {r.wrong}" for r in lost))
    return done.count()
