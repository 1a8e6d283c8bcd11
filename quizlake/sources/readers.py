"""Readers of the inputs. Schemas are declared; a malformed record fails the read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quizlake import schemas
from quizlake.operators.ordered import filled
from quizlake.sources.scratch import file_system

# Names of the files that are taken and of those that are listed only.
SHEETS = "SSC-CGL-Tier-1-Question-Paper-English_*.pdf"
EXCLUDED = "SSC-CGL-T-I-Similar-Paper-*.pdf"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or any path of a glob, is there, in any file system that Spark reads."""
    fs, p = file_system(spark, path)
    found = fs.globStatus(p)
    return found is not None and len(found) > 0


def sheet_files(spark: SparkSession, root: str, pattern: str = SHEETS) -> DataFrame:
    """name, sha256 of the sheets in a folder, not below it."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("raw"), F.sha2("content", 256).alias("sha256")).select(F.url_decode(F.replace("raw", F.lit("+"), F.lit("%2B"))).alias("name"), "sha256")


def excluded_files(spark: SparkSession, root: str, pattern: str = EXCLUDED) -> DataFrame:
    """Names only; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    return files.select(F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B"))).alias("name")).orderBy("name")


def with_order(df: DataFrame) -> DataFrame:
    """ord: the place of a record among all files by path, then in its file. Only repeated keys depend on it."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("ord"))


def json_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return with_order(spark.read.schema(ddl).option("mode", "FAILFAST").json(path))


def numbered_lines(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Records of JSON lines with path and place: the file, and the record's number from 1 in it, however the file is split."""
    rows = json_lines(spark, path, ddl).select("*", F.col("ord.path").alias("path"), F.col("ord.block").alias("_block"), F.col("ord.line").alias("_line")).drop("ord")
    return filled(rows, "path", ["_block", "_line"], F.lit(None).cast("string"), "_none").drop("_block", "_line", "_none")


def json_array(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return with_order(spark.read.schema(ddl).option("mode", "FAILFAST").option("multiLine", True).json(path))


def nothing(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], schemas.struct_type(ddl + ", ord struct<path:string,block:bigint,line:bigint>"))


def optional(spark: SparkSession, path: str, ddl: str, reader=json_lines) -> DataFrame:
    """An absent file has no records."""
    return reader(spark, path, ddl) if exists(spark, path) else nothing(spark, ddl)


def manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sources (with ord), duplicates, excluded of a manifest document."""
    doc = spark.read.schema(schemas.MANIFEST).option("mode", "FAILFAST").option("multiLine", True).json(path)
    sources = doc.select(F.posexplode("sources").alias("ord", "s")).select("s.*", "ord")
    return sources, doc.select(F.inline("duplicates")), doc.select(F.explode("excluded").alias("name"))


def document_text(pages: DataFrame, *more: Column) -> DataFrame:
    """file, text: the pages of a file in order, joined by line feeds; and more that is made of all pages of a file."""
    ordered = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy("file").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"), *more)
