"""Scalar functions as Catalyst expressions; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the domain.
SECTION_CODES = {"General Intelligence and Reasoning": "REASONING", "General Awareness": "GA", "Quantitative Aptitude": "QUANT", "English Comprehension": "ENGLISH"}
HEADER = "Combined Graduate Level Examination 2024 Tier I"
QUESTION_ID = r"Question ID\s*:\s*(\d+)"
FILE_NAME = r"English_(\d{2})\.(\d{2})\.(\d{4})_(\d{1,2})\.(\d{2})-(AM|PM)-\d{1,2}\.\d{2}-(?:AM|PM)"
HEADER_TIME = r"Exam Time\s*(\d{1,2}):(\d{2})\s*(AM|PM)"
HEADER_DATE = r"Exam Date\s*(\d{2}/\d{2}/\d{4})"
COPY_SUFFIX = r" \(\d+\)(?=\.pdf$)"
ASSET_PREFIX = "data/questions/assets/"
#: White space of any script, and the separators 1c to 1f.
WHITE = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    """Without white space of any script at either end."""
    return F.trim(c, F.lit(WHITE))


def has_chars(c: Column, n: int) -> Column:
    """Whether n characters or more (2 at least) are left of it when stripped; a long text isn't read to its end."""
    return c.rlike(f"(?s)[^{WHITE}].{{{n - 2},}}?[^{WHITE}]")


def plain_spaces(c: Column) -> Column:
    """No-break spaces as plain ones."""
    return F.replace(c, F.lit("\u00a0"), F.lit(" "))


def section_code(c: Column) -> Column:
    """The code of a section name; an unknown name is its own code."""
    names = F.create_map(*[F.lit(x) for pair in SECTION_CODES.items() for x in pair])
    return F.coalesce(F.element_at(names, c), c)


def to_hhmm(hour: Column, minute: Column, meridiem: Column) -> Column:
    h = F.pmod(hour.cast("int"), F.lit(12)) + F.when(meridiem == "PM", 12).otherwise(0)
    return F.concat(F.lpad(h.cast("string"), 2, "0"), minute)


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(c, pattern, i)


def file_date(name: Column) -> Column:
    g = lambda i: _group(name, FILE_NAME, i)
    return F.when(name.rlike(FILE_NAME), F.concat_ws(".", g(1), g(2), g(3)))


def file_slot(name: Column) -> Column:
    g = lambda i: _group(name, FILE_NAME, i)
    return F.when(name.rlike(FILE_NAME), to_hhmm(F.nullif(g(4), F.lit("")), g(5), g(6)))


def header_date(text: Column) -> Column:
    return F.nullif(F.replace(_group(text, HEADER_DATE, 1), F.lit("/"), F.lit(".")), F.lit(""))


def header_slot(text: Column) -> Column:
    found = _group(text, HEADER_TIME, 0)
    return F.when(found != "", to_hhmm(F.nullif(_group(found, HEADER_TIME, 1), F.lit("")), _group(found, HEADER_TIME, 2), _group(found, HEADER_TIME, 3)))


def base_name(name: Column) -> Column:
    return F.regexp_replace(name, COPY_SUFFIX, "")


def is_copy(name: Column) -> Column:
    return base_name(name) != name


def is_green(color: Column) -> Column:
    """Green beyond red by more than 40; blue doesn't count."""
    return F.shiftright(color, 8).bitwiseAND(F.lit(255)) > F.shiftright(color, 16) + 40


def clamped(c: Column) -> Column:
    return F.greatest(F.lit(0), c)


def file_digest(content: Column) -> Column:
    return F.sha2(content, 256)


def short_digest(digest: Column) -> Column:
    return F.concat(F.substring(digest, 1, 16), F.lit("…"))


def json_string(c: Column) -> Column:
    """c as a JSON string with characters beyond ASCII as they are and control characters as lower-case escapes; null as null."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    for code in range(32):
        out = F.replace(out, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.coalesce(F.concat(F.lit('"'), out, F.lit('"')), F.lit("null"))


def content_hash(qid: Column, stem: Column, image: Column, options: Column) -> Column:
    """What a solver sees of a question: 16 hex digits of the SHA-256 of its JSON array."""
    each = F.transform(options, lambda o: F.concat(F.lit("["), json_string(o["text"]), F.lit(", "), json_string(o["image"]), F.lit("]")))
    body = F.concat(F.lit("["), F.concat_ws(", ", json_string(qid), json_string(stem), json_string(image), F.concat(F.lit("["), F.array_join(each, ", "), F.lit("]"))), F.lit("]"))
    return F.substring(F.sha2(body, 256), 1, 16)


def paper_date(date: Column) -> Column:
    """dd.MM.yyyy as a date; an impossible date raises under ANSI."""
    return F.to_date(date, "dd.MM.yyyy")


def paper_id(date: Column, slot: Column) -> Column:
    return F.concat(F.date_format(paper_date(date), "yyyy-MM-dd"), F.lit("_"), slot)


def asset_url(path: Column) -> Column:
    """The served URL of a stored path; null or empty gives null."""
    return F.when(path != "", F.concat(F.lit("/assets/"), F.when(path.startswith(ASSET_PREFIX), F.substring(path, len(ASSET_PREFIX) + 1, 1 << 30)).otherwise(path)))


def option_urls(options: Column) -> Column:
    return F.transform(options, lambda o: F.struct(o["label"].alias("label"), o["text"].alias("text"), asset_url(o["image"]).alias("image_url")))


def shift_label(paper: Column) -> Column:
    """yyyy-mm-dd_HHMM as 'yyyy-mm-dd HH:MM'."""
    parts = F.split(paper, "_")
    return F.concat(parts[0], F.lit(" "), F.substring(parts[1], 1, 2), F.lit(":"), F.substring(parts[1], 3, 2))


def or_dash(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
