"""Benchmark decontamination by Wu-Manber multi-pattern search.

A text is brought to its words with one space between them; a pattern is a window of item words with a space at either
end, so a match begins and ends at word bounds. Patterns are kept in classes by length, as the shortest sets how far the
search may skip. In each class a table gives for each block of bytes how far the search may move on; a block that may end
a pattern's head leads to the patterns with that suffix, which are compared in full.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import arrow_map, free_name, materialize, prepare, text_bytes

WINDOW = 10
#: The most bytes of item text that one search holds, in tables of about 170 times that, once in each Python worker; a larger
#: benchmark is searched for in several passes.
PASS_BYTES = 2_000_000
LENGTH_CLASSES = (1, 8, 16, 32, 48)
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of [0-9a-z] and all beyond ASCII, A-Z lower-cased."""
    return text.translate(_WORD_BYTES).split()


class WuManber:
    def __init__(self, patterns: list[bytes]):
        self.m = min(map(len, patterns))
        self.block = max(1, min(12, self.m // 3))
        self.far = self.m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, list[bytes]] = defaultdict(list)
        for p in patterns:
            for end in range(self.block, self.m + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, self.far), self.m - end)
            self.buckets[p[self.m - self.block : self.m]].append(p)

    def find(self, text: bytes):
        """(start, pattern) of every occurrence."""
        get, size, far, head = self.shift.get, self.block, self.far, self.m - self.block
        at, last = head, len(text) - size
        while at <= last:
            b = text[at : at + size]
            if move := get(b, far):
                at += move
                continue
            start = at - head
            for p in self.buckets[b]:
                if text.startswith(p, start):
                    yield start, p
            at += 1


class Searcher:
    """From items (id, text) to the occurrences of their windows in a text."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        self.owners: dict[bytes, set[int]] = defaultdict(set)
        for item, text in items:
            w = words_of(text.encode())
            for i in range(max(1, len(w) - window + 1) if w else 0):
                self.owners[b" " + b" ".join(w[i : i + window]) + b" "].add(item)
        classes = defaultdict(list)
        for p in self.owners:
            classes[sum(len(p) >= x for x in LENGTH_CLASSES)].append(p)
        self.tables = [WuManber(ps) for _, ps in sorted(classes.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Word spans [from, to) that are hit, merged, and the items that hit them."""
        text = b" " + b" ".join(words) + b" "
        spans, items = [], set()
        for table in self.tables:
            first = counted = 0  # starts ascend, so the words before one are counted on from the last
            for start, p in table.find(text):
                first += text.count(b" ", counted, start)
                counted = start
                spans.append((first, first + p.count(b" ") - 1))
                items |= self.owners[p]
        return merged(spans), items


_SEARCHERS: dict[tuple[str, int], Searcher] = {}


def searcher(key: str, items: list[tuple[int, str]], window: int) -> Searcher:
    """One searcher for each worker process, for its life; the next one takes its place."""
    if (key, window) not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key, window] = Searcher(items, window)
    return _SEARCHERS[key, window]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _search(rows: DataFrame, items: list[tuple[int, str]], window: int, every: bool) -> DataFrame:
    """The columns of rows after text, the first, with n_words, spans and items; only rows with a hit, unless ``every``."""
    names = rows.columns[1:]
    plain = [f"c{i}" for i in range(len(names))]  # a column's name may hold a dot
    ddl = ", ".join([*(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, rows.schema[1:], strict=True)), "n_words long", "spans string", "items array<long>"])
    key = uuid.uuid4().hex

    def make():
        s = searcher(key, items, window)

        def step(batch):
            count, spans, found, some = [], [], [], []
            for text in text_bytes(batch.column(0)):
                w = words_of(text)
                hit, ids = s.hits(w)
                some.append(every or bool(hit))
                count.append(len(w))
                spans.append(json.dumps(hit))
                found.append(sorted(ids))
            out = [*batch.columns[1:], pa.array(count, pa.int64()), pa.array(spans, pa.string()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(out, names=[*plain, "n_words", "spans", "items"]).filter(pa.array(some))

        return step

    return arrow_map(rows, ddl, make).toDF(*names, "n_words", "spans", "items")


def _in_passes(rows: DataFrame, items: DataFrame, passes: int, window: int, key: str) -> DataFrame:
    """The rows of _search over items that one search can't hold: rows are numbered and written, each pass writes its hits, and
    the hits of a row are merged. The driver and a worker hold the items of one pass at a time."""
    rows = materialize(rows.withColumn(key, F.monotonically_increasing_id()), "numbered")
    out = _search(rows, [], window, True).drop("spans", "items")
    hits = None
    for k in range(passes):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()]
        found = materialize(_search(rows.select("text", key), part, window, False).drop("n_words"), "hits")
        hits = found if hits is None else hits.unionByName(found)
    ints = "array<array<long>>"
    every = hits.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(F.from_json("spans", ints)))).alias("_s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    # spans in order; one that begins up to where the last ends is a part of it
    join = "aggregate(_s, cast(array() as array<array<long>>), (d, s) -> if(size(d) > 0 and s[0] <= element_at(d, -1)[1], concat(slice(d, 1, size(d) - 1), array(array(element_at(d, -1)[0], greatest(element_at(d, -1)[1], s[1])))), concat(d, array(s))))"
    every = every.select(F.col(key), F.to_json(F.expr(join)).alias("spans"), "items")
    return out.join(every, key, "left").drop(key).withColumns({"spans": F.coalesce("spans", F.lit("[]")), "items": F.coalesce("items", F.array().cast("array<long>"))})


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, keep: list[str] = ()) -> DataFrame:
    """doc_id, the columns of ``keep``, n_words, n_hit, spans (word spans hit, as JSON), items (array of item ids).

    A null or empty text has no words; an item with a null id or without words matches nothing; repeated items count
    once; repeated documents are judged each; an empty table of either kind is fine; other columns are ignored. The item
    texts are sent to every task; their size is checked, and where one search can't hold them the documents are searched in
    several passes, each over all documents with a part of the items, so results don't change.
    """
    prepare(docs.sparkSession)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    passes = max(1, -(-size // PASS_BYTES))
    kept = ["doc_id", *[c for c in keep if c != "doc_id"]]
    names = [f"k{i}" for i in range(len(kept))]
    rows = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(kept, names, strict=True)])
    out = _search(rows, [tuple(r) for r in items.collect()], window, True) if passes == 1 else _in_passes(rows, items, passes, window, free_name(names, "row"))
    hit = F.expr("aggregate(from_json(spans, 'array<array<long>>'), 0L, (n, s) -> n + s[1] - s[0])")
    return out.select(*[F.col(n).alias(c) for c, n in zip(kept, names, strict=True)], "n_words", hit.alias("n_hit"), "spans", "items")


def items_digest(items):
    """sha256 of the ids sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda x: x.cast("string"))), ","), 256)
