"""Ranked lexical search by WAND in each document shard.

Documents are brought to the counts of the terms that items ask for, once. A shard of those is turned into one list for each
term, with the highest impact that the term has in the shard. For an item the lists' cursors are kept in order of their
documents; the pivot is the first one up to which the highest impacts add up to the score of the heap's last place, and no
document before it can reach that place, so cursors are moved up to it unseen. The heap goes on from shard to shard of a
task, so later shards begin with its threshold, and the heaps of the tasks are merged in two steps.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from heapq import heappush, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlake.llm.common import arrow_map, materialize, prepare, text_bytes
from quizlake.llm.decontamination import words_of

TOP = 20
#: The most bytes of item text that one pass over the documents asks for; its terms, weights and heaps are in every task.
PASS_BYTES = 1_000_000
#: Counts of terms that a shard holds, about 50 bytes each in a task.
SHARD_POSTINGS = 1_000_000
#: Heaps of tasks are merged in so many parts of an item first.
MERGE_PARTS = 64
_NULL_ID = 1 << 63
_COUNTS = "doc_id long, n long, terms array<int>, counts array<int>"


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms of the text), terms and counts: those of the vocabulary that it holds."""

    def make():
        known = vocabulary.keys()

        def step(batch):
            n, ends, terms, counts = [], [0], [], []
            for text in text_bytes(batch.column(1)):
                words = words_of(text)
                found = Counter(words)
                for w in found.keys() & known:
                    terms.append(vocabulary[w])
                    counts.append(found[w])
                n.append(len(words))
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, _COUNTS, make)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """The lists of some documents: of each term its documents in order, their impacts and the highest of these."""

    def __init__(self, ids: list, n: list[int], sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int):
        self.ids = ids
        m = np.fromiter((75 + 25 * x * n_docs // n_terms for x in n), np.int64, len(n))
        doc = np.repeat(np.arange(len(n)), sizes)
        tf = counts.astype(np.int64)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.argsort(terms, kind="stable")  # documents stay in order
        doc, impact = doc[order], impact[order]
        some, first = np.unique(terms[order], return_index=True)
        last = np.append(first[1:], len(order))[: len(first)]  # no term of any item may occur
        most = np.maximum.reduceat(impact, first) if len(first) else first
        self.lists = {t: (doc[a:b], impact[a:b], best) for t, a, b, best in zip(some.tolist(), first.tolist(), last.tolist(), most.tolist(), strict=True)}
        self.plain: dict[int, tuple[list[int], list[int]]] = {}

    def list_of(self, term: int) -> tuple[list[int], list[int]]:
        if term not in self.plain:
            doc, impact, _ = self.lists[term]
            self.plain[term] = (doc.tolist(), impact.tolist())
        return self.plain[term]

    def search(self, query: list[tuple[int, int]], heap: list, top: int) -> int:
        """Puts the shard's documents that reach the heap of (score, -doc_id, doc_id) there; how many were scored in full.

        query: terms with how often the item has them. Of equal scores the smaller doc_id is better, a null one the worst.
        """
        lists, at, bound, times = [], [], [], []
        for term, repeats in query:
            if term in self.lists and (best := self.lists[term][2]):
                lists.append(self.list_of(term))
                at.append(0)
                bound.append(best * repeats)
                times.append(repeats)
        cursors = sorted((x[0][0], k) for k, x in enumerate(lists))
        least = heap[0][0] if len(heap) == top else 1
        scored = 0
        while cursors:
            reached = 0
            for pivot, (doc, k) in enumerate(cursors):
                reached += bound[k]
                if reached >= least:
                    break
            else:
                break  # what is left can't reach the heap, even all together
            moved = []
            if cursors[0][0] == doc:
                score = 0
                upto = 0
                for d, k in cursors:
                    if d != doc:
                        break
                    docs, impacts = lists[k]
                    i = at[k]
                    score += impacts[i] * times[k]
                    at[k] = i = i + 1
                    if i < len(docs):
                        moved.append((docs[i], k))
                    upto += 1
                scored += 1
                if score >= least:
                    one = self.ids[doc]
                    entry = (score, -_NULL_ID if one is None else -one, one)
                    if len(heap) < top:
                        heappush(heap, entry)
                    elif entry[:2] > heap[0][:2]:
                        heapreplace(heap, entry)
                    if len(heap) == top:
                        least = heap[0][0]
            else:
                upto = pivot
                for _, k in cursors[:pivot]:
                    docs = lists[k][0]
                    at[k] = i = bisect_left(docs, doc, at[k])
                    if i < len(docs):
                        moved.append((docs[i], k))
            cursors[:upto] = moved
            cursors.sort()
        return scored


def shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Shard]:
    """Shards of about SHARD_POSTINGS counts of terms; a single document may have more."""
    held: list[pa.RecordBatch] = []

    def shard() -> Shard:
        column = lambda k: [x for b in held for x in b.column(k).to_pylist()]
        flat = lambda k: np.concatenate([b.column(k).flatten().to_numpy() for b in held])
        sizes = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in held])
        out = Shard(column(0), column(1), sizes, flat(2), flat(3), weights, n_docs, n_terms)
        held.clear()
        return out

    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= SHARD_POSTINGS:
                yield shard()
                size = 0
    if held:
        yield shard()


def _pass(docs: DataFrame, items: list[tuple[int, str]], top: int) -> DataFrame:
    """item, doc_id and score of each item's best documents, ranked; items are numbered here."""
    spark = docs.sparkSession
    asked = [(number, Counter(words_of(text.encode()))) for number, text in items]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in asked for w in words}))}
    counted = materialize(postings(docs, vocabulary), "term-counts", spark)
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).head()
    df = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row for each term of this pass's items
    weights = np.array([weight(n_docs, df.get(k, 0)) for k in range(len(vocabulary))] or [0], np.int64)
    # rarest first: of cursors at one document those of high impact come first
    queries = [(number, sorted(((vocabulary[w], c) for w, c in words.items()), key=lambda x: -weights[x[0]])) for number, words in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = {number: [] for number, _ in queries}
        for shard in shards(batches, weights, n_docs, n_terms):
            for number, query in queries:
                shard.search(query, heaps[number], top)
        rows = [(number, doc, score) for number, heap in heaps.items() for score, _, doc in heap]
        for a in range(0, len(rows), 10_000):
            columns = zip(*rows[a : a + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["item", "doc_id", "score"])

    found = counted.where("n > 0").mapInArrow(run, "item long, doc_id long, score long")
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = found.withColumn("part", F.spark_partition_id() % MERGE_PARTS)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.select("item", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each item's ``top`` best documents with a score above 0.

    A null or empty text has no terms and is in no ranking; repeated documents are ranked each, and of equal scores a null
    doc_id comes last. Repeated items count once; texts that share an item_id are ranked each by itself, as is an item with a
    null id. Empty tables of either kind give no rows; other columns are ignored. Texts of any length are counted whole.
    Item texts go to every task; their size is checked, and a larger benchmark takes a pass over the documents for each part.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    passes = max(1, -(-size // PASS_BYTES))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    out = None
    for k in range(passes):
        rows = items.where(part == k).collect()  # about PASS_BYTES
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        one = _pass(docs, [(i, r.text) for i, r in enumerate(rows)], top)
        one = one.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = one if out is None else out.unionByName(one)
    return out
