"""Packing of token ids into sequences of a fixed capacity by Karmarkar-Karp multiway differencing.

Each task packs its own documents, so nothing is shuffled. Full sequences are cut off long documents first. What is left
is gathered until it nearly fills ``windows`` sequences and is then spread over them: a partial partition is a tuple of
window loads, and the two tuples of the largest spread are merged, largest load onto smallest, until one is left. If a
window is over capacity, the window count rises by one and the merging is done again.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import prepare, texts
from quizlake.llm.tokens import coder

CAPACITY = 4096
#: Shorter pieces are bundled, until a bundle has so many tokens.
BUNDLE = 64
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def difference(sizes: list[int], k: int) -> np.ndarray:
    """The window of each item, of k windows, by multiway differencing. Ties go by position, so a rerun agrees."""
    if not sizes:
        return np.zeros(0, np.int64)
    nodes: list[tuple] = []  # a leaf: (item,); a merge: (left, right, order of its slots)
    heap = []
    for i, n in enumerate(sizes):
        loads = np.zeros(k, np.int64)
        loads[0] = n
        heap.append((-n, i, loads))
        nodes.append((i,))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        loads = left + right[::-1]
        order = np.argsort(-loads, kind="stable")
        loads = loads[order]
        loads -= loads[-1]
        nodes.append((a, b, order))
        heapq.heappush(heap, (-int(loads[0]), len(nodes) - 1, loads))
    window = np.zeros(len(sizes), np.int64)
    stack = [(heap[0][1], np.arange(k))]
    while stack:
        at, where = stack.pop()  # where: the window of each slot of the node
        node = nodes[at]
        if len(node) == 1:
            window[node[0]] = where[0]
            continue
        a, b, order = node
        slots = np.empty(k, np.int64)
        slots[order] = where
        stack += [(a, slots), (b, slots[::-1])]
    return window


def spread(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """The window of each item and the window count, no window over capacity."""
    k = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        window = difference(sizes, k)
        if not sizes or np.bincount(window, sizes).max() <= capacity:
            return window, k
        k += 1


class Packer:
    """Takes documents one by one; gives rows of SCHEMA for full groups."""

    def __init__(self, first_sequence: int, capacity: int, windows: int, largest: int, slack: float):
        self.sequence, self.capacity, self.largest = first_sequence, capacity, largest
        self.room = max(capacity, int(capacity * windows * (1 - slack)))
        self.items: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray):
        at, n = 0, len(ids)
        while n - at >= self.capacity:
            yield (doc_id, at, ids[at : at + self.capacity], n, self.sequence, 0)
            self.sequence += 1
            at += self.capacity
        while at < n:
            take = min(self.largest, n - at, self.room - self.held)
            self.items.append((doc_id, at, ids[at : at + take], n))
            self.held += take
            at += take
            if self.held == self.room:
                yield from self.flush()

    def flush(self):
        bundle, sizes = [], []  # short pieces that follow each other go to one window, so a group of many has few to spread
        for x in self.items:
            if not sizes or sizes[-1] >= BUNDLE or len(x[2]) >= BUNDLE:
                sizes.append(0)
            sizes[-1] += len(x[2])
            bundle.append(len(sizes) - 1)
        window, k = spread(sizes, self.capacity)
        offset = [0] * k
        for (doc_id, start, ids, n), w in zip(self.items, window[bundle].tolist(), strict=True):
            yield (doc_id, start, ids, n, self.sequence + w, offset[w])
            offset[w] += len(ids)
        if self.items:
            self.sequence += k
        self.items, self.held = [], 0


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, windows: int = 64, largest: int = 512, slack: float = 0.004) -> DataFrame:
    """Packs every document: its ids by the tokenizer (kind 'word'), then the end id.

    A row for each piece: doc_id, start (the document's ids before it), length, ids (little-endian unsigned 32-bit),
    doc_tokens, sequence_id, offset in the sequence. A null or empty text is the end id alone; a null doc_id stays null;
    repeated rows are packed each; an empty table gives no rows; other columns are ignored. A group of documents holds
    at most ``windows`` sequences, whatever the table's size.
    """
    prepare(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def batch_of(rows):
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([cols[0], cols[1], [len(x) for x in cols[2]], [x.tobytes() for x in cols[2]], cols[3], cols[4], cols[5]], schema, strict=True)], schema=schema)

    def run(batches):
        c = coder(tokenizer_path, "word")
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, windows, largest, slack)
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            for doc_id, packed in zip(ids, c.encode(texts(batch.column(1))), strict=True):
                rows.extend(packer.add(doc_id, np.frombuffer(packed, "<u4")))
            if rows:
                yield batch_of(rows)
        if rows := list(packer.flush()):
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
