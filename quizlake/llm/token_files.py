"""Token ids in files of directly addressable codes.

An id is cut into chunks of ``BITS`` bits. Level 0 holds the low chunk of every id and a bitmap that says which ids go
on; level 1 holds the next chunk of those, and so on. A directory gives the set bits before each block of 512, so the
place of an id on the next level is a rank: any token is read without decoding its neighbours. The ids of a document
follow one another on every level, so a document is a slice of each, found by a rank of its first and last id.

A file, all little-endian: magic ``DAC1``, levels u32, documents u64, ids u64; doc_id i64 each; null flag u8 each; end
of each document u64; then for each level: count u64, chunks u8 each, bitmap bytes, directory u32 each.

Files are rows of an uncompressed Parquet table in the shared folder, as only Spark's writers reach a cluster's store.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import arrow_map, materialize, prepare, texts
from quizlake.llm.tokens import coder

BITS = 8
BLOCK = 512
MAGIC = b"DAC1"
FILE_TOKENS = 4_000_000


def write_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        goes_on = (rest >> BITS) > 0
        packed = np.packbits(goes_on, bitorder="little")
        sums = np.concatenate([[0], np.cumsum(np.add.reduceat(goes_on, np.arange(0, len(rest), BLOCK), dtype=np.uint32))])[:-1] if len(rest) else np.zeros(0)
        levels.append(struct.pack("<Q", len(rest)) + (rest & 0xFF).astype(np.uint8).tobytes() + packed.tobytes() + sums.astype("<u4").tobytes())
        rest = rest[goes_on] >> BITS
        if not len(rest):
            break
    head = MAGIC + struct.pack("<IQQ", len(levels), len(doc_ids), len(ids))
    head += np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return head + np.cumsum(np.array(lengths, np.uint64)).astype("<u8").tobytes() + b"".join(levels)


class TokenFile:
    """Reads a file's bytes: token(i) by rank, document(j), or all ids at once."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        n_levels, docs, self.n_ids = struct.unpack_from("<IQQ", data, 4)
        at = 24

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        raw, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if z else x for x, z in zip(raw.tolist(), null.tolist(), strict=True)]
        self.ends = take("<u8", docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.levels.append((take("u1", n), take("u1", (n + 7) // 8), take("<u4", -(-n // BLOCK))))

    def token(self, i: int) -> int:
        value = 0
        for depth, (chunks, bitmap, directory) in enumerate(self.levels):
            value |= int(chunks[i]) << (BITS * depth)
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            block = i // BLOCK
            before = bitmap[block * BLOCK // 8 : i >> 3]
            i = int(directory[block]) + int(np.bitwise_count(before).sum()) + int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
        return value

    def rank(self, depth: int, i: int) -> int:
        """How many of the first i ids of a level go on: the directory's count and the bits of one block."""
        _, bitmap, directory = self.levels[depth]
        block = i // BLOCK
        if block == len(directory):  # i is the level's length, and its last block full
            if not block:
                return 0
            block -= 1
        whole = int(np.bitwise_count(bitmap[block * BLOCK // 8 : i >> 3]).sum())
        return int(directory[block]) + whole + (int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def ids(self, start: int, end: int) -> np.ndarray:
        """The ids from start to below end; nothing else is decoded."""
        out = np.zeros(end - start, np.uint32)
        which = np.arange(end - start)
        for depth, (chunks, bitmap, _) in enumerate(self.levels):
            out[which] |= chunks[start:end].astype(np.uint32) << np.uint32(BITS * depth)
            if depth == len(self.levels) - 1:
                break
            bits = np.unpackbits(bitmap[start >> 3 : (end + 7) >> 3], bitorder="little")[start & 7 :][: end - start]
            which = which[bits.astype(bool)]
            if not len(which):
                break
            start = self.rank(depth, start)
            end = start + len(which)
        return out

    def document(self, j: int) -> np.ndarray:
        return self.ids(int(self.ends[j - 1]) if j else 0, int(self.ends[j]))


def write_token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encodes every whole text (kind 'byte') and writes the ids in ascending doc_id order.

    Documents are dealt by ranges of doc_id and sorted in each, so files follow one another as (part, file) do. Gives the
    table as written: part, file, before (ids of the part before the file), n_docs, n_ids, data. A null text is the end id alone; null doc_ids come first; rows
    that share a doc_id stay side by side; an empty table gives no files; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    out = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("before", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])

    def run(batches):
        c, part, file, before = coder(tokenizer_path, "byte"), TaskContext.get().partitionId(), 0, 0
        names, lengths, held, total = [], [], [], 0

        def closed():
            values = (part, file, before, len(names), total, write_file(names, lengths, np.frombuffer(b"".join(held), "<u4")))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, out, strict=True)], schema=out)

        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), c.encode(texts(batch.column(1))), strict=True):
                names.append(doc_id)
                lengths.append(len(packed) // 4)
                held.append(packed)
                total += lengths[-1]
                if total >= FILE_TOKENS:
                    yield closed()
                    names, lengths, held, total, file, before = [], [], [], 0, file + 1, before + total
        if names:
            yield closed()

    in_order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return materialize(in_order.mapInArrow(run, "part long, file long, before long, n_docs long, n_ids long, data binary"), "token-files", compression="none")


def read_token_files(files: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start over all files, n_tokens, ids (little-endian unsigned 32-bit).

    Each document is read by its ranks. The driver sees one row for each part, which are the partitions of the shuffle that wrote them.
    """
    spark = files.sparkSession
    starts, at = [], 0
    for part, n in sorted(tuple(r) for r in files.groupBy("part").agg(F.sum("n_ids")).collect()):
        starts.append((part, at))
        at += n
    offsets = spark.createDataFrame(starts, "part long, base long")
    kinds = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def make():
        def step(batch):
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                f = TokenFile(data.as_py())
                ends = f.ends
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                for i in range(0, len(ends), 2000):
                    b, e = begins[i : i + 2000], ends[i : i + 2000]
                    ids = [f.document(j).astype("<u4").tobytes() for j in range(i, i + len(b))]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), part)), pa.array(f.doc_ids[i : i + 2000], pa.int64()), pa.array(b + before), pa.array(e - b), pa.array(ids, pa.binary())], schema=kinds)

        return step

    rows = arrow_map(files.select("part", "before", "data"), "part long, doc_id long, local_start long, n_tokens long, ids binary", make)
    return rows.join(F.broadcast(offsets), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")
