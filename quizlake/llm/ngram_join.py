"""Similarity join of documents by the Jaccard similarity of their word n-grams, with MinHash banding.

Band and row counts follow from the recall wanted at the threshold. Documents of equal n-gram sets are one class first,
whose copies never meet again. Class representatives are dealt by band hashes; a bucket that many share is cut into blocks
of bounded rows and n-grams, and a task takes two blocks. A pair is judged in the first band it shares only, on its full n-gram sets, which are sent
for the documents that have such a pair. No pair becomes a row: a task sums a document's links and gives a forest of them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import arrow_map, materialize, prepare, texts
from quizlake.llm.substring_dedup import Hasher, mix

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
MOST_HASHES = 128
BLOCK = 512
#: Bytes of n-grams that the members of a block hold, on average.
BLOCK_BYTES = 8_000_000
#: Bytes of text whose n-grams are hashed at once: a worker holds some dozens of times as much.
GRAM_BYTES = 1_000_000


def bands_and_rows(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """The most selective banding (most rows a band) whose recall at the threshold is reached with at most ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows > most:
            break
        best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def shingles(documents: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each text, sorted, laid end to end; where each text ends.

    Words are lower-cased and parted by white space. A text of fewer words is one n-gram of all its words; a text without
    words has none.
    """
    parts = [" ".join(t.lower().split()).encode() for t in documents]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    lengths = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    spaces = np.flatnonzero(data == 32)
    stops = spaces  # every word ends at a space
    starts = np.concatenate([[0], stops[:-1] + 1])
    text = np.searchsorted(ends, starts)
    real = stops > starts
    starts, stops, text = starts[real], stops[real], text[real]
    n = np.bincount(text, minlength=len(parts))
    first = np.cumsum(n) - n
    rank = np.arange(len(text)) - first[text]
    lead = (rank + words <= n[text]) | (rank == 0)
    last = np.minimum(np.flatnonzero(lead) + words - 1, (first + n - 1)[text[lead]])
    h = Hasher(data).of(starts[lead], stops[last])
    t = text[lead]
    order = np.lexsort((h, t))
    h, t = h[order], t[order]
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])[: len(h)]
    h, t = h[fresh], t[fresh]
    return h, np.cumsum(np.bincount(t, minlength=len(parts)))


class MinHash:
    def __init__(self, bands: int, rows: int, seed: int = 5):
        r = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.xor = r.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + r.integers(0, 2, bands * rows, np.uint64)
        self.times = r.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)

    def buckets(self, h: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A bucket for each band of each set; sets aren't empty."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        out = np.zeros((len(ends), self.bands), np.uint64)
        for b in range(self.bands):
            key = np.full(len(ends), b, np.uint64)
            for j in range(b * self.rows, (b + 1) * self.rows):
                least = np.minimum.reduceat((h ^ self.xor[j]) * self.times[j], starts)
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
            out[:, b] = key
        return out


def set_sums(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A sum over each set that tells sets apart; 0 for an empty one."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h))])
    return sums[ends] - sums[starts]


def signatures(docs: DataFrame, minhash: MinHash, words: int) -> DataFrame:
    """doc_id, a, b, n (the key of the n-gram set) and its buckets, for documents that have n-grams."""

    def make():
        def step(batch):
            h, ends = shingles(texts(batch.column(1)), words)
            n = np.diff(np.concatenate([[0], ends]))
            has = n > 0
            if not has.any():
                return
            ends, n = ends[has], n[has]
            starts = ends - n
            ids = batch.column(0).filter(pa.array(has))
            a, b = set_sums(h, starts, ends), np.bitwise_xor.reduceat(mix(h * np.uint64(0xD6E8FEB86659FD93)), starts)
            sig = minhash.buckets(h, ends).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * minhash.bands), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(n.astype(np.int64)), lists], names=["doc_id", "a", "b", "n", "buckets"])

        return step

    return arrow_map(docs, "doc_id long, a long, b long, n long, buckets array<long>", make, GRAM_BYTES)


def fresh_pairs(sig: np.ndarray, band: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A matrix of which of left x right share this band and none before it."""
    ok = np.ones((len(left), len(right)), bool)
    for k in range(band):
        ok &= sig[left, k][:, None] != sig[right, k][None, :]
    return ok


def _grouped(df: DataFrame, ddl: str, names: list[str], work):
    """work(columns) for each (bucket, i, j) of df; groups of a task follow one another."""

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            key = np.stack([held.column(k).to_numpy() for k in ("bucket", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            if len(cut):  # the last group may go on in the next batch
                yield from batched(held.slice(0, int(cut[-1])))
                held = held.slice(int(cut[-1]))
        if held is not None and held.num_rows:
            yield from batched(held)

    def batched(t):
        rows = []
        key = np.stack([t.column(k).to_numpy() for k in ("bucket", "i", "j")])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), t.num_rows]
        rep = t.column("rep").to_numpy()
        sig = t.column("buckets").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
        extra = {n: t.column(n).combine_chunks() for n in t.column_names if n not in ("bucket", "i", "j", "rep", "buckets")}
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            if y - x > 1:
                rows += work(key[:, x], rep[x:y], sig[x:y], {n: v.slice(x, y - x) for n, v in extra.items()})
        for k in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 20_000], strict=True)], names=names)

    return df.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, ddl)


def _sides(key: np.ndarray, block: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a group: the rows of either side and the matrix of pairs that are judged here."""
    band = int(np.flatnonzero(sig[0] == key[0])[0])
    left = np.flatnonzero(block == key[1])
    right = left if key[1] == key[2] else np.flatnonzero(block == key[2])
    ok = fresh_pairs(sig, band, left, right)
    if key[1] == key[2]:
        ok &= np.triu(np.ones_like(ok), 1)
    return left, right, ok


def links_of(key: np.ndarray, rep: np.ndarray, sig: np.ndarray, block: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple]:
    """(rep, root of its links here, linked documents) of the group's pairs at or over the threshold."""
    left, right, ok = _sides(key, block, sig)
    sizes = np.array([len(s) for s in sets])
    _, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    root = np.arange(len(rep))
    links = np.zeros(len(rep), np.int64)

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    there = np.zeros(int(inverse.max()) + 1, bool)
    for row, a in enumerate(left):
        partners = right[ok[row]]
        least, most = np.minimum(sizes[a], sizes[partners]), np.maximum(sizes[a], sizes[partners])
        partners = partners[least >= threshold * most]
        if not len(partners):
            continue
        own = inverse[begin[a] : begin[a] + sizes[a]]
        there[own] = True
        n = sizes[partners]
        at = np.repeat(begin[partners] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        shared = np.add.reduceat(there[inverse[at]].astype(np.int64), np.cumsum(n) - n)
        there[own] = False
        linked = partners[shared >= threshold * (sizes[a] + n - shared) - 1e-9]
        links[a] += copies[linked].sum()
        links[linked] += copies[a]
        for b in linked:
            x, y = find(a), find(b)
            if x != y:
                x, y = (x, y) if rep[x] < rep[y] else (y, x)
                root[y] = x
    return [(int(rep[x]), int(rep[find(x)]), int(links[x])) for x in np.flatnonzero(links)]


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node of its connected component, by alternating large and small stars.

    Each round is written to the shared folder; the driver sees a count and a sum of hashes.
    """
    spark = edges.sparkSession
    now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges", spark)
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
    seen = mark(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = materialize(small.distinct(), "edges", spark)
        if (new := mark(now)) == seen:
            break
        seen = new
    return now.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root"))


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links of every document.

    A link is a pair of documents whose n-gram sets have at least the threshold of Jaccard similarity, exact copies among
    them; n_links counts a document's, and class_id is the smallest doc_id that links lead to. A null text or one without
    words has no links and is its own class, as has a row with a null doc_id, whose class is null. Repeated rows are
    documents each, and link; texts that differ under one doc_id add up their links with others. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    minhash = MinHash(*bands_and_rows(threshold, recall))
    sigs = materialize(signatures(base.where("doc_id is not null"), minhash, words), "signatures", spark)
    reps = materialize(sigs.groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("buckets").alias("buckets")), "representatives", spark)

    members = reps.select("rep", "a", "n", F.explode("buckets").alias("bucket"))
    sized = members.groupBy("bucket").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).where("m > 1")
    full = sized.select("bucket", F.least("m", F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("grams") * 8 / BLOCK_BYTES))).cast("long").alias("blocks"))
    placed = members.join(full, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("long"))
    dealt = placed.join(reps.select("rep", "a", "buckets"), ["rep", "a"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "a", "buckets")

    def need(key, rep, sig, extra):
        own = extra["block"].to_numpy()
        left, right, ok = _sides(key, own, sig)
        rows = np.union1d(left[ok.any(axis=1)], right[ok.any(axis=0)])
        a = extra["a"].to_numpy()
        return [(int(key[0]), int(key[1]), int(key[2]), int(own[x]), int(rep[x]), int(a[x])) for x in rows]

    needed = materialize(_grouped(dealt, "bucket long, i long, j long, block long, rep long, a long", ["bucket", "i", "j", "block", "rep", "a"], need), "needed", spark)

    def sets():
        def step(batch):
            h, ends = shingles(texts(batch.column(1)), words)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            sums = set_sums(h, starts, ends)
            mine = pa.array(sums.view(np.int64) == batch.column(2).to_numpy())  # another text of the same doc_id isn't it
            out = pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns)), pa.array([h[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary())], names=["rep", "a", "copies", "buckets", "grams"])
            yield out.filter(mine)

        return step

    wanted = reps.join(needed.select("rep", "a").distinct(), ["rep", "a"], "left_semi").select("rep", "a", "copies", "buckets")
    text_of = base.join(wanted, base["doc_id"] == wanted["rep"])
    with_sets = arrow_map(text_of.select("rep", "text", "a", "copies", "buckets"), "rep long, a long, copies long, buckets array<long>, grams binary", sets, GRAM_BYTES).dropDuplicates(["rep", "a"])
    judged = needed.join(with_sets, ["rep", "a"]).select("bucket", "i", "j", "block", "rep", "buckets", "copies", "grams")

    def verify(key, rep, sig, extra):
        grams = [np.frombuffer(x.as_py(), np.uint64) for x in extra["grams"]]
        return links_of(key, rep, sig, extra["block"].to_numpy(), extra["copies"].to_numpy(), grams, threshold)

    links = materialize(_grouped(judged, "rep long, root long, links long", ["rep", "root", "links"], verify), "links", spark)
    roots = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    degree = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of_rep = reps.select("a", "b", "n", "rep", "copies").join(degree, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    of_rep = of_rep.select("a", "b", "n", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    known = sigs.select("doc_id", "a", "b", "n").join(of_rep, ["a", "b", "n"]).select("doc_id", "class_id", "n_links")
    # texts without words have no signature
    bare = base.where(F.col("doc_id").isNull() | F.col("text").isNull() | ~F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.union(bare)
