"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words and its runs of five words, weighted by how often they occur. For each of SAMPLES draws a
term has two gamma variates r and c and a uniform b, all from its hash; with t = floor(ln(weight) / r + b) its cost is
ln(c) - r * (t + 1 - b), and the draw takes the term of the lowest cost, with its t. Two texts take the same one with a
probability of their generalised Jaccard similarity: the sum of the lesser weights over that of the greater.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import arrow_map, materialize, prepare, shards_for, slices, texts

SAMPLES = 64
WORDS = 5
#: Weight of one occurrence of a word, where a run of words has 1: short texts have few runs.
WORD_WEIGHT = 0.25
PARTITION_BYTES = 24_000_000
#: Terms whose costs are made at a time.
BLOCK = 1024
#: Text that is signed at once.
SIGNED_BYTES = 500_000


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2 at the middles of n equal parts, by bisection of 1 - (1 + x) / e**x."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


# Of a hash of 32 bits the high 16 stand for c, then 8 for r and the low 8 for b.
_LN_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)
_R = _gamma_quantiles(256).astype(np.float32)
_RNG = np.random.Generator(np.random.PCG64(12))
_TIMES = _RNG.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
_PLACES = _RNG.integers(1 << 63, 1 << 64, WORDS, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _costs(high: np.ndarray, ln_w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln(c) - r * (t + 1 - b), a row for each term and a column for each draw, and t. high: 32 bits of the terms' hashes, as a
    column or for each draw; ln_w: None if all are 0, as t is then."""
    x = high * _TIMES
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    r = _R.take((x >> np.uint32(8)) & np.uint32(0xFF), mode="clip")  # clip only spares a check; all numbers are in the table
    b = (x & np.uint32(0xFF)).astype(np.float32)
    b *= np.float32(1 / 256)
    b += np.float32(1 / 512)
    t = None
    if ln_w is not None:
        t = ln_w / r
        t += b
        np.floor(t, out=t)
        b -= t
    b -= np.float32(1)
    b *= r
    b += _LN_C.take(x >> np.uint32(16), mode="clip")
    return b, t


def terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's terms, each once, and their weights. A text of fewer than five words has one run, of all."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    counts = Counter(words)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    word = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, counts)), ">u8").astype(np.uint64)
    placed = _mixed(word * _PLACES[:, None])  # of each word at each place of a run
    number = dict(zip(counts, range(len(counts)), strict=True))
    x = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    size = min(WORDS, len(x))
    runs = np.zeros(len(x) - size + 1, np.uint64)
    for k in range(size):
        runs += placed[k].take(x[k : k + len(runs)])
    runs = np.sort(_mixed(runs))
    new = runs[1:] != runs[:-1]
    if new.all():
        return np.concatenate([word, runs]), np.concatenate([WORD_WEIGHT * n, np.ones(len(runs))])
    first = np.flatnonzero(np.concatenate([[True], new]))
    return np.concatenate([word, runs[first]]), np.concatenate([WORD_WEIGHT * n, np.diff(first, append=len(runs))])


def sign_all(texts_: list[str]) -> np.ndarray:
    """A row for each text, with a number of 16 bits for each draw; zeros for a text without words.

    The terms of all texts stand one after the other, first those of another weight than 1, and are drawn a block at a time.
    """
    found = [terms(x) for x in texts_]
    every, weight = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    owner = np.repeat(np.arange(len(texts_)), [len(f[0]) for f in found])
    least, taken = np.full((len(texts_), SAMPLES), np.inf, np.float32), np.zeros((len(texts_), SAMPLES), np.int64)
    ln_w = np.log(weight).astype(np.float32)
    high = (every >> np.uint64(32)).astype(np.uint32)
    for plain in (False, True):
        of = np.flatnonzero((ln_w == 0) == plain)
        for a in range(0, len(of), BLOCK):
            places = of[a : a + BLOCK]
            cost, _ = _costs(high[places][:, None], None if plain else ln_w[places][:, None])
            text = owner[places]
            new = np.ones(len(text), bool)
            np.not_equal(text[1:], text[:-1], out=new[1:])
            begins, which = np.flatnonzero(new), np.cumsum(new) - 1
            now = np.minimum.reduceat(cost, begins, axis=0)
            hit = np.flatnonzero(cost == now[which])[::-1]
            at = np.empty(now.shape, np.int64)
            at[which[hit // SAMPLES], hit % SAMPLES] = places[hit // SAMPLES]  # of several the first
            text = text[begins]
            better = now < least[text]
            least[text], taken[text] = np.where(better, now, least[text]), np.where(better, at, taken[text])
    out = np.zeros(least.shape, np.uint16)
    some = np.isfinite(least[:, 0])
    if some.any():
        won = every[taken[some]]
        _, t = _costs((won >> np.uint64(32)).astype(np.uint32), ln_w[taken[some]])
        drawn = _mixed(won + _mixed(t.astype(np.int64).view(np.uint64) + np.uint64(1)))
        out[some] = (drawn >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
    return out


def encode(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u2").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The part of the draws that took the same; an estimate of the generalised Jaccard similarity."""
    return float(np.count_nonzero(a == b)) / SAMPLES


def fingerprint(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and fingerprint, of each row by itself. A null text is an empty one; texts without words are alike."""
    prepare(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)])

    def make():
        def step(batch):
            signed = pa.array(map(encode, sign_all(texts(batch.column(0)))), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], signed], names=[*names, "fingerprint"])

        return step

    ddl = ", ".join([*(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema[1:], strict=True)), "fingerprint string"])
    return arrow_map(rows, ddl, make).toDF(*keep, "fingerprint")


_FIELDS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts_: list[str], afters: list[str]) -> list[tuple]:
    """The results of texts and the ones after them."""
    halves = [len(x) // 2 for x in texts_]
    edited = [x[: len(x) - h] + after[:h] for x, after, h in zip(texts_, afters, halves, strict=True)]
    own, next_, of_edited = (sign_all(x) for x in (texts_, afters, edited))
    return _rows(ids, texts_, edited, own, of_edited, next_)


def _rows(ids: list, texts_: list[str], edited: list[str], own: np.ndarray, of_edited: np.ndarray, next_: np.ndarray) -> list[tuple]:
    return [(i, len(x), hashlib.sha256(e.encode()).hexdigest(), encode(a), encode(b), likeness(a, b), likeness(a, c)) for i, x, e, a, b, c in zip(ids, texts_, edited, own, of_edited, next_, strict=True)]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text of a document is its own with the last half, rounded down, replaced by as many first signs of the next
    document. Documents are in order of doc_id, nulls first, those of one id by a hash of their text; after the last comes the
    first. A null text is an empty one; texts without words are alike (1) and unlike others (0); an empty table gives no rows;
    other columns are ignored. Texts of any length are taken whole; a task holds two of the longest at a time.

    Texts are dealt once, in ranges of doc_id. Each task compares neighbours; the last document of a range meets the first of
    the next one afterwards, for which the driver holds a number for each range.
    """
    spark = docs.sparkSession
    prepare(spark)
    order = ["doc_id", "_h", "_m"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"_h": F.xxhash64("text"), "_m": F.monotonically_increasing_id()})  # the last one splits rows that are the same
    rows = rows.repartitionByRange(shards_for(docs, PARTITION_BYTES), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def table(found: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        """Results, and rows (which, part, doc_id, text) of a range's first and last document."""
        columns = [pa.array([x[k] for x in found] + [None] * len(edges), kind) for k, kind in enumerate(_FIELDS.values())]
        edge = [pa.array([None] * len(found) + [x[k] for x in edges], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([*columns, *edge], names=[*_FIELDS, "edge", "part", "edge_id", "edge_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, signed = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for some in slices(batch, SIGNED_BYTES) if batch.num_rows else ():
                ids, texts_ = some.column(0).to_pylist(), some.column(1).to_pylist()
                edge = [] if last else [("first", part, ids[0], texts_[0])]
                if last:
                    ids, texts_ = [last[0], *ids], [last[1], *texts_]
                edited = [x[: len(x) - len(x) // 2] + y[: len(x) // 2] for x, y in zip(texts_, texts_[1:], strict=False)]
                own = sign_all(texts_[1:] if last else texts_)
                own = np.concatenate([signed, own]) if last else own
                of_edited = sign_all(edited) if edited else own[:0]
                last, signed = (ids[-1], texts_[-1]), own[-1:]
                yield table(_rows(ids[:-1], texts_[:-1], edited, own[:-1], of_edited, own[1:]), edge)
        if last is not None:
            yield table([], [("last", part, *last)])

    done = materialize(rows.mapInArrow(run, f"{_RESULT}, edge string, part int, edge_id long, edge_text string"), "fingerprints", spark, compression="zstd")
    parts = sorted(r.part for r in done.where("edge = 'first'").select("part").collect())
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, then int")
    first = done.where("edge = 'first'").select(F.col("part").alias("then"), F.col("edge_text").alias("after"))
    ends = done.where("edge = 'last'").select("part", F.col("edge_id").alias("doc_id"), F.col("edge_text").alias("text")).join(after, "part").join(first, "then").select("doc_id", "text", "after")

    def make():
        def step(batch):
            found = _compared(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(_FIELDS.values())], names=list(_FIELDS))

        return step

    return done.where("edge is null").select(*_FIELDS).unionByName(arrow_map(ends, _RESULT, make))
