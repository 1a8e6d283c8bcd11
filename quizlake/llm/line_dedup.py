"""Line dedup by winnowing over line hashes.

A document is a sequence of line hashes. Of every ``run`` consecutive lines the smallest hash is selected, so any run of
that many lines that occurs twice has the same fingerprint at the same place in both. Only the selected positions are
dealt, each with the runs that selected it, which lie before and behind it. They are joined on the fingerprint first, which
leaves few: those whose fingerprint occurs at two positions or more. Their runs are then compared by 128 bits made of the
SHA-256 of each line, however many fingerprints collide, and a line goes if it lies in a run that occurs earlier: in a
smaller doc_id, or further up in the same document. Overlapping runs add up, so matches extend both ways as far as they hold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import arrow_map, free_name, materialize, prepare

RUN = 3
#: Where it is asked for, a shorter run counts as well from so many words.
WORDS = 50
_STEPS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)


def lines_of(text: str) -> list[str]:
    return text.split("\n")


def line_digests():
    """Of each line of column text half its SHA-256, in the JVM."""
    return F.transform(F.split("text", "\n"), lambda x: F.unhex(F.substring(F.sha2(x, 256), 1, 32)))


def fingerprints(digests: np.ndarray) -> np.ndarray:
    """What lines are selected by: 64 bits of each digest."""
    return (digests ^ (digests >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _words(lists: pa.ListArray) -> np.ndarray:
    """The digests of all lines, two words each."""
    flat = lists.flatten().cast(pa.binary(16))
    return np.frombuffer(flat.buffers()[1], np.uint64, 2 * len(flat), 16 * flat.offset).reshape(-1, 2) if len(flat) else np.zeros((0, 2), np.uint64)


def line_words():
    """Per-line numbers of words of column text, parted by white space, in the JVM."""
    return F.transform(F.split("text", "\n"), lambda x: F.regexp_count(x, F.lit(r"\S+")))


def repeated_runs(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """doc_id and spans: first line and number of lines of the runs that occurred earlier.

    Runs are of ``run`` lines and, with ``words``, of fewer lines that hold at least so many words.
    """
    h = docs.where("doc_id is not null and text is not null").select("doc_id", line_digests().alias("h"), *([] if words is None else [line_words().alias("w")]))
    sizes = [run] if words is None else range(1, run + 1)

    def winnow():
        def step(batch):
            ids, lists = batch.column(0), batch.column(1)
            lengths = np.diff(lists.offsets.to_numpy())
            flat = _words(lists)
            begin = np.concatenate([[0], np.cumsum(lengths)])
            text = np.repeat(np.arange(len(lengths)), lengths)
            mixed = fingerprints(flat[:, 0])
            if words is not None:
                so_far = np.concatenate([[0], np.cumsum(batch.column(2).flatten().to_numpy(zero_copy_only=False))])
            for size in sizes:
                n = len(flat) - size + 1
                if n <= 0:
                    continue
                least, place, whole = mixed[:n].copy(), np.arange(n), flat[:n] + np.uint64(size)  # two words: a pair of lines alike in one differs in the other
                for j in range(1, size):
                    less = mixed[j : j + n] < least  # a tie goes to the left
                    least, place = np.where(less, mixed[j : j + n], least), np.where(less, np.arange(j, j + n), place)
                    whole = (whole ^ (whole >> np.uint64(31))) * _STEPS + flat[j : j + n]
                whole ^= whole >> np.uint64(32)
                inside = np.arange(n) - begin[text[:n]] + size <= lengths[text[:n]]
                if size < run:
                    inside &= so_far[size:] - so_far[:n] >= words
                starts = np.flatnonzero(inside)
                if not len(starts):
                    continue
                # windows of one minimum follow one another: a row for each minimum, with the windows it is selected by
                new = np.flatnonzero(np.concatenate([[True], (place[starts][1:] != place[starts][:-1]) | (np.diff(starts) > 1)]))
                first, doc = starts[new], text[starts[new]]
                cuts = pa.array(np.append(new, len(starts)).astype(np.int32))
                windows = [pa.ListArray.from_arrays(cuts, pa.array(np.ascontiguousarray(whole[starts, k]).view(np.int64))) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array((first - begin[doc]).astype(np.int32)), pa.array(np.full(len(first), size, np.int32)), pa.array((least[first] + np.uint64(size)).view(np.int64)), *windows], names=["doc_id", "at", "lines", "mark", "a", "b"])

        return step

    places = materialize(arrow_map(h, "doc_id long, at int, lines int, mark long, a array<long>, b array<long>", winnow), "line-minima", docs.sparkSession)
    # a minimum met once needs no look at its windows; the others are few, and their windows reach both ways around them
    # the other key keeps the count's shuffle apart from the join's, so that Spark can split the rows of a very common line
    again = places.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select(F.bitwise_not("mark").alias("key"))
    near = materialize(places.join(again, F.bitwise_not("mark") == F.col("key"), "left_semi"), "line-places", docs.sparkSession)
    runs = near.select("doc_id", "lines", "mark", "at", F.posexplode(F.arrays_zip("a", "b")).alias("j", "run")).select("doc_id", "lines", "mark", (F.col("at") + F.col("j")).alias("at"), "run.a", "run.b")
    # the earliest place of each run, counts summed before the shuffle; a run met once needs no join
    key = ["mark", "a", "b"]
    first = runs.groupBy(*key).agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").select(*key, "first")
    later = runs.join(first, key).where(F.struct("doc_id", "at") > F.col("first"))
    return later.groupBy("doc_id").agg(F.collect_set(F.struct("at", "lines")).alias("spans"))


def drop_repeated_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """The columns of docs (doc_id, text and any others) with kept text, n_lines, n_removed.

    Lines are what line feeds part; an empty text is one empty line, a null text stays null with no lines, and a row with a
    null doc_id is kept as it is. A text of fewer than ``run`` lines loses nothing, unless ``words``
    is given: then a run of fewer lines that holds at least so many words is a repeat as well. Rows that share a doc_id are one
    document to the order: what repeats between them at the same line stays. An empty table gives no rows. Columns of docs
    that are named n_lines or n_removed give way to the results.
    """
    prepare(docs.sparkSession)
    base = docs.drop("n_lines", "n_removed").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    found = repeated_runs(base, run, words)
    names = base.columns
    other, spans = free_name(names, "_id"), free_name(names, "_spans")
    joined = base.join(found.select(F.col("doc_id").alias(other), F.col("spans").alias(spans)), F.col("doc_id") == F.col(other), "left")
    plain = [f"c{i}" for i in range(len(names))]  # a column's name may hold a dot
    ddl = ", ".join([*(f"{c} {f.dataType.simpleString()}" for c, f in zip(plain, base.schema, strict=True)), "n_lines long, n_removed long"])
    at = names.index("text")

    def cut():
        def step(batch):
            kept, total, removed = [], [], []
            for text, runs in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                if text is None:
                    kept.append(None), total.append(0), removed.append(0)
                    continue
                lines = lines_of(text)
                gone = {x["at"] + j for x in runs or () for j in range(x["lines"])}
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
                total.append(len(lines))
                removed.append(len(gone))
            cols = [pa.array(kept, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=[*plain, "n_lines", "n_removed"])

        return step

    return arrow_map(joined.select(*[F.col(f"`{n}`").alias(c) for n, c in zip(names, plain, strict=True)], spans), ddl, cut).toDF(*names, "n_lines", "n_removed")
