"""Phrase collocation mining by suffix-sigma.

Every word of a piece begins a suffix of at most max_n words. Tasks count equal suffixes before they send them, by language
and first word; each partition is sorted in reverse lexicographic order, and one stack of the words of the last suffix counts
all prefixes, as a prefix is over once a suffix without it comes. What is frequent is kept, and the parts of a phrase are
looked up in that afterwards.

A first word or a pair of words that many suffixes begin with is dealt out further, by its next words; what one partition
counts of it is a part then, and parts are added. A sample says which words those are. It sets the balance only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlake.llm.common import estimated_bytes, materialize, prepare, shards_for, slices, text_bytes

MAX_N = 3
LEAST = 10
TOP = 2000
#: A candidate goes if a longer one that holds it has this percentage of its occurrences.
ABSORBED = 50
#: Different suffixes that a task holds before it sends them, and words of one text that it takes at a time.
HELD = 400_000
SOME_WORDS = 100_000
#: Rows that the stack takes at once.
LOT = 20_000
PARTITION_BYTES = 12_000_000
#: Words and pairs that begin so great a part of the suffixes in about SAMPLE_BYTES of text are dealt into SPLITS parts.
HOT_SHARE = 1 / 1000
SAMPLE_BYTES = 8_000_000
SPLITS = 64
#: Candidates of a language are ranked in so many parts first, one step after the other.
RANK_PARTS = (64, 4, 1)
SEP = "\t"
_END = b"\n"  # stands between pieces; no word holds it
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(b + 32 if 65 <= b <= 90 else 10 if b in _ENDS else 32 if b == 9 else b for b in range(256))
_LOW = re.compile(rb"[\x00-\x08]")
_LOW_LANG = re.compile("[\x00-\x0d]")
_ESCAPED = re.compile("\x0b[\x30-\x3d]")


def words_of(text: bytes) -> list[bytes]:
    """Words, A-Z lower-cased, with _END where a piece ends. A control sign below the tab is written as \\x0b and a letter, so
    that every word sorts after the tab that stands between words."""
    text = text.translate(_TABLE)
    if _LOW.search(text):
        text = _LOW.sub(lambda m: b"\x0b" + bytes([m[0][0] + 48]), text)
    return list(filter(None, text.replace(_END, b" \n ").split(b" ")))


def plain(s):
    """The phrase of a suffix: words with one space between them, control signs as they were."""
    s = F.translate(s, SEP, " ")
    for c in range(9):
        s = F.replace(s, F.lit(f"\x0b{chr(c + 48)}"), F.lit(chr(c)))
    return s


def _suffixes(words: list[bytes], max_n: int) -> Iterator[bytes]:
    """Runs of max_n words from every word on, without regard to the ends of pieces."""
    return map(b"\t".join, zip(*(words[k:] for k in range(max_n)), strict=False))


def _sorted_rows(lang: str, counter: Counter) -> tuple[pa.Array, np.ndarray]:
    """Suffixes, cut at the ends of pieces, in reverse lexicographic order, and their counts; an empty word counts all words."""
    keys = pa.array(list(counter), pa.binary()).cast(pa.string())
    counts = np.fromiter(counter.values(), np.int64, len(counter))
    ended = pc.match_substring(keys, "\n")
    cut: Counter[str] = Counter()
    ended_ = ended.to_numpy(zero_copy_only=False)
    for s, c in zip(keys.filter(ended).to_pylist(), counts[ended_].tolist(), strict=True):
        if not s.startswith("\n"):  # a run that begins where a piece ends is none
            cut[s[: s.index("\t\n")]] += c
    counts = counts[~ended_]
    tail = "\n" + _LOW_LANG.sub(lambda m: "\x0b" + chr(ord(m[0]) + 48), lang)
    words, rest = [tail], [int(counts.sum()) + cut.total()]
    for s, c in cut.items():
        first, sep, more = s.partition(SEP)
        words.append(first + tail + sep + more)
        rest.append(c)
    keys = pa.concat_arrays([pc.replace_substring(keys.filter(pc.invert(ended)), SEP, tail + SEP, max_replacements=1), pa.array(words, pa.string())])
    order = pc.array_sort_indices(keys, order="descending")
    return keys.take(order), np.concatenate([counts, np.array(rest, np.int64)])[order.to_numpy()]


def suffixes(docs: DataFrame, max_n: int) -> DataFrame:
    """s, c: suffixes of at most max_n words (between tabs; the first with its language), and how often a task met them before
    it sent them."""

    def sent(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counter in counts.items():
            rows, c = _sorted_rows(lang, counter)
            for a in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([rows.slice(a, 50_000), pa.array(c[a : a + 50_000])], names=["s", "c"])
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch) if batch.num_rows else ():
                for lang, text in zip(part.column(0).to_pylist(), text_bytes(part.column(1)), strict=True):
                    words = words_of(text)
                    words += [_END] * (max_n - 1)
                    for a in range(0, len(words) - max_n + 1, SOME_WORDS):
                        counts.setdefault(lang, Counter()).update(_suffixes(words[a : a + SOME_WORDS + max_n - 1], max_n))
                        if sum(map(len, counts.values())) >= HELD:
                            yield from sent(counts)
        yield from sent(counts)

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "s string, c long")


def _head(n: int):
    return F.substring_index("s", SEP, n)


def heavy(docs: DataFrame, max_n: int) -> tuple[list[str], list[str]]:
    """First words and pairs (with their language) that begin a large part of all suffixes of a sample; at most 1 / HOT_SHARE of either."""
    share = min(1.0, SAMPLE_BYTES / max(1, estimated_bytes(docs.select("lang", "text"))))
    rows = suffixes(docs.sample(share, seed=1) if share < 1 else docs, max_n)
    many = rows.select(_head(1).alias("w"), F.when(F.locate(SEP, "s") > 0, _head(2)).alias("p")).groupBy("w", "p").count()
    many = materialize(many, "suffix-sample", docs.sparkSession)
    least = many.agg(F.coalesce(F.sum("count"), F.lit(0))).head()[0] * HOT_SHARE
    words = many.groupBy("w").agg(F.sum("count").alias("n")).where(F.col("n") > least).collect()
    pairs = many.where((F.col("count") > least) & F.col("p").isNotNull()).collect()
    return [r.w for r in words], [r.p for r in pairs]


class Stack:
    """The words of the last suffix and how often each of its prefixes has occurred so far.

    Rows come in reverse lexicographic order. How many words each shares with the one before says which prefixes are over;
    those that are over within one lot of rows are counted all at once, those still open stay on the stack for the next.
    """

    def __init__(self, max_n: int, least: int, hot_words: list[str], hot_pairs: list[str]):
        self.max_n, self.least = max_n, least
        self.hot = [pa.array(hot_words, pa.string()), pa.array(hot_pairs, pa.string())]
        self.words: list[str] = []
        self.counts: list[int] = []
        self.out: list[tuple[str, str, int, int]] = []

    def _over(self, words: list[str], count: int) -> None:
        word, _, lang = words[0].partition("\n")
        lang = _ESCAPED.sub(lambda m: chr(ord(m[0][1]) - 48), lang)
        self.out.append((lang, SEP.join([word, *words[1:]]), len(words) if word else 0, count))

    def _part(self, words: list[str]) -> bool:
        """Whether other partitions count the prefix too."""
        if len(words) == 1:
            return words[0] in self.hot_set[0]
        return len(words) < self.max_n and SEP.join(words[:2]) in self.hot_set[1]

    @cached_property
    def hot_set(self) -> list[set[str]]:
        return [set(x.to_pylist()) for x in self.hot]

    def pop(self, keep: int) -> None:
        while len(self.words) > keep:
            if self.counts[-1] >= self.least or self.words[0].startswith("\n") or self._part(self.words):
                self._over(self.words, self.counts[-1])
            self.words.pop()
            self.counts.pop()

    def push(self, s: pa.Array, c: np.ndarray) -> None:
        lists = pc.split_pattern(s, SEP)
        at = lists.offsets.to_numpy().astype(np.int64)
        flat, start, k = lists.values, at[:-1], np.diff(at)
        shared = np.zeros(len(c), np.int64)
        first = s[0].as_py().split(SEP)
        while shared[0] < min(len(first), len(self.words)) and first[shared[0]] == self.words[shared[0]]:
            shared[0] += 1
        same = np.ones(len(c) - 1, bool)
        column = []
        for j in range(self.max_n):
            w = flat.take(pa.array(np.where(k > j, start + j, 0)))
            column.append(w)
            same &= pc.equal(w[1:], w[:-1]).to_numpy(zero_copy_only=False) & (k[1:] > j) & (k[:-1] > j)
            shared[1:] += same
        opened: list[int] = []
        closed = None
        for j in range(self.max_n):
            begins = np.flatnonzero(shared <= j)
            until = begins[0] if len(begins) else len(c)
            if j < len(self.counts):
                self.counts[j] += int(c[:until].sum())
            closed = j if len(begins) and closed is None else closed
            if not len(begins):
                continue
            sums = np.add.reduceat(c, begins)
            if k[begins[-1]] > j:
                opened.append(int(sums[-1]))
            here = k[begins] > j
            here[-1] = False  # the last one is open
            take = here & (sums >= self.least)
            if j == 0:
                take |= here & pc.or_(pc.is_in(column[0], self.hot[0]), pc.starts_with(column[0], "\n")).to_numpy(zero_copy_only=False)[begins]
            elif j + 1 < self.max_n and len(self.hot[1]):
                rows = pa.array(begins)
                take |= here & pc.is_in(pc.binary_join_element_wise(column[0].take(rows), column[1].take(rows), SEP), self.hot[1]).to_numpy(zero_copy_only=False)
            for i, count in zip(begins[take].tolist(), sums[take].tolist(), strict=True):
                self._over([column[x][i].as_py() for x in range(j + 1)], count)
        if closed is not None:
            self.pop(closed)
            last = int(k[-1])
            self.words = [column[x][len(c) - 1].as_py() for x in range(last)]
            self.counts = self.counts[:closed] + opened[: last - closed]


def count_phrases(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST) -> DataFrame:
    """lang, s, k, f: phrases of k words (1 to max_n) that occur f >= least times; with k = 0 the words of a language."""
    words, pairs = heavy(docs, max_n)
    at = F.when(_head(1).isin(words), F.pmod(F.xxhash64(_head(2)), F.lit(SPLITS)).cast("int")).otherwise(0)
    at = F.when(_head(2).isin(pairs), F.pmod(F.xxhash64("s"), F.lit(SPLITS)).cast("int")).otherwise(at)
    dealt = suffixes(docs, max_n).repartition(shards_for(docs, PARTITION_BYTES), _head(1), at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(max_n, least, words, pairs)

        def found() -> Iterator[pa.RecordBatch]:
            if stack.out:
                a, b, k, c = zip(*stack.out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(k, pa.int32()), pa.array(c, pa.int64())], names=["lang", "s", "k", "f"])
                stack.out.clear()

        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= LOT:
                stack.push(pa.concat_arrays([b.column(0) for b in held]), np.concatenate([b.column(1).to_numpy() for b in held]))
                held, rows = [], 0
                yield from found()
        if held:
            stack.push(pa.concat_arrays([b.column(0) for b in held]), np.concatenate([b.column(1).to_numpy() for b in held]))
        stack.pop(0)
        yield from found()

    parts = dealt.sortWithinPartitions(F.col("s").desc()).mapInArrow(run, "lang string, s string, k int, f long")
    return parts.groupBy("lang", "s", "k").agg(F.sum("f").alias("f")).where((F.col("k") == 0) | (F.col("f") >= least))


def _run_of(first, n):
    return F.array_join(F.slice("_w", first, n), SEP)


def mine(docs: DataFrame, max_n: int = MAX_N, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to max_n words.

    a: occurrences of the phrase; l and r: those of its parts at the cut of the lowest score, the earliest of equal ones; n:
    words of the language; score: floor(1000000 * a * a / (l * r)), exact. A candidate that a longer one holds goes if that
    has ABSORBED percent of its occurrences. A null lang is ``und``, as one that says so; a null or empty text has no words,
    repeated rows count each, an empty table gives no rows, and other columns are ignored. A text is read whole, a part of its
    words at a time.
    """
    spark = docs.sparkSession
    prepare(spark)
    grams = materialize(count_phrases(docs, max_n, least), "phrases", spark)
    found = grams.where("k >= 2").select("lang", "s", "k", F.col("f").alias("a")).withColumn("_w", F.split("s", SEP))
    cut = found.select("lang", "s", "a", "k", "_w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.select("lang", "s", "a", "cut", _run_of(F.lit(1), F.col("cut")).alias("left"), _run_of(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda name, count: grams.where("k > 0").select("lang", F.col("s").alias(name), F.col("f").alias(count))
    cut = cut.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = "cast((cast(a as decimal(18,0)) * cast(a as decimal(18,0)) * 1000000BD) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0))) as long)"
    scored = cut.withColumn("score", F.expr(score)).groupBy("lang", "s").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("b")).select("lang", "s", "a", "b.score", "b.l", "b.r")

    inner = found.where("k >= 3").select("lang", "a", "k", "_w", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "a", "_w", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("from"))
    inner = inner.groupBy("lang", _run_of(F.col("from"), F.col("size")).alias("s")).agg(F.max("a").alias("longer"))
    kept = scored.join(inner, ["lang", "s"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * ABSORBED))

    words = grams.where("k = 0").select("lang", F.col("f").alias("n"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    rows = kept.withColumn("phrase", plain(F.col("s")))
    for parts in RANK_PARTS:
        group = Window.partitionBy("lang", F.pmod(F.xxhash64("s"), F.lit(parts))).orderBy(*best)
        rows = rows.withColumn("rank", F.row_number().over(group).cast("long")).where(F.col("rank") <= top)
    return rows.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
