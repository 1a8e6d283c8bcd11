"""Language identification by cross-parsing.

For each language a suffix automaton holds every substring of a sample of its labelled text. A text is cut greedily into the
longest phrases that the automaton knows, over word bounds as they come; the fewer the phrases, the closer the text is to the
language. The count is normalised by log2 of the sample's length over the letters parsed: the cross-parsing entropy in bits a
letter. Texts of a batch are parsed side by side, a letter of each in each automaton at a time.
"""

from __future__ import annotations

import math
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import arrow_map, fold_of, prepare, texts

#: Bounds of training: documents sampled of each language, and letters of each language's automaton.
SAMPLE_DOCS = 2000
TRAIN_LETTERS = 50_000
#: Languages that a model may have, as the driver and every task hold each one's letters. More are refused, not left out.
MOST_LANGUAGES = 500
#: The sample is dealt by lines, cut to at most so many letters, so that no long text fills it alone.
PIECE_LETTERS = 400
UNKNOWN = "und"
#: Texts parsed side by side; fewer than this many at a time are parsed one by one.
SIDE_BY_SIDE = 64
#: The most table cells of all automata; beyond it texts are parsed through the automata's own maps.
MOST_CELLS = 40_000_000
_KINDS: list[np.ndarray] = []


def _kinds() -> np.ndarray:
    """2 for each code point that is a letter, 1 for a mark, else 0; made once in a process."""
    if not _KINDS:
        _KINDS.append(np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8))
    return _KINDS[0]


def plain(text: str) -> str:
    """The letters and marks of a text in lower case, whatever lies between as one space; empty if there is no letter."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[cp]
    if not (kind == 2).any():
        return ""
    word = kind > 0
    keep = word | np.concatenate([[False], word[:-1]])
    return np.where(word, cp, 32)[keep].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").rstrip(" ")


class SuffixAutomaton:
    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.letters = sum(map(len, pieces))
        last = 0
        for ch in "\n".join(pieces):  # no text parsed holds a line end, so no phrase runs over two pieces
            last = self._extend(last, ch)

    def _state(self, length: int, link: int, go: dict[str, int]) -> int:
        self.next.append(go)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, ch: str) -> int:
        cur = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and ch not in self.next[p]:
            self.next[p][ch] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][ch]
            if self.length[q] == self.length[p] + 1:
                self.link[cur] = q
            else:
                copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
                while p >= 0 and self.next[p].get(ch) == q:
                    self.next[p][ch] = copy
                    p = self.link[p]
                self.link[q] = self.link[cur] = copy
        return cur

    def phrases(self, text: str) -> int:
        """Longest-match phrases of a text; a letter that the language doesn't have is one by itself."""
        go, root = self.next, self.next[0]
        n, at = 0, root
        for ch in text:
            to = at.get(ch)
            if to is None:
                n += at is not root
                to = root.get(ch)
                if to is None:
                    n += 1
                    at = root
                    continue
            at = go[to]
        return n + (at is not root)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, letters: int = TRAIN_LETTERS) -> dict[str, list[str]]:
    """The training pieces of each language, from rows (doc_id, text, lang).

    Of at most about ``sample_docs`` documents of a language, chosen by a hash of the id, the lines in the order of a hash
    up to ``letters`` letters. A line that several documents share counts once. The driver gets about twice that much.
    More than MOST_LANGUAGES different values of lang are a ValueError that says so: such a column needs to be cleaned first.
    """
    rows = docs.where("lang is not null and text is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per = rows.groupBy("lang").agg(F.count("*").alias("n"))
    counted = per.limit(MOST_LANGUAGES + 1).collect()
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} different values, such as {sorted(r.lang for r in counted)[:5]}")
    share = F.broadcast(docs.sparkSession.createDataFrame([(r.lang, sample_docs / r.n) for r in counted], "lang string, part double"))  # a row for each language
    chosen = rows.join(share, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.col("part") * 1_000_000)

    def make():
        def step(batch):
            langs, pieces = [], []
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                for line in text.split("\n"):
                    line = plain(line)
                    parts = [line[i : i + PIECE_LETTERS] for i in range(0, len(line), PIECE_LETTERS)]
                    langs += [lang] * len(parts)
                    pieces += parts
            if pieces:
                yield pa.RecordBatch.from_pydict({"lang": langs, "piece": pieces})

        return step

    distinct = arrow_map(chosen.select("lang", "text"), "lang string, piece string", make).distinct().withColumn("h", F.xxhash64("piece"))
    total = distinct.groupBy("lang").agg(F.sum(F.length("piece")).alias("total"))
    wanted = F.pmod(F.col("h"), F.lit(1_000_000)) < F.lit(2e6 * letters) / F.col("total")
    out: dict[str, list[str]] = {}  # of MOST_LANGUAGES at most
    left: dict[str, int] = {}
    for r in sorted(distinct.join(F.broadcast(total), "lang").where(wanted).select("lang", "h", "piece").collect()):
        if left.setdefault(r.lang, letters) > 0:
            out.setdefault(r.lang, []).append(r.piece[: left[r.lang]])
            left[r.lang] -= len(r.piece)
    return out


class Parser:
    def __init__(self, model: dict[str, list[str]]):
        self.langs = sorted(k for k, v in model.items() if v)
        self.automata = [SuffixAutomaton(model[k]) for k in self.langs]
        self.bits = np.array([math.log2(max(2, a.letters)) for a in self.automata])
        signs = sorted({ch for a in self.automata for ch in a.next[0]} - {"\n"})
        self.width = len(signs) + 1  # the first column is for letters that no language has
        self.code = np.zeros(0x110000, np.uint16 if self.width < 1 << 16 else np.uint32)
        self.code[[ord(x) for x in signs]] = np.arange(1, self.width)
        states = sum(len(a.next) for a in self.automata)
        self.table = None
        if states * self.width <= MOST_CELLS:
            self.table = np.full((states, self.width), -1, np.int32)
            self.roots = np.cumsum([0, *(len(a.next) for a in self.automata)])[:-1]
            place = {x: i for i, x in enumerate(signs, 1)}
            for first, a in zip(self.roots.tolist(), self.automata, strict=True):
                for s, go in enumerate(a.next):
                    for ch, to in go.items():
                        if ch != "\n":
                            self.table[first + s, place[ch]] = first + to

    def counts(self, plains: list[str]) -> np.ndarray:
        """The phrases of each text in each language."""
        out = np.zeros((len(plains), len(self.langs)), np.int64)
        if self.table is None:
            for i, x in enumerate(plains):
                out[i] = [a.phrases(x) for a in self.automata]
            return out
        order = np.argsort([-len(x) for x in plains], kind="stable")
        lengths = np.array([len(plains[i]) for i in order], np.int64)
        codes = self.code[np.frombuffer("".join(plains[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        found = np.zeros((len(plains), len(self.langs)), np.int64)
        state = np.broadcast_to(self.roots, found.shape).copy()
        flat, width = self.table.ravel(), self.width
        active, at = len(plains), 0
        while active and lengths[active - 1] <= at:
            active -= 1
        while active >= SIDE_BY_SIDE:
            ch = codes[starts[:active] + at][:, None].astype(np.int64)
            to = flat[state[:active] * width + ch]
            doc, lang = np.nonzero(to < 0)
            if len(doc):
                begun = state[doc, lang] != self.roots[lang]
                again = flat[self.roots[lang] * width + ch[doc, 0]]
                found[doc, lang] += begun.astype(np.int64) + (again < 0)
                to[doc, lang] = np.where(again < 0, self.roots[lang], again)
            state[:active] = to
            at += 1
            while active and lengths[active - 1] <= at:
                active -= 1
        found += state != self.roots
        for k in range(active):  # a few long texts are left: one by one, on from where each is
            text = plains[order[k]][at:]
            for j, a in enumerate(self.automata):
                found[k, j] += self._rest(a, int(state[k, j] - self.roots[j]), text)
        out[order] = found
        return out

    @staticmethod
    def _rest(a: SuffixAutomaton, state: int, text: str) -> int:
        """The phrases that a text adds to one that stands in a state, whose open phrase is counted."""
        for i, ch in enumerate(text):
            to = a.next[state].get(ch)
            if to is None:
                return a.phrases(text[i:])
            if not state:
                return a.phrases(text[i:])
            state = to
        return 0

    def predict(self, batch: list[str]) -> list[tuple[str, float]]:
        plains = [plain(x) for x in batch]
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(batch)
        entropy = self.counts(plains) * self.bits / np.maximum(1, [len(x) for x in plains])[:, None]
        best = entropy.argmin(axis=1)
        odds = np.exp((entropy.min(axis=1)[:, None] - entropy) * 4).sum(axis=1)
        return [(self.langs[b], 1 / o) if x else (UNKNOWN, 0.0) for x, b, o in zip(plains, best.tolist(), odds.tolist(), strict=True)]


_PARSERS: dict[int, tuple[dict, Parser]] = {}


def parser(model: dict[str, list[str]]) -> Parser:
    """One parser for each worker process; another model takes its place."""
    key = hash(tuple((k, tuple(v)) for k, v in sorted(model.items())))
    if key not in _PARSERS or _PARSERS[key][0] != model:
        _PARSERS.clear()
        _PARSERS[key] = model, Parser(model)
    return _PARSERS[key][1]


def identify(docs: DataFrame, model: dict[str, list[str]], keep: list[str] = ()) -> DataFrame:
    """The columns of ``keep``, lang_pred and score of every whole text.

    ``und`` with score 0 where the text is null or holds no letter (a code point of a category L), or where no language was
    learned; ties go to the language that sorts first; repeated rows are judged each; an empty table gives no rows. The
    model is bounded by TRAIN_LETTERS for each language. Columns of ``keep`` may have any name but those of the results.
    """
    prepare(docs.sparkSession)
    names = [f"c{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col("text").cast("string").alias("t"))
    ddl = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "t"), "lang_pred string, score double"])

    def make():
        p = parser(model)

        def step(batch):
            got = p.predict(texts(batch.column(len(names))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=[*names, "lang_pred", "score"])

        return step

    return arrow_map(rows, ddl, make).toDF(*keep, "lang_pred", "score")


def learnable(docs: DataFrame) -> DataFrame:
    """Rows to learn from: those whose crc32(doc_id as text) mod 3 isn't 1. A null id is held out of learning."""
    return docs.where(fold_of(F.col("doc_id"), 3) != 1)
