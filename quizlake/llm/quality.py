"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class gets a mean and a covariance that is shrunk towards the pooled one and towards a multiple of the identity. A
score is the posterior of class 1 from the difference of the two log densities: Mahalanobis distances by the cached
Cholesky factors, log determinants and priors.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import arrow_map, fold_of, materialize, prepare, texts

TO_POOLED = 0.1
TO_IDENTITY = 0.005
#: The densities of thousands of texts are surer than their fit allows; the log odds are damped by this.
DAMPING = 0.5
THRESHOLD = 0.3
_SPACE, _UPPER, _LOWER, _DIGIT, _END, _SIGN = range(6)
_KIND = np.full(256, _LOWER, np.uint8)
_KIND[:33] = _SPACE
_KIND[33:128] = _SIGN
_KIND[48:58] = _DIGIT
_KIND[65:91] = _UPPER
_KIND[97:123] = _LOWER
for _c in b".,;:'\"-?!":
    _KIND[_c] = _END
N_FEATURES = 16


def statistics(text: str) -> list[float]:
    """Numbers that say how a text is made, on scales where clean texts look roughly normal."""
    data = text.encode()
    n = len(data)
    words = text.split()
    if not words:
        return [0.0] * N_FEATURES
    kinds = np.bincount(_KIND[np.frombuffer(data, np.uint8)], minlength=6)
    k = len(words)
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [x for x in text.split("\n") if x.strip()]
    part = lambda x, of: float(np.log((x + 0.5) / (of - x + 0.5)))
    ends = sum(x.rstrip()[-1] in ".!?" for x in lines)
    signed = sum(not w[-1].isalnum() and w[-1] not in ".,;:!?" for w in words)
    return [
        np.log1p(k), np.log((n + 1) / (k + 1)), part(distinct, k), np.log((distinct + 1) / (k + 1) ** 0.8), part(pairs, max(k - 1, pairs)), part(kinds[_UPPER], n), part(kinds[_DIGIT], n), part(kinds[_END], n), part(kinds[_SIGN], n), part(signed, k),
        part(text.count("|"), k + text.count("|")), np.log(k / len(lines)), part(len(set(lines)), len(lines)), part(ends, len(lines)), np.log((len(zlib.compress(data, 1)) + 20) / (n + 20)), part(text.count("!"), n),
    ]


@dataclass
class Model:
    means: list[np.ndarray]
    factors: list[np.ndarray]  # lower Cholesky factor of each class's covariance
    log_weight: list[float]  # log prior less half the log determinant
    centre: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, weight in zip(self.means, self.factors, self.log_weight, strict=True):
            logs.append(weight - 0.5 * (np.linalg.solve(factor, (z - mean).T) ** 2).sum(axis=0))
        return 1 / (1 + np.exp(-np.clip(DAMPING * (logs[1] - logs[0]), -500, 500)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def statistics_of(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and ``_stats``, the statistics of every whole text: a row of fixed size, however long the text."""
    prepare(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    names = list(keep)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"), "_stats array<double>"])

    def make():
        def step(batch):
            x = np.array([statistics(t) for t in texts(batch.column(len(names)))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*names, "_stats"])

        return step

    return arrow_map(rows, ddl, make)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from every labelled row, as fit_statistics does; texts stay where they are and only their statistics are shuffled.

    The statistics are written first: no task then runs two Python workers, one for them and one for the sums.
    """
    return fit_statistics(materialize(statistics_of(docs, ["doc_id"]), "statistics", docs.sparkSession), labels)


def fit_statistics(stats: DataFrame, labels: DataFrame) -> Model | None:
    """Learns from every labelled row of (doc_id, _stats): tasks send sums and products of the statistics, of a fixed size each.

    None where no row or one class only is labelled. A document with several labels counts with each, repeated labels
    being counted before the join; labels other than 0 and 1, and null ids, don't count.
    """
    prepare(stats.sparkSession)
    marks = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).groupBy("doc_id", "quality").agg(F.count("*").alias("times"))
    rows = stats.select(F.col("doc_id").cast("long").alias("doc_id"), "_stats").join(marks, "doc_id").select("_stats", "quality", "times")

    def run(batches):
        d = N_FEATURES
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            y, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for c in (0, 1):
                z, w = x[y == c], times[y == c].astype(float)
                total[c] += np.concatenate([[w.sum()], w @ z, ((z.T * w) @ z).ravel()])
        yield pa.RecordBatch.from_pydict({"quality": [0, 1], "sums": [total[0].tolist(), total[1].tolist()]}, schema=pa.schema([("quality", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    each = rows.mapInArrow(run, "quality int, sums array<double>").select("quality", F.posexplode("sums").alias("i", "v"))
    d = N_FEATURES
    sums = np.zeros((2, 1 + d + d * d))
    for r in each.groupBy("quality", "i").agg(F.sum("v").alias("v")).collect():
        sums[r.quality, r.i] = r.v
    n = sums[:, 0]
    if min(n) < 1:
        return None
    mean = sums[:, 1 : 1 + d] / n[:, None]
    cov = np.array([sums[c, 1 + d :].reshape(d, d) / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = (cov * n[:, None, None]).sum(axis=0) / n.sum()
    centre, scale = mean.mean(axis=0), np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    means, factors, weights = [], [], []
    for c in (0, 1):
        s = (1 - TO_POOLED) * cov[c] + TO_POOLED * pooled
        s = s / np.outer(scale, scale)
        s = (1 - TO_IDENTITY) * s + TO_IDENTITY * max(np.trace(s) / d, 1e-6) * np.eye(d)
        factor = np.linalg.cholesky(s + 1e-9 * np.eye(d))
        means.append((mean[c] - centre) / scale)
        factors.append(factor)
        weights.append(float(np.log(n[c] / n.sum()) - np.log(np.diag(factor)).sum()))
    return Model(means, factors, weights, centre, scale)


def _scores(x: np.ndarray, model: Model | None) -> np.ndarray:
    """Only a text without words has 0 as its first statistic."""
    return np.full(len(x), 0.5) if model is None else np.where(x[:, 0] > 0, model.score(x), 0.0)


def score_statistics(stats: DataFrame, model: Model | None, keep: list[str] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and score of every row of a table with _stats, as score gives it."""
    rows = stats.select(*keep, "_stats")
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_stats"), "score double"])

    def make():
        def step(batch):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(_scores(_matrix(batch.column(batch.num_columns - 1)), model), pa.float64())], names=[*keep, "score"])

        return step

    return arrow_map(rows, ddl, make)


def score(docs: DataFrame, model: Model | None, keep: list[str] = ()) -> DataFrame:
    """The columns of ``keep`` and score, 0 to 1, of every whole text; 0 for a null or blank text, 0.5 for all without a model."""
    prepare(docs.sparkSession)
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    names = list(keep)
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text"), "score double"])

    def make():
        def step(batch):
            t = texts(batch.column(len(names)))
            p = _scores(np.array([statistics(x) for x in t]), model)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], names=[*names, "score"])

        return step

    return arrow_map(rows, ddl, make)


def learnable(labels: DataFrame) -> DataFrame:
    """Labels to learn from: those whose crc32(doc_id as text) mod 5 isn't 0."""
    return labels.where(fold_of(F.col("doc_id"), 5) != 0)
