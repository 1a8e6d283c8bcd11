"""The pipeline against brute force, stage by stage and whole."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from quizlake.llm import quality

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables, with nulls, repeats, blank texts and copies of their own added."""
    out = f"file://{tmp_path_factory.mktemp('sf')}"
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(*cp.COLUMNS)
    rows = docs.orderBy("doc_id").limit(12).collect()
    more = [(None, rows[0].text, None, None, None), (9001, None, None, None, None), (9002, "", "en", "x", 0), (9003, " \n\n ", "en", "x", 4), tuple(rows[1]), (9004, rows[2].text + "\nand a last line", "en", "x", None), (None, None, None, None, None)]
    more += [(9010 + i, "\n".join([f"{r.text[:300]} {i}", "one shared line of the page", "a second shared line", "a third shared line"]), "en", "y", 1) for i, r in enumerate(rows[3:12])]
    docs.union(spark.createDataFrame(more, KINDS)).repartition(3).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def quality_brute(rows, labels):
    """Densities by explicit inverses and determinants."""
    mark = {i: q for i, q in labels if zlib.crc32(str(i).encode()) % 5}
    known = [(quality.statistics(r[1] or ""), mark[r[0]]) for r in rows if r[0] in mark]
    x, y = np.array([k[0] for k in known]), np.array([k[1] for k in known])
    covs = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    share = [(y == c).mean() for c in (0, 1)]
    pooled = share[0] * covs[0] + share[1] * covs[1]
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
    kept = []
    for r in rows:
        if not (r[1] or "").strip():
            continue
        logs = []
        for c in (0, 1):
            s = ((1 - quality.TO_POOLED) * covs[c] + quality.TO_POOLED * pooled) / np.outer(scale, scale)
            s = (1 - quality.TO_IDENTITY) * s + (quality.TO_IDENTITY * np.trace(s) / len(s) + 1e-9) * np.eye(len(s))
            z = (np.array(quality.statistics(r[1])) - x[y == c].mean(axis=0)) / scale
            logs.append(np.log(share[c]) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * z @ np.linalg.inv(s) @ z)
        if 1 / (1 + np.exp(-np.clip(quality.DAMPING * (logs[1] - logs[0]), -500, 500))) >= quality.THRESHOLD:
            kept.append(r)
    return kept


def lines_brute(rows):
    first = {}
    for r in rows:
        lines = r[1].split("\n") if r[0] is not None and r[1] is not None else []
        for k in range(len(lines) - 2):
            run = tuple(lines[k : k + 3])
            first[run] = min(first.get(run, (r[0], k)), (r[0], k))
    out = []
    for r in rows:
        lines = r[1].split("\n") if r[0] is not None and r[1] is not None else []
        gone = {k + j for k in range(len(lines) - 2) if (r[0], k) > first[tuple(lines[k : k + 3])] for j in range(3)}
        if not gone:
            out.append(r)
        elif len(gone) < len(lines):
            text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def near_brute(rows):
    grams = []
    for r in rows:
        w = (r[1] or "").lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w and r[0] is not None else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, g in enumerate(grams):
        for j in range(i):
            if g and len(g & grams[j]) >= 0.8 * len(g | grams[j]) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if grams[i]:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    gone = {r[0] for i, r in enumerate(rows) if grams[i] and least[find(i)] != r[0]}
    return [r for r in rows if r[0] not in gone]


def clean_brute(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for _, t in items:
        if w := words(t):
            n = min(10, len(w))
            windows[n] |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return [r for r in rows if not any(tuple(w[k : k + n]) in s for w in [words(r[1])] for n, s in windows.items() for k in range(len(w) - n + 1))]


def brute(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for step in (lambda x: quality_brute(x, labels), lines_brute, near_brute, lambda x: clean_brute(x, items)):
        rows = step(rows)
        yield rows


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total, sizes = docs.count(), []
    for (name, stage), want in zip(cp.STAGES, brute(spark, sf_dir), strict=False):
        docs = cp.materialize(stage(spark, docs, sf_dir), "stage", spark)
        assert docs.columns == list(cp.COLUMNS), name
        assert Counter(tuple(r) for r in docs.collect()) == Counter(want), name
        sizes.append(len(want))
    assert total > sizes[0] > sizes[2] > sizes[3] > 0  # every stage that drops documents does
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids, times = {}, Counter(r[0] for r in want)
    for r in want:
        ids[r[0]] = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
    lengths, sequences = Counter(), defaultdict(list)
    for p in cp.run(spark, sf_dir).collect():
        assert p.doc_tokens == len(ids[p.doc_id]) and p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start : p.start + p.length].tobytes())
        lengths[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert lengths == Counter({i: len(ids[i]) * n for i, n in times.items()})
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 4096


def test_why_few_near_copies_reach_the_join(spark):
    """Line dedup takes a near copy's repeated lines first: what is left of it is no near copy any more, and is kept."""
    lines = [f"line {i} of a text with quite a few words in it" for i in range(20)]
    other = [*lines[:9], "another line in the middle of the copy, all its own", *lines[10:]]
    odd = [" ".join([*x.split()[:-1], "this"]) if i % 3 == 1 else x for i, x in enumerate(lines)]  # no run of three lines is left whole
    near = " ".join(lines)
    rows = [(0, "\n".join(lines)), (1, "\n".join(other)), (2, "\n".join(odd)), (3, near), (4, near.replace("quite a few", "some", 1))]
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], KINDS)
    left = cp.drop_lines(spark, docs, SF)
    assert {r.doc_id: r.text for r in left.collect()}[1] == other[9]
    kept = {r.doc_id for r in cp.drop_near_copies(spark, left, SF).collect()}
    assert 1 in kept and 4 not in kept and cp.drop_near_copies(spark, docs, SF).where("doc_id = 1").count() == 0


def test_clashing_columns_and_empty_tables(spark, sf_dir):
    names = ["score", "_row", "_id", "__id", "_starts", "n_lines", "n_removed", "class_id", "n_links", "spans", "items", "n_hit", "_text", "rep", "quality", "item_id", "ids", "odd.name"]
    plain = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = plain.select("*", *[F.lit("z").alias(n) for n in names])
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "packing":
            assert out.columns == list(cp.COLUMNS), name
            assert out.exceptAll(stage(spark, plain, sf_dir)).count() == 0, name
        assert out.count() > 0, name
        assert stage(spark, docs.where("false"), sf_dir).count() == 0, name


def test_line_dedup_keeps_other_columns(spark):
    from quizlake.llm import line_dedup

    t = spark.createDataFrame([(i, "a\nb\nc\nd" + str(i), "x", "y", "z") for i in range(3)], "doc_id long, text string, _id string, n_lines string, `odd.name` string")
    got = line_dedup.drop_repeated_lines(t)
    assert sorted((r.doc_id, r.text, r._id, r["odd.name"], r.n_lines, r.n_removed) for r in got.collect()) == [(0, "a\nb\nc\nd0", "x", "z", 4, 0), (1, "d1", "x", "z", 4, 3), (2, "d2", "x", "z", 4, 3)]
