"""The corpus operators against brute force, on rows with nulls, empty and long texts, repeats, and extra columns."""

import hashlib
import inspect
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quizlake.llm import common, decontamination, html_text, language, line_dedup, ngram_join, packing, quality, substring_dedup, token_files, vector_search

DOCS = "doc_id long, text string, lang string, n_bytes int, start string, rep int, first string, at int"


def rows_of(texts, first=0):
    return [(first + i, t, "en", 1, "x", 2, "y", 3) for i, t in enumerate(texts)]


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    line = lambda: " ".join(word() for _ in range(r.randint(3, 12)))
    base = ["\n".join(line() for _ in range(r.randint(1, 9))) for _ in range(40)]
    near = [b.replace(b.split()[3], "zzz", 1) if len(b.split()) > 60 else b for b in base[:15]]
    mixed = [base[i] + "\n" + base[i + 1][:120] for i in range(10)]
    odd = [None, "", " ", "\n\n", "a", "one two three four", base[0], base[0], "ab " * 4000, "ab " * 4000 + "c", "x" * 3000, "naïve 👩‍👩‍👧 ok", "a\x00b\x1cc  d", "<|endoftext|> hi", "x <|EndOfText|>y<|startoftext|>", "²½ ①Ⅷ 7", "हिन्दी में लिखा"]
    return rows_of([*base, *near, *mixed, *odd]) + [(None, base[0], None, 1, "x", 2, "y", 3), (None, None, None, 1, "x", 2, "y", 3), (3, base[3], "en", 1, "x", 2, "y", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def ids_of(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    encode = ids_of("word_bpe_49k.json")
    rows = packing.pack(docs, path, capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4")))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    got = sorted(sum((b.tolist() for _, b in sorted(v, key=lambda x: x[0])), []) for k, v in by_doc.items() if k[0] is not None and k[0] != 3)
    assert got == sorted(encode(x[1]) for x in corpus() if x[0] is not None and x[0] != 3)
    assert sum(r.length for r in rows) == sum(len(encode(x[1])) for x in corpus())
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    assert packing.pack(empty, path).count() == 0


def test_differencing_is_even_and_whole():
    r = random.Random(1)
    sizes = [r.randint(1, 1024) for _ in range(600)]
    window, k = packing.spread(sizes, 4096)
    loads = np.bincount(window, sizes, k)
    assert loads.sum() == sum(sizes) and loads.max() <= 4096
    assert loads.max() - loads.min() < 200
    assert packing.spread([4000, 4000, 200, 200], 4096)[1] == 3


def _packed(sizes, **more):
    """Tokens and windows of full groups, by the operator's own settings."""
    settings = {k: v.default for k, v in inspect.signature(packing.pack).parameters.items() if k in ("capacity", "windows", "largest", "slack")} | more
    packer, used, windows = packing.Packer(0, **settings), 0, 0
    for k, n in enumerate(sizes):
        for _, _, ids, _, window, _ in packer.add(k, np.zeros(n, np.uint32)):
            used, windows = used + len(ids), max(windows, window + 1)
    return used, windows


def test_padding_is_little(spark):
    """Documents of the given lengths, about four signs a token: under half a percent of full groups is padding."""
    lengths = [1 + (r.n_chars or 0) // 4 for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").orderBy("doc_id").limit(6000).select("n_chars").collect()]
    used, windows = _packed(lengths)
    assert windows >= 512 and 1 - used / (windows * packing.CAPACITY) < 0.005


def test_many_tiny_documents_take_little_memory():
    tracemalloc.start()
    used, windows = _packed(itertools.repeat(1, 1_000_000))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6 and windows >= 128 and 1 - used / (windows * packing.CAPACITY) < 0.005


def test_quality(spark, docs, empty):
    from quizlake.llm.queries import op2_quality

    good = op2_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out")
    n, right = good.agg(F.count("*"), F.count_if(F.col("predicted") == F.col("quality"))).head()
    assert right > 0.95 * n
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0), (5, None, 0), (None, 1, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model, ["doc_id", "text"]).collect()
    assert len(got) == len(corpus()) and all(0 <= x.score <= 1 for x in got)
    assert all(x.score == 0 for x in got if not (x.text or "").strip())
    stats = quality.statistics_of(docs, ["doc_id"])
    assert sorted((str(x.doc_id), round(x.score, 9)) for x in quality.score_statistics(stats, model).collect()) == sorted((str(x.doc_id), round(x.score, 9)) for x in got)
    twice = quality.fit(docs, labels.union(labels.where("doc_id is not null")))
    assert np.allclose(twice.factors, model.factors) and np.allclose(twice.means, model.means)
    assert quality.fit(empty, labels) is None and quality.score(empty, None, ["doc_id"]).count() == 0


def test_token_files(docs, empty):
    encode = ids_of("byte_bpe_50k.json")
    files = token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"))
    got = token_files.read_token_files(files).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((x[0] for x in corpus()), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens * 4 == len(r.ids)
        at += r.n_tokens
    want = sorted((x[0], zlib.crc32(np.array(encode(x[1]), "<u4").tobytes())) for x in corpus() if x[0] is not None)
    assert sorted((r.doc_id, zlib.crc32(r.ids)) for r in got if r.doc_id is not None) == want
    empty_files = token_files.write_token_files(empty, public_tokenizers.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(empty_files).count() == 0


def test_any_token_is_addressed():
    ids = np.random.default_rng(0).choice([0, 5, 255, 256, 50_000, 70_000, 2**31], 5000).astype(np.uint32)
    f = token_files.TokenFile(token_files.write_file([7, None], [2000, 3000], ids))
    assert f.doc_ids == [7, None] and (f.ids(0, 5000) == ids).all()
    assert all(f.token(i) == ids[i] for i in range(0, 5000, 7))
    assert (f.document(1) == ids[2000:]).all()
    assert all((f.ids(a, b) == ids[a:b]).all() for a, b in [(0, 0), (5000, 5000), (511, 513), (512, 1024), (4999, 5000), (7, 4000)])
    for n in (0, 1, 512, 1024):
        one = token_files.TokenFile(token_files.write_file([1], [n], np.full(n, 2**31, np.uint32)))
        assert (one.document(0) == 2**31).all() and len(one.document(0)) == n


def test_vector_search(spark):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.normal(size=8)]) for i in range(700)] + [(700, None), (701, []), (702, [None] * 8), (703, [float("nan")] * 8), (704, [1.0] * 3), (None, [1.0] * 8), (5, [0.5] * 8), (20, [0.1] * 8), (720, [3e6] * 8), (721, [0.0] * 8), (722, [0.0] * 8), (723, [1e300] * 8), (724, [-1e300, *[1e10] * 7]), (740, [1e10, *[-1e-3] * 7]), (40, [0.2, *[-0.5] * 7]), (40, [2.0] * 3)]
    t = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for x in vector_search.search(t, lambda i: F.pmod(i, F.lit(20)) == 0, k=5, shard_vectors=100).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    whole = [(i, [int(x) * 64 if abs(x) > 2**53 else math.floor(64 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    for q in {i for i, _ in whole if i % 20 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for p, v in whole if p == q for i, w in whole if i != q and len(w) == len(v))[:5]
        assert sorted(got.pop(q)) == [(k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)], q
    assert not got
    assert vector_search.search(t.where("vec_id < 0"), lambda i: F.pmod(i, F.lit(20)) == 0).count() == 0
    assert vector_search.search(t.where("vec_id = 40"), lambda i: F.pmod(i, F.lit(20)) == 0).count() == 0


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 3)
    t = spark.createDataFrame([(i, f"words of {i}", f"l{i % 4}" if i % 5 else None) for i in range(40)], "doc_id long, text string, lang string")
    assert sorted(language.train(t.where("lang <> 'l3'"))) == ["l0", "l1", "l2"]
    with pytest.raises(ValueError, match="more than 3 different values"):
        language.train(t)


def test_few_queries_search_in_several_tasks(spark):
    """One query over many trees: the trees are split over tasks, and what these found is ranked as one, ties and huge scores too."""
    r = np.random.default_rng(4)
    v = r.integers(-3, 4, (3000, 5)).astype(float)
    v[7], v[8:12] = 1e200, [[1e200 + 1e190 * k] * 5 for k in range(4)]
    v[12:15], v[0] = -1e200, [1, 2, 0, -1, 1]
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3)
    found = vector_search.search(t, lambda i: i == 0, k=2990, shard_vectors=200)
    tasks = re.findall(r"hashpartitioning\(no#\d+, (\d+)\), REPARTITION", found._jdf.queryExecution().toString())
    assert tasks and int(tasks[0]) == min(spark.sparkContext.defaultParallelism, 15) > 1
    whole = [[64 * int(x) for x in w] for w in v]
    scores = [sum(a * b for a, b in zip(whole[0], w, strict=True)) for w in whole]
    best = sorted((-s, i) for i, s in enumerate(scores) if i)[:2990]
    assert [(x.rank, x.vec_id, x.score) for x in found.orderBy("rank").collect()] == [(k + 1, i, max(-(2**63), min(2**63 - 1, -s))) for k, (s, i) in enumerate(best)]
    assert sorted((x for x in (2**63, 2**63 + 5, 2**70, 0, -(2**63), -(2**63) - 1, -(2**90))), key=lambda x: (max(-(2**63), min(2**63 - 1, x)), vector_search.beyond(x))) == sorted((2**63, 2**63 + 5, 2**70, 0, -(2**63), -(2**63) - 1, -(2**90)))


def test_trees_are_gone_down_best_first():
    """Clustered vectors: boxes hold their rows, and most leaves are never compared."""
    r = np.random.default_rng(3)
    centres = r.integers(-2000, 2000, (64, 6))
    v = centres[r.integers(0, 64, 20_000)] + r.integers(-5, 5, (20_000, 6))
    nodes, ids, rows = vector_search.unpack_tree(vector_search.pack_tree(np.arange(20_000), v))
    low, high = vector_search.boxes(nodes, rows)
    for i, (a, b, right) in enumerate(nodes):
        assert (rows[a:b].min(axis=0) == low[i]).all() and (rows[a:b].max(axis=0) == high[i]).all()
        assert (not right and b - a <= vector_search.LEAF) or (nodes[i + 1][0] == a and nodes[right][1] == b and nodes[i + 1][1] == nodes[right][0])
    s = vector_search.BlockSearch(np.array([20_001]), v[:1], 10)
    s.take(nodes, ids, rows)
    assert s.visited < sum(nodes[:, 2] == 0) / 4
    scores = v @ v[0]
    assert s.found[0][0].tolist() == sorted(range(20_000), key=lambda i: (-scores[i], i))[:10]


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_ngram_join(docs, empty):
    rows = [(i, x[0], grams(x[1])) for i, x in enumerate(corpus())]
    links = {i: {j for j, d, h in rows if j != i and d is not None and h and len(g & h) >= 0.8 * len(g | h) - 1e-9} if c is not None and g else set() for i, c, g in rows}
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.n_links) for x in ngram_join.join(docs).collect())
    assert got == sorted((c is not None, c or 0, len(links[i])) for i, c, _ in rows)
    root = {}
    for i, c, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        root[c] = min(rows[j][1] for j in seen) if c is not None else None
    assert {x.doc_id: x.class_id for x in ngram_join.join(docs, block=8).collect()} == root
    assert ngram_join.join(empty).count() == 0


def test_banding_reaches_its_recall():
    bands, rows = ngram_join.bands_and_rows()
    assert 1 - (1 - 0.8**rows) ** bands >= ngram_join.RECALL and bands * rows <= ngram_join.MOST_HASHES


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {x.node: x.root for x in ngram_join.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(n, n) == find(n) for n in list(root))


def test_line_dedup(spark, empty):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", "a\nb", None, "", "q\nq\nq\nq\nq", "b\nc\nd\ne", "a\nb\nc\nd", "z\n\nb\nc\nd\n"]
    t = spark.createDataFrame([*rows_of(texts), (None, "a\nb\nc", "en", 1, "x", 2, "y", 3)], DOCS)
    seen, want = set(), {}
    for i, text in enumerate(texts):
        lines = text.split("\n") if text is not None else []
        gone = set()
        for k in range(len(lines) - 2):
            run = tuple(lines[k : k + 3])
            if run in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(run)
        want[i] = (None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    got = line_dedup.drop_repeated_lines(t)
    assert {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in got.where("doc_id is not null").collect()} == want
    assert got.where("doc_id is null").head().text == "a\nb\nc" and set(t.columns) <= set(got.columns)
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_line_dedup_deals_only_selected_positions(spark, monkeypatch):
    r = random.Random(6)
    texts = ["\n".join(f"{i} {j} {r.random()}" for j in range(100)) for i in range(6)]
    texts.append("\n".join(texts[2].split("\n")[40:50]))
    dealt, kept, write, plan = [], [], line_dedup.materialize, line_dedup.arrow_map
    monkeypatch.setattr(line_dedup, "arrow_map", lambda *a: dealt.append(plan(*a)) or dealt[-1])
    monkeypatch.setattr(line_dedup, "materialize", lambda *a: kept.append(write(*a)) or kept[-1])
    t = spark.createDataFrame(rows_of(texts), DOCS)
    assert {x.doc_id: x.n_removed for x in line_dedup.drop_repeated_lines(t).collect()} == {**dict.fromkeys(range(6), 0), 6: 10}
    assert dealt[0].count() < 0.7 * sum(len(x.split("\n")) - 2 for x in texts)
    assert {x.doc_id for x in kept[-1].collect()} == {2, 6} and kept[-1].count() <= 2 * 8


def test_line_dedup_with_colliding_fingerprints(spark, monkeypatch):
    """All lines have one of eight fingerprints; long texts."""
    monkeypatch.setattr(line_dedup, "fingerprints", lambda x: x & np.uint64(7))
    plan = line_dedup.arrow_map
    monkeypatch.setattr(line_dedup, "arrow_map", lambda df, ddl, make, *a: plan(df, ddl, _patched(make), *a))
    r = random.Random(9)
    texts = ["\n".join(r.choice("abcdefghijkl") for _ in range(n)) for n in (5, 300, 40, 40, 7, 1000, 3, 2)]
    seen, want = set(), {}
    for i, text in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for k in range(len(lines) - 2):
            if tuple(lines[k : k + 3]) in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(tuple(lines[k : k + 3]))
        want[i] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone))
    t = spark.createDataFrame(rows_of(texts), DOCS).repartition(2)
    assert {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in line_dedup.drop_repeated_lines(t).collect()} == want


def _patched(make):
    """make with few fingerprints in the worker as well, which imports the module anew."""

    def patched():
        from quizlake.llm import line_dedup as there

        step = make()

        def few(batch):
            before, there.fingerprints = there.fingerprints, lambda x: x & np.uint64(7)
            try:
                yield from step(batch)
            finally:
                there.fingerprints = before

        return few

    return patched


def test_line_dedup_counts_words_of_short_runs(spark):
    long, half, other = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("b", 30), ("c", 30)))
    texts = [f"x\n{long}\ny", long, f"{half}\n{other}", f"z\n{half}\n{other}", f"{half}\nw", "a\nb\nc", "a\nb\nc", f"{long}\n{long}"]
    t = spark.createDataFrame(rows_of(texts), DOCS)
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in line_dedup.drop_repeated_lines(t, words=line_dedup.WORDS).collect()}
    want = [(texts[0], 3, 0), ("", 1, 1), (texts[2], 2, 0), ("z", 3, 2), (texts[4], 2, 0), (texts[5], 3, 0), ("", 3, 3), ("", 2, 2)]
    assert got == dict(enumerate(want))
    plain = {x.doc_id: x.n_removed for x in line_dedup.drop_repeated_lines(t).collect()}
    assert plain == {i: 3 if i == 6 else 0 for i in range(len(texts))}


def test_language(spark, docs, empty):
    from quizlake.llm.queries import op7_language

    got = op7_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count("*"), F.count_if(F.col("lang_pred") == F.col("lang"))).head()
    assert right > 0.95 * n
    model = language.train(language.learnable(docs))
    said = language.identify(docs, model, ["doc_id", "text"]).collect()
    assert len(said) == len(corpus())
    assert all((x.lang_pred == "und") == (not any(c.isalpha() for c in x.text or "")) and 0 <= x.score <= 1 for x in said)
    clash = docs.selectExpr("*", "'z' AS lang_", "doc_id AS `odd.name`", "'t' AS c0", "'u' AS t")
    kept = ["odd.name", "c0", "t", "doc_id", "n_bytes"]
    assert language.identify(clash, model, kept).columns == [*kept, "lang_pred", "score"]
    assert Counter((x.doc_id, x.lang_pred) for x in language.identify(clash, model, kept).collect()) == Counter((x.doc_id, x.lang_pred) for x in said)
    assert language.identify(empty, model, ["doc_id"]).count() == 0 and language.train(empty) == {}


def test_predictions_equal_brute_force(spark, monkeypatch):
    """Training lines by hand, every phrase by looking for substrings, ties, long texts, and both ways of parsing."""
    r = random.Random(8)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 6)))
    text = lambda letters, n: "".join(word(letters) + r.choice([" ", ", ", "\n", "--", " 7 "]) for _ in range(n))
    rows = [(i, text("abcde" if i % 2 else "cdefg", 60), "x" if i % 2 else "y") for i in range(40)] + [(40, "aaaa bbbb", None), (41, None, "x")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), letters=3000)
    lines = lambda lang: {language.plain(x) for _, t, k in rows if k == lang and t for x in t.split("\n")} - {""}
    pieces = {k: {x[i : i + language.PIECE_LETTERS] for x in lines(k) for i in range(0, len(x), language.PIECE_LETTERS)} for k in "xy"}
    assert set(model) == {"x", "y"} and all(any(p.startswith(q) for p in pieces[k]) for k, v in model.items() for q in v) and all(len("".join(v)) == 3000 for v in model.values())

    def count(x, known):
        n = at = 0
        while at < len(x):
            at += next((k for k in range(min(len(x) - at, language.PIECE_LETTERS), 0, -1) if any(x[at : at + k] in p for p in known)), 1)
            n += 1
        return n

    asked = [text("abcdefgh", n) for n in (1, 2, 5, 9, 300)] + [text("abcde", 20), "", "zzz", "a", "\u0301", "z" * 50, "ab " * 700] + [text("aceg", r.randint(1, 12)) for _ in range(90)]
    plains = [language.plain(x) for x in asked]
    want = [[count(x, model[k]) for k in "xy"] for x in plains]
    p = language.Parser(model)
    assert p.table is not None and p.counts(plains).tolist() == want
    monkeypatch.setattr(language, "SIDE_BY_SIDE", 1)
    assert p.counts(plains).tolist() == want
    monkeypatch.setattr(language, "MOST_CELLS", 1)
    slow = language.Parser(model)
    assert slow.table is None and slow.counts(plains).tolist() == want
    for (lang, score), x, n in zip(p.predict(asked), plains, want, strict=True):
        assert lang == ("und" if not x else "y" if n[1] < n[0] else "x") and 0 <= score <= 1


def test_plain_keeps_letters_and_marks():
    assert language.plain("  Ünï-Code 12 हिन्दी, ²½") == "ünï code हिन्दी" and language.plain("²½①Ⅷ \u0301 7") == "" and language.plain("") == ""


def test_phrases_are_longest_matches():
    words = ["banana", "bandana", "nab"]
    a = language.SuffixAutomaton(words)
    parts = {w[i:j] for w in words for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    r = random.Random(5)
    for _ in range(300):
        w, n, at = "".join(r.choice("bandx") for _ in range(r.randint(1, 9))), 0, 0
        while at < len(w):
            size = next((k for k in range(len(w) - at, 0, -1) if w[at : at + k] in parts), 1)
            n, at = n + 1, at + size
        assert a.phrases(w) == n, w


@pytest.mark.parametrize(("length", "seed"), [(50, 24), (200, 90), (8, 8), (30, 1)])
def test_substring_dedup(docs, empty, length, seed):
    texts = sorted((x[0], (x[1] or "").encode()) for x in corpus() if x[0] is not None)
    first = {}
    for i, t in texts:
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], i)
    want = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum())
        want.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    got = substring_dedup.remove_repeats(docs, length, seed)
    assert sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(x.kept).hexdigest()) for x in got.where("doc_id is not null").collect()) == sorted(want)
    assert got.where("doc_id is null and n_removed = 0").count() == 2
    assert substring_dedup.remove_repeats(empty, length, seed).count() == 0
    clash = docs.selectExpr("*", "1 AS mark", "'f' AS found", "'h' AS hits", "'k' AS kept", "2 AS n_removed")
    assert substring_dedup.remove_repeats(clash, length, seed).exceptAll(got).count() == 0


def test_substring_rounds_send_a_row_for_each_shard_not_each_batch(spark, monkeypatch):
    """A task's rows to shards don't grow with its batches, and the first round's shuffles are gone when it ends."""
    sent, per_shard = [], substring_dedup._per_shard
    monkeypatch.setattr(substring_dedup, "_per_shard", lambda df, *more: sent.append(df) or per_shard(df, *more))
    said = " ".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(9))
    docs = spark.createDataFrame([(i, f"{hashlib.sha256(str(i).encode()).hexdigest() * 20} {said[i % 300 :][:90]}") for i in range(400)], "doc_id long, text string").coalesce(1).withColumn("mark", F.crc32(F.col("text").cast("binary")))
    shuffles = lambda: {x for x in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",") if "shuffle_" in x}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        before = shuffles()
        substring_dedup.find_repeats(docs, shards=16)
        for _ in range(100):
            if not shuffles() - before:
                break
            time.sleep(0.1)
        assert not shuffles() - before
        assert sent[0].where("rows is not null").count() <= 16
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize(("length", "seed"), [(200, 24), (10, 11), (10, 0)])
def test_lengths_that_cannot_be_counted_are_refused(docs, length, seed):
    with pytest.raises(ValueError, match="windows"):
        substring_dedup.remove_repeats(docs, length, seed)


@pytest.mark.parametrize("shards", [1, 2, 16, 67, 1000, 50_001])
def test_shards_are_dealt_evenly(spark, monkeypatch, shards):
    monkeypatch.setattr(substring_dedup, "MOST_TASKS", 300)
    numbers = substring_dedup.shard_numbers(shards)
    tasks = substring_dedup.tasks_of(shards)
    assert len(set(numbers.tolist())) == shards
    dealt = Counter(r[0] for r in spark.createDataFrame([(int(x),) for x in numbers], "n int").select(F.pmod(F.hash("n"), F.lit(tasks))).collect())
    assert max(dealt.values()) <= -(-shards // tasks) + (0 if shards < 1000 else 1)


def test_classes_tell_every_column_apart():
    r = np.random.default_rng(4)
    a, b = r.integers(0, 9, 500).astype(np.uint64), r.integers(0, 9, 500).astype(np.uint64)
    n = substring_dedup.classes(a, b)
    assert all((n[i] == n[j]) == ((a[i], b[i]) == (a[j], b[j])) for i in range(0, 500, 7) for j in range(500))
    assert len(substring_dedup.classes(a[:0], b[:0])) == 0


@pytest.mark.parametrize("batch", [1, 1000, substring_dedup.BATCH])
def test_family_levels_stay_few(monkeypatch, batch):
    monkeypatch.setattr(substring_dedup, "BATCH", batch)
    family = substring_dedup.Family()
    r = np.random.default_rng(1)
    keys, doc = r.integers(0, 5000, 20_000).astype(np.uint64), r.integers(0, 100, 20_000)
    for i in range(0, 20_000, 100):
        family.add(keys[i : i + 100], doc[i : i + 100])
    assert len(family.levels) <= 16
    assert all(family.first(keys[:50]) == [doc[keys == k].min() for k in keys[:50]])


def test_batches_are_scanned_as_they_are_added(monkeypatch):
    monkeypatch.setattr(substring_dedup, "BATCH", 100)
    calls, add, first = [], substring_dedup.Family.add, substring_dedup.Family.first
    monkeypatch.setattr(substring_dedup.Family, "add", lambda f, k, d: calls.append(("add", len(k))) or add(f, k, d))
    monkeypatch.setattr(substring_dedup.Family, "first", lambda f, k: calls.append(("first", len(k))) or first(f, k))
    r = np.random.default_rng(3)
    keys, doc = r.integers(0, 300, 1050).astype(np.uint64), r.integers(-50, 50, 1050)
    assert substring_dedup.first_of(keys, doc).tolist() == [doc[keys == k].min() for k in keys]
    assert calls == [(what, n) for n in [100] * 10 + [50] for what in ("add", "first")]


def test_decontamination(spark, docs, empty):
    texts = [x[1] for x in corpus()]
    items = [(1, texts[2][:150]), (2, texts[5]), (3, "one two"), (4, ""), (5, None), (None, texts[7]), (11, texts[5]), (6, "AB ab"), (6, "AB ab")]
    table = spark.createDataFrame([(a, b, "z") for a, b in items], "item_id long, text string, doc_id string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    want = []
    for doc in corpus():
        w, hit, ids = words(doc[1]), set(), set()
        for i, t in items:
            v = words(t)
            if i is None or not v:
                continue
            n = min(10, len(v))
            windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids.add(i)
        want.append((str(doc[0]), len(w), len(hit), tuple(sorted(ids))))
    for size in (decontamination.PASS_BYTES, 200):
        old, decontamination.PASS_BYTES = decontamination.PASS_BYTES, size
        got = decontamination.find_contamination(docs, table).collect()
        decontamination.PASS_BYTES = old
        assert sorted((str(x.doc_id), x.n_words, x.n_hit, tuple(x["items"])) for x in got) == sorted(want)
    assert decontamination.find_contamination(empty, table).count() == 0
    assert decontamination.find_contamination(docs, table.where("false")).where("n_hit > 0").count() == 0


def test_html_text(spark):
    page = "<html><head><title>no</title><script>var a='<p>x</p>';</script></head><body><nav><a href=/>Menu</a></nav><div class='ad'>Buy</div>{}<footer>&copy;</footer></body></html>"
    body = "<div class='{}'><h1>T &amp; U</h1><p>First  <b>bold</b>\nwords that go on for a while, and then some.<p>Second one<br>with a break.<ul><li>x<li>y</ul><form><input>Search</form><div class='comments'><p>Nice article, thanks a lot for writing it, really.</div></div>"
    rows = [(i, f"http://h.example/{i}", page.format(body.format(f"post post-{i}"))) for i in range(6)] + [(7, "http://h.example/7", None), (8, None, ""), (9, "nonsense", "plain &lt;text&gt; only"), (10, "http://other.example/", "<article><p>Only words here.")]
    t = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = {x.page_id: x.text for x in html_text.extract(t).collect()}
    want = "T & U\nFirst bold words that go on for a while, and then some.\nSecond one with a break.\nx\ny"
    assert all(got[i] == want for i in range(6))
    assert got[7] == "" and got[8] == "" and got[9] == "plain <text> only" and got[10] == "Only words here."
    assert html_text.extract(t.where("false")).count() == 0
    size, html_text.BROADCAST_BYTES = html_text.BROADCAST_BYTES, 0
    dealt = {x.page_id: x.text for x in html_text.extract(t).collect()}
    html_text.BROADCAST_BYTES = size
    assert dealt == got


@pytest.mark.parametrize("size", [html_text.BROADCAST_BYTES, 0])
def test_html_text_reads_every_template_of_a_host(spark, monkeypatch, size):
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", size)
    long, short = "Words that go on for quite a while here. " * 5, "Only a short text of the page."
    pages = [f"<div class='{c}'><p>{long}{k}</div>" for c in "abcdefgh" for k in range(5)]
    pages += [f"<div class='ninth'><p>{x} {k}</div><div class='extra'><p>{y}</div>" for k, (x, y) in enumerate([(long, short), (long, short), (short, long)])]
    t = spark.createDataFrame([(i, None, x) for i, x in enumerate([*pages, None, "plain"])], "page_id long, url string, html string")
    got = {x.page_id: x.text for x in html_text.extract(t).collect()}
    assert got[42] == f"{short} 2" and got[40] == f"{long}0"
    assert got[0] == f"{long}0" and got[43] == "" and got[44] == "plain" and len(got) == 45


def texts_of(page):
    return [text for _, text, _ in html_text.blocks(page)]


@pytest.mark.parametrize(("page", "want"), [
    ("<div class='content has-sidebar'><h1>T</h1><p>Body.</p></div>", ["T", "Body."]),
    ("<article><p class='share-price'>Price</p><h2 id='search'>Find</h2></article>", ["Price", "Find"]),
    ("<div data-t=don't><p>one</p><p>two's</p></div>", ["one", "two's"]), ("<p>a</p><p class=\"x>Hello", ["a"]), ("a<b title='>'>c</b title='>'>d", ["acd"]),
    ("<div class='widget-area'><article><p>Most of the text of this page.</p></article></div><p>x</p>", ["Most of the text of this page.", "x"]),
    ("<div class='ad-slot'>buy</div><div id=cookie-notice>c</div><ul class='share-buttons'><li>s</ul><p>t", ["t"]), ("<div class='related-posts'><p>Far more text than the article has.</p></div><p>x</p>", ["x"]),
    ("<div class='comments'><article><p>A long remark of a reader, longer than all.</p></article></div><p>x</p>", ["x"]),
    ("<p hidden>no</p><p aria-hidden=true>no<p style='display : none'>no<p>yes", ["yes"]), ("a<!-->b<!--x--!>c<![CDATA[d]]>e</>f<?g?>h", ["abcefh"]), ("<a x==y =z>q</a><svg/>r", ["qr"]), ("1 < 2 <3 <", ["1 < 2 <3 <"]),
])
def test_html_by_its_rules(page, want):
    assert texts_of(page) == want


@pytest.mark.parametrize("page", ["<a " * 330_000, '<p class="x>' * 80_000, "<!--" * 250_000, "<" * 1_000_000, "<a " + "=" * 900_000, "<a" + " " * 400_000 + ">x<a" + " " * 400_000, "<div>" + "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000, "<div>" * 200_000, "<div>" + "<b>" * 50_000 + "<p>x</p>" * 50_000, '<div class="' + "x-" * 400_000 + '">'])
def test_html_is_read_once(page):
    began = time.process_time()
    texts_of(page)
    assert time.process_time() - began < 12  # a reader that went back would take minutes


def test_html_text_equals_generated_articles(spark):
    """Pages of hosts with a template each around known articles; on one page of each the surroundings outweigh the article."""
    r = random.Random(12)
    word = lambda: r.choice(["naïve", "a &amp; b", "tea", "&lt;x&gt;", "plain", "Ünit", "longer", "words"])
    plain = lambda x: x.replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    boxes = ["div class='post p{}'", "article", "section id=main-text", "main", "td"]
    rows, want = [], {}
    for host, box in enumerate(boxes):
        for k in range(12):
            blocks = [" ".join(word() for _ in range(r.randint(3, 30))) + "." for _ in range(r.randint(2, 6) if k else 1)]
            tags = [r.choice([("<p>", "</p>"), ("<p>", ""), ("<h2>", "</h2>"), ("<ul><li>", "</ul>"), ("<blockquote>", "</blockquote>")]) for _ in blocks]
            body = "".join(a + b.replace(" ", r.choice(["  ", "\n", " ", " <b></b>"]), 1) + c for b, (a, c) in zip(blocks, tags, strict=True))
            aside = "Teaser words of other pages, many more than here. " * (1 if k else 40)
            rows.append((100 * host + k, f"https://h{host}.example:8{k}/p{k}", f"<!doctype html><title>t</title><body><nav><a href=/>home</a></nav><div class='cookie-banner'>We use</div><table><tr><{box.format(k)}>{body}</{box.split()[0]}></tr></table><div class=teasers-{k}><span>{aside}</span></div><footer>&copy; f</footer>"))
            want[100 * host + k] = "\n".join(" ".join(plain(b).split()) for b in blocks)
    got = {x.page_id: x.text for x in html_text.extract(spark.createDataFrame(rows * 2, "page_id long, url string, html string")).collect()}
    assert got == want


@pytest.mark.parametrize(("page", "want"), [
    ("<article><h1>T</h1><section id=methods><p>How.</section><section id=discussion><p>What it means.</section></article>", ["T", "How.", "What it means."]),
    ("<article><p>a<div class='price-alert'>It costs more now.</div></article>", ["a", "It costs more now."]),
    ("<article><p>a<section class='related-work'><p>Others did it.</section></article>", ["a", "Others did it."]),
    ("<article><p>a<div class='side-by-side'><p>Left.<p>Right.</div></article>", ["a", "Left.", "Right."]),
    ("<article><p>a<table class='widget-list'><tr><td>w</table></article>", ["a", "w"]),
    ("<article><p>a<ul class=menu><li>Soup<li>Fish</ul></article>", ["a", "Soup", "Fish"]),
    ("<body><form action=/><h1>T</h1><p>The whole page stands in a form.</form>", ["T", "The whole page stands in a form."]),
    ("<main><header><h1>T</h1></header><p>Text.</main>", ["T", "Text."]),
    ("<article><p>a<ul class=menu><li><a href=/>Home</a><li><a href=/x>News</a></ul></article>", ["a"]),
    ("<article><p>a<div class='related-posts'><p>Teaser.</div><div class='share-buttons'>Share</div><div class='newsletter'>Mail</div><div id=sidebar>s</div><div class='comment-list'>c</div></article>", ["a"]),
    ("<article><p>Long enough text.<form><p>Ask us:<input></form></article>", ["Long enough text."]), ("<header><h1>Site</h1><p>Its long motto, longer than all.</header><p>x", ["x"]),
])
def test_html_names_of_two_senses(page, want):
    assert texts_of(page) == want


def test_html_text_hosts_vote_on_surroundings(spark):
    """Parts with unlisted names that a host's pages share go, where their text is that; copies of one page don't vote."""
    box, other = "<div class='qx-{}'><p>Our shop sells many lamps, come and see.</p></div>", "<section class=discussion><p>Write to us about this.</p></section>"
    rows = [(k, "http://a.example/", f"<article><h1>T{k}</h1><p>Text of the page with number {k}, which is long enough to be most of it, and longer still.</p>{box.format(k)}{other}<div class=date>1 May</div></article>") for k in range(70)]
    rows += [(100, "http://a.example/", f"<article><p>{'Own text. ' * 9}</p><div class='qx-1'><p>Here the same box has words of this article.</p></div></article>")]
    rows += [(101, "http://a.example/", "<article>" + box.format(2) + "</article>")]
    rows += [(200 + k, "http://b.example/", "<article><p>One page in many copies.</p>" + box.format(1) + "</article>") for k in range(9)]
    t = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (html_text.BROADCAST_BYTES, 0):
        old, html_text.BROADCAST_BYTES = html_text.BROADCAST_BYTES, size
        got = {x.page_id: x.text for x in html_text.extract(t).collect()}
        html_text.BROADCAST_BYTES = old
        assert all(got[k] == f"T{k}\nText of the page with number {k}, which is long enough to be most of it, and longer still.\n1 May" for k in range(70))
        assert got[100].endswith("words of this article.") and got[101] == "Our shop sells many lamps, come and see."
        assert all(got[200 + k] == "One page in many copies.\nOur shop sells many lamps, come and see." for k in range(9))


def test_html_of_any_depth():
    """Paths are told apart at any depth; time and memory don't grow with blocks times depth."""
    deep = "<div>" * 300 + "<div class=main><p>Text.</div><div class=rest><p>More.</div>"
    page = html_text.read_page(deep)
    assert [page.text(p) for p, _, _ in page.blocks()] == ["Text.", "More."] and len(page.paths()) == 302
    for page in ("<div>" * 256 + "<p>x</p>" * 60_000, "".join(f"<div class='{'name ' * 2200}n{k}'>" for k in range(256)) + "x", "<div class=discussion>" * 20_000 + "x", "<div>" * 256 + "<div class=k><p>x</p></div>" * 30_000):
        began = time.process_time()
        read = html_text.read_page(page)
        html_text.scored(read)
        read.text(read.blocks()[0][0]) if read.blocks() else None
        assert time.process_time() - began < 5  # about a second
        tracemalloc.start()
        html_text.read_page(page)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200_000_000


def test_scratch_follows_the_setting(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
