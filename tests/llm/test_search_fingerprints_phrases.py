"""Ranked search, fingerprints and phrases against brute force, on rows with nulls, empty and long texts, ties, repeats, and extra columns."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quizlake.llm import fingerprints, lexical_search, phrases

DOCS = "doc_id long, text string, lang string, term string, part int, score string, `a.b` int"
ITEMS = "item_id long, text string, doc_id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    r = random.Random(11)
    words = ["the", "of", "Alpha", "beta", "gamma2", "δέλτα", "new", "york", "city", "x", "É", "a\x01b", "\x00", "tail\x08"]
    say = lambda n: "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", ". ", "\n", ";", "  "]) for _ in range(n))
    texts = [say(r.randint(1, 60)) for _ in range(120)] + ["new york city the " * 40] * 3 + [None, "", " ", "\n\n", "!?", "one", "new york " * 5000, "x" * 4000]
    langs = ["en", "fr", None, "und", "o\tdd\n"]
    rows = [(i, t, langs[i % 5], "x", 1, "y", 2) for i, t in enumerate(texts)]
    return [*rows, (None, texts[0], "en", "x", 1, "y", 2), (None, texts[3], None, "x", 1, "y", 2), (5, texts[5], "en", "x", 1, "y", 2), (5, texts[6], "fr", "x", 1, "y", 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(rows, items, top=20):
    held = [(i, Counter(terms_of(t))) for i, t in rows]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(w for _, c in held for w in c)
    weight = lambda w: math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 75 + 25 * c.total() * n // total
            score = sum(weight(w) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w in terms_of(text) if w in c)
            if score:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("most", [1_000_000, 30])
def test_search(spark, docs, empty, monkeypatch, most):
    monkeypatch.setattr(lexical_search, "PASS_BYTES", most)  # the smaller one takes a pass for an item or two
    items = [(1, "New YORK city city"), (2, "the of"), (3, "nothing here"), (4, ""), (6, "x x x δέλτα É"), (None, "beta"), (7, "tail a b")]
    table = spark.createDataFrame([*[(i, t, "z") for i, t in items], (8, None, "z"), (1, items[0][1], "again")], ITEMS)
    got = sorted([tuple(r) for r in lexical_search.search(docs, table).select("item_id", "rank", "doc_id", "score").collect()], key=str)
    assert got == ranked([(r[0], r[1]) for r in corpus()], items)
    assert lexical_search.search(empty, table).count() == 0 and lexical_search.search(docs, table.limit(0)).count() == 0


def test_shards_share_a_heap():
    """Several shards, one heap: as one ranking over all; and most documents aren't scored."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [[r.choice(words[: r.choice([3, 30, 300])]) for _ in range(r.randint(1, 80))] for _ in range(3000)]
    item = [r.choice(words) for _ in range(12)]
    want = ranked(enumerate(map(" ".join, texts)), [(0, " ".join(item))])
    n, total, df = len(texts), sum(map(len, texts)), Counter(w for t in texts for w in set(t))
    number = {w: k for k, w in enumerate(words)}
    weights = np.array([lexical_search.weight(n, df[w]) for w in words])
    heap, scored = [], 0
    for a in range(0, n, 500):
        counts = [Counter(number[w] for w in t) for t in texts[a : a + 500]]
        flat = lambda f: np.array([x for c in counts for x in f(c)])
        shard = lexical_search.Shard(list(range(a, a + len(counts))), [c.total() for c in counts], np.array([len(c) for c in counts]), flat(Counter.keys), flat(Counter.values), weights, n, total)
        scored += shard.search([(number[w], c) for w, c in Counter(item).items()], heap, 20)
    assert sorted([(0, k, i, s) for k, (s, _, i) in enumerate(sorted(heap, reverse=True), 1)], key=str) == want
    assert scored < sum(bool(set(t) & set(item)) for t in texts) / 2


def likeness(a, b):
    x, y = (dict(zip(*map(np.ndarray.tolist, fingerprints.terms(t)), strict=True)) for t in (a, b))
    k = x.keys() | y.keys()
    return sum(min(x.get(w, 0), y.get(w, 0)) for w in k) / sum(max(x.get(w, 0), y.get(w, 0)) for w in k)


def test_draws_collide_as_generalised_jaccard():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(r.randint(5, 900))] for _ in range(300)]
    pairs = []
    for k, words in enumerate(base):
        other = words[: int(len(words) * r.random())] + base[k - 1][: len(words) // 3] * r.randint(1, 3)
        pairs.append((" ".join(words), " ".join(other or ["z"])))
    a, b = (fingerprints.sign_all([p[k] for p in pairs]) for k in (0, 1))
    wanted = np.array([likeness(*p) for p in pairs])
    found = np.array([fingerprints.likeness(x, y) for x, y in zip(a, b, strict=True)])
    spread = np.sqrt(wanted * (1 - wanted) / fingerprints.SAMPLES)
    assert abs((found - wanted).mean()) < 0.015 and np.sqrt(((found - wanted) ** 2).mean()) < 1.2 * np.sqrt((spread**2).mean()) + 0.005
    alone = np.concatenate([fingerprints.sign_all([p[0]]) for p in pairs[:40]])
    assert (alone == a[:40]).all()  # whatever else is signed with it


def test_compare_with_next(spark, docs, empty):
    rows = [(i, t or "") for i, t, *_ in corpus()]
    ids = sorted({i for i, _ in rows if i not in (None, 5)})
    got = fingerprints.compare_with_next(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 5)}
    text = dict(rows)
    for i, after in zip(ids, [*ids[1:], None], strict=True):
        if after is None or 4 <= i <= 5:  # rows with a null id come first, and several share id 5: their order is their hash's
            continue
        half = len(text[i]) // 2
        edited = text[i][: len(text[i]) - half] + text[after][:half]
        own, of_edited, next_ = fingerprints.sign_all([text[i], edited, text[after]])
        want = (len(text[i]), hashlib.sha256(edited.encode()).hexdigest(), fingerprints.encode(own), fingerprints.encode(of_edited), fingerprints.likeness(own, of_edited), fingerprints.likeness(own, next_))
        assert tuple(by[i])[1:] == want, i
    alone = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert all(alone[i] == r.fingerprint for i, r in by.items())
    assert fingerprints.compare_with_next(empty).count() == 0
    one = fingerprints.compare_with_next(docs.where("doc_id = 2")).head()
    t = text[2]
    assert one.edited_sha256 == hashlib.sha256((t[: len(t) - len(t) // 2] + t[: len(t) // 2]).encode()).hexdigest() and one.near_next == 1


def collocations(rows, max_n=3, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = Counter()
    for (lang, *w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[(lang, *w[i : i + k])] = max(a, longer[(lang, *w[i : i + k])])
    out = {}
    for (lang, *w), a in found.items():
        if 100 * longer[(lang, *w)] < 50 * a:
            cuts = [(1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k, f[(lang, *w[:k])], f[(lang, *w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for k, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1))


@pytest.mark.parametrize(("max_n", "least", "top"), [(3, 10, 2000), (2, 3, 7), (4, 12, 30)])
def test_phrases(docs, empty, max_n, least, top):
    got = sorted(tuple(r) for r in phrases.mine(docs, max_n, least, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == collocations([(r[2], r[1]) for r in corpus()], max_n, least, top) and got
    assert phrases.mine(empty, max_n, least, top).count() == 0


@pytest.mark.parametrize("lot", [1, 2, 7, 1000])
def test_stack_counts_prefixes(lot):
    """Any number of rows at a time; repeated rows, and prefixes of hot words below the least count."""
    r = random.Random(lot)
    rows = sorted((f"{r.choice('abc')}\nen" + "".join(f"\t{r.choice('xyz')}" for _ in range(r.randint(0, 2))) for _ in range(400)), reverse=True)
    rows = ["c\nfr\tq\tq", "c\nfr\tq\tr"][::-1] + rows if lot > 2 else rows
    rows.sort(reverse=True)
    counts = np.array([r.randint(1, 3) for _ in rows])
    stack = phrases.Stack(3, 25, ["c\nfr"], ["c\nfr\tq"])
    for a in range(0, len(rows), lot):
        stack.push(pa.array(rows[a : a + lot]), counts[a : a + lot])
    stack.pop(0)
    want = Counter()
    for s, c in zip(rows, counts.tolist(), strict=True):
        w = s.split("\t")
        for k in range(1, len(w) + 1):
            want["\t".join(w[:k])] += c
    want = {s: c for s, c in want.items() if c >= 25 or s in ("c\nfr", "c\nfr\tq")}
    got = Counter()
    for lang, s, _, c in stack.out:
        first, sep, rest = s.partition("\t")
        got[f"{first}\n{lang}{sep}{rest}"] += c
    assert dict(got) == want and len(stack.out) == len(want)


def test_hot_words_are_dealt_out(spark, monkeypatch):
    """A pair that begins a third of all suffixes: its counts come from many partitions, and are whole."""
    r = random.Random(9)
    text = lambda: " ".join(x for _ in range(40) for x in ("hot", "pair", f"w{r.randint(0, 400)}"))
    rows = [(i, text(), "en", "", 0, "", 0) for i in range(60)]
    words, pairs = phrases.heavy(spark.createDataFrame(rows, DOCS), 3)
    assert "hot\nen" in words and "hot\nen\tpair" in pairs
    got = sorted(tuple(x) for x in phrases.mine(spark.createDataFrame(rows, DOCS)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == collocations([(x[2], x[1]) for x in rows])
