"""Exact top-k search by inner product with a KD-tree for each shard of the vectors.

A shard's vectors are split at the median of their widest dimension until leaves are small; each node has its tight bounding
box. The largest inner product of a query with any point of a box is a sum over dimensions of the better corner, which is
the bound of the search: a block of queries goes down a tree best first, each query into those nodes only whose bound reaches
its kth score. That kth score goes on from tree to tree, as one task takes a group of queries through every shard; trees are
shuffled once for each group, and no key holds more than a group's queries and the trees it meets. Where there are fewer
groups than cores, the trees are split over several tasks for each group, and what these found is ranked together.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlake.llm.common import dealt_numbers, estimated_bytes, materialize, prepare

LEAF = 256
SHARD_VECTORS = 16_384
QUERY_BLOCK = 512
#: Queries that a task takes through the trees, some 70 MB of vectors and results; trees are shuffled once for each group.
QUERY_GROUP = 65_536
LONGEST = 2**63 - 1
WIDTHS = (np.float32, np.float64, np.int64, object)


def whole_numbers(vectors: list[list[float]], scale: int) -> np.ndarray:
    """floor(scale * x) of every component: as int64, or as Python's integers where those are too small."""
    x = np.array(vectors, np.float64)
    if np.abs(x).max(initial=0) < 2**52 / scale:
        return np.floor(x * scale).astype(np.int64)
    exact = lambda c: int(c) * scale if abs(c) >= 2**52 else int(np.floor(c * scale))  # noqa: E731  beyond 2**52 a double is whole
    return np.array([[exact(c) for c in v] for v in vectors], object)


def build_tree(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and the nodes in the order of a walk: from, to and the place of the right child (0: a leaf)."""
    order, nodes, stack = np.arange(len(vectors)), [], [(0, len(vectors), -1)]
    while stack:
        a, b, parent = stack.pop()
        if parent >= 0:
            nodes[parent][2] = len(nodes)
        nodes.append([a, b, 0])
        if b - a <= leaf:
            continue
        part = vectors[order[a:b]]
        widest = int((part.max(axis=0) - part.min(axis=0)).argmax())
        middle = (b - a) // 2
        order[a:b] = order[a:b][np.argsort(part[:, widest], kind="stable") if part.dtype == object else np.argpartition(part[:, widest], middle, kind="introselect")]
        stack += [(a + middle, b, len(nodes) - 1), (a, a + middle, -1)]  # the left child follows its parent
    return order, np.array(nodes, np.int64)


def pack_tree(ids: np.ndarray, vectors: np.ndarray) -> bytes:
    """Ids, nodes and vectors in the tree's order; numbers beyond int64 as text."""
    order, nodes = build_tree(vectors)
    v = vectors[order]
    if v.dtype == object:
        kind, raw = b"t", " ".join(map(str, v.ravel())).encode()
    else:
        most = np.abs(v).max(initial=0)
        kind = b"1" if most < 128 else b"2" if most < 32768 else b"8"
        raw = v.astype(f"<i{kind.decode()}").tobytes()
    return struct.pack("<IIIc", len(v), vectors.shape[1], len(nodes), kind) + nodes.astype("<u4").tobytes() + ids[order].astype("<i8").tobytes() + raw


def unpack_tree(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, ids and vectors."""
    n, dim, count, kind = struct.unpack_from("<IIIc", data)
    at = struct.calcsize("<IIIc")
    nodes = np.frombuffer(data, "<u4", 3 * count, at).astype(np.int64).reshape(count, 3)
    ids = np.frombuffer(data, "<i8", n, at + 12 * count)
    at += 12 * count + 8 * n
    if kind == b"t":
        return nodes, ids, np.array([int(x) for x in data[at:].split()], object).reshape(n, dim)
    return nodes, ids, np.frombuffer(data, f"<i{kind.decode()}", n * dim, at).reshape(n, dim)


def largest(x: np.ndarray) -> int:
    """No component of x is larger than this."""
    return max((abs(int(c)) for c in x.ravel()), default=0) if x.dtype == object else int(np.abs(x.astype(np.float64)).max(initial=0)) + 1


def number_kind(query: int, row: int, dim: int) -> type:
    """For components of at most these sizes: float32 multiplies fastest and is exact while every sum stays below 2**24, float64
    below 2**53; beyond that int64, and where that could overflow, Python's integers."""
    reach = query * row * max(1, dim)
    return np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64 if reach < 2**62 else object


def boxes(nodes: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest components of each node: a leaf's own rows, then of its children upwards."""
    low, high = np.empty((len(nodes), v.shape[1]), v.dtype), np.empty((len(nodes), v.shape[1]), v.dtype)
    for i in range(len(nodes) - 1, -1, -1):
        a, b, right = nodes[i]
        if right:
            low[i], high[i] = np.minimum(low[i + 1], low[right]), np.maximum(high[i + 1], high[right])
        else:
            low[i], high[i] = v[a:b].min(axis=0), v[a:b].max(axis=0)
    return low, high


class Tree:
    """A tree's rows and boxes, in the kind of numbers last asked for."""

    def __init__(self, nodes: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.nodes, self.ids, self.vectors = nodes, ids, vectors
        self.boxes, self.largest = boxes(nodes, vectors), largest(vectors)
        self.kind = None

    def as_kind(self, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if kind is not self.kind:
            self.kind, self.typed = kind, tuple(x.astype(kind) for x in (*self.boxes, self.vectors))
        return self.typed


def beyond(score: int) -> bytes:
    """What a score that no long holds is more or less than the nearest long, in bytes that sort as it does; else none."""
    if -LONGEST - 1 < score <= LONGEST:
        return b""
    off = abs(score - max(-LONGEST - 1, min(LONGEST, score)))
    size = (off.bit_length() + 7) // 8
    more = struct.pack(">H", size) + off.to_bytes(size, "big")
    return more if score > 0 else bytes(255 - x for x in more)


class BlockSearch:
    """The k best of each query of a block; trees are taken in one by one."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k, self.largest = ids, vectors, k, largest(vectors)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in ids]  # ids, scores, best first
        self.kind = np.float32  # the widest numbers so far
        self.visited = 0  # leaves whose rows were compared

    def take(self, nodes: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        self.go_down(Tree(nodes, ids, v))

    def go_down(self, tree: Tree) -> None:
        nodes, ids = tree.nodes, tree.ids
        kind = self.kind = max(self.kind, number_kind(self.largest, tree.largest, self.vectors.shape[1]), key=WIDTHS.index)
        q = self.vectors.astype(kind)
        low, high, v = tree.as_kind(kind)
        above, below = np.maximum(q, 0), np.minimum(q, 0)
        none = -np.inf if kind in (np.float32, np.float64) else -(1 << 62) if kind is np.int64 else -(1 << 4000)
        kth = np.array([s[self.k - 1] if len(s) == self.k else none for _, s in self.found], kind)

        def bound(node, rows):
            return above[rows] @ high[node] + below[rows] @ low[node]

        every = np.arange(len(q))
        first = bound(0, every)
        heap = [(-first.max(), 0, every, first)] if len(q) else []
        while heap:
            _, node, rows, reach = heapq.heappop(heap)
            on = reach >= kth[rows]  # a tie may have a smaller id
            rows = rows[on]
            if not len(rows):
                continue
            a, b, right = nodes[node]
            if right:
                for child in (node + 1, int(right)):
                    reach = bound(child, rows)
                    heapq.heappush(heap, (-reach.max(), child, rows, reach))
                continue
            self.visited += 1
            scores = q[rows] @ v[a:b].T
            near = (scores >= kth[rows][:, None]) & (ids[a:b] != self.ids[rows][:, None])
            for i in np.flatnonzero(near.any(axis=1)).tolist():
                r = int(rows[i])
                self._merge(r, ids[a:b][near[i]], scores[i][near[i]])
                if len(self.found[r][1]) == self.k:
                    kth[r] = self.found[r][1][-1]

    def _merge(self, r: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.found[r][0], ids]), np.concatenate([self.found[r][1].astype(scores.dtype), scores])
        best = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i])) if scores.dtype == object else np.lexsort((ids, -scores)), np.int64)[: self.k]
        self.found[r] = ids[best], scores[best]


def usable_vectors(table: DataFrame) -> DataFrame:
    """vec_id and the components; vectors that are null, empty or hold a null or no finite number are left out, and null ids."""
    x = F.col("embedding").cast("array<double>")
    return table.where("vec_id is not null and embedding is not null and size(embedding) > 0").where(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def search(table: DataFrame, is_query, k: int = 20, scale: int = 64, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where ``is_query``, the k others with the largest inner product.

    Ties go to the smaller vec_id; fewer than k others give fewer rows. Vectors of another length than a query's have no
    score with it. Repeated rows are candidates each; rows that share a vec_id are one query, whose k best are taken of all
    their scores; no row counts for a query of its own vec_id. Scores are exact and ranked as such; one beyond a long is given
    as the nearest long. An empty table gives no rows; other columns are ignored. Shards and query groups have bounded sizes;
    each group meets every shard once, so the trees' bytes times the groups are shuffled. Few queries are one group, for which
    the shards are split over as many tasks as there are cores for; a query's best of each are then ranked by a window.
    """
    spark = table.sparkSession
    prepare(spark)
    rows = usable_vectors(table)
    n = max(1, estimated_bytes(table) // (256 * shard_vectors))
    shards = max(1, int(n))

    def trees(batches):
        held: dict[tuple[int, int], list] = {}

        def full(key):
            ids, vectors = zip(*held.pop(key), strict=True)
            return pa.RecordBatch.from_pydict({"dim": [key[1]], "tree": [pack_tree(np.array(ids, np.int64), whole_numbers(vectors, scale))]}, schema=pa.schema([("dim", pa.int32()), ("tree", pa.binary())]))

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                key = (0, len(v))
                held.setdefault(key, []).append((i, v))
                if len(held[key]) >= shard_vectors:
                    yield full(key)
        for key in list(held):
            yield full(key)

    built = materialize(rows.repartition(shards, "vec_id", "v").mapInArrow(trees, "dim int, tree binary"), "kd-trees")

    # queries are dealt evenly to groups of at most about QUERY_GROUP, smaller ones while cores are free; each group meets every tree in one task
    asked = rows.where(is_query(F.col("vec_id")))
    n_asked = asked.count()
    groups = max(1, -(-n_asked // QUERY_GROUP), min(-(-n_asked // QUERY_BLOCK), spark.sparkContext.defaultParallelism))
    # where groups are fewer than cores the trees are split too: place group * splits + split of numbers is a task's
    splits = max(1, min(spark.sparkContext.defaultParallelism // groups, built.count()))
    numbers = F.split(F.lit(",".join(map(str, dealt_numbers(groups * splits, groups * splits)))), ",").cast("array<int>")
    group, split = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"), F.pmod(F.xxhash64(F.substring("tree", 1, 4096)), F.lit(splits)).cast("int")
    asked = asked.select(F.explode(F.slice(numbers, group * splits + 1, splits)).alias("no"), F.lit(0).alias("turn"), "vec_id", "v", F.lit(None).cast("int").alias("dim"), F.lit(None).cast("binary").alias("tree"))
    sent = built.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.get(numbers, g * splits + split))).alias("no"), F.lit(1).alias("turn"), F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("v"), "dim", "tree")
    dealt = asked.union(sent).repartition(groups * splits, "no").sortWithinPartitions("no", "turn")

    def run(batches):
        now, queries, searches = None, {}, {}

        def results():
            done = [s for of_dim in searches.values() for s in of_dim]
            ids, n = np.unique(np.concatenate([np.zeros(0, np.int64), *(s.ids for s in done)]), return_counts=True)
            several = ids[n > 1]
            best: dict[int, list[tuple[int, int]]] = {}
            for s in done:
                apart = np.isin(s.ids, several).tolist()
                for i, (f, sc), more in zip(s.ids.tolist(), s.found, apart, strict=True):
                    if more:
                        best.setdefault(i, []).extend((-int(x), j) for j, x in zip(f.tolist(), sc, strict=True))
                yield from ranked([(i, *x) for i, x, more in zip(s.ids.tolist(), s.found, apart, strict=True) if not more])
            merged = [(i, sorted(x)[:k]) for i, x in sorted(best.items())]
            for at in range(0, len(merged), QUERY_BLOCK):
                yield from ranked([(i, np.array([j for _, j in x], np.int64), [-s for s, _ in x]) for i, x in merged[at : at + QUERY_BLOCK]])

        def ranked(rows):
            sizes = np.array([len(f) for _, f, _ in rows], np.int64)
            if sizes.sum():
                rank = np.arange(1, sizes.sum() + 1) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                exact = [int(x) for _, _, sc in rows for x in sc]
                scores = [max(-LONGEST - 1, min(LONGEST, x)) for x in exact]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([i for i, _, _ in rows], np.int64), sizes)), pa.array(rank.astype(np.int32)), pa.array(np.concatenate([f for _, f, _ in rows])), pa.array(scores, pa.int64()), pa.array(map(beyond, exact), pa.binary())], names=["query_id", "rank", "vec_id", "score", "beyond"])

        def searches_of(dim):
            if dim not in searches:
                asking = queries.pop(dim, [])
                ids, vectors = (np.concatenate(x) for x in zip(*asking, strict=True)) if asking else ([], [])
                searches[dim] = [BlockSearch(ids[i : i + QUERY_BLOCK], vectors[i : i + QUERY_BLOCK], k) for i in range(0, len(ids), QUERY_BLOCK)]
            return searches[dim]

        def asked_in(of_dim):
            for dim, (ids, vectors) in of_dim.items():
                queries.setdefault(dim, []).append((np.array(ids, np.int64), whole_numbers(vectors, scale)))

        for batch in batches:
            asking: dict[int, tuple[list, list]] = {}
            for no, vec_id, v, dim, tree in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if no != now or tree.is_valid:
                    asked_in(asking)
                    asking = {}
                if no != now:
                    yield from results()
                    now, queries, searches = no, {}, {}
                if not tree.is_valid:
                    ids, vectors = asking.setdefault(len(v), ([], []))
                    ids.append(vec_id), vectors.append(v)
                elif searches_of(dim):
                    taken = Tree(*unpack_tree(tree.as_py()))
                    for s in searches[dim]:
                        s.go_down(taken)
            asked_in(asking)
        yield from results()

    found = dealt.select("no", "vec_id", "v", "dim", "tree").mapInArrow(run, "query_id long, rank int, vec_id long, score long, beyond binary")
    if splits > 1:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.drop("beyond")
