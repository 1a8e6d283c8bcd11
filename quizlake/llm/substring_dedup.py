"""Exact removal of repeated substrings with a logarithmic index family.

A full suffix array of a corpus needs several times its bytes, so the arrays are sparse. Of every ``LENGTH``-byte window
the leftmost smallest ``SEED``-byte hash is its anchor. Equal windows have equal anchors, so only suffixes that begin at
anchors, about one byte in 13, are indexed, and no repeat of ``LENGTH`` bytes or more is missed.

Anchors are dealt to shards by the hash of their seed. A shard's entries are taken by doc_id in batches of ``BATCH``: each
gets its sorted array, becomes a level, and is scanned against the levels of its own and of smaller doc_ids; levels of about
one size merge, so each entry moves a logarithmic number of times. A level holds each key once with its smallest doc_id.

The windows of an anchor span an extent. An anchor whose extent occurs in an earlier document is covered whole. One whose
seed occurs earlier but whose extent doesn't, at either end of a match, is looked at window by window in a second round,
together with one anchor of each other extent of its seed.

Bytes stand for themselves in no shard, only hashes of them do: an extent by 48 bits of its seed and 64 bits of its own, a
window by 64 bits and 32 of a second hash. By the birthday bound 100 TB, of 8e12 extents and fewer windows, hold a false
match of either kind with a probability below one in a thousand.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.common import arrow_map, dealt_numbers, materialize, prepare, shards_for, text_bytes
from quizlake.sources.scratch import shuffles_dropped

LENGTH = 50
SEED = 24
SHARD_BYTES = 4_000_000
#: Beyond this many shards they grow, up to so many bytes of text; then their number grows again.
MANY_SHARDS = 200_000
MOST_SHARD_BYTES = 64_000_000
#: Tasks that shards are dealt to, at most; a task takes its shards one by one.
MOST_TASKS = 20_000
BATCH = 1 << 18
#: So many anchors or windows a task gathers before it sends them: with more shards a row for each shard would hold fewer of a batch.
GATHERED = 1 << 20
SENT_BYTES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15 - 0x10)  # 5 modulo 8
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_VALUES, _OTHER_VALUES = np.random.default_rng(50).integers(1, 1 << 63, (2, 256), np.uint64)
KEPT_POWERS = 1 << 20
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, for a length of at least n."""
    size = 1 << max(16, n.bit_length())
    if size in _POWERS:
        return _POWERS[size]
    both = []
    for step in (_STEP, _INVERSE):
        powers = np.full(size, step)
        powers[0] = 1
        both.append(np.multiply.accumulate(powers, out=powers))
    if size <= KEPT_POWERS:  # workers live on after a task, so only short ones are kept
        _POWERS.clear()
        _POWERS[size] = tuple(both)
    return tuple(both)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of substrings of some bytes, by sums of byte values times powers."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _VALUES):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.down[:n] + np.uint64(length)) if n > 0 else np.zeros(0, np.uint64)


def anchors(data: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: for each anchor its text, seed hash, extent hash, place, first and last window start."""
    none = np.zeros(0, np.int64)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    hashes = Hasher(data)
    seeds = hashes.every(seed)
    n = len(data) - length + 1
    if n <= 0:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    width = length - seed + 1
    value, place = seeds.copy(), np.arange(len(seeds), dtype=np.int32)
    have = 1
    while have < width:  # minima of doubled reach; a tie goes to the left
        far = min(have, width - have)
        m = len(value) - far
        right = value[far:] < value[:m]
        place = np.where(right, place[far:], place[:m])
        value = np.where(right, value[far:], value[:m])
        have += far
    text = np.repeat(np.arange(len(ends), dtype=np.int32), ends - begins)[:n]
    starts = np.arange(n)
    ok = starts + length <= ends[text]
    starts, text, place = starts[ok], text[ok], place[:n][ok].astype(np.int64)
    if not len(starts):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(starts) - 1]])
    a, b, at, which = starts[new], starts[last], place[new], text[new]
    extent = hashes.of(a, b + length) ^ mix((at - a).astype(np.uint64) + np.uint64(0x51ED))
    return which.astype(np.int64), seeds[at], extent, at - begins[which], a - begins[which], b - begins[which]


class Family:
    """Sorted levels of key and smallest doc_id; levels of about one size merge."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    @staticmethod
    def array(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys)
        keys = keys[order]
        first = _cuts(keys)[:-1]
        return keys[first], np.minimum.reduceat(docs[order], first)

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        """Small batches are gathered until they make an array of BATCH entries."""
        if not len(keys):
            return
        self.waiting.append((keys, docs))
        self.n_waiting += len(keys)
        if self.n_waiting >= BATCH:
            self.settle()

    def settle(self) -> None:
        if not self.waiting:
            return
        keys, docs = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        self.levels.append(self.array(keys, docs))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            k, d = (np.concatenate(x) for x in zip(self.levels.pop(), self.levels.pop(), strict=True))
            self.levels.append(self.array(k, d))

    def first(self, keys: np.ndarray) -> np.ndarray:
        """The smallest doc_id of each key, by a scan of the sorted keys against every level."""
        self.settle()
        order = np.argsort(keys)
        asked = keys[order]
        least = np.full(len(keys), np.iinfo(np.int64).max)
        for k, d in self.levels:
            at = np.minimum(np.searchsorted(k, asked), len(k) - 1)
            np.minimum(least, np.where(k[at] == asked, d[at], least), out=least)
        out = np.empty_like(least)
        out[order] = least
        return out


def first_of(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """The smallest doc_id of each key; in the order of doc_id no later batch can hold a smaller one."""
    family, out, order = Family(), np.empty(len(keys), np.int64), np.argsort(docs, kind="stable")
    for i in range(0, len(order), BATCH):
        part = order[i : i + BATCH]
        family.add(keys[part], docs[part])
        out[part] = family.first(keys[part])
    return out


def classes(*columns: np.ndarray) -> np.ndarray:
    """A number for each row; rows have the same one if they are alike in every column."""
    order = np.lexsort(columns)
    out = np.zeros(len(order), np.uint64)
    if len(order):
        new = np.zeros(len(order), bool)
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        out[order] = np.cumsum(new).astype(np.uint64)
    return out


#: What an anchor's answer holds: its first window start and how many more windows follow.
_EXTENT = np.dtype([("a", "<u4"), ("more", "u1")])


def _laid(batch: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    raw = text_bytes(batch.column(column))
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw]).astype(np.int64), raw


def _cuts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)


_ROUTED = pa.schema([("shard", pa.int32()), ("rows", pa.binary()), ("place", pa.int32()), ("post", pa.binary())])
_ROUTED_DDL = "shard int, rows binary, place int, post binary"
_ANSWER_DDL = "doc_id long, mark long, found binary, open binary"


def _answers(doc: np.ndarray, mark: np.ndarray, found: np.ndarray, values: np.ndarray):
    """For each document (doc_id, mark): the values that are found and those that are open, packed."""
    order = np.lexsort((mark, doc))
    doc, mark, found, values = doc[order], mark[order], found[order], values[order]
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1]), [True]])) if len(doc) else np.zeros(1, np.int64)
    for i in range(0, len(cut) - 1, 5000):
        ends = cut[i : i + 5001]
        spans = list(zip(ends[:-1], ends[1:], strict=True))
        yield pa.array(doc[ends[:-1]], pa.int64()), pa.array(mark[ends[:-1]].astype(np.int64), pa.int64()), pa.array([values[a:b][found[a:b]].tobytes() for a, b in spans], pa.binary()), pa.array([values[a:b][~found[a:b]].tobytes() for a, b in spans], pa.binary())


def _routed(numbers: np.ndarray, rows: list[tuple[int, bytes]], posts: list[tuple[int, bytes]]):
    """Batches of what goes to shards, by their numbers, and of what was settled here and passes through them to its place."""
    for routed, first in ((rows, 0), (posts, 2)):
        at = 0
        for cut in _lots([len(x[1]) for x in routed]):
            part, at = routed[at:cut], cut
            to, blobs = np.array([x[0] for x in part], np.int32), pa.array([x[1] for x in part], pa.binary())
            none = [pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.binary())]
            columns = [pa.array(numbers[to], pa.int32()), blobs, *none] if first == 0 else [pa.array(numbers[to % len(numbers)], pa.int32()), none[1], pa.array(to, pa.int32()), blobs]
            yield pa.RecordBatch.from_arrays(columns, schema=_ROUTED)


def _posts(places: int, doc: np.ndarray, mark: np.ndarray, found: np.ndarray, values: np.ndarray) -> list[tuple[int, bytes]]:
    """What is known of documents as a blob for each place where theirs is put together."""
    place = (mix(doc.astype(np.uint64)) % np.uint64(places)).astype(np.int64)
    order = np.lexsort((mark, doc, place))
    place, doc, mark, found, values = (x[order] for x in (place, doc, mark, found, values))
    new = np.ones(len(doc), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    first, local = np.flatnonzero(new), np.cumsum(new) - 1
    cut = _cuts(place)
    return [(int(place[x]), _pack_table(local[x:y], doc[first], mark[first], found[x:y].astype("u1"), values[x:y])) for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _lots(sizes: list[int]) -> list[int]:
    """Where lots of about SENT_BYTES end, each of one row at least."""
    lot = (np.cumsum(sizes) - sizes) // SENT_BYTES if sizes else np.zeros(0, np.int64)
    return _cuts(lot)[1:].tolist()


class _Gathered:
    """Columns of the documents and rows of several batches; a row names its document by its place."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.n = self.docs = 0

    def add(self, ids: np.ndarray, marks: np.ndarray, which: np.ndarray, *columns: np.ndarray) -> None:
        self.parts.append((ids, marks, (which + self.docs).astype(np.int32), *columns))
        self.n, self.docs = self.n + len(which), self.docs + len(ids)

    def full(self) -> bool:
        return max(self.n, self.docs) >= GATHERED

    def take(self) -> list[np.ndarray]:
        out = [np.concatenate(x) for x in zip(*self.parts, strict=True)]
        self.__init__()
        return out


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, then all second ones, and so on: the high bytes of places are alike, so the shuffle packs them well."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _pack_table(local: np.ndarray, doc: np.ndarray, mark: np.ndarray, *columns: np.ndarray) -> bytes:
    """Columns of rows with a table of their documents and how many rows each has; local: the row's document in doc, ascending."""
    cut = _cuts(local)
    used = local[cut[:-1]]
    steps = np.diff(doc[used], prepend=np.int64(0)).astype("<i8")  # ids mostly ascend: small steps pack well
    return b"".join([struct.pack("<II", len(used), len(local)), *map(_planes, (steps, mark[used].astype("<u4"), np.diff(cut).astype("<u4"), *columns))])


def _unpack_table(blob: bytes, *kinds: str) -> list[np.ndarray]:
    m, n = struct.unpack_from("<II", blob)
    at, out = 8, []
    for kind, rows in (("<i8", m), ("<u4", m), ("<u4", m), *((k, n) for k in kinds)):
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(blob, np.uint8, rows * size, at).reshape(size, rows).T).view(kind).ravel())
        at += rows * size
    return [np.repeat(np.cumsum(out[0]), out[2]), np.repeat(out[1], out[2]), *out[3:]]


def _per_shard(df: DataFrame, work, shards: int, values: np.dtype) -> DataFrame:
    """work(list of blobs) for each shard, and what it finds put together for each document: doc_id, mark, found, open.

    Shards of a task follow one another, two a task, so that none is above the others; a task that is lost costs its shards
    only. It sends a blob for each place, so rows don't grow with the answers, and what was settled before passes through.
    """
    places = tasks_of(shards)

    def run(batches):
        now, held, known = None, [], []

        def posted():
            lots = _posts(places, *(np.concatenate(x) for x in zip(*known, strict=True))) if known else []
            known.clear()
            at = 0
            for cut in _lots([len(x[1]) for x in lots]):
                part, at = lots[at:cut], cut
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.binary())], names=["place", "post"])

        for batch in batches:
            numbers = batch.column(0).to_pylist()
            passing = batch.column(1).is_null()
            if (n := passing.true_count) > 0:
                yield pa.RecordBatch.from_arrays([c.filter(passing) for c in batch.columns[2:]], names=["place", "post"])
            if n == len(numbers):
                continue
            for shard, rows in zip(numbers, batch.column(1), strict=True):
                if not rows.is_valid:
                    continue
                if shard != now and held:
                    known.append(work(held))
                    held = []
                    if sum(len(x[0]) for x in known) >= GATHERED:
                        yield from posted()
                now = shard
                held.append(rows.as_py())
        if held:
            known.append(work(held))
        yield from posted()

    def together(batches):
        now, held = None, []
        for batch in batches:
            for place, post in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if place != now and held:
                    yield from _put_together(held, values)
                    held = []
                now = place
                held.append(post.as_py())
        if held:
            yield from _put_together(held, values)

    posts = df.repartition(places, "shard").sortWithinPartitions("shard").mapInArrow(run, "place int, post binary")
    return posts.repartition(places, "place").sortWithinPartitions("place").mapInArrow(together, _ANSWER_DDL)


def _put_together(blobs: list[bytes], values: np.dtype):
    doc, mark, found, known = (np.concatenate(x) for x in zip(*(_unpack_table(blob, "u1", values) for blob in blobs), strict=True))
    for columns in _answers(doc, mark, found.astype(bool), known):
        yield pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "mark", "found", "open"])


def tasks_of(shards: int) -> int:
    return max(1, min(MOST_TASKS, shards // 2))


def shard_numbers(shards: int) -> np.ndarray:
    """Numbers for shards that Spark's hash deals to all tasks alike."""
    return dealt_numbers(shards, tasks_of(shards))


def _smaller_here(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each row: the smallest doc of its key among these rows."""
    least = np.empty(len(keys), np.int64)
    if len(keys):
        order = np.argsort(keys)
        cut = _cuts(keys[order])
        least[order] = np.repeat(np.minimum.reduceat(doc[order], cut[:-1]), np.diff(cut))
    return least


def _spans(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching [start, end) as maximal runs."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return list(zip(starts[new].tolist(), reach[np.concatenate([new[1:] - 1, [len(reach) - 1]])].tolist(), strict=True))


def find_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED, shards: int | None = None) -> DataFrame:
    """doc_id, mark (crc32 of the text), found and hits: extents and window starts that occur in smaller doc_ids.

    docs: doc_id, text and mark, none null; the second round joins it as the caller joins the result, so that both share
    one shuffle of the texts. A task settles what the documents it gathers show: an anchor whose extent is in a smaller
    doc_id of these is found, one of which only the seed is goes straight to the second round. So a passage that a
    third of all documents share sends one row for each lot that is gathered.
    """
    if not 0 < seed <= length <= seed + 127:
        raise ValueError("an anchor's windows, length - seed + 1 of them at most, are counted in seven bits")
    shards = shards or max(min(shards_for(docs, SHARD_BYTES), MANY_SHARDS), shards_for(docs, MOST_SHARD_BYTES))

    def index():
        numbers, places, held = shard_numbers(shards), tasks_of(shards), _Gathered()

        def step(batch):
            if batch is not None:
                data, ends, raw = _laid(batch, 1)
                which, seeds, extent, _, a, b = anchors(data, ends, length, seed)
                held.add(batch.column(0).to_numpy(zero_copy_only=False), np.array([zlib.crc32(x) for x in raw], np.uint32), which, seeds, extent, a.astype("<u4"), (b - a).astype("u1"))
            if held.n and (batch is None or held.full()):
                yield from settled(*held.take())

        def settled(ids, marks, which, seeds, extent, a, more):
            doc = ids[which]
            least = _smaller_here(seeds, doc)
            least_extent = _smaller_here(classes(extent, seeds), doc)
            here = least < doc
            values = np.zeros(len(which), _EXTENT)
            values["a"], values["more"] = a, more
            # a seed with anchors for the second round asks for all its anchors
            asks = np.isin(seeds, seeds[here & (least_extent == doc)])
            send = np.flatnonzero(~here)
            shard = ((seeds[send] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            send, shard = (x[np.argsort(shard, kind="stable")] for x in (send, shard))
            rows = []
            for x, y in zip(_cuts(shard)[:-1], _cuts(shard)[1:], strict=True):
                s = send[x:y]
                rows.append((int(shard[x]), _pack_table(which[s], ids, marks, (seeds[s] >> np.uint64(32)).astype("<u4"), seeds[s].astype("<u2"), extent[s].astype("<u8"), a[s], more[s] | (asks[s].astype("u1") << 7))))
            yield from _routed(numbers, rows, _posts(places, doc[here], marks[which][here], (least_extent < doc)[here], values[here]))

        return step

    def scan(blobs):
        parts = []
        for blob in blobs:
            doc, mark, high, low, extent, a, more = _unpack_table(blob, "<u4", "<u2", "<u8", "<u4", "u1")
            key = (high.astype(np.uint64) << np.uint64(16)) | low
            parts.append((key, extent, doc, mark, a, more))
        key, extent, doc, mark, a, more = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key)
        key, extent, doc, mark, a, more = (x[order] for x in (key, extent, doc, mark, a, more))
        first, first_whole = first_of(key, doc), first_of(classes(extent, key), doc)
        found = first_whole < doc
        group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        asked = np.zeros(int(group[-1]) + 1, bool)
        asked[group[((first < doc) & ~found) | (more > 127)]] = True
        use = found | asked[group]
        values = np.zeros(int(use.sum()), _EXTENT)
        values["a"], values["more"] = a[use], more[use] & 127
        return doc[use], mark[use], found[use], values

    long_enough = docs.select("doc_id", "text").where(F.octet_length("text") >= length)
    answers = _per_shard(arrow_map(long_enough, _ROUTED_DDL, index, last=True), scan, shards, _EXTENT)
    with shuffles_dropped(docs.sparkSession):  # the second round's come in their place
        first_round = materialize(answers, "repeat-anchors")

    def windows():
        numbers, places, held = shard_numbers(shards), tasks_of(shards), _Gathered()

        def step(batch):
            if batch is not None:
                data, ends, raw = _laid(batch, 1)
                begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                at, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for i, open_ in enumerate(batch.column(2).to_pylist()):
                    f = np.frombuffer(open_, _EXTENT)
                    n = f["more"].astype(np.int64) + 1
                    at.append(np.repeat(f["a"].astype(np.int64), n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
                    which.append(np.full(len(at[-1]), i))
                at, which = np.concatenate(at), np.concatenate(which)
                s = begins[which] + at
                key, other = Hasher(data).of(s, s + length), Hasher(data, _OTHER_VALUES).of(s, s + length).astype("<u4")
                held.add(batch.column(0).to_numpy(zero_copy_only=False), np.array([zlib.crc32(x) for x in raw], np.uint32), which, at.astype("<u4"), key, other)
            if held.n and (batch is None or held.full()):
                yield from settled(*held.take())

        def settled(ids, marks, which, at, key, other):
            doc = ids[which]
            least = _smaller_here(classes(other, key), doc)
            here = least < doc
            send = np.flatnonzero(~here)
            shard = ((key[send] >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
            send, shard = (x[np.argsort(shard, kind="stable")] for x in (send, shard))
            rows = [(int(shard[x]), _pack_table(which[send[x:y]], ids, marks, key[send[x:y]].astype("<u8"), other[send[x:y]], at[send[x:y]])) for x, y in zip(_cuts(shard)[:-1], _cuts(shard)[1:], strict=True)]
            yield from _routed(numbers, rows, _posts(places, doc[here], marks[which][here], np.ones(int(here.sum()), bool), at[here]))

        return step

    def settle(blobs):
        doc, mark, key, other, at = (np.concatenate(x) for x in zip(*(_unpack_table(blob, "<u8", "<u4", "<u4") for blob in blobs), strict=True))
        hit = first_of(classes(other, key), doc) < doc
        return doc[hit], mark[hit], np.ones(int(hit.sum()), bool), at[hit]

    open_docs = first_round.where("octet_length(open) > 0").select("doc_id", "mark", "open")
    hits = _per_shard(arrow_map(docs.join(open_docs, ["doc_id", "mark"]).select("doc_id", "text", "open"), _ROUTED_DDL, windows, last=True), settle, shards, np.dtype("<u4")).select("doc_id", "mark", F.col("found").alias("hits"))
    return first_round.where("octet_length(found) > 0").select("doc_id", "mark", "found").join(hits, ["doc_id", "mark"], "full")


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes) of every document.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller doc_id. A null text is
    empty. Rows that share a doc_id are parts of one document: nothing in them counts as earlier for one another. A row
    with a null doc_id has no place in the order: it is kept whole and takes no part. An empty table gives no rows; other
    columns are ignored.
    """
    prepare(docs.sparkSession)
    # a column of the right type goes as it is: an alias would stay on one side only and keep the two rounds from sharing a shuffle
    kinds = dict(docs.dtypes)
    base = docs.select(*[F.col(c) if kinds[c] == kind else F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "bigint"), ("text", "string"))])
    ordered = base.withColumn("mark", F.crc32(F.col("text").cast("binary"))).where("doc_id is not null and mark is not null")
    marks = find_repeats(ordered, length, seed)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    final = ordered.join(marks, ["doc_id", "mark"], "left").select("doc_id", "text", "found", "hits")
    aside = base.where("doc_id is null or text is null").select("doc_id", "text", *[F.lit(None).cast("binary").alias(c) for c in ("found", "hits")])
    final = final.unionByName(aside)

    def cut():
        def step(batch):
            size, removed, n_spans, kept = [], [], [], []
            for text, found, hits in zip(text_bytes(batch.column(1)), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                f = np.frombuffer(found or b"", _EXTENT)
                h = np.frombuffer(hits or b"", "<u4").astype(np.int64)
                a = f["a"].astype(np.int64)
                spans = _spans(np.concatenate([a, h]), np.concatenate([a + f["more"] + length, h + length])) if len(a) + len(h) else []
                parts, at = [], 0
                for x, y in spans:
                    parts.append(text[at:x])
                    at = y
                parts.append(text[at:])
                size.append(len(text))
                kept.append(b"".join(parts))
                removed.append(len(text) - len(kept[-1]))
                n_spans.append(len(spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], names=names)

        return step

    return arrow_map(final, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", cut)
