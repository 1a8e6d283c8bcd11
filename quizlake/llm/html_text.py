"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text that their own blocks hold and by how little of it is links; a container is
known by its generalised path of tags and classes, digits left out. The pages of a host vote in Spark, and each page is
read again by the best path of its host that it has. The few best paths of a host go to all its pages; a page that has none
of them is joined with the votes of the paths that it has. Pages vote on surroundings too: a part of the article that stands
with the same text on other pages of the host, at the same path, is none of it.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quizlake.llm.common import arrow_map, materialize, prepare, texts

PATHS_PER_PAGE = 3
#: So many paths go to every page of the host; those behind them are joined to the pages that have none of these.
PATHS_PER_HOST = 8
#: Paths of all hosts up to this size go to every task; beyond it pages are dealt by host and one of SALTS numbers.
BROADCAST_BYTES = 16_000_000
SALTS = 32
#: Different pages of a host on which a part must stand with the same text to be surroundings: named as if it were, and not.
REPEATS_NAMED = 2
REPEATS = 4
#: Characters below which a part of no telling name is never surroundings, however often it stands: a byline, a date.
SHORT = 25
#: Characters of a block that is prose, so that a form around it may be the page's.
LONG = 140
#: An attribute by the rules of HTML: a name, which may begin with =, and a value that quotes or white space end. No part gives back what it took, so a page is read once.
_ATTRIBUTE = r"""=?[^\s/>=]++(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+|(?=>)|\Z))?+|="""
#: Comments; tags; the begin of a tag that never ends, which takes the rest of the page; other markup up to the next >.
_TOKEN = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ATTRIBUTE})*+)>|(</?[a-zA-Z])|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMED = re.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+("[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+|(?=>)|\Z))?+|=""")
_WANTED = re.compile(r"class|id|role|hidden|style", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text.
_RAW = frozenset("script style noscript template iframe textarea title svg math canvas object video audio select option xmp noembed noframes".split())
_DROP = frozenset("head nav footer aside button dialog menu fieldset label datalist".split()) | _RAW
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
_CONTAINER = frozenset("article main section div body td blockquote".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_CLOSES_P = _BLOCK - {"dd", "dt", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
_AROUND_P = _CONTAINER | {"li", "td"}
_LISTS = frozenset({"ul", "ol", "dl", "table"})
#: Elements that may hold a part of a page, so that a compound name says what they are; a paragraph's or a word's doesn't.
_HOLDS = _CONTAINER | frozenset("ul ol dl table aside nav header footer form details dialog menu center figure".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Names of a page's surroundings. A class, id or role is one if it is one of these, or if its first or last part is and a container has it.
_NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer header masthead cookie cookies consent notice popup modal overlay newsletter subscribe signup "
    "comment comments respond replies reply disqus discussion share sharing social related recommended toolbar pagination pager widget search login skip complementary contentinfo alert alertdialog gdpr".split()
)
_REMARK = frozenset("comment comments reply replies respond disqus advert adverts advertisement ad ads sponsored".split())
#: Those that mean something else in an article too: alone, and as the first or last part of a name.
_SENSES = frozenset("menu discussion side header".split())
_SENSES_IN_PART = _SENSES | frozenset("share sharing social related recommended widget search alert respond skip promotion login aside".split())
#: Parts beside which they mean surroundings.
_TELLING = frozenset("posts articles stories links buttons button bar icons area box form pages topics content".split())
#: First parts of names that say how a container is laid out, not what it is.
_LAYOUT = frozenset("has with no without is show hide not in".split())
_PARTS = re.compile(r"[-_]+")
#: What a part of a page is: of no telling name; named so that it may be surroundings; named as surroundings; a form; a header.
_PLAIN, _OPEN, _AROUND, _FORM, _HEADER = range(5)


def is_noise(names: str, known: frozenset[str], compound: bool) -> bool:
    """Whether a name of a list parted by white space is known; compound: or begins or ends with a part that is."""
    for name in names.lower().split():
        if name in known:
            return True
        if compound and not known.isdisjoint((x := _PARTS.split(name))[:: max(1, len(x) - 1)]) and x[0] not in _LAYOUT:
            return True
    return False


def _kind(names: str, compound: bool, inside: bool) -> int:
    """What names say of an element; inside: whether an article or main is around it, where some names have another sense."""
    kind = _PLAIN
    for name in names.lower().split():
        if name in _NOISE:
            sense = name in _SENSES
        elif compound and (ends := set((x := _PARTS.split(name))[:: max(1, len(x) - 1)])) & _NOISE and x[0] not in _LAYOUT:
            sense = ends & _NOISE <= _SENSES_IN_PART and not ends & _TELLING and not (len(ends) == 2 and ends <= _NOISE)
        else:
            continue
        if not (inside and sense):
            return _AROUND
        kind = _OPEN
    return kind


class _Node:
    __slots__ = ("block", "drop", "inside", "link", "part", "path", "tag")

    def __init__(self, tag, path, drop, link, inside, block, part):
        self.tag, self.path, self.drop, self.link, self.inside = tag, path, drop, link, inside
        self.block, self.part = block, part  # place of the last block element so far; the part of the page around


class _Stack:
    """Open elements, and where each tag is open."""

    def __init__(self):
        self.nodes, self.places = [_Node("", 0, False, False, False, 0, 0)], defaultdict(list)

    @property
    def top(self) -> _Node:
        return self.nodes[-1]

    def push(self, node: _Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of some tags; 0 if none is open."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def close(self, tags, stop) -> None:
        """Ends an open element of ``tags`` that a new one ends by itself, unless an element of ``stop`` lies between."""
        if (at := self.last(tags)) and at > self.last(stop):
            self.cut(at)


class _Part:
    """An element that is kept or dropped as a whole, with sums over its blocks: those of parts inside are added at the end."""

    __slots__ = ("around", "chars", "kind", "linked", "long", "main", "path", "text", "titled")

    def __init__(self, around: int, kind: int, path: int):
        self.around, self.kind, self.path = around, kind, path
        self.chars = self.linked = self.text = 0
        self.main = self.titled = self.long = False  # holds an article or main; or an h1; or a block of prose

    def add(self, inner: _Part) -> None:
        self.chars, self.linked, self.text = self.chars + inner.chars, self.linked + inner.linked, self.text + inner.text & _MASK
        self.main, self.titled, self.long = self.main or inner.main, self.titled or inner.titled, self.long or inner.long

    def dropped(self, half: float) -> bool:
        """Whether the page itself shows that it is none of its article: half is half of the page's letters outside links."""
        if self.kind == _PLAIN:
            return False
        if self.kind == _OPEN:
            return self.linked * 2 >= self.chars
        holds = self.main or self.kind != _HEADER and self.titled or self.kind == _FORM and self.long
        return not (holds and self.chars - self.linked > half)

    def votes(self) -> bool:
        return not self.main and (self.kind == _OPEN and self.chars > 0 or self.kind == _PLAIN and not self.titled and self.chars >= SHORT)


_MASK = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Page:
    """A page that was read once: its container paths, each after the one around it, its parts likewise, and its text blocks.

    keys, names, around, depth: of each path; the first is the page. found: (path, text, characters in links, part) of the
    blocks in page order. gone: whether each part is dropped by what the page shows.
    """

    def __init__(self):
        self.keys, self.names, self.around, self.depth = [0], [""], [0], [0]
        self.known: dict[tuple[int, str], int] = {}
        self.parts = [_Part(0, _PLAIN, 0)]
        self.found: list[tuple[int, str, int, int]] = []
        self.gone: list[bool] = []

    def path(self, around: int, mark: str) -> int:
        """The place of the path ``around`` with a mark behind it; its key is a hash of the key before and the mark."""
        at = self.known.get((around, mark))
        if at is None:
            at = self.known[around, mark] = len(self.keys)
            self.keys.append(_signed(xxhash.xxh3_64_intdigest(mark.encode("utf-8", "surrogatepass"), self.keys[around] & _MASK)))
            self.names.append(mark)
            self.around.append(around)
            self.depth.append(self.depth[around] + self.counts(at))
        return at

    def counts(self, at: int) -> bool:
        """Whether a path is a container's, that may be the main one; other elements have a path as parts only."""
        return self.names[at].partition(".")[0] in _CONTAINER

    def part(self, around: int, kind: int, path: int) -> int:
        self.parts.append(_Part(around, kind, path))
        return len(self.parts) - 1

    def block(self, path: int, text: str, linked: int, part: int) -> None:
        self.found.append((path, text, linked, part))
        p = self.parts[part]
        p.chars, p.linked, p.text = p.chars + len(text), p.linked + linked, p.text + xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) & _MASK
        p.long = p.long or len(text) - linked >= LONG

    def end(self) -> Page:
        for p in reversed(self.parts[1:]):
            self.parts[p.around].add(p)
        half = (self.parts[0].chars - self.parts[0].linked) / 2
        self.gone = [False] * len(self.parts)
        for i, p in enumerate(self.parts[1:], 1):
            self.gone[i] = self.gone[p.around] or p.dropped(half)
        return self

    def blocks(self) -> list[tuple[int, str, int]]:
        return [(path, text, linked) for path, text, linked, part in self.found if not self.gone[part]]

    def paths(self) -> dict[int, int]:
        """Keys of the paths around the blocks, and their places."""
        seen = {0}
        for path, _, _ in self.blocks():
            while path not in seen:
                seen.add(path)
                path = self.around[path]
        return {self.keys[at]: at for at in seen if at}

    def repeated(self) -> list[tuple[int, int]]:
        """Key of the path and hash of the text of parts that are surroundings if other pages have them."""
        return sorted({(self.keys[p.path], _signed(p.text)) for i, p in enumerate(self.parts) if i and not self.gone[i] and p.votes()})

    def text(self, at: int, named: frozenset[int] = frozenset(), plain: frozenset[int] = frozenset()) -> str:
        """The blocks within a path, without parts that the host repeats, unless these are more than half of them."""
        inside = [True] * len(self.keys)
        for i in range(1, len(self.keys)):
            inside[i] = i == at or not at or (i > at and inside[self.around[i]] and self.around[i] >= at)
        inside[0] = not at
        out = [(text, part) for path, text, _, part in self.found if inside[path] and not self.gone[part]]
        if named:
            again = [False] * len(self.parts)
            for i, p in enumerate(self.parts[1:], 1):
                again[i] = again[p.around] or p.votes() and self.keys[p.path] ^ _signed(p.text) in (named if p.kind == _OPEN else plain)
            kept = [(text, part) for text, part in out if not again[part]]
            if sum(len(text) for text, _ in kept) * 2 >= sum(len(text) for text, _ in out):
                out = kept
        return "\n".join(text for text, _ in out)


def attributes(text: str) -> tuple[str, bool]:
    """The classes, id and role of a tag, and whether it is hidden. Of a repeated attribute the first counts."""
    if not _WANTED.search(text):
        return "", False
    found: dict[str, str] = {}
    for name, value in _NAMED.findall(text):
        found.setdefault(name.lower(), entities.unescape(value.strip(value[0]) if value[:1] in ("'", '"') else value))
    names = " ".join(found[x] for x in ("class", "id", "role") if x in found)
    return names, "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDDEN.search(found.get("style", "")))


def blocks(html: str) -> list[tuple[int, str, int]]:
    """The page's text blocks in order: place of the path around, text, characters in links."""
    return read_page(html).blocks()


def read_page(html: str) -> Page:
    page = Page()
    stack = _Stack()
    parts: list[str] = []
    linked = 0

    def end_block():
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                page.block(stack.top.path, text, min(linked, len(text)), stack.top.part)
            parts.clear()
            linked = 0

    at, raw = 0, None
    size = len(html)
    while at < size:
        if raw:
            m = re.compile(rf"</{raw}(?=[\s/>])[^>]*+>?", re.I).search(html, at)
            at, raw = (m.end() if m else size), None
            continue
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else size]
        if text and not stack.top.drop:
            parts.append(text)
            if stack.top.link:
                linked += len(text)
        if not m or m[4]:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not (place := stack.last((tag,))):
                if tag in ("p", "br") and not stack.top.drop:
                    end_block()
                continue
            if tag in _BLOCK:
                end_block()
            elif stack.top.block > place:
                continue  # an inline tag that ends after its block did
            stack.cut(place)
            continue
        if tag in _VOID:
            if tag == "hr":
                end_block()
            elif tag in ("br", "img", "input") and not stack.top.drop:
                parts.append(" ")
            continue
        if tag in _BLOCK:
            end_block()
            if tag in _CLOSES_P:
                stack.close(("p",), _AROUND_P)
            if tag in _SIBLINGS:
                stack.close(_SIBLINGS[tag], _LISTS | ({"tr"} if tag in ("td", "th") else set()))
        top = stack.top
        named, hidden = attributes(m[3]) if m[3] else ("", False)
        drop = top.drop or hidden or tag in _DROP
        kind = _FORM if tag == "form" else _HEADER if tag == "header" and not top.inside else _PLAIN
        if named and not drop and kind == _PLAIN and tag not in ("body", "html", "main") and tag not in _HEADING:
            drop = is_noise(named, _REMARK, tag in _HOLDS)
            kind = _PLAIN if tag == "article" else _kind(named, tag in _HOLDS, top.inside)
            drop = drop or kind == _AROUND and tag not in _CONTAINER
        path, part = top.path, top.part
        if not drop:
            if tag in _CONTAINER or kind != _PLAIN or (named and tag in _HOLDS):
                path = page.path(path, ".".join((tag, *sorted(_DIGITS.sub("#", named).split()))))
            if kind != _PLAIN or (named and tag in _HOLDS and tag not in ("body", "main", "article")):
                part = page.part(part, kind, path)
            if tag in ("article", "main"):
                page.parts[part].main = True
            if tag in ("article", "main", "h1"):
                page.parts[part].titled = True
        if m[3].endswith("/") and tag in ("svg", "math"):
            continue
        if tag in _RAW - {"svg", "math", "object", "video", "audio", "select", "option", "canvas", "noscript", "template"}:
            raw = re.escape(tag)
            continue
        stack.push(_Node(tag, path, drop, top.link or tag == "a", top.inside or tag in ("article", "main"), len(stack.nodes) if tag in _BLOCK else top.block, part))
    end_block()
    return page.end()


def scored(page: Page) -> list[tuple[float, int, int]]:
    """Of each container path how much it looks like the main text, its depth and its key, the best first.

    Characters outside links count, in the innermost container most; sums go from each path to the one around it.
    """
    total = [0.0] * len(page.keys)
    for path, text, linked in page.blocks():
        total[path] += (len(text) - 2 * linked) * (1 if len(text) >= SHORT or text[-1] in ".!?" else 0.5)
    for i in range(len(total) - 1, 0, -1):
        total[page.around[i]] += total[i] * (0.9 if page.counts(i) else 1)
    out = []
    for i in range(1, len(total)):
        if total[i] > 0 and page.counts(i):
            tag, *names = page.names[i].split(".")
            weight = 2.0 if tag == "article" else 1.5 if tag == "main" or "main" in names else 0.8 if tag == "body" else 1.0
            out.append((-math.log1p(total[i]) * weight, -page.depth[i], page.keys[i]))
    return [(-score, -depth, key) for score, depth, key in sorted(out)]


def host_of(url):
    """The host of a URL without port and user; an unreadable or null URL has the empty host."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def rest_of(joined: DataFrame, votes: DataFrame) -> DataFrame:
    """host, key, rest: of the pages of joined that have none of their host's ``paths``, the best voted path that they have."""

    def list_paths():
        def step(batch):
            hosts, keys, own = [], [], []
            for host, key, html, paths in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                have = read_page(html or "").paths()
                if have.keys().isdisjoint(paths or ()):
                    hosts += [host] * len(have)
                    keys += [key] * len(have)
                    own += have
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.string()), pa.array(own, pa.int64())], names=["host", "key", "path"])

        return step

    own = arrow_map(joined.select("host", "key", "html", "paths"), "host string, key string, path long", list_paths)
    return own.join(votes, ["host", "path"]).groupBy("host", "key").agg(F.min(F.struct((-F.col("votes")).alias("v"), (-F.col("depth")).alias("d"), "path"))["path"].alias("rest"))


def surroundings(seen: DataFrame) -> DataFrame:
    """host, named, plain: codes of parts whose text most pages of the host that have the part share, and not only copies of one page.

    A code is the hash of the path crossed with that of the text, so that a page loses the part only where its text is that.
    Different pages are counted by one bit of 64 each, which never says too many.
    """
    most = seen.groupBy("host", "path").agg(F.sum("n").alias("all"), F.max(F.struct("n", "text", "bits")).alias("m"))
    most = most.where(F.col("m.n") * 2 > F.col("all")).select("host", F.col("path").bitwiseXOR(F.col("m.text")).alias("code"), F.bit_count("m.bits").alias("pages")).where(F.col("pages") >= REPEATS_NAMED)
    return most.groupBy("host").agg(F.sort_array(F.collect_list("code")).alias("named"), F.sort_array(F.collect_list(F.when(F.col("pages") >= REPEATS, F.col("code")))).alias("plain"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page.

    A null or empty html has the empty text; a page is read in one pass whatever its markup, by the rules of HTML for tags, so
    what follows a tag that never ends is no text. Names of classes, ids and roles drop what they name as surroundings, but a
    container that holds most of the page's text and its article, main or h1 stays, as does a form with most of its text.
    Names that mean something else within an article ("discussion", "related-work") drop a part of it only if half of it is
    links, or another page of the host has it with the same text; a part of any name goes if that is so on four different
    pages, and on most that have it. Only the repeated text goes, and nothing if it is more than half of the article.
    Pages of a null or unreadable URL vote together; repeated rows are read each; ties between paths go to the deeper, then to
    the one of the smaller hash; an empty table gives no rows; other columns are ignored. A page votes for its three best
    paths. Votes are summed for each host and path before they are dealt out; a host's best paths are one small row, so a host
    with a third of the pages is no burden. They are written, and their size decides how pages get them: small ones are
    broadcast and pages stay where they are; else a host's pages are salted. A page's own best path always has a vote, so
    where a host has no more paths than those, every page has one of them; the pages of other hosts that have none are looked
    up by host and path among all votes.
    """
    prepare(pages.sparkSession)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"))

    def vote():
        def step(batch):
            votes: dict[tuple, list] = {}
            for host, html in zip(texts(batch.column(0)), texts(batch.column(1)), strict=True):
                page = read_page(html)
                for (_, depth, path), weight in zip(scored(page)[:PATHS_PER_PAGE], (1.0, 0.25, 0.0625), strict=False):
                    votes.setdefault((host, path, None), [0.0, depth, 0, 0])[0] += weight
                bit = _signed(1 << page.parts[0].text % 64)
                for path, text in page.repeated():
                    x = votes.setdefault((host, path, text), [0.0, 0, 0, 0])
                    x[2], x[3] = x[2] + 1, x[3] | bit
            if votes:
                columns = [*zip(*votes, strict=True), *zip(*votes.values(), strict=True)]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "path", "text", "votes", "depth", "n", "bits"])

        return step

    ballots = arrow_map(rows.select("host", "html"), "host string, path long, text long, votes double, depth int, n long, bits long", vote)
    ballots = materialize(ballots.groupBy("host", "path", "text").agg(F.sum("votes").alias("votes"), F.max("depth").alias("depth"), F.sum("n").alias("n"), F.bit_or("bits").alias("bits")), "host-votes")
    votes = ballots.where("text is null").select("host", "path", "votes", "depth")
    rank = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("depth"), "path")
    best = votes.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= PATHS_PER_HOST + 1)
    paths = best.groupBy("host").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]), 1, PATHS_PER_HOST).alias("paths"), (F.count("*") > PATHS_PER_HOST).alias("more"))
    paths = paths.join(surroundings(ballots.where("text is not null")), "host", "full")

    paths = materialize(paths, "host-paths")
    size, more = paths.agg(F.coalesce(F.sum(F.octet_length("host") + 8 * (F.greatest(F.size("paths"), F.lit(0)) + F.greatest(F.size("named"), F.lit(0)) + F.greatest(F.size("plain"), F.lit(0))) + 64), F.lit(0)), F.coalesce(F.bool_or("more"), F.lit(False))).head()
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    if more:
        joined = joined.withColumn("key", F.md5(F.coalesce("html", F.lit("")).cast("binary")))
        joined = joined.join(materialize(rest_of(joined.where("more"), votes), "rest-paths"), ["host", "key"], "left")
    else:
        joined = joined.withColumn("rest", F.lit(None).cast("string"))

    def read():
        def step(batch):
            out = []
            for html, paths, rest, named, plain in zip(texts(batch.column(2)), *(batch.column(i).to_pylist() for i in range(3, 7)), strict=True):
                page = read_page(html)
                have = page.paths()
                path = next((p for p in paths or () if p in have), rest)  # none: no container has a score
                out.append(page.text(have.get(path, 0), frozenset(named or ()), frozenset(plain or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

        return step

    kind = dict(rows.dtypes)["page_id"]
    return arrow_map(joined.select("page_id", "url", "html", "paths", "rest", "named", "plain"), f"page_id {kind}, url string, text string", read)
