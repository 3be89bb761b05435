"""Main text of web pages: structure first, then a suffix array over each host's pages.

A page becomes blocks in page order, each in a zone: the article (inside article or main), marked boilerplate (menus,
headers, footers, sidebars, notices, adverts, forms, comments, by element, role or class; never kept), or unmarked. If articles
hold half or more of a page's text outside marks only they are kept; else an article is a teaser among others and its blocks are
unmarked ones. A class name marks only as a whole (``sidebar``, ``cookie-notice``, ``related-posts``, but neither ``no-sidebar`` nor
``share-price-box``), and where nothing is left outside marks those by a layout word are dropped. A raw element (script,
style) ends at its own end tag only. The time is in proportion to a page's size, whatever it leaves open.

Runs of ``RUN`` tokens or more that repeat across a host's pages are boilerplate. Pages of equal main blocks are one page
here; a run doesn't reach from one zone into another. For a block of an article one occurrence at least must be in an unmarked
block, and those in marked zones don't count. Of an unmarked block its covered runs of RUN tokens or more go, or all of it, and
its unique runs stay; a block of an article goes only if it is covered whole.

The suffix array of a whole host is dealt to tasks by minimizers: a suffix's first RUN tokens hold RUN - GRAM + 1 grams of GRAM
tokens, and the least of their hashes names its part, so equal runs meet in one part wherever their pages are. Parts whose
gram occurs on one page only, or in no unmarked block, can't hold a repeat that counts and are left out before any text moves.
Consecutive suffixes of one part travel as one fragment, equal fragments as one row with the least and greatest page. A task
concatenates the fragments of its parts and sorts their suffixes by prefix doubling to RUN tokens, which is as deep as a run's
coverage depends on; a part of more than ``PART`` fragments is dealt anew by its whole runs. The result is the same at any
size of a host, and no task's memory grows with it.

Null html counts as empty and has no text; a null url is a host of its own.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, prepare, stored
from .urlfilter import url_host

RUN, GRAM, PART, TASK, KNOWN = 16, 8, 20_000, 50_000, 1 << 22
ARTICLE, UNMARKED, MARKED = 0, 1, 2
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
_NAME = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_UNTIL = frozenset("script style textarea title".split())  # text up to their own end tag, whatever it holds
_RAW = frozenset("script style noscript template iframe svg math object canvas audio video textarea title select".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
_OUT = frozenset("head nav footer aside form button menu dialog search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login sidebar aside widget related recommended recommendations share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer header masthead topbar comment comments disqus reply replies pagination pager toolbar copyright".split())
_KEEP = frozenset("article post entry story main".split())
_ADS = frozenset("ad ads adv advert adverts advertisement sponsored".split())
_ASIDE = _ADS | frozenset("comment comments reply replies related recommended promo".split())
# words that say nothing by themselves in a class name of several words
_FILL = frozenset("area bar block bottom box button buttons col column container content desktop fixed global group inner item items left link links list mobile outer page panel posts primary right row secondary section site sticky sub text top wrap wrapper articles".split())


@functools.cache
def _end_tag(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I)


_OWN, _LAYOUT = 1, 2  # a mark that stands, and one by a layout word only


def _class_mark(names: str) -> int:
    """What whole class names (or an id) say."""
    found = 0
    for name in names.split():
        words = set(re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name))
        words = {w.lower() for w in words} - {""}
        if words & _WORDS and words <= _WORDS | _FILL | _KEEP:
            if words & _ASIDE:
                return _OWN
            if not words & _KEEP:
                found = _LAYOUT
    return found


def _marked(name: str, attributes: str, in_article: bool) -> int:
    """0, _OWN or _LAYOUT."""
    if name in _OUT or name == "header" and not in_article:
        return _OWN
    if not attributes.strip(" \t\r\n/"):
        return 0
    found = {m[1].lower(): (m[2] or "").strip("\"'") for m in _NAME.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").lower().replace(" ", ""):
        return _OWN
    if found.get("role", "").lower() in _ROLES:
        return _OWN
    if name in ("main", "body", "html"):
        return 0
    says = _class_mark(f"{found.get('class', '')} {found.get('id', '')}")
    if name == "article":
        return says if says == _OWN else 0
    if name not in _BLOCK:
        words = set(f"{found.get('class', '')} {found.get('id', '')}".lower().split())
        return _OWN if words & _ADS else 0
    if says == _LAYOUT and set(found.get("class", "").lower().split()) & _KEEP:
        return 0
    return says


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(zone, text) of every block with text, in page order. If marks cover the whole page, as when one is never closed, an
    article ends them, and else marks by a layout word don't count."""
    for ends_marks, layout in ((False, True), (True, True), (True, False)):
        found = _blocks(page, ends_marks, layout)
        if not found or any(z != MARKED for z, _ in found):
            break
    of = lambda zone: sum(len(t) for z, t in found if z == zone)
    if of(ARTICLE) < of(UNMARKED):
        return [(UNMARKED if z == ARTICLE else z, t) for z, t in found]
    return found


_IMPLIED = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "body": ("head",)} | dict.fromkeys(("option", "h1", "h2", "h3", "h4", "h5", "h6"), ("p",))


class _Open:
    """The open elements of a page: their names, how many there are of each, and which are blocks."""

    def __init__(self):
        self.stack: list[tuple[str, int, int, int]] = []  # name; adds to marked, article, hidden (marked inside a block)
        self.count: Counter = Counter()
        self.blocks: list[int] = []  # places of blocks in the stack
        self.sums = [0, 0, 0]

    def push(self, name: str, *adds: int) -> None:
        if name in _BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((name, *adds))
        self.count[name] += 1
        if any(adds):
            self.sums = [a + b for a, b in zip(self.sums, adds, strict=True)]

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            name, *adds = self.stack.pop()
            self.count[name] -= 1
            if any(adds):
                self.sums = [a - b for a, b in zip(self.sums, adds, strict=True)]
        while self.blocks and self.blocks[-1] >= to:
            self.blocks.pop()

    def end(self, name: str) -> None:
        """An end tag: what it passes is closed too, so each search is paid for by what it closes."""
        if self.count[name]:
            self.pop(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name))

    def implied(self, ends: tuple[str, ...]) -> None:
        """A start tag that ends an open element of these names, unless another block is between."""
        for i in reversed(self.blocks):
            name = self.stack[i][0]
            if name in ends:
                self.pop(i)
                return
            if name not in ("p", "td", "th"):
                return


def _blocks(page: str, article_ends_marks: bool, layout: bool) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    text: list[str] = []
    opened, endless = _Open(), set()

    def flush() -> None:
        if text:
            if joined := " ".join(entities.unescape("".join(text)).split()):
                out.append((MARKED if opened.sums[0] else ARTICLE if opened.sums[1] else UNMARKED, joined))
            text.clear()

    at = 0
    while m := _TOKEN.match(page, at):
        at, name = m.end(), m[2]
        if name is None:
            if not opened.sums[2] and not m[0].startswith(("<!", "<?")):
                text.append(m[0])
            continue
        name = name.lower()
        if name == "br":
            text.append(" ")
            continue
        if name in _BLOCK:
            flush()
        if m[1]:
            opened.end(name)
            continue
        if name in _RAW:
            if name in _UNTIL or not m[3].rstrip().endswith("/"):
                end = None if name in endless else _end_tag(name).search(page, at)
                if end is None:
                    endless.add(name)
                at = end.end() if end else len(page) if name in _UNTIL else at
            continue
        if name in _VOID:
            continue
        if name in _IMPLIED:
            opened.implied(_IMPLIED[name])
        is_article = name in ("article", "main") or 'role="main"' in m[3]
        mark = _marked(name, m[3], opened.sums[1] > 0)
        is_marked = mark == _OWN or mark == _LAYOUT and layout
        if is_article and article_ends_marks:
            opened.pop(0)
        inside = is_marked and name not in _BLOCK
        opened.push(name, is_marked and not inside, is_article, inside)
    flush()
    return out


def _long_runs(gone: np.ndarray, run: int) -> np.ndarray:
    """``gone`` without runs of fewer than ``run`` tokens, which only reach over from the next block; a whole block may be short."""
    if gone.all() or not gone.any():
        return gone
    edges = np.flatnonzero(np.diff(np.r_[0, gone, 0]))
    out = gone.copy()
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a < run:
            out[a:b] = False
    return out


def _wanted(blocks: list[tuple[int, str]]) -> int:
    return ARTICLE if any(z == ARTICLE for z, _ in blocks) else UNMARKED


def _kept(blocks: list[tuple[int, str]], covered: list[tuple[int, int]]) -> list[str]:
    """The kept blocks of a page; covered: (token, bits of the runs from there on that repeat)."""
    wanted, kept, lo = _wanted(blocks), [], 0
    gone = np.zeros(sum(t.count(" ") + 1 for _, t in blocks), bool)
    for at, bits in covered:
        while bits:
            i = (bits & -bits).bit_length() - 1
            gone[at + i : at + i + RUN] = True
            bits &= bits - 1
    for z, text in blocks:
        hi = lo + text.count(" ") + 1
        mine, lo = gone[lo:hi], hi
        if z != wanted:
            continue
        mine = _long_runs(mine, RUN)
        if not mine.any() or z == ARTICLE and not mine.all():
            kept.append(text)
        elif z == UNMARKED and not mine.all():
            kept.append(" ".join(w for w, g in zip(text.split(" "), mine.tolist(), strict=True) if not g))
    return kept


_WEIGHTS = np.random.default_rng(3).integers(0, 2**64, GRAM, np.uint64) | np.uint64(1)


def fragments(host: str, blocks: list[tuple[int, str]]):
    """(part, token, zone, words, begin, end) of a page: for each least gram the runs that hold it, as one stretch of words from ``token`` on."""
    lo, seed = 0, xxhash.xxh64_intdigest(host.encode())
    while blocks:
        zone = blocks[0][0]
        n = next((i for i, (z, _) in enumerate(blocks) if z != zone), len(blocks))
        words, blocks = " ".join(t for _, t in blocks[:n]).split(" "), blocks[n:]
        count = len(words) - RUN + 1
        if count > 0:
            h = np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64)
            grams = sum(h[i : len(h) - GRAM + 1 + i] * _WEIGHTS[i] for i in range(GRAM))
            grams ^= grams >> np.uint64(31)
            inside = np.lib.stride_tricks.sliding_window_view(grams, RUN - GRAM + 1)
            place = np.arange(count) + inside.argmin(1)
            first = np.flatnonzero(np.diff(place, prepend=-1))
            parts = grams[place[first]].view(np.int64).tolist()
            for part, a, b in zip(parts, first.tolist(), [*first[1:].tolist(), count], strict=True):
                yield part, lo + a, zone, words, a, b - 1 + RUN
        lo += len(words)


def _parts_of(pages: DataFrame) -> DataFrame:
    """(part, lo, hi, open): of each part the least and greatest page and whether it is in an unmarked block."""

    def run(batches):
        for batch in batches:
            out = [(part, stream, z == UNMARKED) for host, stream, blocks in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for part, _, z, *_ in fragments(host, [(b["zone"], b["text"]) for b in blocks])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["part", "stream", "open"])

    seen = pages.select("host", "stream", "blocks").mapInArrow(run, "part long, stream long, open boolean")
    return seen.groupBy("part").agg(F.min("stream").alias("lo"), F.max("stream").alias("hi"), F.max("open").alias("open"))


_FRAGMENT = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("zone", pa.int32()), ("target", pa.bool_()), ("part", pa.int64()), ("stream", pa.int64()), ("text", pa.string())])


def _fragments_of(pages: DataFrame, shared: DataFrame) -> DataFrame:
    """The fragments of the parts that several pages share."""
    known = None
    if shared.limit(KNOWN + 1).count() <= KNOWN:  # up to 32 MB; past it a join that Spark can split
        known = np.sort(np.array([r["part"] for r in shared.collect()], np.int64))

    def run(batches):
        for batch in batches:
            out = []
            for row, host, stream, blocks in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                zoned = [(b["zone"], b["text"]) for b in blocks]
                wanted, found = _wanted(zoned), list(fragments(host, zoned))
                if known is not None and found:
                    parts = np.array([f[0] for f in found], np.int64)
                    at = np.minimum(np.searchsorted(known, parts), len(known) - 1)
                    found = [f for f, k in zip(found, known[at] == parts, strict=True) if k] if len(known) else []
                out += [(row, at, zone, zone == wanted, part, stream, " ".join(words[a:b])) for part, at, zone, words, a, b in found]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(_FRAGMENT), _FRAGMENT, strict=True)], schema=_FRAGMENT)

    found = pages.select("row", "host", "stream", "blocks").mapInArrow(run, "row long, at int, zone int, target boolean, part long, stream long, text string")
    return found if known is not None else found.join(shared, "part", "left_semi")


def suffix_classes(tokens: np.ndarray, run: int) -> np.ndarray:
    """A number for every suffix, equal where the first ``run`` tokens are, in suffix order: prefix doubling."""
    n, depth = len(tokens), 1
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    while depth < run:
        step = min(depth, run - depth)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + after + 1, return_inverse=True)[1]
        depth += step
    return rank


_FOUND = "part long, text string, inside int, outside int"


def _repeats(table: pa.Table) -> pa.Table:
    """Bits of the runs of each fragment that are boilerplate, inside an article and outside."""
    texts, part = table["text"].to_pylist(), table["part"].to_numpy()
    words = [t.split(" ") for t in texts]
    size = np.array([len(w) for w in words], np.int64)
    ids: dict[str, int] = {}
    flat = np.array([ids.setdefault(w, len(ids)) for some in words for w in [*some, None]], np.int64)
    ends = np.cumsum(size + 1) - 1
    flat[ends] = len(ids) + np.arange(len(ends))  # separators, each of its own
    rank = suffix_classes(flat, RUN)
    owner = np.repeat(np.arange(len(size)), size - RUN + 1)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(size - RUN + 1) - (size - RUN + 1), size - RUN + 1)
    klass = np.unique(np.c_[part[owner], rank[(ends - size)[owner] + place]], axis=0, return_inverse=True)[1].ravel()
    n = int(klass.max()) + 1

    def several(lo: str, hi: str) -> np.ndarray:
        there = ~table[lo].is_null().to_numpy()[owner]
        a, b = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(a, klass[there], table[lo].fill_null(0).to_numpy()[owner][there])
        np.maximum.at(b, klass[there], table[hi].fill_null(0).to_numpy()[owner][there])
        return a < b

    is_open = np.bincount(klass, table["open"].to_numpy()[owner], n) > 0
    bits = [np.zeros(len(size), np.int64) for _ in range(2)]
    for b, hit in zip(bits, (several("lo2", "hi2") & is_open, several("lo", "hi") & is_open), strict=True):
        np.add.at(b, owner, (hit[klass].astype(np.int64)) << place)
    some = pa.array(np.flatnonzero(bits[0] | bits[1]))
    return pa.Table.from_arrays([table["part"].take(some), table["text"].take(some), *(pa.array(b.astype(np.int32)).take(some) for b in bits)], names=["part", "text", "inside", "outside"])


def _by_runs(large: DataFrame) -> DataFrame:
    """The same for parts of many fragments, each run a group of its own."""
    words = F.split("text", " ")
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - RUN), lambda i: F.array_join(F.slice(words, i + 1, RUN), " "))
    each = large.select("*", F.posexplode(runs).alias("k", "words"))
    seen = each.groupBy("part", "words").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.min("lo2").alias("a2"), F.max("hi2").alias("b2"), F.max("open").alias("o")).where("o and a < b")
    bits = lambda hit: F.sum(F.when(hit, F.expr("shiftleft(1, k)")).otherwise(0)).cast("int")
    return each.select("part", "text", "k", "words").join(seen, ["part", "words"]).groupBy("part", "text").agg(bits(F.expr("a2 < b2")).alias("inside"), bits(F.lit(True)).alias("outside"))


def _covered(pages: DataFrame) -> DataFrame:
    """(row, covered): where the runs begin that repeat across pages of a host, for each page that has any."""
    on = pages.where("open").select("host").distinct()
    pages = pages.join(on, "host", "left_semi")
    shared = stored(_parts_of(pages).where("open and lo < hi").select("part"), "parts")
    found = stored(_fragments_of(pages, shared), "fragments")
    lo, hi = F.min("stream"), F.max("stream")
    unmarked = F.when(F.col("zone") != MARKED, F.col("stream"))
    rows = stored(found.groupBy("part", "text").agg(lo.alias("lo"), hi.alias("hi"), F.min(unmarked).alias("lo2"), F.max(unmarked).alias("hi2"), F.max(F.col("zone") == UNMARKED).alias("open")), "distinct")
    large = rows.groupBy("part").count().where(F.col("count") > PART).select("part")
    tasks = max(1, -(-rows.count() // TASK))
    small = rows.join(large, "part", "left_anti").withColumn("task", F.pmod(F.xxhash64("part"), F.lit(tasks)))
    masks = stored(small.groupBy("task").applyInArrow(_repeats, _FOUND).unionByName(_by_runs(rows.join(large, "part", "left_semi"))), "masks")
    if masks.count() <= TASK:
        masks = F.broadcast(masks)  # TASK rows of 24 words at most; else Spark shuffles both sides
    hit = found.where("target").join(masks, ["part", "text"]).select("row", "at", F.when(F.col("zone") == ARTICLE, F.col("inside")).otherwise(F.col("outside")).alias("bits"))
    return hit.where("bits <> 0").groupBy("row").agg(F.collect_list(F.struct("at", "bits")).alias("covered"))  # of one page


@arrow_column("struct<stream:long,open:boolean,blocks:array<struct<zone:int,text:string>>>", repeats=False)
def page_blocks(pages: pa.Array) -> pa.Array:
    """The blocks of a page, and the hash of those that may be kept: pages where it is equal are one."""
    block = pa.struct([("zone", pa.int32()), ("text", pa.string())])
    out = []
    for page in pages.to_pylist():
        blocks = blocks_of(page or "")
        main = "\n".join(t for z, t in blocks if z == _wanted(blocks))
        out.append({"stream": xxhash.xxh64_intdigest(main) - (1 << 63), "open": any(z == UNMARKED for z, _ in blocks), "blocks": [{"zone": z, "text": t} for z, t in blocks]})
    return pa.array(out, pa.struct([("stream", pa.int64()), ("open", pa.bool_()), ("blocks", pa.list_(block))]))


@arrow_column("struct<text:string,n_chars:long>")
def _texts(blocks: pa.Array, covered: pa.Array) -> pa.Array:
    out = []
    for some, hits in zip(blocks.to_pylist(), covered.to_pylist(), strict=True):
        text = "\n".join(_kept([(b["zone"], b["text"]) for b in some], [(h["at"], h["bits"]) for h in hits or []]))
        out.append({"text": text, "n_chars": len(text)})
    return pa.array(out, pa.struct([("text", pa.string()), ("n_chars", pa.int64())]))


def main_text(pages: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """One row for each row of ``pages``: key, url, text, n_chars. Columns are read by name; others aren't read."""
    prepare(pages.sparkSession)
    rows = pages.select(pages[key].alias("key"), pages[url].alias("url"), F.coalesce(url_host(pages[url]), F.lit("")).alias("host"), page_blocks(pages[html]).alias("b"))
    parsed = stored(rows.select(F.monotonically_increasing_id().alias("row"), "key", "url", "host", "b.*"), "pages", compression="zstd")
    if parsed.where("open").limit(1).count():  # without an unmarked block no repeat counts
        parsed = parsed.join(_covered(parsed), "row", "left")
    else:
        parsed = parsed.withColumn("covered", F.lit(None).cast("array<struct<at:int,bits:int>>"))
    return parsed.select(F.col("key").alias(key), "url", _texts("blocks", "covered").alias("t")).select(key, "url", "t.*")
