"""Main text of web pages by nearest-URL page differencing.

A page is read into lines, one for each block of text, without markup, scripts and styles.
Pages of a host are laid out by URL path; every page is compared with its nearest
neighbour there, the one that shares the longer start of the path (the one before, if both
do). All lines of the two are aligned by their longest common subsequence, and shared
lines, which belong to the site and not to the page, are deleted.

Markup has a say beside. Lines inside ``<article>``, ``<main>`` or the like are the page's
own by its author's word and stay even if they are shared; lines inside elements that are
or name themselves boilerplate (menus, footers, sidebars, notices, adverts, forms, comments)
go even if they are not. All others are decided by the comparison alone.

Copies of a page share everything and tell nothing. Neighbours with the very same lines are
passed over: pages with equal lines side by side are one run, compared with the pages before
and after it. Where nothing of a page would be left, the page is a copy with another frame,
and its other neighbour is asked; if that leaves nothing either, no line goes by comparison.

Pages are dealt by (host, path, page_id) to ranges of nearly equal counts, so that a host
with a third of all pages is spread. A range is sorted and walked page by page: a task holds
a page, its neighbours and the ids of a run. The first and last run of each range are set
aside, and joined with those of the ranges beside. Where a run fills a whole range, it has
no neighbour on that side. Null html counts as empty and gives empty text, a null URL as host ""
and path "". Equal URLs lie side by side in the order of page_id as text of 20 places; repeated rows
each have their own result. An empty table gives an empty result; page_id may have any type,
other columns are not read, and pages of any length are aligned alike.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import PIECE, bounded, materialize, slots, spans

#: Elements that end the block of text before them.
# The block elements of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never content.
# Elements of HTML.
DROPPED = frozenset("aside button canvas datalist dialog fieldset footer form frameset head iframe input label menu nav noframes noscript option script select style template textarea title".split())
#: Elements without an end tag.
# The void elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no markup.
RAW = frozenset("script style textarea title noscript iframe xmp noframes".split())
#: Elements that a start tag of the same kind ends if they are open.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of class, id and role that mark boilerplate: the first anywhere and as parts of names, the others outside of the main content and as whole names inside.
# Names in common use on the web.
STRONG_NAMES = frozenset("ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments commentlist contentinfo cookie cookies disqus footer gdpr menu menubar nav navbar navigation newsletter outbrain pager pagination popup promo promoted related sidebar signup sponsor sponsored sponsors subscribe subscription taboola toolbar".split())
WEAK_NAMES = frozenset("banner banners complementary consent dialog disclaimer hidden legal login masthead modal notice notices overlay privacy promotion recommended replies respond search share sharing skip social topbar widget".split())
MAIN_NAMES = frozenset("article-body article-content entry-content main main-content maincontent post-body post-content story-body articlebody".split())
#: First parts of names that speak of the layout around: "has-sidebar" is no sidebar.
ABOUT = frozenset("has with without no is".split())

#: What markup says of a line.
OPEN, MAIN, FRAME = 0, 1, 2

#: Cells of one alignment table, at most (one bit each); of longer pages the table is split in halves.
CELLS = 1 << 28
#: Ranges of pages, at most; beyond 16 MB each they grow, and are walked all the same.
RANGES = 1 << 14

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|([^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)", re.S)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def _named_frame(word: str, tag: str, inside: bool) -> bool:
    """Whether a name marks an element as boilerplate."""
    parts = _NAME.findall(_CAMEL.sub("-", word).lower())
    whole = word.lower()
    if tag in ("body", "html") or not parts or parts[0] in ABOUT:
        return False
    if tag in ("article", "main"):
        return whole in STRONG_NAMES
    if not STRONG_NAMES.isdisjoint(parts):
        return True
    return whole in WEAK_NAMES if inside else not WEAK_NAMES.isdisjoint(parts)


def _judge(tag: str, raw: str, inside: bool) -> int:
    """FRAME: the element is boilerplate; MAIN: it is the page's main content; OPEN: neither is said."""
    if tag in DROPPED:
        return FRAME
    kind = MAIN if tag in ("article", "main") else OPEN
    if "=" in raw or "hidden" in raw.lower():
        for name, a, b, c, bare in _ATTRIBUTE.findall(raw):
            name, value = (name or bare).lower(), entities.unescape(a or b or c)
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                return FRAME
            if name in ("class", "id", "role", "itemprop"):
                for word in value.split():
                    if word.lower() in MAIN_NAMES:
                        kind = MAIN
                    elif (kind != MAIN or tag in ("article", "main")) and _named_frame(word, tag, inside):
                        return FRAME
    return kind


def page_lines(page: str) -> tuple[list[str], list[int]]:
    """The lines of a page, and what markup says of each."""
    lines, marks = [], []
    #: The line that is being read, and the boilerplate on its way.
    text, frame = [], []
    stack: list[tuple[str, bool, bool]] = []
    off = main = False

    def end(parts: list[str], mark: int) -> None:
        line = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if line:
            lines.append(line)
            marks.append(mark)

    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        closing, tag, raw, plain = token.groups()
        if plain is not None:
            (frame if off else text).append(plain)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            end(frame, FRAME)
            if not off:
                end(text, MAIN if main else OPEN)
        elif tag == "br":
            (frame if off else text).append(" ")
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    off, main = stack[i][1:]
                    del stack[i:]
                    break
            continue
        if tag in CLOSES and stack and stack[-1][0] in CLOSES[tag]:
            off, main = stack[-1][1:]
            stack.pop()
        if tag in VOID or raw.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        kind = _judge(tag, raw, main)
        if tag == "header" and not main:
            kind = FRAME
        stack.append((tag, off, main))
        off = off or kind == FRAME
        main = (main or kind == MAIN) and not off
    end(frame, FRAME)
    end(text, MAIN if main else OPEN)
    return lines, marks


def _raised(x: list[int], y: np.ndarray, table: list | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` with all starts of ``y``; ``table`` gets, for each row, which cells raised them, packed as bits."""
    last = np.zeros(len(y) + 1, np.int32)
    for v in x:
        now = np.maximum.accumulate(np.maximum(np.append(0, np.where(y == v, last[:-1] + 1, 0)), last))
        if table is not None:
            table.append(np.packbits(now > last))
        last = now
    return last


def _aligned(x: list[int], y: np.ndarray) -> list[int]:
    """Places in ``x`` of a longest common subsequence with ``y``; memory is bounded by CELLS and the length of both."""
    if not x or not len(y):
        return []
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        cut = int(np.argmax(_raised(x[:half], y) + _raised(x[half:][::-1], y[::-1])[::-1]))
        return _aligned(x[:half], y[:cut]) + [half + i for i in _aligned(x[half:], y[cut:])]
    table: list[np.ndarray] = []
    _raised(x, y, table)
    out, j = [], len(y)
    for i in range(len(x) - 1, -1, -1):
        if np.unpackbits(table[i], count=len(y) + 1)[j]:
            # A raised cell takes this row's entry, at best with its last equal before the cell.
            j = int(np.flatnonzero(y[:j] == x[i])[-1])
            out.append(i)
    return out[::-1]


def shared_lines(own: list[int], other: list[int]) -> list[bool]:
    """Which entries of ``own`` are on a longest common subsequence with ``other``."""
    out = [False] * len(own)
    a = 0
    while a < min(len(own), len(other)) and own[a] == other[a]:
        out[a] = True
        a += 1
    b = 0
    while b < min(len(own), len(other)) - a and own[-1 - b] == other[-1 - b]:
        out[-1 - b] = True
        b += 1
    common = set(own[a : len(own) - b]) & set(other[a : len(other) - b])
    x = [i for i in range(a, len(own) - b) if own[i] in common]
    for i in _aligned([own[i] for i in x], np.array([v for v in other[a : len(other) - b] if v in common], np.int64)):
        out[x[i]] = True
    return out


def deleted(own: list[int], marks, others: list[list[int]]) -> list[bool]:
    """The lines to delete from a page, given what markup says of them and the lines of its neighbours, the nearest first."""
    frame = [m == FRAME for m in marks]
    for other in others:
        shared = shared_lines(own, other)
        if any(not s and not f for s, f in zip(shared, frame)):
            return [f or (s and m == OPEN) for f, s, m in zip(frame, shared, marks)]
    return frame


def sort_key(url: str | None, page_id) -> bytes:
    """Pages rise by host, path and page_id as text."""
    host, path = url_parts(url or "")
    return f"{host}\0{path}\0{str('' if page_id is None else page_id).zfill(20)}".encode("utf-8", "surrogatepass")


def _parse(ends: list[bytes]):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in spans(batches, "html"):
            columns = [[] for _ in range(5)]
            for page_id, url, page in zip(part.column("page_id").to_pylist(), part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                lines, marks = page_lines(page or "")
                key = sort_key(url, page_id)
                columns[0].append(bisect_left(ends, key))
                columns[1].append(key)
                # Of boilerplate only the hash is needed.
                columns[2].append(pack("\n".join(x for x, m in zip(lines, marks) if m != FRAME).encode("utf-8", "surrogatepass")))
                columns[3].append(bytes(marks))
                columns[4].append(np.array([stable(x) for x in lines], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(columns[0], pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=["page_id", "url", "range", "sort", "lines", "marks", "hashes"])

    return run


def stable(line: str) -> int:
    """A hash of a line that is the same in every process."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


def url_parts(url: str) -> tuple[str, str]:
    """Host without its port, in lower case, and path without query and fragment."""
    found = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)", url)
    if not found:
        return "", re.match(r"[^?#]*", url)[0]
    return found[1].rpartition("@")[2].partition(":")[0].lower(), found[2]


class Run:
    """Pages side by side on one host that have the very same lines."""

    def __init__(self, range_: int, host: bytes, hashes: bytes, marks: bytes, lines: bytes):
        self.range, self.host, self.hashes, self.marks, self.lines = range_, host, hashes, marks, lines
        #: page_id, url and path of each.
        self.pages: list[tuple] = []

    def side(self, at: int) -> tuple:
        """What a neighbour needs to know: path, hashes and page_id of the first or the last page."""
        return self.pages[at][2], self.hashes, self.pages[at][0]

    def texts(self, before: tuple | None, after: tuple | None):
        """Each page's id, URL, text and neighbour, given the pages before and after the run on its host."""
        own, known = np.frombuffer(self.hashes, np.int64).tolist(), {}
        for page_id, url, path in self.pages:
            beside = sorted((x for x in (before, after) if x is not None and x[1] != self.hashes), key=lambda x: -_common(path, x[0]))
            order = tuple(x[2] for x in beside)
            if order not in known:
                gone = deleted(own, self.marks, [np.frombuffer(x[1], np.int64).tolist() for x in beside])
                held = [not g for g, m in zip(gone, self.marks) if m != FRAME]
                lines = zstandard.ZstdDecompressor().decompress(self.lines).decode("utf-8", "surrogatepass").split("\n") if held else []
                known[order] = "\n\n".join(x for x, h in zip(lines, held, strict=True) if h)
            yield page_id, url, known[order], order[0] if order else None


def _common(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def _runs(batches):
    """All runs of rows in order, each with the run before and after it in its range (None where there is none)."""
    before = run = None
    for part in spans(batches, "lines"):
        for page_id, url, range_, sort, lines, marks, hashes in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "range", "sort", "lines", "marks", "hashes")), strict=True):
            host, path, _ = sort.split(b"\0", 2)
            if run is None or (run.range, run.host, run.hashes, run.marks) != (range_, host, hashes, marks):
                new = Run(range_, host, hashes, marks, lines)
                if run is not None:
                    same = run.range == range_
                    new.pages.append((page_id, url, path))
                    yield before, run, new if same else None
                    before, run = (run if same else None), new
                    continue
                run = new
            run.pages.append((page_id, url, path))
    if run is not None:
        yield before, run, None


def _on_host(run: Run, other: Run | None, at: int) -> tuple | None:
    return other.side(at) if other is not None and other.host == run.host else None


def _results(rows: list[tuple], kind: pa.DataType) -> list[pa.Array]:
    ids, urls, texts, beside = zip(*rows) if rows else ((), (), (), ())
    return [pa.array(ids, kind), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(beside, kind)]


_RESULT = "page_id {0}, url string, text string, neighbour {0}"
_SIDE = "struct<path:binary,hashes:binary,page_id:{0}>"
_OUTER = "range:int, first:boolean, last:boolean, host:binary, hashes:binary, marks:binary, lines:binary, pages:array<struct<page_id:{0},url:string,path:binary>>, low:" + _SIDE + ", high:" + _SIDE + ", inner_before:" + _SIDE + ", inner_after:" + _SIDE
_WALKED = _RESULT + ", outer boolean, run struct<" + _OUTER + ">"


def _walk(kind: pa.DataType):
    """Results of all pages but those of the first and the last run of each range, a few MB at a time, and these runs with what they know of their neighbours inside."""
    side = pa.struct([("path", pa.binary()), ("hashes", pa.binary()), ("page_id", kind)])
    page = pa.struct([("page_id", kind), ("url", pa.string()), ("path", pa.binary())])
    names = ["range", "first", "last", "host", "hashes", "marks", "lines", "pages", "low", "high", "inner_before", "inner_after"]
    outer = pa.struct(list(zip(names, [pa.int32(), pa.bool_(), pa.bool_(), *[pa.binary()] * 4, pa.list_(page), *[side] * 4], strict=True)))
    as_side = lambda x: None if x is None else dict(zip(("path", "hashes", "page_id"), x))

    def batch(rows: list[tuple], run: dict | None = None) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([*_results(rows, kind), pa.array([run is not None] * n, pa.bool_()), pa.array([run] * n, outer)], names=["page_id", "url", "text", "neighbour", "outer", "run"])

    def run(batches):
        rows, held = [], 0
        for before, own, after in _runs(batches):
            beside = _on_host(own, before, -1), _on_host(own, after, 0)
            if before is None or after is None:
                pages = [dict(zip(("page_id", "url", "path"), p)) for p in own.pages]
                known = [own.range, before is None, after is None, own.host, own.hashes, own.marks, own.lines, pages, as_side(own.side(0)), as_side(own.side(-1)), *map(as_side, beside)]
                yield batch([(None,) * 4], dict(zip(names, known, strict=True)))
                continue
            for row in own.texts(*beside):
                rows.append(row)
                held += len(row[2])
                if held > PIECE:
                    yield batch(rows)
                    rows, held = [], 0
        yield batch(rows)

    return run


def _settle(kind: pa.DataType):
    """Results of the outer runs, joined with their neighbours in the ranges beside."""

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own = Run(0, r["host"], r["hashes"], r["marks"], r["lines"])
                own.pages = [(p["page_id"], p["url"], p["path"]) for p in r["pages"]]
                before, after = ((x["path"], x["hashes"], x["page_id"]) if x is not None else None for x in (r["before"], r["after"]))
                rows += own.texts(before, after)
            yield pa.RecordBatch.from_arrays(_results(rows, kind), names=["page_id", "url", "text", "neighbour"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """Each page's page_id, url, text (blocks joined by two line feeds) and neighbour (the page it was compared with first)."""
    spark = pages.sparkSession
    bounded(spark)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    arrow = to_arrow_type(rows.schema["page_id"].dataType)
    count, total = rows.agg(F.count("*"), F.sum(F.octet_length("html"))).first()
    ranges = max(1, min(RANGES, max(3 * slots(spark), -(-(total or 0) // (16 << 20)))))
    # Ends of the ranges: from the sort keys of a sample of 30 a range, whatever the number of pages; at most 90 * RANGES keys are taken.
    sample = rows.sample(min(1.0, 30 * ranges / max(1, count)), seed=7).select("url", F.col("page_id").cast("string")).limit(90 * ranges).collect()
    keys = sorted(sort_key(u, i) for u, i in sample)
    ends = sorted({keys[i * len(keys) // ranges] for i in range(1, ranges)}) if keys else []

    parsed = rows.mapInArrow(_parse(ends), T.StructType([rows.schema[0], *T._parse_datatype_string("url string, range int, sort binary, lines binary, marks binary, hashes binary").fields]))
    # Parsed, shuffled and walked once; what the walk finds is written before the ends of ranges are joined.
    dealt = parsed.repartition(max(ranges, slots(spark)), "range").sortWithinPartitions("range", "sort")
    walked = materialize(dealt.mapInArrow(_walk(arrow), _WALKED.format(kind)), "pages-walked", "zstd")
    inner = walked.where("not outer").select("page_id", "url", "text", "neighbour")
    outer = walked.where("outer").select("run.*")
    # Which ranges that have pages lie beside each other: one row of three numbers a range.
    by = Window.orderBy("range")
    beside = outer.select("range").distinct().select("range", F.lag("range").over(by).alias("left"), F.lead("range").over(by).alias("right"))
    last = outer.where("last").select(F.col("range").alias("left"), F.col("host").alias("left_host"), F.col("high").alias("outer_before"), F.col("inner_before").alias("left_beyond"))
    first = outer.where("first").select(F.col("range").alias("right"), F.col("host").alias("right_host"), F.col("low").alias("outer_after"), F.col("inner_after").alias("right_beyond"))
    joined = outer.join(beside, "range").join(last, "left", "left").join(first, "right", "left")
    # A run that goes on beside is compared with the page beyond.
    beyond = lambda side, past: F.when(F.col(f"{side}.hashes") == F.col("hashes"), F.col(past)).otherwise(F.col(side))
    before = F.when(F.col("first"), F.when(F.col("left_host") == F.col("host"), beyond("outer_before", "left_beyond"))).otherwise(F.col("inner_before"))
    after = F.when(F.col("last"), F.when(F.col("right_host") == F.col("host"), beyond("outer_after", "right_beyond"))).otherwise(F.col("inner_after"))
    settled = joined.select("host", "hashes", "marks", "lines", "pages", before.alias("before"), after.alias("after")).mapInArrow(_settle(arrow), _RESULT.format(kind))
    return inner.union(settled)
