"""Main text of web pages: markup, and token runs that repeat across a host's pages."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_memory, pick, stored

GROUP = 256  # pages and
GROUP_BYTES = 8 << 20  # bytes of text of a host that share a suffix array, about
RUN = 8  # tokens of a repeated substring at least
LOOSE, SURE = 0.2, 0.6  # shares of a host's pages from which a run is boilerplate, outside and inside an article
LEAST_PAGES = 3
LINKED = 0.6  # share of a block's text in links from which it is a menu
BITMAP_BITS = 24
MOST_BROADCAST = 500_000

# HTML element names and words of class, id and role attributes.
RAW = set("script style textarea title iframe noembed noframes xmp".split())
DROPPED = set("nav footer aside form menu button select dialog head header template noscript svg object canvas audio video annotation annotation-xml".split()) | RAW
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "button select input textarea script style template noscript iframe svg object canvas audio video embed param source track link meta "
    "math mrow mi mo mn ms mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mstyle mspace semantics annotation annotation-xml".split()
)
CLOSES_P = set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HELD_BY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
P_HELD_BY = set("article section div body td th li main aside nav button object".split())
ENDS_DRAWING = set(
    "b big blockquote body center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr img li menu ol p pre ruby s small span strong strike sub sup table tt u ul var "
    "article section main header footer nav aside".split()
)
DRAWINGS, TEXT_IN_DRAWINGS = {"svg", "math"}, {"foreignobject", "desc", "annotation-xml", "mtext"}
MARKED = set("div section ul ol dl table details figure center fieldset header".split())  # elements that class words may put beside the article
COMMENT_WORDS = set("comment comments reply replies respond disqus".split())
SIDE_WORDS = COMMENT_WORDS | set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription "
    "signup login share sharing social related recommended widget toolbar pagination pager copyright disclaimer hidden".split()
)
SAYS_STATE = set("has no not with without is".split())
OF_ARTICLE = set("section entry post article content story".split())
SIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_WORDS = set("article main content post entry story".split())

_START = re.compile(r"<(?:!--(?:-?>)?|[!?]|/?[a-zA-Z][^\s/>]*+|/)")
_ATTRIBUTES = re.compile(r"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++))?+)*+")
_ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|((?![\"'])[^\s>]++)))?+")
_NEEDED = set("class id role hidden aria-hidden style itemprop".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_WORD = re.compile(r"[a-z0-9]+")


def _side_words(value: str) -> set[str]:
    """Words of a class or id that name something beside an article; ``no-comments`` and ``entry-header`` don't."""
    found = set()
    for token in value.split():
        words = _WORD.findall(token)
        if words and words[0] not in SAYS_STATE:
            found |= SIDE_WORDS.intersection(words) - ({"header"} if words[0] in OF_ARTICLE else set())
    return found


def _judge(name: str, attributes: str) -> tuple[bool, bool, set[str]]:
    """Whether an element is beside the article, whether it is the article, and the words of its classes that name something beside one."""
    side, main, words = name in DROPPED, name in ("article", "main"), set()
    for key, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        key = key.lower()
        if key not in _NEEDED:
            continue
        value = "".join(values).lower()
        if key == "role":
            side, main = side or value in SIDE_ROLES, main or value in ("main", "article")
        elif key == "hidden" or key == "aria-hidden" and value == "true":
            side = True
        elif key == "style":
            side = side or _HIDES.search(value) is not None
        elif key == "itemprop":
            main = main or value == "articlebody"
        elif key in ("class", "id"):
            words |= _side_words(value)
            if name in ("div", "section"):
                named = set(_WORD.findall(value))
                main = main or bool(named & MAIN_WORDS and named & {"article", "body", "main", "content", "text"})
    return side, main, words


class _Open:
    """Open elements, the innermost last. Where a name is open is known without a search, so deep nesting stays linear."""

    def __init__(self):
        # name, beside, in the article, beside by class words other than those of comments alone; beside and in the article of the block around
        self.stack: list[tuple[str, bool, bool, bool, bool, bool]] = [("", False, False, False, False, False)]
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, name: str, side: bool, main: bool, weak: bool) -> None:
        self.places[name].append(len(self.stack))
        block = self.stack[-1][4:] if name in INLINE else (side, main)
        self.stack.append((name, side, main, weak, *block))

    def last(self, names: set[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()

    def close(self, names: set[str], held_by: set[str] = frozenset()) -> None:
        place = self.last(names)
        if place > self.last(held_by):
            self.cut(place)


def blocks(html: str) -> list[tuple[str, bool, bool, float]]:
    """Text blocks in page order: ``text, beside the article, in the article, share of it in links``.

    One pass, linear in the page. Attribute values end as HTML has it: a quote inside an unquoted value is a character of it, and a tag
    whose quote is never closed ends at the next ``>``. Elements that aren't closed end where HTML has them end: a paragraph with the next
    block, a list item with the next, a drawing with the next element that can't be in one. Script, comments and tags that never end take the rest.
    """
    out: list[tuple[str, bool, bool, float]] = []
    held = _Open()
    text: list[str] = []
    linked = at = 0
    seen_article = False

    def flush() -> None:
        nonlocal linked
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                side, inside = held.stack[-1][4:]
                out.append((whole, side, inside, min(1.0, linked / len(whole))))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        top = held.stack[-1]
        if top[1] and not top[4]:
            return  # a hidden or dropped element within a line
        piece = unescape(raw) if "&" in raw else raw
        text.append(piece)
        if held.places.get("a"):
            linked += len(piece.strip())

    while True:
        token = _START.search(html, at)
        if token is None:
            if at < len(html):
                add(html[at:])
            break
        if token.start() > at:
            add(html[at : token.start()])
        opening = token[0]
        if opening.startswith("<!--"):
            at = token.end()
            if opening == "<!--":
                end = html.find("-->", at)
                at = end + 3 if end >= 0 else len(html)
            continue
        if opening in ("<!", "<?", "</"):
            end = html.find(">", token.end())
            at = end + 1 if end >= 0 else len(html)
            continue
        attributes, end = "", token.end()
        if not html.startswith(">", end):
            found = _ATTRIBUTES.match(html, end)
            attributes, end = found[0], html.find(">", found.end())
            if end < 0:
                break
        at = end + 1
        closing = opening[1] == "/"
        name = opening[2 if closing else 1 :].lower()
        if name == "br":
            text.append(" ")
        inline = name in INLINE
        if not closing and name in ENDS_DRAWING and (drawing := held.last(DRAWINGS)) > held.last(TEXT_IN_DRAWINGS):
            held.cut(drawing)
        if not inline:
            flush()
        if closing:
            held.close({name})
            continue
        if name in CLOSES_P:
            held.close({"p"}, P_HELD_BY)
        if name in ALIKE:
            held.close(ALIKE[name], HELD_BY[name])
        empty = html[end - 1] == "/"
        if name in RAW and not empty:
            last = _RAW_END[name].search(html, at)
            end = html.find(">", last.end()) if last else -1
            at = end + 1 if end >= 0 else len(html)
            continue
        if name in VOID or empty:
            continue
        _, above_side, above_main, weak, *_ = held.stack[-1]
        side, main, words = _judge(name, attributes)
        if name in ("article", "main"):
            if weak and not above_main and not (seen_article and name == "article"):
                above_side = False  # class words around the article don't drop it
            side = side or name == "article" and above_main and bool(words & COMMENT_WORDS)
            seen_article = True
        elif name in ("h1", "h2") and held.stack[-1][0] == "header" and above_main and not held.stack[-2][1]:
            above_side = False  # the article's own heading
        elif name in MARKED and words:
            side, weak = True, weak if above_side else not side and not words & COMMENT_WORDS
        held.push(name, above_side or side, above_main or main, weak and (above_side or side))
    flush()
    return out


def _chosen(html: str) -> list[tuple[str, bool, float]]:
    """``text, in the article, share in links`` of blocks not beside the article; of those in it alone, if there are any."""
    rest = [(text, inside, links) for text, side, inside, links in blocks(html) if not side]
    return [b for b in rest if b[1]] or rest


def sorted_runs(tokens: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a token stream, sorted by ``length`` tokens at least, and where a new run of that length begins."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    known = 1
    while known < length:
        later = np.zeros(n, np.int64)
        step = min(known, length - known)
        later[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + later, return_inverse=True)[1].astype(np.int64) + 1
        known += step
    order = np.argsort(rank, kind="stable")
    new = np.ones(n, bool)
    new[1:] = rank[order][1:] != rank[order][:-1]
    return order, new


def token_hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens))


def run_hashes(tokens: np.ndarray, length: int = RUN) -> np.ndarray:
    """A number for the run of ``length`` tokens that begins at each place where one fits."""
    n = max(0, len(tokens) - length + 1)
    out = np.zeros(n, np.uint64)
    for i in range(length if n else 0):
        out = (out ^ tokens[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def frequent_runs(streams: list[np.ndarray], share: float = LOOSE, length: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """``run hash, streams that have it`` of runs that a share of the given streams has, from one suffix array over all.

    Streams are concatenated with a separator of their own each, so no run crosses them.
    """
    number = np.unique(np.concatenate(streams), return_inverse=True)[1]
    lengths = np.array([len(s) for s in streams])
    starts = np.cumsum([0, *(lengths + 1)])
    whole = np.empty(starts[-1], np.int64)
    ends = starts[1:] - 1
    whole[ends] = len(number) + np.arange(len(streams))
    inside = np.ones(len(whole), bool)
    inside[ends] = False
    whole[inside] = number
    of = np.repeat(np.arange(len(streams)), lengths + 1)
    order, new = sorted_runs(whole, length)
    run = np.cumsum(new) - 1
    pairs = np.unique(run * len(streams) + of[order])
    spread = np.bincount(pairs // len(streams), minlength=run[-1] + 1)
    first = order[np.flatnonzero(new)]
    wanted = np.flatnonzero((spread >= share * len(streams) - 1e-9) & (first + length <= ends[of[first]]))
    hashes = [run_hashes(streams[of[f]][f - starts[of[f]] : f - starts[of[f]] + length], length)[0] for f in first[wanted]]
    return np.array(hashes, np.uint64), spread[wanted]


def covered(stream: np.ndarray, runs: np.ndarray, shares: np.ndarray, length: int = RUN) -> np.ndarray:
    """For each token, the largest share of the known runs over it. ``runs`` are sorted."""
    out = np.zeros(len(stream))
    if len(runs) and len(stream) >= length:
        mine = run_hashes(stream, length)
        at = np.minimum(np.searchsorted(runs, mine), len(runs) - 1)
        value = np.where(runs[at] == mine, shares[at], 0)
        for i in range(length):
            out[i : i + len(value)] = np.maximum(out[i : i + len(value)], value)
    return out


def _cleaned(texts: list[str], inside: list[bool], links: list[float], runs: np.ndarray, shares: np.ndarray) -> str:
    """Blocks joined, without what runs of a host cover.

    If a page marks its article, a block goes only if runs that most pages have cover it: a passage or a copy that some articles
    share is part of them. Without such a mark, tokens of runs that a fifth of the pages have go, and so do blocks of links.
    """
    words = [t.split(" ") for t in texts]
    cover = covered(token_hashes([w for block in words for w in block]), runs, shares) if len(runs) else None
    kept, at = [], 0
    for text, block, within, linked in zip(texts, words, inside, links, strict=True):
        part = cover[at : at + len(block)] if cover is not None else np.zeros(len(block))
        at += len(block)
        if within:
            if not (part >= SURE).all():
                kept.append(text)
        elif linked < LINKED:
            if rest := " ".join(t for t, s in zip(block, part, strict=True) if s < LOOSE):
                kept.append(rest)
    return "\n".join(kept)


_PARSED = "texts binary, inside array<boolean>, links array<double>, size long, digest binary"


def _packed(texts: list[str]) -> bytes:
    """Blocks of a page, which hold no line end, as one compressed value: pages are stored and shuffled in this form."""
    return zstandard.compress("\n".join(texts).encode("utf-8", "surrogatepass"))


def _unpacked(value: bytes) -> list[str]:
    text = zstandard.decompress(value).decode("utf-8", "surrogatepass")
    return text.split("\n") if text else []


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["id", "url", "host", "texts", "inside", "links", "size", "digest"]
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            pages = [_chosen(h or "") for h in part.column("html").to_pylist()]
            texts, inside, links = ([[b[i] for b in p] for p in pages] for i in range(3))
            sizes = pa.array([sum(map(len, t)) for t in texts], pa.int64())
            packed = pa.array([_packed(t) for t in texts], pa.binary())
            digests = pa.array([xxhash.xxh3_128_digest("\n".join(t)) for t in texts], pa.binary())
            columns = [packed, pa.array(inside, pa.list_(pa.bool_())), pa.array(links, pa.list_(pa.float64())), sizes, digests]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names[:3]), *columns], names=names)


def _streams(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [token_hashes([w for t in texts for w in t.split(" ")]) for texts in map(_unpacked, column.to_pylist())]


def _frequent(rows: pa.Table) -> pa.Table:
    """Runs that a share of the pages of one group has."""
    host = rows.column("host")[0].as_py()
    found, _ = frequent_runs(_streams(rows.column("texts")))
    free_memory()
    return pa.table([pa.array([host] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(_slots(host, found), pa.int32())], names=["host", "run", "slot"])


def _slots(host: str, runs: np.ndarray) -> np.ndarray:
    return ((runs ^ np.uint64(xxhash.xxh3_64_intdigest(host))) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def _listed(bitmap: np.ndarray):
    """Runs of each page that the bitmap has, once a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                hosts, runs = [], []
                for host, stream in zip(part.column("host").to_pylist(), _streams(part.column("texts")), strict=True):
                    mine = np.unique(run_hashes(stream))
                    slots = _slots(host, mine)
                    mine = mine[(bitmap[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1]
                    hosts.append(pa.repeat(pa.scalar(host, pa.string()), len(mine)))
                    runs.append(mine)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(hosts), pa.array(np.concatenate(runs).view(np.int64))], names=["host", "run"])

    return run


def _write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["texts", "inside", "links", "runs"]
    none = np.zeros(0, np.uint64)
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            out = []
            for texts, inside, links, runs in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                known = np.array([r["run"] for r in runs or []], np.int64).view(np.uint64)
                order = np.argsort(known)
                shares = np.array([r["share"] for r in runs or []])[order] if len(known) else none
                out.append(_cleaned(_unpacked(texts), inside, links, known[order], shares))
            columns = [part.column("id"), part.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "url", "text", "n_chars"])


def _bitmap(candidates: DataFrame) -> np.ndarray:
    """Which slots candidates have, as bits: 2 MB at most, whatever their number."""
    bits = candidates.groupBy(F.shiftright("slot", 3).alias("at")).agg(F.bit_or(F.expr("shiftleft(1, slot & 7)")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 3), np.uint8)
    out[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()
    return out


def _small(table: DataFrame) -> DataFrame:
    """The table, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def _boilerplate(parsed: DataFrame) -> DataFrame:
    """``host, runs``: runs that at least ``LOOSE`` of a host's different pages have, with their share of all of them.

    A run that a share of a host has is had by that share of one of its groups at least, so the suffix arrays of groups name all that can count.
    Their exact numbers of pages are then counted over all pages of the host; a bitmap keeps other runs out of that shuffle. Pages with equal text
    count once, and meet in no group. A host has at most ``1 / LOOSE`` times as many of these runs as a mean page has tokens.
    """
    paged = parsed.where((F.col("host") != "") & (F.col("size") > 0))
    kinds = stored(paged.groupBy("host", "digest").agg(F.count("*").alias("copies"), F.min("row").alias("first"), F.max("size").alias("size")), "page-kinds")
    parts = F.greatest(F.ceil(F.count("*") / GROUP), F.ceil(F.sum("size") / GROUP_BYTES)).alias("parts")
    hosts = stored(kinds.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("pages"), parts).where(F.col("pages") >= LEAST_PAGES), "page-hosts")
    copied = stored(kinds.where("copies > 1").select(F.col("digest").alias("copy"), F.col("host").alias("copy_host"), "first"), "page-copies")
    hosts, copied = _small(hosts), _small(copied)
    different = paged.join(copied, (F.col("digest") == F.col("copy")) & (F.col("host") == F.col("copy_host")), "left").where("first IS NULL OR row = first")
    different = different.join(hosts, F.col("host") == F.col("of")).select("host", "texts", "row", "parts")
    groups = different.groupBy("host", F.pmod(F.xxhash64("row"), "parts").alias("part"))
    candidates = stored(groups.applyInArrow(_frequent, "host string, run long, slot int").distinct(), "page-runs")
    listed = different.select("host", "texts").mapInArrow(_listed(_bitmap(candidates)), "host string, run long")
    counted = listed.groupBy("host", "run").agg(F.count("*").alias("n")).join(hosts, F.col("host") == F.col("of"))
    counted = counted.where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= F.col("pages") * LOOSE - 1e-9))
    share = (F.col("n") / F.col("pages")).alias("share")
    return stored(counted.groupBy(F.col("host").alias("of")).agg(F.collect_list(F.struct("run", share)).alias("runs")), "page-boilerplate")


def extract_pages(rows: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The main text of each page: ``key, url, text, n_chars``.

    Markup is read first, each page alone: blocks beside the article go, and if a page marks its article, only blocks in it count. Then
    runs of ``RUN`` tokens that a host's different pages repeat are boilerplate (see ``_cleaned``). Shares are of all pages of the host, whatever
    the number of groups its suffix arrays are built in, so a host with most of the pages is spread over tasks and judged like any other. Pages
    without a host, and hosts of fewer than ``LEAST_PAGES`` different pages, are judged by markup alone. A null or empty page gives an empty text.
    Repeated rows are pages like others, but count once for what repeats. Null keys and further columns change nothing. An empty table gives an
    empty result.
    """
    base = pick(rows, id=key, url=url, html=html)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    kind = base.schema["id"].dataType.simpleString()
    parsed = base.withColumn("host", host).mapInArrow(_parse, f"id {kind}, url string, host string, {_PARSED}")
    parsed = stored(parsed.withColumn("row", F.monotonically_increasing_id()), "pages")
    boilerplate = _boilerplate(parsed)
    few = boilerplate.agg(F.sum(F.size("runs"))).first()[0] or 0
    joined = parsed.join(F.broadcast(boilerplate) if few <= MOST_BROADCAST else boilerplate, F.col("host") == F.col("of"), "left")
    out = joined.select("id", "url", "texts", "inside", "links", "runs").mapInArrow(_write_out, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", key).withColumnRenamed("url", url)
