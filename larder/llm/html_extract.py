"""Main text of web pages: markup, and a suffix array of each host's repeats.

1. :func:`blocks_of` reads a page's whole markup (unclosed tags, bare angle
   brackets and cut-off ends too) into blocks of text, each marked as content (in
   an ``article`` or ``main``), other, or furniture (menus, headers, footers,
   asides, forms, adverts, notices, reader comments, by element, role or class).
   A form, or an element named like furniture, that holds most of the page is its
   container (:func:`decided`).
2. The token streams of all of a host's pages, furniture included, are compared at
   every place: each run of ``REACH`` tokens that stands on distinct pages covers
   its places.  A first pass finds the least grams (:mod:`larder.llm.suffixes`) that
   several pages have; a second sorts the suffixes with such a gram over the
   cluster, by host and content.  Whole blocks of fewer tokens are counted by their
   hash, where the host has a page that declares no content.
3. Furniture goes.  On a page that declares no content the blocks go that repeats
   cover by half, unless nearly all of the page is covered by text of few pages: it
   is then a copy.  In declared content a covered block goes only where its
   repeats look like boilerplate (:func:`dropped`): whole articles and quoted
   passages repeat across a host's pages and stay.

Only hashes, block sizes and the numbers of dropped blocks are shuffled, no page text.

Defined results: null or empty html gives an empty text; references are decoded
as in HTML (``&amp`` without its semicolon too); white space is Unicode's, the
no-break space included; equal rows give equal rows and count as one page; pages
without a host form one host; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm import words
from larder.llm.common import arrow_batches, small, staged, text_of
from larder.llm.suffixes import bitmap, every, hits, run_hashes, spread

#: Tokens of a gram, and of the shortest substring that counts as long.
GRAM, REACH = 6, 20
#: Blocks of fewer tokens are counted whole: a longer one holds runs of REACH tokens.
SHORT = REACH
#: A short block of one or two words is a repeat only on so many pages; text on fewer pages may be a copy's.
FEW_PAGES = 3
#: The covered share of an open page that may be a copy.
COPY = 0.8
#: Tokens of a block at the edge of declared content that may be boilerplate.
EDGE = 40

CONTENT, OTHER, FURNITURE = 0, 1, 2

# HTML elements by their role.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas audio video head title select textarea button datalist".split())
FURNITURE_TAGS = frozenset("nav header footer aside form dialog menu".split())
CONTENT_TAGS = frozenset(("article", "main"))
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
FURNITURE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead footer sidebar aside widget related recommended share sharing social "
    "comment comments disqus replies respond newsletter subscribe subscription signup login search skip".split()
)

# Names that also stand in compound names of article parts ("share-price", "related-work").
LOOSE_NAMES = frozenset("share sharing related recommended header masthead search notice promotion skip subscription respond overlay popup modal aside widget".split())
TITLE_NAMES = frozenset(("header", "masthead"))
# Names of reader comments, which are never an article's container.
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
# First or last parts of names that tell of a layout, not of what an element holds.
LAYOUT_PARTS = frozenset("no has with without is hide show enabled disabled open closed on off".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure table".split())

# Raw text runs to its own end tag; an unfinished tag at a page's end is markup.
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>?|<[a-zA-Z/][^<>]*\Z", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PARTS = re.compile(r"[a-z]+")

# What an element is: the page; declared content; furniture for certain; furniture by its whole or by a part of its name; a form.
ROOT, DECLARED, CERTAIN, COMMENTS, NAMED, PARTLY, LOOSELY, FORM = range(8)


def kind_of(tag: str, attributes: str) -> int | None:
    """What an element seems to be by its tag and attributes alone; None for one that says nothing."""
    if tag in FURNITURE_TAGS and tag != "form":
        return CERTAIN
    found = DECLARED if tag in CONTENT_TAGS else FORM if tag == "form" else None
    if not attributes or attributes.isspace() or tag in ("html", "body"):
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" and value not in ("until-found", "false") or name == "aria-hidden" and value == "true" or name == "style" and _NO_DISPLAY.search(value):
            return CERTAIN
        if tag in CONTENT_TAGS:
            continue
        if name == "role" and value in FURNITURE_ROLES:
            found = FORM if value == "form" else CERTAIN
        elif name in ("class", "id"):
            for token in value.split():
                parts = _PARTS.findall(token)
                known = FURNITURE_NAMES.intersection(parts)
                if not known or not LAYOUT_PARTS.isdisjoint((parts[0], parts[-1])):
                    continue
                whole = token in FURNITURE_NAMES and token not in TITLE_NAMES
                made = COMMENTS if known & COMMENT_NAMES else NAMED if whole else PARTLY if known - LOOSE_NAMES else LOOSELY
                if found is None or found == FORM or COMMENTS <= made < found:
                    found = made
    return found


@dataclass(slots=True)
class Marked:
    """An element that says what it is, and what stands in it, elements below it included."""

    above: int
    kind: int
    tag: str
    size: int = 0
    linked: int = 0
    flowing: int = 0
    titled: bool = False
    declares: bool = False


def decided(marked: list[Marked]) -> list[int]:
    """The kind of text right below each marked element.

    An element that only seems to be furniture by its name, and a form, are
    containers of the page where most of the page's text is in them: text of an
    ``article`` or ``main``, or, where the page declares no content, paragraphs
    that aren't links (in a form below an ``h1``).  In declared content a header
    holds the title, and a part of a name says less than a whole one.
    """
    certain = [m.kind == CERTAIN for m in marked]
    for i, m in enumerate(marked):  # elements stand behind those they are in
        certain[i] = certain[i] or m.above >= 0 and certain[m.above]
    for i in range(len(marked) - 1, 0, -1):
        m, up = marked[i], marked[marked[i].above]
        if m.above >= 0 and not certain[i]:
            up.size, up.linked, up.flowing = up.size + m.size, up.linked + m.linked, up.flowing + m.flowing
            up.titled, up.declares = up.titled or m.titled, up.declares or m.declares or m.kind == DECLARED
    total = marked[0].size
    kinds = [OTHER] * len(marked)
    for i, m in enumerate(marked[1:], 1):
        over = kinds[m.above]
        flows = (m.kind in (PARTLY, LOOSELY) or m.kind == FORM and m.titled) and 2 * m.flowing > m.size and 2 * m.linked < m.size
        most = 2 * m.size > total and m.kind > CERTAIN
        if over == FURNITURE:
            kinds[i] = FURNITURE
        elif m.kind == DECLARED:
            kinds[i] = CONTENT
        elif m.kind == CERTAIN:
            kinds[i] = CONTENT if over == CONTENT and m.tag == "header" else FURNITURE
        elif over == CONTENT:
            links = 2 * m.linked > m.size
            title = m.titled or m.tag in TEXT_TAGS
            kinds[i] = CONTENT if not links and (m.kind == LOOSELY or m.kind == PARTLY and title) else FURNITURE
        elif most and m.kind != COMMENTS and (m.declares or not marked[0].declares and flows):
            kinds[i] = OTHER
        else:
            kinds[i] = FURNITURE
    return kinds


def blocks_of(page: str) -> list[tuple[int, str, int]]:
    """(kind, text, characters in links) of each block with text, in page order."""
    out: list[tuple[int, str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, int]] = []
    marked = [Marked(-1, ROOT, "")]
    inner, skipped, at, link, linked, flow = 0, 0, 0, False, 0, ""

    def flush() -> None:
        nonlocal linked
        if held:
            if text := " ".join("".join(held).split()):
                out.append((inner, text, linked))
                m = marked[inner]
                m.size, m.linked, m.titled = m.size + len(text), m.linked + linked, m.titled or flow == "h1"
                m.flowing += len(text) if flow in TEXT_TAGS else 0
            held.clear()
        linked = 0

    for m in _MARKUP.finditer(page):
        if m.start() > at and not skipped:
            piece = page[at : m.start()]
            held.append(html.unescape(piece) if "&" in piece else piece)
            linked += link * len(piece.strip())
        at = m.end()
        if not (name := m[3]):
            continue
        tag = name.lower()
        if tag == "br":
            held.append(" ")
            continue
        if tag == "a":
            link = not m[2]
        if tag not in INLINE:
            flush()
            flow = "" if m[2] else tag
        if m[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if tag in INLINE:
                        flush()
                    inner = stack[i][1]
                    skipped -= sum(t in SKIPPED for t, _ in stack[i:])
                    del stack[i:]
                    break
        elif tag not in VOID and not m[4].endswith("/"):
            made = kind_of(tag, m[4])
            if tag in INLINE and made is None:
                continue
            if tag in INLINE:
                flush()
            if tag in SKIPPED or made is not None or tag not in ("p", "li", "td", "th", "tr", "dt", "dd", "option"):
                stack.append((tag, inner))
                skipped += tag in SKIPPED
            if made is not None:
                marked.append(Marked(inner, made, tag))
                inner = len(marked) - 1
    if at < len(page) and not skipped:
        held.append(html.unescape(page[at:]))
    flush()
    kinds = decided(marked)
    return [(kinds[k], text, n) for k, text, n in out]


def tokens_of(blocks: list[tuple[int, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all blocks' words, and how many words each block has."""
    return words.hashed([t for _, t, _ in blocks], lower=False) if blocks else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def kept_kind(kinds: list[int]) -> int:
    """The kind of block that a page's text is made of."""
    return CONTENT if CONTENT in kinds else OTHER


LEAST = pa.schema([("key", pa.int64()), ("kept", pa.bool_())])


def shared(pages: DataFrame) -> DataFrame:
    """(key): the least grams that several pages of a host have, one of them by a run of tokens that meets its text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.parts(batches):
            pages_of = [blocks_of(t) for t in part.column("text").to_pylist()]
            streams, sizes = zip(*map(tokens_of, pages_of), strict=True)
            stream, place, _, least = every(streams, GRAM, REACH)
            if not len(stream):
                continue
            of_text = [np.repeat([k == kept_kind([x for x, _, _ in b]) for k, _, _ in b], n) if b else np.zeros(0, dtype=bool) for b, n in zip(pages_of, sizes, strict=True)]
            before = np.concatenate([[0], np.cumsum(np.concatenate(of_text))])
            first = (np.cumsum([len(s) for s in streams]) - [len(s) for s in streams])[stream] + place
            kept = before[first + REACH] > before[first]
            key = least ^ part.column("host").to_numpy().view(np.uint64)[stream]
            order = np.lexsort((~kept, key, stream))  # a page's key once, with text where it has some
            key, stream, kept = key[order], stream[order], kept[order]
            once = np.concatenate([[True], (key[1:] != key[:-1]) | (stream[1:] != stream[:-1])])
            yield words.batch(LEAST, key=key[once].view(np.int64), kept=kept[once])

    found = arrow_batches(pages.select("host", "text")).mapInArrow(scan, "key long, kept boolean")
    return found.groupBy("key").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where("n > 1 and kept").select("key")


SCAN = pa.schema([("key", pa.int64()), ("who", pa.int64()), ("pos", pa.int64()), ("host", pa.int64()), ("kinds", pa.list_(pa.int8())), ("sizes", pa.list_(pa.int32())), ("links", pa.list_(pa.bool_()))])


def scanned(pages: DataFrame, least: DataFrame) -> DataFrame:
    """A row for each page's blocks (key null), and one for each place whose least gram is among ``least``, keyed by host and content.

    No place is left out that is repeated and meets a page's text.
    """
    held = pages.sparkSession.sparkContext.broadcast(bitmap(least))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.parts(batches):
            pages_of = [blocks_of(t) for t in part.column("text").to_pylist()]
            streams, sizes = zip(*map(tokens_of, pages_of), strict=True)
            host, who = part.column("host").to_numpy(), part.column("who").to_numpy()
            none = lambda n: {c: pa.nulls(n, SCAN.field(c).type) for c in SCAN.names}
            links = [[2 * l > len(t) for _, t, l in b] for b in pages_of]
            yield words.batch(SCAN, **none(len(part)) | {"who": who, "host": host, "kinds": [[k for k, _, _ in b] for b in pages_of], "sizes": [n.tolist() for n in sizes], "links": links})
            stream, place, key, gram = every(streams, GRAM, REACH)
            of_host = host.view(np.uint64)[stream]
            at = np.flatnonzero(hits(gram ^ of_host, held.value))
            if len(at):
                yield words.batch(SCAN, **none(len(at)) | {"key": (key ^ of_host)[at].view(np.int64), "who": who[stream[at]], "pos": place[at]})

    schema = "key long, who long, pos long, host long, kinds array<tinyint>, sizes array<int>, links array<boolean>"
    return arrow_batches(pages.select("who", "host", "text")).mapInArrow(scan, schema)


BLOCK = pa.schema([("host", pa.int64()), ("who", pa.int64()), ("block", pa.int32()), ("hash", pa.int64())])


def short_blocks(pages: DataFrame) -> DataFrame:
    """(host, who, block, hash) of each block of fewer than ``SHORT`` tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.parts(batches):
            rows = []
            for host, who, text in zip(part.column("host").to_pylist(), part.column("who").to_pylist(), part.column("text").to_pylist(), strict=True):
                stream, sizes = tokens_of(blocks_of(text))
                ends = np.cumsum(sizes)
                rows += [(host, who, b, int(run_hashes(stream[ends[b] - sizes[b] : ends[b]], int(sizes[b]))[0].view(np.int64))) for b in np.flatnonzero((sizes > 0) & (sizes < SHORT))]
            yield words.batch(BLOCK, **{c: [r[i] for r in rows] for i, c in enumerate(BLOCK.names)})

    return arrow_batches(pages.select("host", "who", "text")).mapInArrow(scan, "host long, who long, block int, hash long")


def covered(pages: DataFrame, seen: DataFrame, layouts: DataFrame) -> DataFrame:
    """(who, at, blocks): the places of a page's repeated suffixes, and its repeated short blocks, each with the number of pages that have it."""
    open_hosts = staged(layouts.where(f"not array_contains(kinds, {CONTENT}Y) and size(kinds) > 0").select("host").distinct(), "hosts")
    found = spread(seen.where("key is not null"), "repeats")
    at = found.groupBy("who").agg(F.collect_set(F.struct("pos", "n")).alias("at"))
    if open_hosts.isEmpty():
        return at.withColumn("blocks", F.expr("cast(array() as array<struct<block: int, n: bigint>>)"))
    whole = staged(short_blocks(pages.join(small(open_hosts), "host", "left_semi")), "shorts")
    pages_of = whole.select("host", "hash", "who").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where("n > 1")
    blocks = whole.join(pages_of, ["host", "hash"]).groupBy("who").agg(F.collect_set(F.struct("block", "n")).alias("blocks"))
    return at.join(blocks, "who", "full")


def dropped(cover: DataFrame, layouts: DataFrame) -> DataFrame:
    """(who, drop): the numbers of the blocks that a host's repeats decide against, of pages that have such blocks."""
    hosts = layouts.groupBy("host").agg(F.count("*").alias("host_pages"))
    rows = layouts.join(cover, "who").join(hosts, "host").select("who", "kinds", "sizes", "links", "at", "blocks", "host_pages")
    schema = pa.schema([("who", pa.int64()), ("drop", pa.list_(pa.int32()))])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            places = batch.column("at")
            pos, n, ends = places.values.field("pos").to_numpy(), places.values.field("n").to_numpy(), places.offsets.to_numpy()
            for i, r in enumerate(batch.drop_columns(["at"]).to_pylist()):
                at = list(zip(pos[ends[i] : ends[i + 1]].tolist(), n[ends[i] : ends[i + 1]].tolist(), strict=True))
                if drop := chosen(r["kinds"], r["sizes"], r["links"], at, {x["block"]: x["n"] for x in r["blocks"] or ()}, r["host_pages"]):
                    out.append((r["who"], drop))
            yield words.batch(schema, who=[w for w, _ in out], drop=[d for _, d in out])

    return arrow_batches(rows).mapInArrow(decide, "who long, drop array<int>")


def chosen(kinds: list[int], sizes: list[int], links: list[bool], at: list[tuple[int, int]], blocks: dict[int, int], host_pages: int) -> list[int]:
    """The blocks of one page to drop.

    ``at`` has the places of repeated suffixes and ``blocks`` the repeated short
    blocks, each with the number of pages that have it.  On an open page blocks
    covered by half go.  In declared content a covered block goes where it is in the
    lesser part of the content and either mostly links on ``FEW_PAGES`` or more
    pages, or short, at the content's edge and on at least half of the host's pages.
    """
    end = np.cumsum(sizes)
    spread = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.int64)  # for each token the pages of its widest repeat
    for pos, n in sorted(at, key=lambda x: x[1]):
        spread[pos : pos + REACH] = n
    for b, n in blocks.items():
        if sizes[b] > 2 or n >= FEW_PAGES:
            part = spread[end[b] - sizes[b] : end[b]]
            np.maximum(part, n, out=part)
    declared = CONTENT in kinds
    kept = [b for b, k in enumerate(kinds) if k == kept_kind(kinds)]
    of = {b: spread[end[b] - sizes[b] : end[b]] for b in kept}
    total, under = sum(sizes[b] for b in kept), sum(int((x > 0).sum()) for x in of.values())
    repeats = [b for b in kept if 2 * int((of[b] > 0).sum()) >= sizes[b]]
    pages = {b: int(np.median(of[b][of[b] > 0])) for b in repeats}
    if not declared:
        return [b for b in repeats if pages[b] >= FEW_PAGES or under < COPY * total]
    if 2 * under >= total:
        return []
    lead, rear = kept[0] if kept else 0, kept[-1] if kept else 0
    while lead in pages:
        lead = kept[kept.index(lead) + 1] if lead != kept[-1] else -1
    while rear in pages:
        rear = kept[kept.index(rear) - 1] if rear != kept[0] else len(kinds)
    edge = lambda b: b < lead or b > rear
    return [b for b in repeats if pages[b] >= FEW_PAGES and (links[b] or edge(b) and sizes[b] <= EDGE and 2 * pages[b] >= host_pages)]


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64()), ("n_dropped", pa.int64())])


def main_text(pages: DataFrame) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars, the number of its blocks, and of those that repeats decided against."""
    page, url, number = text_of(pages, "html"), pages["url"].cast("string"), pages["page_id"].cast("long")
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    keyed = pages.select(number.alias("page_id"), url.alias("url"), page.alias("text"), F.xxhash64(host).alias("host"), F.xxhash64(number, url, page).alias("who"))
    seen = staged(scanned(keyed, staged(shared(keyed), "least")), "scan")
    layouts = seen.where("key is null").select("who", "host", "kinds", "sizes", "links").dropDuplicates(["who"])
    drops = staged(dropped(covered(keyed, seen, layouts), layouts), "drops")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in words.parts(batches):
            rows = [kept_text(t, set(d or ())) for t, d in zip(part.column("text").to_pylist(), part.column("drop").to_pylist(), strict=True)]
            yield words.batch(RESULT, page_id=part.column("page_id"), url=[u for u in part.column("url").to_pylist()], text=[t for t, _, _ in rows], n_chars=[len(t) for t, _, _ in rows], n_blocks=[n for _, n, _ in rows], n_dropped=[d for _, _, d in rows])

    both = keyed.select("page_id", "url", "text", "who").join(small(drops), "who", "left").select("page_id", "url", "text", "drop")
    return arrow_batches(both).mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_blocks long, n_dropped long")


def kept_text(page: str, drop: set[int]) -> tuple[str, int, int]:
    """A page's text, the number of its blocks, and of the dropped ones."""
    blocks = blocks_of(page)
    kind = kept_kind([k for k, _, _ in blocks])
    kept = [t for i, (k, t, _) in enumerate(blocks) if k == kind and i not in drop]
    return "\n".join(kept), len(kept), len(drop)
