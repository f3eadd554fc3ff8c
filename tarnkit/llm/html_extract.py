"""Main text of web pages.

A page is cut into blocks of text, each in a zone: the article, boilerplate by its
markup (menus, headers, footers, sidebars, notices, adverts, forms, comments), or
loose. Loose blocks are segments of their own, and blocks of another zone that follow each
other are one. The token streams of
all segments of a host, articles included, are put end to end, and a suffix array finds
the strings of MIN_TOKENS tokens or more that occur on two distinct pages. What such
strings cover outside articles is removed as boilerplate; the rest of a page is its
unique runs, of which those stay that the markup doesn't speak against:

  article   stays whole, also where other pages repeat it, as articles have copies,
            quote each other and share licence lines
  loose     stays where it isn't covered; beside an article a run shorter than
            MIN_TOKENS, which the search can't judge, goes too
  boiler    goes: covered or, as reader comments and short menus are, by its markup

Pages of a host with equal articles and loose text are one page when strings are
counted, so that copies don't make each other boilerplate. repeated and marked tell how
many tokens of a page went because they recur and by markup alone.

A host with more than SHARD_CHARS characters of HTML is split by page. The windows of
MIN_TOKENS tokens of its loose segments are then looked up, by hash, among those of all
its pages, and the ones that two pages hold go to the shards that ask for them. So the
whole host is the evidence for every loose token at every size (for what is boilerplate
by markup too, repeated counts what the shard shows).

Edge cases: null and empty pages have an empty text; unclosed tags, comments and
truncated ends are taken as a browser would; pages are read whole; repeated rows are one
page when strings are counted, and each give a result; a null url is a host of its own;
an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnkit.llm import common as C
from tarnkit.llm.near_join import whole_groups
from tarnkit.llm.suffix_dedup import larsson_sadakane

MIN_TOKENS = 6
SHARD_CHARS = 6_000_000
ARTICLE, LOOSE, BOILER = range(3)

# Element and attribute names.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "object", "xmp", "noembed", "noframes"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCK = frozenset(("address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
BOILER_TAGS = frozenset(("nav", "header", "footer", "aside", "form", "menu", "head", "button", "dialog", "search"))
PLAIN = frozenset(("html", "body", "article", "main", "h1", "h2", "h3", "h4", "h5", "h6"))
HINTS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header masthead menu modal nav navbar navigation newsletter notice popup promo related respond share sharing sidebar social sponsor sponsored subscribe toolbar".split())
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"))

TAG = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<(?=[a-zA-Z!?/])""")
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+")


def hinted(name: str, attributes: str) -> bool:
    """Whether an element is boilerplate by its name, class, id or role."""
    if name in BOILER_TAGS:
        return True
    if name in PLAIN or "=" not in attributes:
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        if value in ROLES if key.lower() == "role" else HINTS.intersection(SPLIT.split(value)):
            return True
    return False


def zoned(page: str) -> tuple[list[tuple[str, str]], bool]:
    """(zone, text) of each block in order, and whether there is an article."""
    out: list[tuple[str, str]] = []
    pieces: list[str] = []
    zone, articles, mains, found = "loose", 0, 0, False
    skip, depth = "", 0  # the boilerplate element that is open, and how often
    at, n = 0, len(page)

    def close() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            out.append(("boiler" if skip else zone, text))

    while at < n:
        m = TAG.search(page, at)
        if not m:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at : m.start()])
        if m.group() == "<!--":
            end = page.find("-->", m.end())
            at = n if end < 0 else end + 3
            continue
        if m.end() - m.start() == 1:  # a tag that never ends
            break
        at = m.end()
        name = m.group(2) or m.group(5)
        if not name:
            continue
        name, closing, attributes = name.lower(), bool(m.group(1) or m.group(4)), m.group(3) or m.group(6) or ""
        if name in RAW:
            if not closing:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name in BLOCK:
            close()
        if skip:
            if skip == "p" and name in BLOCK:
                depth = 0  # a paragraph ends where any block starts or ends
            elif skip == name and name not in VOID:
                depth += -1 if closing else 1
            elif skip in ("li", "dd", "dt", "td", "th", "tr") and closing and name in BLOCK:
                depth = 0
            elif name in ("article", "main", "body") and (closing or not articles + mains):
                depth = 0  # an element left open ends with the one around it
            if depth > 0:
                continue
            skip = ""
            if closing and name not in ("article", "main"):
                continue
        if name in ("article", "main"):
            if name == "article":
                articles = max(0, articles + (-1 if closing else 1))
            else:
                mains = max(0, mains + (-1 if closing else 1))
            found |= not closing
            zone = "article" if articles or mains else "loose"
        elif not closing and name not in VOID and hinted(name, attributes):
            if name not in BLOCK:
                close()
            skip, depth = name, 1
    close()
    return out, found


def segments(page: str) -> tuple[list[int], list[str], bool]:
    """Zones and texts of the page's segments, and whether there is an article."""
    zones: list[int] = []
    texts: list[list[str]] = []
    every, found = zoned(page)
    for name, text in every:
        zone = (ARTICLE, LOOSE, BOILER)[("article", "loose", "boiler").index(name)]
        if zones and zones[-1] == zone != LOOSE:
            texts[-1].append(text)
        else:
            zones.append(zone)
            texts.append([text])
    return zones, [" ".join(t) for t in texts], found


def repeated_runs(ids: np.ndarray, page: np.ndarray, least: int = MIN_TOKENS) -> np.ndarray:
    """Which tokens lie in a string of least tokens or more that occurs on two pages.

    ids: the tokens of all pages, a value of its own between segments; page: of each."""
    n = len(ids)
    if n < 2 * least:
        return np.zeros(n, bool)
    order, _ = larsson_sadakane(ids, 1)
    alike = np.zeros(n, bool)  # with the suffix before it, for least tokens
    last = n - least
    near = np.flatnonzero((order[1:] <= last) & (order[:-1] <= last)) + 1
    for k in range(least):
        near = near[ids[order[near] + k] == ids[order[near - 1] + k]]
    alike[near] = True
    first = np.flatnonzero(~alike)
    pages = page[order]
    shared = np.minimum.reduceat(pages, first) != np.maximum.reduceat(pages, first)
    starts = order[np.repeat(shared, np.diff(np.append(first, n)))]
    edge = np.zeros(n + least + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + least, -1)
    return np.cumsum(edge)[:n] > 0


class Stream:
    """The tokens of segments: their bytes, codes and segments."""

    def __init__(self, texts: pa.Array) -> None:
        self.data, self.offsets = C.column_bytes(texts)
        self.start, self.end = C.word_spans(self.data, self.offsets)
        self.code, self.table = C.span_codes(self.data, self.start, self.end)
        self.segment = np.searchsorted(self.offsets, self.start, "right") - 1

    def covered(self, page: np.ndarray) -> np.ndarray:
        """Which tokens recur; page: of each segment."""
        n, at = len(self.code) + len(page), np.arange(len(self.code)) + self.segment
        ids, pages = np.empty(n, np.int64), np.empty(n, np.int64)
        ends = np.cumsum(np.bincount(self.segment, minlength=len(page)) + 1) - 1
        ids[at], pages[at] = self.code, page[self.segment]
        ids[ends], pages[ends] = -1 - np.arange(len(page)), page
        return repeated_runs(ids, pages)[at]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First tokens of the windows of MIN_TOKENS tokens inside a segment, and their hashes."""
        n = max(0, len(self.code) - MIN_TOKENS + 1)
        at = np.flatnonzero(self.segment[:n] == self.segment[MIN_TOKENS - 1 :][:n])
        told = np.fromiter(map(C.digest, self.table.to_pylist()), np.uint64, len(self.table))[self.code]
        key = np.zeros(len(at), np.uint64)
        for k in range(MIN_TOKENS):
            key = C.mix(key * np.uint64(C.BASE) + told[at + k])
        return at, key.view(np.int64)

    def runs(self, segment: int, covered: np.ndarray, least: int) -> Iterator[str]:
        """The segment's tokens that aren't covered, in runs of least tokens or more."""
        a, b = np.searchsorted(self.segment, [segment, segment + 1])
        edge = np.flatnonzero(np.diff(np.concatenate([[True], covered[a:b], [True]]))) + a
        for i, j in zip(edge[::2], edge[1::2], strict=True):
            if j - i >= least:
                yield bytes(self.data[self.start[i] : self.end[j - 1]]).decode()


def _parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, page (a digest of what isn't boilerplate), spread (a hash of the
    row, which deals it to a shard), marked, zones and texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in C.runs(C.column_bytes(batch.column(2))[1]):
                page, marked, zones, texts = [], [], [], []
                for value in batch.column(2).slice(i, j - i):
                    zone, text, found = segments(value.as_py() or "")
                    page.append(C.digest("\0".join(t for z, t in zip(zone, text, strict=True) if z != BOILER).encode()) >> 1)
                    marked.append(found)
                    zones.append(zone)
                    texts.append(text)
                columns = [*(batch.column(k).slice(i, j - i) for k in (0, 1, 3)), pa.array(page, pa.int64()), pa.array(marked, pa.bool_()), pa.array(zones, pa.list_(pa.int8())), pa.array(texts, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "page", "marked", "zones", "texts"])

    kind = pages.schema["page_id"].dataType.simpleString()
    out = pages.select("page_id", "url", "html", _host()).mapInArrow(work, f"page_id {kind}, url string, host string, page long, marked boolean, zones array<byte>, texts array<string>")
    return out.withColumn("spread", F.xxhash64("page_id", "url", "page"))


def _host() -> Column:
    return F.lower(F.coalesce(F.regexp_extract("url", "://([^/?#]*)", 1), F.lit(""))).alias("host")


def _dealt(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """rows of the hosts in shards, each with its shard in place of spread."""
    return rows.join(shards, "host").withColumn("shard", F.pmod("spread", F.col("shards"))).drop("shards", "spread")


def _windows(parsed: DataFrame, loose: bool) -> DataFrame:
    """host, key, and the page and spread of the windows of loose segments; or host, key and
    the least and greatest page of those of all segments, once each batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zone, texts = batch.column(3), batch.column(4)
            row = np.repeat(np.arange(batch.num_rows), np.diff(zone.offsets.to_numpy()))
            pick = np.flatnonzero((zone.flatten().to_numpy() == LOOSE) | (not loose))
            if not len(pick):
                continue
            stream = Stream(texts.flatten().take(pa.array(pick)))
            at, key = stream.windows()
            of = row[pick][stream.segment[at]]
            page, host, spread = batch.column(1).to_numpy()[of], C.codes_of(batch.column(0))[of], batch.column(2).to_numpy()[of]
            order = np.lexsort((spread, key, host) if loose else (key, host))
            host, key, page, of, spread = (x[order] for x in (host, key, page, of, spread))
            new = (host[1:] != host[:-1]) | (key[1:] != key[:-1])
            first = np.flatnonzero(np.append(True, new | (spread[1:] != spread[:-1]) if loose else new))[: len(key)]
            if not len(first):
                continue
            rest = [pa.array(spread[first])] if loose else [pa.array(np.minimum.reduceat(page, first)), pa.array(np.maximum.reduceat(page, first))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[first])), pa.array(key[first]), *rest], ["host", "key", *(("spread",) if loose else ("low", "high"))])

    return parsed.select("host", "page", "spread", "zones", "texts").mapInArrow(work, "host string, key long, " + ("spread long" if loose else "low long, high long"))


def _known(pages: DataFrame, shards: DataFrame) -> DataFrame | None:
    """host, shard, known: of a split host's loose windows those that two of its pages hold."""
    parsed, split = _parsed(pages), shards.where("shards > 1")
    asked = C.staged(_dealt(_windows(parsed, True), split).distinct(), "asked")
    if asked.isEmpty():
        return None
    held = _windows(parsed, False).join(asked.select("host", "key").distinct(), ["host", "key"], "left_semi")
    twice = held.groupBy("host", "key").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high")
    return asked.join(twice, ["host", "key"]).groupBy("host", "shard").agg(F.collect_list("key").alias("known"))  # no more than the shard's tokens


def _extracted(streams: DataFrame, kind: str) -> DataFrame:
    """Sorted rows of whole shards, to the text of each page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["host", "shard"], 1024):
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield shard(table.slice(a, b - a).combine_chunks())

    def shard(table: pa.Table) -> pa.RecordBatch:
        zones, texts = (table.column(c).chunk(0) for c in ("zones", "texts"))
        cut = zones.offsets.to_numpy() - zones.offsets[0].as_py()
        zone, text = zones.flatten().to_numpy(), texts.flatten()
        row = np.repeat(np.arange(table.num_rows), np.diff(cut))
        _, first, of = np.unique(table.column("page").to_numpy(), return_index=True, return_inverse=True)
        stand = first[of]  # the page that stands for all of equal text
        used = np.flatnonzero((zone == BOILER) | (stand[row] == row))
        place = np.full(len(zone), -1)
        place[used] = np.arange(len(used))
        stream = Stream(text.take(pa.array(used)))
        covered = stream.covered(of[row[used]])
        known = pa.concat_arrays([pa.array([], pa.int64()), *(x.flatten() for x in table.column("known").chunks)]).to_numpy()
        if len(known):
            begin, key = stream.windows()
            begin = begin[(zone[used] == LOOSE)[stream.segment[begin]] & np.isin(key, known)]
            for k in range(MIN_TOKENS):
                covered[begin + k] = True
        repeats, size = (np.bincount(stream.segment, weights=w, minlength=len(used)).astype(np.int64) for w in (covered, np.ones(len(covered))))
        marked = table.column("marked").to_pylist()
        out, repeated, by_mark = [], [], []
        for r in range(table.num_rows):
            parts, n_repeated, n_marked = [], 0, 0
            theirs = iter(np.flatnonzero(zone[cut[stand[r]] : cut[stand[r] + 1]] == LOOSE) + cut[stand[r]])
            for s in range(cut[r], cut[r + 1]):
                if zone[s] == ARTICLE:
                    parts.append(text[s].as_py())
                elif zone[s] == LOOSE:
                    k = place[next(theirs)]
                    parts += stream.runs(k, covered, MIN_TOKENS if marked[r] else 1)
                    n_repeated += int(repeats[k])
                else:
                    n_repeated += int(repeats[place[s]])
                    n_marked += int(size[place[s]] - repeats[place[s]])
            out.append(" ".join(parts))
            repeated.append(n_repeated)
            by_mark.append(n_marked)
        real = table.column("real").combine_chunks()
        columns = [table.column("page_id").combine_chunks(), table.column("url").combine_chunks(), pa.array(out, pa.string()), pa.array(repeated, pa.int64()), pa.array(by_mark, pa.int64())]
        return pa.RecordBatch.from_arrays([c.filter(real) for c in columns], ["page_id", "url", "text", "repeated", "marked"])

    return streams.mapInArrow(work, f"page_id {kind}, url string, text string, repeated long, marked long")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, repeated and marked of each page."""
    shards = pages.groupBy(_host()).agg(F.greatest(F.lit(1), F.ceil(F.sum(F.coalesce(F.length("html"), F.lit(0))) / SHARD_CHARS)).alias("shards"))
    shards = C.staged(shards, "shards")  # a table of known size: Spark broadcasts it if it is small, and moves no page to find that out
    known = _known(pages, shards)
    rows = _dealt(_parsed(pages), shards).withColumns({"known": F.array().cast("array<long>"), "real": F.lit(True)})
    if known is not None:
        none = {"page_id": F.lit(None).cast(pages.schema["page_id"].dataType), "url": F.lit(None).cast("string"), "page": F.lit(-1).cast("long"), "marked": F.lit(False), "zones": F.array().cast("array<byte>"), "texts": F.array().cast("array<string>"), "real": F.lit(False)}
        rows = rows.unionByName(known.withColumns(none))
    streams = rows.repartition("host", "shard").sortWithinPartitions("host", "shard", "page")
    out = _extracted(streams, pages.schema["page_id"].dataType.simpleString())
    return out.withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "repeated", "marked")
