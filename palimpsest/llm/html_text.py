"""Main text of web pages, with site templates removed.

One linear pass parses each page into blocks of text and the container elements
around them.  Every container subtree, menus and footers included, is hashed over
its tags and text, from the leaves up; Spark counts on how many pages of a host
each hash occurs, and subtrees on ``LEAST_PAGES`` of them or more are deleted.
Copies of an article are no template: a hash counts once for all pages of equal
text, a subtree with half of its page's text or more counts but isn't deleted
there, nor is a plain text block (paragraph, heading, list item, cell ...) of an
article.

What occurs once can't be told by counting, so elements that are no article text
by their kind go as well: by tag or role, and containers (not paragraphs, headings
and the like) by a class or id that is exactly a name for a menu, header, footer,
sidebar, notice, advert or comment section; within an article only adverts and
comment sections go by name.  Where a page has articles (or else a main element),
only the one with the most text is read; an article within an article is a
reader's comment.  Nothing else is left out: not what a style hides, nor further
elements whose names only sound like one of these kinds.

Blocks end at block-level tags and line breaks.  White space is what str.split
takes as such.  Null or empty html gives empty text; a null url is a host of its
own name, "".  Rows are handled one by one: repeated rows come out repeatedly, and
null ids stay null.  A page's cost grows with its length, however deeply it nests.
An empty table gives an empty result; extra columns are left out at the scan.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, stored

#: A template is on this many differing pages of a host, however many it has.
LEAST_PAGES = 4

# Element names and attribute words of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("br body html head option optgroup caption tbody td tfoot th thead tr legend title".split())
OUT = frozenset("head template nav footer aside form dialog menu search".split())
MUTE = frozenset("button select datalist svg canvas object audio video".split())
HEAD = frozenset("html head base link meta title style script noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertisements advertising".split())
COMMENTS = frozenset("comments comment-list commentlist comment-section comments-section disqus-thread".split())
NAMES = ADVERTS | COMMENTS | frozenset("menu nav navbar navigation header site-header page-header footer site-footer page-footer sidebar side-bar notice notices cookie-notice cookie-banner".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
CONTAINERS = TEXTUAL | frozenset("div section ul ol dl table header footer nav aside form menu search dialog details figure center tr tbody address".split()) - frozenset(["figcaption", "caption"])
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body article main section div td th table ul ol dl aside nav footer header form".split())
BARRIERS = ("article", "main", "td", "th")
CROSSES = frozenset("article main td th tr table body html div section".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+[^>]*+)>?)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_END_OF = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}

PAGE = "row_id bigint, page_id bigint, url string, host string, page_key bigint, subtrees array<bigint>, packed binary"
TEXT = "page_id bigint, url string, text string, n_chars bigint, n_removed bigint"


def _left_out(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no article text by its kind; ``inside`` an article or main element a header is."""
    if name in OUT or (name == "header" and not inside):
        return True
    if name not in CONTAINERS and name != "article" or not attributes or attributes.isspace():
        return False
    low = attributes.lower()
    if not any(k in low for k in ("class", "id", "role")):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in ROLES:
        return True
    if name in TEXTUAL:
        return False
    words = {w.replace("_", "-") for w in f"{found.get('class', '')} {found.get('id', '')}".lower().split()}
    return bool(words & (ADVERTS | COMMENTS if inside else NAMES))


class Page:
    """Text blocks of a page's article, and its container subtrees in document order.

    ``hashes[k]`` names subtree k; it holds the blocks from ``first[k]`` to
    ``last[k]`` and the subtrees up to ``until[k]``, which is 0 where it must stay.
    """

    def __init__(self, source: str):
        blocks: list[tuple[str, bool, int, bool]] = []  # text, left out by kind, article or -1, in a main element
        self.hashes: list[int] = []
        begin, stop, self.until = [], [], []
        content: list[bytearray] = []  # of each container: its tag, then hashes of its lines and subtrees
        # open elements: name, muted, left out, innermost container, article, in main, own container
        stack: list[tuple[str, bool, bool, int, int, bool, int]] = [("", False, False, -1, -1, False, -1)]
        open_at: dict[str, list[int]] = defaultdict(list)
        scopes = [0]
        articles = 0
        text: list[str] = []

        def flush():
            if text:
                line = " ".join(html.unescape("".join(text)).split())
                text.clear()
                if line:
                    _, _, out, inner, article, main, _ = stack[-1]
                    blocks.append((line, out, article, main))
                    if inner >= 0:
                        content[inner] += _digest(line.encode("utf-8", "surrogatepass"))

        def close(to: int):
            while len(stack) > to:
                name, _, _, _, _, _, own = stack[-1]
                if name in BLOCK:
                    flush()
                stack.pop()
                open_at[name].pop()
                if name in SCOPE:
                    scopes.pop()
                if own >= 0:
                    digest = _digest(content[own])
                    self.hashes[own] = int.from_bytes(digest, "little", signed=True)
                    content[own] = bytearray()
                    stop[own], self.until[own] = len(blocks), len(begin)
                    if stack[-1][3] >= 0:
                        content[stack[-1][3]] += digest

        def nearest(names) -> int:
            return max((open_at[n][-1] for n in names if open_at[n]), default=0)

        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            if not m:
                if not stack[-1][1]:
                    text.append(source[at:])
                break
            if m.start() > at and not stack[-1][1]:
                text.append(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            name = m[2].lower()
            if m[1]:
                place = nearest([name])
                if place and (name in CROSSES or place > nearest(BARRIERS)):
                    close(place)
                elif name == "p" and not place:
                    flush()
                continue
            if open_at["head"] and name not in HEAD:
                close(open_at["head"][-1])
            if name in BLOCK and not stack[-1][1]:
                flush()
            if name in CLOSES_P and nearest(["p"]) > scopes[-1]:
                close(nearest(["p"]))
            if name in CLOSED_BY:
                above = nearest(SIBLINGS[name])
                place = min((open_at[n][-1] for n in CLOSED_BY[name] if open_at[n] and open_at[n][-1] > above), default=0)
                if place:  # a row closes with its cells
                    close(place)
            if name in VOID:
                continue
            if name in RAW:
                done = _END_OF[name].search(source, at)
                at = done.end() if done else end
                continue
            _, mute, out, inner, article, main, _ = stack[-1]
            out = out or (name == "article" and article >= 0) or _left_out(name, m[3], article >= 0 or main)
            if name == "article" and not out:
                article, articles = articles, articles + 1
            own = -1
            if name in CONTAINERS and not mute and not (name in TEXTUAL and (article >= 0 or main)):
                own = inner = len(begin)
                begin.append(len(blocks)), stop.append(0), self.until.append(0), self.hashes.append(0)
                content.append(bytearray(name.encode() + b">"))
            open_at[name].append(len(stack))
            if name in SCOPE:
                scopes.append(len(stack))
            stack.append((name, mute or name in MUTE, out, inner, article, main or name == "main", own))
        flush()
        close(1)

        plain = [b for b in blocks if not b[1]]
        size = defaultdict(int)
        for line, _, article, _ in plain:
            size[article] += len(line)
        best = max((a for a in size if a >= 0), key=lambda a: (size[a], -a), default=-1)
        if best >= 0:
            keep = [not out and article == best for _, out, article, _ in blocks]
        else:
            some = any(main for *_, main in plain)
            keep = [not out and (main or not some) for _, out, _, main in blocks]
        self.blocks = [b[0] for b, k in zip(blocks, keep, strict=True) if k]
        # places and lengths in terms of the blocks that are read
        place = np.concatenate([[0], np.cumsum(np.array(keep, np.int64))]).astype(np.int64)
        length = np.concatenate([[0], np.cumsum([len(b) for b in self.blocks])]).astype(np.int64)
        begin, stop, until = np.array(begin, np.int64), np.array(stop, np.int64), np.array(self.until, np.int64)
        self.first, self.last = place[begin], place[stop]
        until[(length[self.last] - length[self.first]) * 2 >= max(1, int(length[-1]))] = 0
        # subtrees without text are none
        full = stop > begin
        rank = np.concatenate([[0], np.cumsum(full)])
        self.until = np.where(until > 0, rank[until], 0)[full]
        self.hashes = np.array(self.hashes, np.int64)[full]
        self.first, self.last = self.first[full], self.last[full]

    def text(self) -> str:
        return " ".join(self.blocks)

    def packed(self) -> bytes:
        """All but the hashes, as ``unpacked`` reads them; blocks hold no line breaks."""
        numbers = np.concatenate([[len(self.first)], self.first, self.last, self.until]).astype(np.int32)
        return zstandard.compress(numbers.tobytes() + "\n".join(self.blocks).encode("utf-8", "surrogatepass"))


def _digest(content: bytes | bytearray) -> bytes:
    return xxhash.xxh3_64_digest(bytes(content))


def _hash(content: str) -> int:
    return xxhash.xxh3_64_intdigest(content.encode("utf-8", "surrogatepass")) - (1 << 63)


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _parser(batches):
    context = TaskContext.get()
    row_id = (context.partitionId() if context else 0) << 33
    for batch in batches:
        for low in range(0, batch.num_rows, 500):
            part = batch.slice(low, min(500, batch.num_rows - low))
            n = part.num_rows
            pages = [Page(source or "") for source in part.column(2).to_pylist()]
            lists = [pa.array([p.hashes for p in pages], pa.list_(pa.int64())), pa.array([p.packed() for p in pages], pa.binary())]
            columns = [pa.array(np.arange(row_id, row_id + n)), part.column(0), part.column(1), pa.array([_host(u) for u in part.column(1).to_pylist()], pa.string()), pa.array([_hash(p.text()) for p in pages], pa.int64())]
            row_id += n
            yield pa.RecordBatch.from_arrays([*columns, *lists], names=["row_id", "page_id", "url", "host", "page_key", "subtrees", "packed"])


def unpacked(packed: bytes) -> tuple[list[str], list[int], list[int], list[int]]:
    """Blocks, and the first and last block and the end of each subtree."""
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:4], "little")
    first, last, until = np.frombuffer(raw, np.int32, 3 * n, 4).reshape(3, n).tolist()
    text = raw[4 + 12 * n :].decode("utf-8", "surrogatepass")
    return text.split("\n") if text else [], first, last, until


def without(blocks: list[str], first: list[int], last: list[int], until: list[int], gone: set[int]) -> tuple[str, int]:
    """The text without the subtrees numbered in ``gone``, and how many were deleted, one within another counted with it."""
    edge, found, low = np.zeros(len(blocks) + 1, np.int64), 0, 0
    for k in sorted(gone):
        if k >= low and until[k]:
            edge[first[k]] += 1
            edge[last[k]] -= 1
            found, low = found + 1, until[k]
    inside = np.cumsum(edge[:-1]) > 0
    return " ".join(b for b, out in zip(blocks, inside.tolist(), strict=True) if not out), found


def _cutter(batches):
    for batch in batches:
        made = [without(*unpacked(packed), set(gone or ())) for packed, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        texts = [t for t, _ in made]
        columns = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([n for _, n in made], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["page_id", "url", "text", "n_chars", "n_removed"])


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_removed) of every row of ``pages`` (page_id, url, html); n_removed counts deleted templates."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    bounded_batches(pages.sparkSession)
    parsed = stored(pages.mapInArrow(_parser, PAGE))
    seen = parsed.select("row_id", "host", "page_key", F.posexplode("subtrees").alias("place", "subtree"))
    counted = seen.groupBy("host", "subtree", "page_key").agg(F.lit(1).alias("one")).groupBy("host", "subtree").agg(F.count("*").alias("found"))
    often = stored(counted.filter(F.col("found") >= least_pages).select("host", "subtree"))
    # at most the subtrees of one page meet in a group; written, so that Spark knows its size and
    # moves the pages' texts, packed, only where it is too large to broadcast
    gone = stored(seen.join(often, ["host", "subtree"]).groupBy("row_id").agg(F.collect_list("place").alias("gone")))
    return parsed.join(gone, "row_id", "left").select("page_id", "url", "packed", "gone").mapInArrow(_cutter, TEXT)


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
