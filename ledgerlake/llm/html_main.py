"""Main text of web pages by site template removal.

1. Every page is parsed leniently to a tree (unclosed and cut-off elements
   included), and its element subtrees are hashed: tag, class and id, and the
   content below.
2. Spark counts, per host, on how many different pages each subtree occurs.
3. Subtrees that recur on many pages of their host are the site's template and
   are deleted, next to elements that are never main text by their kind
   (navigation, scripts, forms, comments, adverts and the like).
4. What is left in the article is cut into blocks.

Paragraphs and headings of an article are content even if documents share
them, so inside an article only containers can be template, at a higher share.
Equal pages of one host count as one page, so copies make no template.

Defined cases: a null or empty html has an empty text; a null url is a host of
its own; a page without article or main uses its whole body; repeated rows are
extracted each; a very long or deeply nested page costs time in proportion to
its length; an empty table gives an empty table; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import columns, salted_left_join
from ledgerlake.llm.words import slices

MIN_PAGES, MIN_SHARE = 3, 0.2  # of a host's different pages, outside articles
ARTICLE_PAGES, ARTICLE_SHARE = 5, 0.5  # containers inside articles; paragraphs of pages without one

# Element kinds (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
                  "summary table tbody td tfoot th thead tr ul".split())
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr".split())
DROPPED = frozenset("head script style noscript template iframe object canvas svg nav footer aside form button select "
                    "textarea input label menu dialog title map audio video".split())
DROPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
                          "cookie cookies disclaimer disqus footer gdpr menu modal nav navbar navigation newsletter notice notices "
                          "pager pagination popup promo promoted promotion related replies reply share sharing sidebar signup "
                          "skip social sponsor sponsored subscribe toolbar widget widgets".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr dd dt li".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th")}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
                    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_CUT_OFF = re.compile(r"<[A-Za-z/!?]")
_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_NAMES = re.compile(r"[a-z]+")


class Node:
    # below: does the subtree hold an h1 or h2, an article that is not dropped
    __slots__ = ("tag", "names", "drop", "children", "hash", "heading_below", "article_below")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.hash = tag, [], 0
        self.heading_below = self.article_below = False
        self.names, self.drop = "", tag in DROPPED
        if attributes.strip():
            found = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            self.names = (found.get("class", "") + " " + found.get("id", "")).strip().lower()
            if tag not in ("html", "body", "article", "main"):
                words = set(_NAMES.findall(self.names))
                self.drop |= bool(words & DROPPED_NAMES) or found.get("role", "").lower() in DROPPED_ROLES
                self.drop |= "hidden" in found or found.get("aria-hidden") == "true"
                self.drop |= bool(re.search(r"display\s*:\s*none", found.get("style", "")))
                self.drop |= tag == "div" and "header" in words and not words & {"article", "post", "entry"}
            elif tag == "article":
                self.drop = bool(set(_NAMES.findall(self.names)) & {"comment", "comments", "reply", "replies"})


class _Open:
    """The open elements, with the places of each tag, so that no end tag searches the stack."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """End the element at ``place`` and all inside it."""
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        """The place of the innermost open element of ``tags``, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: tuple, limit: frozenset) -> None:
        """End the innermost open element of ``tags``, unless one of ``limit`` stands between."""
        place = self.last(tags)
        if place and place >= self.last(limit):
            self.cut(place)

    def end(self, tag: str) -> None:
        place = self.last((tag,))
        if place and (tag in BLOCK or place > self.blocks[-1]):  # an inline end tag does not close blocks
            self.cut(place)


def parse(html: str) -> Node:
    """A lenient tree: open elements end with their parent, stray end tags are ignored, a cut-off tag is dropped."""
    root = Node("#root")
    stack = _Open(root)
    at, size = 0, len(html)
    last_mark = html.rfind(">")
    while at < size:
        if at > last_mark:  # no tag ends any more: text up to a cut-off one
            cut = _CUT_OFF.search(html, at)
            _text(stack.nodes[-1], html[at:] if cut is None else html[at:cut.start()])
            break
        m = _TOKEN.search(html, at)
        if m is None:
            _text(stack.nodes[-1], html[at:])
            break
        if m.start() > at:
            _text(stack.nodes[-1], html[at:m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None or not m[0].endswith(">"):
            continue
        tag = tag.lower()
        if close:
            stack.end(tag)
            continue
        if tag in CLOSES_P:
            stack.close(("p",), CLOSES_P - {"p"})
        if tag in SIBLINGS:
            stack.close(SIBLINGS[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        node = Node(tag, attributes)
        stack.nodes[-1].children.append(node)
        if tag in RAW and not attributes.endswith("/"):
            end = _RAW_END[tag].search(html, at)
            at = size if end is None else end.start()
            at = (html.find(">", at) + 1 or size) if end is not None else at
        elif tag not in VOID and not attributes.endswith("/"):
            stack.push(node)
    return root


def _text(node: Node, text: str) -> None:
    if text:
        node.children.append(text)


def hash_tree(root: Node) -> None:
    """Set the hash of every element and what it holds; iterative, so depth is no limit."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    for n in reversed(order):
        h = hashlib.blake2b(f"{n.tag}\0{n.names}".encode("utf-8", "replace"), digest_size=8)
        for c in n.children:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "little", signed=True))
                n.heading_below |= c.heading_below or c.tag in ("h1", "h2")
                n.article_below |= c.article_below or (c.tag == "article" and not c.drop)
            elif c.strip():
                h.update(" ".join(c.split()).encode("utf-8", "replace") + b"\1")
        n.hash = int.from_bytes(h.digest(), "little", signed=True)


def subtrees(root: Node) -> set[tuple[int, bool]]:
    """(hash, strict) of the page's deletable block elements; strict ones need the higher share."""
    has_article = any(n.tag in ("article", "main") for n in _walk(root))
    out = set()
    todo = [(root, False)]
    while todo:
        n, inside = todo.pop()
        inside = inside or n.tag in ("article", "main")
        for c in n.children:
            if isinstance(c, Node):
                todo.append((c, inside))
        if n.tag in BLOCK and n.tag not in ("html", "body", "article", "main", "td", "th", "tr", "tbody"):
            if n.tag in CONTENT and (inside or not has_article):
                if has_article:
                    continue
                out.add((n.hash, True))
            else:
                out.add((n.hash, inside))
    return out


def _walk(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def blocks(start: Node, template: frozenset | set) -> list[str]:
    """The text blocks below ``start`` in page order, without dropped kinds and template subtrees."""
    out, parts = [], []

    def flush():
        text = " ".join(unescape("".join(parts)).split())
        if text:
            out.append(text)
        parts.clear()

    todo: list = [start]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            parts.append(x)
        elif x.tag in ("br", "wbr"):
            parts.append(" " if x.tag == "br" else "")
        elif x is not start and (x.drop or x.hash in template or (x.tag == "header" and not x.heading_below)):
            if x.tag in BLOCK:
                flush()
        else:
            block = x.tag in BLOCK and x.tag not in ("td", "th")
            if block:
                flush()
                todo.append(None)
            if x.tag in ("td", "th"):
                parts.append(" ")
            todo += reversed(x.children)
    flush()
    return out


def main_text(root: Node, template: frozenset | set) -> str:
    """The article's blocks joined by an empty line; of several articles all, of none the body."""
    starts, todo, fallback = [], [root], []
    while todo:
        n = todo.pop()
        if n is not root and (n.drop or n.hash in template):
            continue
        if n.tag == "article" or n.tag == "main" and not n.article_below:
            starts.append(n)
            continue
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    text = [b for s in starts for b in blocks(s, template)]
    if not text:
        body = next((n for n in _walk(root) if n.tag == "body"), root)
        fallback = blocks(body, template)
    return "\n\n".join(text or fallback)


def _parsed(html: str) -> Node:
    root = parse(html)
    hash_tree(root)
    return root


def _hash_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html"):
            host, page, hashes, strict = [], [], [], []
            for h, p, html in zip(part.column("host").to_pylist(), part.column("fp").to_pylist(), part.column("html").to_pylist(), strict=True):
                found = subtrees(_parsed(html))
                host += [h] * len(found)
                page += [p] * len(found)
                hashes += [x for x, _ in found]
                strict += [s for _, s in found]
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.int64()), pa.array(hashes, pa.int64()),
                                              pa.array(strict, pa.bool_())], ["host", "fp", "subtree", "strict"])


def _pack_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in slices(batch, "html"):
            packed = [press.compress(x.encode("utf-8")) for x in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(c) for c in ("page_id", "url", "host", "fp")] + [pa.array(packed, pa.binary())],
                ["page_id", "url", "host", "fp", "packed"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpress = zstandard.ZstdDecompressor()
    for batch in batches:
        for part in slices(batch, "packed", 1 << 20):
            texts = []
            for packed, gone in zip(part.column("packed").to_pylist(), part.column("gone").to_pylist(), strict=True):
                html = unpress.decompress(packed).decode("utf-8")
                texts.append(main_text(_parsed(html), set(gone or ())))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])


def site_templates(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seen, templates): the (host, fp, subtree) rows of all different pages, and the (host, subtree) that recur on many."""
    seen = pages.mapInArrow(_hash_pages, "host string, fp long, subtree long, strict boolean")
    once = seen.groupBy("host", "fp", "subtree").agg(F.max("strict").alias("strict"))
    count = once.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"), F.max("strict").alias("strict"))
    hosts = pages.select("host", "fp").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    enough = F.when(F.col("strict"), (F.col("n") >= ARTICLE_PAGES) & (F.col("n") >= ARTICLE_SHARE * F.col("pages"))).otherwise(
        (F.col("n") >= MIN_PAGES) & (F.col("n") >= MIN_SHARE * F.col("pages")))
    return once, count.join(hosts, "host").where(enough).select("host", "subtree", F.lit(True).alias("hit"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url and text (empty if there is none) of every row of ``pages`` (page_id, url, html)."""
    p = columns(pages, ["page_id", "url", "html"]).withColumn("page_id", F.col("page_id").cast("long"))
    p = p.withColumn("html", F.coalesce("html", F.lit("")))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    p = p.withColumn("host", host).withColumn("fp", F.xxhash64("html"))
    once, templates = site_templates(p)
    gone = (salted_left_join(once, templates, ["host", "subtree"], F.col("fp")).where("hit")
            .groupBy("host", "fp").agg(F.collect_list("subtree").alias("gone")))
    packed = p.mapInArrow(_pack_pages, "page_id long, url string, host string, fp long, packed binary")
    return salted_left_join(packed, gone, ["host", "fp"], F.col("page_id"), 4).select(
        "page_id", "url", "packed", "gone").mapInArrow(_extract, "page_id long, url string, text string")
