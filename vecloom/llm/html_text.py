"""HTML extraction with site template removal.

A page becomes an element tree. The subtrees of block elements are hashed and counted for each host in
Spark, over pages of different content. Outside of articles and main elements, those that recur on a
tenth of a host's pages (LEAST at least) are its template; inside of them, where writing may well repeat,
those that recur on four fifths of its pages (INSIDE_LEAST at least), whatever they are: paragraphs too. Template
subtrees are deleted where they stand, and a page of nothing else has an empty text. Besides, elements
that never hold main text go by their tag, role, class or id (NEVER, ROLES, WORDS); inside an article or
main element paragraphs, headings and the like are not judged by class or id, and other elements only by
INSIDE_WORDS. What stays of the outermost articles (else of main, else of the body) is the text.

Template hashes go to the workers by broadcast while they are few (their number is counted first);
else each page's own hashes meet the templates by a join, and pages meet what they hit.

Cases: a null or empty html has an empty text. A page without a host meets no template. Repeated pages
count once. Parsing is linear in the page, however long its tags, deep its nesting or many its stray end
tags. Ties cannot be: a share is reached or not. Other columns are ignored, whatever their names. An empty
table gives an empty table.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm._common import small_batches, table
from vecloom.session import materialize

#: A subtree is template from this share of a host's pages on, but never under LEAST pages.
SHARE, LEAST = 0.1, 3
#: The same inside articles and main elements.
INSIDE_SHARE, INSIDE_LEAST = 0.8, 10
#: Tells a subtree inside from the same one outside.
_INSIDE = 0x5DEECE66D
#: Most template hashes that are broadcast (16 bytes each in a worker's set, about 30 MB).
BROADCAST_TEMPLATES = 400_000

# Fixed sets of HTML: elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
NEVER = frozenset("head script style noscript template nav aside footer form button select option input textarea iframe object embed svg canvas audio video map dialog menu title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figcaption dt dd li td th caption".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "body": {"head"}}
P_SCOPE = ("table", "td", "th", "button", "div", "article", "section", "main", "li")
CONTENT = ("article", "main")
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices sidebar nav navbar "
    "navigation menu breadcrumb breadcrumbs footer masthead comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe "
    "subscription popup modal overlay widget widgets pagination pager skip toolbar copyright disclaimer login signup search".split()
)

# Words that mark an element other than prose inside an article or main element.
INSIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr comment comments disqus respond share sharing social newsletter subscribe subscription popup pagination pager sidebar nav navbar navigation breadcrumb breadcrumbs related recommended".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(?:>|\Z)""", re.DOTALL)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


class Node:
    """An element: ``holds`` is whether an article or main element stands below."""

    __slots__ = ("tag", "attrs", "kids", "hash", "holds")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids, self.hash, self.holds = tag, attrs, [], 0, False


class Open:
    """The open elements, and at which depths each tag is open."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        self.stack.append(node)

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            node = self.stack.pop()
            if self.stack:
                self.at[node.tag].pop()
                self.stack[-1].holds |= node.holds or node.tag in CONTENT
            seal(node)

    def deepest(self, tags) -> int:
        """The depth of the innermost open element of these tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=0)

    def close(self, tags, scope=()) -> None:
        """Close the innermost of these tags, unless one of ``scope`` stands within."""
        depth = self.deepest(tags)
        if depth > self.deepest(scope):
            self.pop_to(depth)


def parse(page: str) -> Node:
    """The element tree of a page; children are nodes and decoded strings. End tags may be missing."""
    root = Node("#root")
    open_ = Open(root)
    stack = open_.stack
    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].kids.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].kids.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or page[at - 1] != ">":  # comment, doctype, or a tag cut off by the end of the page
            continue
        if m[1]:
            open_.close((tag,))
            continue
        if tag in CLOSES_P:
            open_.close(("p",), P_SCOPE)
        if tag in CLOSED_BY:
            open_.close(CLOSED_BY[tag], SCOPE.get(tag, ()))
            if tag in ("tr", "tbody"):
                open_.close(CLOSED_BY[tag], SCOPE[tag])
        node = Node(tag, m[3] or "")
        stack[-1].kids.append(node)
        if tag in VOID or node.attrs.endswith("/") and tag not in INLINE | PROSE | CLOSES_P:
            seal(node)
        elif tag in RAW:
            close_at = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            node.kids.append(page[at : close_at.start() if close_at else end])
            at = close_at.end() if close_at else end
            seal(node)
        else:
            open_.push(node)
    open_.pop_to(0)
    return root


def seal(node: Node) -> None:
    """The hash of a complete subtree: its tag, attributes, texts and the hashes of its elements."""
    parts = [node.tag, " ".join(node.attrs.split())]
    parts += [" ".join(k.split()) if isinstance(k, str) else f"<{k.hash}>" for k in node.kids]
    node.hash = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def is_boilerplate(node: Node, inside: bool) -> bool:
    """By tag, role, class and id; ``inside``: within an article or main element."""
    if node.tag in NEVER or node.tag == "header" and not inside:
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main") or "=" not in node.attrs and "hidden" not in node.attrs:
        return False
    for m in _ATTR.finditer(node.attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" and not m.group(0).startswith("aria"):
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name in ("class", "id") and not node.holds and not (inside and node.tag in PROSE):
            words = {w.lower() for w in _SPLIT.split(value) if w}
            if words & (INSIDE_WORDS if inside else WORDS) or not inside and "header" in words:
                return True
    return False


def content_roots(root: Node) -> list[Node]:
    """The outermost articles outside boilerplate; else the outermost main elements; else everything."""
    for wanted in CONTENT:
        found, todo = [], [(root, False)]
        while todo:
            node, inside = todo.pop()
            if node.tag == wanted:
                found.append(node)
                continue
            if node is not root and is_boilerplate(node, inside):
                continue
            inner = inside or node.tag in CONTENT
            todo += [(k, inner) for k in reversed(node.kids) if isinstance(k, Node)]
        if found:
            return found
    return [root]


def blocks(roots: list[Node], templates: frozenset[int] | set[int] = frozenset()) -> list[str]:
    """Texts of the blocks in page order, white space made one space, empty ones left out."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append(text)
            run.clear()

    for root in roots:
        inside = root.tag in CONTENT
        todo: list = [root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                run.append(x)
            elif x is None:
                flush()
            elif x.tag == "br":
                run.append(" ")
            elif x is not root and (is_boilerplate(x, inside) or x.tag not in INLINE and (x.hash ^ _INSIDE if inside else x.hash) in templates):
                if x.tag not in INLINE:
                    flush()
            else:
                if x.tag not in INLINE:
                    flush()
                    todo.append(None)
                todo += reversed(x.kids)
        flush()
    return out


def extract(page: str | None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    return " ".join(blocks(content_roots(parse(page)), templates)) if page else ""


def subtree_hashes(root: Node) -> set[tuple[int, bool]]:
    """(hash, inside) of the block elements that could be template: not whole pages and contents."""
    out, todo = set(), [(root, False)]
    while todo:
        node, inside = todo.pop()
        inner = inside or node.tag in CONTENT
        for k in node.kids:
            if isinstance(k, Node):
                if k.tag not in INLINE and k.tag not in ("html", "head", "body", "article", "main") and k.tag not in VOID:
                    out.add((k.hash ^ _INSIDE if inner else k.hash, inner))
                todo.append((k, inner))
    return out


def host_of(url: str | None) -> str | None:
    m = _HOST.match(url or "")
    return m[1].lower() if m else None


def templates(pages: DataFrame) -> DataFrame:
    """host, hash of the subtrees that recur on their share of the host's pages."""

    def work(batches):
        for b in batches:
            rows = []
            for url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                host = host_of(url)
                if host is None or not page:
                    continue
                root = parse(page)
                content = xxhash.xxh3_64_intdigest(" ".join(blocks(content_roots(root))).encode("utf-8", "surrogatepass")) - (1 << 63)
                rows.append((host, 0, None, content))  # the page itself
                rows += [(host, h, inside, content) for h, inside in subtree_hashes(root)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["host", "hash", "inside", "content"])

    found = pages.select("url", "html").mapInArrow(work, "host string, hash long, inside boolean, content long")
    counts = materialize(found.groupBy("host", "hash", "inside", "content").agg(F.lit(1).alias("one")).groupBy("host", "hash", "inside").agg(F.count("*").alias("pages")), "subtrees")
    hosts = counts.where("inside IS NULL").select("host", F.col("pages").alias("all"))
    least = F.when(F.col("inside"), F.greatest(F.lit(INSIDE_LEAST), F.ceil(F.col("all") * INSIDE_SHARE))).otherwise(F.greatest(F.lit(LEAST), F.ceil(F.col("all") * SHARE)))
    return counts.where("inside IS NOT NULL").join(hosts, "host").where(F.col("pages") >= least).select("host", "hash")


def main_text(pages: DataFrame, broadcast_limit: int = BROADCAST_TEMPLATES) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    spark = pages.sparkSession
    small_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    found = materialize(templates(pages), "templates")
    out = "page_id long, url string, text string, n_chars long"

    def texts(b, sets):
        made = [extract(p, s) for p, s in zip(b.column(2).to_pylist(), sets, strict=True)]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], ["page_id", "url", "text", "n_chars"])

    if found.count() <= broadcast_limit:
        by_host: dict[str, set[int]] = {}
        for r in found.toLocalIterator():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        held = spark.sparkContext.broadcast(by_host)

        def near(batches):
            for b in batches:
                yield texts(b, [held.value.get(host_of(u), frozenset()) for u in b.column(1).to_pylist()])

        return pages.mapInArrow(near, out)
    tag = F.xxhash64("page_id", "url", "html")

    def pairs(batches):
        for b in batches:
            rows = []
            for t, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                host = host_of(url)
                rows += [(t, host, h) for h, _ in (subtree_hashes(parse(page)) if page and host else ())]
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True)], ["tag", "host", "hash"])

    own = pages.select(tag.alias("tag"), "url", "html").mapInArrow(pairs, "tag long, host string, hash long")
    hits = own.join(found, ["host", "hash"]).groupBy(F.col("tag").alias("htag")).agg(F.collect_set("hash").alias("hashes"))  # of one page

    def joined(batches):
        for b in batches:
            yield texts(b, [frozenset(h or ()) for h in b.column(3).to_pylist()])

    tagged = pages.withColumn("tag", tag)
    return tagged.join(hits, tagged["tag"] == hits["htag"], "left").select("page_id", "url", "html", "hashes").mapInArrow(joined, out)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
