"""HTML extraction with a site style tree.

The pages of a host are merged into one tree of element paths. A path whose presentation (the
labels of the elements below it) and content (the text below it) hardly differ between the host's
pages is part of the site and not of the article: the entropies of both, over the pages that have the path,
give its importance, which is weighted by the role that its tag, class and id name, since menus and
adverts may differ from page to page. Blocks of low importance are removed from each page, but none
within an article or main part; of the rest, the article (or else the main part, or else the body) is the
text. Pages of a host with the same article count once, so that it doesn't seem to be part of the site.

The tree exists as counts by (host, path): a host with a third of all pages is many partial counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import append_columns, staged

LEAST_PAGES = 8
LEAST_IMPORTANCE = 0.2

# HTML's void elements, raw-text elements, blocks, and what an opening tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
ENDS_P = BLOCKS - frozenset("body caption dd dt html legend option tbody td tfoot th thead title tr".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
P_SCOPE = frozenset("article aside body button caption div fieldset figure footer form header html li main nav object section "
                    "table td th".split())

# Tags that never hold an article's text, and names of classes, ids and roles that say so.
SITE_TAGS = frozenset(
    "annotation annotation-xml aside audio button canvas dialog embed footer form head iframe input map menu nav noscript "
    "object option script select style svg template textarea title video".split()
)
SITE_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments "
    "consent contentinfo complementary cookie cookies copyright disclaimer disqus footer gdpr login masthead menu "
    "modal nav navbar navigation newsletter notice notification notifications overlay pager pagination popup promo "
    "promotion promoted recommended recommendations related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription toolbar".split()
)
HEAD_NAMES = frozenset(["header"])
STATE_NAMES = frozenset("has hide is no not show with without".split())
# How surely an element's own tag, class, id and role make its branch a part of the site.
BY_WORD, BY_NAME, BY_TAG = 1, 2, 3
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element: its label, path number, parent, and children (elements and texts in order)."""

    __slots__ = ("tag", "label", "path", "children", "parent", "mark", "site", "article", "nested", "inside")

    def __init__(self, tag: str, label: str, parent: Node | None, mark: int, article: bool):
        self.tag, self.label, self.parent, self.mark, self.article = tag, label, parent, mark, article
        self.site = mark > 0 or (parent is not None and parent.site)
        self.path = number(f"{parent.path if parent else 0}>{label}")
        self.nested = parent is not None and (parent.nested or parent.tag == "article")
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        self.children: list = []


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def marked(tokens: list[list[str]], names: frozenset[str]) -> int:
    """BY_NAME if a token has only words of ``names``, BY_WORD if it has one and doesn't tell a state ("no-sidebar")."""
    mark = 0
    for words in tokens:
        if words and all(w in names for w in words):
            return BY_NAME
        if words and words[0] not in STATE_NAMES and any(w in names for w in words):
            mark = BY_WORD
    return mark


def spare_article(root: Node) -> None:
    """Clear names that would drop a page's every article and main element, if those hold most of its text."""
    nodes = [root]
    for node in nodes:
        nodes.extend(c for c in node.children if isinstance(c, Node))
    named = [n for n in nodes if n.tag in ("article", "main")]
    if not named or not all(n.site for n in named):
        return

    def spread() -> None:
        for n in nodes:  # parents come before their children
            n.site = n.mark > 0 or (n.parent is not None and n.parent.site)

    def size(some: list[Node]) -> int:
        return sum(len(" ".join(c.split())) for n in some if not n.site for c in n.children if isinstance(c, str))

    outside, held = size(nodes), {}
    for n in named:
        up: Node | None = n
        while up is not None and id(up) not in held:
            held[id(up)] = up, up.mark
            up = up.parent
    for n, mark in held.values():
        n.mark = 0 if mark == BY_WORD or (mark == BY_NAME and n.tag == "article") else mark
    spread()
    if size([n for n in nodes if n.inside]) <= outside:
        for n, mark in held.values():
            n.mark = mark
        spread()


#: The path of every page's root.
ROOT = number("0>html")


class Builder(HTMLParser):
    """A tree from tag soup: void elements, implied ends and stray end tags as browsers take them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", "html", None, 0, False)
        self.open = [self.root]
        self.counts: dict[str, int] = {}

    def _pop_to(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.counts[node.tag] -= 1
        del self.open[depth:]

    def _end_open(self, tags: set | frozenset, scope: set | frozenset) -> None:
        if not any(self.counts.get(t) for t in tags):
            return
        last = None
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.open[depth].tag
            if tag in tags:
                last = depth
            elif tag in scope:
                break
        if last is not None:
            self._pop_to(last)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "body"):
            return
        if tag in ENDS_P:
            self._end_open({"p"}, P_SCOPE)
        if tag in ENDS:
            self._end_open(*ENDS[tag])
        parent = self.open[-1]
        named = {k: v or "" for k, v in attrs if k in ("class", "id", "role", "hidden", "itemprop")}
        tokens = [[w.lower() for w in WORD.findall(t)] for k in ("class", "id", "role") if named.get(k) for t in named[k].split()]
        names = {w for t in tokens for w in t}
        article = parent.article or tag in ("article", "main") or "main" in names or "articleBody" in named.get("itemprop", "")
        mark = BY_TAG if tag in SITE_TAGS or "hidden" in named or (tag == "label" and not article) else 0
        if not mark and tag != "main":
            mark = marked(tokens, SITE_NAMES)
            if mark == BY_WORD and (tag == "article" or parent.inside):
                mark = 0
        if not parent.article and tag not in ("article", "main"):
            mark = max(mark, BY_TAG if tag == "header" else min(marked(tokens, HEAD_NAMES), BY_WORD))
        node = Node(tag, tag + "".join("." + c for c in sorted(named.get("class", "").split())), parent, mark, article)
        parent.children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if not self.counts.get(tag):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self._pop_to(depth)
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = Builder()
    if html:
        builder.feed(html)
        if re.match(r"<[A-Za-z/!?]", builder.rawdata):  # a tag cut off by the end is no text
            builder.rawdata = ""
        builder.close()
        spare_article(builder.root)
    return builder.root


def pruned(node: Node, gone: frozenset[int]) -> bool:
    """Whether the tree removes the node: only blocks, and none of an article or main part."""
    return node.path in gone and not node.article and node.tag in BLOCKS and node.parent is not None


def below(root: Node, gone: frozenset[int] = frozenset()) -> Iterator[Node]:
    """Elements that may hold article text, in page order; not below site or removed branches."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.site or pruned(node, gone):
            continue
        yield node
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))


def blocks(root: Node, gone: frozenset[int]) -> list[str]:
    """Texts of the blocks below ``root``, in page order, white space as one space."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            out.append(text)

    stack: list = [root]
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(item)
        elif item.site or (item is not root and pruned(item, gone)):
            if item.tag in BLOCKS:
                flush()
        else:
            if item.tag in BLOCKS:
                flush()
                stack.append(None)
            elif item.tag == "br":
                held.append(" ")
            stack.extend(reversed(item.children))
    flush()
    return out


def parts(nodes: list[Node]) -> list[Node]:
    """The article elements, or else the main part; none if the page names neither."""
    found = [n for n in nodes if n.tag == "article" and not n.nested]
    return found or [n for n in nodes if n.article and not n.parent.article]


def main_text(html: str | None, gone: frozenset[int] = frozenset()) -> str:
    """The article of the page: article elements, or else the main part, or else the whole body."""
    root = parse(html)
    return " ".join(t for n in parts(list(below(root, gone))) or [root] for t in blocks(n, gone))


def site_nodes(html: str | None) -> tuple[int | None, list[tuple[int, int, int]]]:
    """The article's number, and (path, presentation, content) of the element paths that a role doesn't settle.

    Both are those of the whole branch: the labels of the elements below, and the text below. A page
    that names no article or main part, or an empty one, has no number.
    """
    nodes = list(below(parse(html)))
    article = "|".join(t for n in parts(nodes) for t in blocks(n, frozenset()))
    style, content = {}, {}
    by_path: dict[int, list[tuple[int, int]]] = {}
    for node in reversed(nodes):  # children come before their parents
        own = [c for c in node.children if isinstance(c, str) or not c.site]
        style[id(node)] = number("|".join(f"{c.label}{style[id(c)]}" for c in own if isinstance(c, Node)))
        content[id(node)] = number("|".join(" ".join(c.split()) if isinstance(c, str) else str(content[id(c)]) for c in own))
        by_path.setdefault(node.path, []).append((style[id(node)], content[id(node)]))
    rows = [(p, number(str([s for s, _ in found])), number(str([c for _, c in found]))) for p, found in by_path.items()]
    return number(article) if article else None, rows


def entropy(nodes: DataFrame, column: str) -> DataFrame:
    """(host, path, pages, entropy): how evenly the values of ``column`` are spread, 0 to 1."""
    counts = nodes.groupBy("host", "path", column).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("host", "path").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.log(F.col("n"))).alias("weighted")
    )
    spread = (F.log("pages") - F.col("weighted") / F.col("pages")) / F.log("pages")
    return sums.select("host", "path", "pages", F.when(F.col("pages") > 1, spread).otherwise(1.0).alias(f"{column}_entropy"))


def importance(nodes: DataFrame) -> DataFrame:
    """(host, path, pages, importance) over the distinct pages of each host."""
    both = entropy(nodes, "style").join(entropy(nodes, "content").drop("pages"), ["host", "path"])
    return both.withColumn("importance", 1 - (1 - F.col("style_entropy")) * (1 - F.col("content_entropy")))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html).

    A block's path is removed from a host's pages if at least ``least_pages`` of its distinct pages have it
    and its importance is below ``least_importance``; article and main parts stay whole. Pages of a host
    that name an article or main part of the same text are one page there (that of the least hash). Pages
    without a host in their url, or of smaller sites, are judged by roles alone. A null or empty
    html gives the empty text; equal pages count once in the tree; repeated rows are repeated; an
    empty table gives no rows; other columns aren't read.
    """
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    slim = slim.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("page", F.xxhash64("host", "html"))
    node = T.StructType([T.StructField(n, T.LongType()) for n in ("path", "style", "content")])

    def listed(batch: pa.RecordBatch) -> list:
        found = [site_nodes(h.as_py()) for h in batch.column(2)]
        lists = [[{"path": p, "style": s, "content": c} for p, s, c in rows] for _, rows in found]
        node_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("path", "style", "content")]))
        return [pa.array([a for a, _ in found], pa.int64()), pa.array(lists, node_type)]

    with_host = slim.filter("host <> ''").select("host", "page", "html")
    nodes = append_columns(with_host, [T.StructField("article", T.LongType()), T.StructField("nodes", T.ArrayType(node))], listed, drop=("html",))
    nodes = staged(nodes.select("host", "page", "article", F.explode("nodes").alias("n")).select("host", "page", "article", "n.*").distinct())
    named = nodes.filter(F.col("article").isNotNull() & (F.col("path") == ROOT)).select("host", "page", "article")
    firsts = named.groupBy("host", "article").agg(F.min("page").alias("page")).select("page")
    again = named.select("page").join(firsts, "page", "left_anti")
    low = importance(nodes.join(again, "page", "left_anti")).filter((F.col("pages") >= least_pages) & (F.col("importance") < least_importance))
    gone = nodes.join(low.select("host", "path"), ["host", "path"]).groupBy("page").agg(F.collect_set("path").alias("gone"))

    def text(batch: pa.RecordBatch) -> list:
        out = [main_text(h.as_py(), frozenset(g.as_py() or ())) for h, g in zip(batch.column(2), batch.column(3))]
        return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    joined = slim.join(gone, "page", "left").select("page_id", "url", "html", "gone")
    return append_columns(joined, fields, text, drop=("html", "gone"))
