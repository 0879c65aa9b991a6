"""Operator 12: main text of pages by consensus paths of their host.

Every page is read into its containers (``div``, ``article``, table cells and
the like).  A container's score is the share of the page's plain text that it
holds, squared, times the share of plain text in all that it holds, with a
bonus for elements that mark an article and for every level of depth.  Each
page votes for the generalised tag-class path of its best container; Spark adds
the votes up per host.  Paths with at least two votes and two hundredths of
their host's votes win (fifty at most, by that share), and every page is read
again with the winning path that it holds and that has most votes.  A page
without one keeps its own container.

What never counts as text: comments, scripts, styles and other raw elements,
forms, menus, footers, asides, headers (but for one inside an article that has
a heading), hidden elements, and elements whose class, id or role names such a
part (advert, sidebar, notice, comments and so on), unless they hold most of
the page.  Character references are decoded; white space inside a block becomes
one space; blocks are joined by one space.

An absent page has an empty text, so has a page without text.  An absent or
odd url makes up a host of its own name.  Equal rows give equal results; ties
of votes go to the earlier path in code point order, ties of containers to the
deeper and then the first one.  Elements deeper than ``MOST_DEPTH`` belong to
the container at that depth; the time is linear in the length of a page.  Input
columns that have the name of an added column are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmark.operators.skew import grid_join
from hearthmark.session import checkpointed

#: A path needs so many votes of its host, and so many hundredths of them.
LEAST_VOTES, LEAST_SHARE = 2, 2
MOST_DEPTH = 64
#: Winning paths are sent to all executors up to this size, and joined by host beyond it.
BROADCAST_BYTES = 8 << 20

# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video title textarea xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("article body center div main section td".split())
LEFT_OUT = frozenset("nav footer aside form head button select dialog menu search datalist fieldset label option".split())
HEADINGS = frozenset("h1 h2 h3".split())
ENDED_BY = {
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("tr", "tbody", "thead"), "tfoot": ("tr", "tbody", "thead"),
}
SCOPES = frozenset("table ul ol dl td th div article section main aside nav header footer form blockquote figure".split())
# Words of a class, id or role that name a part beside the article.
BESIDE = frozenset(
    "ad adbox ads adsense adslot adunit adv advert adverts advertisement advertising banner billboard breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright "
    "disclaimer disqus discussion dropdown footer gdpr login masthead menu menubar modal nav navbar navigation navigations newsletter notice notices notification "
    "outbrain pager pagination paywall popup promo promos promoted promotion recommendations recommended related replies reply respond search searchbar share "
    "sharing sidebar sidebars sidenav signup skip skyscraper social sponsor sponsored subnav subscribe subscription taboola teaser teasers toc toolbar tooltip topnav widget widgets".split()
)
BESIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
PARTS = frozenset("article entry post story".split())
REMARKS = frozenset("comment comments related replies reply teaser teasers".split())
ARTICLE_WORDS = frozenset("article articlebody body content entry main post story text".split())

_TAG = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_DIGITS = re.compile(r"\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    """An element that can hold text of its own: container or part beside the article."""

    __slots__ = ("beside", "children", "depth", "good", "has_article", "header", "heading", "in_article", "label", "link", "own", "parent", "path", "sure", "tag", "total", "words")

    def __init__(self, tag: str, label: str, parent: Node | None, words: frozenset[str], sure: bool, beside: bool, header: bool) -> None:
        self.tag, self.label, self.parent, self.words, self.sure, self.beside, self.header = tag, label, parent, words, sure, beside, header
        self.depth = parent.depth + 1 if parent else 0
        self.path = "" if parent is None else f"{parent.path}>{label}" if parent.path else label
        self.children: list[Node] = []
        self.own = self.link = self.good = self.total = 0
        self.heading = self.in_article = False
        self.has_article = tag in ("article", "main") or "articlebody" in words


class Page:
    """Containers of a page and its blocks of text in page order."""

    def __init__(self, source: str) -> None:
        self.root = Node("body", "", None, frozenset(), False, False, False)
        self.nodes = [self.root]
        self.blocks: list[tuple[Node, str]] = []
        self._text: list[str] = []
        self._link_chars = 0
        self._read(source)
        self._weigh()

    # ---- reading ------------------------------------------------------------------

    def _flush(self, node: Node) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((node, text))
                node.own += len(text)
                node.link += min(self._link_chars, len(text))
            self._text.clear()
        self._link_chars = 0

    def _read(self, source: str) -> None:
        stack: list[tuple[str, Node]] = []  # open elements and the node that their text belongs to
        still: dict[str, int] = {}
        node, at, size, links = self.root, 0, len(source), 0

        def pop() -> None:
            nonlocal node, links
            tag, _ = stack.pop()
            still[tag] -= 1
            links -= tag == "a"
            outer = stack[-1][1] if stack else self.root
            if tag in BLOCKS or outer is not node:
                self._flush(node)
            node = outer

        def text(low: int, high: int) -> None:
            if high > low:
                piece = html.unescape(source[low:high])
                self._text.append(piece)
                if links:
                    self._link_chars += len(piece)

        search = at
        while True:
            found = _TAG.search(source, search)
            if found is None:
                text(at, size)
                break
            text(at, found.start())
            if found[2] is None:  # comment, declaration or processing instruction
                comment = found[0] == "<!--"
                end = source.find("-->" if comment else ">", found.end())
                if end < 0:
                    break
                at = search = end + (3 if comment else 1)
                continue
            at = search = found.end()
            tag = found[2].lower()
            if found[1]:
                if tag == "br":
                    self._text.append(" ")
                elif tag == "p" and not still.get("p"):
                    self._flush(node)
                elif still.get(tag):
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                continue
            if tag in VOID:
                if tag == "hr":
                    self._flush(node)
                elif tag == "br":
                    self._text.append(" ")
                continue
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, at)
                if found[3].rstrip().endswith("/") and tag in ("svg", "math"):
                    continue
                if close is None:
                    break
                end = source.find(">", close.end())
                at = search = end + 1 if end >= 0 else size
                continue
            ends = ENDED_BY.get(tag, ("p",) if tag in BLOCKS else ())
            if any(still.get(x) for x in ends):
                depth = len(stack) - 1
                while depth >= 0 and stack[depth][0] not in ends and stack[depth][0] not in SCOPES:
                    depth -= 1
                if depth >= 0 and stack[depth][0] in ends:
                    while len(stack) > depth:
                        pop()
            if tag in ("html", "body"):
                self._flush(node)
                continue
            if tag in BLOCKS:
                self._flush(node)
            child = self._child(tag, found[3], node)
            if child is not node:
                self._flush(node)
            if tag in HEADINGS:
                child.heading = True
            stack.append((tag, child))
            still[tag] = still.get(tag, 0) + 1
            links += tag == "a"
            node = child
        self._flush(node)

    def _child(self, tag: str, attributes: str, node: Node) -> Node:
        """The node of a new element: one of its own, or that of its parent."""
        named: dict[str, str] = {}
        if attributes:
            for name, a, b, c in _ATTRIBUTE.findall(attributes):
                named.setdefault(name.lower(), a or b or c)
        sure = tag in LEFT_OUT or "hidden" in named or named.get("aria-hidden") == "true"
        sure = sure or named.get("role", "").lower() in BESIDE_ROLES or bool(_HIDDEN.search(named.get("style", "")))
        names = f"{named.get('class', '')} {named.get('id', '')}" if "class" in named or "id" in named else ""
        words = frozenset(w.lower() for w in _WORD.findall(names)) if names else frozenset()
        if named.get("itemprop", "").lower() == "articlebody" or named.get("role", "").lower() == "main":
            words |= {"articlebody"}
        beside = bool(words & BESIDE)
        header = tag == "header" or "header" in words
        if not (sure or beside or header or tag in CONTAINERS) or node.depth >= MOST_DEPTH:
            return node
        classes = sorted({_DIGITS.sub("#", c) for c in named.get("class", "").split()})
        child = Node(tag, ".".join([tag, *classes]), node, words, sure, beside, header)
        node.children.append(child)
        self.nodes.append(child)
        return child

    # ---- weighing -----------------------------------------------------------------

    def _weigh(self) -> None:
        """Decide what stands beside the article, and sum up the texts of all containers."""
        for node in reversed(self.nodes):  # children come after their parents
            node.total += node.own
            if node.parent:
                node.parent.total += node.total
                node.parent.has_article |= node.has_article
                node.parent.heading |= node.heading
        whole = self.root.total
        for node in self.nodes[1:]:
            node.in_article = node.parent.in_article or _marked(node) or bool(node.words & PARTS)
            # a part that is only named so has to be small and must not hold the article
            named = node.beside and not (node.has_article and not node.words & REMARKS) and 2 * node.total <= whole
            heads = node.header and not (node.heading and node.in_article) and not (node.has_article or 2 * node.total > whole)
            node.sure = node.parent.sure or node.sure or named or heads
        for node in reversed(self.nodes):
            node.good += 0 if node.sure else node.own - node.link
            if node.parent:
                node.parent.good += node.good

    def score(self, node: Node) -> float:
        if node.sure or not node.good:
            return 0.0
        share = node.good / self.root.good
        bonus = 1.5 if _marked(node) else 1.2 if node.words & ARTICLE_WORDS else 1.0
        return share * share * node.good / node.total * bonus * 1.1 ** min(node.depth, 10)

    def best(self, nodes: list[Node]) -> Node:
        return max(nodes, key=lambda n: (self.score(n), n.depth))

    def vote(self) -> str | None:
        """Path of the best container; null for a page without plain text."""
        return self.best(self.nodes).path if self.root.good else None

    def text(self, paths: list[str]) -> str:
        """Text of the container on the first of the paths that the page has, or else of its best one."""
        chosen = None
        for path in paths:
            held = [n for n in self.nodes if n.path == path and n.good]
            if held:
                chosen = self.best(held)
                break
        chosen = chosen or self.best(self.nodes)
        inside = {id(chosen)}
        for node in self.nodes:
            if node.parent is not None and id(node.parent) in inside:
                inside.add(id(node))
        return " ".join(text for node, text in self.blocks if id(node) in inside and not node.sure)


def _marked(node: Node) -> bool:
    return node.tag in ("article", "main") or "articlebody" in node.words


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes = [Page(x.as_py() or "").vote() for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(votes, pa.string())], names=["host", "path"])


def _read_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, winners = batch.column("html"), batch.column("paths")
        texts = [Page(p.as_py() or "").text(w.as_py() or []) for p, w in zip(pages, winners, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])


def hosts(df: DataFrame, url: str, name: str) -> DataFrame:
    """Add the host of every url; what has no host counts by its whole url."""
    whole = F.lower(F.coalesce(F.col(url), F.lit("")))
    host = F.regexp_extract(whole, r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return df.withColumn(name, F.when(host == "", whole).otherwise(host))


def consensus(df: DataFrame, least_votes: int = LEAST_VOTES, least_share: int = LEAST_SHARE) -> DataFrame:
    """Winning paths per host, most votes first, from ``host`` and ``html``."""
    votes = df.select("host", "html").mapInArrow(_voted, "host string, path string").where(F.col("path").isNotNull())
    counted = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    # only paths with enough votes are gathered, so that no host has more than 100 / least_share of them
    counted = checkpointed(counted)
    totals = counted.groupBy("host").agg(F.sum("votes").alias("all"))
    winning = counted.where(F.col("votes") >= least_votes).join(totals, "host").where(F.col("votes") * 100 >= F.col("all") * least_share)
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path")))
    return winning.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def main_text(df: DataFrame, page: str = "html", url: str = "url", text: str = "text", **limits: int) -> DataFrame:
    """Every row with the main text of its page."""
    kept = [c for c in df.columns if c != text]
    rows = hosts(df.select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col(page).alias("html"), F.col(url).alias("url")), "url", "host").drop("url")
    winners = checkpointed(consensus(rows, **limits))
    size = winners.agg(F.sum(F.length("host") + F.aggregate("paths", F.lit(0), lambda n, p: n + F.length(p) + 16))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        # every host is on both sides once at least, hot ones are split on the side of the pages
        every = rows.select("host").distinct().join(winners, "host", "left")
        joined = grid_join(rows.withColumn("page_key", F.xxhash64(F.monotonically_increasing_id())), every, ["host"], "page_key", "host")
    ready = joined.select("row", "html", "paths")
    done = ready.mapInArrow(_read_again, T.StructType([ready.schema["row"], T.StructField("text", T.StringType())]))
    return done.select("row.*", F.col("text").alias(text))


def extracted(df: DataFrame) -> DataFrame:
    """Main text and its length of every page."""
    done = main_text(df.select("page_id", "url", "html"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
