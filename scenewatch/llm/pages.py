"""Main text of web pages by site style trees: what a site repeats is layout, what varies is text.

All pages of a host are merged into one tree, and all pages of all hosts into another. A node is a path of elements (tag with its
class and id, digits made one sign, neighbours alike merged); it knows in which *styles* (sequences of children) it is seen
and which *contents* (texts of blocks, short ones in pieces) it holds. With m pages that have a node,

    presentation = entropy of its styles, to the base m         (one style everywhere: 0)
    content      = 1 - mean entropy of its contents over pages  (the same text on all pages: 0, each on one page: 1)

both 1 for a single page. A block's importance is 0.9 of its content and 0.1 of the presentation of the element that holds
it, the lesser of the two trees: layout is text that its site repeats, or that many sites have at the same place. What tags
and names say (nav, footer, advert, article and so on) scales the importance of a whole branch. Blocks under the limit are cut
from the page; a branch whose blocks all are goes as a whole.

Trees are sums over (node, style or content) that combine in tasks before they shuffle, so a host with a third of all
pages is many rows, not one. No tree is gathered: pages get the importance of their own nodes.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scenewatch.llm.common import cut, need

#: Share of the presentation in a block's importance, and the importance that a block needs.
SHARE, LIMIT = 0.1, 0.5
#: What a branch of layout keeps of its importance, what a branch of the article keeps of the lack of it, and what a list of links keeps.
LAYOUT, ARTICLE, LINKS = 0.2, 0.1, 0.4
#: Nodes, of two numbers each, that are sent to every task; beyond, pages are joined with them.
SENT = 200_000
#: Texts up to so many characters are compared in pieces.
SHORT = 200

TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|$)|[!?/][^>]*(?:>|$))""", re.S)
MARK = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
DIGITS, WORD = re.compile(r"\d+"), re.compile(r"[a-z]+")
PIECE = re.compile(r"[.!?|·•\n]+")
# Fixed values of HTML: elements without content, with raw content, within lines, and those that a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
HOLDERS = frozenset("ul ol dl menu table tbody thead select article section div body".split())
#: Raw content that is no text, so that it parts no block either.
SILENT = frozenset(["script", "style"])
# What names of elements, classes, ids and roles say.
UNSEEN = frozenset("head script style noscript template iframe svg object title noembed noframes audio video canvas".split())
GONE = frozenset("nav footer aside form button select textarea dialog menu".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice popup modal newsletter subscribe "
    "subscription signup signin login search share sharing social related recommended recommendations comment comments commentlist disqus replies pagination pager widget copyright complementary contentinfo toolbar".split()
)
BODY = frozenset("article articlebody".split())


def number(*parts: str | int) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


class Element:
    """An open element; those within lines share the path and place of what holds them."""

    __slots__ = ("tag", "path", "place", "block", "last", "style")

    def __init__(self, tag: str, path: int, place: str, block: bool) -> None:
        self.tag, self.path, self.place, self.block, self.last, self.style = tag, path, place, block, "", 0


class Page:
    """One page as blocks in order: (path, text, share of links, place), place saying what the branch around it is.

    styles counts (path, style) of its elements; paths are numbers that do not depend on the host.
    """

    def __init__(self, source: str, evidence: bool = True) -> None:
        self.blocks: list[tuple[int, str, float, str]] = []
        self.styles: Counter[tuple[int, int]] = Counter()
        self.evidence = evidence
        self.open = [Element("", 0, "", True)]
        self.text: list[str] = []
        self.links = self.in_links = 0
        self.read(source)
        self.drop(0)

    def read(self, source: str) -> None:
        at, raw = 0, ""
        while tag := self.next_tag(source, at, raw):
            self.say(source[at : tag.start()], raw)
            at, raw = tag.end(), ""
            name = (tag["name"] or "").lower()
            if tag["end"]:
                self.end(name)
            elif name:
                self.start(name, tag["more"])
                raw = name if name in RAW else ""
        self.say(source[at:], raw)

    @staticmethod
    def next_tag(source: str, at: int, raw: str) -> re.Match | None:
        return re.compile(rf"<(?P<end>/)(?P<name>{raw})(?P<more>[^>]*)(?:>|$)", re.I).search(source, at) if raw else TAG.search(source, at)

    def say(self, text: str, raw: str) -> None:
        if text and raw not in SILENT:
            text = entities.unescape(text)
            self.text.append(text)
            self.links += len(text) if self.in_links else 0

    def holder(self) -> Element:
        return next(e for e in reversed(self.open) if e.block)

    def flush(self) -> None:
        """Ends the block of text read so far; white space becomes single spaces."""
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                holder = self.holder()
                self.blocks.append((holder.path, text, self.links / len(text), holder.place))
            self.text, self.links = [], 0

    def start(self, name: str, more: str) -> None:
        if name in ("br", "hr"):
            self.text.append(" ")
        if name in CLOSES_P:
            self.close({"p"}, INLINE)
        if name in CLOSED:
            self.close(CLOSED[name], None)
        if name in VOID or name in SILENT:
            return
        marks = {k.lower(): a or b or c for k, a, b, c in MARK.findall(more)} if more else {}
        around = self.open[-1]
        place = self.place(name, marks, around.place)
        self.in_links += name == "a"
        if name in INLINE and place == around.place:
            self.open.append(Element(name, around.path, place, False))
            return
        self.flush()
        holder = self.holder()
        key = DIGITS.sub("0", f"{name}.{marks.get('class', '')}#{marks.get('id', '')}")
        if holder.last != key:
            holder.last, holder.style = key, number(holder.style, key)
        self.open.append(Element(name, number(holder.path, key), place, True))

    def place(self, name: str, marks: dict[str, str], around: str) -> str:
        """What the branch that begins here is: gone, article, main, or as around it."""
        if around == "gone" or name in UNSEEN:
            return "gone"
        if not self.evidence or name in ("html", "body"):
            return around
        said = set(WORD.findall(" ".join(marks.get(k, "") for k in ("class", "id", "role", "itemprop")).lower())) if marks else frozenset()
        if name in GONE or said & NOISE or "hidden" in marks or "display:none" in marks.get("style", "").replace(" ", ""):
            return "gone"
        if around == "" and (name == "header" or "header" in said):
            return "gone"
        if name == "article" or said & BODY:
            return "article"
        return "main" if around == "" and (name == "main" or "main" in said) else around

    def close(self, names: set[str], through: frozenset[str] | None) -> None:
        """Closes the open element of these names if only elements of `through` (None: no holder of lists) lie above it."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in names:
                return self.drop(k)
            if tag not in through if through is not None else tag in HOLDERS:
                return None
        return None

    def end(self, name: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == name:
                if not self.open[k].block and any(e.block for e in self.open[k + 1 :]):  # a line's element that crosses blocks
                    self.in_links -= name == "a"
                    del self.open[k]
                    return
                return self.drop(k)

    def drop(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        if any(e.block for e in self.open[k:]):
            self.flush()
        for e in self.open[k:]:
            self.in_links -= e.tag == "a"
            if e.block:
                self.styles[e.path, e.style] += 1
        del self.open[k:]


def contents(text: str) -> list[str]:
    """What of a block's text is compared with other pages: a short one's pieces, else the whole."""
    return [p for p in map(str.strip, PIECE.split(text)) if p] or [text] if len(text) <= SHORT else [text]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


COUNTS = "path long, node long, kind int, value long, n long, spread double, pages int"


def seen(pages: DataFrame, evidence: bool = True) -> DataFrame:
    """COUNTS of (host, html): each page's styles (kind 0) and contents (kind 1) of its nodes; spread is n log n."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, source in zip(*batch.columns):
                page, at = Page(source.as_py(), evidence), host.as_py()
                rows: Counter[tuple[int, int, int]] = Counter({(path, 0, style): n for (path, style), n in page.styles.items()})
                for path, text, _, _ in page.blocks:
                    for piece in contents(text):
                        rows[path, 1, number(piece)] += 1
                nodes = {path: number(at, path) for path, _, _ in rows}
                path, kind, value = zip(*rows)
                n = np.array(list(rows.values()))
                path = np.array(path)
                once = np.zeros(len(path), np.int32)
                once[np.unique(path, return_index=True)[1]] = 1
                columns = [pa.array(path), pa.array([nodes[p] for p in path.tolist()], pa.int64()), pa.array(kind, pa.int32()), pa.array(value, pa.int64()), pa.array(n), pa.array(n * np.log(n)), pa.array(once)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "node", "kind", "value", "n", "spread", "pages"])

    return pages.select("_host", "_html").mapInArrow(of, COUNTS)


def entropies(each: DataFrame, node: str) -> DataFrame:
    """(node, presentation, content) of sums of COUNTS: entropies to the base of the number of pages that have the node, from 0 to 1."""
    n, own = F.col("n").cast("double"), lambda k, c: F.sum(F.when(F.col("kind") == k, c))
    total = each.groupBy(node).agg(
        F.sum("pages").alias("m"), own(0, n).alias("styles"), own(0, n * F.log(n)).alias("style_logs"), own(1, n).alias("texts"), own(1, n * F.log(n) - F.col("spread")).alias("text_entropy")
    )
    base, one = F.log(F.col("m")), lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    style, text = F.log("styles") - F.col("style_logs") / F.col("styles"), F.col("text_entropy") / F.col("texts")
    alone = F.col("m") <= 1
    return total.select(node, F.when(alone, 1.0).otherwise(one(style / base)).alias("presentation"), F.when(alone | text.isNull(), 1.0).otherwise(1.0 - one(text / base)).alias("content"))


def style_trees(counts: DataFrame) -> DataFrame:
    """(node, importance) of COUNTS: the lesser of what its host's tree and the tree of all hosts say."""
    sums = [F.sum(c).alias(c) for c in ("n", "spread", "pages")]
    own = cut(counts.groupBy("path", "node", "kind", "value").agg(*sums))
    value = SHARE * F.col("presentation") + (1 - SHARE) * F.col("content")
    host = entropies(own, "node").select("node", value.alias("own"))
    every = entropies(own.groupBy("path", "kind", "value").agg(*sums), "path").select("path", value.alias("all"))
    return own.select("path", "node").distinct().join(every, "path").join(host, "node").select("node", F.least("own", "all").alias("importance"))


def importances(page: Page, known: Callable[[int], float | None]) -> list[float]:
    """Of each block: that of its path, scaled by the place of its branch."""
    places = {b[3] for b in page.blocks}
    rooted = "article" in places
    out = []
    for path, _, links, place in page.blocks:
        value = known(path)
        value = 1.0 if value is None else value
        if place == "gone" or place == "" and (rooted or "main" in places):
            value *= LAYOUT
        elif place == "article" or place == "main" and not rooted:
            value = 1 - ARTICLE * (1 - value)
        elif links > 0.8 and page.evidence:
            value *= LINKS
        out.append(value)
    return out


def main_text(page: Page, known: Callable[[int], float | None], limit: float = LIMIT) -> tuple[str, int]:
    """(text of the blocks that stay, number of blocks cut); known gives the importance of a path."""
    stay = [b[1] for b, value in zip(page.blocks, importances(page, known)) if value >= limit]
    return " ".join(stay), len(page.blocks) - len(stay)


def extract(pages: DataFrame, limit: float = LIMIT, sent: int = SENT, evidence: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars, n_cut): the main text of each page, from its whole html.

    White space within a block is one space; blocks are joined by one. A null html or url is empty, and so is the text of a page
    without any; n_chars counts code points, n_cut the blocks removed. One row for each input row, repeated rows and null ids
    too; repeated pages count each in their site's tree. An empty table gives no rows; other columns are ignored. Hosts are the
    parts of urls after `://`, lower-cased; pages without one are a site of their own. Without `evidence` the trees alone decide, and
    names of elements say nothing.
    """
    rows = need(pages, "page_id", "url", "html").select(F.struct("page_id", "url").alias("_page"), host_of(F.col("url").cast("string")).alias("_host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"))
    tree = cut(style_trees(seen(rows, evidence)))
    if tree.count() <= sent:
        table = rows.sparkSession.sparkContext.broadcast({r.node: r.importance for r in tree.toLocalIterator()})
        rows = rows.withColumn("_known", F.lit(None).cast("map<long,double>"))
    else:
        table, rows = None, with_known(rows, tree, evidence)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for host, source, own in zip(*batch.columns[1:]):
                at, known = host.as_py(), table.value if table else dict(own.as_py() or ())
                found.append(main_text(Page(source.as_py(), evidence), lambda path: known.get(number(at, path)), limit))
            texts = pa.array([t for t, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array([len(t) for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], names=["_page", "text", "n_chars", "n_cut"])

    kind = rows.schema["_page"].dataType.simpleString()
    done = rows.select("_page", "_host", "_html", "_known").mapInArrow(of, f"_page {kind}, text string, n_chars long, n_cut long")
    return done.select("_page.*", "text", "n_chars", "n_cut")


def with_known(rows: DataFrame, tree: DataFrame, evidence: bool) -> DataFrame:
    """rows with _known: the importance of each page's own nodes, found by joins on nodes and on the page's digest."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, host, source in zip(*batch.columns):
                nodes = sorted({number(host.as_py(), b[0]) for b in Page(source.as_py(), evidence).blocks})
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(nodes), pa.string()), pa.array(nodes, pa.int64())], names=["_digest", "node"])

    keyed = rows.withColumn("_digest", F.md5(F.concat_ws("\x1f", "_host", "_html")))
    nodes = keyed.select("_digest", "_host", "_html").mapInArrow(of, "_digest string, node long").distinct()
    own = nodes.join(tree, "node").groupBy("_digest").agg(F.map_from_entries(F.collect_list(F.struct("node", "importance"))).alias("_known"))
    return keyed.join(own, "_digest", "left").drop("_digest")
