"""HTML extraction by wrapper induction over the pages of a host.

Each host has a reference page. Every page's tree is aligned with its host's
reference by simple tree matching (children in order, equal tags and names,
most matched nodes), and grouped sums over the host's different pages tell of
each node of the reference how often its text came out the same and how much
varying text, links left out, pages have in its place. Near copies of the
reference say nothing, near copies of another page count once.

Nodes that stay constant are the template. The main slot is found from the
top: as long as one child holds most of the varying text and no heading or
paragraph that varies stands beside it, the slot is in that child. So menus
(links), adverts, headers and footers outside it go whatever they are called.
What is aligned with the main slot is a page's article; template nodes inside
it go. Where a host has too few pages for that, or a page nothing in the slot's
place, the page's own article or main element is taken. Within the article,
elements whose whole name says that they are no part of it go (comments,
adverts, forms): alignment can't tell a reader's comment from a paragraph.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import checked_broadcast, drop_tables, mix, shingles, spread_join, stage, table


@dataclass(frozen=True)
class ExtractionParameters:
    """constant: share of a host's different pages (near copies of the reference left out) in which a template node has the reference's text; least_pages: pages needed for that.

    A page is a near copy if copy of the reference's text is in equal nodes, or near_copy of what isn't is in equal word pairs of aligned nodes.
    """

    constant: float = 0.8
    least_pages: int = 4
    copy: float = 0.9
    near_copy: float = 0.5
    #: Matching of two child lists takes the product of their lengths; longer lists are matched in order within this band.
    band: int = 64
    #: Share of a slot's varying text that its child must hold to be the slot in its place.
    most: float = 0.5
    #: Host references, and their bytes, held in one broadcast; more are joined by shuffle, those of the largest hosts apart.
    broadcast_hosts: int = 2_000
    broadcast_bytes: int = 64 << 20


# Elements without content, raw-text elements, elements that end a block, elements that are no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg")
BLOCK = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROPPED = frozenset("head script style noscript template iframe svg nav header footer aside form button select option textarea input menu title canvas audio video".split())
#: Elements that hold running text; a varying one of them beside the fullest child means that both are content.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
# A class or role counts only if all its parts by hyphens and underscores are of these two kinds, and one is of the first; an id only if it is of the third.
BOILERPLATE = frozenset("ad ads advert adverts advertisement sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar header masthead footer contentinfo complementary cookie consent notice newsletter subscribe popup modal comment comments replies disqus share sharing social related recommended login search".split())
FILLER = re.compile(r"site|page|main|global|top|bottom|left|right|primary|secondary|inner|outer|container|wrap|wrapper|box|block|bar|area|list|items?|links?|buttons?|widget|panel|section|content|form|slot|unit|posts?|articles?|stories|\d+", re.I)
#: An article's section may have any word as its id, from its heading; these are hardly one.
BOILERPLATE_IDS = frozenset("ads advert adverts navbar breadcrumb breadcrumbs sidebar masthead newsletter comments disqus".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Their names decide nothing: a heading's id is made from its words.
NAMELESS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<[/a-zA-Z][^<>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: Rounds of grouping near copies, by so many sketches each: pages with half of their text in common stay apart, near copies meet in one round or another.
ROUNDS, KEY = 4, 6
_SKETCH = mix(np.arange(1, KEY * ROUNDS + 1, dtype=np.uint64)) | np.uint64(1)


@dataclass(slots=True)
class Node:
    """An element (tag) or a text (tag "#")."""

    tag: str
    mark: str = ""
    text: str = ""
    #: Classes and roles, and an id that names boilerplate.
    names: str = ""
    children: list = field(default_factory=list)
    number: int = -1


@lru_cache(maxsize=20_000)
def _marks(attributes: str) -> tuple[str, str]:
    """Classes, ids and roles of a tag; and those of them whose names may tell boilerplate."""
    marks = [(kind.lower(), one or two or bare) for kind, one, two, bare in _ATTRIBUTE.findall(attributes)]
    return " ".join(v for _, v in marks), " ".join(v for kind, v in marks if kind != "id" or v.lower() in BOILERPLATE_IDS)


def parse(source: str) -> Node:
    """A forgiving tree: unknown end tags are skipped, paragraphs end at the next block, what is open at the end is closed."""
    root = Node("html")
    stack = [root]
    at = 0
    while at < len(source):
        m = _TOKEN.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if text:
            stack[-1].children.append(Node("#", text=text))
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    del stack[k:]
                    break
                if name not in BLOCK and stack[k].tag in BLOCK and stack[k].tag != "p":
                    break  # a stray inline end tag closes no block
            continue
        if name == "html":
            continue
        if name in BLOCK:
            # a block ends an open paragraph and what is open in it
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in _CLOSES.get(name, ()):
                del stack[k:]
                break
            if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                break
        node = Node(name)
        if m.group(3):
            node.mark, node.names = _marks(m.group(3))
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            inner = source[at : end.start() if end else len(source)]
            if name == "title" and inner:
                node.children.append(Node("#", text=inner))
            at = end.end() if end else len(source)
        elif name not in VOID and not m.group(3).rstrip().endswith("/"):
            stack.append(node)
        if len(stack) > 400:  # deeper nesting is flattened
            del stack[400:]
    number = 0
    todo = [root]
    while todo:
        node = todo.pop()
        node.number = number
        number += 1
        todo.extend(reversed(node.children))
    return root


def align(a: Node, b: Node, band: int, out: dict[int, Node]) -> None:
    """Simple tree matching of two trees with equal roots; out: number of a node of b -> node of a."""
    memo: dict[tuple[int, int], int] = {}
    _score(a, b, band, memo)
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        out[y.number] = x
        todo.extend(_matched(x, y, band, memo))


def _grid(x: Node, y: Node, band: int, memo: dict, depth: int = -1) -> list[list[int]]:
    n, m = len(x.children), len(y.children)
    width = band + abs(n - m)
    grid = [[0] * (m + 1)]
    for i, c in enumerate(x.children):
        row, above = [0] * (m + 1), grid[-1]
        low, high = max(0, i - width), min(m, i + width + 1)
        for j in range(m):
            best = above[j + 1] if above[j + 1] > row[j] else row[j]
            if low <= j < high:
                d = y.children[j]
                if c.tag == d.tag and c.mark == d.mark:
                    s = above[j] + (2 if c.tag == "#" and c.text == d.text else 1 if c.tag == "#" else _score(c, d, band, memo, depth - 1))
                    if s > best:
                        best = s
            row[j + 1] = best
        grid.append(row)
    return grid


def _score(x: Node, y: Node, band: int, memo: dict, depth: int = -1) -> int:
    """Matched nodes of two trees with equal roots, equal texts counted twice; depth 0: the roots alone."""
    key = (x.number, y.number)
    known = memo.get(key)
    if known is None:
        known = memo[key] = 1 + (_grid(x, y, band, memo, depth)[-1][-1] if x.children and y.children and depth else 0)
    return known


def _matched(x: Node, y: Node, band: int, memo: dict, depth: int = -1) -> list[tuple[Node, Node]]:
    if not x.children or not y.children:
        return []
    grid, out = _grid(x, y, band, memo, depth), []
    i, j = len(x.children), len(y.children)
    while i and j:
        if grid[i][j] == grid[i - 1][j]:
            i -= 1
        elif grid[i][j] == grid[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((x.children[i], y.children[j]))
    return out


def _texts(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag == "#":
            out.append(node)
        todo.extend(reversed(node.children))
    return out


def _pairs(text: str) -> list[tuple[str, str]]:
    words = text.split()
    return list(zip(words, words[1:], strict=False)) if len(words) > 1 else [(text.strip(), "")]


@lru_cache(maxsize=20_000)
def _counted(text: str) -> tuple[Counter, int]:
    """Word pairs of a reference's text, and their characters."""
    pairs = _pairs(text)
    return Counter(pairs), sum(len(a) + len(b) for a, b in pairs)


def _shared(known: Counter, text: str) -> int:
    """Characters of the word pairs that a text shares."""
    return sum(min(n, known[x]) * (len(x[0]) + len(x[1])) for x, n in Counter(_pairs(text)).items() if x in known)


def _masses(page: Node, matched: dict[int, Node], constant: set[int]) -> list[tuple[int, int]]:
    """(number of an element of the reference, characters of varying text, links left out, that the page has in its place)."""
    mass: dict[int, int] = {}
    todo = [(page, False)]
    while todo:
        node, leave = todo.pop()
        if leave:
            mass[id(node)] = sum(mass.get(id(c), 0) for c in node.children)
        elif node.tag == "#":
            mass[id(node)] = 0 if id(node) in constant else len(node.text.strip())
        elif node.tag not in ("a", "head") and node.tag not in RAW:
            todo.append((node, True))
            todo.extend((c, False) for c in node.children)
    return [(k, m) for k, x in matched.items() if x.tag != "#" and (m := mass.get(id(x), 0))]


def main_slot(reference: Node, mass: dict[int, int], p: ExtractionParameters) -> list[int]:
    """Child numbers on the way from the reference's root to its main slot, by the sums of _masses; [] if nothing varies."""
    node, way = reference, []
    while True:
        kids = [(i, c) for i, c in enumerate(node.children) if c.tag != "#"]
        if not kids:
            return way
        at, best = max(kids, key=lambda e: mass.get(e[1].number, 0))
        whole = mass.get(node.number, 0) if node is not reference else sum(mass.get(c.number, 0) for _, c in kids)
        if not whole or mass.get(best.number, 0) <= p.most * whole or best.tag in PROSE:
            return way
        if any(c is not best and c.tag in PROSE and mass.get(c.number, 0) for _, c in kids):
            return way
        node = best
        way.append(at)


def in_slot(page: Node, reference: Node, way: list[int], p: ExtractionParameters) -> Node | None:
    """What a page has in the place of the slot: matched level by level, by the shape of two levels where several children could be meant."""
    for at in way:
        slot = reference.children[at]
        same = [c for c in page.children if c.tag == slot.tag and c.mark == slot.mark]
        if len(same) > 1:
            pairs = _matched(page, reference, p.band, {}, 2)
            same = [x for x, y in pairs if y is slot]
        if not same:
            return None
        page, reference = same[0], slot
    return page


def witness(page: Node, reference: Node, p: ExtractionParameters) -> tuple[list[tuple[int, bool]], list[int], list[tuple[int, int]]] | None:
    """(number of a text node of the reference, whether the page has the same text there), sketches of the rest of the page, which near copies share, and the varying text in the place of each element; None if the page nearly copies the reference."""
    matched: dict[int, Node] = {}
    align(page, reference, p.band, matched)
    own = [y for y in _texts(reference) if y.text.strip()]
    found = [(y.number, matched[y.number].text == y.text) for y in own if y.number in matched]
    same = {k for k, equal in found if equal}
    if sum(len(y.text) for y in own if y.number in same) >= p.copy * sum(len(y.text) for y in own):
        return None
    varying = [(matched.get(y.number), *_counted(y.text)) for y in own if y.number not in same]
    enough = p.near_copy * sum(n for _, _, n in varying)
    # a text shares at most twice its characters
    if sum(min(n, 2 * len(x.text)) for x, _, n in varying if x) >= enough and sum(_shared(c, x.text) for x, c, _ in varying if x) >= enough:
        return None
    known = {id(matched[k]) for k in same}
    words = " ".join(x.text for x in _texts(page) if id(x) not in known).split() or [""]
    sums = shingles(np.array([zlib.crc32(x.encode("utf-8", "replace")) for x in words], np.uint64), min(4, len(words)))
    return found, ((sums[:, None] * _SKETCH).min(axis=0) >> np.uint64(1)).tolist(), _masses(page, matched, known)


def outcomes(page: Node, reference: Node, p: ExtractionParameters) -> list[tuple[int, bool]]:
    """The outcomes of witness(); none if the page nearly copies the reference."""
    found = witness(page, reference, p)
    return found[0] if found else []


@lru_cache(maxsize=20_000)
def _names_boilerplate(names: str) -> bool:
    for name in names.lower().split():
        parts = [x for x in re.split("[_-]+", name) if x]
        kinds = [x in BOILERPLATE for x in parts]
        if any(kinds) and all(k or FILLER.fullmatch(x) for k, x in zip(kinds, parts, strict=True)):
            return True
    return False


def _boiler(node: Node) -> bool:
    return node.tag in DROPPED or bool(node.names) and node.tag not in NAMELESS and _names_boilerplate(node.names)


def _headings(node: Node) -> list[Node]:
    """The headings of an article's own header, in order."""
    found, todo = [], list(reversed(node.children))
    while todo:
        x = todo.pop()
        if x.tag in HEADINGS:
            found.append(x)
        elif x.tag != "#" and (x.tag == "hgroup" or not _boiler(x)):
            todo.extend(reversed(x.children))
    return found


def marked_articles(page: Node) -> list[Node]:
    """The page's own article elements, else its main element, else the page."""
    todo, found = [page], []
    while todo:
        node = todo.pop()
        if _boiler(node):
            continue
        if node.tag in ("article", "main"):
            found.append(node)
            if node.tag == "article":
                continue
        todo.extend(reversed(node.children))
    return [x for x in found if x.tag == "article"] or [x for x in found if x.tag == "main"][:1] or [page]


def extract(page: Node, template: set[int], slot: Node | None = None) -> str:
    """Blocks of the article; template: id() of text nodes of the page that belong to the host's template; slot: what the page has in the main slot, if that is known."""
    article = [slot] if slot is not None else marked_articles(page)
    blocks: list[str] = []
    for root in article:
        current: list[str] = []

        def flush(current=current) -> None:
            text = _SPACE.sub(" ", "".join(current)).strip()
            if text:
                blocks.append(text)
            current.clear()

        # (node, False): enter; (node, True): the end of a block
        steps = [(root, False)]
        while steps:
            node, leave = steps.pop()
            if leave:
                flush()
                continue
            if node.tag == "#":
                if id(node) not in template:
                    current.append(entities.unescape(node.text))
                continue
            if node is not root and _boiler(node):
                if node.tag in BLOCK:
                    flush()
                if node.tag == "header" and root.tag not in ("html", "body"):
                    steps.extend((h, False) for h in reversed(_headings(node)))
                continue
            if node.tag == "br":
                current.append(" ")
            if node.tag in BLOCK:
                flush()
                steps.append((node, True))
            steps.extend((c, False) for c in reversed(node.children))
        flush()
    return "\n\n".join(blocks)


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


class _References:
    """Parsed references of the hosts seen last."""

    def __init__(self, limit: int = 500):
        self.held: dict[str, Node] = {}
        self.limit = limit

    def get(self, source: str) -> Node:
        node = self.held.get(source)
        if node is None:
            if len(self.held) >= self.limit:
                self.held.clear()
            node = self.held[source] = parse(source)
        return node


def extract_pages(pages: DataFrame, p: ExtractionParameters | None = None) -> DataFrame:
    """page_id, url, text, n_chars, by_slot (whether the host's main slot decided) of every row of pages(page_id, url, html).

    Null or empty html: empty text. Pages of one host share a template;
    unknown hosts (null or odd urls) count as one host. A host of few pages has
    no template; the page's own article or main element, names and classes decide. Repeated rows give repeated
    results. An empty table gives no rows; other columns are ignored. Nothing
    is cut off: pages come out whole, however long.
    """
    p = p or ExtractionParameters()
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    # one reference a host: a whole page, by a hash of its id; a partial minimum for each task
    whole = F.when(F.lower("html").contains("</html>"), 0).otherwise(1)
    chosen = rows.where("html <> ''").groupBy("host").agg(F.min(F.struct(whole.alias("part"), F.xxhash64("page_id").alias("order"), "page_id")).alias("x")).select("host", F.col("x.page_id").alias("page_id"))
    references = rows.where("html <> ''").join(checked_broadcast(chosen), ["host", "page_id"]).groupBy("host").agg(F.min("html").alias("reference"))
    references = stage(references, "references")
    small = references.agg(F.sum(F.octet_length("reference")).alias("bytes")).first().bytes or 0
    limit = p.broadcast_hosts if small <= p.broadcast_bytes else 0
    counts = _counts(spread_join(rows.where("html <> ''"), references, "host", "inner", limit, hot_keys=500), p)
    enough = counts.where(F.col("pages") >= p.least_pages)
    nodes = F.collect_list(F.when((F.col("same") >= p.constant * F.col("pages")), F.col("node"))).alias("nodes")
    masses = F.map_from_entries(F.collect_list(F.when(F.col("mass") > 0, F.struct("node", "mass")))).alias("mass")
    wrappers = stage(references.join(enough.groupBy("host").agg(nodes, masses), "host", "left"), "wrappers")
    return _extracted(spread_join(rows, wrappers, "host", "left", limit, hot_keys=500), p)


def _counts(rows: DataFrame, p: ExtractionParameters) -> DataFrame:
    """host, node, pages, same, mass: different pages of the host, those with the reference's text in the node, and characters of varying text in its place."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        known = _References()
        for batch in batches:
            hosts, nodes, sketches, masses = [], [], [], []
            for host, source, reference in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = witness(parse(source), known.get(reference), p)
                if found:
                    hosts.append(host)
                    nodes.append([k for k, same in found[0] if same])
                    sketches.append(found[1])
                    masses.append([{"node": k, "mass": m} for k, m in found[2]])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64())), pa.array(masses, pa.list_(pa.struct([("node", pa.int32()), ("mass", pa.int64())])))], names=["host", "nodes", "sketch", "masses"])

    pages = rows.select("host", "html", "reference").mapInArrow(run, "host string, nodes array<int>, sketch array<long>, masses array<struct<node:int,mass:long>>")
    # near copies differ in some sketches; one of each group is left after the rounds
    for k in range(ROUNDS):
        pages = pages.groupBy("host", F.slice("sketch", KEY * k + 1, KEY).alias("key")).agg(F.min(F.struct("sketch", "nodes", "masses")).alias("x")).select("host", "x.sketch", "x.nodes", "x.masses")
    pages = stage(pages.select("host", "nodes", "masses"), "witnesses")
    same = pages.select("host", F.explode("nodes").alias("node"), F.lit(1).alias("same"), F.lit(0).cast("long").alias("mass"))
    held = pages.select("host", F.explode("masses").alias("x")).select("host", "x.node", F.lit(0).alias("same"), "x.mass")
    sums = same.unionByName(held).groupBy("host", "node").agg(F.sum("same").alias("same"), F.sum("mass").alias("mass"))
    return sums.join(pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages")), "host")


def _extracted(rows: DataFrame, p: ExtractionParameters) -> DataFrame:
    kind = dict(rows.dtypes)["page_id"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_tables()
        known = _References()
        ways: dict[str, list[int]] = {}
        for batch in batches:
            texts, decided = [], []
            for source, host, reference, nodes, mass in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                page = parse(source)
                template: set[int] = set()
                slot = None
                if mass:
                    ref = known.get(reference)
                    if host not in ways:
                        ways[host] = main_slot(ref, dict(mass), p)
                    if ways[host]:
                        slot = in_slot(page, ref, ways[host], p)
                if nodes:
                    ref = known.get(reference)
                    matched: dict[int, Node] = {}
                    align(page, ref, p.band, matched)
                    same = {y.number: y.text for y in _texts(ref)}
                    template = {id(matched[k]) for k in nodes if k in matched and matched[k].text == same.get(k)}
                decided.append(slot is not None)
                texts.append(extract(page, template, slot))
            out = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out, pa.array(np.array([len(t) for t in texts], np.int64)), pa.array(decided, pa.bool_())], names=["page_id", "url", "text", "n_chars", "by_slot"])

    return rows.select("page_id", "url", "html", "host", "reference", "nodes", "mass").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, by_slot boolean")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html": op9_html}
SQL: dict[str, str] = {}
