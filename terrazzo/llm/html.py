"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; none of it is ever shown text of an article.
RAW = frozenset("script style textarea title noscript template iframe svg math object canvas audio video xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
#: Start tags that end an open element of these names, up to the nearest container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead"},
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
STOPS = frozenset("html body article main section div table ul ol dl td th blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A path counts as content from this share of the page's mean ratio; inside the element that holds the content from the
#: second, if it is not mostly links.
SHARE, INNER_SHARE = 0.25, 0.01
#: What a name multiplies the ratios of an element by, unless the element holds more than half of the high-ratio text.
OTHER_WEIGHT = 0.002
#: Elements, roles and names of class or id whose content is seldom part of an article.
OTHER_TAGS = frozenset("nav footer aside form button select dialog menu fieldset datalist".split())
OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
OTHER_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
    notices popup modal overlay newsletter subscribe subscription signup login sidebar aside menu nav navbar navigation breadcrumb breadcrumbs
    footer header masthead topbar toolbar comment comments commentlist discussion disqus respond reply replies share sharing social related
    recommended widget pagination pager search skip""".split()
)
#: Parts that may stand beside those words in one name, as in site-footer, without making it another.
PLAIN_WORDS = frozenset("site page main global top bottom left right primary secondary box bar list wrapper container wrap area section block inner outer links item items form".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，！？]")


class Node:
    """An element. ``path`` is the number of its path of tags from the root: elements of one path share it."""

    __slots__ = ("tag", "path", "parent", "other", "header", "score", "weight", "holder", "link", "article", "aside", "lone")

    def __init__(self, tag: str, path: int, parent: Node | None, other: bool = False, header: bool = False):
        self.tag, self.path, self.parent, self.other, self.header = tag, path, parent, other, header
        self.score, self.weight = 0.0, 1.0
        #: The nearest element here or above that is no inline one.
        self.holder = self if parent is None or tag not in INLINE else parent.holder
        #: How many more inner elements are taken to stand in the link, if any.
        self.link = 3 if tag == "a" else max(0, parent.link - 1) if parent else 0
        self.article = tag in ("article", "main") or parent is not None and parent.article
        self.aside = tag in ("nav", "footer") or parent is not None and parent.aside


@dataclass
class Block:
    node: Node
    parts: list[str]
    text: str = ""
    linked: int = 0


def _named_other(names: str) -> set[str]:
    """The telling words of those names, whole ones, that say what is no part of an article."""
    found: set[str] = set()
    for name in names.split():
        parts = set(re.split(r"[-_]+", name)) - {""}
        if parts & OTHER_WORDS and parts <= OTHER_WORDS | PLAIN_WORDS:
            found |= parts & OTHER_WORDS
    return found


def _is_other(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether an element's own tag, name or attributes speak against it, and whether it is a header."""
    if tag in OTHER_TAGS:
        return True, False
    header = tag == "header"
    if raw.strip(" /"):
        for name, value in ATTRIBUTE.findall(raw):
            name, value = name.lower(), unescape(value.strip("\"'")).lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return True, False
            if name == "role" and value in OTHER_ROLES:
                return True, False
            if name in ("class", "id") and tag not in ("html", "body"):
                words = _named_other(value)
                if tag in ("article", "p", "main"):
                    # A comment may be an article of its own, and a notice a paragraph.
                    words -= {"header", "related", "search"}
                if words == {"header"}:
                    header = True
                elif words:
                    return True, False
    return False, header


def blocks_of(html: str) -> tuple[list[Node], list[Block]]:
    """The elements, each after its parent and the root first, and the blocks of text in page order with the element that
    each stands in. Time and memory grow with the page, however deep its elements are nested."""
    root = Node("", 0, None)
    nodes, stack, blocks, current = [root], [root], [], None
    paths: dict[tuple[int, str], int] = {}
    open_: Counter[str] = Counter()
    at, n = 0, len(html)

    def add(piece: str) -> None:
        nonlocal current
        if current is None:
            if not piece or piece.isspace():
                return
            current = Block(stack[-1].holder, [])
            blocks.append(current)
        current.parts.append(piece)
        if stack[-1].link:
            current.linked += len(piece)

    def close(k: int) -> None:
        open_.subtract(x.tag for x in stack[k:])
        del stack[k:]

    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            add(unescape(html[at:]))
            break
        if m.start() > at:
            add(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, raw = m[1] or m[4], m[3] if m[2] else m[6]
        if tag not in INLINE:
            current = None
        elif tag == "br":
            add(" ")
            continue
        if closing:
            for k in range(len(stack) - 1, 0, -1) if open_[tag] > 0 else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in STOPS and tag not in STOPS:
                    break
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        gone = CLOSES.get(tag, {"p"} if tag in ENDS_P else ())
        if gone and any(open_[x] > 0 for x in gone):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in gone:
                    close(k)
                    if tag not in ("tr", "tbody"):
                        break
                elif stack[k].tag in STOPS:
                    break
        parent = stack[-1]
        other, header = (False, False) if tag in INLINE else _is_other(tag, raw or "")
        if not raw.rstrip().endswith("/") or tag not in ("path", "circle"):
            node = Node(tag, paths.setdefault((parent.path, tag), len(paths) + 1), parent, other, header)
            nodes.append(node)
            stack.append(node)
            open_[tag] += 1
    for b in blocks:
        b.text = " ".join("".join(b.parts).split())
    return nodes, [b for b in blocks if b.text]


def ratios(blocks: list[Block]) -> np.ndarray:
    """The smoothed and fused ratio of each block.

    All blocks of one tag path share the path's mean text length and its mean number of punctuation marks, each
    without linked text. Both series are smoothed over the page's order by a Gaussian and multiplied.
    """
    length, marks, nodes = defaultdict(float), defaultdict(float), defaultdict(int)
    for b in blocks:
        own = max(0, len(b.text) - b.linked)
        length[b.node.path] += own
        marks[b.node.path] += len(PUNCTUATION.findall(b.text)) * own / len(b.text)
        nodes[b.node.path] += 1
    text = np.array([length[b.node.path] / nodes[b.node.path] for b in blocks])
    mark = np.array([marks[b.node.path] / nodes[b.node.path] for b in blocks])
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    kernel /= kernel.sum()
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), kernel, "valid")
    return smooth(text) * (1 + smooth(mark))


def _score(nodes: list[Node], blocks: list[Block], chosen: np.ndarray) -> None:
    """Sum the unlinked text of chosen blocks up the tree."""
    for node in nodes:
        node.score = 0.0
    for b, taken in zip(blocks, chosen, strict=True):
        if taken:
            b.node.score += max(0, len(b.text) - b.linked)
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None:
            node.parent.score += node.score


def _weights(nodes: list[Node], beside: bool) -> None:
    """The weight of each element, from the names at and above it. A name of an element that holds most of the scored text
    doesn't count, but the tags nav and footer do if there is an article beside them with scored text (``beside``)."""
    whole = nodes[0].score
    for node in nodes:
        above = node.parent.weight if node.parent else 1.0
        # Headers hold the article's headings at most.
        counts = (node.other or node.header) and (2 * node.score <= whole or beside and node.tag in ("nav", "footer"))
        node.weight = above * OTHER_WEIGHT if counts else above
        #: Whether names speak against this element alone, and against none above it.
        node.lone = counts and above == 1


def _content(nodes: list[Node]) -> Node:
    """The innermost element, from the root on, that holds most of the scored text of those around it."""
    children, headed = {}, set()
    for node in nodes[1:]:
        children.setdefault(id(node.parent), []).append(node)
        if node.tag in HEADINGS:
            headed.add(id(node.parent))
    node = nodes[0]
    while node.tag not in ("article", "main"):
        best = max(children.get(id(node), ()), key=lambda x: x.score, default=None)
        if best is None or best.tag not in STOPS or best.score < 0.6 * node.score or not best.score:
            break
        if best.tag in ("ul", "ol", "dl", "blockquote", "figure") or best.tag == "div" and id(node) in headed:
            break  # a heading beside the text belongs to it
        node = best
    return node


def extract(html: str) -> str:
    """The main text of a page: its blocks joined by line feeds, empty if there is none.

    Blocks are chosen by their path's fused ratio. Names of elements only weigh the ratios. A heading is chosen with
    the text that it heads, and a block of a low ratio in the element that holds the chosen text unless it is mostly links.
    """
    nodes, blocks = blocks_of(html)
    if not blocks:
        return ""
    fused = ratios(blocks)
    high = fused >= SHARE * fused.mean()
    _score(nodes, blocks, high)
    _weights(nodes, any(b.node.article and not b.node.aside for b, taken in zip(blocks, high, strict=True) if taken))
    weight = np.array([b.node.weight for b in blocks])
    linked, whole = defaultdict(int), defaultdict(int)
    for b in blocks:
        linked[b.node.path] += b.linked
        whole[b.node.path] += len(b.text)
    # Smoothing mustn't lift what is mostly links.
    own = np.array([2 * linked[b.node.path] <= whole[b.node.path] for b in blocks]) | (fused.max() == 0)
    weighed = fused * weight
    free = weight == 1
    chosen = (weighed >= SHARE * weighed.mean()) & (free | (weighed > 0)) & own
    _score(nodes, blocks, chosen)
    content, inside = _content(nodes), set()
    for node in nodes:
        if node is content or id(node.parent) in inside:
            inside.add(id(node))
    least = INNER_SHARE * weighed.mean()
    for k, b in enumerate(blocks):
        if free[k] and weighed[k] >= least and own[k]:
            chosen[k] |= id(b.node) in inside
    follows = False
    for k in range(len(blocks) - 1, -1, -1):
        b = blocks[k]
        if b.node.tag in HEADINGS:
            # Of named elements a header in an article may hold its heading, and a heading's own name says nothing.
            titled = b.node.parent.header and b.node.article
            chosen[k] |= follows and (free[k] or b.node.lone or titled)
        else:
            follows = bool(chosen[k])
    return "\n".join(b.text for b, taken in zip(blocks, chosen, strict=True) if taken)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of pages, from its whole html.

    A null or empty html gives an empty text. Markup may be broken in any way: what is never closed ends with its
    parent or the page. Rows are neither merged nor dropped; other columns are not read.
    """

    @F.arrow_udf("string")
    def of(html: pa.Array) -> pa.Array:
        return pa.array([extract(h or "") for h in html.to_pylist()], pa.string())

    return pages.select("page_id", "url", of(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
