"""Operator 8: main text of HTML pages by tag-path ratios.

A page is read once by a tolerant tokenizer into blocks of text; each has a root-to-leaf
tag path (inline tags don't count, sections are told apart by class).  Which blocks are
content is decided by ratios of paths:

1. For each path, characters, punctuation, characters of links and blocks are aggregated
   over the page.  Two ratios result, characters a block and punctuation a block.
2. Both are smoothed over the paths in order of appearance by a Gaussian whose weights
   fall with the share of the path that two paths don't have in common.
3. They are fused: root of the product, times the share of text that isn't in links, times
   the fourth root of the number of blocks.  Tags and names only weigh: a path below a
   menu, header, footer, sidebar, form or the like counts ``LOW``, below a class or id
   of such a name ``HINT``, below an article or main ``HIGH``.
4. Paths whose fused ratio passes a threshold from mean and spread of the page's
   paths are content; ``FLOOR`` keeps pages without content empty.
5. Headings, lists and short paragraphs of low ratio belong to content that they stand in:
   to an element that directly holds content blocks, or to the smallest container of
   nearly all content, if the part of it that they are in is content for the most part.
   Blocks that are links for the most part or of less weight than their container never do.

A class or id doesn't count for an element that holds a main, or an article or h1 with
most of the page's text: it is a wrapper.  If nothing passes on a page without article and
main, the outermost elements with most of the page's text are wrappers as well.

Edge cases: null and empty html give an empty text; html without any tag is one block
(plain text has the root path, which is content); cut-off tags, scripts and comments
at the end are dropped; unclosed and misnested tags are closed by their parents;
repeated rows get equal results; an empty table gives no rows; extra columns are kept
by ``extract_pages``, but for columns text and n_chars, which its own replace.  Time and
memory for a page are linear in its length, however deep it is: paths are numbers in
a tree of paths, and elements know their nearest block and list or table element.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import col, fresh, map_rows, read, without

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
_RAW = re.compile(r"script|style|noscript|template|textarea|title|svg|math|iframe|object|select|xmp", re.I)
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile(r"[.,;:!?。，…\"'()«»-]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("nav header footer aside form button dialog menu fieldset head".split())
NEVER_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_BAD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumb\w*|header|masthead|footer|foot|sidebar\w*|side|aside|widget\w*|related|recommend\w*|"
    r"share|sharing|social|cookie\w*|consent|notice\w*|popup|modal|overlay|newsletter|subscribe|signup|login|search\w*|comment\w*|disqus|respond|reply|replies|reader-\w+|toolbar|pagination|pager|skip\w*|legal|copyright|hidden)(?=$|[\s_-])",
    re.I,
)
#: Class names that tell of a part elsewhere, such as has-sidebar.
_STATE = re.compile(r"(?<!\S)(?:has|no|with|without)[_-]\S*", re.I)
_P_CLOSERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt tr td th thead tbody figure details center".split())
THRESHOLD = 0.5
#: Elements of lists and tables: what an opening tag closes, up to the nearest of the others.
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NESTED = frozenset("ul ol dl menu table tbody thead tfoot tr td th li dd dt select option".split())
#: Elements that a heading, list or short paragraph can stand in inside of content.
_WITHIN = frozenset("ul ol dl li dd dt table thead tbody tfoot tr td th blockquote figure figcaption pre details summary".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LOW, HINT, HIGH, FLOOR = 0.005, 0.02, 3.0, 0.5


class _Node:
    __slots__ = ("block", "chars", "content", "head", "hint", "label", "link", "main", "named", "near", "parent", "path", "rank", "tag", "weight")

    def __init__(self, tag: str, parent: _Node | None, attributes: str = ""):
        self.tag, self.parent = tag, parent
        #: The nearest element that isn't inline, and the nearest of a list or table, itself included.
        self.block: _Node = self if tag not in INLINE or parent is None else parent.block
        self.near: _Node | None = self if tag in _NESTED else parent.near if parent is not None else None
        self.link: bool = tag == "a" or (parent is not None and parent.link)
        self.chars = self.content = self.path = 0
        self.weight, self.named = 1.0, False
        self.rank, self.hint, names = _read(tag, attributes)
        self.label = f"{tag}.{names}" if names and tag not in _P_LIKE else tag
        self.main: bool = tag == "main"
        self.head: bool = tag == "h1" or (tag == "article" and not self.hint)


_P_LIKE = _HEADINGS | frozenset("p li dd dt td th tr pre blockquote body html".split())
_EXEMPT = frozenset("html body main".split())


def _read(tag: str, attributes: str) -> tuple[float, bool, str]:
    """(weight of the element, whether class or id holds a listed word, its class)."""
    rank = LOW if tag in NEVER else HIGH if tag in ("article", "main") else 1.0
    hint, names = False, ""
    if attributes:
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "role" and value.lower() in NEVER_ROLE:
                rank = LOW
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
                rank = 0.0
            elif name in ("class", "id"):
                hint = hint or bool(_BAD.search(_STATE.sub("", value)))
                names = value.lower() if name == "class" else names
    return rank, hint and tag not in _EXEMPT, names


_UNSEEN = re.compile(r"display\s*:\s*none", re.I)


class Block:
    """A run of text between tags that aren't inline: decoded, white space as one space, trimmed."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, node: _Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, min(linked, len(text))


class _Reader:
    """Elements, in order of their start tags, and blocks of a page."""

    def __init__(self, page: str):
        self.root = self.now = _Node("", None)
        self.nodes, self.blocks = [self.root], []
        self.open: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked, self.owners = 0, set()
        self.read(page)

    def close_block(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                # The block's element; an inline one if all of its text is in that.
                owner = next(iter(self.owners)) if len(self.owners) == 1 else self.now.block
                self.blocks.append(Block(owner if owner.hint or not owner.rank else owner.block, text, self.linked))
        self.parts, self.linked, self.owners = [], 0, set()

    def text(self, raw: str) -> None:
        if raw:
            decoded = _html.unescape(raw)
            self.parts.append(decoded)
            if size := len(decoded.strip()):
                self.owners.add(self.now)
                self.linked += size if self.now.link else 0

    def leave(self, node: _Node) -> None:
        """Closes the open elements up to ``node``, itself included."""
        if node.block is node or self.now.block is not node.block:
            self.close_block()
        while True:
            self.open[self.now.tag] -= 1
            self.now, left = self.now.parent, self.now
            if left is node:
                return

    def enter(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self.close_block()
            if tag in _P_CLOSERS:
                while self.now.block.tag == "p":
                    self.leave(self.now.block)
            closes = _CLOSES.get(tag, ())
            while self.now.near is not None and self.now.near.tag in closes:
                self.leave(self.now.near)
        self.now = _Node(tag, self.now, attributes)
        self.nodes.append(self.now)
        self.open[tag] += 1

    def read(self, page: str) -> None:
        at = 0
        while True:
            begin = page.find("<", at)
            m = _TOKEN.match(page, begin) if begin >= 0 else None
            if m is None:
                if begin < 0:
                    self.text(page[at:])
                    break
                if begin + 1 >= len(page) or page[begin + 1] in "/!?" and page.find(">", begin) < 0:
                    self.text(page[at:begin])
                    break
                self.text(page[at : begin + 1])
                at = begin + 1
                continue
            self.text(page[at:begin])
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                continue
            tag = name.lower()
            if tag == "br":
                self.text(" ")
            elif (m[1] or m[4]) == "/":
                if self.open[tag] > 0:
                    node = self.now
                    while node.tag != tag:
                        node = node.parent
                    self.leave(node)
            elif _RAW.fullmatch(tag):
                if not (m[3] or "").rstrip().endswith("/"):
                    end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                    at = end.end() if end else len(page)
                if tag not in ("svg", "math"):
                    self.close_block()
            elif tag in VOID:
                if tag == "hr":
                    self.close_block()
            else:
                self.enter(tag, m[3] or "")
        self.close_block()


def _weigh(nodes: list[_Node], found: list[Block], again: bool) -> None:
    """Sets the weight of each element: the product of those on its path."""
    for n in nodes:
        n.chars, n.main, n.head = 0, n.tag == "main", n.tag == "h1" or (n.tag == "article" and not n.hint)
    for b in found:
        b.node.chars += len(b.text) - b.linked
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.main |= n.main
        n.parent.head |= n.head
    half = nodes[0].chars / 2
    for n in nodes[1:]:
        wraps = n.main or (n.head and n.chars > half)
        n.named = n.parent.named or n.hint
        if again and not n.parent.named:
            wraps |= n.chars > half
        n.weight = n.parent.weight * n.rank * (HINT if n.hint and not wraps else 1.0)


class Path:
    """What a page's blocks of one tag path have in common."""

    __slots__ = ("blocks", "chars", "depth", "linked", "number", "parent", "punct", "weight")

    def __init__(self, number: int, parent: Path | None, weight: float):
        self.number, self.parent, self.weight = number, parent, weight
        self.depth: int = parent.depth + 1 if parent is not None else 0
        self.chars = self.punct = self.linked = self.blocks = 0


def paths_of(nodes: list[_Node], found: list[Block]) -> list[Path]:
    """The paths of blocks, in order of appearance; ``path`` of each element is set to its path in the tree of all."""
    tree: list[Path] = []
    numbers: dict[tuple, int] = {}
    for n in nodes:
        if n.parent is not None and n.block is not n and not n.hint and n.rank:
            n.path = n.parent.path
            continue
        key = (n.parent.path if n.parent is not None else None, n.label, n.weight)
        if key not in numbers:
            numbers[key] = len(tree)
            tree.append(Path(len(tree), tree[n.parent.path] if n.parent is not None else None, n.weight))
        n.path = numbers[key]
    seen: dict[int, Path] = {}
    for b in found:
        p = seen.setdefault(b.node.path, tree[b.node.path])
        p.chars += len(b.text)
        p.punct += len(_PUNCT.findall(b.text))
        p.linked += b.linked
        p.blocks += 1
    return list(seen.values())


def _alike(a: Path, b: Path) -> float:
    """The share of the longer path that both have in common; 0 where they part more than eight steps above an end."""
    longest, steps = max(a.depth, b.depth), 0
    while a is not b:
        if steps == 16:
            return 0.0
        a, b = (a.parent, b) if a.depth > b.depth else (a, b.parent) if b.depth > a.depth else (a.parent, b.parent)
        steps += 1
    return (a.depth + 1) / (longest + 1)


_KERNEL = [math.exp(-(k * k) / 2) for k in range(3)]


def ratios(paths: list[Path]) -> list[float]:
    """The fused ratio of each path."""
    length = [p.chars / p.blocks for p in paths]
    punct = [(p.punct + 0.5) / p.blocks for p in paths]
    fused = []
    for i, p in enumerate(paths):
        near = [(j, _KERNEL[abs(j - i)] * _alike(p, paths[j])) for j in range(max(0, i - 2), min(len(paths), i + 3))]
        total = sum(w for _, w in near)
        # A path's own ratio bounds what its neighbours lend it.
        a = min(3 * length[i], sum(length[j] * w for j, w in near) / total)
        b = min(3 * punct[i], sum(punct[j] * w for j, w in near) / total)
        fused.append(math.sqrt(a * b) * (1 - p.linked / p.chars) * p.blocks**0.25 * p.weight)
    return fused


def content_paths(paths: list[Path]) -> set[int]:
    """The numbers of the paths whose ratio passes the threshold."""
    fused = ratios(paths)
    if not fused:
        return set()
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((v - mean) ** 2 for v in fused) / len(fused))
    least = max(FLOOR, min(THRESHOLD * (spread + mean), max(fused)))
    return {p.number for p, v in zip(paths, fused, strict=True) if v >= least}


def extract(page: str | None) -> str:
    """The main text of one page; see the module."""
    read = _Reader(page or "")
    nodes, found = read.nodes, read.blocks
    sections = any(n.tag in ("article", "main") and not n.hint for n in nodes)
    for again in (False,) if sections else (False, True):
        _weigh(nodes, found, again)
        content = content_paths(paths_of(nodes, found))
        if content:
            break
    return "\n".join(b.text for b in _selected(nodes, found, content)) if content else ""


def _selected(nodes: list[_Node], found: list[Block], content: set[int]) -> list[Block]:
    """Content blocks and those that stand in content."""
    for n in nodes:
        n.chars = n.content = 0
    hosts = set()
    for b in found:
        b.node.chars += len(b.text)
        if b.node.path in content:
            b.node.content += len(b.text)
            hosts.add(b.node.parent or b.node)
    for n in reversed(nodes[1:]):
        n.parent.chars += n.chars
        n.parent.content += n.content
    total = nodes[0].content
    # The innermost element of nearly all content: the last in the order of start tags that holds that much.
    top = next(n for n in reversed(nodes) if n.content >= 0.9 * total)
    if top in hosts or top.block is not top or top.tag in _P_LIKE:
        top = top.parent or top if top not in hosts else top
    # ``inner`` of an element: the child of ``top`` it is in, or none outside of ``top``.
    inner: dict[_Node, _Node | None] = {}
    for n in nodes[1:]:
        inner[n] = n if n.parent is top else inner.get(n.parent)
    whole = top in hosts or top.tag in ("article", "main")
    out = []
    for b in found:
        n = b.node
        if n.path in content:
            out.append(b)
            continue
        if 2 * b.linked >= len(b.text):
            continue
        host = n if n in hosts else n.parent
        while host is not None and host not in hosts and host.tag in _WITHIN:
            host = host.parent
        if host is not None and host in hosts:
            if n.weight >= host.weight:
                out.append(b)
        elif (part := inner.get(n)) is not None and n.weight >= top.weight and ((part is n and (whole or n.tag in _HEADINGS)) or (part is not n and 2 * part.content >= part.chars)):
            out.append(b)
    return out


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages``, text and n_chars. No shuffle."""
    page, = fresh(pages.columns, "html")
    kept = without(pages.withColumn(page, col(html)), "text", "n_chars")
    at = kept.columns.index(page)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):  # bounds the output held at a time
                part = batch.slice(lo, 200)
                texts = [extract(x) for x in part.column(at).to_pylist()]
                yield [*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_rows(kept, run, {"text": "string", "n_chars": "long"}).drop(page)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_pages(read(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
