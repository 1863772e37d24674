"""Main text of web pages by tag-path ratios.

A page is cut into blocks (text between block-level tags), each with its path
from the root. For every path, the length and the punctuation of its blocks'
text are added up and divided by the number of its blocks; both are smoothed
over the paths that come before and after, and fused (multiplied) to the path's
score. What an element is called weighs: names that pages give to what isn't
content lower the score of the paths below.

Scores are added up for each element. From the root, the content nodes are found
by going on to the child that holds most of the score, or to all that hold a fair
share (beside an ``article`` or ``main``, that share is larger). Within a content node
a block is content unless its weight and its path's score are low; outside of them
a path is content if its blocks score together like a content node. Only elements
that are by their tag or role no content (menus, headers and footers of the page,
asides, forms, scripts) are out from the start.

Defined cases: null or empty html gives an empty text; so does a page without
content. Unclosed tags end where a block-level tag or the parent ends, and those
of buttons, drawings, players and the like also where a block-level tag begins;
only raw text (scripts, styles, text areas, frames) goes on to the end of the
page if its end is missing. Unknown tags are inline; so are formulas and
objects, whose text counts. Elements nested deeper than DEPTH are read as text of
the one at that depth. Among equal scores the first in page order counts. Repeated
rows, and rows with a null page_id or url, give a row each; other columns aren't
looked at, whatever their names. Time grows in proportion to a page's length, and a
page is held in memory by the task that reads it.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, map_blocks, strings

# Tags of HTML, and names by which pages mark what isn't content.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea iframe noembed noframes xmp".split())
#: Elements without content of the page, which don't part the text around them.
SKIPPED = frozenset("noscript template svg canvas audio video select button".split())
NESTED = frozenset("svg template".split())
BOILERPLATE = frozenset("nav footer aside form head title menu dialog fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Names of readers' comments, of other parts that aren't content, and those that may be either.
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|comment-?list|disqus|replies|respond)(?:$|[\s_-])", re.I)
STRONG = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|side-?bar|nav|navbar|navigation|menu|breadcrumbs?|footer|page-?header|site-?header|masthead|topbar|toolbar|share|sharing|pagination|pager|skip-?link)(?:$|[\s_-])", re.I)
WEAK = re.compile(r"(?:^|[\s_-])(?:related|recommended|social|widget|login)(?:$|[\s_-])", re.I)
#: Names that count only if they stand alone, outside of the content.
ALONE = frozenset("header head top bottom foot".split())
#: Tags that hold other blocks; the rest are text.
HOLDERS = frozenset("html body div article main section center table tbody tr td details hgroup".split())
CONTENT = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")

#: Weights of paths below an element with a strong or weak name.
WEIGHTS = {"strong": 0.04, "weak": 0.3}
#: Share of the best score that a path must have within a content node.
THRESHOLD = 0.1
#: A child with so much of the score is gone into; without one, all with FAIR of it. What
#: has no article or main beside what has needs BONUS times as much.
DOMINANT, FAIR, BONUS = 0.75, 0.1, 3.0
DEPTH = 400

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: To the end of a tag: quotes count behind "=" alone. Nothing is tried twice.
_REST = re.compile(r"((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[\"'=])*+)>")
_PLAIN = re.compile(r"([^>]*+)(?:>|$)")
_OTHER = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)[^>]*(?:>|$)", re.I) for t in RAW}
_PAIRS = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<(/?)({'|'.join(sorted(SKIPPED))})(?=[\s/>])", re.I | re.S)
_CLOSES_P = BLOCK - {"option", "optgroup", "caption", "tbody", "tr", "td", "th", "thead", "tfoot", "body", "html", "head", "title"}
_SIBLINGS = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table", "tbody", "thead", "tfoot"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}


class Node:
    """An element. ``out``: by its tag or role no content; ``mark``: what its names
    say; ``within``: it lies in an article or main that isn't out."""

    __slots__ = ("chars", "children", "direct", "heads", "holds", "level", "mark", "mass", "out", "parent", "path", "tag", "weight", "within")

    def __init__(self, tag: str, parent: Node | None, level: bool, out: bool = False, mark: str = ""):
        self.tag, self.parent, self.level, self.out, self.mark = tag, parent, level, out, mark
        self.within = bool(parent) and parent.within or tag in CONTENT and not out and not mark and not (parent and parent.marked())
        self.chars, self.heads, self.holds, self.mass, self.direct = 0, False, False, 0.0, 0.0
        self.children: list[Node] = []
        self.path = self.weight = None

    def marked(self) -> bool:
        return bool(self.mark) or bool(self.parent) and self.parent.marked()


class Block:
    __slots__ = ("linked", "node", "score", "text")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked, self.score = node, text, min(linked, len(text)), 0.0


def _kind(tag: str, raw: str, within: bool) -> tuple[bool, str]:
    """Whether an element is no content by its tag or role, and its mark."""
    if tag in BOILERPLATE or tag == "header" and not within:
        return True, ""
    mark = ""
    if raw and tag not in ("html", "body") and tag not in CONTENT:
        for name, value in _ATTRIBUTE.findall(raw):
            name, value = name.lower(), unescape(value.strip("\"'"))
            if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return True, ""
            if name in ("class", "id"):
                if COMMENTS.search(value):
                    mark = "comments"
                elif not mark and (STRONG.search(value) or not within and ALONE & set(value.lower().split())):
                    mark = "strong"
                elif not mark and WEAK.search(value):
                    mark = "weak"
    return False, mark


def _closed(html: str) -> set[int]:
    """Where those tags of SKIPPED elements start that have an end tag."""
    waiting: dict[str, list[int]] = {t: [] for t in SKIPPED}
    found = set()
    for m in _PAIRS.finditer(html):
        if not m[3]:
            continue
        tag = m[3].lower()
        if not m[2]:
            if tag not in NESTED:
                waiting[tag].clear()
            waiting[tag].append(m.start())
        elif waiting[tag]:
            found.add(waiting[tag].pop())
    return found


def page_blocks(html: str) -> list[Block]:
    """Blocks in page order, without those that are out."""
    out: list[Block] = []
    stack = [Node("", None, True)]
    open_ = {"": 1}  # elements in the stack by tag
    parts: list[str] = []
    linked = 0
    closed: set[int] | None = None
    skipped: list[str] = []  # the SKIPPED element that the place is in, and what is open within it
    ends_soon = False  # it has no end tag
    quoted = True  # no tag yet whose quotes hide its end

    def flush() -> None:
        nonlocal linked
        if parts:
            node = stack[-1]
            while not node.level:
                node = node.parent
            if not node.out:
                text = " ".join(unescape("".join(parts)).split())
                if text:
                    out.append(Block(node, text, linked))
            parts.clear()
        linked = 0

    def drop(i: int) -> None:
        for node in stack[i:]:
            open_[node.tag] -= 1
        del stack[i:]

    def push(tag: str, level: bool, no: bool, mark: str) -> None:
        if len(stack) < DEPTH:
            parent = stack[-1]
            while not parent.level:
                parent = parent.parent
            if not level:  # what is inline hangs below its block, but for what it says
                parent = stack[-1]
            stack.append(Node(tag, parent, level, parent.out or no, mark))
            open_[tag] = open_.get(tag, 0) + 1

    at, end = 0, len(html)
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at and not skipped:
            parts.append(html[at:lt])
            if open_.get("a"):
                linked += lt - at
        if lt == end:
            break
        m = _OPEN.match(html, lt)
        if not m:
            other = _OTHER.match(html, lt)
            if not other and not skipped:  # a stray "<" is text
                parts.append("<")
            at = other.end() if other else lt + 1
            continue
        rest = _REST.match(html, m.end()) if quoted else None
        if rest is None:
            quoted, rest = False, _PLAIN.match(html, m.end())
        at = rest.end()
        ends, tag, raw = bool(m[1]), m[2].lower(), rest[1]
        if skipped and tag not in RAW:
            if ends:
                if tag in skipped:
                    while skipped.pop() != tag:
                        pass
                    continue
                if not open_.get(tag):
                    continue
                skipped.clear()  # its parent ends
            elif ends_soon and tag in BLOCK and not (skipped[0] == "select" and tag in ("option", "optgroup")):
                skipped.clear()
            else:
                if tag not in VOID and not raw.rstrip().endswith("/") and len(skipped) < DEPTH:
                    skipped.append(tag)
                continue
        if ends:
            if open_.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        if stack[i].level:
                            flush()
                            drop(i)
                        else:
                            open_[tag] -= 1
                            del stack[i]
                        break
                    if stack[i].level and tag not in BLOCK:
                        break
            continue
        if tag in RAW:
            if not raw.rstrip().endswith("/") or tag in ("script", "style", "textarea", "iframe"):
                stop = _RAW_END[tag].search(html, at)
                at = stop.end() if stop else end
            continue
        if tag in SKIPPED:
            if not raw.rstrip().endswith("/"):
                closed = _closed(html) if closed is None else closed
                ends_soon = lt not in closed
                skipped.append(tag)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in BLOCK:
            if tag in _CLOSES_P and open_.get("p"):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        flush()
                        drop(i)
                        break
                    if stack[i].level:
                        break
            if tag in _SIBLINGS:
                names, within = _SIBLINGS[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in names.split():
                        flush()
                        drop(i)
                        if tag != "tr" or stack[-1].tag != "tr":
                            break
                    elif stack[i].tag in within:
                        break
            flush()
            push(tag, True, *_kind(tag, raw, stack[-1].within))
        elif not raw.rstrip().endswith("/"):
            no, mark = _kind(tag, raw, stack[-1].within)
            if (no or mark) and not stack[-1].out:
                flush()  # inline, but said to be no content
            push(tag, bool(no or mark), no, mark)
    flush()
    return out


def _weigh(found: list[Block]) -> None:
    """Text and children of each element; then weights and paths. A name says nothing
    about an element that holds most of the text and a heading or article, unless it
    is one of readers' comments."""
    total, seen = 0, set()
    for b in found:
        own = len(b.text) - b.linked
        total += own
        node, heads, holds = b.node, False, False
        while node is not None:
            if node.mark == "comments":
                heads = holds = False  # what comments hold says nothing about the elements around
            else:
                holds |= node.tag in CONTENT
                heads |= holds or node.tag == "h1"
            node.chars += own
            node.heads |= heads
            node.holds |= holds
            if id(node) not in seen:
                seen.add(id(node))
                if node.parent is not None:
                    node.parent.children.append(node)
            node = node.parent

    for b in found:
        line = []
        node = b.node
        while node is not None and node.weight is None:
            line.append(node)
            node = node.parent
        for node in reversed(line):
            above = node.parent
            weight = above.weight if above else 1.0
            if node.mark and not (node.mark != "comments" and 2 * node.chars >= total and node.heads):
                weight *= WEIGHTS["weak" if node.mark == "weak" else "strong"]
            # Marked elements don't share a path with others of their tag.
            node.weight, node.path = weight, f"{above.path if above else ''}/{node.tag}" + ("" if not above or weight >= above.weight else "~")


def path_scores(found: list[Block]) -> dict[str, float]:
    """Of each path: smoothed text ratio times smoothed punctuation ratio, times the
    share of its text that isn't links."""
    sums: dict[str, list[float]] = {}
    for b in found:
        s = sums.setdefault(b.node.path, [0, 0, 0, 0])
        s[3] += len(b.text)
        s[0] += len(b.text) - b.linked
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
    ratio = [(s[0] / s[2], s[1] / s[2]) for s in sums.values()]
    last = len(ratio) - 1

    def smooth(k: int, i: int) -> float:
        return (ratio[max(0, i - 1)][k] + 2 * ratio[i][k] + ratio[min(last, i + 1)][k]) / 4

    return {p: smooth(0, i) * (1 + smooth(1, i)) * s[0] / s[3] for i, (p, s) in enumerate(sums.items())}


def _content_nodes(root: Node) -> set[int]:
    """The elements whose blocks are content, by the scores they hold."""
    found, todo = set(), [root]
    while todo:
        node = todo.pop()
        kids = [c for c in node.children if c.tag in HOLDERS and c.mass > 0]
        top = max(kids, key=lambda c: c.mass, default=None)
        fair = lambda holds, n=node: FAIR * n.mass * (BONUS if n.holds and not holds else 1)
        if node.tag in CONTENT or top is None:
            found.add(id(node))
        elif top.mass >= DOMINANT * node.mass:
            todo.append(top)
        elif node.direct >= fair(False):  # text of its own: it is one node with all its parts
            found.add(id(node))
        else:
            todo += [c for c in kids if c.mass >= fair(c.holds)]
    return found


def main_blocks(html: str, threshold: float = THRESHOLD, scored: bool = True) -> list[Block]:
    """The blocks that are content. Without ``scored``, all paths score alike."""
    found = page_blocks(html)
    if not found:
        return []
    _weigh(found)
    scores = path_scores(found) if scored else {b.node.path: 1.0 for b in found}
    # What has a name of its own can't score higher than the best of what has none.
    heaviest = max(b.node.weight for b in found)
    most = max(scores[b.node.path] for b in found if b.node.weight == heaviest)
    for b in found:
        b.score = b.node.weight * (min(1.0, scores[b.node.path] / most) if most else 1.0)
    best = max(b.score for b in found)
    for b in found:
        node, inner = b.node, True
        while node is not None:
            node.mass += b.score
            if inner and (node.tag in HOLDERS or node.parent is None):
                node.direct += b.score  # the nearest element that holds blocks
                inner = False
            node = node.parent
    root = found[0].node
    while root.parent is not None:
        root = root.parent
    nodes = _content_nodes(root)
    outside: dict[str, float] = {}
    within: dict[int, float] = {}

    def place(b: Block) -> tuple[int, float]:
        """The content node that a block is in, or 0, and the least weight on the way."""
        node, least = b.node, 1.0
        while node is not None and id(node) not in nodes:
            if node.parent is not None:
                least = min(least, node.weight / node.parent.weight)
            node = node.parent
        return (0 if node is None else id(node)), least

    places = [place(b) for b in found]
    for b, (node, _) in zip(found, places, strict=True):
        if node:
            within[node] = within.get(node, 0) + b.score
        else:
            outside[b.node.path] = outside.get(b.node.path, 0) + b.score
    fair = FAIR * BONUS * max(within.values(), default=0.0)

    def passes(b: Block, node: int, least: float) -> bool:
        if not node:
            return outside[b.node.path] >= fair
        # A block has a share of its content node's score, by its weight.
        return b.score + threshold * best * least >= threshold * best

    kept: list[Block] = []
    heads: list[Block] = []  # headings right before
    for b, (node, least) in zip(found, places, strict=True):
        good = passes(b, node, least)
        if good:
            kept += heads if node else ()
            kept.append(b)
        heads = [*heads, b] if not good and b.node.tag in HEADINGS and b.node.weight >= 1 and not b.linked else []
    return kept


def main_text(html: str, threshold: float = THRESHOLD) -> str:
    return "\n\n".join(b.text for b in main_blocks(html, threshold))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in strings(block, "html")]
        return pa.RecordBatch.from_arrays([column(block, "page_id"), column(block, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_blocks(pages.select("page_id", "url", "html"), run, schema, "html")
