"""HTML into blocks, titles and links: a small tree over the standard parser."""

from __future__ import annotations

import re
import urllib.parse
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import by_slices, collapse_text

# Elements that are no content, and those that make blocks.
NOISE = frozenset("script style noscript template svg canvas iframe form button select input textarea nav header footer aside link meta".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
BLOCKS = frozenset("p li blockquote pre dd dt figcaption td th".split())
STRUCTURE = BLOCKS | HEADINGS.keys() | {"table", "ul", "ol"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Node:
    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str | None]):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self):
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def first(self, *names: str) -> Node | None:
        return next((n for n in self.walk() if n.name in names), None)

    def strings(self):
        stack: list = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    yield x.strip()
            else:
                stack.extend(reversed(x.children))

    def text(self) -> str:
        return collapse_text(" ".join(self.strings()))


class _Tree(HTMLParser):
    """End tags close up to the nearest open element of their name, or do nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(reversed(attrs)))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, dict(reversed(attrs))))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _noise(n: Node) -> bool:
    classes = (n.attrs.get("class") or "").split()
    return n.name in NOISE or "headerlink" in classes or n.attrs.get("role") in NOISE_ROLES or n.attrs.get("aria-hidden") == "true"


def parse(html: str) -> Node:
    """The tree without what is no content."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    stack = [tree.root]
    while stack:
        node = stack.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _noise(c)]
        stack.extend(c for c in node.children if isinstance(c, Node))
    return tree.root


def _list_items(node: Node):
    for item in node.children:
        if isinstance(item, Node) and item.name == "li":
            nested = [c for c in item.children if isinstance(c, Node) and c.name in ("ul", "ol")]
            own = Node("li", {})
            own.children = [c for c in item.children if c not in nested]
            if text := own.text():
                yield text
            for inner in nested:
                yield from _list_items(inner)


def _table(node: Node) -> str:
    rows = ([c.text() for c in r.walk() if c.name in ("td", "th")] for r in node.walk() if r.name == "tr")
    return "\n".join(" | ".join(cells) for cells in rows if any(cells))


def extract_blocks(html: str) -> tuple[list[tuple[str, list[str]]], list[str], str]:
    """([(text, heading path)], warnings, title)."""
    root = parse(html)
    container, warnings = root.first("main") or root.first("article"), []
    if container is None:
        container, warnings = root.first("body") or root, ["no-semantic-container"]
    named = root.first("title")
    title = named.text() if named else ""
    if not title:
        h1 = container.first("h1")
        title = h1.text() if h1 else ""
        warnings.append("title-missing")
    path = [title] if title else []
    out: list[tuple[str, list[str]]] = []

    def visit(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                continue
            if level := HEADINGS.get(c.name):
                if text := c.text().rstrip("¶").rstrip():
                    path[level:] = [text]
                continue
            if c.name == "table":
                texts = [_table(c)]
            elif c.name in ("ul", "ol"):
                texts = list(_list_items(c))
            elif c.name in BLOCKS or c.first(*STRUCTURE) is None:
                texts = [c.text()]
            else:
                visit(c)
                continue
            out.extend((t, list(path)) for t in texts if t)

    visit(container)
    return out, warnings, title


def normalize_url(url: str) -> str:
    """Lower-case scheme and host, no fragment; ValueError if it's no http(s) URL."""
    p = urllib.parse.urlsplit((url or "").strip())
    if p.scheme not in ("http", "https") or not p.netloc:
        raise ValueError(f"no http or https URL: {url!r}")
    return urllib.parse.urlunsplit((p.scheme, p.netloc.lower(), p.path, p.query, ""))


def extract_links(html: str, base: str) -> list[str]:
    """Absolute http(s) links in order, without repeats or fragments."""
    out: dict[str, None] = {}
    for a in parse(html).walk():
        href = (a.attrs.get("href") or "").strip() if a.name == "a" else ""
        if href and not href.startswith(("mailto:", "javascript:", "tel:", "#")):
            try:
                out.setdefault(normalize_url(urllib.parse.urljoin(base, href)))
            except ValueError:
                pass
    return list(out)


def plain_blocks(text: str) -> list[tuple[str, list[str]]]:
    """Paragraphs of a text/plain page."""
    return [(p, []) for p in map(collapse_text, re.split(r"\n\s*\n", text or "")) if p]


_PAGE = "struct<title:string,warnings:array<string>,blocks:array<struct<text:string,heading_path:array<string>>>>"
_BLOCK = pa.struct([("text", pa.string()), ("heading_path", pa.list_(pa.string()))])
_PAGE_TYPE = pa.struct([("title", pa.string()), ("warnings", pa.list_(pa.string())), ("blocks", pa.list_(_BLOCK))])


def _pages(html: list[str | None], content_type: list[str | None]) -> pa.Array:
    rows = []
    for h, kind in zip(html, content_type, strict=True):
        if kind == "text/plain":
            blocks, warnings, title = plain_blocks(h or ""), ["plain-text-page"], ""
        else:
            blocks, warnings, title = extract_blocks(h or "")
        if not blocks:
            warnings = [*warnings, "empty-page"]
        rows.append({"title": title, "warnings": sorted(set(warnings)), "blocks": [{"text": t, "heading_path": p} for t, p in blocks]})
    return pa.array(rows, _PAGE_TYPE)


def page_udf(html: Column, content_type: Column) -> Column:
    @F.arrow_udf(_PAGE)
    def run(h: pa.Array, kind: pa.Array) -> pa.Array:
        return by_slices(_pages, _PAGE_TYPE, h, kind)

    return run(html, content_type)


def links_udf(html: Column, base: Column) -> Column:
    links = lambda h, b: pa.array([extract_links(x or "", y or "") for x, y in zip(h, b, strict=True)], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def run(h: pa.Array, b: pa.Array) -> pa.Array:
        return by_slices(links, pa.list_(pa.string()), h, b)

    return run(html, base)


def page_documents(pages: DataFrame) -> DataFrame:
    """Pages (url, html, optional content_type) with title, warnings and blocks."""
    kind = F.col("content_type") if "content_type" in pages.columns else F.lit("text/html")
    got = pages.withColumn("page", page_udf(F.col("html"), kind))
    return got.select("*", "page.title", "page.warnings", "page.blocks").drop("page")


def page_blocks(pages: DataFrame, key: str) -> DataFrame:
    # An inner explode would have Spark filter by the blocks' number first, for which pages are parsed once more.
    blocks = page_documents(pages).select(key, F.posexplode_outer("blocks").alias("block_pos", "b")).filter("block_pos IS NOT NULL")
    return blocks.select(key, "block_pos", "b.text", "b.heading_path")


def blocked_host(host: Column) -> Column:
    """Whether a host is a literal address (or name) that must not be fetched."""

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(is_blocked_host)

    return run(host)


def is_blocked_host(host: str | None) -> bool:
    import ipaddress

    name = (host or "").lower().rstrip(".")
    if not name or name == "localhost" or name.endswith(".localhost"):
        return True
    try:
        a = ipaddress.ip_address(name)
    except ValueError:
        return False
    return any((a.is_private, a.is_loopback, a.is_link_local, a.is_reserved, a.is_unspecified, a.is_multicast))
