"""One parse of each page into a struct that all extractors share."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Not part of any text; and not part of the lines in which people are looked for.
SILENT, SKIPPED = {"script", "style"}, {"script", "style", "nav", "header"}
BLOCKS = {"li", "article", "tr", "div", "section"}
LEAST_BLOCK, MOST_BLOCK = 15, 2000
TEXT, TEXTS = pa.string(), pa.list_(pa.string())
ARROW = pa.struct([("lang", TEXT), ("title", TEXT), ("title_source", TEXT), ("site_name", TEXT), ("organization", TEXT), ("json_ld", TEXTS), ("hrefs", TEXTS), ("anchors", TEXTS), ("body_text", TEXT), ("footer_text", TEXT), ("lines", TEXTS), ("blocks", TEXTS)])
PAGE = StructType([StructField(f.name, ArrayType(StringType()) if pa.types.is_list(f.type) else StringType()) for f in ARROW])


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """A lenient tree: an end tag closes the nearest open element of its name, and is ignored if there is none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        #: (line, column) where the inside of the first title begins and ends.
        self.title_from: tuple[int, int] | None = None
        self.title_to: tuple[int, int] | None = None

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {})
        for k, v in attrs:
            node.attrs.setdefault(k, v or "")
        if tag == "title" and self.title_from is None:
            self.title_from = self.getpos()
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag == "title" and self.title_from and self.title_to is None:
            self.title_to = self.getpos()
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def between(html: str, start: tuple[int, int], end: tuple[int, int]) -> str:
    """What is written from the end of the tag at ``start`` up to ``end``, both as (line from 1, column)."""
    lines = html.split("\n", end[0])
    at = lambda p: sum(len(line) + 1 for line in lines[: p[0] - 1]) + p[1]
    tag = re.match(r"""<(?:[^>"']|"[^"]*"|'[^']*')*>""", html[at(start) : at(end)])
    return html[at(start) + (tag.end() if tag else 0) : at(end)]


def walk(node: Node, skipped: frozenset[str] | set[str] = frozenset()):
    """Elements in document order, and no others below skipped ones."""
    stack = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str) or at.tag in skipped:
            continue
        yield at
        stack.extend(reversed(at.children))


def strings(node: Node, skipped: set[str]) -> list[str]:
    """Trimmed text nodes that are not blank, in document order."""
    out, stack = [], [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            if text := at.strip():
                out.append(text)
        elif at.tag not in skipped or at is node:
            stack.extend(reversed(at.children))
    return out


def organisation_names(texts: list[str]) -> list[str]:
    """Names of organisations in JSON-LD, the legal name before the plain one."""
    out = []
    for text in texts:
        try:
            data = json.loads(text or "")
        except ValueError:
            continue
        graph = data.get("@graph") if isinstance(data, dict) else None
        for node in graph if isinstance(graph, list) else data if isinstance(data, list) else [data]:
            if not isinstance(node, dict):
                continue
            kind = node.get("@type") or ""
            kind = ",".join(map(str, kind)) if isinstance(kind, list) else str(kind)
            if re.search("organization|corporation", kind, re.IGNORECASE):
                if name := node.get("legalName") or node.get("name"):
                    out.append(str(name))
    return out


def parse(html: str | None) -> dict | None:
    """The parts of a page; null for a null or empty page. ``title_source`` is the title as it is written, with its entities, cut-off ones too."""
    if not html:
        return None
    tree = Tree()
    tree.feed(html)
    tree.close()
    page: dict = {f.name: [] if pa.types.is_list(f.type) else None for f in ARROW}
    scripts = []
    for node in walk(tree.root):
        a = node.attrs
        if node.tag == "html" and page["lang"] is None:
            page["lang"] = a.get("lang") or None
        elif node.tag == "title" and page["title"] is None:
            page["title"] = "".join(strings(node, set()))
        elif node.tag == "meta" and a.get("property") == "og:site_name" and page["site_name"] is None:
            page["site_name"] = a.get("content") or None
        elif node.tag == "meta" and a.get("name") == "organization" and page["organization"] is None:
            page["organization"] = a.get("content") or None
        elif node.tag == "script" and a.get("type") == "application/ld+json":
            scripts.append("".join(c for c in node.children if isinstance(c, str)))
        elif node.tag == "a" and "href" in a:
            page["hrefs"].append(a["href"].strip())
            page["anchors"].append(" ".join(strings(node, SILENT)))
        elif node.tag == "footer" and page["footer_text"] is None:
            page["footer_text"] = " ".join(strings(node, SILENT))
    if tree.title_from and tree.title_to:
        page["title_source"] = between(html, tree.title_from, tree.title_to)
    page["json_ld"] = organisation_names(scripts)
    page["body_text"] = " ".join(strings(tree.root, SILENT))
    page["lines"] = [line for text in strings(tree.root, SKIPPED) for part in re.split(r"\n|<br\s*/?>", text) if (line := part.strip())]
    for node in walk(tree.root, SKIPPED):
        if node.tag in BLOCKS:
            texts = strings(node, SKIPPED)
            if LEAST_BLOCK <= len(" ".join(texts)) <= MOST_BLOCK:
                page["blocks"].append("\n".join(texts))
    return page


@F.arrow_udf(PAGE)
def parse_page(html: pa.Array) -> pa.Array:
    return pa.array([parse(h) for h in html.to_pylist()], ARROW)
