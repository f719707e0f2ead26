"""Pages of standards and their index, read from HTML with the standard library's tokenizer.

The tree is built as a lenient reader would: void elements close at once, an end tag closes its nearest open match or is
ignored, and the end closes everything. An unclosed block therefore swallows the blocks after it, which are then part of
its text and not read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vouchline.functions.ident import struct_digest
from vouchline.functions.text import as_number, clean_text
from vouchline.sources.tables import PARAGRAPH

# How the pages are marked up.
VOID = frozenset("area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta nextid param source spacer track wbr".split())
HEADINGS = ("h2", "h3", "h4", "h5", "h6")
BLOCKS = (*HEADINGS, "p", "li")
TITLE = ("h1", "article-detail__title")
BODY = ("div", "article-detail__content")
CONTENTS = ("ul", "standardTopBookmarks")
NOTES = ("div", "footnotes")
DETAILS = "/auditing-standards/details/"
_number = re.compile(r"\.(?:\d{2}[A-Z]?|[A-Z]\d+)(?=\s|$)")
_titled = re.compile(r"\s*as\s*(\d{4})\s*[:—-]\s*(.+)$", re.IGNORECASE | re.DOTALL)
_linked = re.compile(r"\s*as\s*(\d{4})\s*[:—-]\s*(.+)$", re.IGNORECASE)

PARSED = (
    f"url string, ok boolean, error string, as_number string, title string, notes array<string>, "
    f"sections array<struct<heading: string, level: int, paragraphs: array<{PARAGRAPH}>>>, footnotes array<{PARAGRAPH}>"
)


@dataclass
class Node:
    name: str
    attributes: dict[str, str | None] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)

    def has_class(self, name: str) -> bool:
        return name in (self.attributes.get("class") or "").split()

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.name not in ("script", "style", "template"):
                yield from child.strings()

    def text(self) -> str:
        return "".join(self.strings())

    def first(self, name: str, css: str) -> Node | None:
        return next((n for n in self.walk() if n.name == name and n.has_class(css)), None)

    def without(self, drop: set[int]) -> None:
        """Removes the descendants whose identity is in drop."""
        self.children = [c for c in self.children if isinstance(c, str) or id(c) not in drop]
        for child in self.children:
            if isinstance(child, Node):
                child.without(drop)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


class NotAStandard(ValueError):
    """The page lacks what a standard's page has."""


def _outer_blocks(node: Node) -> Iterator[Node]:
    """Blocks that aren't inside another block."""
    for child in node.children:
        if isinstance(child, Node):
            if child.name in BLOCKS:
                yield child
            else:
                yield from _outer_blocks(child)


def _marked(node: Node) -> tuple[str, str]:
    """A footnote's marker and its text without the marker; '?' where there is none."""
    marker = next((n for n in node.walk() if n.name == "sup"), None)
    if marker is not None:
        node.without({id(marker)})
    return (clean_text(marker.text()) if marker is not None else "") or "?", clean_text(node.text())


def parse_page(html: str) -> dict:
    """A standard's page -> number, title, notes, sections and footnotes. Raises NotAStandard with the reason.

    Text before the first numbered paragraph below a heading belongs to no paragraph and is left out; before the first
    heading it is a note. Headings without a numbered paragraph make no section; paragraphs without a heading are filed
    under the title.
    """
    page = tree(html)
    heading = page.first(*TITLE)
    if heading is None:
        raise NotAStandard("no standard title on the page")
    titled = _titled.match(clean_text(heading.text()))
    if titled is None:
        raise NotAStandard("no number in the title")
    title = titled.group(2).strip()
    body = page.first(*BODY)
    if body is None:
        raise NotAStandard("no standard body on the page")
    body.without({id(n) for n in body.walk() if n.name == CONTENTS[0] and n.has_class(CONTENTS[1])})
    block = body.first(*NOTES)
    footnotes = []
    if block is not None:
        body.without({id(block)})
        footnotes = [(number, text) for number, text in map(_marked, [n for n in block.walk() if n.name == "p"]) if text]
    body.without({id(n) for n in body.walk() if n.name == "sup"})
    runs: list[tuple[str, int, list[list[str]]]] = [(title, 2, [])]
    notes, headed = [], False
    for node in _outer_blocks(body):
        text = clean_text(node.text())
        if not text:
            continue
        found = _number.match(text)
        if node.name in HEADINGS:
            runs.append((text, int(node.name[1]), []))
            headed = True
        elif found:
            runs[-1][2].append([found.group(), text[found.end() :].strip()])
        elif runs[-1][2]:
            runs[-1][2][-1].append(text)
        elif not headed:
            notes.append(text)
    sections = [
        {"heading": name, "level": level, "paragraphs": [{"number": p[0], "text": " ".join(p[1:]).strip()} for p in paragraphs]}
        for name, level, paragraphs in runs
        if paragraphs
    ]
    if not sections:
        raise NotAStandard("no numbered paragraphs found")
    return {"as_number": f"AS {titled.group(1)}", "title": title, "notes": notes, "sections": sections, "footnotes": [{"number": n, "text": t} for n, t in footnotes]}


def parse_pages(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> a row a page; pages that are no standard have ok false and the reason as error."""

    names = ["url", "ok", "error", "as_number", "title", "notes", "sections", "footnotes"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for url, html in zip(frame["url"], frame["html"], strict=True):
                try:
                    rows.append({"url": url, "ok": True, "error": None, **parse_page(html or "")})
                except NotAStandard as why:
                    rows.append(dict.fromkeys(names) | {"url": url, "ok": False, "error": str(why)})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return pages.select("url", "html").mapInPandas(run, PARSED)


def links_of(html: str) -> list[tuple[int, str, str]]:
    """(position, target, text) of every link with a target."""
    anchors = [n for n in tree(html).walk() if n.name == "a" and n.attributes.get("href") is not None]
    return [(i, a.attributes["href"] or "", " ".join(s for s in map(str.strip, a.strings()) if s)) for i, a in enumerate(anchors)]


def index_links(index_pages: DataFrame, base: str) -> DataFrame:
    """index_pages(html) -> (as_number, title, url): the first link to each standard's details, in the numbers' order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for html in frame["html"]:
                for at, target, text in links_of(html or ""):
                    found = _linked.match(text)
                    if DETAILS in target and found:
                        rows.append((at, found.group(1), found.group(2).strip(), urljoin(base, target)))
            yield pd.DataFrame(rows, columns=["at", "digits", "title", "url"])

    links = index_pages.select("html").mapInPandas(run, "at int, digits string, title string, url string")
    numbered = links.withColumn("as_number", as_number(F.col("digits")))
    first = F.row_number().over(W.partitionBy("as_number").orderBy("at", "url"))
    return numbered.withColumn("rank", first).filter("rank = 1").select("as_number", "title", "url").orderBy("as_number")


def footnotes(parsed: DataFrame) -> DataFrame:
    """Parsed pages -> (standard, id, number, citation, text, paragraph_link) of their footnotes. Labels may be missing or
    repeat, so an id holds a digest of the whole note; no note is linked to a paragraph."""
    each = parsed.select(F.col("as_number").alias("standard"), F.explode("footnotes").alias("x")).select("standard", "x.number", "x.text")
    slug = F.replace("standard", F.lit(" "), F.lit(""))
    one = F.concat(slug, F.lit(":footnote:"), "number", F.lit(":"), struct_digest(F.struct("number", "text")))
    return each.select("standard", one.alias("id"), "number", F.concat("standard", F.lit(" footnote "), "number").alias("citation"), "text", F.lit(None).cast("string").alias("paragraph_link"))


def render_pages(standards: DataFrame, paragraphs: DataFrame, with_notes: bool = False) -> DataFrame:
    """standards and paragraphs -> (url, html): pages in the markup that parse_pages reads, a heading a section; the
    standards' notes as numbered footnotes if asked for."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c) if isinstance(c, str) else c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<p>"), "number", F.lit("&nbsp; "), escaped("text"), F.lit("</p>"))
    sections = paragraphs.groupBy("standard", "section_id").agg(F.min("number").alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    part = F.concat(F.lit("<h2>"), "section_id", F.lit("</h2>\n"), "lines")
    bodies = sections.groupBy("standard").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "section_id", part.alias("part")))), lambda x: x["part"]), "\n").alias("body"))
    listed = F.transform("notes", lambda n, i: F.concat(F.lit("<p><sup>"), (i + 1).cast("string"), F.lit("</sup> "), escaped(n), F.lit("</p>")))
    notes = F.concat(F.lit('<div class="footnotes">'), F.array_join(listed, ""), F.lit("</div>")) if with_notes else F.lit("")
    page = F.concat(F.lit('<html><body><h1 class="article-detail__title">'), "as_number", F.lit(": "), escaped("title"), F.lit('</h1><div class="article-detail__content">'), "body", notes, F.lit("</div></body></html>"))
    return standards.join(bodies, standards["as_number"] == bodies["standard"]).select("url", page.alias("html"))
