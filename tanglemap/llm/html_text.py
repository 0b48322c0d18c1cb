"""HTML to text by layout-aware rendering.

A tokenizer feeds a tree builder that opens and closes what HTML implies; visibility
rules drop what a reader does not see; a renderer lays out the rest: blocks on lines
of their own, list items with markers, table cells in aligned columns.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tanglemap.llm.common import unpacked

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head script style noscript template iframe noembed noframes title datalist object audio video canvas svg math".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset hr form".split())
BLOCK = SPACED | frozenset("html body address article aside details dialog dd div dt fieldset figcaption footer header hgroup legend li main menu nav option optgroup section select summary caption tr thead tbody tfoot center".split())
CLOSES_P = SPACED | frozenset("address article aside details div dl fieldset figcaption footer header main menu nav section center".split())
#: A start tag closes these open elements, up to the elements that bound the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
MAX_DEPTH = 512  # deeper elements become siblings at this depth, as in browsers
MAX_COLSPAN, MAX_ROWSPAN = 1_000, 65_534  # larger spans count as these, as HTML says

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
UNDISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    shown: bool = True  # own visibility, else the parent's


def _shown(attrs: dict[str, str], parent: Node) -> bool:
    own = VISIBILITY.findall(attrs["style"]) if "style" in attrs else []
    return own[-1].lower() == "visible" if own else parent.shown


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return out


def parse(source: str) -> Node:
    """The element tree, under a nameless root."""
    root = Node("")
    stack = [root]

    def close(tags: set[str], bounds: set[str]) -> None:
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag in bounds:
                return
            if stack[at].tag in tags:
                del stack[at:]
                if not any(n.tag in tags for n in stack[1:]):
                    return
                close(tags, bounds)
                return

    at = 0
    for m in iter(lambda: TOKEN.search(source, at), None):
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if at == m.start():  # cannot happen with this pattern, but never loop
            at += 1
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html"):
                    break
            continue
        if tag in ("html", "body"):
            close({"head"}, set())
            if any(n.tag == tag for n in stack):
                continue
        elif tag in BLOCK and any(n.tag == "head" for n in stack):
            close({"head"}, set())
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "li", "dd", "blockquote", "button", "object"})
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            close({"h1", "h2", "h3", "h4", "h5", "h6"}, BLOCK - {"h1", "h2", "h3", "h4", "h5", "h6"})
        attrs = _attributes(m[3]) if m[3].strip(" /") else {}
        node = Node(tag, attrs, [], _shown(attrs, stack[-1]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(source, at)
            body = source[at : end.start()]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            at = end.end()
        elif tag not in VOID and not (m[3].endswith("/") and tag in ("svg", "path")) and len(stack) < MAX_DEPTH:
            stack.append(node)
    if at < len(source):
        stack[-1].children.append(html.unescape(source[at:]))
    return root


def _seen(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return False
    if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False
    return not ("style" in node.attrs and UNDISPLAYED.search(node.attrs["style"]))


def width(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Page:
    """Lines under construction. ``gap``: blank lines owed before the next text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False  # white space is owed before the next word of the line
        self.lead = ""  # marker that the next line starts with

    def text(self, value: str) -> None:
        words = SPACE.split(value)
        if words[0] == "" and len(words) > 1:
            self.space = True
            words = words[1:]
        for i, word in enumerate(words):
            if not word:
                self.space = self.space or i > 0
                continue
            if i:
                self.space = True
            self._put(word)

    def _put(self, word: str) -> None:
        if not self.line:
            if self.lines and self.gap:
                self.lines.extend([""] * self.gap)
            self.gap = 0
            self.line.append(self.lead)
            self.lead = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(word)

    def end_line(self, gap: int = 0) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        self.gap = max(self.gap, gap)

    def whole(self, lines: Sequence[str]) -> None:
        self.end_line()
        for i, line in enumerate(lines):
            if line or 0 < i < len(lines) - 1:
                if self.lines and self.gap:
                    self.lines.extend([""] * self.gap)
                self.gap = 0
                self.lines.append(self.lead + line)
                self.lead = " " * len(self.lead) if i == 0 else self.lead
        self.lead = ""


def _block(node: Node) -> list[str]:
    page = Page()
    _children(node, page)
    page.end_line()
    return page.lines


def _indented(page: Page, marker: str, lines: list[str]) -> None:
    pad = " " * len(marker)
    page.whole([(marker if i == 0 else pad) + line if line or i == 0 else "" for i, line in enumerate(lines)])


def _rows(node: Node, group: object = None) -> Iterator[tuple[object, Node]]:
    """Rows, each with what tells its row group; a cell spans no rows of another."""
    for child in node.children:
        if isinstance(child, Node) and _seen(child):
            if child.tag == "tr":
                yield group, child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child, id(child))


def _span(cell: Node, name: str, most: int) -> int:
    """Value of ``colspan`` or ``rowspan``; a ``rowspan`` of 0 goes on to the group's end."""
    value = cell.attrs.get(name, "1").strip()
    number = int(value) if value.isdecimal() and value.isascii() and len(value) < 10 else 1
    return min(most, most if number == 0 and name == "rowspan" else max(1, number))


def _grid(node: Node) -> list[dict[int, tuple[list[str], int]]]:
    """For each row the cells that begin in it, by column: lines, and columns spanned."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    held: dict[int, int] = {}  # column: rows for which a cell from above still holds it
    last = None
    for group, row in _rows(node):
        if group != last:
            held, last = {}, group
        cells: dict[int, tuple[list[str], int]] = {}
        begun: dict[int, int] = {}
        stray = Node("", {}, [], row.shown)
        at = 0
        for child in row.children:
            if not (isinstance(child, Node) and child.tag in ("td", "th")):
                stray.children.append(child)
            elif _seen(child):
                while held.get(at):
                    at += 1
                wide, high = _span(child, "colspan", MAX_COLSPAN), _span(child, "rowspan", MAX_ROWSPAN)
                cells[at] = ([line for line in _block(child) if line], wide)
                begun.update({column: high - 1 for column in range(at, at + wide)} if high > 1 else {})
                at += wide
        extra = [line for line in _block(stray) if line]
        if extra:
            while held.get(at):
                at += 1
            cells[at] = (extra, 1)
        held = {column: rows - 1 for column, rows in held.items() if rows > 1} | begun
        grid.append(cells)
    return grid


def _table(node: Node, page: Page) -> None:
    loose = Node("", {}, [c for c in node.children if not (isinstance(c, Node) and c.tag in ("tr", "thead", "tbody", "tfoot"))], node.shown)
    before = _block(loose)
    if before:
        page.whole(before)
    grid = _grid(node)
    widths: dict[int, int] = {}
    for cells in grid:
        for at, (cell, wide) in cells.items():
            if wide == 1:
                widths[at] = max(widths.get(at, 0), max(map(width, cell), default=0))
    used = sorted({at for at, size in widths.items() if size} | {at for cells in grid for at, (cell, _) in cells.items() if cell})
    for cells in grid:  # a cell over several columns widens the last of them, if it must
        for at, (cell, wide) in cells.items():
            if wide > 1 and cell:
                own = [c for c in used if at <= c < at + wide]
                short = max(map(width, cell)) - sum(widths.get(c, 0) + 2 for c in own) + 2
                widths[own[-1]] = widths.get(own[-1], 0) + max(0, short)
    lines = []
    for cells in grid:
        for n in range(max((len(cell) for cell, _ in cells.values()), default=0)):
            line, upto = "", 0
            for at, (cell, wide) in sorted(cells.items()):
                if n < len(cell):
                    line += " " * (sum(widths.get(c, 0) + 2 for c in used if c < at) - upto)
                    line, upto = line + cell[n], sum(widths.get(c, 0) + 2 for c in used if c < at) + width(cell[n])
            lines.append(line.rstrip(" "))
    page.whole(lines)


def _children(node: Node, page: Page) -> None:
    number = int(n) if (n := node.attrs.get("start", "1")).isdecimal() and n.isascii() and len(n) < 10 else 1
    for child in node.children:
        if isinstance(child, str):
            if node.shown:
                page.text(child)
            continue
        if not _seen(child):
            continue
        tag = child.tag
        if tag == "br":
            if page.line:
                page.end_line()
            else:
                page.gap = max(page.gap, 1 if page.lines else 0)
        elif tag == "hr":
            page.end_line(1)
        elif tag == "img":
            if child.attrs.get("alt") and child.shown:
                page.text(child.attrs["alt"])
        elif tag == "input":
            if child.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset") and child.attrs.get("value") and child.shown:
                page.text(child.attrs["value"])
        elif tag == "li":
            marker = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            page.end_line()
            lines = _block(child)
            if lines or child.shown:
                _indented(page, marker, lines or [""])
            page.end_line()
        elif tag in ("dd", "blockquote"):
            page.end_line(int(tag == "blockquote"))
            _indented(page, "  ", _block(child))
            page.end_line(int(tag == "blockquote"))
        elif tag == "pre":
            page.end_line(1)
            raw = "".join(_raw(child)).removeprefix("\n")
            page.whole([line.rstrip() for line in raw.replace("\r\n", "\n").split("\n")])
            page.end_line(1)
        elif tag == "table":
            page.end_line(1)
            _table(child, page)
            page.end_line(1)
        elif tag == "details" and "open" not in child.attrs:
            page.end_line()
            _children(Node("", {}, [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1], child.shown), page)
            page.end_line()
        elif tag in BLOCK:
            gap = int(tag in SPACED and not (tag in ("ul", "ol") and node.tag == "li"))
            page.end_line(gap)
            _children(child, page)
            page.end_line(gap)
        else:
            if tag in ("td", "th"):
                page.space = True
            _children(child, page)


def _raw(node: Node) -> Iterator[str]:
    for child in node.children:
        if isinstance(child, str):
            if node.shown:
                yield child
        elif child.tag == "br":
            yield "\n"
        elif _seen(child):
            yield from _raw(child)


def render(source: str | None) -> str:
    return "\n".join(_block(parse(source))) if source else ""


def extract_text(pages: DataFrame, *, html_col: str = "html", keep: Sequence[str] | None = None) -> DataFrame:
    """The pages (columns ``keep``, or all) with ``text``, the visible text as laid out.

    Null or empty HTML gives an empty text, and so does a page without visible text. Unclosed
    and stray tags are handled as HTML implies; elements deeper than browsers nest them (512)
    become siblings, their text stays. A null id is a value like any other. Repeated rows each give a row; an empty table gives an empty table. No shuffle."""
    names = list(keep or pages.columns)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(html_col).alias("_html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))
        for batch in batches:
            texts = [render(source) for source in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "_text"])

    out = rows.mapInArrow(extract, rows.select("_row").schema.add("_text", "string"))
    return out.select(*unpacked(out, names, text=F.col("_text")))
