"""HTML extraction: a layout-aware renderer.

A tree builder supplies implied tags (open paragraphs, list items, cells and
the head close where the next element demands it), visibility rules drop what a
page does not show, and the renderer walks the tree with an explicit stack:
blocks are set apart by line breaks and blank lines, list items get markers and
indents, table cells are aligned in columns, and preformatted text keeps its
white space.  All visible text comes out, that of drawings and formulas and the
fallback of objects as well.

Defined results: null HTML gives null text; an empty page and one without
visible text give an empty text; broken or unclosed markup is rendered as far
as it goes; depth is limited by memory only, since nothing recurses, and levels
beyond ``MAX_LEVELS`` are not indented further; a column of a table is padded to
``MAX_WIDTH`` at most, and a line to ``MAX_PLACE``, beyond which cells stand two
spaces apart, and cells from ``MAX_COLUMNS`` on take no part in spans; so a very
long page is rendered as a whole, in time and into text in proportion to its
length; repeated rows give repeated results;
an input column that has the name of the result is replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .frames import append

# Element classes of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD_ONLY = frozenset("title meta link style script base template noscript".split())
UNSEEN = frozenset("head title style script template noscript datalist audio video canvas iframe desc defs metadata annotation annotation-xml".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr menu".split())
BLOCKS = PARAGRAPHS | frozenset("html body div section article aside header footer nav main address fieldset form li dt dd details summary figcaption legend caption center dialog search hgroup tr option optgroup select textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(("td", "th"))
TABLE_PARTS = frozenset(("table", "thead", "tbody", "tfoot", "tr"))
#: What a start tag closes, and the element at which the search for it ends.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "a": ({"a"}, {"td", "th", "table"}),
}
SCOPE = frozenset("table td th caption html button object template".split())
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
KEEPS_SPACE = re.compile(r"(?:^|;)\s*white-space\s*:\s*(?:pre|pre-wrap|break-spaces)\b", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
#: Nested lists and quotes whose indents are printed.
MAX_LEVELS = 64
#: Padded width of a column and of a line, and columns of a table that spans are kept for.
MAX_WIDTH, MAX_PLACE, MAX_COLUMNS = 128, 320, 1000
#: Elements of drawings and formulas end at once where they close themselves; inside these they are HTML again.
FOREIGN, HTML_AGAIN = frozenset(("svg", "math")), frozenset(("foreignobject", "annotation-xml"))


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(HTMLParser):
    """Builds a tree of ``Node`` and text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.places: dict[str, list[int]] = {}  # where elements of a tag are in ``open``

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def innermost(self, tags: set[str] | frozenset[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close_open(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> bool:
        """Close the innermost of the tags, if none of ``stop`` is open inside it."""
        at = self.innermost(tags)
        if not at or at < self.innermost(stop):
            return False
        self.pop_to(at)
        return True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.places.get(tag):
            return
        if self.places.get("head") and tag not in HEAD_ONLY:
            self.close_open({"head"}, frozenset())
        if tag in CLOSES:
            self.close_open(*CLOSES[tag])
        if tag in BLOCKS and tag not in ("html", "body", "option", "optgroup", "tr"):
            self.close_open({"p"}, SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop_to(len(self.open) - 1)
        if tag in CELLS and self.places.get("table") and self.open[-1].tag in TABLE_PARTS - {"tr"}:
            self.push(Node("tr", {}))
        node = Node(tag, dict(attrs))
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self.push(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag and self.innermost(FOREIGN) > self.innermost(HTML_AGAIN - {tag}):
            self.pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        elif tag == "p" and not self.places.get("p"):
            self.open[-1].children.append(Node("p", {}))
        elif tag not in VOID and tag not in ("html", "body"):
            stop = {"table"} if tag in TABLE_PARTS | CELLS and tag != "table" else frozenset() if tag == "table" else SCOPE - {tag}
            self.close_open({tag}, stop)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip(" \t\n\r\f"):
            self.close_open({"head"}, frozenset())
        self.open[-1].children.append(data)


class Flow:
    """Lines of text; ``gap`` blank lines are due before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = True  # the line so far has no text after which a space would show
        self.gap = 0
        self.indent: list[str] = []
        self.marker: str | None = None

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self.put(first)
            for line in rest:
                self.end_line(always=True)
                self.put(line)
            return
        data = SPACES.sub(" ", data)
        if self.blank:
            data = data.lstrip(" ")
        self.put(data)

    def put(self, data: str) -> None:
        if data:
            self.parts.append(data)
            self.blank = data.endswith(" ")

    def end_line(self, always: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts, self.blank = [], True
        if line or always:
            self.emit(line)

    def emit(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        lead = "".join(self.indent[:MAX_LEVELS])
        if self.marker is not None:
            lead, self.marker = lead[: len(lead) - len(self.marker)] + self.marker, None
        self.lines.append((lead + line).rstrip(" "))

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Table:
    def __init__(self) -> None:
        self.rows: list[dict[int, list[str]]] = []
        #: First column, the one after the last, and the row before which it ends, of what cells above cover, in order.
        self.spans: list[tuple[int, int, int]] = []
        self.new: list[tuple[int, int, int]] = []  # those that begin in this row
        self.wide: set[tuple[int, int]] = set()
        self.column = self.passed = 0

    def row(self) -> None:
        self.spans = sorted(s for s in self.spans + self.new if s[2] > len(self.rows))
        self.rows.append({})
        self.new, self.column, self.passed = [], 0, 0

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        while self.passed < len(self.spans) and self.spans[self.passed][0] <= self.column:
            self.column = max(self.column, self.spans[self.passed][1])
            self.passed += 1
        at, self.column = self.column, self.column + columns
        self.rows[-1][at] = lines
        if columns > 1:
            self.wide.add((len(self.rows) - 1, at))
        if rows > 1 and at < MAX_COLUMNS:
            self.new.append((at, min(self.column, MAX_COLUMNS), len(self.rows) - 1 + rows))

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for r, row in enumerate(self.rows):
            for c, lines in row.items():
                own = 0 if (r, c) in self.wide else max(map(width, lines), default=0)
                widths[c] = max(widths.get(c, 0), min(own, MAX_WIDTH))
        place, places, out = 0, {}, []
        for c in sorted(widths):
            places[c] = place
            place = min(place + widths[c] + 2 * bool(widths[c]), MAX_PLACE)
        for row in self.rows:
            left = sorted(row)
            for k in range(max(map(len, row.values()), default=0)):
                left = [c for c in left if k < len(row[c])]
                parts, at = [], 0
                for c in left:
                    if text := row[c][k]:
                        gap = places[c] - at if at < places[c] else 2 * bool(parts and places[c])
                        parts.append(" " * gap + text)
                        at += gap + width(text)
                out.append("".join(parts).rstrip(" "))
        return out


def number(value: str | None, low: int, high: int) -> int:
    return min(max(int(value), low), high) if value and re.fullmatch(r"[0-9]{1,6}", value.strip()) else low


def unseen(node: Node) -> bool:
    a = node.attrs
    return node.tag in UNSEEN or "hidden" in a or (node.tag == "dialog" and "open" not in a) or bool(NO_DISPLAY.search(a.get("style") or ""))


def shown(node: Node) -> list[Node | str]:
    """The children that the element itself does not hide."""
    if node.tag == "details" and "open" not in node.attrs:
        return next(([c] for c in node.children if isinstance(c, Node) and c.tag == "summary"), [])
    if node.tag == "select" and "multiple" not in node.attrs:
        options, stack = [], list(reversed(node.children))
        while stack:
            if isinstance(x := stack.pop(), Node):
                options += [x] * (x.tag == "option")
                stack += reversed(x.children)
        return next(([o] for o in options if "selected" in o.attrs), options[:1])
    return node.children


def render(html: str) -> str:
    """The visible text of a page."""
    builder = Builder()
    builder.feed(html)
    builder.close()
    flows, tables, lists = [Flow()], [], []
    # (node, leaving, visible, keeps white space)
    stack: list[tuple[Node | str, bool, bool, bool]] = [(builder.root, False, True, False)]
    while stack:
        node, leaving, visible, keep = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if visible:
                flow.text(node, keep)
            continue
        tag = node.tag
        cell, in_table = tag in CELLS and bool(tables), bool(tables)
        if leaving:
            if cell:
                flows.pop()
                tables[-1].cell(flow.done(), number(node.attrs.get("colspan"), 1, 1000), number(node.attrs.get("rowspan"), 1, 65534))
            elif tag == "table":
                flow.block(1)
                for line in tables.pop().lines():
                    flow.emit(line)
                flow.block(1)
            elif tag == "caption" and in_table:
                flow.block(0)
            elif tag in BLOCKS and not (tag == "tr" and in_table):
                flow.block(int(tag in PARAGRAPHS and not (tag in ("ul", "ol", "menu") and len(lists) > 1)))
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag == "li":
                if flow.marker is not None:
                    flow.emit("")
                flow.indent.pop()
            elif tag in ("dd", "blockquote"):
                flow.indent.pop()
            elif tag == "q" and visible:
                flow.put('"')
            continue
        if unseen(node):
            continue
        style = node.attrs.get("style") or ""
        if m := VISIBILITY.search(style):
            visible = m[1].lower() == "visible"
        keep = keep or tag in ("pre", "textarea") or bool(KEEPS_SPACE.search(style))
        if tag == "br":
            flow.end_line(always=True)
        elif tag == "hr":
            flow.block(1)
            flow.emit("---")
            flow.block(1)
        elif tag == "input" and visible and (node.attrs.get("type") or "").lower() in ("submit", "button", "reset"):
            flow.text(node.attrs.get("value") or "", False)
        if tag in VOID:
            continue
        if cell:
            if not tables[-1].rows:
                tables[-1].row()
            flows.append(Flow())
        elif tag == "table":
            flow.block(1)
            tables.append(Table())
        elif tag == "tr" and in_table:
            tables[-1].row()
        elif tag in BLOCKS:
            flow.block(int(tag in PARAGRAPHS and not (tag in ("ul", "ol", "menu") and lists)))
        if tag in ("ul", "ol", "menu"):
            lists.append(number(node.attrs.get("start"), 1, 999_999) if tag == "ol" else 0)
        elif tag == "li":
            if flow.marker is not None:  # an item that begins with another list
                flow.emit("")
            marker = "- "
            if lists and lists[-1]:
                marker = f"{number(node.attrs.get('value'), lists[-1], 999_999) if node.attrs.get('value') else lists[-1]}. "
                lists[-1] = int(marker[:-2]) + 1
            flow.indent.append(" " * len(marker))
            flow.marker = marker
        elif tag == "dd":
            flow.indent.append("    ")
        elif tag == "blockquote":
            flow.indent.append("> ")
        elif tag == "q" and visible:
            flow.text('"', keep)
        stack.append((node, True, visible, keep))
        children = shown(node)
        if tag == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        stack.extend((c, False, visible, keep) for c in reversed(children))
    return "\n".join(flows[0].done())


FIELDS = T.StructType([T.StructField("text", T.StringType())])


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text``, the visible text of each page."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        column = batch.column(batch.schema.get_field_index(html_col))
        return [pa.array([None if x is None else render(x) for x in column.to_pylist()], pa.string())]

    return append(pages, html_col, FIELDS, make, keep)
