"""HTML extraction by layout: the visible text of a page, with its blocks, lists and tables.

A tree builder reads tags in any order, with the end tags that HTML implies (a new paragraph, list item, row or cell
ends the open one; a cell outside a row opens one) and raw text elements. A renderer walks the tree without recursion,
leaves out what a page does not show, and keeps line breaks, blank lines between blocks, list marks with indent,
preformatted text, and tables with aligned columns.

Formulas and drawings: the text of MathML and SVG is visible, without SVG's titles, descriptions and metadata and MathML's
annotations and phantoms. SVG's texts, foreign objects and MathML's table cells are set apart by blanks. In both, "/>"
ends an element, CDATA is text, and tags of HTML blocks and text leave them.

Defined results: null is null; an empty page is an empty text; unclosed tags, comments and quotes end with the page; a
"<" that starts no tag is text; unknown tags are inline; character references are resolved, unknown ones kept; equal
pages give equal texts; numbers in attributes are ASCII digits after at most one "-", others give the default; an empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakframe.llm.common import freeing, slices

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)|'([^']*)|([^\s>]+)))?")
_INTEGER = re.compile(r"-?[0-9]+")
_HIDING_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
UNSEEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas".split())
#: Elements of SVG and MathML: what they don't show, what blanks set apart, what holds HTML, and the tags that leave them.
FOREIGN = frozenset(["svg", "math"])
FOREIGN_UNSEEN = frozenset("title desc metadata annotation annotation-xml mphantom".split())
APART = frozenset("text mtd foreignobject".split())
_HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
_LEAVES = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr form fieldset menu".split())
LINED = frozenset(
    "html body div section article aside main nav header footer address li dt dd tr caption legend details summary figcaption option center dialog".split()
)
#: What a start tag ends, looked for up to the nearest of the limits.
_SCOPE = frozenset("table td th caption button template object html foreignobject".split())
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split()) | _SCOPE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _SCOPE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _SCOPE),
    "td": (frozenset(["td", "th"]), frozenset("tr table".split())),
    "th": (frozenset(["td", "th"]), frozenset("tr table".split())),
    "tr": (frozenset(["tr"]), frozenset("table".split())),
    "thead": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "body": (frozenset(["head"]), frozenset()),
}
_ENDS_P = (SPACED | LINED) - frozenset("html body tr caption option legend".split())
_P = (frozenset(["p"]), _SCOPE)
_CELL = frozenset(["table", "td", "th"])
_HEAD_ONLY = frozenset("head base link meta title style script template noscript".split())


class Node:
    __slots__ = ("attributes", "children", "foreign", "tag")

    def __init__(self, tag: str, attributes: str = "", foreign: bool = False):
        self.tag, self.attributes, self.children = tag, attributes, []  # children: nodes and texts
        self.foreign = foreign


def _closed(attributes: str) -> bool:
    """Whether a tag ends in "/>"; the "/" of an unquoted value does not count."""
    if not attributes.endswith("/"):
        return False
    last = attributes.rsplit(None, 1)[-1]
    return "=" not in last or '"' in last or "'" in last


class TreeBuilder:
    """Builds the tree of a page; open elements are a stack with a count of each tag."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.stack = [self.root]
        self.open: dict[str, int] = {"html": 1}

    def _pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    def _end(self, tags: frozenset[str], limits: frozenset[str]) -> None:
        """Closes the nearest of the tags, with all it holds, unless a limit lies between."""
        if not any(self.open.get(t) for t in tags):
            return
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag in tags:
                while len(self.stack) > at:
                    self._pop()
                return
            if self.stack[at].tag in limits:
                return

    def foreign(self) -> bool:
        """Whether the next tag belongs to SVG or MathML."""
        return self.stack[-1].foreign and self.stack[-1].tag not in _HOLDS_HTML

    def _push(self, tag: str, attributes: str) -> None:
        node = Node(tag, attributes, tag in FOREIGN or self.foreign())
        self.stack[-1].children.append(node)
        if not (_closed(attributes) if node.foreign else tag in VOID):
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def start(self, tag: str, attributes: str) -> None:
        if tag == "html":
            return
        while tag in _LEAVES and self.foreign():
            self._pop()
        if self.open.get("head") and tag not in _HEAD_ONLY:
            self._end(frozenset(["head"]), frozenset())
        if tag in _ENDS_P:
            self._end(*_P)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", "")
        self._push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "p" and not self.open.get("p"):
            self._push("p", "")
        if tag in ("table", "head") or tag in _SCOPE:
            limits = frozenset()
        elif tag in SPACED or tag in LINED:
            limits = _CELL - {tag}
        else:  # the end of an inline element leaves the blocks in it open
            limits = (SPACED | LINED | _CELL) - {tag}
        self._end(frozenset([tag]), limits)

    def text(self, data: str) -> None:
        if data:
            if self.open.get("head") and self.stack[-1].tag == "head" and not data.isspace():
                self._pop()
            self.stack[-1].children.append(data)


def parse(page: str) -> Node:
    builder, at = TreeBuilder(), 0
    while True:
        found = _TAG.search(page, at)
        if found is None:
            builder.text(html.unescape(page[at:]))
            return builder.root
        builder.text(html.unescape(page[at : found.start()]))
        at = found.end()
        closing, tag, attributes = found[1], found[2], found[3]
        if tag is None:
            if builder.foreign() and page.startswith("<![CDATA[", found.start()):
                stop = page.find("]]>", found.start())
                builder.text(page[found.start() + 9 : stop if stop >= 0 else len(page)])
                at = stop + 3 if stop >= 0 else len(page)
            continue
        tag = tag.lower()
        if closing:
            builder.end(tag)
            continue
        raw = tag in RAW and not builder.foreign()
        builder.start(tag, attributes)
        if raw:
            stop = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            inner = page[at : stop.start() if stop else len(page)]
            builder.text(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = stop.start() if stop else len(page)


def shown(node: Node) -> bool:
    if node.tag in UNSEEN or node.foreign and node.tag in FOREIGN_UNSEEN:
        return False
    if not node.attributes or node.attributes.isspace():
        return True
    for name, *values in _ATTRIBUTE.findall(node.attributes):
        name = name.lower()
        if name == "hidden" or name == "style" and any(map(_HIDING_STYLE.search, values)):
            return False
    return True


def _number(node: Node, name: str, default: int) -> int:
    for key, *values in _ATTRIBUTE.findall(node.attributes):
        if key.lower() == name and _INTEGER.fullmatch(value := "".join(values).strip()):
            return int(value[:9])
    return default


class Flow:
    """Lines of a block: collapsed text, pending blank lines, and the indent of open lists."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = ""
        self.mark = ""

    def text(self, data: str) -> None:
        own = data.split()
        if own:
            if self.parts and (self.space or data[0].isspace()):
                self.parts.append(" ")
            self.parts.append(" ".join(own))
            self.space = data[-1].isspace()
        else:
            self.space = True

    def line(self, content: str) -> None:
        if self.lines and self.gap:
            self.lines += [""] * self.gap
        self.gap = 0
        if self.mark:
            self.lines.append(self.indent[: -len(self.mark)] + self.mark + content)
            self.mark = ""
        else:
            self.lines.append(self.indent + content if content else "")

    def end(self, gap: int = 0) -> None:
        """Ends the line; at least `gap` blank lines come before the next one."""
        if self.parts:
            self.line("".join(self.parts))
            self.parts = []
        self.space = False
        self.gap = max(self.gap, gap)

    def as_text(self) -> str:
        self.end()
        return "\n".join(self.lines)


def _table_lines(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of (cell text, columns spanned), as lines with aligned columns."""
    grid = [[(cell.split("\n"), span) for cell, span in row] for row in rows]
    widths: dict[int, int] = {}
    for row in grid:
        column = 0
        for lines, span in row:
            if span == 1:
                widths[column] = max(widths.get(column, 0), *map(len, lines))
            column += span
    out = []
    for row in grid:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            column, cells = 0, []
            for lines, span in row:
                width = sum(widths.get(c, 0) for c in range(column, column + span)) + 3 * (span - 1)
                cells.append((lines[i] if i < len(lines) else "").ljust(width))
                column += span
            out.append(" | ".join(cells).rstrip())
    return out


def render(root: Node) -> str:
    """The visible text of a tree."""
    flows = [Flow()]
    lists: list[list] = []  # [ordered, next number]
    tables: list[list[list[tuple[str, int]]]] = []
    kept = 0  # open preformatted blocks
    todo: list[tuple[Node | str, bool]] = [(root, False)]
    while todo:
        node, leaving = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not kept:
                flow.text(node)
                continue
            first, *rest = node.replace("\r\n", "\n").split("\n")
            flow.parts.append(first)
            for line in rest:
                flow.line("".join(flow.parts))
                flow.parts = [line]
            continue
        tag = node.tag
        if not leaving and not shown(node):
            continue
        if node.foreign and tag in APART:
            if kept:
                flow.parts.append(" ")
            flow.space = True
        if not leaving:
            if tag == "br":
                if flow.parts:
                    flow.end()
                else:
                    flow.gap = max(flow.gap, 1)
                continue
            if tag == "img":
                continue
            if tag == "table":
                flow.end(1)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(Flow())
            elif tag in SPACED or tag in LINED:
                flow.end(0 if tag not in SPACED or tag in ("ul", "ol", "menu") and lists else 1)
            if tag in ("ul", "ol", "menu"):
                lists.append([tag == "ol", _number(node, "start", 1)])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    mark = f"{_number(node, 'value', lists[-1][1])}. "
                    lists[-1][1] = _number(node, "value", lists[-1][1]) + 1
                flow.indent += " " * len(mark)
                flow.mark = mark
                node.attributes = str(len(mark))  # for the way out
            elif tag in ("blockquote", "dd"):
                flow.indent += "  "
            kept += tag == "pre"
            todo.append((node, True))
            todo += [(child, False) for child in reversed(node.children)]
            continue
        kept -= tag == "pre"
        if tag in ("td", "th") and tables:
            tables[-1][-1].append((flows.pop().as_text(), min(1000, max(1, _number(node, "colspan", 1)))))
        elif tag == "table":
            rows = tables.pop()
            for line in _table_lines([r for r in rows if any(cell for cell, _ in r)]):
                flow.line(line)
            flow.end(1)
        elif tag in SPACED or tag in LINED:
            flow.end(0 if tag not in SPACED or tag in ("ul", "ol", "menu") and len(lists) > 1 else 1)
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            flow.indent, flow.mark = flow.indent[: len(flow.indent) - int(node.attributes)], ""
        elif tag in ("blockquote", "dd"):
            flow.indent = flow.indent[:-2]
    return flows[0].as_text()


def visible_text(page: str | None) -> str | None:
    return None if page is None else render(parse(page))


def extract_pages(pages: DataFrame, page_id: str = "page_id", page: str = "html") -> DataFrame:
    """(page_id, text) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "page", 2 << 20):
            texts = [visible_text(x.as_py()) for x in batch.column("page")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(page).alias("page"))
    return rows.mapInArrow(freeing(run), "page_id long, text string")
