"""Visible text of web pages, laid out.

A tree builder with implied end tags makes the element tree; a renderer walks
it and writes all visible text: block elements on lines of their own with
their spacing, list items with bullets or numbers and indents, preformatted
text as it is, and tables with their columns aligned. Both are iterative and
take time in proportion to the page, whatever its nesting; for that indents
stop growing at ``MOST_INDENT`` columns and blanks before a table cell at
``MOST_BLANK``, both parameters that can be off. Columns that cells from above
take are kept as intervals. Each page is rendered by itself; nothing is
shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from galena.llm.common import batches_of

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object svg canvas audio video datalist title meta link".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())  # a blank line before and after
BLOCK = SPACED | frozenset("html body div section article nav header footer main aside li dt dd form fieldset legend address figcaption details summary hr caption center dialog option optgroup select menu tr td th thead tbody tfoot".split())
CLOSES_P = BLOCK - frozenset("html body td th tr thead tbody tfoot caption option optgroup select summary legend".split())
#: An opening tag ends the open elements named, up to the nearest of the others.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
BARRIER = frozenset({"table", "td", "th", "caption", "button", "object", "template", "html"})
#: Text and elements directly in these, other than those of the second set, go before their table.
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())
IN_TABLE = frozenset("caption colgroup col thead tbody tfoot tr td th style script template form".split())
MOST_INDENT, MOST_BLANK = 64, 1000  # so that text and time stay in proportion to the page


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """Builds the tree; ``sheets`` collects the text of style elements.

    ``places`` has, for each tag, where its open elements are in ``open``, so
    no tag needs a walk through all of them.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open, self.sheets = [self.root], []
        self.places: defaultdict[str, list[int]] = defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.open))
        self.open.append(node)

    def cut(self, at: int) -> None:
        """Close the open elements from ``at`` on."""
        while len(self.open) > at:
            self.places[self.open.pop().tag].pop()

    def nearest(self, names: set[str] | frozenset[str]) -> int:
        return max((own[-1] for n in names if (own := self.places.get(n))), default=0)

    def shut(self, names: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of ``names`` inside the nearest of ``within``."""
        if not any(self.places.get(n) for n in names):
            return
        floor, found = self.nearest(within), []
        for n in names:
            own = self.places.get(n) or []
            k = bisect_right(own, floor)
            found += own[k : k + 1]
        if found:
            self.cut(min(found))

    def home(self) -> list:
        """Where content goes that may not stand directly in a table: before the table."""
        at = self.nearest({"table"})
        above, table = self.open[at - 1].children, self.open[at]
        if not above or above[-1] is not table:  # the table itself was moved out of another
            return above
        above.pop()
        self.after = (above, table)
        return above

    def put(self, item: Node | str, moved: bool) -> None:
        if not moved:
            self.open[-1].children.append(item)
            return
        self.after = None
        self.home().append(item)
        if self.after:
            self.after[0].append(self.after[1])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in IMPLIED:
            self.shut(*IMPLIED[tag])
        elif tag in CLOSES_P and self.open[-1].tag == "head":
            self.cut(len(self.open) - 1)
        if tag in CLOSES_P:
            self.shut({"p"}, BARRIER)
        node = Node(tag, dict(reversed(attrs)))
        self.put(node, self.open[-1].tag in TABLE_PARTS and tag not in IN_TABLE and bool(self.places.get("table")))
        if tag not in VOID:
            self.push(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            return self.handle_starttag("br", [])
        own = self.places.get(tag)
        if own and own[-1] > self.nearest((BARRIER if tag not in BARRIER else frozenset({"table"})) - {tag}):
            self.cut(own[-1])

    def handle_data(self, data: str) -> None:
        top = self.open[-1]
        if top.tag == "style":
            self.sheets.append(data)
        self.put(data, top.tag in TABLE_PARTS and not data.isspace() and bool(self.places.get("table")))


_DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_VISIBLE = re.compile(r"(?:^|[;\s])visibility\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_BLANK, _SOLID = " \t\n\r\f", re.compile(r"[^ \t\n\r\f]+")  # no-break spaces are text
_COMPOUND = re.compile(r"([A-Za-z][\w-]*|\*?)((?:[.#][\w-]+)*)")
_PART = re.compile(r"[.#][\w-]+")
_SCREEN = re.compile(r"@(?:media|supports|layer|container)\b(?![^{]*\bprint\b)", re.I)

@dataclass
class Rule:
    """A compound selector (tag, .classes, #ids) and what it says of display and visibility: (important, order, value)."""

    tag: str
    parts: frozenset[str]
    says: list[tuple[bool, int, str] | None]

    @property
    def weight(self) -> tuple[int, int, int]:
        ids = sum(p[0] == "#" for p in self.parts)
        return ids, len(self.parts) - ids, bool(self.tag)


#: Rules by one of their parts, or by their tag.
Rules = dict[str, list[Rule]]


def style_rules(sheets: list[str]) -> Rules:
    """Rules of compound selectors for display and visibility; what is for print only is left out."""
    rules: dict[tuple[str, frozenset[str]], Rule] = {}
    order = 0
    for sheet in sheets:
        closed, head = [], ""  # of each block that is open, whether its rules hold
        for text, mark in re.findall(r"([^{};]*)([{};]|$)", re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
            if mark == "{":
                if head or not all(closed):  # a block in a rule, or in one that does not hold
                    closed.append(False)
                elif text.strip().startswith("@"):
                    closed.append(bool(_SCREEN.match(text.strip())))
                else:
                    closed, head, body = [*closed, True], text.strip() or " ", []
                continue
            if head and all(closed):
                body.append(text)
            if mark == "}" and closed:
                holds = all(closed)
                closed.pop()
                if head and holds:
                    order += 1
                    said = [[(bool(i), order, v.lower()) for v, i in pattern.findall(";".join(body))] for pattern in (_DISPLAY, _VISIBLE)]
                    for name in map(str.strip, head.split(",")) if any(said) else ():
                        if name and (m := _COMPOUND.fullmatch(name)):
                            key = m[1].lower().strip("*"), frozenset(_PART.findall(m[2]))
                            own = rules.setdefault(key, Rule(*key, [None, None]))
                            for k, found in enumerate(said):
                                own.says[k] = max([*found, *([own.says[k]] if own.says[k] else [])], key=lambda x: x[:2], default=None)
                    head = ""
    uses = Counter(p for r in rules.values() for p in r.parts)
    out: Rules = defaultdict(list)
    for r in rules.values():  # by its rarest part
        out[min(r.parts, key=lambda p: (uses[p], p), default=r.tag)].append(r)
    return dict(out)


def styled(rules: Rules, tag: str, attrs: dict[str, str | None]) -> tuple[str | None, str | None]:
    """Display and visibility of an element, null where nothing says: the important, then the more special, then the later rule."""
    found = []
    if rules:
        parts = {*("." + c for c in (attrs.get("class") or "").split()), f"#{attrs.get('id')}"}
        found = [r for n in (tag, *parts) for r in rules.get(n, ()) if r.tag in ("", tag) and r.parts <= parts]
    out = []
    for k, pattern in enumerate((_DISPLAY, _VISIBLE)):
        own = [(bool(i), (9, 0, 0), n, v.lower()) for n, (v, i) in enumerate(pattern.findall(attrs.get("style") or ""))]
        best = max([*((r.says[k][0], r.weight, *r.says[k][1:]) for r in found if r.says[k]), *own], key=lambda x: x[:3], default=None)
        out.append(best and best[3])
    return out[0], out[1]


def _width(line: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line) if not line.isascii() else len(line)


class Flow:
    """Lines of text; collapses white space within a line and blank lines between blocks."""

    def __init__(self, most_indent: int | None = MOST_INDENT) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.most_indent = most_indent
        self.indent, self.space, self.blank, self.bullet = "", False, False, ""

    def text(self, data: str) -> None:
        words = _SOLID.findall(data)
        if not words:
            self.space |= bool(data)
            return
        if self.line and (self.space or data[0] in _BLANK):
            self.line.append(" ")
        self.line.append(" ".join(words))
        self.space = data[-1] in _BLANK

    def raw(self, data: str) -> None:
        first, *rest = data.expandtabs(8).split("\n")
        self.line.append(first)
        for x in rest:
            self.end(keep=True)
            self.line.append(x)

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        lead = self.indent[: max(0, len(self.indent) - len(self.bullet))] + self.bullet if self.bullet else self.indent
        self.bullet = ""
        self.lines.append((lead + line).rstrip())

    def end(self, keep: bool = False) -> None:
        """End the line; an empty one counts only if ``keep``."""
        line, self.line, self.space = "".join(self.line), [], False
        if line or keep:
            self.put(line)

    def block(self, spaced: bool) -> None:
        self.end()
        self.blank |= spaced

    def deeper(self, columns: int) -> str:
        """Indent by so many columns more, up to the most there are; returns the indent before."""
        before = self.indent
        self.indent = before + " " * (columns if self.most_indent is None else min(columns, max(0, self.most_indent - len(before))))
        return before


class Columns:
    """Columns that no cell from above takes, as gaps; what a cell takes comes back after its last row."""

    def __init__(self) -> None:
        self.starts, self.ends = [0], {0: 1 << 60}  # of gaps, in order
        self.taken: list[tuple[int, int, int]] = []  # heap of (row, from, to)

    def first(self, at: int) -> int:
        """The first free column from ``at``."""
        k = bisect_right(self.starts, at) - 1
        return at if k >= 0 and self.ends[self.starts[k]] > at else self.starts[k + 1]

    def take(self, a: int, b: int, until: int) -> None:
        """Take what is free of columns [a, b) until row ``until``; what another cell has is that one's."""
        k = max(0, bisect_right(self.starts, a) - 1)
        while k < len(self.starts) and self.starts[k] < b:
            start = self.starts[k]
            end = self.ends[start]
            low, high = max(a, start), min(b, end)
            if low >= high:
                k += 1
                continue
            heappush(self.taken, (until, low, high))
            left = [(x, y) for x, y in ((start, low), (high, end)) if x < y]
            del self.ends[start]
            self.starts[k : k + 1] = [x for x, _ in left]
            self.ends |= dict(left)
            k += start < low

    def row(self, r: int) -> None:
        """Give back what was taken until row ``r``."""
        while self.taken and self.taken[0][0] <= r:
            _, a, b = heappop(self.taken)
            k = bisect_right(self.starts, a)
            if k < len(self.starts) and self.starts[k] == b:
                b = self.ends.pop(self.starts.pop(k))
            if k and self.ends[self.starts[k - 1]] == a:
                self.ends[self.starts[k - 1]] = b
            else:
                self.starts.insert(k, a)
                self.ends[a] = b


class Table:
    """Rows of cells (lines, columns, rows they span)."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def placed(self) -> Iterator[list[tuple[int, list[str], int]]]:
        """Each row's cells as (column, lines, span); a column that a cell from above still takes is passed over."""
        columns = Columns()
        for r, row in enumerate(self.rows):
            columns.row(r)
            at, out, down_from = 0, [], []
            for cell, span, down in row:
                at = columns.first(at)
                out.append((at, cell, span))
                if down != 1:
                    down_from.append((at, at + span, r + down if down else len(self.rows)))
                at += span
            for own in down_from:
                columns.take(*own)
            yield out

    def lines(self, most_blank: int | None) -> list[str]:
        """Rows with each column as wide as its widest cell; columns two spaces apart, at most ``most_blank`` in a row."""
        rows, width = list(self.placed()), defaultdict(int)
        for row in rows:
            for at, cell, span in row:
                if span == 1:
                    width[at] = max([width[at], *map(_width, cell)])
        wide_columns = sorted(width)
        before = [0, *accumulate(width[c] for c in wide_columns)]

        def place(column: int) -> int:
            return 2 * column + before[bisect_left(wide_columns, column)]

        out = []
        for row in rows:
            each: dict[int, list[tuple[int, int, str]]] = defaultdict(list)
            for at, cell, span in row:
                for k, own in enumerate(cell):
                    each[k].append((at, span, own))
            for k in range(max((len(c) for _, c, _ in row), default=0)):
                line, wide, have, column = [], 0, 0, 0  # wide: of the line; have: where ``column`` begins
                for at, span, own in each[k]:
                    have += place(at) - place(column)
                    if own:
                        line.append(" " * min(have - wide, have - wide if most_blank is None else most_blank) + own)
                        wide = have + _width(own)
                    have, column = max(have + place(at + span) - place(at), wide + 2 if own else 0), at + span
                out.append("".join(line).rstrip())
        return out


def _number(value: str | None, least: int, most: int) -> int:
    return min(most, max(least, int(value))) if value and re.fullmatch(r"\d{1,9}", value.strip()) else least


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


def _roman(n: int) -> str:
    out = ""
    for value, name in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out += name * (n // value)
        n %= value
    return out


def ordinal(n: int, kind: str | None) -> str:
    """Number of a list item as its list's type has it; what a type can't tell is a plain number."""
    if kind in ("a", "A") and n > 0:
        return _letters(n) if kind == "a" else _letters(n).upper()
    if kind in ("i", "I") and 0 < n < 4000:
        return _roman(n) if kind == "i" else _roman(n).upper()
    return str(n)


def in_order(children: list) -> list:
    """Children of a table as they show: its first head first, its first foot last."""
    head = next((c for c in children if isinstance(c, Node) and c.tag == "thead"), None)
    foot = next((c for c in children if isinstance(c, Node) and c.tag == "tfoot"), None)
    rest = [c for c in children if c is not head and c is not foot]
    front = next((k for k, c in enumerate(rest) if isinstance(c, Node) and c.tag in ("tbody", "tr")), len(rest))
    return [*rest[:front], *([head] if head else []), *rest[front:], *([foot] if foot else [])]


def render(html: str | None, most_indent: int | None = MOST_INDENT, most_blank: int | None = MOST_BLANK) -> str:
    """All visible text of a page; an empty string for null, empty or wholly hidden pages.

    Indents stop at ``most_indent`` columns and blanks before a table cell at
    ``most_blank``; None: never, however deep or wide the page is.
    """
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    rules = style_rules(builder.sheets)
    flows: list[Flow] = [Flow(most_indent)]
    tables: list[Table] = []
    lists: list[list] = []  # [ordered, next number, step, type]
    todo: list[tuple[Node | str, bool, bool, object]] = [(builder.root, True, False, None)]
    while todo:
        node, seen, pre, closing = todo.pop()
        flow = flows[-1]
        if closing is not None:
            closing()
            continue
        if isinstance(node, str):
            if seen:
                (flow.raw if pre else flow.text)(node)
            continue
        tag, attrs = node.tag, node.attrs
        display, visible = styled(rules, tag, attrs)
        shut = "hidden" in attrs or (tag == "dialog" and "open" not in attrs)
        if tag in HIDDEN or display == "none" or (shut and display is None):
            continue
        seen = seen if visible in (None, "inherit") else visible == "visible"
        if tag == "br":
            flow.end(keep=True)
            continue
        children = node.children
        if tag == "details" and "open" not in attrs:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        close = None
        if tag == "table":
            flow.block(True)
            tables.append(Table())
            children = in_order(children)

            def close(flow: Flow = flow) -> None:
                for line in tables.pop().lines(most_blank):
                    flow.put(line)
                flow.block(True)
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
        elif tag in ("td", "th") and tables:
            if not tables[-1].rows:
                tables[-1].rows.append([])
            flows.append(Flow(most_indent))

            def close(row: list = tables[-1].rows[-1], span: int = _number(attrs.get("colspan"), 1, 1000), down: int = _number(attrs.get("rowspan"), 0, 65534) if attrs.get("rowspan") else 1) -> None:
                cell = flows.pop()
                cell.end()
                row.append((cell.lines, span, down))
        elif tag in ("ul", "ol", "menu"):
            flow.block(not lists)
            step = -1 if tag == "ol" and "reversed" in attrs else 1
            first = _number(attrs["start"], 1, 10**9) if attrs.get("start") else sum(isinstance(c, Node) and c.tag == "li" for c in children) if step < 0 else 1
            lists.append([tag == "ol", first, step, attrs.get("type")])

            def close(flow: Flow = flow) -> None:
                lists.pop()
                flow.block(not lists)
        elif tag == "li":
            flow.block(False)
            bullet = "- "
            if lists and lists[-1][0]:
                number = _number(attrs.get("value"), lists[-1][1], 10**9) if attrs.get("value") else lists[-1][1]
                bullet, lists[-1][1] = f"{ordinal(number, lists[-1][3])}. ", number + lists[-1][2]
            before, flow.bullet = flow.deeper(len(bullet)), bullet

            def close(flow: Flow = flow, before: str = before) -> None:
                flow.end()
                flow.indent, flow.bullet = before, ""
        elif tag in ("dd", "blockquote"):
            flow.block(tag in SPACED)
            before = flow.deeper(2)

            def close(flow: Flow = flow, before: str = before, spaced: bool = tag in SPACED) -> None:
                flow.block(spaced)
                flow.indent = before
        elif tag in BLOCK:
            flow.block(tag in SPACED)
            if tag == "pre":
                pre = True
                if children and isinstance(children[0], str) and children[0].startswith("\n"):
                    children = [children[0][1:], *children[1:]]

            def close(flow: Flow = flow, spaced: bool = tag in SPACED) -> None:
                flow.block(spaced)
        if close is not None:
            todo.append((node, seen, pre, close))
        todo.extend((c, seen, pre, None) for c in reversed(children))
    flows[0].end()
    return "\n".join(flows[0].lines).strip("\n")


def page_texts(pages: DataFrame) -> DataFrame:
    """Return page_id, url, text and n_lines for every row of ``pages``.

    Null and empty pages have an empty text and no line. Pages may be of any
    length. Rows that repeat a page_id or lack one are rendered like others.
    An empty table gives an empty result; further columns, of whatever names
    (text too), are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(h) for h in batch.column("html").to_pylist()]
            lines = [len(t.split("\n")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["page_id", "url", "text", "n_lines"])

    return batches_of(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_lines long")
