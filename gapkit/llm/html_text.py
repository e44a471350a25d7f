"""Visible text of HTML pages as a browser lays it out: blocks, lists and tables.

A tokenizer feeds a tree builder that keeps the stack of open elements: it opens and closes what HTML leaves implied
(``</p>`` before a block, ``</li>``, ``</td>``, ``</tr>`` and so on), ignores stray end tags and closes what is left open
at the end. Text goes out while the tree grows, so depth is no limit. Elements that are not shown take their whole subtree with
them: those of ``UNSEEN`` and, inside svg and math, ``UNSEEN_THERE``; ``hidden`` and ``display:none``; closed ``details`` but for the
summary and closed ``dialog``. What is ``visibility:hidden`` keeps its place without its text, but for parts that are visible again.
Both are read from attributes and from style sheets in the page before the element, there from rules for a tag, a class, an id, or a
tag with one of these; rules within at-rules, such as those for print, and other selectors are left out. Of an svg the content of ``text`` and ``foreignObject`` is shown, of a select
the chosen option, or all options where it is a list. What is typed into a page (``textarea``, ``input``) counts as no text of it.

Layout: a block starts a new line, and blocks with a margin are set off by an empty line; runs of white space are one space
except in ``pre``; list items carry a bullet or their number and are indented by level; the cells of a table's column are
padded to one width, which a wide character counts double in, and parted by two spaces;
empty lines of a cell go. Cells over several columns or rows take the places of all these, as long as their part of the table goes;
their text stands in the first. All steps but the padding itself are linear, or nearly so, in the length of a page.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"?|'[^']*+'?)*+)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WHITE = re.compile(r"[ \t\n\r\f]+")
USED = re.compile(r"hidden|style|open|start|value|span", re.I)  # the attributes that matter here
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript".split())
# not rendered, or rendered as something that is no text: media and object show their content only where they fail
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist title "
                   "textarea".split())
UNSEEN_THERE = frozenset("annotation annotation-xml metadata desc defs symbol clippath mask pattern marker".split())
# a start tag of HTML ends an open svg or math, unless one of POINTS is between
LEAVES = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
                   "ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
POINTS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt figcaption footer form header hgroup html legend li main menu nav "
    "optgroup option search section summary caption".split())
# an open element of the first kind is closed by a start tag of the second, unless one of the third is between
CLOSES_P = BLOCK - frozenset("html body li dd dt option optgroup summary legend caption".split()) | {"li", "dd", "dt"}
SCOPE = frozenset("table td th caption button object template".split())
IMPLIED = {
    "li": (("li",), SCOPE | {"ul", "ol", "menu", "dir"}), "dt": (("dt", "dd"), SCOPE | {"dl"}), "dd": (("dt", "dd"), SCOPE | {"dl"}),
    "option": (("option",), SCOPE | {"select"}), "optgroup": (("option", "optgroup"), SCOPE | {"select"}),
    "tr": (("tr", "td", "th", "caption", "colgroup"), {"table"}), "td": (("td", "th"), {"table", "tr"}), "th": (("td", "th"), {"table", "tr"}),
    **{s: (("tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup"), {"table"}) for s in ("thead", "tbody", "tfoot")},
}
TABLE_ONLY = frozenset("td th tr thead tbody tfoot caption colgroup".split())
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
SHEET = re.compile(r"/\*.*?(?:\*/|$)|([{}])|([^{}/]+|/)", re.S)
SELECTOR = re.compile(r"([a-z][a-z0-9-]*)?([.#][\w-]+)?", re.I)
END = 1 << 62


def declared(text: str) -> dict[str, str]:
    """The last ``display`` and ``visibility`` of a list of declarations."""
    return {m[1].lower(): m[2].lower() for m in DECLARATION.finditer(text)}


def sheet_rules(sheet: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Selectors of the known forms, tags in small letters, with what they declare, in the order of the sheet."""
    depth, at_rule, head, body = 0, False, [], []
    for m in SHEET.finditer(sheet):
        if m[1] == "{":
            depth += 1
            at_rule = at_rule or (depth == 1 and "".join(head).rpartition(";")[2].lstrip().startswith("@"))
        elif m[1] == "}":
            depth = max(depth - 1, 0)
            if depth == 0:
                found = {} if at_rule else declared("".join(body))
                for selector in "".join(head).rpartition(";")[2].split(",") if found else ():
                    parts = SELECTOR.fullmatch(selector.strip())
                    if parts and parts[0]:
                        yield (parts[1] or "").lower() + (parts[2] or ""), found
                at_rule, head, body = False, [], []
        elif m[2]:
            (body if depth else head).append(m[2])


@dataclass
class Flow:
    """Lines of a page or of a table cell while they are written."""

    lines: list[str] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    gap: int = 0  # empty lines due before the next text
    space: bool = False
    lead: str = ""  # a list marker due before the next text

    def text(self, text: str, indent: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self._put(first, indent)
            for line in rest:
                self.end(True)
                self._put(line, indent)
            return
        words = WHITE.sub(" ", text)
        body = words.strip(" ")
        if words[:1] == " ":
            self.space = True
        if body:
            self._put((" " if self.space and self.parts else "") + body, indent)
            self.space = words[-1] == " "

    def _put(self, text: str, indent: str) -> None:
        if not text:
            return
        if not self.parts:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.parts.append(indent[:len(indent) - len(self.lead)] + self.lead if self.lead else indent)
            self.lead = ""
        self.parts.append(text)

    def end(self, always: bool = False) -> None:
        """End the line, if there is one."""
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
            self.parts = []
        elif always:
            self.gap = max(self.gap, 1)
        self.space = False

    def block(self, margin: bool) -> None:
        self.end()
        if margin:
            self.gap = max(self.gap, 1)

    def closed(self) -> list[str]:
        self.end()
        return self.lines


@dataclass
class Element:
    name: str
    unseen: bool
    invisible: bool = False
    span: tuple[int, int] = (1, 1)  # columns and rows of a cell; no rows stand for all that are left
    number: int | None = None  # of the next item of an ordered list
    outer: Flow | None = None  # the flow around a select or an option of one
    options: list[tuple[bool, bool, str]] | None = None  # of a select: chosen, can be chosen, text
    choice: tuple[bool, bool, str | None] = (False, True, None)  # of an option: chosen, can be chosen, label


@dataclass
class Table:
    rows: list[list[tuple[list[str], tuple[int, int]]]] = field(default_factory=list)
    parts: list[int] = field(default_factory=list)  # the first row of each head, body and foot
    outer: Flow | None = None


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Free:
    """The columns that no cell from an earlier row reaches into, as intervals in order."""

    def __init__(self):
        self.lo, self.hi = [0], [END]

    def first(self, column: int) -> int:
        """The first free column from this one on."""
        i = bisect_right(self.lo, column)
        return column if i and self.hi[i - 1] > column else self.lo[i]

    def take(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Take what is free of an interval, and return it."""
        i, j = bisect_right(self.hi, lo), bisect_left(self.lo, hi)
        taken = [(max(a, lo), min(b, hi)) for a, b in zip(self.lo[i:j], self.hi[i:j])]
        if taken:
            rest = [(a, b) for a, b in ((self.lo[i], lo), (hi, self.hi[j - 1])) if a < b]
            self.lo[i:j], self.hi[i:j] = [a for a, _ in rest], [b for _, b in rest]
        return taken

    def give(self, lo: int, hi: int) -> None:
        i, j = bisect_left(self.hi, lo), bisect_right(self.lo, hi)
        if i < j:
            lo, hi = min(lo, self.lo[i]), max(hi, self.hi[j - 1])
        self.lo[i:j], self.hi[i:j] = [lo], [hi]


def _placed(table: Table) -> list[list[tuple[int, int, list[str]]]]:
    """First column, column after the last, and lines of each row's cells. Columns where no cell begins are left out.

    A cell may run over a column that one from an earlier row reaches into; the column is the earlier one's as long as that lasts,
    and free then.
    """
    free, ends, rows = Free(), {}, []
    for r, row in enumerate(table.rows):
        for lo, hi in ends.pop(r, ()):
            free.give(lo, hi)
        column, out, down = 0, [], []
        part = bisect_right(table.parts, r)
        last = table.parts[part] if part < len(table.parts) else len(table.rows)
        for lines, (across, below) in row:
            lo = free.first(column)
            column = lo + across
            out.append((lo, column, lines))
            if below != 1:
                down.append((lo, column, min(r + below, last) if below else last))
        for lo, hi, end in down:
            if end > r + 1:
                ends.setdefault(end, []).extend(free.take(lo, hi))
        rows.append(out)
    begins = sorted({lo for row in rows for lo, *_ in row})
    return [[(bisect_left(begins, lo), bisect_left(begins, hi), lines) for lo, hi, lines in row] for row in rows]


def _aligned(table: Table) -> list[str]:
    rows = _placed(table)
    widths = [0] * max((hi for row in rows for _, hi, _ in row), default=0)
    wide = []
    for row in rows:
        for lo, hi, lines in row:
            width = max(map(_width, lines), default=0)
            if hi == lo + 1:
                widths[lo] = max(widths[lo], width)
            elif width:
                wide.append((hi - lo, lo, width))
    for n, lo, width in sorted(wide):
        widths[lo + n - 1] += max(0, width - sum(widths[lo:lo + n]) - 2 * (n - 1))
    offsets = [0]
    for width in widths:
        offsets.append(offsets[-1] + width + 2)
    out = []
    for row in rows:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            pieces, at = [], 0
            for lo, _, lines in row:
                if k < len(lines):
                    # cells that lie over each other are set side by side
                    gap = max(offsets[lo] - at, 2 if at else 0)
                    pieces += [" " * gap, lines[k]]
                    at += gap + _width(lines[k])
            out.append("".join(pieces).rstrip())
    return [line for line in out if line]


class Page:
    """The tree builder: the stack of open elements, and the flow that visible text goes to."""

    def __init__(self):
        self.stack: list[Element] = []
        self.flow, self.tables = Flow(), []
        self.items = self.pre = 0
        self.opened: dict[str, list[int]] = {}  # the places in the stack of each name's open elements
        self.rules: dict[str, dict[str, tuple[int, str]]] = {}  # by selector and property, the last rule's number and value
        self.read = 0

    def attributes(self, name: str, text: str) -> dict[str, str]:
        used = name in ("select", "option", "optgroup") or USED.search(text) or self.opened.get("svg") or (text and self.rules)
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)} if used else {}

    def last(self, names: Iterable[str]) -> int:
        """Place in the stack of the innermost open element of these names, -1 without one."""
        return max((self.opened[n][-1] for n in names if self.opened.get(n)), default=-1)

    def sheet(self, text: str) -> None:
        for selector, found in sheet_rules(text):
            self.read += 1
            for key, value in found.items():
                self.rules.setdefault(selector, {})[key] = self.read, value

    def styled(self, name: str, a: dict[str, str]) -> dict[str, str]:
        """``display`` and ``visibility`` as rules and attributes of the element say; an id goes before a class, that before a tag."""
        best: dict[str, tuple[int, int, str]] = {}
        if self.rules:
            classes = [f".{c}" for c in a.get("class", "").split()]
            ranked = [(0, name), *((1, c) for c in classes), *((2, name + c) for c in classes)]
            if "id" in a:
                ranked += [(3, f"#{a['id']}"), (4, f"{name}#{a['id']}")]
            for rank, selector in ranked:
                for key, (number, value) in self.rules.get(selector, {}).items():
                    if key not in best or best[key] < (rank, number, value):
                        best[key] = rank, number, value
        return {**{k: v for k, (*_, v) in best.items()}, **declared(a.get("style", ""))}

    def foreign(self) -> bool:
        """Whether the innermost of svg, math and the places for HTML inside them is an svg or a math."""
        if self.opened.get("svg") or self.opened.get("math"):
            return self.stack[self.last(POINTS | {"svg", "math"})].name not in POINTS
        return False

    def start(self, name: str, attributes: str) -> None:
        if name in LEAVES:
            while self.foreign():
                self._pop()
        inside = self.opened.get("svg") or self.opened.get("math") or name in ("svg", "math")
        if name in ("select", "input", "textarea") and self.opened.get("select") and self._above("select", {"table"}):
            self.finish("select")
            if name == "select":
                return
        if name in ("html", "body"):
            self._leave_head()
        elif name != "head":
            if name not in ("meta", "link", "base", "title", "script", "style", "template", "noscript"):
                self._leave_head()
            if name in TABLE_ONLY and not self.opened.get("table"):
                return
            if name in CLOSES_P and self.opened.get("p"):
                self._close_implied(("p",), SCOPE)
            if name in IMPLIED:
                self._close_implied(*IMPLIED[name])
            if name in ("td", "th") and not self._above("tr", {"table"}):
                self._push("tr", {})
        self._push(name, self.attributes(name, attributes))
        if name in VOID or (inside and attributes.endswith("/")):
            self._pop()

    def _leave_head(self) -> None:
        if self.opened.get("head"):
            self.finish("head")

    def _above(self, name: str, stop) -> bool:
        return bool(self.opened.get(name)) and self.opened[name][-1] >= self.last(stop)

    def _close_implied(self, names, stop) -> None:
        low = self.last(stop)
        found = [places[i] for places in (self.opened.get(n, ()) for n in names) if (i := bisect_left(places, low)) < len(places)]
        if found:
            depth = min(found)
            while len(self.stack) > depth:
                self._pop()

    def finish(self, name: str) -> None:
        if name == "br":
            self._push("br", {})
            self._pop()
            return
        if not self.opened.get(name):
            if name == "p":  # an empty paragraph; any other stray end tag means nothing
                self._push("p", {})
                self._pop()
            return
        stop = {"table"} if name in TABLE_ONLY else {"td", "th", "caption"} if name != "table" else ()
        if self.opened[name][-1] < self.last(stop):
            return
        while self._pop() != name:
            pass

    def _push(self, name: str, a: dict[str, str]) -> None:
        above = self.stack[-1] if self.stack else None
        styled = self.styled(name, a) if a or self.rules else {}
        gone = styled["display"] == "none" if "display" in styled else "hidden" in a
        unseen = bool(above and above.unseen) or name in UNSEEN or gone
        unseen = unseen or (name == "dialog" and "open" not in a)
        if above and above.name == "details" and above.number == 0 and name != "summary":
            unseen = True
        if self.opened.get("svg") or self.opened.get("math"):
            unseen = unseen or name in UNSEEN_THERE
            if self.opened.get("svg"):
                unseen = unseen or ("display" not in styled and a.get("display") == "none")
                styled = {"visibility": a["visibility"], **styled} if "visibility" in a else styled
        invisible = bool(above and above.invisible)
        if styled.get("visibility") in ("hidden", "collapse", "visible", "initial"):
            invisible = styled["visibility"] in ("hidden", "collapse")
        element = Element(name, unseen, invisible)
        self.opened.setdefault(name, []).append(len(self.stack))
        self.stack.append(element)
        if name == "details":
            element.number = 1 if "open" in a else 0
        if unseen:
            return
        if name == "br":
            self.flow.end(True)
        elif name == "select":
            element.outer, element.options, self.flow = self.flow, [], Flow()
            size = a.get("size", "")
            element.number = int("multiple" in a or (re.fullmatch(r"\d{1,9}", size) is not None and int(size) > 1))
        elif name == "optgroup" and self.opened.get("select"):
            element.number = int("disabled" in a)
        elif name == "option" and self.opened.get("select"):
            element.outer, self.flow = self.flow, Flow()
            off = "disabled" in a or (above.name == "optgroup" and above.number == 1)
            element.choice = "selected" in a, not off, a.get("label")
        elif name == "text" and self.opened.get("svg"):
            self.flow.space = True
        elif name == "table":
            self.flow.block(True)
            self.tables.append(Table(outer=self.flow))
        elif name == "tr":
            self.tables[-1].rows.append([])
        elif name in ("thead", "tbody", "tfoot") and self.tables:
            self.tables[-1].parts.append(len(self.tables[-1].rows))
        elif name in ("td", "th", "caption"):
            self.flow = Flow()
            across, below = (int(a.get(k, "1")) if re.fullmatch(r"\d{1,9}", a.get(k, "1")) else 1 for k in ("colspan", "rowspan"))
            element.span = min(max(across, 1), 1000), min(below, 65534)
        elif name in BLOCK:
            self.flow.block(name in SPACED and not (name in ("ul", "ol") and self.items))
            if name in ("ul", "ol", "menu", "dir"):
                self.items += 1
                start = a.get("start", "1")
                element.number = int(start) if name == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if name == "ol" else None
            elif name == "li":
                self._marker(a)
            elif name == "pre":
                self.pre += 1

    def _marker(self, a: dict[str, str]) -> None:
        at = self.last(("ul", "ol", "menu", "dir"))
        owner = self.stack[at] if at >= 0 else None
        self.flow.lead = "- "
        if owner is not None and owner.number is not None:
            if re.fullmatch(r"-?\d{1,9}", a.get("value", "")):
                owner.number = int(a["value"])
            self.flow.lead = f"{owner.number}. "
            owner.number += 1
        if self.stack[-1].invisible:
            self.flow.lead = ""

    def _pop(self) -> str:
        e = self.stack.pop()
        self.opened[e.name].pop()
        if e.unseen:
            return e.name
        if e.outer is not None:
            self._close_choice(e)
        elif e.name == "text" and self.opened.get("svg"):
            self.flow.space = True
        elif e.name == "optgroup" and self.opened.get("select"):
            pass
        elif e.name == "table":
            table = self.tables.pop()
            self.flow = table.outer
            for line in _aligned(table):
                self.flow.text(line, "", True)
                self.flow.end()
            self.flow.block(True)
        elif e.name in ("thead", "tbody", "tfoot") and self.tables:
            self.tables[-1].parts.append(len(self.tables[-1].rows))
        elif e.name in ("td", "th", "caption"):
            lines = self.flow.closed()
            table = self.tables[-1]
            self.flow = table.outer
            if e.name == "caption":
                for line in lines:
                    self.flow.text(line, "", True)
                    self.flow.end()
            else:
                table.rows[-1].append((lines, e.span))
        elif e.name in BLOCK:
            if e.name in ("ul", "ol", "menu", "dir"):
                self.items -= 1
            elif e.name == "pre":
                self.pre -= 1
            elif e.name == "li":
                self.flow.lead = ""
            self.flow.block(e.name in SPACED and not (e.name in ("ul", "ol") and self.items))
        return e.name

    def _close_choice(self, e: Element) -> None:
        """End an option, whose text goes to its select, or a select, which shows one option, or all on lines of their own."""
        lines, self.flow = self.flow.closed(), e.outer
        if e.name == "option":
            chosen, free, label = e.choice
            label = "" if e.invisible else label
            owner = next((self.stack[i] for i in reversed(self.opened["select"]) if self.stack[i].options is not None), None)
            if owner is not None:
                owner.options.append((chosen, free, label or " ".join(" ".join(lines).split())))
        elif e.number:
            self.flow.end()
            for *_, label in e.options:
                self.flow.text(label, self._indent(), False)
                self.flow.end()
        else:
            shown = [o for o in e.options if o[0]][-1:] or [o for o in e.options if o[1]][:1]
            self.flow.space = True
            for *_, label in shown:
                self.flow.text(label, self._indent(), False)
            self.flow.space = True

    def _indent(self) -> str:
        lead = max(len(self.flow.lead), 2) if self.items else 0
        return "  " * (self.items - 1) + " " * lead if self.items else ""

    def _in_graphic(self) -> bool:
        """Whether text here is inside an svg, but in no part of it that shows text."""
        return bool(self.opened.get("svg")) and self.stack[self.last(("svg", "text", "foreignobject"))].name == "svg"

    def text(self, text: str) -> None:
        above = self.stack[-1] if self.stack else None
        blank = not text.strip(" \t\n\r\f")
        if above and (above.unseen or (above.name == "details" and above.number == 0)):
            if not (above.name == "head" and not blank):
                return
            self._leave_head()
        if above and above.invisible:
            self.flow.space = True
            return
        if above and blank and above.name in ("table", "tr", "thead", "tbody", "tfoot", "html", "ul", "ol"):
            return
        if self._in_graphic():
            return
        if "&" in text:
            text = html.unescape(text)
        # text right inside a table belongs before it
        flow = self.tables[-1].outer if above and above.name in ("table", "tr", "thead", "tbody", "tfoot") and self.tables else self.flow
        flow.text(text, self._indent(), self.pre > 0)


def visible_text(source: str) -> str:
    """The visible text of one page; empty for a page that shows none."""
    page, at, end = Page(), 0, len(source)
    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            page.text(source[at:])
            break
        if m.start() > at:
            page.text(source[at:m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:
            page.finish(name)
            continue
        page.start(name, m[3] or "")
        if name == "plaintext":
            page.text(source[at:])
            break
        if name in RAW and page.stack and page.stack[-1].name == name:
            close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            media = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in ATTRIBUTE.finditer(m[3] or "")}.get("media", "all")
            if name == "style" and media.lower() in ("", "all", "screen") and not page.opened.get("template"):
                page.sheet(source[at:close.start() if close else end])
            at = close.start() if close else end
            if not close:
                page.finish(name)
        elif name == "pre" and source.startswith("\n", at):
            at += 1
    while page.stack:
        page._pop()
    return "\n".join(page.flow.closed())


def extracted(pages: DataFrame, keep: list[str] = ["page_id", "url"]) -> DataFrame:
    """The columns ``keep`` of ``pages`` and ``text``, the visible text of ``html``, for each row; null for a null page.

    An empty page gives an empty text, an empty table no rows. Rows that repeat are worked out one by one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                texts = [None if h is None else visible_text(h) for h in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*keep, "text"])

    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep), "text string"])
    return pages.select(F.col("html").cast("string").alias("__html"), *keep).mapInArrow(run, schema)
