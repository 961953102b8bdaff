"""HTML extraction by layout: the visible text of a page as a browser would lay it out in plain text.

A page is cut into tags and text; a stack of open elements adds the tags that HTML implies (paragraphs end at
blocks, list items at the next item, rows and cells at the next row or cell, the head at the first content) and drops end
tags that match nothing. Text goes to flows: the page, a list item, a quotation, a table cell. White space
collapses across inline elements, blocks begin lines, paragraphs and headings stand apart by a blank line, list
items carry their mark and indentation, cells of a table are aligned in columns.

Not visible, by element, attribute or style: head, scripts, styles, templates, embedded media, closed details and dialogs,
``hidden``, ``display: none`` and ``visibility: hidden``, in ``style`` or in style sheets, as the cascade has them: importance,
layer, specificity and order. Only rules that surely hold on an ordinary screen (``SCREEN``) hide: for selectors of one element,
without combinators. Rules that may hold, for their medium or their selector, show what others hide, so that in doubt text stays.

SVG and MathML are read by their own rules (``/>`` ends an element, HTML tags that cannot stand there end all). Shown are SVG
``text`` and ``foreignObject``, each text apart, and the tokens of formulas with blanks between them; not titles, descriptions
and annotations. Texts of definitions are shown where they stand if the page may refer to them.
Columns over ``WIDEST`` characters are not padded, so one long cell does not widen every row; no text is cut.
Work is linear in the page and uses no recursion, so depth and unclosed tags do no harm.

A null page has null text and title; an empty one has empty text. Columns named like an output are replaced.
Pages are independent: no shuffle, and copies are worked on where they are.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablewise.llm import texts
from tablewise.llm.common import without

WIDEST = 200
INDENT = "  "

# Fixed values of HTML: groups of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound frame keygen".split())
RAW = frozenset("script style xmp iframe noembed noframes title textarea plaintext".split())
HIDDEN = frozenset(
    "head script style template title iframe noembed noframes object video audio canvas datalist rp map "
    "area base link meta param source track col colgroup".split()
)
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre "
    "search section summary table ul xmp caption".split()
)
APART = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre listing xmp plaintext table figure fieldset menu dir hr".split())
ENDS_P = BLOCK - frozenset("body html option optgroup caption legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("thead tbody tfoot".split())
PREFORMATTED = frozenset("pre listing xmp plaintext textarea".split())
# Foreign elements are named with their space; points are those that hold HTML or text.
POINTS = frozenset("svg:foreignobject svg:desc svg:title math:mi math:mo math:mn math:ms math:mtext".split())
TOKENS = frozenset("math:mi math:mo math:mn math:ms math:mtext".split())
FOREIGN_HIDDEN = frozenset("svg:title svg:desc svg:metadata svg:style svg:script math:style math:script".split())
DEFINITIONS = frozenset(("svg:defs", "svg:symbol"))
LEAVES = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
    "pre ruby s small span strong strike sub sup table tt u ul var".split()
)
SCOPE = frozenset("table td th caption html template object math:annotation-xml".split()) | POINTS

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)?(\s*=\s*)?""")
_SPACE = re.compile(r"[ \t\n\f\r]+")
# Widths and heights of ordinary screens in pixels, smallest and largest: what differs between them is in doubt.
SCREEN = {"width": (1280, 1920), "height": (720, 1080)}
_NOISE = re.compile(
    r"""/\*.*?(?:\*/|$)|<!--|-->|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|url\(\s*[^"'\s)][^)]*\)?|\\([0-9a-f]{1,6})\s?|\\(.)""", re.S | re.I
)
_PIECE = re.compile(r"([^{};]*)([{};]|$)")
_MEDIUM = re.compile(r"(?:(not|only)\s+)?([\w-]*)(.*)", re.S)
_FEATURE = re.compile(r"\(\s*(?:(min|max)-)?(?:device-)?([\w-]+)\s*(?::\s*([\d.]+)?\s*([\w-]*)\s*)?\)")
_HAS_ATTRIBUTE = re.compile(r"\[\s*([^][\s=~|^$*]+)\s*\]|\[[^]]*\]?")
_COMBINATOR = re.compile(r"\s*([\s>+~])\s*")
_SIMPLE = re.compile(r"(::?|[.#\1]?)([^\s.#:\0\1*&]+)|([\0*&])")
_AT_REST = frozenset("hover active focus focus-within focus-visible target target-within before after first-line first-letter".split())
_NO_RULES = frozenset("keyframes font-face page property counter-style font-feature-values font-palette-values view-transition".split())
_IMPLIED = frozenset("html body tbody".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def tokens(source: str, foreign=lambda: False):
    """(kind, name, attributes or text): kinds are open, close, text, raw and data. Comments are dropped.

    ``/`` is an attribute of tags that end in it; ``foreign`` tells whether the open element is one of SVG or MathML.
    """
    at, end = 0, len(source)
    while at < end:
        tag = source.find("<", at)
        if tag < 0:
            yield "text", "", source[at:]
            return
        if tag > at:
            yield "text", "", source[at:tag]
        m = _OPEN.match(source, tag)
        if not m:
            if source.startswith("<!--", tag):
                stop = source.find("-->", tag + 2)
                at = end if stop < 0 else stop + 3
            elif source.startswith("<![CDATA[", tag) and foreign():
                stop = source.find("]]>", tag)
                yield "data", "", source[tag + 9 : stop if stop >= 0 else end]
                at = end if stop < 0 else stop + 3
            elif source[tag + 1 : tag + 2] in ("!", "?", "/"):
                stop = source.find(">", tag)
                at = end if stop < 0 else stop + 1
            else:
                yield "text", "", "<"
                at = tag + 1
            continue
        name, at = m.group(2).lower(), m.end()
        attributes: dict[str, str] = {}
        bare = -1  # the end of a value without quotes, whose slash is its own
        while at < end and source[at] != ">":
            a = _ATTRIBUTE.match(source, at)
            at = a.end()
            if a.group(1) is None and a.group(2) is None:
                if at < end and source[at] != ">":
                    at += 1
                continue
            value = ""
            if a.group(2):
                quote = source[at : at + 1]
                if quote in ('"', "'"):
                    stop = source.find(quote, at + 1)
                    if stop < 0:
                        return  # an unclosed value swallows the rest of the page
                    value, at = source[at + 1 : stop], stop + 1
                else:
                    stop = at
                    while stop < end and source[stop] not in " \t\n\f\r>":
                        stop += 1
                    value, at = source[at:stop], stop
                    bare = stop
            attributes.setdefault((a.group(1) or "").lower(), html.unescape(value))
        if at >= end:
            return
        if source[at - 1] == "/" and at != bare:
            attributes["/"] = ""
        at += 1
        if m.group(1):
            yield "close", name, attributes
            continue
        yield "open", name, attributes
        if name in RAW and not foreign():
            stop = None if name == "plaintext" else _RAW_END[name].search(source, at)
            body = source[at : stop.start()] if stop else source[at:]
            yield "raw", name, html.unescape(body) if name in ("title", "textarea") else body
            at = stop.start() if stop else end
            if not stop:
                yield "close", name, {}


def _width(text: str) -> int:
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = self.blank = False

    def text(self, text: str) -> None:
        collapsed = _SPACE.sub(" ", text)
        if collapsed.startswith(" "):
            self.space = True
        body = collapsed.strip(" ")
        if not body:
            return
        if self.space and self.parts:
            self.parts.append(" ")
        self.parts.append(body)
        self.space = collapsed.endswith(" ")

    def preformatted(self, text: str) -> None:
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = False
        first, *rest = text.split("\n")
        if first:
            self.parts.append(first)
        for line in rest:
            self.line(True)
            if line:
                self.parts.append(line)

    def line(self, even_empty: bool = False) -> None:
        """End the line; an empty one only counts where the page asks for it."""
        if self.parts or even_empty:
            self._gap()
            self.lines.append("".join(self.parts).replace("\xa0", " ").replace("\xad", "").rstrip())
            self.parts = []
        self.space = False

    def apart(self) -> None:
        self.line()
        self.blank = True

    def add(self, lines: list[str], first: str = "", rest: str = "") -> None:
        self.line()
        while lines and not lines[-1]:
            lines.pop()
        if not lines and not first.strip():
            return
        self._gap()
        self.lines.append((first + (lines[0] if lines else "")).rstrip())
        self.lines.extend((rest + x).rstrip() for x in lines[1:])

    def _gap(self) -> None:
        if self.blank and self.lines and self.lines[-1]:
            self.lines.append("")
        self.blank = False

    def done(self) -> list[str]:
        self.line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _number(value: str | None, default: int, low: int, high: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,9})", value or "")
    return min(max(int(m.group(1)), low), high) if m else default


class Table:
    """Rows of cells, laid out when the table ends."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.busy: dict[int, int] = {}  # column -> rows that a cell above still covers
        self.caption: list[str] = []

    def row(self) -> None:
        if self.rows:
            self.busy = {c: n - 1 for c, n in self.busy.items() if n > 1}
        self.rows.append([])
        self.next = 0

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        while self.busy.get(self.next, 0) > 0:
            self.next += 1
        self.rows[-1].append((self.next, columns, lines))
        if rows > 1:
            for c in range(self.next, self.next + columns):
                self.busy[c] = rows
        self.next += columns

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        wide = []
        for row in self.rows:
            for column, span, lines in row:
                width = max(map(_width, lines), default=0)
                if width > WIDEST:
                    continue
                if span == 1:
                    widths[column] = max(widths.get(column, 0), width)
                else:
                    wide.append((column, span, width))
        for column, span, width in wide:
            has = sum(widths.get(c, 0) for c in range(column, column + span)) + len(INDENT) * (span - 1)
            if has < width:
                widths[column + span - 1] = widths.get(column + span - 1, 0) + width - has
        at, place = {}, 0
        for column in range(max([*widths, *(c for row in self.rows for c, _, _ in row)], default=-1) + 1):
            at[column] = place
            place += widths.get(column, 0) + (len(INDENT) if widths.get(column, 0) else 0)
        out = list(self.caption)
        for row in self.rows:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                parts, length = [], 0
                for column, _, lines in row:
                    if i < len(lines) and lines[i]:
                        pad = max(at[column] - length, len(INDENT) if length else 0)
                        parts.append(" " * pad + lines[i])
                        length += pad + _width(lines[i])
                out.append("".join(parts))
        return out


def _plain(m: re.Match) -> str:
    """Style sheet text without comments and strings; an escaped character stands apart from the signs of selectors."""
    if not (m.group(1) or m.group(2)):
        return ""
    code = int(m.group(1), 16) if m.group(1) else ord(m.group(2))
    if not 0 < code < 0x110000 or 0xD800 <= code < 0xE000:
        code = 0xFFFD
    return chr(0xE000 + code if code < 128 else code)


def _name(text: str) -> str:
    return "".join(chr(ord(c) - 0xE000) if "\ue000" <= c <= "\ue07f" else c for c in text)


def _both(a: bool | None, b: bool | None) -> bool | None:
    """And of what holds (true), does not (false) or is in doubt (none)."""
    return False if a is False or b is False else None if a is None or b is None else True


def _medium(queries: str) -> bool | None:
    """Whether a list of media queries holds on ordinary screens; none if that is in doubt."""
    found = []
    for query in queries.lower().split(","):
        sign, kind, features = _MEDIUM.match(query.strip()).groups()
        holds: bool | None = kind in ("", "all", "screen")
        for feature in _FEATURE.finditer(features):
            bound, name, value, unit = feature.groups()
            holds = _both(holds, _feature(bound, name, value, unit))
        if _FEATURE.sub("", features).replace("and", "").strip():
            holds = _both(holds, None)
        found.append((None if holds is None else not holds) if sign == "not" else holds)
    return True if True in found else None if None in found else False


def _feature(bound: str | None, name: str, value: str | None, unit: str) -> bool | None:
    if name not in SCREEN or not bound or not re.fullmatch(r"\d*\.?\d+", value or "") or unit not in ("px", "em", "rem", ""):
        return None
    low, high = SCREEN[name]
    pixels = float(value) * (1 if unit in ("px", "") else 16)
    if bound == "min":
        return True if pixels <= low else False if pixels > high else None
    return True if pixels >= high else False if pixels < low else None


def _selectors(text: str) -> list[str]:
    """The selectors of a list; conditions in brackets that are not read become one sign."""
    out, depth = [], 0
    for c in _HAS_ATTRIBUTE.sub(lambda m: f"\1{m.group(1)}" if m.group(1) else "\0", text):
        if c == "(":
            depth += 1
            out.append("\0")
        elif c == ")":
            depth = max(depth - 1, 0)
        elif not depth:
            out.append(c)
    return [x.strip() for x in "".join(out).split(",")]


def _declared(text: str) -> tuple[str, str, bool] | None:
    """Property, value and importance of a declaration of display or visibility."""
    name, _, value = text.partition(":")
    if (name := name.strip().lower()) not in ("display", "visibility"):
        return None
    value, _, sign = value.lower().partition("!")
    return (name, value.strip(), sign.strip() == "important") if value.strip() else None


class Rules:
    """What the style sheets of a page say of display and visibility, by a name, class, id or attribute that is needed."""

    def __init__(self):
        self.by_key: dict[str, dict[tuple, tuple]] = {}
        self.layers: dict[str, int] = {}
        self.count = 0

    def read(self, sheet: str, medium: str = "") -> None:
        holds = _medium(medium) if medium.strip() else True
        stack: list[tuple] = [(None, holds, None)]  # selectors, whether they hold, layer
        for m in _PIECE.finditer(_NOISE.sub(_plain, sheet)):
            text, stop = m.group(1).strip(), m.group(2)
            selectors, holds, layer = stack[-1]
            if stop == "{":
                stack.append(self.block(text, selectors, holds, layer))
                continue
            if text[:6].lower() == "@layer":
                for name in text[6:].split(","):
                    self.layers.setdefault(name.strip(), len(self.layers))
            elif selectors and holds is not False and (found := _declared(text)):
                for selector in selectors:
                    self.add(selector, holds, layer, *found)
            if stop == "}" and len(stack) > 1:
                stack.pop()

    def block(self, text: str, selectors: list[str] | None, holds: bool | None, layer: int | None) -> tuple:
        if not text.startswith("@"):
            return self.nested(_selectors(text), selectors), holds, layer
        name, rest = re.match(r"@(?:-\w+-)?([\w-]*)(.*)", text, re.S).groups()
        if (name := name.lower()) == "media":
            return selectors, _both(holds, _medium(rest)), layer
        if name == "layer":
            return selectors, holds, self.layers.setdefault(rest.strip() or f" {len(self.layers)}", len(self.layers))
        return selectors, False if name in _NO_RULES else _both(holds, None), layer

    def nested(self, inner: list[str], outer: list[str] | None) -> list[str]:
        if not outer:
            return inner
        parent = outer[0] if len(outer) == 1 and len(outer[0]) < 1000 else "\0"
        return [x.replace("&", parent, 1) if "&" in x else f"{parent} {x}" for x in inner]

    def add(self, selector: str, holds: bool | None, layer: int | None, name: str, value: str, important: bool) -> None:
        if not selector:
            return
        parts = _COMBINATOR.split(selector)
        sure = holds is True and len(parts) == 1
        weight, above, need = [0, 0, 0], set(), set()
        for i in range(0, len(parts), 2):
            need = set()
            for sign, word, other in _SIMPLE.findall(parts[i]):
                if other:
                    sure &= other == "*"
                    weight[0] += other == "\0"
                elif sign in (":", "::"):
                    if sign == "::" or word.lower() in _AT_REST:
                        return
                    sure = False
                    weight[1] += 1
                else:
                    need.add(sign + (_name(word) if sign in (".", "#") else _name(word).lower()))
                    weight[0 if sign == "#" else 1 if sign else 2] += 1
            if i + 1 < len(parts) and parts[i + 1] not in "+~":
                above |= need - _IMPLIED
        if not sure and value in ("none", "hidden", "collapse"):
            return
        self.count += 1
        key = min(need, key=lambda k: (len(self.by_key.get(k, ())), k), default="*")
        place = 10**9 if layer is None else layer  # what is in no layer comes after all layers
        rank = (important, False, -place if important else place, *weight, self.count)
        what = (frozenset(need), frozenset(above), name, important, layer)
        self.by_key.setdefault(key, {})[what] = (rank, value)


class Element:
    __slots__ = ("name", "gone", "shown", "flow", "table", "count", "step", "mark", "spans", "pre", "summary", "keys", "space", "drawn")

    def __init__(self, name, gone, shown, flow, pre):
        self.name, self.gone, self.shown, self.flow, self.pre = name, gone, shown, flow, pre
        self.table = self.count = self.mark = self.spans = None
        self.step, self.summary, self.keys = 1, False, ()
        self.space, self.drawn = "", True  # svg, math or HTML; whether its text is shown


class Page:
    """The stack of open elements and the flows they write to."""

    def __init__(self, rules: Rules | None = None):
        self.flow = Flow()
        self.stack = [Element("html", False, True, self.flow, False)]
        self.open_count: dict[str, int] = {"html": 1}
        self.rules, self.known = rules or Rules(), rules is not None
        self.medium: str | None = ""  # of the style sheet that is open
        self.begun = self.late = False  # late: rules came after elements they may be meant for
        self.open_keys: dict[str, int] = {}
        self.sheet: list[str] = []
        self.source, self.refers, self.first_token = "", None, True
        self.title: str | None = None

    # --- tree -----------------------------------------------------------------------------------

    def has(self, name: str, stop: frozenset) -> bool:
        if not self.open_count.get(name):
            return False
        for e in reversed(self.stack):
            if e.name == name:
                return True
            if e.name in stop:
                return False
        return False

    def close_to(self, name: str) -> None:
        while self.stack[-1].name != name:
            self.pop()
        self.pop()

    def feed(self, source: str) -> None:
        self.source = source
        for kind, name, value in tokens(source, lambda: self.stack[-1].space != ""):
            if kind == "open":
                self.open(name, value)
            elif kind == "close":
                self.close(name)
            elif kind == "raw":
                self.raw(name, value)
            elif kind == "data":
                self.text(value)
            else:
                self.text(html.unescape(value))
        while len(self.stack) > 1:
            self.pop()

    def open(self, name: str, attributes: dict[str, str]) -> None:
        top = self.stack[-1]
        if top.space and not self.holds_html(top, name):
            if name not in LEAVES and not (name == "font" and attributes.keys() & {"color", "face", "size"}):
                self.push_foreign(top.space, name, attributes)
                return
            self.leave()
            top = self.stack[-1]
        if name in ("html", "body") and (name == "html" or self.open_count.get("body")):
            for key in self.keys(name, attributes):
                self.open_keys[key] = self.open_keys.get(key, 0) + 1
            return
        if top.name == "head" and name not in HEAD:
            self.pop()
        if name in ("svg", "math"):
            self.push_foreign(name, name, attributes)
            return
        if name in ENDS_P and self.has("p", SCOPE):
            self.close_to("p")
        if name == "li" and self.has("li", SCOPE | LISTS):
            self.close_to("li")
        elif name in ("dd", "dt"):
            for other in ("dd", "dt"):
                if self.has(other, SCOPE | {"dl"}):
                    self.close_to(other)
        elif name in HEADINGS and self.stack[-1].name in HEADINGS:
            self.pop()
        elif name in ("option", "optgroup") and self.stack[-1].name == "option":
            self.pop()
        if name == "optgroup" and self.stack[-1].name == "optgroup":
            self.pop()
        if name in ("td", "th", "tr", "caption") or name in SECTIONS:
            if not self.open_count.get("table"):
                return
            self.end_cells(name)
            if name in ("td", "th") and self.stack[-1].name != "tr":
                self.push("tr", {})
        self.push(name, attributes)
        if name in VOID:
            self.pop()

    def end_cells(self, name: str) -> None:
        """Close what a new cell, row or section of the innermost table ends."""
        keeps = {"td": ("tr", "table"), "th": ("tr", "table"), "tr": (*SECTIONS, "table")}.get(name, ("table",))
        while self.stack[-1].name not in keeps:
            if self.stack[-1].name in SECTIONS and name in ("td", "th"):
                return
            self.pop()

    # --- SVG and MathML -------------------------------------------------------------------------

    @staticmethod
    def holds_html(top: Element, name: str) -> bool:
        """Whether a tag in a foreign element is read as HTML."""
        if top.name == "math:annotation-xml":
            return name == "svg" or top.mark == "html"
        return top.name in POINTS and not (top.space == "math" and name in ("mglyph", "malignmark"))

    def leave(self) -> None:
        while self.stack[-1].space and not self.holds_html(self.stack[-1], ""):
            self.pop()

    def push_foreign(self, space: str, local: str, attributes: dict[str, str]) -> None:
        top, name = self.stack[-1], f"{space}:{local}"
        keys = self.keys(local, attributes) if self.rules.by_key else ()
        gone, shown = self.visible(top, name, attributes, keys)
        if top.name in ("svg:switch", "math:semantics", "math:maction"):  # one of the children is shown
            gone = gone or top.summary
            top.summary = top.summary or not attributes.keys() & {"systemlanguage", "requiredextensions"}
        elif local in ("annotation", "annotation-xml"):
            gone = True
        if name in DEFINITIONS and not gone:
            if self.refers is None:
                self.refers = re.search(r"<use[\s/>]|url\(\s*[\"']?#", self.source, re.I) is not None
            gone = not self.refers
        e = Element(name, gone or name in FOREIGN_HIDDEN, shown and name != "math:mphantom", top.flow, False)
        e.space, e.keys = space, keys
        e.drawn = space == "math" or local in ("text", "foreignobject") or (local != "svg" and top.drawn and top.space == "svg" and top.name not in POINTS)
        for key in keys:
            self.open_keys[key] = self.open_keys.get(key, 0) + 1
        if local == "style":
            self.style(attributes)
        elif name == "math:annotation-xml" and attributes.get("encoding", "").lower() in ("text/html", "application/xhtml+xml"):
            e.mark = "html"
        self.begun = True
        self.stack.append(e)
        self.open_count[name] = self.open_count.get(name, 0) + 1
        if not e.gone:
            if name == "math:math":
                self.first_token = True
                if attributes.get("display", "").lower() == "block":
                    e.mark = "block"
                    e.flow.line()
            elif name in TOKENS:
                e.flow.space = e.flow.space or not self.first_token
                self.first_token = False
            elif name in ("svg:text", "svg:foreignobject") or (name == "svg:tspan" and attributes.keys() & {"x", "y", "dx", "dy"}):
                e.flow.space = True
        if "/" in attributes:
            self.pop()

    def close_foreign(self, name: str) -> bool:
        """Whether an end tag is one of the foreign elements that are open."""
        if name in ("p", "br") and not self.holds_html(self.stack[-1], ""):
            self.leave()
            return False
        if self.open_count.get("svg:" + name) or self.open_count.get("math:" + name):
            for e in reversed(self.stack):
                if not e.space:
                    return False
                if e.name == f"{e.space}:{name}":
                    while self.stack[-1] is not e:
                        self.pop()
                    self.pop()
                    return True
        return False

    # --- elements -------------------------------------------------------------------------------

    def style(self, attributes: dict[str, str]) -> None:
        kind = attributes.get("type", "").strip().lower()
        self.medium = attributes.get("media", "") if kind in ("", "text/css") and not self.open_count.get("template") else None

    def read_sheet(self, sheet: str) -> None:
        if self.medium is not None and not self.known:
            before = self.rules.count
            self.rules.read(sheet, self.medium)
            self.late = self.late or (self.begun and self.rules.count > before)

    def push(self, name: str, attributes: dict[str, str]) -> None:
        top = self.stack[-1]
        keys = self.keys(name, attributes) if self.rules.by_key else ()
        gone, shown = self.visible(top, name, attributes, keys)
        e = Element(name, gone, shown, top.flow, top.pre or name in PREFORMATTED)
        e.keys = keys
        for key in keys:
            self.open_keys[key] = self.open_keys.get(key, 0) + 1
        if name == "style":
            self.style(attributes)
        self.begun = self.begun or not (name == "head" or name in HEAD)
        self.stack.append(e)
        self.open_count[name] = self.open_count.get(name, 0) + 1
        if gone:
            return
        flow = top.flow
        if name == "br":
            flow.line(True)
        elif name == "input" and attributes.get("type", "").lower() in ("submit", "button", "reset"):
            flow.text(attributes.get("value", ""))
        elif name in ("td", "th", "caption"):
            e.flow = Flow()
            e.spans = (_number(attributes.get("colspan"), 1, 1, 1000), _number(attributes.get("rowspan"), 1, 0, 65534) or 65534)
        elif name == "table":
            e.table = Table()
            e.flow = Flow()  # what stands in a table outside its cells comes before it
        elif name == "tr":
            if table := self.table():
                table.row()
        elif name == "li":
            e.flow = Flow()
            e.mark = self.mark(attributes)
        elif name in ("blockquote", "dd"):
            e.flow = Flow()
        elif name == "details":
            e.mark = "open" if "open" in attributes else "closed"
            flow.line()
        elif name in LISTS:
            e.count = _number(attributes.get("start"), 1, -(10**9), 10**9) if name == "ol" else None
            e.step = -1 if name == "ol" and "reversed" in attributes else 1
            if self.open_count.get("li"):
                flow.line()
            else:
                flow.apart()
        elif name in APART:
            flow.apart()
        elif name in BLOCK:
            flow.line()
        if name in PREFORMATTED:
            e.mark = "fresh"

    def keys(self, name: str, attributes: dict[str, str]) -> set[str]:
        """What selectors can ask of an element."""
        keys = {name, *("\1" + a for a in attributes), *("." + c for c in attributes.get("class", "").split())}
        return keys | {"#" + attributes["id"]} if "id" in attributes else keys

    def visible(self, top: Element, name: str, attributes: dict[str, str], keys: set[str]) -> tuple[bool, bool]:
        gone, shown = top.gone or name in HIDDEN, top.shown
        if top.name == "details" and not (name == "summary" and not top.summary):
            gone = gone or top.mark == "closed"
        if top.name == "details" and name == "summary":
            top.summary = True
        if not attributes and not keys:
            return gone or name == "dialog", shown
        best: dict[str, tuple] = {}
        if name.startswith("svg:"):
            for what in ("display", "visibility"):
                if value := attributes.get(what, "").strip().lower():
                    best[what] = ((False, False, -1, 0, 0, 0, 0), value)
        for key in (*keys, "*") if keys else ():
            for (need, above, what, *_), found in self.rules.by_key.get(key, {}).items():
                if need <= keys and (what not in best or found > best[what]) and all(self.open_keys.get(k) for k in above):
                    best[what] = found
        for i, text in enumerate(_NOISE.sub(_plain, attributes.get("style", "")).split(";")):
            if declared := _declared(text):
                what, value, important = declared
                found = ((important, True, 0, 0, 0, 0, i), value)
                if what not in best or found > best[what]:
                    best[what] = found
        if "display" in best:
            gone = gone or best["display"][1] == "none"
        elif ":" not in name:
            gone = gone or "hidden" in attributes or (name == "dialog" and "open" not in attributes)
        visibility = best["visibility"][1] if "visibility" in best else ""
        if visibility in ("hidden", "collapse", "visible", "initial"):
            shown = visibility in ("visible", "initial")
        return gone, shown

    def table(self) -> Table | None:
        return next((e.table for e in reversed(self.stack) if e.name == "table"), None)

    def mark(self, attributes: dict[str, str]) -> str:
        parent = next((e for e in reversed(self.stack[:-1]) if e.name in LISTS), None)
        if parent is None or parent.count is None:
            return "- "
        parent.count = _number(attributes.get("value"), parent.count, -(10**9), 10**9)
        parent.count += parent.step
        return f"{parent.count - parent.step}. "

    def pop(self) -> None:
        e = self.stack.pop()
        self.open_count[e.name] -= 1
        for key in e.keys:
            self.open_keys[key] -= 1
        if e.space:
            if e.name.endswith(":style"):
                self.read_sheet("".join(self.sheet))
                self.sheet = []
            elif not e.gone and e.mark == "block":
                e.flow.line()
            elif not e.gone and e.name in ("svg:text", "svg:foreignobject"):
                e.flow.space = True
            return
        if e.gone or not self.stack:
            return
        flow = self.stack[-1].flow
        if e.name in ("td", "th"):
            if table := self.table():
                table.cell(e.flow.done(), *e.spans)
        elif e.name == "caption":
            if table := self.table():
                table.caption.extend(e.flow.done())
        elif e.name == "table":
            flow.add(e.flow.done())
            flow.add(e.table.lines())
            flow.apart()
        elif e.name == "li":
            flow.add(e.flow.done(), e.mark, " " * len(e.mark))
        elif e.name in ("blockquote", "dd"):
            flow.add(e.flow.done(), INDENT, INDENT)
            if e.name == "blockquote":
                flow.apart()
        elif e.name in LISTS and self.open_count.get("li"):
            flow.line()
        elif e.name in APART:
            flow.apart()
        elif e.name in BLOCK:
            flow.line()

    def close(self, name: str) -> None:
        if self.stack[-1].space and self.close_foreign(name):
            return
        if name in ("html", "body"):
            return
        if name == "br":
            self.open("br", {})
        elif name == "p" and not self.has("p", SCOPE):
            if not self.stack[-1].gone:
                self.stack[-1].flow.apart()
        elif name in ("table", "tr", "td", "th", "caption") or name in SECTIONS:
            if self.has(name, frozenset({"table"}) if name != "table" else frozenset()):
                self.close_to(name)
        elif name in HEADINGS:
            open_ = next((e.name for e in reversed(self.stack) if e.name in HEADINGS or e.name in SCOPE), "")
            if open_ in HEADINGS:
                self.close_to(open_)
        elif self.has(name, SCOPE):
            self.close_to(name)

    # --- text -----------------------------------------------------------------------------------

    def raw(self, name: str, body: str) -> None:
        if name == "title" and self.title is None:
            self.title = _SPACE.sub(" ", body).strip(" ")
        elif name == "style":
            self.read_sheet(body)
        elif name in ("textarea", "xmp", "plaintext"):
            self.text(body)

    def text(self, text: str) -> None:
        top = self.stack[-1]
        if top.name == "head" and text.strip():
            self.pop()
            top = self.stack[-1]
        if top.name in ("svg:style", "math:style"):
            self.sheet.append(text)
        if top.space == "math" and top.name not in TOKENS and not text.strip():
            return
        if top.gone or not top.shown or not top.drawn or (top.name == "details" and top.mark == "closed"):
            return
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
        if top.pre:
            if top.mark == "fresh":  # a newline right after the tag does not count
                text, top.mark = text.removeprefix("\n"), None
            top.flow.preformatted(text)
        else:
            top.flow.text(text)


def render(source: str) -> tuple[str | None, str]:
    """Title and visible text of a page."""
    page = Page()
    page.feed(source)
    if page.late:
        page = Page(page.rules)
        page.feed(source)
    return page.title, "\n".join(page.flow.done())


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """``df`` with title and text in place of the page."""
    kept = without(df, ["title", "text", column])
    source = df.select(*[df[c] for c in kept], df[column].cast("string").alias("__html"))
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = [(None, None) if page is None else render(page) for page in part.column(len(kept)).to_pylist()]
                columns = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(kept))), *columns], names=[f.name for f in schema])

    return source.mapInArrow(texts.lean(run), schema)
