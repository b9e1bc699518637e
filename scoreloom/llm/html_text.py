"""Layout-aware text of HTML pages.

A tokenizer feeds a tree builder that closes elements whose end tags are implied (paragraphs before blocks, list items,
definition terms, rows, cells, options) and ignores end tags that match nothing open. Elements are invisible by kind
(script, style, head and the like), by attribute (hidden, closed dialogs, hidden inputs), by inline style and by simple selectors
(tag, .class, #id) of the page's own style sheets that set ``display: none`` or ``visibility: hidden`` on a screen of ``SCREEN``
pixels, where a later or more specific one of them, or the element's own style, doesn't undo it; what is visible within something of hidden
visibility is seen. The renderer emits
all visible text: white space collapsed outside ``pre``, blocks on lines of their own with a blank line around
paragraphs, headings, lists and tables, list items with their marker and indent, and table cells with the lines of their blocks, padded to their
column's width, cells that span rows or columns holding theirs. Of a closed details element only the summary is visible. Elements nested deeper than ``DEPTH`` are attached at that depth, as browsers do, so no page exhausts the stack.

A null or empty page gives an empty text; any other string gives what it says, well-formed or not. The time for a page grows with its length,
however long and deep it is, and memory is that of one page. All other columns of a row stay, but for the one that takes the text;
repeated rows give repeated rows, an empty table an empty one.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm.common import table

DEPTH = 200
MOST_COLUMNS, MOST_ROWS = 1000, 65534  # that a cell spans, by the standard
MOST_PADDING = 50  # blanks for each character of a table's text
SCREEN = (1280, 800)
# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEAD = set("title meta link base basefont bgsound style script noscript noframes template".split())
UNSEEN = set("head script style template noscript title meta link datalist object audio video canvas iframe map defs desc symbol metadata".split())
BLOCK = set("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul tr caption thead tbody tfoot".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
CONTROLS = {"option", "button", "textarea", "select", "output", "meter", "progress"}
CLOSES_P = BLOCK - {"tr", "caption", "thead", "tbody", "tfoot", "li", "dd", "dt", "body", "html", "legend"}
#: Tag that begins: open tags that it ends, and where the search for them stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
_OWN = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([^;]*)", re.I)
_WHOLE = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
_CSS = re.compile(r"""[^"'\\{};]+|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|\\.?|[{};]""", re.S)
_WIDTH = re.compile(r"(-?\d*\.?\d+)(px|em|rem|pt|cm|mm|in)?$")
_PX = {None: 1, "px": 1, "em": 16, "rem": 16, "pt": 96 / 72, "cm": 96 / 2.54, "mm": 96 / 25.4, "in": 96}
_SIMPLE = re.compile(r"([a-z][\w-]*)?([.#][\w-]+)?$", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def whole(value: str | None) -> int | None:
    """The whole number that an attribute begins with; none if there is none, or one of over nine digits."""
    m = _WHOLE.match(value or "")
    return int(m[1]) if m else None


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open, self.css = [self.root], []
        self.at: dict[str, list[int]] = {}  # where in ``open`` each tag stands, ascending

    def _cut(self, k: int) -> None:
        while len(self.open) > k:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if tag in BLOCK:
                self.at["#block"].pop()

    def _nearest(self, tags: set[str]) -> int:
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=0)

    def _end_open(self, tags: set[str], stops: set[str]) -> None:
        """Closes the outermost of the open elements in ``tags`` above the nearest of ``stops``."""
        floor = self._nearest(stops)
        found = [own[bisect_right(own, floor)] for t in tags if (own := self.at.get(t)) and own[-1] > floor]
        if found:
            self._cut(min(found))

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED:
            self._end_open(*IMPLIED[tag])
        if tag in CLOSES_P:
            self._end_open({"p"}, {"table", "td", "th", "li", "button", "caption"})
        if self.open[-1].tag == "head" and tag not in HEAD and tag not in ("html", "head"):
            self._cut(len(self.open) - 1)
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[min(len(self.open), DEPTH) - 1].kids.append(node)
        if tag not in VOID:
            for own in (tag, "#block") if tag in BLOCK else (tag,):
                self.at.setdefault(own, []).append(len(self.open))
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash has no meaning but on void elements

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag == "p" and not self.at.get("p"):
            self.handle_starttag("p", [])
        last = self._nearest({tag})
        # An inline element isn't ended from within a block in it.
        stops = set() if tag in ("table", "body", "html", "tr", "thead", "tbody", "tfoot", "td", "th") else {"table", "td", "th"} if tag in BLOCK or tag in HEAD or tag == "head" else {"td", "th", "#block"}
        if last > self._nearest(stops):
            self._cut(last)

    def handle_data(self, data):
        top = self.open[-1]
        if top.tag == "style" and on_screen(top.attrs.get("media", "")):
            self.css.append(data)
        if top.tag == "head" and data.strip(" \t\n\r\f"):
            self._cut(len(self.open) - 1)
        self.open[min(len(self.open), DEPTH) - 1].kids.append(data)


def _pixels(value: str) -> float | None:
    m = _WIDTH.match(value.strip())
    return float(m[1]) * _PX[m[2]] if m else None


def _feature(text: str) -> bool | None:
    """Whether one media feature holds on the screen; None if it isn't known."""
    size = {"width": SCREEN[0], "height": SCREEN[1], "device-width": SCREEN[0], "device-height": SCREEN[1]}
    fixed = {"orientation": "landscape", "prefers-color-scheme": "light", "prefers-reduced-motion": "no-preference", "hover": "hover", "any-hover": "hover", "pointer": "fine", "any-pointer": "fine", "scripting": "enabled"}
    name, colon, value = (x.strip() for x in text.partition(":"))
    if colon:
        side, plain = (name[:3], name[4:]) if name[:4] in ("min-", "max-") else ("", name)
        if plain in size:
            n = _pixels(value)
            return None if n is None else size[plain] >= n if side == "min" else size[plain] <= n if side == "max" else size[plain] == n
        return fixed[name] == value if name in fixed else None
    terms = re.split(r"(<=|>=|<|>|=)", text)
    if len(terms) in (3, 5):
        n = [size.get(x.strip(), _pixels(x)) for x in terms[::2]]
        holds = {"<=": float.__le__, ">=": float.__ge__, "<": float.__lt__, ">": float.__gt__, "=": float.__eq__}
        return None if None in n else all(holds[op](float(x), float(y)) for x, op, y in zip(n, terms[1::2], n[1:]))
    return True if name in size or name in fixed or name == "color" else None


def _condition(text: str, types: bool = True) -> bool | None:
    """A media query without commas: types and bracketed features, joined by not, and, or. What isn't known stays so."""
    text, depth, cut, parts = text.strip(), 0, 0, []
    if text.count("(") + text.count("not") > DEPTH:
        return None
    for k, c in enumerate(text):  # at depth 0: words and brackets
        if c == "(":
            if not depth:
                parts += text[cut:k].split()
                cut = k + 1
            depth += 1
        elif c == ")" and depth:
            depth -= 1
            if not depth:
                parts.append("(" + text[cut:k])
                cut = k + 1
    parts += text[cut:].split() if not depth else ["?"]
    if parts[:1] == ["only"]:
        parts = parts[1:]
    if parts[:1] == ["not"]:
        rest = _condition(" ".join(f"{x})" if x[0] == "(" else x for x in parts[1:]), types)
        return None if rest is None else not rest
    found = [x for x in parts if x not in ("and", "or")]
    values = []
    for x in found:
        if x[0] == "(":
            inner = x[1:].strip()
            values.append(_condition(inner, False) if inner.startswith(("(", "not ", "not(")) else _feature(inner))
        else:
            values.append(x in ("all", "screen") if types and x in ("all", "screen", "print", "speech", "tty", "tv", "projection", "handheld", "braille", "embossed", "aural") else None)
    if "or" in parts:
        return True if True in values else None if None in values else False
    return False if False in values else None if None in values else True


def on_screen(media: str) -> bool:
    """Whether a list of media queries holds on a screen; an empty one does."""
    media = media.strip().lower()
    return not media or any(q.strip() and _condition(q) is True for q in media.split(","))


def hiding(css: list[str]) -> dict[tuple[str, str], dict[str, tuple[bool, int, bool]]]:
    """Per simple selector (tag, .class or #id; either may be empty) and property: whether important, place, whether it hides."""
    found: dict[tuple[str, str], dict[str, tuple[bool, int, bool]]] = {}
    place = 0

    def declare(said: str, keys: list[tuple[str, str]]) -> None:
        nonlocal place
        name, _, value = said.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if name in ("display", "visibility") and value:
            important = value.endswith("important")
            value = value.partition("!")[0].strip()
            place += 1
            for key in keys:
                known = found.setdefault(key, {})
                known[name] = max(known.get(name, (False, 0, False)), (important, place, value == "none" if name == "display" else value in ("hidden", "collapse")))

    for sheet in css:
        text = re.sub(r"/\*.*?(?:\*/|$)|<!--|-->", " ", sheet, flags=re.S)
        # Open blocks: (whether it holds, selectors that its declarations are for)
        open_: list[tuple[bool, list[tuple[str, str]]]] = [(True, [])]
        said = ""
        for token in _CSS.findall(text):
            live, keys = open_[-1]
            if token == "{":
                head = said.strip()
                word = re.match(r"@([\w-]+)", head)
                if word:
                    name, rest = word[1].lower(), head[word.end() :]
                    holds = on_screen(rest) if name == "media" else name == "layer" or (name == "supports" and "not" not in re.findall(r"[\w-]+", rest.lower()))
                    open_.append((live and holds, keys))
                else:
                    simple = [_SIMPLE.match(x.strip()) for x in head.split(",")] if not keys else []  # nested rules are for compound selectors
                    own = [((m[1] or "").lower(), m[2] or "") for m in simple if m and m[0]]
                    open_.append((live and bool(own), own))
                said = ""
            elif token in (";", "}"):
                if live and keys and said.strip():
                    declare(said, keys)
                said = ""
                if token == "}" and len(open_) > 1:
                    open_.pop()
            else:
                said += token
        if open_[-1][0] and open_[-1][1]:
            declare(said, open_[-1][1])  # the end of the sheet ends what is open
    return found


def numeral(n: int, kind: str) -> str:
    """A list item's number as digits, letters or Roman numerals, as far as they go."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n > 0:
            n, rest = divmod(n - 1, 26)
            out = chr(ord(kind) + rest) + out
        return out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
        return out if kind == "i" else out.upper()
    return str(n)


NOTHING = Node("#nothing", {})


class Renderer:
    def __init__(self, hidden: dict[tuple[str, str], dict[str, tuple[bool, int, bool]]]):
        self.hidden, self.lines, self.line, self.gap, self.indent, self.marker = hidden, [], [], False, 0, ""

    def look(self, n: Node) -> tuple[bool, bool | None]:
        """Whether an element is displayed, and whether it is made visible or hidden (none: like what it is in)."""
        a = n.attrs
        if n.tag in UNSEEN or (n.tag == "dialog" and "open" not in a) or (n.tag == "input" and a.get("type", "").lower() in ("hidden", "password", "checkbox", "radio", "file")):
            return False, None
        known: dict[str, list[tuple]] = {"display": [], "visibility": []}
        for k, (name, value) in enumerate(_OWN.findall(a.get("style", ""))):
            value, _, important = value.lower().partition("!")
            known[name.lower()].append((bool(important), True, (), k, value.strip() in ("none", "hidden", "collapse")))
        if self.hidden:
            marks = ["", *(f".{c}" for c in a.get("class", "").split()), *([f"#{a['id']}"] if a.get("id") else [])]
            for tag in ("", n.tag):
                for m in marks:
                    for name, (important, place, hides) in self.hidden.get((tag, m), {}).items():
                        known[name].append((important, False, (m[:1] == "#", m[:1] == ".", tag != ""), place, hides))
        display, visibility = (max(known[name], default=None) for name in ("display", "visibility"))
        return not (display[-1] if display else "hidden" in a), None if visibility is None else not visibility[-1]

    def flush(self) -> None:
        text = "".join(self.line).strip(" ")
        self.line = []
        if text:
            self.put(text)

    def put(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        lead = " " * max(0, self.indent - len(self.marker)) + self.marker
        self.marker = ""
        self.lines.append((lead + text).rstrip(" "))

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.line.append(first)
            for x in rest:
                done = "".join(self.line)
                self.line = []
                self.put(done)
                self.line.append(x)
            return
        s = _SPACE.sub(" ", s)
        if s.startswith(" ") and (not self.line or self.line[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.line.append(s)

    def render(self, n: Node, pre: bool = False, kind: str = "", seen: bool = True, first: int | None = None) -> None:
        """``kind``: the list that ``n`` is; ``seen``: whether it is visible; ``first``: the number of its first item."""
        step_by = -1 if kind == "ol" and "reversed" in n.attrs else 1
        if first is None:
            first = sum(isinstance(k, Node) and k.tag == "li" and self.look(k)[0] for k in n.kids) if step_by < 0 else 1
        number = first - step_by
        # Of a closed details element only its first summary is shown.
        closed = next((k for k in n.kids if isinstance(k, Node) and k.tag == "summary"), NOTHING) if n.tag == "details" and "open" not in n.attrs else None
        for kid in n.kids:
            if isinstance(kid, str):
                if seen and not closed:
                    self.text(kid, pre)
                continue
            displayed, visible = self.look(kid)
            if not displayed or (closed and kid is not closed):
                continue
            tag, shown = kid.tag, seen if visible is None else visible
            if tag == "br":
                done = "".join(self.line).strip(" ")
                self.line = []
                self.put(done) if done or pre else None
            elif tag in ("img", "input", "area"):
                if shown:
                    self.text(kid.attrs.get("alt" if tag != "input" else "value", ""), False)
            elif tag == "table":
                self.table(kid, shown)
            elif tag in BLOCK:
                self.flush()
                self.gap |= tag in SPACED and not (tag in ("ul", "ol") and kind)
                step = 0
                if tag == "li":
                    number += step_by
                    if kind == "ol":
                        said = whole(kid.attrs.get("value"))
                        number = number if said is None else said
                    self.marker = "" if not shown else f"{numeral(number, kid.attrs.get('type') or n.attrs.get('type') or '1')}. " if kind == "ol" else "- "
                    step = len(self.marker)
                elif tag in ("dd", "blockquote"):
                    step = 2
                self.indent += step
                inner = tag if tag in ("ul", "ol") else kind if tag == "li" else ""
                self.render(kid, pre or tag == "pre", inner, shown, whole(kid.attrs.get("start")) if tag == "ol" else None)
                if tag == "pre" and (rest := "".join(self.line)).strip():
                    self.line = []
                    self.put(rest)
                self.flush()
                self.indent -= step
                self.marker = "" if tag == "li" else self.marker
                self.gap |= tag in SPACED and not (tag in ("ul", "ol") and kind)
            elif tag in CONTROLS:  # a control stands apart from what is around it
                if self.line and not self.line[-1].endswith(" "):
                    self.line.append(" ")
                self.render(kid, pre or tag == "textarea", kind, shown)
                if self.line and not self.line[-1].endswith(" "):
                    self.line.append(" ")
            else:
                self.render(kid, pre, kind, shown)

    def table(self, n: Node, seen: bool) -> None:
        self.flush()
        self.gap = True
        groups: list[list[list[tuple[list[str], int, int | None]]]] = [[]]  # rows by group, which ends the cells that span rows

        def walk(x: Node, seen: bool) -> None:
            cells = []
            for kid in x.kids:
                if isinstance(kid, str):
                    if seen and kid.strip():
                        self.text(kid, False)  # text outside of cells stands before the table
                    continue
                displayed, visible = self.look(kid)
                shown = seen if visible is None else visible
                if not displayed:
                    continue
                if kid.tag in ("td", "th"):
                    own = Renderer(self.hidden)
                    own.render(kid, seen=shown)
                    own.flush()
                    down = whole(kid.attrs.get("rowspan"))
                    across = whole(kid.attrs.get("colspan")) or 1
                    cells.append((own.lines, across if 1 <= across <= MOST_COLUMNS else 1 if across < 1 else MOST_COLUMNS, 1 if down is None or down < 0 else min(down, MOST_ROWS) or None))
                elif kid.tag == "tr":
                    walk(kid, shown)
                elif kid.tag in ("thead", "tbody", "tfoot"):
                    groups.append([])
                    walk(kid, shown)
                    groups.append([])
                else:
                    self.render(_wrap(kid), seen=seen)
                    self.flush()
            if cells or x.tag == "tr":
                groups[-1].append(cells)

        walk(n, seen)
        self.flush()
        rows = [row for group in groups for row in placed(group)]
        widths: dict[int, int] = {}
        for cells in rows:
            for at, span, lines in cells:
                if span == 1:
                    widths[at] = max(widths.get(at, 0), *map(cell_width, lines), 0)
        used = sorted({at for cells in rows for at, _, _ in cells} | set(widths))
        place, left = {}, 0
        for at in used:  # columns in which no cell begins take no room
            place[at] = left
            left += widths.get(at, 0) + 2
        # Padding that would outgrow the text (stairs of cells that span rows) is left out: cells then stand two blanks apart.
        said = sum(cell_width(x) for cells in rows for _, _, lines in cells for x in lines)
        padding = sum(place[cells[-1][0]] * max(len(lines) for _, _, lines in cells) for cells in rows if cells)
        if padding > MOST_PADDING * (said + 1000):
            place = dict.fromkeys(place, 0)
        for cells in rows:
            for k in range(max((len(lines) for _, _, lines in cells), default=0)):
                line, full = "", 0
                for at, _, lines in cells:
                    text = lines[k] if k < len(lines) else ""
                    if text:
                        gap = max(place[at] - full, 2 if full else 0)
                        line, full = line + " " * gap + text, full + gap + cell_width(text)
                if line or len(cells) and max(len(lines) for _, _, lines in cells) > 1:
                    self.put(line)
        self.gap = True


def placed(group: list[list[tuple[list[str], int, int | None]]]) -> list[list[tuple[int, int, list[str]]]]:
    """Rows of (column, columns spanned, lines): every cell in the first free column, a cell that spans rows keeping its columns below, to the end of the group at most,
    unless it begins beyond ``MOST_COLUMNS``."""
    out, held = [], []  # held: (first column, columns, rows still to come) of cells that span rows, by column
    for k, cells in enumerate(group):
        row, at, busy = [], 0, sorted(held)
        n, fresh = 0, []
        for lines, span, down in cells:
            while n < len(busy) and busy[n][0] <= at:
                at = max(at, busy[n][0] + busy[n][1])
                n += 1
            row.append((at, span, lines))
            if (down is None or down > 1) and at < MOST_COLUMNS:
                fresh.append((at, span, len(group) - k - 1 if down is None else down - 1))
            at += span
        held = [(c, w, r - 1) for c, w, r in held if r > 1] + fresh
        out.append(row)
    return out


def _wrap(n: Node) -> Node:
    box = Node("#box", {})
    box.kids.append(n)
    return box


def cell_width(text: str) -> int:
    """Columns of a fixed-width font: wide characters count twice, combining ones not at all."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


_RAW = re.compile(r"<(/?)(script|style|textarea|title)\b", re.I)


def without_open_comment(html: str) -> str:
    """A page up to a comment that nothing ends, which takes all that follows; not within script, style and the like, where it is text."""
    at = html.find("<!--", html.rfind("-->") + 1)
    if at < 0:
        return html
    last = None
    for m in _RAW.finditer(html, 0, at):
        if last is None and not m[1]:
            last = m[2].lower()
        elif m[1] and last == m[2].lower():
            last = None
    return html if last else html[:at]


def text_of(html: str | None) -> str:
    if not html:
        return ""
    builder = Builder()
    builder.feed(without_open_comment(html))
    builder.close()
    out = Renderer(hiding(builder.css))
    out.render(builder.root)
    out.flush()
    return "\n".join(out.lines)


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Adds the visible text of every page."""
    keep = pages.drop(text)
    schema = T.StructType([*keep.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text_of(x.as_py()) for x in b.column(html)], pa.string())], names=schema.names)

    return keep.mapInArrow(run, schema)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
