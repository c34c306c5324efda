"""HTML to text by layout: a tree with implied tags, rules of visibility, and rendering of blocks, lists and tables.

The tree builder knows void elements, the end tags that others imply (p, li, dt, dd, option, rows and cells of tables,
head by the first thing that can't stand in it), end tags out of order, and text-only elements. It keeps for each kind of
element where it is open, so no step walks the stack, and indentation and tables in tables go to a bounded depth: time is
linear in the page.

Not visible: head, script, style, noscript (scripts run), template and like elements, hidden inputs, dialogs and details
that aren't open (a summary is), elements with the hidden attribute or display:none, those with visibility:hidden but for
what is visible again inside, and comments. All other text is emitted: white space collapses outside pre, blocks start on
their own lines, paragraphs, headings, lists and tables have a blank line around them, br ends a line, list items have
marks or numbers and indentation. Cells of a table are laid out in columns padded to their width and parted by two
blanks; a cell may have several lines, span columns and span rows. Images give their alt text.

Defined cases: null and empty pages give an empty text; unclosed and stray tags never lose text; quotes count in a tag
only where a value starts; as in browsers an unterminated tag, quoted value or comment hides the rest of the page, and
CDATA is a comment outside svg and math; cells over WIDE code points overflow their column instead of widening it, tables
deeper than TABLES inside others flow as blocks, and indentation stops at DEEP levels: no text is cut by these; repeated
rows get equal results; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

WIDE, TABLES, DEEP, COLUMNS = 200, 8, 40, 200
_SPECIAL = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[(.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|/(?![a-zA-Z])[^>]*(?:>|\Z))", re.S)
#: A tag whose attributes are well formed; others are read attribute by attribute.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:\s++[^\s"'<>/=]++(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s"'=<>`]++))?+)*+\s*+/?)>""")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTR = re.compile(r"""[\s/]*+(?:([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)("|\Z)|'([^']*+)('|\Z)|([^\s>]*+)))?+)?+""")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_STYLE = re.compile(r"(?:^|[;\s])(display|visibility)\s*:\s*([a-z-]+)", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes noscript iframe".split())
HIDDEN = frozenset("head script style template title noembed noframes noscript iframe datalist audio video canvas desc metadata defs".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr menu".split())
IN_HEAD = frozenset("head base basefont bgsound link meta title script style noscript template noframes html".split())
#: An opening tag closes the outermost of these inside the innermost of those.
_CELL = ("td", "th")
IMPLIES = {
    **{t: (("p",), ("table", "td", "th", "button", "object")) for t in BLOCK - {"li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption", "body", "html"}},
    "li": (("li", "p"), ("ul", "ol", "menu", "table", "td", "th")),
    "dd": (("dd", "dt", "p"), ("dl", "table", "td", "th")),
    "dt": (("dd", "dt", "p"), ("dl", "table", "td", "th")),
    "option": (("option",), ("select", "datalist")),
    "optgroup": (("option", "optgroup"), ("select",)),
    **{t: (("td", "th", "p", "li", "ul", "ol", "caption"), ("tr", "table")) for t in _CELL},
    "tr": (("td", "th", "tr", "p", "caption"), ("tbody", "thead", "tfoot", "table")),
    **{t: (("td", "th", "tr", "tbody", "thead", "tfoot", "p", "caption"), ("table",)) for t in ("tbody", "thead", "tfoot")},
}
_BOUNDS = ("table", "td", "th", "caption", "button", "object", "html")
_PARTS = frozenset("td th tr tbody thead tfoot caption".split())


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.kids = tag, attrs, []

    def get(self, name: str) -> str | None:
        return self.attrs.get(name) if self.attrs else None

    def shown(self, seen: bool) -> tuple[bool, bool]:
        """If a node is laid out, and if its own text is seen, from what its parent's is."""
        if self.tag in HIDDEN or self.tag == "dialog" and self.get("open") is None:
            return False, False
        if not self.attrs:
            return True, seen
        if self.get("hidden") is not None or self.tag == "input" and (self.get("type") or "").lower() == "hidden":
            return False, False
        for name, value in _STYLE.findall(self.get("style") or ""):
            if name.lower() == "display":
                if value.lower() == "none":
                    return False, False
            elif value.lower() in ("hidden", "collapse", "visible"):
                seen = value.lower() == "visible"
        return True, seen

    def number(self, name: str, default: int, low: int, high: int) -> int:
        v = (self.get(name) or "").strip()
        return min(high, max(low, int(v))) if v.lstrip("-").isdigit() and v.isascii() and len(v) < 10 else default


def _attributes(page: str, at: int) -> tuple[dict, int, bool]:
    """Attributes from a place behind a tag's name: values by lower-case name (the first counts), where the tag ends
    (the end of the page if it doesn't), and if it ends in a slash."""
    found: dict[str, str] = {}
    n = len(page)
    while at < n and page[at] != ">":
        m = _ATTR.match(page, at)
        if m.end() == at:
            at += 1
            continue
        at = m.end()
        if m[1] is not None:
            found.setdefault(m[1].lower(), html.unescape(m[2] or m[4] or m[6] or ""))
        if m[3] == "" or m[5] == "":
            return found, n + 1, False
    return found, at + 1, at < n and page[at - 1] == "/"


class _Builder:
    """The stack of open elements, and for each kind of element where it is open."""

    def __init__(self):
        self.root = Node("#root")
        self.stack, self.open, self.blocks = [self.root], {}, []

    def push(self, node: Node) -> None:
        self.open.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Closes all from a place of the stack on."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.open[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def top(self, tags) -> int:
        """The innermost place where one of tags is open, or 0."""
        return max((x[-1] for t in tags if (x := self.open.get(t))), default=0)

    def imply(self, tags, bounds) -> None:
        bound, found = self.top(bounds), []
        for t in tags:
            places = self.open.get(t)
            if places and places[-1] > bound:
                found.append(places[bisect_right(places, bound)])
        if found:
            self.cut(min(found))

    def close(self, tag: str) -> None:
        places = self.open.get(tag)
        if not places:
            return
        at = places[-1]
        if tag in BLOCK:
            bounds = () if tag in ("table", "body", "html") else ("table",) if tag in _PARTS else tuple(b for b in _BOUNDS if b != tag)
            if at > self.top(bounds):
                self.cut(at)
        elif not self.blocks or self.blocks[-1] < at:  # an inline element's end inside a later block is left alone
            self.cut(at)

    def text(self, s: str) -> None:
        if self.stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
            self.cut(len(self.stack) - 1)
        self.stack[-1].kids.append(s)


def parse(page: str) -> Node:
    b = _Builder()
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            b.text(page[at:])
            break
        if lt > at:
            b.text(page[at:lt])
        m = _TAG.match(page, lt)
        if m is not None:
            closing, tag, raw, at = m[1], m[2].lower(), m[3], m.end()
            attrs = _attributes(raw, 0)[0] if raw and not closing and not raw.isspace() else None
            slash = raw.endswith("/")
        elif (m := _NAME.match(page, lt)) is not None:
            closing, tag = m[1], m[2].lower()
            attrs, at, slash = _attributes(page, m.end())
            if at > n:  # the tag never ends
                break
        elif (m := _SPECIAL.match(page, lt)) is not None:
            if m[1] is not None and b.top(("svg", "math")):
                b.text(html.escape(m[1], quote=False))
                at = m.end()
            elif m[1] is not None:  # a comment up to the first >
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                at = m.end()
            continue
        else:
            b.text("<")
            at = lt + 1
            continue
        if closing:
            if tag == "p" and not b.open.get("p"):
                b.stack[-1].kids.append(Node("p"))
            elif tag == "br":
                b.stack[-1].kids.append(Node("br"))
            else:
                b.close(tag)
            continue
        if tag in ("html", "body") and b.open.get(tag):
            continue
        if tag not in IN_HEAD and b.stack[-1].tag == "head" or tag == "body" and b.open.get("head"):
            b.cut(b.open["head"][-1])
        if tag in IMPLIES:
            b.imply(*IMPLIES[tag])
        node = Node(tag, attrs)
        b.stack[-1].kids.append(node)
        if tag in VOID or slash and b.top(("svg", "math")):
            continue
        if tag in RAW:
            end = _raw_end(tag).search(page, at)
            node.kids.append(page[at : end.start()] if end else page[at:])
            at = end.end() if end else n
            continue
        b.push(node)
    return b.root


_ends: dict[str, re.Pattern] = {}


def _raw_end(tag: str) -> re.Pattern:
    if tag not in _ends:
        _ends[tag] = re.compile(rf"</{tag}(?=[\s/>])[^>]*+>?", re.I)
    return _ends[tag]


class _Out:
    """Lines under construction: text, pending line breaks and blank lines, and the mark of the current item."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.gap, self.space, self.breaks = [], 0, False, 0

    def _start(self, indent: str, mark: list[str]) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        self.now.append(indent + (mark.pop() if mark else ""))
        self.space = False

    def _break(self) -> None:
        """Line breaks that text follows."""
        if self.breaks:
            if self.now:
                self.lines.append("".join(self.now))
                self.now, n = [], self.breaks - 1
            else:
                n = self.breaks - (not self.lines)
            self.lines += [""] * n
            self.breaks = 0
            self.gap = min(self.gap, 1)

    def text(self, s: str, indent: str, mark: list[str]) -> None:
        s = _SPACE.sub(" ", s)
        if s == " ":
            self.space = True
            return
        if not s:
            return
        self._break()
        if not self.now:
            self._start(indent, mark)
            s = s.lstrip(" ")
        elif self.space or s[0] == " ":
            self.now.append(" ")
            s = s.lstrip(" ")
        self.space = s.endswith(" ")
        self.now.append(s.rstrip(" "))

    def line(self, gap: int) -> None:
        if self.now:
            self.lines.append("".join(self.now))
        self.now, self.space, self.breaks = [], False, 0
        self.gap = max(self.gap, gap)

    def verbatim(self, s: str, indent: str, mark: list[str]) -> None:
        for i, part in enumerate(s.split("\n")):
            if i:
                self.breaks += 1
            if part:
                self._break()
                if not self.now:
                    self._start(indent, mark)
                self.now.append(part)

    def done(self) -> str:
        self.line(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return "\n".join(self.lines)


def _grid(table: Node) -> tuple[list[Node], list[tuple[Node, list[Node]]]] | None:
    """Captions, and rows with their cells, if all that a table shows stands in these."""
    captions, rows = [], []
    for kid in table.kids:
        if isinstance(kid, str):
            if kid.strip():
                return None
        elif kid.tag == "caption":
            captions.append(kid)
        elif kid.tag in ("thead", "tbody", "tfoot", "tr"):
            if not kid.shown(True)[0]:
                continue
            for row in [kid] if kid.tag == "tr" else kid.kids:
                if isinstance(row, str):
                    if row.strip():
                        return None
                elif row.tag != "tr" or any((k.strip() if isinstance(k, str) else k.tag not in _CELL) for k in row.kids):
                    return None
                elif row.shown(True)[0]:
                    rows.append([k for k in row.kids if isinstance(k, Node) and k.shown(True)[0]])
        elif kid.tag not in ("colgroup", "col"):
            return None
    return captions, rows


def _aligned(rows: list[list[Node]], seen: bool, depth: int) -> list[str]:
    """The lines of rows whose cells stand in columns."""
    most = max(map(len, rows), default=0)
    until: dict[int, int] = {}
    placed: list[list[tuple[int, int, list[str]]]] = []
    width: list[int] = []
    for r, row in enumerate(rows):
        here, c = [], 0
        for cell in row:
            while until.get(c, 0) > r:
                c += 1
            span = cell.number("colspan", 1, 1, most)
            down = cell.number("rowspan", 1, 1, len(rows)) if most <= COLUMNS else 1
            lines = _render(cell, cell.shown(seen)[1], depth + 1).split("\n")
            width += [0] * (c + 1 - len(width))
            if span == 1:
                width[c] = max(width[c], *(len(x) for x in lines if len(x) <= WIDE), 0)
            if down > 1:
                for k in range(c, c + span):
                    until[k] = r + down
            here.append((c, span, lines))
            c += span
        placed.append(here)
    start = [0]
    for w in width:
        start.append(start[-1] + (w + 2 if w else 0))
    out = []
    for here in placed:
        for k in range(max((len(lines) for _, _, lines in here), default=0)):
            line: list[str] = []
            size = 0
            for c, _, lines in here:
                if k < len(lines) and lines[k]:
                    pad = start[c] - size
                    line += [" " * pad if pad > 0 else "  " if size else "", lines[k]]
                    size += max(pad, 0 if pad > 0 or not size else 2) + len(lines[k])
            if line:
                out.append("".join(line))
    return out


def _render(root: Node, seen: bool, depth: int) -> str:
    """The visible text below a node. Work items: a step, a node or text, level of indentation, mark, pre, counter, seen."""
    out = _Out()
    stack: list[tuple] = [("kids", root, 0, [], False, None, seen)]
    while stack:
        step, node, level, mark, pre, count, seen = stack.pop()
        if step == "line":
            out.line(node)
            continue
        indent = "  " * min(level, DEEP)
        if isinstance(node, str):
            if seen:
                (out.verbatim if pre else out.text)(html.unescape(node), indent, mark)
            continue
        kids = node.kids
        if step != "kids":
            laid, seen = node.shown(seen)
            if not laid:
                continue
            tag = node.tag
            if tag == "br":
                out.breaks += 1
                out.space = False
                continue
            if tag in ("img", "input"):
                alt = node.get("alt") if tag == "img" else node.get("value") if (node.get("type") or "").lower() in ("submit", "button", "reset") else None
                if alt and seen:
                    out.text(alt, indent, mark)
                continue
            if tag in BLOCK:
                gap = 2 if tag in SPACED and not (level and tag in ("ul", "ol", "menu")) else 1
                out.line(gap)
                stack.append(("line", gap, 0, [], False, None, seen))
            if tag == "table" and depth < TABLES and (grid := _grid(node)) is not None:
                lines = [x for c in grid[0] for x in _render(c, seen, depth + 1).split("\n")] if grid[0] else []
                for line in lines + _aligned(grid[1], seen, depth):
                    if line:
                        out.verbatim(line, indent, mark)
                        out.line(1)
                continue
            if tag in ("ul", "menu", "ol"):
                count = [tag, node.number("start", 1, -(10**9), 10**9) if tag == "ol" else 1]
                level += 1
            elif tag == "li":
                ordered = count is not None and count[0] == "ol"
                if ordered:
                    count[1] = node.number("value", count[1], -(10**9), 10**9)
                mark = [f"{count[1]}. " if ordered else "- "]
                if ordered:
                    count[1] += 1
            elif tag in ("blockquote", "dd"):
                level += 1
            elif tag in _CELL:
                out.space = True
            elif tag == "details" and node.get("open") is None:
                kids = next(([k] for k in kids if isinstance(k, Node) and k.tag == "summary"), [])
            if tag in ("pre", "textarea", "xmp"):
                pre = True
                if kids and isinstance(kids[0], str) and kids[0].startswith("\n"):
                    kids = [kids[0][1:], *kids[1:]]
        stack += [("node", k, level, mark, pre, count, seen) for k in reversed(kids)]
    return out.done()


def render(root: Node) -> str:
    return _render(root, True, 0)


def extract(page: str | None) -> str:
    return render(parse(page)) if page else ""


_OUT = pa.schema([("page_id", pa.int64()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_lines", pa.int64()), ("text_sha256", pa.string())])


def extract_pages(pages: DataFrame, ident: str = "page_id", source: str = "html") -> DataFrame:
    """page_id, text, n_chars, n_lines, text_sha256 of every row, where the rows are read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [extract(x) for x in batch.column(1).to_pylist()]
            yield batches(_OUT, [batch.column(0), found, [len(x) for x in found], [x.count("\n") + 1 if x else 0 for x in found], [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in found]])

    return pages.select(F.col(ident).cast("long"), F.col(source)).mapInArrow(run, "page_id long, text string, n_chars long, n_lines long, text_sha256 string")
