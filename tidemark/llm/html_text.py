"""HTML to text, laid out the way a browser would show it.

A page goes through three small steps per row: tokens (one regular expression), a tree
(implied ends of ``p``, ``li``, table parts and so on; void elements; stray ends are
ignored, open elements end with the page), and a rendering of the visible nodes:

* block elements stand on lines of their own, with a blank line around paragraphs,
  headings, lists and tables; ``br`` breaks a line, ``hr`` draws one; white space is
  collapsed except in ``pre`` and ``textarea``;
* list items start with a bullet or their number, indented by depth;
* tables are grids: cells of a column are padded to the same width, and a cell that
  spans several columns takes their width;
* what a browser hides is left out: head matter, scripts, styles, templates, comments,
  the ``hidden`` attribute, ``display:none`` or ``visibility:hidden`` in a style
  attribute, ``aria-hidden`` is shown, closed ``details`` show their summary only;
* of ``svg`` the text elements are shown, of ``math`` all but annotations, and all options
  of a ``select``, each on its line; fallbacks of media (``object``, ``audio``, ``video``,
  ``canvas``, ``iframe``), ``noscript``, ``datalist`` and form values are not shown.

Null is null; an empty page or one without visible text is the empty string. Any
string is some page: broken markup never fails. The tree has any depth; what is nested
deeper than ``MAX_DEPTH`` is laid out flat, as lines of its blocks, so depth cannot
exhaust the stack: its visible text stays, and nothing around it changes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import bounded_batches

MAX_DEPTH = 150

# Groups of element names, as HTML defines them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = set("head script style template noscript title meta link base datalist iframe noembed noframes object audio video canvas "
             "annotation annotation-xml mphantom".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
            "h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul tr tbody "
            "thead tfoot caption".split())
SPACED = set("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
             "header hgroup hr main menu nav ol p pre search section table ul".split())
# An opening tag ends open elements of these names, up to the nearest of the limits.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
# An end tag does not look for its element beyond these.
SCOPE = {"table", "td", "th", "caption", "html", "template"}
# Inside svg only these hold text, and these are never shown; a foreignobject holds HTML.
SVG_TEXT = {"text", "tspan", "textpath", "foreignobject"}
SVG_HIDDEN = set("title desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter script style".split())
# HTML that may stand inside svg and math, and start tags that end them elsewhere.
INTEGRATION = set("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p "
               "pre ruby s small span strong strike sub sup table tt u ul var".split())
# Text and any other start tag end an open head.
HEAD_MATTER = set("base basefont bgsound head html link meta noframes noscript script style template title".split())

# Attributes as browsers read them: a quote opens a value only right after "=" and white space, elsewhere it is part of a name or value.
NAME = r"[^\s/>][^\s/>=]*+"
VALUE = r"""\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>|\Z))"""
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)"
                   rf"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attributes>(?:[\s/]++|{NAME}(?:{VALUE})?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(rf"({NAME})(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"'][^\s>]*+))?+)?+")
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def attributes_of(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


def parse(html: str) -> Node:
    """The tree of a page; text nodes are strings."""
    root = Node("", {})
    stack = [root]
    # where in the stack the open elements of a name are, and those of SCOPE, so that depth costs no search
    places: dict[str, list[int]] = {"svg": [], "math": []}
    svg, math = places["svg"], places["math"]
    scopes: list[int] = []
    deep = False

    def nearest(name: str) -> int:
        return places[name][-1] if places.get(name) else 0

    def close_to(k: int) -> None:
        for node in stack[k:]:
            places[node.name].pop()
        while scopes and scopes[-1] >= k:
            scopes.pop()
        del stack[k:]

    def imply(names: set[str], limits: set[str]) -> None:
        # inside the limit, the outermost of the names ends
        limit = max([0, *map(nearest, limits)])
        inside = [own[k] for own in (places.get(n, []) for n in names) if (k := bisect_right(own, limit)) < len(own)]
        if inside:
            close_to(min(inside))

    at, size = 0, len(html)
    while at < size:
        m = TOKEN.search(html, at)
        text = html[at:m.start()] if m else html[at:]
        if text:
            text = unescape(text) if "&" in text else text
            if stack[-1].name == "head" and SPACE.sub("", text):
                close_to(len(stack) - 1)
            if not svg or max(map(nearest, SVG_TEXT)) > svg[-1]:
                stack[-1].children.append(text)
        if not m:
            break
        at = m.end()
        end, name, attributes = m.groups()
        if name is None:
            continue
        name = name.lower()
        if end:
            k = nearest(name)
            if k and (name in ("table", "html", "body", "tr", "tbody", "thead", "tfoot") or not scopes or scopes[-1] <= k):
                close_to(k)
            elif not k and not scopes and name in ("br", "p"):
                stack[-1].children.append(Node(name, {}))
            continue
        around = max(nearest("svg"), nearest("math")) if svg or math else 0
        foreign = around > max(0, *map(nearest, INTEGRATION)) if around else False
        if foreign and name in BREAKOUT:
            roots = [places.get(n, []) for n in ("svg", "math")]
            inside = max(map(nearest, INTEGRATION))
            close_to(min(own[k] for own in roots if (k := bisect_right(own, inside)) < len(own)))
            foreign = False
        if name in ENDS_P and not foreign:
            k = nearest("p")
            if k and k > max([nearest("button"), *scopes[-1:]]):
                close_to(k)
        if name in IMPLIED:
            imply(*IMPLIED[name])
        elif name not in HEAD_MATTER and stack[-1].name == "head":
            close_to(len(stack) - 1)
        node = Node(name, attributes_of(attributes) if attributes and attributes.strip(" \t\n\r\f/") else {})
        if foreign and (name in SVG_HIDDEN and nearest("svg") == around or node.attributes.get("display") == "none"
                        or node.attributes.get("visibility") == "hidden"):
            node.attributes["hidden"] = ""
        stack[-1].children.append(node)
        if name in VOID or (foreign or name in ("svg", "math")) and attributes.endswith("/"):
            continue
        if name in RAW and not (foreign and name in ("title", "textarea", "xmp", "iframe", "noembed", "noframes")):
            end = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            body = html[at:end.start()] if end else html[at:]
            if body:
                node.children.append(unescape(body) if name in ("textarea", "title") else body)
            at = end.end() if end else size
            continue
        places.setdefault(name, []).append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        stack.append(node)
        deep = deep or len(stack) >= MAX_DEPTH
    if deep:
        flatten(root)
    return root


def flatten(root: Node) -> None:
    """Replace what is nested deeper than MAX_DEPTH by its visible text, images and line ends."""
    level, line_end = [root], Node("div", {})
    for _ in range(MAX_DEPTH):
        level = [c for node in level for c in node.children if isinstance(c, Node) and c.children]
    for top in level:
        flat: list = []
        rest = shown(top)[::-1]
        while rest:
            c = rest.pop()
            if isinstance(c, str) or c is line_end or c.name in ("br", "hr", "img"):
                flat.append(c)
            elif not hidden(c):
                edge = [line_end] if c.name in BLOCK else [" "] if c.name in ("td", "th", "text") else []
                rest += [*edge, *shown(c)[::-1], *edge]
        top.children = flat
        if top.name == "details":
            # only what it shows is left
            top.attributes["open"] = ""


def shown(node: Node) -> list:
    """The children of a node, of closed ``details`` only the summary; the labels of options."""
    if node.name == "details" and "open" not in node.attributes:
        return [c for c in node.children if isinstance(c, Node) and c.name == "summary"][:1]
    label = node.attributes.get("label") if node.name in ("option", "optgroup") else None
    if label:
        line = Node("div", {})
        line.children = [label]
        return [line] if node.name == "option" else [line, *node.children]
    return node.children


def hidden(node: Node) -> bool:
    a = node.attributes
    return node.name in HIDDEN or bool(a) and (
        "hidden" in a or node.name == "input" or node.name == "dialog" and "open" not in a or "style" in a and bool(UNSEEN.search(a["style"])))


def collapsed(text: str) -> str:
    """Text with a space for each run of white space; most texts have nothing but single spaces."""
    return SPACE.sub(" ", text) if "\n" in text or "  " in text or "\t" in text or "\r" in text or "\f" in text else text


class Lines:
    """Text under construction: lines, collapsed white space, and blank lines owed."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = self.space = self.fresh = False

    def text(self, text: str) -> None:
        text = collapsed(text)
        words = text.strip(" ")
        if words:
            self.put((" " if (self.space or text[0] == " ") and self.now and not self.fresh else "") + words)
            self.fresh, self.space = False, text[-1] == " "
        elif text:
            self.space = True

    def put(self, text: str) -> None:
        if not self.now and self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.now.append(text)

    def line(self) -> None:
        """End the line, if anything is on it."""
        if self.now:
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []
        self.space = self.fresh = False

    def break_(self) -> None:
        if self.now:
            self.line()
        elif self.lines and not self.gap:
            self.lines.append("")

    def blank(self) -> None:
        self.line()
        self.gap = True

    def block(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Finished lines, the first after ``first`` and the others after ``rest``."""
        self.line()
        for k, x in enumerate(lines):
            self.put(((first if k == 0 else rest) + x) if x or k == 0 else "")
            self.lines.append("".join(self.now).rstrip(" "))
            self.now = []

    def done(self) -> list[str]:
        self.line()
        out = self.lines
        while out and not out[-1]:
            out.pop()
        while out and not out[0]:
            out.pop(0)
        return out


def number(value: str | None, default: int) -> int:
    m = re.match(r"\s*([+-]?\d{1,6})", value or "")
    return int(m[1]) if m else default


def render(children: list, out: Lines) -> None:
    for node in children:
        if isinstance(node, str):
            out.text(node)
        elif hidden(node):
            continue
        elif node.name == "br":
            out.break_()
        elif node.name == "hr":
            out.block(["----"])
        elif node.name == "img":
            if node.attributes.get("alt"):
                out.text(node.attributes["alt"])
        elif node.name in ("pre", "textarea"):
            out.blank()
            out.block(preformatted(node).split("\n"))
            out.blank()
        elif node.name in ("ul", "ol", "menu", "dir"):
            out.blank()
            items(node, out)
            out.blank()
        elif node.name == "table":
            out.blank()
            for block in table(node):
                out.block(block)
            out.blank()
        elif node.name == "text":
            out.space = True
            render(node.children, out)
            out.space = True
        elif node.name == "blockquote":
            out.blank()
            out.block(laid_out(node.children), "> ", "> ")
            out.blank()
        elif node.name == "details" and "open" not in node.attributes:
            out.line()
            render(shown(node), out)
            out.line()
        elif node.name in BLOCK:
            spaced = node.name in SPACED
            out.blank() if spaced else out.line()
            if node.name == "dd":
                out.block(laid_out(node.children), "    ", "    ")
            else:
                render(shown(node), out)
            out.blank() if spaced else out.line()
        else:
            render(node.children, out)


def laid_out(children: list) -> list[str]:
    out = Lines()
    render(children, out)
    return out.done()


def preformatted(node: Node) -> str:
    parts = []

    def walk(children: list) -> None:
        for c in children:
            if isinstance(c, str):
                parts.append(c)
            elif c.name == "br":
                parts.append("\n")
            elif not hidden(c):
                walk(c.children)

    walk(node.children)
    return "".join(parts).replace("\r\n", "\n").replace("\r", "\n").removeprefix("\n").rstrip("\n")


def items(node: Node, out: Lines) -> None:
    count = number(node.attributes.get("start"), 1)
    for c in node.children:
        if isinstance(c, str):
            out.text(c)
        elif hidden(c):
            continue
        elif c.name == "li":
            out.line()
            mark = "- "
            if node.name == "ol":
                count = number(c.attributes.get("value"), count)
                mark, count = f"{count}. ", count + 1
            inner = laid_out(c.children)
            # a list right inside an item stands close to it
            own = [x for k, x in enumerate(inner) if x or not (k + 1 < len(inner) and re.match(r"\s*(?:- |\d+\. )", inner[k + 1]))]
            out.block(own or [""], mark, " " * len(mark))
        elif c.name in ("ul", "ol", "menu", "dir"):
            nested = Lines()
            items(c, nested)
            out.block(nested.done(), "  ", "  ")
        else:
            render([c], out)


def table(node: Node) -> list[list[str]]:
    """The caption and what stands outside of cells, if any, and the aligned rows."""
    rows: list[list[tuple[int, list[str]]]] = []
    head, loose = Lines(), Lines()

    def walk(children: list) -> None:
        for c in children:
            if isinstance(c, str):
                loose.text(c)
            elif hidden(c):
                continue
            elif c.name == "caption":
                head.block(laid_out(c.children))
            elif c.name in ("tbody", "thead", "tfoot"):
                walk(c.children)
            elif c.name == "tr":
                rows.append(cells(c.children))
            elif c.name in ("td", "th"):
                rows.append(cells([c]))
            elif c.name not in ("colgroup", "col"):
                render([c], loose)

    def cells(children: list) -> list[tuple[int, list[str]]]:
        row = []
        for c in children:
            if isinstance(c, Node) and c.name in ("td", "th"):
                if not hidden(c):
                    span = min(1000, max(1, number(c.attributes.get("colspan"), 1)))
                    row.append((span, laid_out(c.children), min(1000, max(1, number(c.attributes.get("rowspan"), 1)))))
            elif isinstance(c, str):
                loose.text(c)
            elif not hidden(c):
                render([c], loose)
        return row

    walk(node.children)
    # columns that a cell of an earlier row still fills
    taken: dict[int, int] = {}
    placed: list[list[tuple[int, int, list[str]]]] = []
    for row in rows:
        at, own, below = 0, [], {}
        for span, lines, depth in row:
            while taken.get(at):
                at += 1
            own.append((at, span, lines))
            if depth > 1:
                below.update({k: depth for k in range(at, at + span)})
            at += span
        taken = {k: n - 1 for k, n in {**taken, **below}.items() if n > 1}
        placed.append(own)
    widths: dict[int, int] = {}
    for own in placed:
        for at, span, lines in own:
            if span == 1:
                widths[at] = max([widths.get(at, 0), *map(len, lines)])
    for own in placed:
        for at, span, lines in own:
            if span > 1:
                missing = max([0, *map(len, lines)]) - sum(widths.get(k, 0) for k in range(at, at + span)) - 3 * (span - 1)
                if missing > 0:
                    widths[at + span - 1] = widths.get(at + span - 1, 0) + missing
    body: list[str] = []
    n = 1 + max([-1, *(at + span - 1 for own in placed for at, span, _ in own)])
    start = [0]
    for k in range(n):
        start.append(start[-1] + widths.get(k, 0) + 3)
    for own in placed:
        for k in range(max([0, *(len(lines) for _, _, lines in own)])):
            line = ""
            for at, _, lines in own:
                bar = " | " if at else ""
                line = line.ljust(max(0, start[at] - len(bar))) + bar + (lines[k] if k < len(lines) else "")
            body.append(line.rstrip(" "))
    return [x for x in (head.done(), loose.done(), body) if x]


def to_text(html: str | None) -> str | None:
    """The visible text of a page."""
    return None if html is None else "\n".join(laid_out(parse(html).children))


def title_of(html: str | None) -> str | None:
    m = re.search(r"<title\b[^>]*>(.*?)(?:</title|\Z)", html or "", re.I | re.S)
    return SPACE.sub(" ", unescape(m[1])).strip() if m else None


def visible_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def text(batch: pd.Series) -> pd.Series:
        return pd.Series([to_text(x) for x in batch], dtype=object)

    return text(html)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text of each page in the column ``into``; every row and other column stays."""
    bounded_batches(pages.sparkSession)
    return pages.withColumn(into, visible_text(F.col(html)))
