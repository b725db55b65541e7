"""Layout-aware HTML rendering: all visible text, with block spacing, lists and aligned tables.

A tree is built with implied end tags, visibility rules drop what a browser wouldn't show, and the rest is laid
out: inline text is joined and its white space collapsed, blocks start lines, paragraphs and headings stand
apart, lists are indented and marked, and the cells of a table are padded to columns.
"""

from __future__ import annotations

import bisect
import html
import itertools
import re
import unicodedata
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofuse.llm.shared import small_batches, table

# Element names and their roles, from the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = set("head script style template noscript title meta link iframe noembed noframes object audio video canvas datalist map colgroup col annotation annotation-xml".split())
BLOCK = set(
    "address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
APART = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu pre blockquote table figure hr".split())
ENDS_P = BLOCK - set("html body head td th tr tbody thead tfoot caption option optgroup legend".split())
SCOPE = set("table td th caption template html".split())
#: An opening tag ends these, up to the nearest of those.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: What an svg draws as text, and what of it is never drawn.
DRAWN = {"text", "foreignobject"}
UNDRAWN = set("defs desc metadata symbol clippath mask pattern marker".split())
#: Columns up to which nested lists are indented further; their text is whole at any depth.
INDENT = 400
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTES = re.compile(r"""(?:\s++|/|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+|=)*+""")
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WHITE = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Node:
    tag: str
    attributes: str = ""
    children: list[Node | str] = field(default_factory=list)
    dark: bool = False

    def get(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape(m[2] or m[3] or m[4] or "")
        return None


def parse(source: str) -> Node:
    """The tree of a page; anything is accepted, and no text outside of tags is lost."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of each open tag, where it is in the stack

    def add_text(text: str) -> None:
        if text:
            stack[-1].children.append(html.unescape(text) if "&" in text else text)

    def nearest(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def cut(i: int) -> None:
        for node in stack[i:]:
            places[node.tag].pop()
        del stack[i:]

    def close(tags: set[str], until: set[str]) -> None:
        edge = nearest(until)
        while (i := nearest(tags)) > edge:
            cut(i)

    at, n, closed = 0, len(source), source.rfind(">")
    while at < n:
        lt = source.find("<", at)
        if lt < 0 or lt > closed:  # no tag ends behind it
            if lt >= 0 and source.startswith("<!--", lt):
                add_text(source[at:lt])
            else:
                add_text(source[at:])
            break
        add_text(source[at:lt])
        if source.startswith("<!--", lt):
            end = source.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), lt):
            at = source.find(">", lt) + 1
            continue
        ending = source.startswith("</", lt)
        name = NAME.match(source, lt + 1 + ending)
        if not name:
            if ending:
                at = source.find(">", lt) + 1
            else:
                add_text("<")
                at = lt + 1
            continue
        tag = name[0].lower()
        attributes = ATTRIBUTES.match(source, name.end())
        stop = attributes.end()
        while stop < n and source[stop] != ">":  # an unclosed quote: up to the next bracket
            stop = source.find(">", stop)
            stop = n if stop < 0 else stop
        at = stop + 1
        if ending:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                edge = {"table"} if tag in ("td", "th", "tr", "tbody", "thead", "tfoot") else SCOPE - {tag}
                i = nearest({tag})
                if i > (0 if tag in ("table", "html", "body") else nearest(edge)):
                    cut(i)
            continue
        if tag == "html":
            root.attributes += " " + attributes[0]
            continue
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        if tag in ENDS_P:
            close({"p"}, SCOPE | {"button"})
        node = Node(tag, attributes[0])
        stack[-1].children.append(node)
        if tag in VOID or attributes[0].endswith("/") and (tag in ("svg", "path") or nearest({"svg", "math"})):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
            text = source[at : end.start() if end else n]
            node.children.append(html.unescape(text) if tag == "textarea" else text)
            at = n if not end else max(source.find(">", end.end()), end.end() - 1) + 1
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append(node)
    return root


HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse|initial)", re.I)


def visible(node: Node) -> bool:
    """Whether a node has a box; what has none shows nothing of what is inside."""
    if node.tag in UNSEEN:
        return False
    if not node.attributes:
        return node.tag != "dialog"
    lower = node.attributes.lower()
    if "hidden" in lower and node.get("hidden") is not None:
        return False
    if "style" in lower:
        style = node.get("style") or ""
        if HIDDEN_STYLE.search(style) or node.tag in ("tr", "tbody", "thead", "tfoot") and _visibility(style) == "collapse":
            return False
    return node.tag != "dialog" or node.get("open") is not None


def _visibility(style: str) -> str | None:
    """What a style says of visibility: its last word on it."""
    found = VISIBILITY.findall(style)
    return found[-1].lower() if found else None


def shade(root: Node) -> None:
    """Takes the text out of nodes that are invisible, by their own style or by that of what they are in; boxes stay.

    Visibility is inherited, and a node inside an invisible one may be visible again.
    """
    todo = [(root, False)]
    while todo:
        node, dark = todo.pop()
        if node.attributes and "visibility" in node.attributes.lower():
            own = _visibility(node.get("style") or "")
            dark = dark if own is None else own in ("hidden", "collapse")
        node.dark = dark
        if dark:
            node.children = [c for c in node.children if isinstance(c, Node)]
        todo += [(c, dark) for c in node.children if isinstance(c, Node)]


class Page:
    """Lines in the making: pending inline text, and the blank line that is due before the next."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.indent, self.mark, self.apart = "", "", False

    def flush(self) -> None:
        text = WHITE.sub(" ", "".join(self.inline)).strip(" ")
        self.inline.clear()
        if text:
            self.line(text)

    def line(self, text: str) -> None:
        if self.apart and self.lines:
            self.lines.append("")
        self.apart = False
        lead = self.indent
        if self.mark:
            lead, self.mark = self.indent[: len(self.indent) - len(self.mark)] + self.mark, ""
        self.lines.append(lead + text)

    def gap(self) -> None:
        self.flush()
        self.apart = self.apart or bool(self.lines)


def width(text: str) -> int:
    """Columns that a text takes: wide characters two, marks none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _run(step):
    """Runs a generator that yields the generators it waits for: recursion of any depth."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def _rows(node: Node):
    """The rows of a table, each with the group that holds it."""
    todo = [(node, child) for child in node.children[::-1]]
    while todo:
        group, child = todo.pop()
        if isinstance(child, Node) and visible(child):
            if child.tag == "tr":
                yield group, child
            elif child.tag in ("tbody", "thead", "tfoot"):
                todo += [(child, x) for x in child.children[::-1]]


def _drawn(node: Node) -> list[Node]:
    """The elements of an svg that draw text."""
    found, todo = [], node.children[::-1]
    while todo:
        child = todo.pop()
        if isinstance(child, Node) and child.tag not in UNDRAWN and visible(child):
            if child.tag in DRAWN:
                found.append(child)
            else:
                todo += child.children[::-1]
    return found


def _shown(node: Node) -> list[Node]:
    """The options that a select shows: all of a list box, else the last selected or the first that is enabled."""
    found, todo = [], node.children[::-1]
    while todo:
        child = todo.pop()
        if isinstance(child, Node) and visible(child):
            if child.tag == "option":
                found.append(child)
            else:
                todo += child.children[::-1]
    size = (node.get("size") or "1").strip()
    if node.get("multiple") is not None or size.isascii() and size.isdigit() and int(size[:9]) > 1:
        return found
    selected = [o for o in found if o.get("selected") is not None][-1:]
    return selected or [o for o in found if o.get("disabled") is None][:1]


def _cell(node: Node):
    page = Page()
    yield lay(node, page, inside=True)
    page.flush()
    return [x for x in page.lines if x.strip()]


def _span(node: Node, name: str, most: int) -> int:
    """A span as the standard reads it: one where it isn't a number, most at most; rows may be 0, all that follow."""
    value = (node.get(name) or "1").strip()
    n = int(value[:9]) if value.isascii() and value.isdigit() else 1
    return most if name == "rowspan" and n == 0 else min(max(n, 1), most)


def lay_table(node: Node, page: Page):
    others = [c for c in node.children if not (isinstance(c, Node) and c.tag in ("tr", "tbody", "thead", "tfoot"))]
    yield lay(Node("div", "", others), page)  # captions, and whatever stands in a table outside its rows
    page.flush()
    rows, widths, over, group = [], {}, [], None
    for own, tr in _rows(node):
        if own is not group:  # no cell reaches into another group of rows
            group, over = own, []
        # Cells of rows above that reach into this one: (first column, column after, rows left), in order.
        cells, column, above, more = [], 0, iter(over), []
        taken = next(above, None)
        stray = [c for c in tr.children if isinstance(c, str) or c.tag not in ("td", "th")]
        if any(isinstance(c, Node) or c.strip() for c in stray):
            yield lay(Node("div", "", stray), page)
            page.flush()
        for cell in tr.children:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or not visible(cell):
                continue
            lines, span, down = (yield _cell(cell)), _span(cell, "colspan", 1000), _span(cell, "rowspan", 65534)
            while taken and taken[0] <= column:
                column, taken = max(column, taken[1]), next(above, None)
            cells.append((column, lines))
            if span == 1:
                widths[column] = max([widths.get(column, 0), *map(width, lines)])
            if down > 1:
                more.append((column, column + span, down))
            column += span
        over = sorted((a, b, n - 1) for a, b, n in [*over, *more] if n > 1)
        rows.append(cells)
    # Only columns with a cell of their own take room.
    used = sorted(k for k, n in widths.items() if n)
    starts = [0, *itertools.accumulate(widths[k] + 2 for k in used)]
    for cells in rows:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            out, at = "", 0
            for column, lines in cells:
                start = starts[bisect.bisect_left(used, column)]
                out += " " * max(start - at, 2 if at else 0)
                at = max(start, at + 2 if at else 0)
                text = lines[k] if k < len(lines) else ""
                out, at = out + text, at + width(text)
            if out.strip():
                page.line(out.rstrip())


def _number(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if re.fullmatch(r"-?[0-9]{1,9}", text) else None


def _roman(n: int) -> str:
    pairs = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))
    out = ""
    for value, sign in pairs:
        out, n = out + sign * (n // value), n % value
    return out


def _letters(n: int) -> str:
    out = ""
    while n > 0:
        n, k = divmod(n - 1, 26)
        out = chr(97 + k) + out
    return out


class Numbers:
    """The numbers of an ordered list: where it starts, which way it counts, and how numbers are written."""

    def __init__(self, node: Node):
        self.step = -1 if node.get("reversed") is not None else 1
        items = sum(isinstance(c, Node) and c.tag == "li" and visible(c) for c in node.children)
        first = _number(node.get("start"))
        self.next = first if first is not None else 1 if self.step > 0 else items
        self.kind = (node.get("type") or "").strip()

    def take(self, item: Node) -> str:
        own = _number(item.get("value")) if item.attributes else None
        n = self.next if own is None else own
        self.next = n + self.step
        if self.kind in ("i", "I") and 0 < n < 4000:
            text = _roman(n)
        elif self.kind in ("a", "A") and n > 0:
            text = _letters(n)
        else:
            return str(n)
        return text.upper() if self.kind.isupper() else text


#: Kinds of inputs that show no text of their own, and what buttons without a label say.
SILENT, LABELS = set("hidden checkbox radio file range color password image date datetime-local month week time".split()), {"submit": "Submit", "reset": "Reset"}


def _input(node: Node) -> str:
    """What an input shows: a button's label, a field's value or else its placeholder."""
    kind = (node.get("type") or "text").strip().lower()
    if kind in SILENT or node.dark:
        return ""
    value = node.get("value")
    if kind in ("submit", "reset", "button"):
        return value if value is not None else LABELS.get(kind, "")
    return value or node.get("placeholder") or ""


def lay(node: Node, page: Page, inside: bool = False, ordered: Numbers | None = None):
    """Lays out a node's children; ordered has the numbers of the items of an ordered list."""
    for child in node.children:
        if isinstance(child, str):
            page.inline.append(child)
            continue
        tag = child.tag
        if not visible(child):
            continue
        if tag == "br":
            text = WHITE.sub(" ", "".join(page.inline)).strip(" ")
            page.inline.clear()
            page.line(text) if text else page.gap()
            continue
        if tag in ("svg", "select"):
            page.inline.append(" ")
            for part in _drawn(child) if tag == "svg" else _shown(child):
                yield lay(part, page)
                page.inline.append(" ")
            continue
        if tag not in BLOCK:
            if tag == "q" and not child.dark:
                page.inline.append('"')
            if tag in ("textarea", "button", "xmp", "plaintext", "label", "input", "img"):
                page.inline.append(" ")
            if tag == "input" and (text := _input(child)):
                page.inline.append(text + " ")
            yield lay(child, page)
            if tag == "q" and not child.dark:
                page.inline.append('"')
            if tag in ("textarea", "button", "xmp", "plaintext", "label"):
                page.inline.append(" ")
            continue
        page.gap() if tag in APART and not (node.tag == "li" and tag in ("ul", "ol", "menu")) else page.flush()
        if tag == "pre":
            text = _plain(child)
            for line in (text[1:] if text.startswith("\n") else text).rstrip().split("\n"):
                page.line(line.rstrip("\r"))
        elif tag == "table":
            yield lay_table(child, page)
        elif tag in ("ul", "menu"):
            yield lay(child, page)
        elif tag == "ol":
            yield lay(child, page, ordered=Numbers(child))
        elif tag == "li":
            mark = "- " if ordered is None else f"{ordered.take(child)}. "
            mark = " " * len(mark) if child.dark else mark
            before, outer = page.indent, page.mark
            page.indent, page.mark = before + " " * len(mark) * (len(before) < INDENT), mark
            yield lay(child, page)
            page.flush()
            page.indent, page.mark = before, outer if page.mark == mark else ""
        elif tag in ("blockquote", "dd"):
            before = page.indent
            page.indent += "  " * (len(before) < INDENT)
            yield lay(child, page)
            page.flush()
            page.indent = before
        elif tag == "details" and child.get("open") is None:
            yield lay(Node("div", "", [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]), page)
        else:
            yield lay(child, page)
        page.gap() if tag in APART and not (node.tag == "li" and tag in ("ul", "ol", "menu")) else page.flush()


def _plain(node: Node) -> str:
    out, todo = [], node.children[::-1]
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.tag == "br":
            out.append("\n")
        elif visible(child):
            todo += (_drawn(child) if child.tag == "svg" else _shown(child) if child.tag == "select" else child.children)[::-1]
    return "".join(out)


def render(source: str | None) -> str:
    """The visible text of a page; empty for null."""
    if not source:
        return ""
    page, root = Page(), parse(source)
    if "visibility" in source.lower():
        shade(root)
    _run(lay(root, page))
    page.flush()
    return "\n".join(page.lines)


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, text.

    A null or empty page, and one without visible text, gives an empty text. Text without any tag is one
    paragraph. Ids may be null or repeat. An empty table gives an empty result; other columns are ignored.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def rendered(sources: pd.Series) -> pd.Series:
        return sources.map(render)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), rendered(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op7_html_text": op7_html_text}
