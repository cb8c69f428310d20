"""HTML extraction by layout-aware rendering.

A tree builder reads the tags of a page, adds the ones that HTML implies (a paragraph
ends at the next block, a list item at the next, cells and rows at theirs, and so on),
and a renderer walks the tree and writes all visible text: blocks on lines of their own,
paragraphs and headings apart by an empty line, list items with a bullet or a number and
indented by depth, tables with cells aligned in columns (cells that span rows or columns, and
wide characters, counted as such), preformatted text as it is, the values of form fields.
Invisible are: the head, scripts, styles, templates, comments, embedded objects and media,
drop-down lists, elements with ``hidden``, ``aria-hidden="true"``, ``type="hidden"``, or that an inline
style, or a rule of a style sheet in the page, gives ``display: none``; text under ``visibility: hidden``
unless something in between says ``visible``. Of style sheets, rules count whose selector is a tag, id
and classes of the element itself, outside of at-rules; the last one wins, an inline style over all.

The tree is built and walked without recursion but for tables within tables, NESTED deep.

Defined results: null and empty pages give empty text; broken markup gives the text that
is there; an unclosed element ends with its parent; rows are rendered each on its own, whole,
however long (a page is one step of one task); an empty table gives an empty table. Input columns stay; one that bears a result's name is
replaced.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown.
HIDDEN = frozenset("head script style template noscript title object iframe datalist select canvas audio video defs desc metadata annotation".split())
#: Elements that begin and end a line.
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: Blocks that stand apart by an empty line.
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
#: What a start tag ends, up to the given boundary.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
#: Tables within tables whose cells are aligned; deeper ones come cell by cell.
NESTED = 20
_TABLE = frozenset("table thead tbody tfoot tr".split())
_IN_TABLE = frozenset("caption colgroup col thead tbody tfoot tr td th script style template".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_LOOK = re.compile(r"(?<![\w-])(display|visibility)\s*:\s*([a-z-]+)", re.I)
_AT_RULE = re.compile(r"@[^{};]*(?:;|\{(?:[^{}]*\{[^{}]*\})*[^{}]*\})")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)", re.I)
#: Kinds of form fields that show no text.
_NO_TEXT = frozenset("hidden password checkbox radio file color range image".split())


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


class Looks:
    """What is shown: by tags and attributes, inline styles and the style sheets of a page."""

    def __init__(self, sheets: str) -> None:
        self.rules: dict[str, list[tuple[int, str, frozenset[str], dict[str, str]]]] = {}  # by an id, class or tag that must be there
        for i, (selectors, body) in enumerate(_RULE.findall(_AT_RULE.sub(" ", re.sub(r"/\*.*?\*/", " ", sheets, flags=re.S)))):
            look = _look(body)
            for x in selectors.split(",") if look else ():
                m = _SELECTOR.fullmatch(x.strip())
                if m and m[0]:
                    parts = frozenset(re.findall(r"[.#][\w-]+", m[2]))
                    tag = (m[1] or "").lower()
                    self.rules.setdefault(min(parts, default=tag), []).append((i, tag, parts, look))

    def of(self, node: Node) -> dict[str, str]:
        a = node.attrs
        found: dict[str, str] = {}
        if self.rules:
            own = {f".{c}" for c in a.get("class", "").split()} | ({f"#{a['id']}"} if "id" in a else set())
            for _, tag, parts, look in sorted((r for k in (node.tag, *own) for r in self.rules.get(k, ())), key=lambda r: r[0]):
                if tag in ("", node.tag) and parts <= own:
                    found |= look
        return found | _look(a["style"]) if "style" in a else found

    def visible(self, node: Node) -> bool:
        a = node.attrs
        return not (node.tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or (self.rules or "style" in a) and self.of(node).get("display") == "none")

    def shows_text(self, node: Node, above: bool) -> bool:
        """Whether text in the node shows by its visibility, or that of what is above."""
        own = self.of(node).get("visibility") if self.rules or "style" in node.attrs else None
        return above if own in (None, "inherit") else own == "visible"


def _look(style: str) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in _LOOK.findall(style)}


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # of open elements
        self.sheets: list[str] = []

    def close_until(self, tags: set[str] | frozenset[str], bounds: set[str]) -> None:
        """End the nearest of tags that is open above any of bounds."""
        if not any(self.count[t] for t in tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self.count.subtract(n.tag for n in self.open[i:])
                del self.open[i:]
                return
            if self.open[i].tag in bounds:
                return

    def place(self, child: Node | str) -> None:
        """Add to the open element; what tables can't hold goes before the table."""
        at = self.open[-1]
        if at.tag in _TABLE and not (child.isspace() if isinstance(child, str) else child.tag in _IN_TABLE):
            i = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == "table"), 0)
            if i:
                self.open[i - 1].children.insert(-1, child)
                return
        at.children.append(child)

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.place(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        found = {k: v or "" for k, v in attrs}
        if tag == "html":
            return
        if tag in BLOCK:
            self.close_until({"p"}, {"table", "td", "th", "li", "div", "section", "article", "blockquote", "button"})
            if tag != "head":
                self.close_until({"head"}, {"body"})
        if tag == "table" and self.open[-1].tag in _TABLE:
            self.close_until({"table"}, set())
        if tag in _CLOSES:
            self.close_until(*_CLOSES[tag])
        if tag in ("td", "th") and not self.inside("tr"):
            self.push("tr", {})
        if tag == "tr" and self.open[-1].tag == "td":
            self.close_until({"td"}, {"table"})
        self.push(tag, found)

    def inside(self, tag: str) -> bool:
        for n in reversed(self.open):
            if n.tag == tag:
                return True
            if n.tag == "table":
                return False
        return False

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends only void elements

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.push("br", {})
        elif tag == "p" and not self.count["p"]:
            self.push("p", {})
            self.close_until({"p"}, set())
        else:
            bounds = {"table"} if tag not in ("table", "body") else set()
            self.close_until({tag}, bounds)

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style":
            self.sheets.append(data)
        self.place(data)


class Output:
    """Lines of text with collapsed white space and pending breaks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = False  # an empty line is due before the next text
        self.prefix, self.rest = "", ""  # of the next line and of those after it

    def text(self, s: str) -> None:
        parts = _SPACE.split(s)
        for i, p in enumerate(parts):
            self.space |= i > 0 and bool(self.line)
            if p:
                if not self.line:
                    self.begin()
                self.line.append(" " + p if self.space else p)
                self.space = False

    def begin(self) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.line.append(self.prefix)
        self.prefix = self.rest

    def end(self, gap: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False
        self.gap |= gap

    def raw(self, lines: list[str]) -> None:
        for x in lines:
            self.begin()
            self.line.append(x)
            self.end()


def width(text: str) -> int:
    """Columns that a line takes: two for wide characters, none for marks that stand on others."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.category(c) in ("Mn", "Me", "Cf") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _number(text: str | None, least: int, most: int) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,9}", text.strip()) and least <= int(text) <= most else None


class Renderer:
    def __init__(self, looks: Looks) -> None:
        self.looks = looks

    def rows(self, table: Node, shows: bool) -> list[tuple[Node, bool]]:
        """Rows of a table, and whether text shows in them."""
        out = []
        for c in table.children:
            if isinstance(c, Node) and self.looks.visible(c):
                below = self.looks.shows_text(c, shows)
                if c.tag == "tr":
                    out.append((c, below))
                elif c.tag in ("thead", "tbody", "tfoot"):
                    out += [(r, self.looks.shows_text(r, below)) for r in c.children if isinstance(r, Node) and r.tag == "tr" and self.looks.visible(r)]
        return out

    def table(self, table: Node, depth: int, shows: bool) -> list[str]:
        """Rows of cells in columns of equal width; a cell of several lines takes several; below a cell that spans rows its column is empty."""
        rows = self.rows(table, shows)
        grid: list[list[tuple[int, int, list[str]]]] = [[] for _ in rows]  # first column, columns and lines of each cell
        taken: dict[int, int] = {}  # columns that cells above still span, and the row where that ends
        for y, (row, below) in enumerate(rows):
            x = 0
            for c in row.children:
                if not (isinstance(c, Node) and c.tag in ("td", "th") and self.looks.visible(c)):
                    continue
                while taken.get(x, 0) > y:
                    x += 1
                columns = _number(c.attrs.get("colspan"), 1, 1000) or 1
                down = _number(c.attrs.get("rowspan"), 0, 65534)
                grid[y].append((x, columns, self.render(c, depth + 1, self.looks.shows_text(c, below)).split("\n")))
                if down is not None and down != 1:
                    taken.update(dict.fromkeys(range(x, x + columns), y + down if down else len(rows)))
                x += columns
        wide: dict[int, int] = {}
        for row in grid:
            for x, columns, lines in row:
                if columns == 1:
                    wide[x] = max(wide.get(x, 0), *map(width, lines))
        out = []
        for row in grid:
            for k in range(max((len(lines) for _, _, lines in row), default=0)):
                parts, at = [], 0
                for x, columns, lines in row:
                    parts += [" " * wide.get(i, 0) for i in range(at, x)]
                    text = lines[k] if k < len(lines) else ""
                    parts.append(text + " " * (sum(wide.get(i, 0) for i in range(x, x + columns)) + 3 * (columns - 1) - width(text)))
                    at = x + columns
                out.append(" | ".join(parts).rstrip())
        return [x for x in out if x.strip(" |")]

    def plain(self, root: Node, shows: bool) -> str:
        out: list[str] = []
        stack = [(c, shows) for c in reversed(root.children)]
        while stack:
            n, below = stack.pop()
            if isinstance(n, str):
                out.append(n if below else "\n" * n.count("\n"))
            elif n.tag == "br":
                out.append("\n")
            elif self.looks.visible(n):
                below = self.looks.shows_text(n, below)
                stack += [(c, below) for c in reversed(n.children)]
        return "".join(out)

    def field(self, node: Node) -> str:
        """Text that a form field shows: its value, or else what stands there for none."""
        kind = node.attrs.get("type", "text").lower()
        return "" if kind in _NO_TEXT else node.attrs.get("value") or ("" if kind in ("submit", "button", "reset") else node.attrs.get("placeholder", ""))

    def render(self, root: Node, depth: int = 0, shows: bool = True) -> str:
        """Visible text below a node; depth: of tables around it."""
        out = Output()
        stack: list[tuple[Node | str, bool, tuple]] = [(c, shows, None) for c in reversed(root.children)]
        lists: list[list] = []  # [tag, number] of the lists that are open
        while stack:
            node, shows, leave = stack.pop()
            if isinstance(node, str):
                if shows:
                    out.text(node)
                continue
            if leave is not None:
                if node.tag in BLOCK:
                    out.end(node.tag in APART and (node.tag not in ("ul", "ol") or not lists[:-1]))
                if node.tag in ("ul", "ol"):
                    lists.pop()
                if leave:
                    out.prefix, out.rest = leave
                continue
            if not self.looks.visible(node):
                continue
            shows = self.looks.shows_text(node, shows)
            if node.tag == "br":
                if out.line:
                    out.end()
                continue
            if node.tag in ("img", "input"):
                text = node.attrs.get("alt", "") if node.tag == "img" else self.field(node)
                if text and shows:
                    out.text(text)
                continue
            if node.tag in BLOCK:
                out.end(node.tag in APART and not (node.tag in ("ul", "ol") and lists))
            if node.tag == "table" and depth < NESTED:
                for c in node.children:
                    if isinstance(c, Node) and c.tag == "caption" and self.looks.visible(c):
                        out.text(self.render(c, depth + 1, self.looks.shows_text(c, shows)))
                        out.end()
                out.raw(self.table(node, depth, shows))
                out.end(True)
                continue
            if node.tag == "pre":
                out.raw(self.plain(node, shows).strip("\n").split("\n"))
                out.end(True)
                continue
            before = ()
            if node.tag in ("ul", "ol"):
                start = _number(node.attrs.get("start"), -(10**9), 10**9)
                lists.append([node.tag, 1 if start is None else start])
            elif node.tag == "li":
                before = (out.rest, out.rest)
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    value = _number(node.attrs.get("value"), -(10**9), 10**9)
                    lists[-1][1] = lists[-1][1] if value is None else value
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                out.prefix, out.rest = out.rest + mark, out.rest + " " * len(mark)
            elif node.tag in ("dd", "blockquote"):
                before = (out.rest, out.rest)
                out.prefix = out.rest = out.rest + "  "
            stack.append((node, shows, before))
            stack += [(c, shows, None) for c in reversed(node.children)]
        out.end()
        return "\n".join(out.lines)


def extract(html: str | None) -> str:
    """Visible text of a page."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    return Renderer(Looks(" ".join(builder.sheets))).render(builder.root)


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the visible text."""
    df = pages.drop(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(html_col)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, text_col])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(text_col, StringType())]))
