"""Layout-aware text of HTML pages.

A tree is built with the tags that HTML implies (body, p, li, dt, dd, option, tbody, tr, td and their ends, that of colgroup; text
misplaced in a table goes before it), then rendered: each block starts a line, blocks with margins keep one blank line
around them, list items carry their bullet or number and indentation, and the cells of a table are set in columns.
Everything visible is emitted, navigation and advertisements too. Invisible are: head, script, style, template, noscript
and the fallback of embedded media; what svg and math only define or describe; the attribute ``hidden``; ``display:none`` and inherited ``visibility:hidden`` of
style attributes and of rules with a simple selector in the page's own style sheets; closed ``details`` but their summary;
closed ``dialog``; all but the chosen option of a drop-down list.

Whitespace collapses, but for ``pre`` and ``textarea``. Columns are padded to ``PAD`` characters at most, so that a table
used for layout can't multiply a long text: cells behind a longer one are set off by two spaces. Tables nested deeper than
``DEPTH`` are rendered as plain blocks. Both change the layout only, no text is lost. An end tag closes an element among the
last ``REACH`` open ones, so time grows with the page also where nothing is ever closed.

A null or empty page has an empty text. Unclosed or misnested tags never fail. Repeated rows are rendered each on its own;
an empty table gives no rows.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

#: Widest column that is padded, tables within tables that are set in columns, and what stands between columns.
PAD, DEPTH, GAP = 80, 12, "  "
#: How many open elements are looked through for one that an end tag or an implied end names; deeper ones stay open.
REACH = 512

# What HTML says about elements. Fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes audio video canvas object datalist map".split())
#: Not shown inside svg or math.
FOREIGN_UNSEEN = frozenset("annotation annotation-xml defs desc metadata symbol".split())
PARAGRAPHS = frozenset("blockquote center dir dl figure form h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul fieldset xmp listing".split())
LINES = frozenset(
    "address article aside body caption dd details dialog div dt fieldset figcaption footer header hgroup html legend li main nav optgroup section summary".split()
)
BLOCKS = PARAGRAPHS | LINES
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "optgroup"}
TABLE_PARTS = frozenset("table thead tbody tfoot tr".split())
#: Opening the first closes any of the second that is open within the third.
IMPLIED_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "optgroup", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("td", "th", "tr", "caption"), ("thead", "tbody", "tfoot", "table")),
    "thead": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption"), ("table",)), "tbody": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("td", "th", "tr", "thead", "tbody", "tfoot", "caption"), ("table",)),
}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>""", re.S
)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_SIMPLE = re.compile(r"[a-zA-Z][\w-]*|[.#][\w-]+|[a-zA-Z][\w-]*[.#][\w-]+")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDES = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def _insert_before(children: list, node: Node, new) -> None:
    """Puts ``new`` before ``node``, which is among the last children."""
    at = len(children) - 1
    while children[at] is not node:
        at -= 1
    children.insert(at, new)


class Builder:
    """Builds the tree of one page."""

    def __init__(self):
        self.root = Node("html")
        self.head, self.body = Node("head"), Node("body")
        self.root.children = [self.head, self.body]
        self.stack, self.styles, self.title = [self.root, self.head], [], ""
        self.foreign = 0

    def leave_head(self) -> None:
        if self.stack[1] is self.head:
            self.stack[1:] = [self.body]

    def text(self, raw: str) -> None:
        if not raw:
            return
        if len(self.stack) == 2 and self.stack[1] is self.head:
            if raw.isspace():
                return
            self.leave_head()
        data = html.unescape(raw) if "&" in raw else raw
        if self.stack[-1].tag == "colgroup" and not raw.isspace():
            self.stack.pop()
        top = self.stack[-1]
        if top.tag in TABLE_PARTS:
            if not raw.isspace():
                at = max(i for i, n in enumerate(self.stack) if n.tag in TABLE_PARTS and (n.tag == "table" or i == 2))
                above, table = self.stack[at - 1], self.stack[at]
                _insert_before(above.children, table, data)
            return
        top.children.append(data)

    def close(self, tags: tuple[str, ...], within: tuple[str, ...]) -> None:
        """Ends the outermost open element of ``tags`` inside the innermost of ``within``."""
        found = 0
        for i in range(len(self.stack) - 1, max(1, len(self.stack) - REACH), -1):
            tag = self.stack[i].tag
            if tag in tags:
                found = i
            elif tag in within or (tag == "table" and "table" not in tags):
                break
        if found:
            self.leave(found)

    def leave(self, at: int) -> None:
        """Closes the open elements from that place on."""
        self.foreign -= sum(n.tag in ("svg", "math") for n in self.stack[at:])
        del self.stack[at:]

    def push(self, node: Node) -> None:
        self.foreign += node.tag in ("svg", "math")
        self.stack.append(node)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "body", "head"):
            node = {"html": self.root, "body": self.body, "head": self.head}[tag]
            for k, v in attrs.items():
                node.attrs.setdefault(k, v)
            if tag == "body":
                self.leave_head()
            return
        if self.stack[1] is self.head and tag not in IN_HEAD:
            self.leave_head()
        foreign = self.foreign > 0
        if foreign and tag in FOREIGN_UNSEEN:
            attrs = attrs | {"hidden": ""}
        if self.stack[-1].tag == "colgroup" and tag not in ("col", "template"):
            self.stack.pop()
        if tag in IMPLIED_ENDS:
            self.close(*IMPLIED_ENDS[tag])
        if tag in CLOSES_P:
            self.close(("p",), ("td", "th", "button", "caption"))
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.stack.pop()
        if tag in ("td", "th"):
            self.imply("table", "tbody")
            for part in ("thead", "tbody", "tfoot"):
                self.imply(part, "tr")
        elif tag == "tr":
            self.imply("table", "tbody")
        elif self.stack[-1].tag in TABLE_PARTS and tag not in ("caption", "colgroup", "col", "script", "style", "template", "thead", "tbody", "tfoot"):
            # misplaced in a table: before it
            at = max(i for i, n in enumerate(self.stack) if n.tag in TABLE_PARTS and (n.tag == "table" or i == 2))
            above, table = self.stack[at - 1], self.stack[at]
            node = Node(tag, attrs)
            _insert_before(above.children, table, node)
            if tag not in VOID and not closed:
                self.push(node)
            return
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag not in VOID and not (closed and (foreign or tag in ("svg", "math", "path"))):
            self.push(node)

    def imply(self, inside: str, tag: str) -> None:
        if self.stack[-1].tag == inside:
            node = Node(tag)
            self.stack[-1].children.append(node)
            self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag == "head":
            self.leave_head()
            return
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.start("br", {}, False)
            return
        for i in range(len(self.stack) - 1, max(1, len(self.stack) - REACH), -1):
            open_tag = self.stack[i].tag
            if open_tag == tag:
                if tag not in BLOCKS and any(n.tag in BLOCKS for n in self.stack[i + 1 :]):
                    del self.stack[i]  # a block that began inside goes on
                else:
                    self.leave(i)
                return
            if open_tag in ("td", "th", "caption", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                break
        if tag == "p":
            self.start("p", {}, False)
            self.stack.pop()

    def feed(self, page: str) -> Node:
        at, end = 0, len(page)
        last = page.rfind(">") + 1  # no tag ends behind it; a comment may begin there and last to the end
        open_comment = page.find("<!--", last)
        page, end = (page[:open_comment], open_comment) if open_comment >= 0 else (page, end)
        while at < end:
            m = _TOKEN.search(page, at, last) if at < last else None
            if not m:
                self.text(page[at:])
                break
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if not tag:
                continue
            tag = tag.lower()
            if m["end"]:
                self.end(tag)
                continue
            attrs = m["attrs"]
            self.start(tag, _attributes(attrs) if attrs and not attrs.isspace() else {}, attrs.endswith("/"))
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
                inside = page[at : close.start() if close else end]
                at = close.end() if close else end
                if tag == "style":
                    self.styles.append(inside)
                elif tag == "title" and not self.title:
                    self.title = _SPACE.sub(" ", html.unescape(inside)).strip()
                elif tag in ("textarea", "xmp"):
                    self.stack[-1].children.append(html.unescape(inside) if tag == "textarea" else inside)
                if len(self.stack) > 2:
                    self.stack.pop()
        return self.root


def hiding_rules(styles: list[str]) -> dict[str, str]:
    """Simple selectors whose rules hide, with what they say: none, hidden or visible."""
    out: dict[str, str] = {}
    for sheet in styles:
        for selectors, body in _RULE.findall(re.sub(r"(?s)/\*.*?\*/", "", sheet)):
            seen = _VISIBILITY.search(body)
            says = "none" if _HIDES.search(body) else seen[1].lower() if seen else None
            if says:
                for s in selectors.split(","):
                    if _SIMPLE.fullmatch(s.strip()):
                        out[s.strip()] = says
    return out


class Renderer:
    """Writes the text of a tree. Lines so far, the line being written, and what the next text must have before it."""

    def __init__(self, rules: dict[str, str]):
        self.rules = rules

    def says(self, node: Node) -> str | None:
        attrs = node.attrs
        if node.tag in UNSEEN or "hidden" in attrs:
            return "none"
        style = attrs.get("style")
        if style:
            if _HIDES.search(style):
                return "none"
            if seen := _VISIBILITY.search(style):
                return seen[1].lower()
        if self.rules:
            names = [node.tag, *(f".{c}" for c in attrs.get("class", "").split()), *([f"#{attrs['id']}"] if "id" in attrs else [])]
            for name in [*names[1:], *(node.tag + n for n in names[1:]), names[0]]:
                if name in self.rules:
                    return self.rules[name]
        if node.tag == "dialog" and "open" not in attrs:
            return "none"
        if node.tag == "input" and attrs.get("type", "").lower() not in ("submit", "reset", "button"):
            return "none"
        return None

    def render(self, top: Node, depth: int = 0) -> list[str]:
        lines: list[str] = []
        line: list[str] = []
        state = {"space": False, "blank": False, "mark": ""}
        indents: list[str] = [""]

        def flush() -> None:
            if line:
                lines.append((indents[-1][: len(indents[-1]) - len(state["mark"])] + state["mark"] if state["mark"] else indents[-1]) + "".join(line))
                line.clear()
                state["mark"] = ""
            state["space"] = False

        def blank() -> None:
            flush()
            state["blank"] = bool(lines)

        def begin() -> None:
            if not line and state["blank"]:
                if lines and lines[-1]:
                    lines.append("")
                state["blank"] = False

        def write(data: str, pre: bool, seen: bool) -> None:
            if not seen:
                return
            if pre:
                pieces = data.replace("\r\n", "\n").split("\n")
                for i, piece in enumerate(pieces):
                    if i:
                        if not line and lines:
                            begin()
                            lines.append("")
                        flush()
                    if piece:
                        begin()
                        line.append(piece)
                return
            words = _SPACE.split(data)
            if not words[0]:
                state["space"] = state["space"] or bool(line)
                words = words[1:]
            trailing = bool(words) and not words[-1]
            words = words[:-1] if trailing else words
            if words:
                begin()
                if state["space"] and line:
                    line.append(" ")
                line.append(" ".join(words))
                state["space"] = False
            if trailing:
                state["space"] = bool(line)

        # (what, node, inherited): children are pushed in reverse, an element's end after them
        todo: list = [("open", top, (False, True))]
        counters: list = []
        while todo:
            what, node, (pre, seen) = todo.pop()
            if what == "open":
                if isinstance(node, str):
                    write(node, pre, seen)
                    continue
                says = self.says(node)
                if says == "none":
                    continue
                seen = seen if says is None else says == "visible"
                tag = node.tag
                if tag == "br":
                    if line or state["mark"]:
                        begin()
                        line.append("") if not line else None
                        flush()
                    elif seen and lines:
                        begin()
                        lines.append("")
                    continue
                if tag == "hr":
                    blank()
                    if seen:
                        begin()
                        line.append("-" * 8)
                    blank()
                    continue
                if tag == "input":
                    write(node.attrs.get("value", ""), False, seen)
                    continue
                if tag == "table" and depth < DEPTH:
                    table = self.table(node, depth + 1, seen)
                    blank()
                    for row in table:
                        begin()
                        line.append(row)
                        flush()
                    blank()
                    continue
                if tag in PARAGRAPHS and not (tag in ("ul", "ol", "menu", "dir") and counters):
                    blank()
                elif tag in BLOCKS or tag in ("tr", "tbody", "thead", "tfoot", "table"):
                    flush()
                elif tag in ("td", "th"):
                    state["space"] = bool(line)
                children = node.children
                if tag in ("ul", "ol", "menu", "dir"):
                    counters.append([int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start", "")) else 1] if tag == "ol" else None)
                elif tag == "li":
                    mark = "- "
                    if counters and counters[-1]:
                        if re.fullmatch(r"-?\d{1,9}", node.attrs.get("value", "")):
                            counters[-1][0] = int(node.attrs["value"])
                        mark = f"{counters[-1][0]}. "
                        counters[-1][0] += 1
                    indents.append(indents[-1] + " " * len(mark))
                    state["mark"] = mark if seen else ""
                elif tag in ("blockquote", "dd"):
                    indents.append(indents[-1] + "  ")
                elif tag == "details" and "open" not in node.attrs:
                    children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
                elif tag == "select" and "multiple" not in node.attrs:
                    options = [o for c in children if isinstance(c, Node) for o in ([c] if c.tag == "option" else c.children) if isinstance(o, Node) and o.tag == "option"]
                    children = [next((o for o in options if "selected" in o.attrs), options[0])] if options else []
                todo.append(("close", node, (pre, seen)))
                inner = (pre or tag in ("pre", "textarea", "xmp", "listing"), seen)
                if inner[0] and not pre and children and isinstance(children[0], str) and children[0][:1] == "\n":
                    children = [children[0][1:], *children[1:]]
                todo.extend(("open", c, inner) for c in reversed(children))
                continue
            tag = node.tag
            if tag == "li":
                flush()
                state["mark"] = ""
                indents.pop()
            elif tag in ("blockquote", "dd"):
                flush()
                indents.pop()
            if tag in ("ul", "ol", "menu", "dir"):
                counters.pop()
                flush() if counters else blank()
            elif tag in PARAGRAPHS:
                blank()
            elif tag in BLOCKS or tag == "tr":
                flush()
        flush()
        while lines and not lines[-1].strip():
            lines.pop()
        return [x.rstrip() for x in lines]

    def table(self, node: Node, depth: int, seen: bool) -> list[str]:
        """The rows of a table, each line with its cells in columns."""
        out: list[str] = []
        rows: list[list[tuple[Node, bool]]] = []

        def inherits(part: Node, seen: bool) -> bool | None:
            """Whether what is in ``part`` is seen unless it says otherwise; None if nothing of it is rendered."""
            says = self.says(part)
            return None if says == "none" else seen if says is None else says == "visible"

        def parts(of: Node, seen: bool):
            for c in of.children:
                if isinstance(c, Node) and (own := inherits(c, seen)) is not None:
                    yield c, own

        for c, own in parts(node, seen):
            if c.tag == "tr":
                rows.append([x for x in parts(c, own) if x[0].tag in ("td", "th")])
            elif c.tag in ("thead", "tbody", "tfoot"):
                rows.extend([x for x in parts(r, shown) if x[0].tag in ("td", "th")] for r, shown in parts(c, own) if r.tag == "tr")
            elif c.tag == "caption":
                out += self.block(c, depth, own)
        taken: dict[int, int] = {}  # column: rows that a cell above still fills
        grid: list[list[tuple[int, int, list[str], str]]] = []
        widths: dict[int, int] = {}
        for cells in rows:
            placed, column, now = [], 0, dict(taken)
            taken = {k: v - 1 for k, v in taken.items() if v > 1}
            for cell, shown in cells:
                while now.get(column, 0) > 0:
                    column += 1
                span = _number(cell.attrs.get("colspan"), 1000)
                down = _number(cell.attrs.get("rowspan"), len(rows))
                text = self.block(cell, depth, shown)
                align = (cell.attrs.get("align") or "".join(re.findall(r"text-align\s*:\s*(\w+)", cell.attrs.get("style", ""))[:1])).lower()
                placed.append((column, span, text, align))
                if down > 1:
                    taken |= {k: down - 1 for k in range(column, column + span)}
                if span == 1:
                    widths[column] = max(widths.get(column, 0), min(PAD, max(map(len, text), default=0)))
                column += span
            grid.append(placed)
        last = max((column + span for placed in grid for column, span, *_ in placed), default=0)
        begins = [0]
        for c in range(last):
            begins.append(begins[-1] + (widths[c] + len(GAP) if c in widths else 0))
        for placed in grid:
            for k in range(max((len(text) for *_, text, _ in placed), default=0)):
                row = ""
                for column, span, text, align in placed:
                    at = begins[column]
                    room = max(0, begins[column + span] - at - len(GAP))
                    piece = text[k] if k < len(text) else ""
                    piece = piece.rjust(room) if align == "right" else piece.center(room) if align == "center" else piece
                    if not piece.strip():
                        continue
                    row = row.ljust(at) if len(row) + len(GAP) <= at or not row else row.rstrip() + GAP
                    row += piece
                out.append(row.rstrip())
        return [x for x in out if x] if len(out) else []

    def block(self, node: Node, depth: int, seen: bool) -> list[str]:
        inner = Node("div")
        inner.children = node.children
        inner.attrs = {} if seen else {"style": "visibility:hidden"}
        return self.render(inner, depth)


def _number(text: str | None, most: int) -> int:
    return min(max(int(text), 1), most) if text and re.fullmatch(r"\d{1,9}", text.strip()) else 1


def page_text(page: str | None) -> tuple[str, str]:
    """(title, text) of a page."""
    if not page:
        return "", ""
    builder = Builder()
    tree = builder.feed(page)
    return builder.title, "\n".join(Renderer(hiding_rules(builder.styles)).render(tree))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, title, text, n_lines of each row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [page_text(p) for p in part.column(1).to_pylist()]
                yield pa.record_batch({
                    "page_id": part.column(0), "title": pa.array([t for t, _ in found], pa.string()), "text": pa.array([t for _, t in found], pa.string()),
                    "n_lines": pa.array([t.count("\n") + 1 if t else 0 for _, t in found], pa.int32()),
                })

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, title string, text string, n_lines int")
