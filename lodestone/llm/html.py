"""HTML extraction by layout-aware rendering.

A tree builder reads tags with the implied ends and starts of HTML (an li ends an li, a block ends a p, a
cell opens a row, void elements hold nothing), keeps the open elements on a stack, and renders as it goes:
blocks part lines, headings and paragraphs stand apart, lists get marks and depth, cells of a table are
padded to columns, a cell over several rows keeps its column free below it, preformatted text keeps its blanks.
Everything visible is kept, menus and footers too; scripts, styles, heads, comments and whatever is hidden by
attribute or inline style are not; a visible element inside an invisible one (by visibility) is. Formulas, texts of
drawings, all choices of a form and open dialogs are kept; what a browser shows only in place of embedded media
(in iframe, audio, video, canvas, and object with data) is not, nor are datalists and closed dialogs.

Defined results: a null or empty page gives an empty text; tags that never end, stray ends, unknown elements
and bare < are taken as browsers do, without error; nesting of any depth needs no recursion and a fixed time a tag; lines
are indented by INDENT characters at most; columns are padded to pad_limit characters at most, longer cells run
over whole; repeated rows give repeated rows; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import lean, read, slices, spread, texts_of

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset("head script style title iframe noembed noframes noscript template datalist audio video canvas".split())
#: Parts of drawings and formulas that aren't drawn where they stand.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker annotation annotation-xml".split())
APART = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCK = APART | frozenset("address article aside body center details dd dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav search section summary caption dialog select option optgroup".split())
ENDS_P = APART | frozenset("address article aside center details dir div dl fieldset figcaption footer form header hgroup main menu nav search section summary li dd dt".split())
#: An opening tag ends the nearest open element named, unless one of the walls stands before it.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "optgroup": ({"optgroup"}, {"select"})} | {x: ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for x in ("thead", "tbody", "tfoot", "colgroup")}
SCOPE = frozenset("table td th caption html body".split())
NOT_DISPLAYED = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Indents of deeply nested lists end here, or the text would grow with the square of the depth.
INDENT = 80
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
TAG = re.compile(r"""<(?:!--(?P<note>)|(?P<slash>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+)>|[!?/][^>]*+>)""")
BLANKS = re.compile(r"[ \t\r\n\f]+")


class Flow:
    """Lines under way: finished lines, the line being written, and whether the next block stands apart."""

    def __init__(self, indent: str = "") -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.mark, self.indent, self.blank, self.written = False, "", indent, False, False
        self.dents: list[str] = []  # indents outside the open dd elements

    def text(self, data: str, kept: bool) -> None:
        if kept:
            first, *rest = data.split("\n")
            self.write(first)
            for x in rest:
                self.line(force=True)
                self.write(x)
            return
        body = BLANKS.sub(" ", data)
        if body.startswith(" "):
            self.blank, body = True, body[1:]
        if body.strip(" "):
            if self.blank and self.now:
                self.now.append(" ")
            tail = body.endswith(" ")
            self.write(body[:-1] if tail else body)
            self.blank = tail

    def write(self, data: str) -> None:
        if data:
            self.now.append(data)

    def line(self, force: bool = False) -> None:
        """End the line; an empty one is kept only if forced."""
        data = "".join(self.now).rstrip(" ")
        self.now, self.blank = [], False
        if data or force:
            if self.gap and self.written:
                self.lines.append("")
            self.gap = False
            lead = self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent
            self.lines.append((lead + data).rstrip(" ") if data else "")
            self.mark, self.written = "", True

    def extend(self, lines: list[str]) -> None:
        self.line()
        for x in lines:
            self.write(x)
            self.line(force=True)


def attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def placed(rows: list[list[tuple[list[str], int, int]]]) -> list[list[tuple[list[str], int]]]:
    """Rows of (lines, columns taken), with an empty cell where one of an earlier row (lines, columns, rows taken) reaches down."""
    below: dict[int, int] = {}  # column: rows that it is still taken for
    out = []
    for row in rows:
        taken, cells, at = {c for c, n in below.items() if n > 0}, [], 0
        below = {c: n - 1 for c, n in below.items() if n > 1}
        for lines, span, down in row:
            while at in taken:
                cells.append(([], 1))
                at += 1
            cells.append((lines, span))
            if down > 1:
                below.update((c, down - 1) for c in range(at, at + span))
            at += span
        out.append(cells)
    return out


def align(spanned: list[list[tuple[list[str], int, int]]], pad_limit: int) -> list[str]:
    """Rows of (lines, columns taken, rows taken) as lines of text with padded columns."""
    rows = placed(spanned)
    widths: dict[int, int] = {}
    for row in rows:
        at = 0
        for lines, span in row:
            if span == 1:
                widths[at] = max(widths.get(at, 0), min(pad_limit, max(map(len, lines), default=0)))
            at += span
    out = []
    for row in rows:
        for k in range(max((len(lines) for lines, _ in row), default=0)):
            cells, at = [], 0
            for lines, span in row:
                width = sum(widths.get(c, 0) for c in range(at, at + span)) + 3 * (span - 1)
                cells.append((lines[k] if k < len(lines) else "").ljust(min(width, pad_limit)))
                at += span
            out.append(" | ".join(cells).rstrip(" "))
    return out


class Renderer:
    def __init__(self, pad_limit: int) -> None:
        self.pad_limit = pad_limit
        self.open: list[tuple[str, bool, bool]] = []  # name, hidden by itself, whether all was invisible before it
        self.places: dict[str, list[int]] = {}  # where in open each name stands
        self.hidden = self.kept = self.foreign = 0  # foreign: open svg and math
        self.veiled = False
        self.flows = [Flow()]
        self.lists: list[list] = []  # name, number
        self.tables: list[dict] = []

    @property
    def flow(self) -> Flow:
        return self.flows[-1]

    def data(self, text: str) -> None:
        if self.hidden or self.veiled or not text:
            return
        if self.open and self.open[-1][0] in ("table", "tr", "tbody", "thead", "tfoot", "colgroup") and not text.strip():
            return
        self.flow.text(html.unescape(text), self.kept > 0)

    def last(self, names: set[str] | frozenset[str]) -> int:
        """Where the innermost open element of these names stands, -1 if none is open."""
        return max((own[-1] for n in names if (own := self.places.get(n))), default=-1)

    def near(self, names: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> int:
        """The innermost open element of names, unless one of the walls stands inside it."""
        at = self.last(names)
        return at if at >= self.last(walls - names) else -1

    def start(self, name: str, rest: str) -> None:
        if name in ENDS and (i := self.near(*ENDS[name])) >= 0:
            self.close_to(i)
        if name in ENDS_P and (i := self.near({"p"}, SCOPE | {"button"})) >= 0:
            self.close_to(i)
        if name in ("td", "th") and self.tables and self.near({"tr"}, {"table"}) < 0:
            self.start("tr", "")
        found = attributes(rest) if rest.strip(" /\t\r\n") else {}
        hides = name in UNSEEN or "hidden" in found or bool(NOT_DISPLAYED.search(found.get("style", ""))) or (name == "input" and found.get("type", "").lower() == "hidden")
        hides = hides or (name == "dialog" and "open" not in found) or (name == "object" and "data" in found) or (self.foreign > 0 and name in UNDRAWN)
        if (self.foreign or name in ("svg", "math")) and rest.endswith("/"):
            return
        if name in VOID:
            if self.hidden or hides or (self.veiled and name != "br"):
                return
            if name == "br":
                self.flow.line(force=True)
            elif name == "hr":
                self.flow.line()
                self.flow.gap = True
            elif name == "img" and found.get("alt"):
                self.flow.text(found["alt"], False)
            elif name == "input" and found.get("type", "text").lower() in ("button", "submit", "reset") and found.get("value"):
                self.flow.text(found["value"], False)
            return
        self.places.setdefault(name, []).append(len(self.open))
        self.open.append((name, hides, self.veiled))
        self.hidden += hides
        if seen := VISIBILITY.search(found.get("style", "")):
            self.veiled = seen[1].lower() != "visible"
        self.foreign += name in ("svg", "math")
        if self.hidden:
            return
        if name in BLOCK or (self.foreign and name == "text"):
            self.flow.line()
            if name in APART and not (self.lists and name in ("ul", "ol")):
                self.flow.gap = True
        if name == "optgroup" and found.get("label") and not self.veiled:
            self.flow.text(found["label"], False)
            self.flow.line()
        if name == "pre":
            self.kept += 1
        elif name in ("ul", "ol", "menu", "dir"):
            number = found.get("start", "1")
            self.lists.append([name, int(number) if re.fullmatch(r"-?\d{1,9}", number) else 1, self.flow.indent])
            self.flow.indent = (self.flow.indent + "  ")[:INDENT]
        elif name == "li":
            base = self.lists[-1][2] if self.lists else ""
            mark = "- "
            if self.lists and self.lists[-1][0] == "ol":
                mark = f"{self.lists[-1][1]}. "
                self.lists[-1][1] += 1
            self.flow.mark, self.flow.indent = mark, (base + " " * len(mark))[: INDENT + len(mark)]
        elif name == "dd":
            self.flow.dents.append(self.flow.indent)
            self.flow.indent = (self.flow.indent + "  ")[:INDENT]
        elif name == "table":
            self.tables.append({"rows": [], "row": None, "flow": len(self.flows)})
        elif name == "tr" and self.tables:
            self.tables[-1]["row"] = []
        elif name in ("td", "th") and self.tables:
            span = found.get("colspan", "1")
            self.tables[-1]["span"] = min(1000, max(1, int(span))) if re.fullmatch(r"\d{1,6}", span) else 1
            down = found.get("rowspan", "1")
            self.tables[-1]["down"] = min(65534, int(down) or 65534) if re.fullmatch(r"\d{1,6}", down) else 1
            self.flows.append(Flow())
            self.flows[-1].lists = self.lists
            self.lists = []

    def finish(self, name: str, hides: bool, veiled: bool) -> None:
        self.veiled = veiled
        self.foreign -= name in ("svg", "math")
        if self.hidden:
            self.hidden -= hides
            return
        if name == "pre":
            self.flow.line()
            self.kept -= 1
        elif name == "dd":
            self.flow.line()
            if self.flow.dents:
                self.flow.indent = self.flow.dents.pop()
        elif name in ("td", "th") and self.tables and len(self.flows) > self.tables[-1]["flow"]:
            cell = self.flows.pop()
            cell.line()
            self.lists = cell.lists
            if self.tables[-1]["row"] is not None:
                self.tables[-1]["row"].append((cell.lines, self.tables[-1]["span"], self.tables[-1]["down"]))
            return
        elif name == "tr" and self.tables:
            if self.tables[-1]["row"]:
                self.tables[-1]["rows"].append(self.tables[-1]["row"])
            self.tables[-1]["row"] = None
            return
        elif name == "table" and self.tables:
            self.flow.extend(align(self.tables.pop()["rows"], self.pad_limit))
        if name in BLOCK or (self.foreign and name == "text"):
            self.flow.line()
            if name in ("ul", "ol", "menu", "dir") and self.lists:
                self.flow.indent = self.lists.pop()[2]
            if name == "li":
                self.flow.mark = ""
            if name in APART and not (self.lists and name in ("ul", "ol")):
                self.flow.gap = True

    def close_to(self, i: int) -> None:
        while len(self.open) > i:
            element = self.open.pop()
            self.places[element[0]].pop()
            self.finish(*element)

    def end(self, name: str) -> None:
        if name == "br":
            return self.start("br", "")
        if name == "p" and self.near({"p"}, SCOPE) < 0:
            self.start("p", "")
        walls = frozenset() if name in SCOPE or name in ("tr", "tbody", "thead", "tfoot") else SCOPE
        if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption"):
            walls = frozenset({"table"})
        if name not in ("html", "body") and (i := self.near({name}, walls)) >= 0:
            self.close_to(i)


def render_html(page: str, pad_limit: int = 80) -> str:
    """All visible text of a page."""
    r, at, n = Renderer(pad_limit), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            r.data(page[at:])
            break
        m = TAG.match(page, lt)
        if m is None:
            if lt + 1 < n and (page[lt + 1].isascii() and page[lt + 1].isalpha() or page[lt + 1] in "/!?"):
                r.data(page[at:lt])  # a tag that isn't closed: it ends at the next >, or takes the rest
                gt = page.find(">", lt)
                at = n if gt < 0 else gt + 1
            else:
                r.data(page[at : lt + 1])
                at = lt + 1
            continue
        r.data(page[at:lt])
        at = m.end()
        if m["note"] is not None:
            stop = page.find("-->", lt + 2)
            at = n if stop < 0 else stop + 3
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["slash"]:
            r.end(name)
            continue
        r.start(name, m["rest"])
        if name in RAW and name not in VOID:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else n
            if name in ("textarea", "xmp") and not r.hidden:
                r.data(page[at:stop])
            at = stop
    r.close_to(0)
    r.flow.line()
    lines = r.flows[0].lines
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines)


def extract_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", pad_limit: int = 80) -> DataFrame:
    """id_col and text, the visible text of each page. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "html"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([render_html(x, pad_limit) for x in texts_of(rows.column("html"))], pa.string())], names=[id_col, "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, F.col(html_col).cast("string").alias("html")).mapInArrow(lean(run), f"`{id_col}` {kind}, text string")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract_html(spread(read(spark, sf_dir, "pages").select("page_id", "html")))
    return text.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
