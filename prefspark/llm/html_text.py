"""Layout-aware text of HTML pages.

A tree builder turns tags into well-formed element events: it supplies the
end tags that HTML lets authors leave out, ignores end tags that close
nothing, and skips what a browser does not show.  The renderer lays the
events out as text: blocks on lines of their own, blank lines around
paragraphs, headings, lists and tables, list markers with hanging indents,
preformatted text as it stands, and table cells in aligned columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from prefspark.llm.common import table

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)

#: Element classes of the HTML standard, fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
UNSEEN = frozenset("head title script style template noscript iframe noembed noframes object audio video canvas "
                   "datalist param meta link base rp desc defs metadata annotation annotation-xml".split())
HEAD_ONLY = frozenset("title script style template noscript meta link base".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu fieldset".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog dir div dt figcaption footer form "
                            "header html legend li main nav option optgroup search section summary tbody td tfoot th "
                            "thead tr caption".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
                     "footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre search section summary table "
                     "ul li dd dt".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that a start tag closes, and the elements that shield those.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
WALLS = frozenset("table td th caption template html".split())
#: Elements whose end tag may stand inside a block that they began outside of.
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Greatest spans of the standard.
COLSPAN, ROWSPAN = 1000, 65534
#: Blanks that align a table are at most this many for a character of it, and
#: PADDING more; in a table that needs more, cells over ALIGN do not widen columns.
BLANKS, PADDING, ALIGN = 16, 1 << 16, 80
#: Open elements at most: as in browsers, one more becomes a sibling instead.
DEPTH = 512


class Flow:
    """Lines of one block container: the page or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.indents: list[str] = []
        self.marker = ""

    def inline(self, text: str) -> None:
        words = _SPACE.split(text)
        if len(words) == 1:
            if words[0]:
                self._put(words[0])
            return
        if words[0]:
            self._put(words[0])
        self.space = True
        body = " ".join(w for w in words[1:] if w)
        if body:
            self._put(body)
            self.space = words[-1] == ""

    def _put(self, text: str) -> None:
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = False
        self.parts.append(text)

    def line(self, text: str) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        indent = "".join(self.indents)
        if self.marker:
            indent, self.marker = indent[:len(indent) - len(self.marker)] + self.marker, ""
        self.lines.append((indent + text).replace("\xa0", " ").rstrip())

    def end_line(self) -> None:
        if self.parts:
            text, self.parts = "".join(self.parts), []
            self.line(text)
        self.space = False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def forced_break(self) -> None:
        if self.parts:
            self.end_line()
        else:
            self.line("")

    def finish(self) -> list[str]:
        self.end_line()
        return self.lines


class Grid:
    """Cells of a table by row and column."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.spans: list[tuple[int, int, int]] = []  # first column, end, last row, by first column
        self.column = self.next = 0

    def row(self) -> None:
        self.rows.append([])
        self.column = self.next = 0
        self.spans = [x for x in self.spans if x[2] >= len(self.rows)]

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        spans = self.spans
        while self.next < len(spans) and spans[self.next][0] <= self.column:
            self.column = max(self.column, spans[self.next][1])
            self.next += 1
        self.rows[-1].append((self.column, columns, lines))
        if rows > 1:
            spans.insert(self.next, (self.column, self.column + columns, len(self.rows) + rows - 1))
            self.next += 1
        self.column += columns

    def widths(self, at: dict[int, int], most: int | None) -> list[int]:
        width = [0] * len(at)
        for row in self.rows:
            for column, columns, lines in row:
                w = max(map(len, lines), default=0)
                if columns == 1 and (most is None or w <= most):
                    width[at[column]] = max(width[at[column]], w)
        return width

    def layout(self) -> Iterator[str]:
        """Lines of the table; columns in which no cell begins take no room."""
        at = {c: i for i, c in enumerate(sorted({column for row in self.rows for column, *_ in row}))}
        width = self.widths(at, None)
        size = sum(len(x) for row in self.rows for *_, lines in row for x in lines)
        high = sum(max((len(lines) for *_, lines in row), default=0) for row in self.rows)
        if high * sum(width) > PADDING + BLANKS * size:
            width = self.widths(at, ALIGN)
        for row in self.rows:
            for i in range(max((len(lines) for *_, lines in row), default=0)):
                out, done = [], 0
                for column, _, lines in row:
                    place = at[column]
                    out += [" " * (w + 2) for w in width[done:place]]
                    text = lines[i] if i < len(lines) else ""
                    out.append(text.ljust(width[place]) + "  ")
                    done = place + 1
                yield "".join(out).rstrip()


class Renderer:
    """Builds the tree of one page and renders it as the events come."""

    def __init__(self):
        self.open: list[tuple[str, dict]] = []
        self.shown = [True]  # of the page and every open element: whether its own text can be seen
        self.flows = [Flow()]
        self.grids: list[tuple[Grid, int]] = []
        self.lists: list[list] = []
        self.hidden = 0
        self.pre = 0
        self.after_pre = False

    # tree building

    def start(self, tag: str, attrs: dict) -> None:
        if self.open and self.open[-1][0] == "head" and tag not in HEAD_ONLY:
            self.pop()
        if tag in CLOSES_P:
            self.close({"p"}, WALLS | {"button"})
        if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop()
        if tag in CLOSED_BY:
            self.close_all(*CLOSED_BY[tag])
        if tag in ("td", "th") and self.grids and not self.within("tr"):
            self.push("tr", {})
        self.push(tag, attrs)

    def within(self, tag: str) -> bool:
        for name, _ in reversed(self.open):
            if name == tag:
                return True
            if name == "table":
                return False
        return False

    def close(self, tags: set, walls) -> None:
        """Close the nearest open element of ``tags`` and all inside it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in tags:
                while len(self.open) > i:
                    self.pop()
                return
            if self.open[i][0] in walls:
                return

    def close_all(self, tags: set, walls: set) -> None:
        n = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in walls:
                break
            if self.open[i][0] in tags:
                n = i
        while n is not None and len(self.open) > n:
            self.pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.void("br", {})
        elif tag == "p" and not any(t == "p" for t, _ in self.open):
            if not self.hidden:
                self.flows[-1].block(1)
        elif tag in FORMATTING:
            self.end_formatting(tag)
        elif tag in BLOCKS or tag in WALLS or tag == "button":
            self.close(HEADINGS if tag in HEADINGS else {tag},
                       frozenset() if tag in ("table", "html", "body") else WALLS - {tag})
        else:  # no other element ends from inside a block
            self.close({tag}, WALLS | BLOCKS)

    def end_formatting(self, tag: str) -> None:
        """As the standard's adoption rule: blocks that began inside the
        element stay open when it ends; what follows in them is outside it."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.open[i][0]
            if name == tag:
                break
            if name in WALLS:
                return
        else:
            return
        above = self.open[i + 1:]
        if not any(name in BLOCKS for name, _ in above):
            self.close({tag}, frozenset())
        elif self.hidden > len(above):  # the element may be what hides them: they begin anew
            while len(self.open) > i:
                self.pop()
            for name, attrs in above:
                self.push(name, attrs)
        else:
            del self.open[i], self.shown[i + 1]
            for k in range(i, len(self.open)):
                self.shown[k + 1] = self.sees(*self.open[k], self.shown[k])

    # rendering

    def unseen(self, tag: str, attrs: dict) -> bool:
        if tag in UNSEEN or "hidden" in attrs or tag == "dialog" and "open" not in attrs:
            return True
        if self.open and self.open[-1][0] == "details" and "open" not in self.open[-1][1] and tag != "summary":
            return True
        return "style" in attrs and bool(_HIDING.search(attrs["style"]))

    @staticmethod
    def sees(tag: str, attrs: dict, above: bool) -> bool:
        """Visibility is inherited until a style says otherwise; a drawing
        shows the text of its text elements only."""
        if tag in ("svg", "text", "foreignobject"):
            above = tag != "svg"
        found = _VISIBILITY.findall(attrs["style"]) if "style" in attrs else ()
        return found[-1].lower() == "visible" if found else above

    def push(self, tag: str, attrs: dict) -> None:
        if len(self.open) >= DEPTH:
            self.pop()
        self.shown.append(self.sees(tag, attrs, self.shown[-1]))
        if self.hidden or self.unseen(tag, attrs):
            self.hidden += 1
            self.open.append((tag, attrs))
            return
        self.open.append((tag, attrs))
        flow = self.flows[-1]
        if tag in ("td", "th") and self.grids:
            self.flows.append(Flow())
        elif tag == "tr" and self.grids:
            self.grids[-1][0].row()
        elif tag in BLOCKS:
            flow.block(1 if tag in SPACED and not (tag in ("ul", "ol") and self.lists) else 0)
        if tag == "table":
            self.grids.append((Grid(), len(self.lists)))
        elif tag in ("ul", "ol", "menu", "dir"):
            self.lists.append([tag, self.number(attrs, "start", 1, 1 << 31) - 1])
        elif tag == "li":
            last = self.lists[-1] if self.lists else ["ul", 0]
            last[1] = self.number(attrs, "value", last[1] + 1, 1 << 31)
            marker = f"{last[1]}. " if last[0] == "ol" else "- "
            flow.indents.append(" " * len(marker))
            flow.marker = marker
        elif tag in ("blockquote", "dd"):
            flow.indents.append("  ")
        elif tag == "pre":
            self.pre += 1
            self.after_pre = True
        elif tag == "q" and self.shown[-1]:
            flow.inline('"')

    @staticmethod
    def number(attrs: dict, name: str, default: int, most: int) -> int:
        value = attrs.get(name, "").strip()
        return max(-most, min(int(value), most)) if re.fullmatch("[+-]?[0-9]{1,11}", value) else default

    def pop(self) -> None:
        tag, attrs = self.open.pop()
        shown = self.shown.pop()
        if self.hidden:
            self.hidden -= 1
            return
        flow = self.flows[-1]
        if tag in ("td", "th") and self.grids:
            lines = self.flows.pop().finish()
            self.grids[-1][0].cell(lines, max(1, self.number(attrs, "colspan", 1, COLSPAN)),
                                   max(1, self.number(attrs, "rowspan", 1, ROWSPAN)))
            return
        if tag == "tr" and self.grids:
            return
        if tag in BLOCKS:
            flow.end_line()
        if tag == "table":
            grid, _ = self.grids.pop()
            flow = self.flows[-1]
            flow.block(1)
            for line in grid.layout():
                flow.line(line)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.lists.pop()
        elif tag == "li":
            if flow.marker:
                flow.line("")
            flow.indents.pop()
        elif tag in ("blockquote", "dd"):
            flow.indents.pop()
        elif tag == "pre":
            self.pre -= 1
        elif tag == "q" and shown:
            flow.inline('"')
        if tag in BLOCKS:
            flow.block(1 if tag in SPACED and not (tag in ("ul", "ol") and self.lists) else 0)

    def void(self, tag: str, attrs: dict) -> None:
        if tag == "hr":
            self.start(tag, attrs)
            self.pop()
        elif not self.hidden and not self.unseen(tag, attrs):
            if tag == "br":
                self.flows[-1].forced_break()
            elif tag == "input" and self.shown[-1] and attrs.get("type", "").lower() in ("submit", "button", "reset"):
                self.flows[-1].inline(attrs.get("value", ""))

    def text(self, text: str) -> None:
        if self.open and self.open[-1][0] == "head" and text.strip():
            self.pop()
        if self.hidden or not text or not self.shown[-1]:
            return
        if self.open and self.open[-1][0] == "details" and "open" not in self.open[-1][1]:
            return
        text = unescape(text) if "&" in text else text
        flow = self.flows[-1]
        if not self.pre:
            flow.inline(text)
            return
        text = text.replace("\r\n", "\n")
        if self.after_pre and text.startswith("\n"):
            text = text[1:]
        self.after_pre = False
        first, *rest = text.split("\n")
        if first:
            flow.parts.append(first)
        for line in rest:
            flow.forced_break()
            if line:
                flow.parts.append(line)

    def page(self, html: str) -> str:
        at, n = 0, len(html)
        lower = None
        while at < n:
            m = _MARKUP.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            if m.start() > at:
                self.text(html[at:m.start()])
            at = m.end()
            tag = m[2]
            if not tag:
                continue
            tag = tag.lower()
            if m[1]:
                self.end(tag)
                continue
            attrs = {a[1].lower(): unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3])} if (
                m[3].strip(" /\n")) else {}
            if tag in VOID:
                self.void(tag, attrs)
                continue
            self.start(tag, attrs)
            if tag in RAW:
                if lower is None:  # ASCII only, so that offsets stay
                    lower = html.translate(_LOWER)
                stop = lower.find(f"</{tag}", at)
                stop = n if stop < 0 else stop
                if tag == "textarea":  # keeps its line ends
                    self.pre += 1
                    self.after_pre = True
                    self.text(html[at:stop])
                    self.after_pre = False
                    self.pre -= 1
                self.close({tag}, frozenset())
                stop = html.find(">", stop)
                at = n if stop < 0 else stop + 1
        while self.open:
            self.pop()
        lines = self.flows[0].finish()
        while lines and not lines[-1]:
            lines.pop()
        return "\n".join(lines)


_LOWER = {c: c + 32 for c in range(65, 91)}


def visible_text(html: str | None) -> str:
    """All text that a browser would show; the empty string for null.
    Reversed lists are numbered upwards."""
    return Renderer().page(html) if html else ""


def extract_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id, n_chars and text of every page; a narrow step.

    Null and empty pages give the empty text; equal pages equal texts; null
    and repeated ids keep one row per input row; an empty table gives no
    rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [visible_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(texts, pa.string())],
                [id_col, "n_chars", "text"])
    kind = dict(pages.dtypes)[id_col]
    return pages.select(id_col, "html").mapInArrow(run, f"`{id_col}` {kind}, n_chars bigint, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
