"""Visible text of HTML pages, laid out as a browser would lay it out in plain text.

A tokenizer feeds a builder that keeps the open elements, closes what the markup
leaves open and ignores ends of what isn't open. Elements that aren't shown are
skipped. The renderer collapses white space, separates blocks, marks list items
and pads table cells into columns.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from bindery.llm.blocks import sliced

# Fixed values of HTML: kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set(
    "head script style template noscript iframe object svg math canvas audio video "
    "datalist noembed noframes frameset applet map dialog".split()
)
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
#: Blocks with a blank line around them, and blocks that only begin a new line.
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure fieldset hr menu dir".split())
PLAIN = set(
    "html body div section article aside header footer nav main address center details summary "
    "form legend figcaption li dt dd hgroup search option optgroup caption listing plaintext".split()
)
BLOCKS = SPACED | PLAIN
#: An element's start closes these, if they are open within the given boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
CELLS = {"td", "th"}
SCOPES = {"table", "td", "th", "caption", "html"}
#: Ends that reach out of a scope.
ANYWHERE = SCOPES | {"tr", "thead", "tbody", "tfoot", "body"}

#: A quote opens a value right after the equals sign only; elsewhere it is like a letter.
ATTRIBUTE = re.compile(
    r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>][^\s>]*+)|(?=>|\Z)))?+"
)
MARKUP = (
    r"<!--(?:>|->|.*?(?:--!?>|\Z))"
    r"|<[!?][^>]*+>?"
    r"|</(?=[^a-zA-Z])[^>]*+>?"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>%s)>"
)
_ANY_ATTRIBUTE = re.sub(r"(?<!\\)\((?!\?)", "(?:", ATTRIBUTE.pattern)
TOKEN = re.compile(MARKUP % rf"(?:[\s/]++|{_ANY_ATTRIBUTE})*+", re.S)
#: Where a quoted value that never closes hides every end of tag, the first one counts.
LOOSE = re.compile(MARKUP % "[^>]*+", re.S)
UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
#: Cells wider than this don't widen the column for the others.
WIDEST = 40


class Writer:
    """Lines of one flow of text."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.indents = [""]
        self.mark = ""

    def text(self, data: str, keep: bool = False) -> None:
        if keep:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.line_break()
                self._put(line)
            return
        words = SPACE.sub(" ", data)
        if words[:1] == " ":
            self.space = True
            words = words[1:]
        if words:
            if self.space and self.parts and not self.parts[-1].endswith(" "):
                self.parts.append(" ")
            self.space = words[-1] == " "
            self.parts.append(words[:-1] if self.space else words)

    def _put(self, words: str) -> None:
        if words:
            self.parts.append(words)
            self.space = False

    def line_break(self) -> None:
        if not self.flush():
            self.gap = max(self.gap, 1) if self.lines else 0

    def flush(self) -> bool:
        line = "".join(self.parts).rstrip().replace("\xa0", " ")
        self.parts, self.space = [], False
        if not line.strip():
            return False
        self.put_line(line)
        return True

    def put_line(self, line: str) -> None:
        if self.lines:
            self.lines.extend([""] * self.gap)
        indent = self.indents[-1]
        if self.mark:
            indent = indent[: len(indent) - len(self.mark)] + self.mark
            self.mark = ""
        self.lines.append(indent + line)
        self.gap = 0

    def block(self, gap: int) -> None:
        self.flush()
        if self.lines:
            self.gap = max(self.gap, gap)

    def enter(self, mark: str) -> None:
        self.block(0)
        self.indents.append(self.indents[-1] + " " * len(mark))
        self.mark = mark if mark.strip() else ""

    def leave(self) -> None:
        self.block(0)
        if len(self.indents) > 1:
            self.indents.pop()
        self.mark = ""


class Table:
    """Cells by row and column; spans take up the places they cover."""

    def __init__(self) -> None:
        self.rows: list[dict[int, tuple[list[str], int]]] = []
        self.covered: dict[int, int] = {}  # column: rows that a cell above still covers
        self.column = 0

    def row(self) -> None:
        self.covered = {c: n - 1 for c, n in self.covered.items() if n > 1}
        self.rows.append({})
        self.column = 0

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self.column in self.covered:
            self.column += 1
        self.rows[-1][self.column] = (lines, across)
        if down > 1:
            self.covered |= dict.fromkeys(range(self.column, self.column + across), down)
        self.column += across

    def lines(self) -> Iterator[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for c, (lines, across) in row.items():
                wide = max(map(len, lines), default=0)
                if across == 1 and wide <= WIDEST:
                    widths[c] = max(widths.get(c, 0), wide)
        columns = sorted(widths.keys() | {c for row in self.rows for c in row})
        place, at = {}, 0
        for c in columns:
            place[c] = at
            at += widths[c] + 2 if c in widths else 2
        for row in self.rows:
            for k in range(max((len(lines) for lines, _ in row.values()), default=0)):
                line = ""
                for c, (lines, _) in sorted(row.items()):
                    if k < len(lines) and lines[k]:
                        pad = max(place[c] - len(line), 2 if line else 0)
                        line += " " * pad + lines[k]
                if line:
                    yield line


class Page:
    """Builder and renderer of one page."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool]] = []  # tag, shown
        self.places: dict[str, list[int]] = {}  # where in `open` each tag is, ascending
        self.hidden = 0
        self.kept = 0  # open elements whose white space is kept
        self.flows = [Writer()]
        self.tables: list[Table] = []
        self.spans: list[tuple[int, int]] = []
        self.lists: list[int | None] = []  # next number, or None without numbers

    def text(self, data: str) -> None:
        closed = bool(self.open) and self.open[-1][0] == "details-closed"
        if not self.hidden and not closed:
            self.flows[-1].text(html.unescape(data) if "&" in data else data, self.kept > 0)

    def start(self, tag: str, raw: str) -> None:
        closes, bounds = CLOSES.get(tag, (None, ()))
        if closes:
            self._close_within(closes, bounds)
        elif tag in BLOCKS:
            self._close_within({"p"}, SCOPES | {"button"})
        if tag in CELLS and self.tables and self._last(("tr",)) <= self._last(("table",)):
            self.start("tr", "")
        attrs = attributes(raw) if raw.strip() else {}
        shown = self._shown(tag, attrs)
        if tag in VOID:
            if shown and not self.hidden:
                if tag == "br":
                    self.flows[-1].line_break()
                elif tag == "hr":
                    self.flows[-1].block(1)
            return
        self._push(tag, shown)
        self.hidden += not shown
        if not self.hidden:
            self._enter(tag, attrs)

    def _push(self, tag: str, shown: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, shown))

    def _drop(self) -> tuple[str, bool]:
        tag, shown = self.open.pop()
        self.places[tag].pop()
        return tag, shown

    def _last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of these tags, -1 without one."""
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def _shown(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag == "dialog" and "open" in attrs:
            return True
        if tag in HIDDEN or "hidden" in attrs or UNSEEN.search(attrs.get("style", "")):
            return False
        parent = self.open[-1] if self.open else ("", True)
        return not (parent[0] == "details-closed" and tag != "summary")

    def _enter(self, tag: str, attrs: dict[str, str]) -> None:
        flow = self.flows[-1]
        if tag in {"ul", "ol", "menu", "dir"}:
            flow.block(0 if self.lists else 1)
            self.lists.append(number(attrs.get("start"), 1, 1 << 31) if tag == "ol" else None)
        elif tag == "li":
            mark = "- "
            if self.lists and self.lists[-1] is not None:
                at = number(attrs.get("value"), self.lists[-1], 1 << 31)
                mark, self.lists[-1] = f"{at}. ", at + 1
            flow.enter(mark)
        elif tag in {"dd", "blockquote"}:
            flow.block(tag == "blockquote")
            flow.enter("  ")
        elif tag == "table":
            flow.block(1)
            self.tables.append(Table())
        elif tag == "tr" and self.tables:
            self.tables[-1].row()
        elif tag in CELLS and self.tables:
            self.spans.append(
                (number(attrs.get("colspan"), 1, 1000), number(attrs.get("rowspan"), 1, 65534))
            )
            self.flows.append(Writer())
        elif tag in BLOCKS:
            flow.block(tag in SPACED)
            if tag == "details" and "open" not in attrs:
                self._drop()
                self._push("details-closed", True)
        if tag in {"pre", "textarea", "listing", "xmp", "plaintext"}:
            self.kept += 1

    def _leave(self, tag: str) -> None:
        flow = self.flows[-1]
        if tag in {"pre", "textarea", "listing", "xmp", "plaintext"}:
            self.kept -= 1
        if tag in {"ul", "ol", "menu", "dir"}:
            if self.lists:
                self.lists.pop()
            flow.block(0 if self.lists else 1)
        elif tag in {"li", "dd", "blockquote"}:
            flow.leave()
            flow.block(tag == "blockquote")
        elif tag == "table" and self.tables:
            flow.flush()
            for line in self.tables.pop().lines():
                flow.put_line(line)
            flow.block(1)
        elif tag in CELLS and self.spans:
            flow.flush()
            self.flows.pop()
            self.tables[-1].cell(flow.lines, *self.spans.pop())
        elif tag in BLOCKS or tag == "details-closed":
            flow.block(tag in SPACED)

    def _pop(self) -> str:
        tag, shown = self._drop()
        if not self.hidden:
            self._leave(tag)
        self.hidden -= not shown
        return tag

    def _close_within(self, tags: set[str], bounds: set[str]) -> None:
        """Close the outermost of `tags` that is open within `bounds`, and all in it."""
        bound = self._last(t for t in (*bounds, "table") if t not in tags)
        depth = len(self.open)
        for tag in tags:
            at = self.places.get(tag, ())
            if at and at[-1] > bound:
                depth = min(depth, at[bisect_right(at, bound)])
        while len(self.open) > depth:
            self._pop()

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", "")
        depth = self._last((tag, "details-closed") if tag == "details" else (tag,))
        if tag not in ANYWHERE and self._last(SCOPES) > depth:
            return
        while 0 <= depth < len(self.open):
            self._pop()

    def close(self) -> str:
        while self.open:
            self._pop()
        self.flows[-1].flush()
        return "\n".join(self.flows[0].lines)


def number(value: str | None, default: int, most: int) -> int:
    found = re.match(r"\s*(\d{1,9})", value or "")
    return min(int(found[1]), most) if found and (int(found[1]) or most > 65534) else default


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def render(page: str | None) -> str | None:
    """The visible text of a page; null stays null.

    A tag without any `>` behind it hides the rest, and one left open is closed at
    the end.
    """
    if page is None:
        return None
    out, at, size, token = Page(), 0, len(page), TOKEN
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            out.text(page[at:])
            break
        if begin > at:
            out.text(page[at:begin])
        m = token.match(page, begin)
        if not m and (m := LOOSE.match(page, begin)):
            token = LOOSE  # no tag from here on would end otherwise
        if not m:
            if begin + 1 < size and (page[begin + 1].isalpha() or page[begin + 1] == "/"):
                break
            out.text("<")
            at = begin + 1
            continue
        at = m.end()
        if not (tag := m["tag"]):
            continue
        tag = tag.lower()
        if m["end"]:
            out.end(tag)
            continue
        out.start(tag, m["attrs"])
        if tag in RAW:
            ends = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            stop = ends.start() if ends else size
            if tag != "script":
                out.text(page[at:stop])
            at = stop
    return out.close()


def extracted(pages: DataFrame, source: str = "html", key: str = "page_id") -> DataFrame:
    """page_id, text, n_lines for each page; a null page has a null text and no lines.

    Map-only: pages are rendered one by one, whatever copies or ties there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "html"):
            texts = [render(x) for x in batch.column("html").to_pylist()]
            lines = [t.count("\n") + 1 if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string()), pa.array(lines, pa.int64())],
                names=["page_id", "text", "n_lines"],
            )

    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(source).cast("string").alias("html")
    )
    return rows.mapInArrow(run, "page_id long, text string, n_lines long")
