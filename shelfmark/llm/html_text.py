"""HTML extraction by layout: a tree with implied tags, visibility rules, and a renderer
that keeps block spacing, lists and aligned table cells. All visible text is emitted, as
a client shows it that runs no scripts and loads no objects: their fallback counts."""
from __future__ import annotations

import re
from bisect import bisect_left
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template iframe noframes datalist rp".split())
#: Parts of a drawing or formula that are not shown where they stand.
UNSEEN_WITHIN = {
    "svg": frozenset("desc metadata defs symbol clippath mask pattern".split()),
    "math": frozenset(("annotation", "annotation-xml")),
}
#: All that can stand in a head; any other start tag ends it.
HEAD_TAGS = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
BLOCKS = frozenset(
    "address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open drawing or formula.
_LEAVES = BLOCKS - {"html", "option"} | frozenset("b br center code em embed i img s small span strong sub sup u var".split())
#: What stands apart in a line of text: blocks and the labels of a drawing.
_APART = BLOCKS | {"text"}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
#: A start tag closes these open ones, up to the nearest of the tags that hold them.
_CLOSES = {
    "li": ({"li", "p"}, BLOCKS - {"li", "p", "address", "div"}),
    "dt": ({"dt", "dd", "p"}, BLOCKS - {"dt", "dd", "p", "address", "div"}),
    "dd": ({"dt", "dd", "p"}, BLOCKS - {"dt", "dd", "p", "address", "div"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "p"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)


class Node:
    """``seen`` is false for what is not laid out, with all below it; ``visible`` is
    inherited, and says whether its own text shows. ``foreign`` is the drawing or formula
    that holds it (or it is), ``inert`` says whether it is (in) a template, ``span`` how
    many columns and rows a cell takes."""

    __slots__ = ("tag", "seen", "visible", "children", "foreign", "inert", "span")

    def __init__(self, tag: str, seen: bool = True, visible: bool = True, foreign: str | None = None, inert: bool = False, span: tuple[int, int] = (1, 1)):
        self.tag, self.seen, self.visible, self.children, self.foreign, self.inert, self.span = tag, seen, visible, [], foreign, inert, span


def _span(given: dict, name: str, most: int) -> int:
    value = (given.get(name) or "").strip()
    return min(max(int(value), 1), most) if value.isascii() and value.isdigit() else 1


class _Builder(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self._lines = [0, *(m.end() for m in re.finditer("\n", page))]
        self._last_title = max((m.start() for m in re.finditer("</title", page, re.I)), default=-1)
        self.root = Node("html")
        self._open = [self.root]
        self._count: dict[str, int] = {}
        self._head, self._past_head = 0, False

    def _cut(self, at: int) -> None:
        """Closes the open elements from a place on."""
        for node in self._open[at:]:
            self._count[node.tag] -= 1
        del self._open[at:]

    def _end_head(self) -> None:
        """The body that a tag or a text implies: an open head ends with all in it."""
        if self._open[-1].inert:
            return
        if 0 < self._head < len(self._open) and self._open[self._head].tag == "head":
            self._cut(self._head)
        self._past_head = True

    def _close(self, tags: set, within: set) -> None:
        left = sum(self._count.get(t, 0) for t in tags)
        i = len(self._open) - 1
        while i > 0 and left and self._open[i].tag not in within:
            if self._open[i].tag in tags:
                self._cut(i)
                left -= 1
            i -= 1

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if self._open[-1].tag == "title":  # one that nothing closes
            self._cut(len(self._open) - 1)
        if tag == "head":
            if self._past_head or self._open[-1].inert:
                return
            self._head, self._past_head = len(self._open), True
        elif tag not in HEAD_TAGS:
            self._end_head()
        if tag in _LEAVES:
            while self._open[-1].foreign:
                self._cut(len(self._open) - 1)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        elif tag in BLOCKS:
            self._close({"p"}, {"div", "td", "th", "li", "table", "body"})
        if tag == "body":  # whatever the head left open ends
            self._cut(1)
        last = self._open[-1]
        unseen = tag in UNSEEN or tag in UNSEEN_WITHIN.get(last.foreign, ())
        foreign = tag if tag in UNSEEN_WITHIN else None if tag == "foreignobject" else last.foreign
        style = {k.lower(): v.lower() for k, v in _STYLE.findall(given.get("style") or "")}
        gone = style["display"] == "none" if "display" in style else "hidden" in given or tag == "dialog" and "open" not in given
        shown = style.get("visibility", "inherit")
        visible = shown == "visible" if shown in ("visible", "hidden", "collapse") else last.visible
        span = (_span(given, "colspan", 1000), _span(given, "rowspan", 65534)) if tag in ("td", "th") else (1, 1)
        node = Node(tag, not (unseen or gone), visible, foreign, last.inert or tag == "template", span)
        last.children.append(node)
        if tag == "title" and not foreign and self._lines[self.lineno - 1] + self.offset < self._last_title:
            self.set_cdata_mode(tag)  # tags in a title are text
        if tag not in VOID:
            self._open.append(node)
            self._count[tag] = self._count.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and not self.cdata_elem:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._count.get(tag):  # else no open element need be looked at
            self._cut(next(i for i in range(len(self._open) - 1, 0, -1) if self._open[i].tag == tag))

    def handle_data(self, data):
        if self._open[-1].tag not in ("title", "style", "script", "noframes") and data.strip():
            self._end_head()
        self._open[-1].children.append(data)


def _walk(node: Node):
    """(node or text, entering) in order, without recursion; unseen nodes are skipped, and
    so is text that does not show."""
    stack = [(node, True)]
    while stack:
        at, entering = stack.pop()
        if isinstance(at, str) or not entering:
            yield at, entering
        elif at.seen:
            yield at, True
            stack.append((at, False))
            stack.extend((c, True) for c in reversed(at.children) if at.visible or not isinstance(c, str))


def _inline(node: Node) -> str:
    parts = [x if isinstance(x, str) else " " if x.tag in _APART or x.tag == "br" else "" for x, _ in _walk(node)]
    return " ".join("".join(parts).split())


def _cells(node: Node) -> list[list[tuple[int, int, str]]]:
    """Rows of cells: column, columns it takes, text. Cells of a table within a cell are
    part of that cell's text; text outside of cells makes rows of its own."""
    rows: list[list[tuple[int, int, str]]] = []
    depth, taken, at = 0, {}, 0  # taken: the last row that a cell from above reaches in a column

    def begin():
        nonlocal at
        rows.append([])
        at = 0

    for x, entering in _walk(node):
        if isinstance(x, str):
            if not depth and x.strip():
                rows.append([(0, 1, " ".join(x.split()))])
                at = 1
            continue
        if x.tag == "tr" and entering and not depth:
            begin()
        if x.tag in ("td", "th"):
            if entering and not depth:
                if not rows:
                    begin()
                while taken.get(at, -1) >= len(rows) - 1:
                    at += 1
                wide, high = x.span
                rows[-1].append((at, wide, _inline(x)))
                if high > 1:
                    taken.update(dict.fromkeys(range(at, at + wide), len(rows) - 2 + high))
                at += wide
            depth += 1 if entering else -1
    return rows


def _table(node: Node) -> list[str]:
    """The rows of a table, each column as wide as its widest cell; a cell over several
    columns has the width of all. Columns in which no cell begins take no place."""
    rows = [r for r in _cells(node) if any(text for _, _, text in r)]
    begins = sorted({column for r in rows for column, _, _ in r})
    placed = [[(bisect_left(begins, c), bisect_left(begins, c + wide), text) for c, wide, text in r] for r in rows]
    widths = [0] * len(begins)
    for alone in (True, False):
        for first, end, text in (cell for r in placed for cell in r if (cell[1] - cell[0] == 1) == alone):
            lacking = len(text) - sum(widths[first:end]) - 2 * (end - first - 1)
            widths[end - 1] += max(0, lacking)
    lines = []
    for r in placed:
        line, reached = [], 0
        for first, end, text in r:
            line += ["".ljust(widths[i]) for i in range(reached, first)]
            line.append(text.ljust(sum(widths[first:end]) + 2 * (end - first - 1)))
            reached = end
        lines.append("  ".join(line).rstrip())
    return lines


def render(html: str | None) -> str:
    """The visible text of a page. Null and empty pages give empty text; markup that
    cannot be parsed is read as far as tags can be told from text."""
    builder = _Builder(html or "")
    builder.feed(html or "")
    builder.close()
    lines, line, blank, lists, inside, pre = [], [], False, [], 0, 0

    def end(space=False):
        nonlocal blank
        text = "".join(line)
        own = text.removeprefix("\n").rstrip().split("\n") if pre else [" ".join(text.split())]
        line.clear()
        if text.strip():
            if blank and lines:
                lines.append("")
            blank = False
            lines.extend("  " * max(0, len(lists) - 1) + x for x in own)
        blank = blank or space

    for x, entering in _walk(builder.root):
        if isinstance(x, str):
            if not inside:
                line.append(x)
            continue
        if x.tag == "table":
            if entering and not inside:
                end(True)
                own = _table(x)
                if own and lines:
                    lines.append("")
                lines.extend(own)
                blank = True
            inside += 1 if entering else -1
            continue
        if inside:
            continue
        if x.tag == "br" and entering:
            end()
        elif x.tag in _APART:
            end(x.tag in SPACED and not (lists and x.tag in ("ul", "ol", "p")))
            if x.tag == "pre":
                pre += 1 if entering else -1
            if x.tag in ("ul", "ol"):
                lists.append([x.tag, 0]) if entering else lists.pop()
            elif x.tag == "li" and entering:
                if lists:
                    lists[-1][1] += 1
                if x.visible:
                    line.append(f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- ")
    end()
    return "\n".join(lines)


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, text of every row; null and empty pages have empty text; repeated rows have a
    result each, no rows give none. Other columns are not read, so their names may clash.
    Pages are read where they lie; nothing moves. Work grows in proportion to a page, also
    to one of many megabytes with tags that nothing closes or opens."""

    def run(batches):
        for batch in small_batches(batches, "html"):
            texts = [render(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, text string")


def op9_html_text(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
