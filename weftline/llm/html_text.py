"""Layout-aware text of HTML pages (op9).

A tree builder turns tags into opened and closed elements, with the tags that HTML implies; a renderer follows
them, skips what a browser doesn't show, and sets the visible text in blocks, lists and aligned tables. Both
run over the page once, without recursion, so that deep nesting and very long pages need no more than memory
for the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

# The element kinds of the HTML standard that matter for structure and display.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title noscript iframe noembed noframes datalist object audio video canvas".split())
#: Elements of drawings and formulas that hold no visible text.
UNSEEN_WITHIN = {"svg": frozenset("desc metadata defs symbol clippath mask pattern".split()), "math": frozenset("annotation annotation-xml".split())}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre search section summary table ul xmp textarea".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl table blockquote pre figure hr xmp fieldset form".split())
CLOSES_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table ul xmp".split())
LISTS = frozenset("ul ol menu dir".split())
#: An end tag or an implied one doesn't reach beyond these.
SCOPE = frozenset("table td th caption html template".split())
#: Elements at which the search for an ordinary element's end stops, and those whose end leaves open what was opened within them.
SPECIAL = (BLOCK - frozenset(["legend", "option", "dialog"])) | VOID | RAW | SCOPE | frozenset("applet button colgroup head html marquee noscript object select tbody tfoot thead tr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: What a start tag ends if it is open, and the elements at which the search for it stops.
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), LISTS | SCOPE), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | SCOPE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"]) | SCOPE), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"]) | SCOPE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table", "template"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table", "template"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table", "template"])),
    "tbody": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table", "template"])),
    "thead": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table", "template"])),
    "tfoot": (frozenset(["td", "th", "tr", "tbody", "thead", "tfoot", "caption", "colgroup"]), frozenset(["table", "template"])),
    "body": (frozenset(["head"]), frozenset(["table"])),
}
#: Content that ends an open head.
_HEAD_ONLY = frozenset("base link meta title style script noscript template head html".split())

_TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|(?P<never>\Z)))|(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<raw>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_BLANK = re.compile(r"[ \t\n\f\r]+")
_NO_DECLARATION = re.compile(r"""/\*.*?(?:\*/|\Z)|"[^"]*"|'[^']*'|\([^)]*\)""", re.S)
_KEYWORD = re.compile(r"[a-z-]+(?: [a-z-]+)*")
_VISIBILITIES = frozenset(["hidden", "collapse", "visible"])
#: Characters at which a cell's lines are wrapped, to which lines are indented, and to which columns are aligned.
_WRAP, _INDENT, _ALIGNED = 80, 80, 400


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in reversed(list(_ATTR.finditer(raw)))} if raw.strip(" /\n\t\r\f") else {}


def _style(text: str) -> dict[str, str]:
    """Display and visibility as the last declaration that counts has them; important ones before others."""
    out: dict[str, tuple[bool, str]] = {}
    for part in _NO_DECLARATION.sub("", text.lower()).split(";"):
        name, _, value = part.partition(":")
        value, name = " ".join(value.split()), name.strip()
        important = value.endswith("important") and "!" in value
        value = value.partition("!")[0].strip()
        counts = name == "display" and _KEYWORD.fullmatch(value) or name == "visibility" and value in _VISIBILITIES
        if counts and (important or not out.get(name, (False,))[0]):
            out[name] = important, value
    return {k: v for k, (_, v) in out.items()}


def _ordinal(n: int, kind: str) -> str:
    """A list item's number: as it is, or by letters or Roman numerals as the list's ``type`` says (of what these can count)."""
    out = str(n)
    if kind in ("a", "A") and n > 0:
        out, m = "", n
        while m:
            m, r = divmod(m - 1, 26)
            out = chr(97 + r) + out
    elif kind in ("i", "I") and 0 < n < 4000:
        out, m = "", n
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split()):
            out, m = out + sign * (m // value), m % value
    return out.upper() if kind in ("A", "I") else out


def _number(value: str | None, otherwise: int, most: int) -> int:
    found = re.match(r"\s*([+-]?\d+)", value or "")
    return min(int(found[1][:20]), most) if found else otherwise


def _wrapped(line: str) -> list[str]:
    """A line in parts of at most ``_WRAP`` characters, cut at blanks; longer words and laid-out lines stay whole."""
    if len(line) <= _WRAP or "  " in line.strip():
        return [line]
    out, now = [], ""
    for word in line.split(" "):
        if now and len(now) + 1 + len(word) > _WRAP:
            out.append(now)
            now = word
        else:
            now = f"{now} {word}" if now else word
    return [*out, now]


class _Flow:
    """Lines of one block container: the page or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.ends_blank = True
        self.gap = False
        self.indent = [""]  # what stands before a line at each depth; from a depth on it grows no more
        self.marker = ""

    def deeper(self, blanks: str) -> None:
        self.indent.append((self.indent[-1] + blanks)[:_INDENT])

    def shallower(self) -> None:
        if len(self.indent) > 1:
            self.indent.pop()

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *more = data.split("\n")
            self._add(first)
            for line in more:
                self.break_line(keep_blank=True)
                self._add(line)
            return
        data = _BLANK.sub(" ", data)
        if self.ends_blank and data.startswith(" "):
            data = data[1:]
        self._add(data)

    def _add(self, data: str) -> None:
        if data:
            self.now.append(data)
            self.ends_blank = data[-1] == " "

    def break_line(self, keep_blank: bool = False) -> None:
        line = "".join(self.now).rstrip(" ")
        if line or (keep_blank and self.lines):
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            prefix = self.indent[-1]
            if self.marker and line:
                prefix = self.indent[-2 if len(self.indent) > 1 else 0] + self.marker
                self.marker = ""
            self.lines.append((prefix + line) if line else "")
        self.now, self.ends_blank = [], True

    def block(self, margin: bool) -> None:
        self.break_line()
        self.gap |= margin

    def done(self) -> list[str]:
        self.break_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Table:
    """Rows of cells, laid out with aligned columns when the table ends."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        self.held: dict[int, int] = {}  # column -> rows for which a cell from above holds it

    def section(self) -> None:
        self.held = {}

    def row(self) -> None:
        self.held = {c: n - 1 for c, n in self.held.items() if n > 1}
        self.rows.append([])

    def cell(self, lines: list[str], colspan: int, rowspan: int) -> None:
        if not self.rows:
            self.row()
        row = self.rows[-1]
        at = row[-1][0] + row_width(row[-1]) if row else 0
        while self.held.get(at, 0):
            at += 1
        row.append((at, lines, colspan))
        if rowspan > 1:
            self.held |= {c: rowspan for c in range(at, at + colspan)}

    def layout(self) -> list[str]:
        """Lines in which each column begins at one place, behind the widest line of the columns before it.

        Where there are several columns long lines are wrapped first. A word that is wider still moves only what stands
        behind it in its own line; columns beyond a limit follow each other by two blanks.
        """
        several = any(at for row in self.rows for at, _, _ in row)
        rows = [[(at, [x for line in lines for x in _wrapped(line)] if several else lines, span) for at, lines, span in row] for row in self.rows]
        width: Counter[int] = Counter()
        for row in rows:
            for at, lines, colspan in row:
                if colspan == 1:
                    width[at] = max(width[at], *(min(len(x), _WRAP) for x in lines), 0)
        start, place = {}, 0
        for c in sorted({at for row in rows for at, _, _ in row}):
            start[c], place = min(place, _ALIGNED), place + (width[c] + 2 if width[c] else 0)
        out = []
        for row in rows:
            for k in range(max((len(lines) for _, lines, _ in row), default=0)):
                line = ""
                for at, lines, _ in row:
                    if k < len(lines) and lines[k]:
                        line = line.ljust(start[at]) if len(line) + 2 <= start[at] or not line else line + "  "
                        line += lines[k]
                out.append(line.rstrip(" "))
        return out


def row_width(cell: tuple) -> int:
    return cell[2]


class _Renderer:
    """Follows opened and closed elements and writes visible text."""

    def __init__(self) -> None:
        self.flows = [_Flow()]
        self.tables: list[_Table] = []
        self.lists: list[list] = []
        self.unseen = self.pre = 0
        self.visible = [True]  # inherited; an element may set it anew
        self.shut: list[int] = []  # for each closed details element: ``unseen`` within it
        self.foreign: Counter[str] = Counter()

    def opened(self, tag: str, raw: str) -> tuple:
        """What ``closed`` needs to know of the element: its kind, facts of a cell, and whether it sets visibility."""
        low = raw.lower()
        attrs = _attributes(raw) if raw and (tag in ("ol", "li", "td", "th", "details", "dialog", "input") or "hidden" in low or "style" in low) else {}
        style = _style(attrs["style"]) if "style" in attrs else {}
        hides = tag in UNSEEN or ("hidden" in attrs and "display" not in style) or style.get("display") == "none" or (tag == "dialog" and "open" not in attrs)
        hides = hides or any(tag in inner and self.foreign[outer] for outer, inner in UNSEEN_WITHIN.items())
        if tag == "summary" and not hides and self.shut and self.unseen == self.shut[-1]:
            saved, self.unseen = self.unseen, 0
            self.flows[-1].block(False)
            return "summary", saved, 0, False
        if hides or self.unseen:
            self.unseen += 1
            return "unseen", 0, 0, False
        found = "visibility" in style
        if found:
            self.visible.append(style["visibility"] == "visible")
        kind, *cell = self._shown(tag, attrs)
        return kind, *(cell or (0, 0)), found

    def _shown(self, tag: str, attrs: dict) -> tuple:
        flow = self.flows[-1]
        if tag == "br":
            flow.break_line(keep_blank=True)
        elif tag == "input":
            if attrs.get("type", "").lower() in ("submit", "button", "reset") and self.visible[-1]:
                flow.text(attrs.get("value", ""), False)
        elif tag in ("td", "th"):
            self.flows.append(_Flow())
            rows = _number(attrs.get("rowspan"), 1, 65534)
            return ("cell", max(1, _number(attrs.get("colspan"), 1, 1000)), 65534 if rows == 0 else max(1, rows))  # 0: to the section's end
        elif tag in ("tbody", "thead", "tfoot"):
            if self.tables:
                self.tables[-1].section()
        elif tag in UNSEEN_WITHIN:
            self.foreign[tag] += 1
        elif tag == "text" and self.foreign["svg"]:
            flow.block(False)
        elif tag == "tr":
            if self.tables:
                self.tables[-1].row()
        elif tag == "table":
            flow.block(True)
            self.tables.append(_Table())
        elif tag in BLOCK:
            flow.block(tag in MARGIN and not (tag in LISTS and self.lists))
            if tag in LISTS:
                self.lists.append([tag, _number(attrs.get("start"), 1, 10**9), attrs.get("type", "")])
            elif tag == "li":
                marker = "* "
                if self.lists and self.lists[-1][0] == "ol":
                    if "value" in attrs:
                        self.lists[-1][1] = _number(attrs["value"], self.lists[-1][1], 10**9)
                    marker = f"{_ordinal(*self.lists[-1][1:])}. "
                    self.lists[-1][1] += 1
                flow.deeper(" " * len(marker))
                flow.marker = marker
            elif tag in ("blockquote", "dd"):
                flow.deeper("  ")
            elif tag in ("pre", "xmp", "textarea"):
                self.pre += 1
            elif tag == "details" and "open" not in attrs:
                self.unseen += 1
                self.shut.append(self.unseen)
                return ("shut",)
        return (tag,)

    def closed(self, tag: str, facts: tuple) -> None:
        if facts[3]:
            self.visible.pop()
        if facts[0] == "unseen":
            self.unseen -= 1
        elif facts[0] == "summary" and facts[1]:
            self.flows[-1].block(False)
            self.unseen = facts[1]
        elif facts[0] == "shut":
            self.unseen -= 1
            self.shut.pop()
            self.flows[-1].block(False)
        elif tag in UNSEEN_WITHIN:
            self.foreign[tag] -= 1
        elif tag == "text" and self.foreign["svg"]:
            self.flows[-1].block(False)
        elif facts[0] == "cell":
            lines = self.flows.pop().done()
            if self.tables:
                self.tables[-1].cell(lines, facts[1], facts[2])
            else:  # a cell without a table is a block
                self._lines(lines)
        elif tag == "table":
            self._lines(self.tables.pop().layout())
            self.flows[-1].block(True)
        elif tag in BLOCK:
            flow = self.flows[-1]
            flow.block(tag in MARGIN and not (tag in LISTS and len(self.lists) > 1))
            if tag in LISTS:
                self.lists.pop()
            elif tag == "li":
                flow.shallower()
                flow.marker = ""
            elif tag in ("blockquote", "dd"):
                flow.shallower()
            elif tag in ("pre", "xmp", "textarea"):
                self.pre -= 1

    def _lines(self, lines: list[str]) -> None:
        flow = self.flows[-1]
        flow.break_line()
        for line in lines:
            flow._add(line)
            flow.break_line(keep_blank=True)

    def text(self, data: str) -> None:
        if not self.unseen and self.visible[-1]:
            self.flows[-1].text(html.unescape(data) if "&" in data else data, bool(self.pre))


def page_text(page: str | None) -> str:
    """All visible text of a page; a null or empty page has none."""
    if not page:
        return ""
    page = page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�")
    out = _Renderer()
    stack: list[tuple[str, tuple]] = []
    count: Counter[str] = Counter()

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            tag, facts = stack.pop()
            count[tag] -= 1
            out.closed(tag, facts)

    def find(tags: frozenset | tuple, stop: frozenset) -> int:
        """Place of the nearest open element of ``tags`` this side of ``stop``, or -1."""
        if any(count[t] for t in tags):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in tags:
                    return i
                if stack[i][0] in stop:
                    break
        return -1

    def open_(tag: str, raw: str) -> None:
        if count["head"] and tag not in _HEAD_ONLY and (i := find(("head",), frozenset())) >= 0:
            close_to(i)
        if tag in ("html", "body") and count[tag]:
            return
        while tag in IMPLIED_ENDS and (i := find(*IMPLIED_ENDS[tag])) >= 0:
            close_to(i)
        if tag in ("td", "th") and find(("tr",), frozenset(["table", "template"])) < 0 and count["table"]:
            open_("tr", "")
        if tag in CLOSES_P and count["p"] and (i := find(("p",), SCOPE | {"button"})) >= 0:
            close_to(i)
        facts = out.opened(tag, raw)
        if tag in VOID:
            out.closed(tag, facts) if tag != "br" else None
            if tag == "br" and facts[0] == "unseen":
                out.closed(tag, facts)
        else:
            stack.append((tag, facts))
            count[tag] += 1

    at, end = 0, len(page)
    last = page.rfind(">") + 1  # no tag ends beyond it; searching no farther keeps broken markup linear
    if (cut := page.find("<!--", last)) >= 0:  # a comment that never ends
        end = cut
    while at < end:
        token = _TOKEN.search(page, at, last)
        stop = token.start() if token else end
        if stop > at:
            data = page[at:stop]
            if count["head"] and data.strip(" \t\n\f") and (i := find(("head",), frozenset())) >= 0:
                close_to(i)
            out.text(data)
        if not token:
            break
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if token["never"] is not None:
                break
            continue
        tag = tag.lower()
        if token["end"]:
            if tag == "p" and find(("p",), SCOPE) < 0:
                open_("p", "")
            if tag == "br":
                open_("br", "")
            elif tag in FORMATTING:
                if (i := find((tag,), SCOPE)) >= 0:
                    if stack[i][1][3] or not any(t in SPECIAL for t, _ in stack[i + 1 :]):
                        close_to(i)
                    else:  # blocks that were opened within it stay open
                        _, facts = stack.pop(i)
                        count[tag] -= 1
                        out.closed(tag, facts)
            elif tag not in SPECIAL:
                if (i := find((tag,), SPECIAL)) >= 0:
                    close_to(i)
            elif tag not in VOID and tag not in ("html", "body") and (i := find((tag,), SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else frozenset(["table"]) - {tag})) >= 0:
                close_to(i)
            continue
        open_(tag, token["raw"])
        if (count["svg"] or count["math"]) and tag not in ("svg", "math") and token["raw"].endswith("/") and tag not in VOID:
            close_to(len(stack) - 1)  # in drawings and formulas a tag may close itself
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            out.text(page[at : found.start() if found else end].removeprefix("\n")) if tag not in UNSEEN else None
            at = found.end() if found else len(page)
            close_to(len(stack) - 1)
    close_to(0)
    return "\n".join(out.flows[0].done()).replace("\xa0", " ")


def extract_text(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` columns with ``text``, the page as a reader sees it; one row for each row, whatever the markup.

    A null or empty page gives an empty text. Unclosed, misnested and unknown tags are taken as the tree builder
    takes them; no visible text is cut off. Indentation ends at 80 blanks, aligned columns at 400. A column of ``keep`` that
    is called ``text`` already is replaced.
    """
    keep = [c for c in keep if c != "text"]
    S.arrow_batches(pages.sparkSession)
    rows = pages.select(*keep, F.col(html_column).cast("string").alias("__html"))
    schema = rows.drop("__html").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [page_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)
