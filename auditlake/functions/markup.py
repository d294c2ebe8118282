"""Nested markup: lists and quotes in markdown, and what elements hold, each by one walk with a stack over a page's tags.

Regular expressions of the JVM do the text; only nesting, which they cannot follow, is walked here, row by row
and in time linear in a page.
"""

from __future__ import annotations

import html as htmllib
import re
import sys
from collections.abc import Callable
from itertools import accumulate

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Workers get these functions with the query, whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Between the pieces of a page, and between the cells of one; private-use characters, as html.py has.
ROW, CELL = "\uE004", "\uE005"
_BREAK = re.compile(r"</?(?:ul|ol|li|blockquote|pre)(?:[\s/][^<>]*)?>", re.I)
_TAGS = re.compile(r"<[^<>]*>")
# Tags that show something without any text: images, rules, and links.
_VISIBLE = re.compile(r"<(?:img|hr|a)[\s/>]", re.I)
_NAME = re.compile(r"<(/?)([a-zA-Z]+)")
_START = re.compile(r"""\sstart\s*=\s*["']?(-?\d{1,9})""", re.I)


# Elements inside each other beyond this depth count as siblings, as they do in browsers.
DEEPEST = 512


class _Open:
    """An open list (ul, ol), item (li) or quote; ``number`` counts a list's items and is an item's own number."""

    __slots__ = ("fresh", "kind", "mark", "number", "used")

    def __init__(self, kind: str, number: int = 0, mark: str = ""):
        self.kind, self.number, self.mark = kind, number, mark
        self.fresh, self.used = kind == "li", False


def _step(stack: list[_Open], tag: str) -> None:
    """What a tag does to the open lists, items and quotes."""
    closing, name = _NAME.match(tag).groups()
    name = name.lower()
    places = [i for i, e in enumerate(stack) if e.kind == name]
    last_list = max((i for i, e in enumerate(stack) if e.kind in ("ul", "ol")), default=-1)
    if closing:
        if places and (name != "li" or places[-1] > last_list):
            del stack[places[-1] :]
    elif name == "li":
        if last_list < 0:
            stack.append(_Open("ul"))
            last_list = len(stack) - 1
        del stack[last_list + 1 :]
        inside = stack[-1]
        inside.number += 1
        stack.append(_Open("li", mark=f"{inside.number}.  " if inside.kind == "ol" else "-   "))
    elif len(stack) < DEEPEST:
        start = _START.search(tag) if name == "ol" else None
        stack.append(_Open(name, int(start[1]) - 1 if start else 0))


def _margin(stack: list[_Open]) -> str:
    return "".join("> " if e.kind == "blockquote" else "    " if e.kind == "li" else "" for e in stack)


def laid_out(page: str) -> str:
    """A page's text between the tags of lists, quotes and preformatted parts, each piece with its place in the markdown.

    Cells of a piece: what separates it from the one before, the margin of its first line, that of its other lines, its
    markup, and ``pre`` if it is preformatted. Pieces that show nothing are left out.
    """
    out: list[str] = []
    stack: list[_Open] = []
    shared = at = 0
    pre = False
    for m in [*_BREAK.finditer(page), None]:
        name = _NAME.match(m[0])[2].lower() if m else ""
        if pre and m and name != "pre":
            # Preformatted text keeps what stands in it.
            continue
        piece = page[at : m.start() if m else len(page)]
        if _shows(piece):
            fresh = next((i for i, e in enumerate(stack) if e.fresh), None)
            gap = ""
            if out:
                # Items follow each other line by line, and so does a list that begins inside an item.
                near = fresh is not None and (stack[fresh - 1].used or (fresh >= 2 and stack[fresh - 2].kind == "li"))
                gap = "\n" if near else "\n" + _margin(stack[:shared]).rstrip(" ") + "\n"
            first = "".join(e.mark if e.fresh else _margin([e]) for e in stack)
            out.append(CELL.join([gap, first, _margin(stack), piece, "pre" if pre else ""]))
            for e in stack:
                e.fresh, e.used = False, True
            shared = len(stack)
        if m is None:
            break
        at = m.end()
        if name == "pre":
            pre = not m[0].startswith("</")
        else:
            _step(stack, m[0])
            shared = min(shared, len(stack))
    return ROW.join(out)


def _shows(piece: str) -> bool:
    return _VISIBLE.search(piece) is not None or _TAGS.sub("", piece).strip() != ""


# Spark sends plain Python functions about 100 rows at a time, Arrow ones 10,000: with whole pages as rows, what a
# worker holds must not grow with the table until such batches are full.
@F.udf(T.StringType(), useArrow=False)
def _laid_out(page: str | None) -> str | None:
    return None if page is None else laid_out(page)


def placed_pieces(page: Column, text: Callable[[Column], Column], preformatted: Callable[[Column], Column]) -> Column:
    """Markdown of a page whose pieces are converted by ``text`` and ``preformatted``."""

    def piece(row: Column) -> Column:
        cells = F.split(row, CELL)
        return F.get(
            F.transform(
                F.array(cells),
                lambda c: F.concat(c[0], c[1], F.replace(F.when(c[4] == "pre", preformatted(c[3])).otherwise(text(c[3])), F.lit("\n"), F.concat(F.lit("\n"), c[2]))),
            ),
            F.lit(0),
        )

    rows = F.split(_laid_out(page), ROW)
    return F.array_join(F.transform(F.filter(rows, lambda r: r != ""), piece), "")


# ---------------------------------------------------------------- what elements hold

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"'=]+|=\s*+(?:"[^"]*"|'[^']*')?|["'])*+)>""")
_ROLE = re.compile(r"""\srole\s*=\s*(?:"\s*tabpanel\s*"|'\s*tabpanel\s*'|tabpanel(?=[\s/]|$))""", re.I)
_CLASS = re.compile(r"""\sclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_DATA = re.compile(r"\sdata-tab-panel(?=[\s=/]|$)", re.I)
# Classes and element names of tab panels.
PANEL_CLASSES, PANEL_TAGS = {"tabs__panel", "tabs-panel", "tab-panel"}, {"mdx-tab-panel", "tab-panel"}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())


def _panel_ways(name: str, attributes: str) -> int:
    """In how many of the four ways a tag says that it is a panel."""
    found = _CLASS.search(attributes) if attributes else None
    classes = set((found[1] or found[2] or found[3] or "").split()) if found else set()
    return bool(_ROLE.search(attributes)) + bool(classes & PANEL_CLASSES) + bool(_DATA.search(attributes)) + (name in PANEL_TAGS)


def panel_sizes(page: str) -> tuple[int, int]:
    """Number of tab panels, once for each way that marks one, and the characters of their collapsed text.

    A panel reaches to the tag that closes it, over all that is nested in it; without one, to the end of the page.
    """
    pieces: list[str] = []
    stack: list[tuple[str, int, int]] = []
    opened: dict[str, int] = {}
    spans: list[tuple[int, int, int]] = []
    at = size = 0

    def add(text: str) -> None:
        nonlocal size
        text = htmllib.unescape(text) if "&" in text else text
        pieces.append(text)
        size += len(text)

    while (mark := page.find("<", at)) >= 0:
        m = _TAG.match(page, mark)
        if m is None and page[mark + 1 : mark + 2].isalpha():
            # A tag that is never closed swallows the rest.
            add(page[at:mark])
            at = len(page)
            break
        add(page[at : m.start() if m else mark + 1])
        at = m.end() if m else mark + 1
        if m is None:
            continue
        name = m[2].lower()
        if m[1]:
            if opened.get(name):
                while True:
                    top, start, ways = stack.pop()
                    opened[top] -= 1
                    if ways:
                        spans.append((start, size, ways))
                    if top == name:
                        break
        elif name not in _VOID:
            ways = _panel_ways(name, m[3])
            stack.append((name, size, ways))
            opened[name] = opened.get(name, 0) + 1
    add(page[at:])
    spans += [(start, size, ways) for _, start, ways in stack if ways]
    if not spans:
        return 0, 0
    text = "".join(pieces)
    # UTF-16 units of what is no white space, and beginnings of words, up to each place.
    units = [0, *accumulate(0 if c.isspace() or c == "\uFEFF" else 1 + (c > "\uFFFF") for c in text)]
    starts = [0, *accumulate(units[i + 1] > units[i] and (i == 0 or units[i] == units[i - 1]) for i in range(len(text)))]
    chars = 0
    for a, b, ways in spans:
        if a < b:
            words = starts[b] - starts[a] + (a > 0 and units[a + 1] > units[a] and starts[a + 1] == starts[a])
            chars += ways * (units[b] - units[a] + max(words - 1, 0))
    return sum(ways for *_, ways in spans), chars


@F.udf(T.StructType([T.StructField("panels", T.LongType()), T.StructField("chars", T.LongType())]), useArrow=False)
def panels_of(page: str | None) -> tuple[int | None, int | None]:
    return (None, None) if page is None else panel_sizes(page)
