"""Fields of fetched pages by selector: each page is parsed once, whatever is asked of it.

A ``Pick`` says where a value stands: steps to the element that it lies in, a selector, and what is taken of what matches,
the text or an attribute, of the first match or of all, or a record of further picks. ``select`` runs a set of picks over
every element that a root selector matches, as an Arrow job over a table of pages, and gives columns of the types that follow from the picks.
Pages of a site repeat few layouts: where values stand is found once for a layout, and other pages of it are only cut at their tags (``Layouts``).

Selectors are groups of compounds (tag, ``#id``, ``.class``, ``[attr]``, ``[attr=v]`` and its forms ``*= ^= $= ~=``, ``:nth-child(n)``) joined by a space
(descendant) or ``>`` (child). An empty selector is the element itself.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from agendry.runtime import share_code

VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
#: Elements that another of the kind ends, and the elements beyond which it doesn't.
ENDS = {"li": ("ul", "ol"), "option": ("select",), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "p": ()}
#: Rows of an Arrow batch: a worker holds a batch of pages several times over.
ROWS = 500


@dataclass(frozen=True)
class Pick:
    """``within`` are steps, each a choice of selectors of which the first that matches is gone into; no match in a step gives null.

    ``attr`` takes an attribute in place of the text, ``many`` all matches in place of the first, ``fields`` a record of each match.
    Texts are stripped. A missing element, or attribute, is null; of many, those are left out.
    """

    selector: str = ""
    attr: str | None = None
    many: bool = False
    within: tuple[tuple[str, ...], ...] = ()
    fields: tuple[tuple[str, "Pick"], ...] = ()

    def kind(self) -> str:
        one = f"struct<{','.join(f'{n}:{p.kind()}' for n, p in self.fields)}>" if self.fields else "string"
        return f"array<{one}>" if self.many else one


class Page(HTMLParser):
    """Elements in document order; those of a subtree follow its root up to ``end``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tag, self.attrs, self.parent, self.end, self.nth = ["#page"], [{}], [-1], [0], [1]
        #: Each text with the last element begun before it and the one that it stands in.
        self.texts: list[tuple[int, int, str]] = []
        self.open, self.children = [0], [0]
        self.feed(html)
        self.close()
        while self.open:
            self._shut()

    def _shut(self) -> None:
        self.end[self.open.pop()] = len(self.tag)

    def handle_starttag(self, tag, attrs):
        if tag in ENDS:
            for i in range(len(self.open) - 1, 0, -1):
                name = self.tag[self.open[i]]
                if name == tag:
                    while len(self.open) > i:
                        self._shut()
                    break
                if name in ENDS[tag] or tag == "p":
                    break
        parent = self.open[-1]
        self.children[parent] += 1
        for held, value in ((self.tag, tag), (self.attrs, {k: v or "" for k, v in reversed(attrs)}), (self.parent, parent), (self.end, len(self.tag) + 1), (self.nth, self.children[parent]), (self.children, 0)):
            held.append(value)
        if tag not in VOID:
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[i]] == tag:
                while len(self.open) > i:
                    self._shut()
                return

    def handle_data(self, data):
        self.texts.append((len(self.tag) - 1, self.open[-1], data))

    def text(self, node: int) -> str:
        """What stands in a subtree."""
        begun = self.texts[bisect_left(self.texts, node, key=lambda t: t[0]) : bisect_left(self.texts, self.end[node], key=lambda t: t[0])]
        return "".join(t for _, owner, t in begun if node <= owner < self.end[node]).strip()

    def attr(self, node: int, name: str) -> str | None:
        return self.attrs[node].get(name)


@lru_cache(maxsize=512)
def compiled(selector: str) -> tuple:
    """Groups of (combinator, tests) from the last compound back."""
    groups = []
    for group in re.split(r",(?![^\[]*\])", selector):
        parts, comb = [], " "
        for token in re.findall(r"""\s*>\s*|\s+|(?:\[[^\]]*\]|:nth-child\(\d+\)|[^\s>\[:]|:(?!nth-child))+""", group.strip()):
            if not token.strip() or token.strip() == ">":
                comb = token.strip() or " "
                continue
            tests = []
            for m in re.finditer(r"""\[\s*([\w-]+)\s*(?:([*^$~]?)=\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+)))?\s*\]|:nth-child\((\d+)\)|([.#]?)([\w-]+)|\*""", token):
                name, op, *values, nth, sign, word = m.groups()
                value = next((v for v in values if v is not None), None)
                if name:
                    tests.append(("[", name, op, value))
                elif nth:
                    tests.append(("n", int(nth), None, None))
                elif word:
                    tests.append((sign, word, None, None))
            parts.append((comb, tuple(tests)))
            comb = " "
        groups.append(tuple(reversed(parts)))
    return tuple(groups)


def _passes(tag: str, at: dict[str, str], test: tuple) -> bool:
    """An element passes a test that is not about its place."""
    kind, name, op, value = test
    if kind == "":
        return tag == name
    if kind == ".":
        return name in at.get("class", "").split()
    if kind == "#":
        return at.get("id") == name
    if value is None:
        return name in at
    own = at.get(name)
    return own is not None and {"": own == value, "*": value in own, "^": own.startswith(value), "$": own.endswith(value), "~": value in own.split()}[op]


def _fits(page: Page, node: int, tests: tuple) -> bool:
    return all(page.nth[node] == t[1] if t[0] == "n" else _passes(page.tag[node], page.attrs[node], t) for t in tests)


def _stands(page: Page, node: int, parts: tuple) -> bool:
    """The element fits the last compound and what is above it fits the rest."""
    if not _fits(page, node, parts[0][1]):
        return False
    if len(parts) == 1:
        return True
    above = page.parent[node]
    while above > 0:
        if _stands(page, above, parts[1:]):
            return True
        if parts[0][0] == ">":
            return False
        above = page.parent[above]
    return False


def matches(page: Page, root: int, selector: str) -> Iterator[int]:
    """Elements below ``root`` that a selector matches, in document order; the root itself for an empty one."""
    if not selector:
        yield root
        return
    groups = compiled(selector)
    for node in range(root + 1, page.end[root]):
        if any(_stands(page, node, g) for g in groups):
            yield node


def taken(page: Page, root: int, pick: Pick):
    """The value of a pick at an element."""
    for choice in pick.within:
        root = next((n for s in choice for n in matches(page, root, s)), -1)
        if root < 0:
            return [] if pick.many else None
    found = matches(page, root, pick.selector)
    one = lambda n: {k: taken(page, n, p) for k, p in pick.fields} if pick.fields else page.text(n) if pick.attr is None else page.attr(n, pick.attr)
    if pick.many:
        return [v for v in map(one, found) if v is not None]
    return next(map(one, found), None)


_SPACE = r"[ \t\n\r\f]"
#: Markup that every reader cuts alike: well-formed tags, plain comments and a document type.
_MARK = re.compile(rf"""(</[a-zA-Z][a-zA-Z0-9-]*{_SPACE}*>|<[a-zA-Z][a-zA-Z0-9-]*(?:{_SPACE}+[a-zA-Z_][a-zA-Z0-9_:.-]*(?:="[^"<]*"|='[^'<]*')?)*{_SPACE}*/?>|<!--[^<>-]*(?:-[^<>-]+)*-->|<!(?i:doctype)[^<>]*>)""")
_NAME = re.compile(r"</?([a-zA-Z0-9-]+)")
_ATTR = re.compile(rf"""{_SPACE}([a-zA-Z_][a-zA-Z0-9_:.-]*)(?:="([^"]*)"|='([^']*)')?""")
#: Elements whose text is no markup; the text of the first two is not decoded. Pages with others of them are left to ``Page``.
RAW, ESCAPABLE, OTHER_RAW = frozenset(["script", "style"]), frozenset(["title", "textarea"]), frozenset(["xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"])
#: Layouts, and marks, that a task keeps; pages with more marks than the last number keep none.
LAYOUTS, MARKS, LONG = 512, 50_000, 5_000


class _Attr(tuple):
    """Where an attribute stands: the place of its mark and its name."""


class _Outline(Page):
    """The elements of marks; a text is where its pieces stand (piece ``i`` follows mark ``i - 1``), and so is an attribute."""

    def __init__(self, marks: list[tuple]):
        HTMLParser.__init__(self)
        self.tag, self.attrs, self.parent, self.end, self.nth = ["#page"], [{}], [-1], [0], [1]
        self.texts, self.open, self.children, self.mark = [(0, 0, 0)], [0], [0], [-1]
        for i, (kind, tag, attrs, _) in enumerate(marks):
            if kind == "<":
                self.handle_starttag(tag, attrs.items())
                self.mark.append(i)
            elif kind == "/":
                self.handle_endtag(tag)
            self.texts.append((len(self.tag) - 1, self.open[-1], i + 1))
        while self.open:
            self._shut()

    def text(self, node: int) -> tuple[int, ...]:
        begun = self.texts[bisect_left(self.texts, node, key=lambda t: t[0]) : bisect_left(self.texts, self.end[node], key=lambda t: t[0])]
        return tuple(i for _, owner, i in begun if node <= owner < self.end[node])

    def attr(self, node: int, name: str) -> _Attr | None:
        return _Attr((self.mark[node], name)) if name in self.attrs[node] else None


def _value(at, texts: list[str], marks: list[tuple]):
    """What stands at a place, or at the places of a list or a record."""
    kind = type(at)
    if kind is tuple:
        return texts[at[0]].strip() if len(at) == 1 else "".join([texts[i] for i in at]).strip()
    if kind is _Attr:
        return marks[at[0]][2][at[1]]
    if kind is list:
        return [_value(a, texts, marks) for a in at]
    return {k: _value(a, texts, marks) for k, a in at.items()} if kind is dict else None


class Layouts:
    """The rows of pages for a root and picks, as ``Page`` gives them.

    A layout is the sequence of a page's marks, of each no more than its tag, the tests of the selectors that it passes and which of the picked attributes
    it has. That settles where all values stand, so pages of a known layout need no elements. Pages whose markup readers could cut in several ways go to ``Page``.
    """

    def __init__(self, root: str, picks: dict[str, Pick]):
        self.root, self.picks = root, picks
        selectors, attrs, todo = [root], [], [*picks.values()]
        while todo:
            p = todo.pop()
            selectors += [p.selector, *[s for choice in p.within for s in choice]]
            attrs += [p.attr] if p.attr else []
            todo += [f for _, f in p.fields]
        self.tests = sorted({t for s in selectors if s for group in compiled(s) for _, tests in group for t in tests if t[0] != "n"}, key=repr)
        self.attrs = sorted(set(attrs))
        self.marks: dict[str, tuple] = {}
        self.places: dict[tuple, list | None] = {}

    def _mark(self, text: str) -> tuple:
        """(kind, tag, attributes, what a layout keeps of it)."""
        if text[1] == "!":
            return "!", "", {}, "!"
        tag = _NAME.match(text)[1].lower()
        if text[1] == "/":
            return "/", tag, {}, f"/{tag}"
        if "&" in text:
            one = Page(text)
            attrs = one.attrs[1]
        else:
            attrs = {n.lower(): a or b for n, a, b in reversed(_ATTR.findall(text))}
        passed = tuple(i for i, t in enumerate(self.tests) if _passes(tag, attrs, t))
        return "<", tag, attrs, (tag, text.endswith("/>") and tag in RAW | ESCAPABLE, passed, tuple(a in attrs for a in self.attrs))

    def _places(self, marks: list[tuple]) -> tuple[list, frozenset] | None:
        """Where the values of each row stand, and the texts that are not decoded; None for markup that is left to ``Page``."""
        raw = []
        for i, (kind, tag, _, kept) in enumerate(marks):
            if kind == "<" and tag in RAW | ESCAPABLE | OTHER_RAW:
                if tag in OTHER_RAW or kept[1] or i + 1 == len(marks) or marks[i + 1][:2] != ("/", tag):
                    return None
                raw += [i + 1] if tag in RAW else []
        page = _Outline(marks)
        return [[taken(page, node, p) for p in self.picks.values()] for node in matches(page, 0, self.root)], frozenset(raw)

    def rows(self, html: str) -> list[list]:
        """The values of the picks for each element that the root matches."""
        parts = _MARK.split(html)
        texts, marks = parts[::2], []
        if len(texts) == html.count("<") + 1:
            if len(self.marks) > MARKS:
                self.marks.clear()
            known = self.marks
            for t in parts[1::2]:
                m = known.get(t)
                if m is None:
                    m = known[t] = self._mark(t)
                marks.append(m)
            layout = tuple([m[3] for m in marks])
            if layout in self.places:
                found = self.places[layout]
            else:
                if len(self.places) >= LAYOUTS:
                    self.places.clear()
                found = self._places(marks)
                if len(marks) <= LONG:
                    self.places[layout] = found
            if found:
                if "&" in html:
                    texts = [unescape(t) if "&" in t and i not in found[1] else t for i, t in enumerate(texts)]
                return [[_value(a, texts, marks) for a in row] for row in found[0]]
        page = Page(html)
        return [[taken(page, node, p) for p in self.picks.values()] for node in matches(page, 0, self.root)]


def _arrow(pick: Pick) -> pa.DataType:
    one = pa.struct([(n, _arrow(p)) for n, p in pick.fields]) if pick.fields else pa.string()
    return pa.list_(one) if pick.many else one


def select(pages: DataFrame, root: str, picks: dict[str, Pick], key: str = "page_id") -> DataFrame:
    """(key, pos, picks): a row for each element of each page that ``root`` matches, in page order; the page itself for an empty root.

    Null and empty pages have no elements but themselves. Markup that isn't closed ends with what it stands in. Other columns are not read.
    """
    source = share_code(pages).select(key, "html")
    schema = f"{key} {source.schema[key].dataType.simpleString()}, pos int, " + ", ".join(f"{n} {p.kind()}" for n, p in picks.items())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layouts = Layouts(root, picks)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part, at, pos, rows = batch.slice(start, ROWS), [], [], []
                for i, html in enumerate(part.column(1).to_pylist()):
                    found = layouts.rows(html or "")
                    at += [i] * len(found)
                    pos += range(len(found))
                    rows += found
                own = part.column(0).take(pa.array(at, pa.int64()))
                columns = zip(*rows) if rows else [()] * len(picks)
                yield pa.RecordBatch.from_arrays([own, pa.array(pos, pa.int32()), *[pa.array(v, _arrow(p)) for v, p in zip(columns, picks.values())]], [key, "pos", *picks])

    return source.mapInArrow(parse, schema)
