"""Main text of web pages by composite text density.

A page is parsed into a DOM. Parts that are not article text (menus, page headers and footers, asides,
forms, scripts, adverts, notices, reader comments) go first, by element, role, and the words of class and
id. Such a word is a hint, not a proof: a part that holds most of what the page says stays, a large part
stays if its word can also be an article's subject, and lists that are links alone are menus whatever
their name. For what remains, the composite density of a node is its characters per tag, scaled down by
the share of its characters that stand in links. A node's score is the sum of its children's densities.
The least density on the path from ``body`` to the node of the largest score is the threshold: children
below it are not counted, and the node whose remaining children sum to most is the core. The article is
the ``article`` or ``main`` around the core, else the nearest element around it that is more than a part
of an article. All its blocks are returned in page order, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from agendry.llm.arrow import map_batches

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("script style noscript template nav footer button select textarea svg iframe object canvas audio video dialog menu head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that are parts of an article, never the whole of one.
PARTS = frozenset("section p blockquote ul ol li dl dd dt pre table tbody tr td th figure figcaption h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class or id that mark reader comments.
COMMENTS = frozenset("comment comments comentarios kommentare commentaires disqus replies respond".split())
#: Words that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar aside footer masthead "
    "topbar toolbar cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login recommended recommendations widget paywall".split()
)
#: Words that mark small parts, and that articles can be about.
HINTS = frozenset(
    "promo promotion notice notices notification alert subscription reply share sharing social related popular trending search skip legal copyright disclaimer".split()
)
#: Share of a page's text from which a part stays in spite of a mark, and in spite of a hint.
MARKED, HINTED = 0.8, 0.25
#: Elements whose class and id say what kind of page it is, not what they are.
KEPT = frozenset("body html main".split())
#: Prefixes of class names that say what stands around or inside an element.
ABOUT = ("has-", "with-", "no-", "is-", "without-")
WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*$")
#: Share of characters in links, and number of links, from which a list without paragraphs is a menu.
LINK_SHARE, LINKS = 0.9, 3
#: What ends an element that is still open, and the elements beyond which it isn't looked for.
SAME = {"li": ("ul", "ol", "menu"), "option": ("select",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",)}
BESIDES_P, INNER = ("table", "td", "button"), ("td", "li", "article", "body")


class Node:
    __slots__ = ("tag", "kids", "chars", "tags", "link_chars", "link_tags", "paragraphs", "density", "score", "gone", "inside")

    def __init__(self, tag: str, gone: float = 0.0, inside: bool = False):
        #: ``gone`` is 0 or the share of the page's text that the part must exceed to stay.
        self.tag, self.gone, self.inside, self.kids = tag, gone, inside, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.paragraphs = 0
        self.density = self.score = 0.0


def _mark(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> float:
    if tag in NEVER:
        return 1.0
    limit = MARKED if tag in ("aside", "form") or tag == "header" and not in_article else 0.0
    if tag in KEPT:
        return limit
    for name, value in attrs:
        if name in ("class", "id") and value:
            own = " ".join(v for v in value.split() if not v.startswith(ABOUT))
            words = set(WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", own).lower()))
            if words & COMMENTS:
                return 1.0
            if words & MARKS:
                limit = max(limit, MARKED)
            elif words & HINTS:
                limit = max(limit, HINTED)
        elif name == "role" and value and value.strip().lower() in ROLES:
            limit = max(limit, MARKED)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 1.0
    return limit


class _Tree(HTMLParser):
    """Nodes as they open and close; the places of open elements are kept by name, so no tag searches the stack."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.stack = [self.root]
        self.open: defaultdict[str, list[int]] = defaultdict(list)

    def _close(self, stop: int) -> None:
        while len(self.stack) > stop:
            self.open[self.stack.pop().tag].pop()

    def _open_at(self, tag: str, until: tuple[str, ...]) -> int:
        """The place of the innermost open element of that name, or 0 if there is none inside of ``until``."""
        at = self.open[tag][-1] if self.open[tag] else 0
        return at if all(not self.open[u] or self.open[u][-1] <= at for u in until) else 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag not in INLINE and tag != "br" and (i := self._open_at("p", BESIDES_P)):
            self._close(i)  # a block ends an open paragraph
        if tag in SAME and (i := self._open_at(tag, SAME[tag])):
            self._close(i)
        if tag == "body" and self.open["head"]:
            self._close(1)
        inside = bool(self.open["article"] or self.open["main"])
        node = Node(tag, _mark(tag, attrs, inside), inside or tag in ("article", "main"))
        self.stack[-1].kids.append(node)
        if tag not in VOID:
            self.open[tag].append(len(self.stack))
            self.stack.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if i := self._open_at(tag, () if tag not in INLINE and tag != "p" else INNER):
            self._close(i)

    def handle_data(self, data: str) -> None:
        self.stack[-1].kids.append(data)


def _postorder(root: Node) -> list[Node]:
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo.extend(k for k in n.kids if isinstance(k, Node) and not k.gone)
    return order[::-1]


def _count(n: Node) -> None:
    """Characters, tags and links of a node, from its children that are not gone."""
    for k in n.kids:
        if isinstance(k, str):
            n.chars += len(SPACE.sub("", k))
        elif not k.gone:
            n.chars, n.tags, n.paragraphs = n.chars + k.chars, n.tags + k.tags + 1, n.paragraphs + k.paragraphs + (k.tag == "p")
            n.link_chars, n.link_tags = n.link_chars + k.link_chars, n.link_tags + k.link_tags
    if n.tag == "a":
        n.link_chars, n.link_tags = n.chars, n.link_tags + 1


def _spare(root: Node) -> None:
    """Keep marked parts that say most of what the page says: each is weighed with what stands outside of marks.

    A part's text is what it has outside of marks inside it. A part that stays lays its own marked parts open.
    """
    every, todo = [], [root]
    while todo:
        n = todo.pop()
        every.append(n)
        todo.extend(k for k in n.kids if isinstance(k, Node) and k.gone < 1)
    for n in reversed(every):
        _count(n)
    free = lambda n: n.chars - n.link_chars
    said, held, level = free(root), [], [root]

    def lay_open(n: Node) -> None:
        level = [n]
        while level:
            for k in level.pop().kids:
                if isinstance(k, Node) and k.gone < 1:
                    (held if k.gone else level).append(k)

    lay_open(root)
    while held:
        held.sort(key=free)
        for i in range(len(held) - 1, -1, -1):
            n = held[i]
            if free(n) > n.gone * (free(n) + said):
                n.gone = 0.0
                said += free(n)
                del held[i]
                lay_open(n)
                break
        else:
            break
    for n in every:
        n.chars = n.tags = n.link_chars = n.link_tags = n.paragraphs = 0


def _measure(root: Node) -> Node:
    """Densities and scores of all nodes that remain; gives the node of the article."""
    _spare(root)
    for n in _postorder(root):
        _count(n)
        # A list of links alone is a menu, whatever its name.
        n.gone = 1.0 if n.tag in ("ul", "ol", "dl") and not n.paragraphs and n.link_tags >= LINKS and n.link_chars >= LINK_SHARE * n.chars else n.gone
    order = _postorder(root)
    for n in order:
        n.kids = [k for k in n.kids if not (isinstance(k, Node) and k.gone)]
        n.chars = n.tags = n.link_chars = n.link_tags = n.paragraphs = 0
        _count(n)
    body = next((n for n in reversed(order) if n.tag == "body"), root)
    share = body.link_chars / max(1, body.chars)
    for n in order:
        unlinked = max(1, n.chars - n.link_chars)
        base = math.log(n.chars * n.link_chars / unlinked + share * n.chars + math.e)
        inner = n.chars / max(1, n.link_chars) * max(1, n.tags) / max(1, n.link_tags)
        n.density = n.chars / max(1, n.tags) * max(0.0, math.log(max(1.0, inner)) / base) if n.chars else 0.0
    parent = {id(k): n for n in order for k in n.kids if isinstance(k, Node)}
    named = any(n.chars for n in order if n.tag in ("article", "main"))
    fit = [n for n in reversed(order) if n.tag not in INLINE and (n.inside or not named)]

    def path_of(n: Node) -> list[Node]:
        path = [n]
        while path[-1] is not body and id(path[-1]) in parent:
            path.append(parent[id(path[-1])])
        return path

    def densest(threshold: float) -> Node:
        for n in fit:
            own = n.density if any(isinstance(k, str) and not k.isspace() for k in n.kids) else 0.0
            n.score = own + sum(k.density for k in n.kids if isinstance(k, Node) and k.tag not in INLINE and k.density >= threshold)
        return max(fit, key=lambda n: n.score, default=body)

    path = path_of(densest(min(n.density for n in path_of(densest(0.0)))))
    if named:
        return next((n for n in path if n.tag in ("article", "main")), path[0])
    return next((n for n in path if n.tag not in PARTS), body)


def _blocks(node: Node) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    todo: list = [(node, False)]
    while todo:
        n, done = todo.pop()
        if isinstance(n, str):
            run.append(n)
        elif done or n.tag == "br":
            flush()
        else:
            if n.tag not in INLINE:
                flush()
                todo.append((n, True))
            todo.extend((k, False) for k in reversed(n.kids))
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article's text of a page; empty for null, empty and text-free pages."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(CUT_TAG.sub("", html))
    tree.close()
    return "\n".join(_blocks(_measure(tree.root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``, from the whole html.

    Null, empty and text-free pages give an empty text; rows repeated or with null ids stay rows.
    Broken markup (open tags, a tag or reference cut off at the end) is read as browsers read it.
    Other columns are not read.
    """

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        texts = [main_text(h.as_py()) for h in b.column(2)]
        return [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return map_batches(pages.select("page_id", "url", "html"), one, "page_id long, url string, text string, n_chars long")
