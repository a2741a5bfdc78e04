"""The selector engine and the packs that stand on it, over literal pages."""

from __future__ import annotations

import random

import pytest

from agendry.sources import packs as K, selectors as S

PAGE = """<html><body><ul id="all" class="a list"><li class="x" data-k="one two">1 <b>bold</b> tail<li class="x y">2<br>more</ul>after
<div class=y><p>p one<p>p two <i>in</i></div><table><tr><td>a<td>b<tr><td>c</table><img src="i.jpg" alt=""><script>var x = "<li class=x>";</script></body></html>"""


def texts(selector: str) -> list[str]:
    page = S.Page(PAGE)
    return [page.text(n) for n in S.matches(page, 0, selector)]


@pytest.mark.parametrize("selector, want", [
    ("li", ["1 bold tail", "2more"]), ("li.x", ["1 bold tail", "2more"]), (".x.y", ["2more"]), ("#all > li.y", ["2more"]), ("body li b", ["bold"]), ("body > li", []), ("ul > b", []),
    ("[data-k]", ["1 bold tail"]), ('[data-k="one two"]', ["1 bold tail"]), ("[data-k*=wo]", ["1 bold tail"]), ("[data-k^='one']", ["1 bold tail"]), ("li[data-k$=two]", ["1 bold tail"]), ("[data-k~=two]", ["1 bold tail"]), ("[data-k~=tw]", []),
    ("li:nth-child(2)", ["2more"]), ("td:nth-child(1)", ["a", "c"]), ("tr", ["ab", "c"]), ("p", ["p one", "p two in"]), ("div.y p > i", ["in"]), ("b, i", ["bold", "in"]), ("script", ['var x = "<li class=x>";']), ("nothing", []), ("li li", []),
])
def test_selectors(selector, want):
    assert texts(selector) == want


def test_odd_markup():
    for html in ("", "<", "</div>", "<p", "<ul><li>" * 50, "a &amp; b &nope; &#233;", "<!-- <li> -->x", "<div><span>open"):
        page = S.Page(html)
        assert page.end[0] == len(page.tag) and all(page.parent[i] < i < page.end[i] <= page.end[page.parent[i]] for i in range(1, len(page.tag)))
    assert S.Page("a &amp; b &#233;").text(0) == "a & b é" and S.Page("<!-- <li> -->x").text(0) == "x"
    deep = S.Page("<div>" * 3000 + "x")
    assert len(list(S.matches(deep, 0, "div div"))) == 2999 and deep.text(1) == "x"


def plain_rows(html, root, picks):
    page = S.Page(html)
    return [[S.taken(page, n, p) for p in picks.values()] for n in S.matches(page, 0, root)]


def test_layouts_give_what_elements_give():
    """Random markup, well-formed and not: many pages share layouts, with other texts and attributes."""
    picks = {
        "text": S.Pick(), "k": S.Pick(attr="data-k"), "b": S.Pick("b", many=True), "deep": S.Pick("p > .x", within=(("ul", "div"),)), "hrefs": S.Pick('a[href*="/e/"]', attr="href", many=True), "nth": S.Pick("li:nth-child(2)"),
        "rows": S.Pick("li", many=True, fields=(("t", S.Pick("i")), ("c", S.Pick(attr="class")), ("s", S.Pick("script, title")))),
    }
    pieces = [
        "<div>", "</div>", '<div class="x y">', "<ul>", "</ul>", "<li>", "</li>", "<p class='x'>", "</p>", "<b>", "</b>", "<i/>", "</i>", "<br>", "<br/>", "text {}", " &amp; {}", "&#233;", "&lt;b&gt;", '<a href="/e/{}">', '<A HREF="/o/{}" href="/e/">', "</a>", '<li data-k="{}" class="y">',
        '<li data-k="&quot;{}" class=x>', "<!-- c {} -->", "<!-- <b> -->", "<!DOCTYPE html>", "<script>if (a &amp; b) {}</script>", "<script>x < y</script>", "<title>T &amp; {}</title>", "<title>", "<script/>", "<style>", "a < b", "<", "&", "<div title='a > {}' hidden>", '<p a="1"b="2">', "\n", "<td>", "<?php ?>", "</b x>", "<noscript>n</noscript>",
    ]
    rng, cut, layouts = random.Random(1), 0, {root: S.Layouts(root, picks) for root in ("", "li", "div.x, ul")}
    for _ in range(3000):
        shape = rng.choices(pieces[:22] if rng.random() < 0.6 else pieces, k=rng.randint(0, 14))
        for _ in range(2):
            html = "".join(p.replace("{}", str(rng.randint(0, 99))) for p in shape)
            for root, each in layouts.items():
                assert each.rows(html) == plain_rows(html, root, picks), html
        cut += tuple(m[3] for m in map(layouts[""]._mark, S._MARK.split(html)[1::2])) in layouts[""].places
    assert cut > 1000 and all(len(each.places) <= S.LAYOUTS for each in layouts.values())


def test_known_layouts_need_no_elements(monkeypatch):
    """Before, each page was read into elements, some 0.6 ms of plain Python a page."""
    page = '<ul><li data-id="{}" class="c"><b>{} &amp; co</b><a href="/e/{}">x</a></li><li>none</li></ul>'
    layouts = S.Layouts("li[data-id]", {"id": S.Pick(attr="data-id"), "title": S.Pick("b"), "link": S.Pick('a[href*="/e/"]', attr="href")})
    assert layouts.rows(page.format(0, 0, 0)) == [["0", "0 & co", "/e/0"]]
    monkeypatch.setattr(S, "_Outline", None)
    monkeypatch.setattr(S, "Page", None)
    assert [layouts.rows(page.format(i, "é", i)) for i in range(1, 50)] == [[[str(i), "é & co", f"/e/{i}"]] for i in range(1, 50)]


def test_picks(spark):
    pages = spark.createDataFrame([(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (1, "<p class=y>alone</p>", "x")], "page_id long, html string, pos string")
    picks = {
        "first": S.Pick("li"), "all": S.Pick("li", many=True), "key": S.Pick("li", attr="data-k"), "keys": S.Pick("li", attr="data-k", many=True), "either": S.Pick("i", within=((".none", "div.y"),)), "lost": S.Pick("i", within=((".none",),)),
        "lists": S.Pick("p", many=True, within=((".none",),)), "rows": S.Pick("tr", many=True, fields=(("cells", S.Pick("td", many=True)), ("last", S.Pick("td:nth-child(2)")))),
    }
    got = [r.asDict(True) for r in S.select(pages, "", picks).collect()]
    assert got[0] == {
        "page_id": 1, "pos": 0, "first": "1 bold tail", "all": ["1 bold tail", "2more"], "key": "one two", "keys": ["one two"], "either": "in", "lost": None, "lists": [], "rows": [{"cells": ["a", "b"], "last": "b"}, {"cells": ["c"], "last": None}],
    }
    assert [r["first"] for r in got[1:]] == [None] * 3 and len(got) == 4
    own = S.select(pages, ".y", {"text": S.Pick(), "cls": S.Pick(attr="class")}).collect()
    assert [tuple(r) for r in own] == [(1, 0, "2more", "x y"), (1, 1, "p onep two in", "y"), (1, 0, "alone", "y")]
    assert S.select(pages.limit(0), "li", picks).count() == 0


def test_date_blocks(spark):
    """Wrapped and plain blocks, the year in the month, a time beside the year, and what is no date."""
    blocks = [
        '<div class="data-inicio"><i class="dia">4</i><i class="mes">Setembro</i><i class="ano">2026</i><i class="hora">às 14h00</i></div><div class="data-fim"><i class="dia">6</i><i class="mes">set 2026</i></div>',
        '<div class="date"><i class="dia">04</i><i class="mes">SET</i><i class="ano">2026</i><i class="ano">18h30</i></div>', '<i class="dia">4</i><i class="mes">set. 2026</i><i class="hora">9h</i>',
        '<i class="dia">4</i><i class="mes">xyz</i><i class="ano">2026</i>', '<i class="dia">x</i><i class="mes">set</i><i class="ano">2026</i>', '<i class="dia">4</i><i class="mes">set</i><i class="ano">1999</i>', '<i class="dia">31</i><i class="mes">fev</i><i class="ano">2026</i>', "",
    ]
    pages = spark.createDataFrame(list(enumerate(blocks)), "page_id long, html string")
    rows = S.select(pages, "", {"a": K._date_picks("inicio"), "z": K._date_picks("fim")})
    got = {r.page_id: (r.at, r.until) for r in rows.select("page_id", K._block_epoch(rows.a).alias("at"), K._block_epoch(rows.z).alias("until")).collect()}
    day = 1788476400  # 2026-09-04, midnight in Lisbon
    assert [got[i] for i in range(8)] == [(day + 14 * 3600, day + 2 * 86400), (day + 18 * 3600 + 1800, None), (day + 9 * 3600, None)] + [(None, None)] * 5


def test_agenda_cards_and_details(spark):
    card = '<a href="/pt/agenda/{}"><b class="proximo_title">{}</b><b class="local">Casa</b><b class="date"><i class="dia">4</i><i class="mes">set</i><i class="ano">2026</i></b></a>'
    listings = spark.createDataFrame([(1, card.format("a/", "Old A") + card.format("b", "B") + '<a href="/pt/agenda/c">no date</a>'), (2, card.format("a/", "New A") + '<a href="https://leiriagenda.cm-leiria.pt/pt/agenda/proximos-eventos?page=2">2</a>')], "page_id long, html string")
    detail = '<div class="titles"><h1 class="title">A, whole</h1><p class="local"> </p><p class="localidade">Leiria</p><div class="data-inicio"><i class="dia">5</i><i class="mes">set</i><i class="ano">2026</i></div></div>'
    details = spark.createDataFrame([("https://leiriagenda.cm-leiria.pt/pt/agenda/a/", detail), ("https://leiriagenda.cm-leiria.pt/pt/agenda/z", detail)], "url string, html string")
    got = {r.slug: r for r in K.leiriagenda(listings, details).collect()}
    assert set(got) == {"a", "b"} and (got["a"].title, got["a"].startAt, got["a"].venueName, got["a"].city, got["a"].error) == ("A, whole", 1788562800, "Casa", "Leiria", None)
    assert (got["b"].title, got["b"].startAt, got["b"].error) == ("B", None, "no detail page")
    assert K.leiriagenda(listings.limit(0), details).count() == 0


def test_box_office_sessions(spark):
    pages = spark.createDataFrame([(1, '<a href=" /Comprar/Bilhetes/7-a_b-c-teatro_leiria/?x=1 ">x</a><a href="/Comprar/Bilhetes/7-other-teatro_leiria/">x</a><a href="/Comprar/Bilhetes/8-far-porto/">x</a>')], "page_id long, html string")
    day = lambda d: f'<div class="sessao"><i class="ano">2026</i><i class="mes">dez</i><i class="dia">{d}</i></div>'
    html = f'<p>09/09/2026</p><div class="datas">{day(1)}{day(2)}{day(3)}<p class="proxima-sessao"><span>01 dez 2026 21:30</span><span>x</span><span>22h</span></p></div>'
    details = spark.createDataFrame([("https://www.bol.pt/Comprar/Bilhetes/7-a_b-c-teatro_leiria/", html)], "url string, html string")
    got = sorted(K.box_office(pages, details).collect(), key=lambda r: r.startAt or 0)
    first = 1796083200  # 2026-12-01, midnight in Lisbon
    assert [(r.startAt, r.hasTime, r.error) for r in got] == [(first + 21 * 3600 + 1800, True, None), (first + 86400 + 22 * 3600, True, None), (first + 2 * 86400 + 22 * 3600, True, None)]
    assert {(r.title, r.slug, r.venueName) for r in got} == {("A B C", "a_b-c", "Teatro Leiria")}
    assert [r.error for r in K.box_office(pages, details.limit(0)).collect()] == ["no detail page"]


def test_pages_of_one_file_are_dealt_over_tasks(spark):
    from helpers import SF

    from agendry.bound import packs

    assert spark.read.parquet(f"{SF}/events.parquet").rdd.getNumPartitions() == 1
    rows = packs.rows(spark, SF)
    assert rows.rdd.getNumPartitions() >= 3 * spark.sparkContext.defaultParallelism and rows.select("id").distinct().count() == rows.count()
