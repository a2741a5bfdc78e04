"""Operators over small hand-made tables: positions, grid cells, and rows of pages."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from agendry.operators import anchors as N, geo as G, merge as M
from agendry.operators.order import positions
from agendry.plans import export as E
from agendry.plans.catalog import current_version
from agendry.sources import extract as X


def test_positions(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1, 2, 3]), i) for i in range(200)] + [("lone", 5, 999)]
    table = spark.createDataFrame(rows, "g string, t int, id int").repartition(7)
    got = {r.id: (r.g, r.position) for r in positions(table, "g", "t", "id").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {r[2]: (g, k) for k, r in enumerate(own, 1)}
    assert got == want and positions(table.limit(0), "g", "t", "id").count() == 0


def test_grid_equals_boxes(spark):
    """Holes, several polygons of a shape, shapes over one another, and points on edges, corners and cell borders."""
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    box = lambda a, b, c, d: ring((a, b), (c, b), (c, d), (a, d))
    star = ring((0, 0), (3, 1.3), (6, 0), (4.7, 3), (6, 6), (3, 4.7), (0, 6), (1.3, 3))
    shapes = spark.createDataFrame([("holed", 1, [[box(0, 0, 4, 4), box(1, 1, 3, 3)]]), ("two", 2, [[box(-3, -3, -1, -1)], [box(2, 2, 2.5, 2.5)]]), ("star", 3, [[star]])], G.SHAPES)
    rng = random.Random(3)
    at = [(rng.uniform(-4, 7), rng.uniform(-4, 7)) for _ in range(400)] + [(x / 2, y / 2) for x in range(-7, 14) for y in range(-7, 14)] + [(None, 1.0), (1.0, None)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(at)], "id int, x double, y double")
    want = sorted(map(tuple, G.locate(points, shapes).collect()))
    for size in (0.5, 0.37, 5.0):
        found = G.locate_by_grid(points, shapes, size)
        assert sorted(map(tuple, found.collect())) == want
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and len({w[1] for w in want}) == 4
    cover = {(r.cx, r.cy, r.ord): r.border for r in G.cells(shapes, 0.5).collect()}
    assert cover[0, 0, 1] and not cover[1, 6, 1] and (4, 3, 1) not in cover


def test_link_chunks(spark):
    html = '<p>head</p><a class="c" href="/one">One <b>4 Out</b></a> text<div>2026/10/04</div><a href="/two">Two</a><a name="x">no link</a> 17.10.26 a 19.10.2026'
    rows = spark.createDataFrame([(html,), ("",)], "html string").select(F.explode(X.link_chunks(F.col("html"))).alias("r")).select("r.href", "r.chunk", F.from_unixtime("r.earliest", "yyyy-MM-dd").alias("a"), F.from_unixtime("r.latest", "yyyy-MM-dd").alias("z")).collect()
    # Midnights in Lisbon are an hour before those of UTC in summer.
    assert [tuple(r) for r in rows] == [("/one", "One 4 Out text 2026/10/04", "2026-10-03", "2026-10-03"), ("/two", "Two no link 17.10.26 a 19.10.2026", "2026-10-16", "2026-10-18")]


def test_dom_cards(spark):
    html = '<li class="card x">A <a href="/1">one</a><ul><li>inner</li></ul></li><li>other</li><li class="card">B</li>'
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [tuple(r) for r in X.dom_cards(pages, "li", "card").collect()] == [(1, 0, "A oneinner", "/1"), (1, 1, "B", None)]


TEMPLATE = '<head>\n<meta name="description" content="">\n<title></title>\n</head>\n<body>{x}</body>'
EVENTS = "slug string, title string, description string, start_at long, end_at long, date_text string, venue string, city string, updated_at long"


def test_site_is_published_whole_or_not(spark, tmp_path):
    folder = f"file://{tmp_path}/site"
    make = lambda *rows: spark.createDataFrame(list(rows), EVENTS)
    one = ("a", "A &amp; <B>", None, 1_788_476_400, None, None, None, None, 1_788_476_400)
    out = {r.tbl: r.n for r in E.export(make(one, ("b", None, 'say "hi"', None, None, "Em breve", "V", "C", 1)), TEMPLATE, "https://s.org", "Site", folder).collect()}
    assert out == {"pages": 2, "sitemaps": 2, "robots": 1}
    html = {r.path: r.html for r in spark.read.parquet(f"{folder}/v=0/pages").collect()}
    a, b = html["evento/a/index.html"], html["evento/b/index.html"]
    assert "<title>A &amp; &lt;B&gt; — Site</title>" in a and '<meta name="description" content="A &amp; &lt;B&gt;">' in a and '"name":"A & \\u003cB>"' in a and a.endswith("</head>\n<body>{x}</body>") and a.startswith("<head>\n<meta name")
    assert '"startDate":"2026-09-04T00:00:00"' in a and "endDate" not in a and '<meta property="og:image" content="https://s.org/og/a.png" />' in a
    assert "<title>Evento — Site</title>" in b and "ld+json" not in b and 'content="say &quot;hi&quot;"' in b
    maps = {r.path: r.body for r in spark.read.parquet(f"{folder}/v=0/sitemaps").collect()}
    assert maps["sitemap-00001.xml"].index("<loc>https://s.org/</loc><lastmod>2026-09-03") < maps["sitemap-00001.xml"].index("/evento/a<") and "sitemap-00001.xml</loc>" in maps["sitemap.xml"]
    for rows, what in (([], "refusing"), ([one, (None, *one[1:])], "no slug"), ([one, one], "pages has 1 rows, not 2")):
        with pytest.raises(ValueError, match=what):
            E.export(make(*rows), TEMPLATE, "https://s.org", "Site", folder)
        assert current_version(spark, folder) == 0
    with pytest.raises(ValueError, match="template"):
        E.pages(make(one), "<head></head>", "https://s.org", "Site")


def fold(starts, window):
    out = []
    for t in sorted(set(starts)):
        if not out or t - out[-1] > window:
            out.append(t)
    return out


def test_pointers_equal_the_fold(spark):
    rng = random.Random(6)
    starts = {k: [rng.randrange(span) for _ in range(n)] for k, (n, span) in enumerate([(400, 90_000), (300, 3_000), (1, 5), (60, 2_000_000), (200, 7_300)])}
    starts[9] = [0, 3600, 7200, 7201, 10_800, 10_802, -5]
    rows = spark.createDataFrame([(k, t) for k, ts in starts.items() for t in [*ts, ts[0]]], "component int, start_at long")
    for window in (3600, 100):
        got = sorted(map(tuple, N.anchors(rows, window).collect()))
        assert got == sorted((k, t) for k, ts in starts.items() for t in fold(ts, window))
    assert N.anchors(rows.limit(0), 3600).count() == 0


def test_filled_over_ranges(spark):
    rng = random.Random(7)
    rows = [(rng.choice("ab"), i, rng.choice([None, None, None, i])) for i in range(300)] + [("c", 1, None)]
    got = {(r.g, r.i): (r.before, r.after) for r in N.filled(spark.createDataFrame(rows, "g string, i int, v int").repartition(5), "g", ["i"], F.col("v")).collect()}
    for g, i, _ in rows:
        own = [v for h, _, v in rows if h == g and v is not None]
        assert got[g, i] == (max([v for v in own if v <= i], default=None), min([v for v in own if v >= i], default=None))


def test_large_components_are_planned_alike(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, i % 3, "same", t, t + rng.choice([60, 30]), None, rng.choice([0, 0, 1, 2])) for i in range(240) for t in [rng.randrange(1_700_000_000, 1_700_000_000 + 200_000)]]
    table = spark.createDataFrame(rows, "id long, component long, norm string, start_at long, end_at long, item_key string, trust int")
    want = sorted(map(tuple, M.plan(table).collect()), key=str)
    monkeypatch.setattr(M, "HOT", 20)
    assert sorted(map(tuple, M.plan(table).collect()), key=str) == want and len({w[3] for w in want}) > 40


def test_plans_reckon_no_frame_anew_for_each_row(spark):
    """A frame that is open to the end costs the square of its rows: 20,000 rows of one component are planned in seconds."""
    rows = spark.range(20_000).select("id", F.lit(1).alias("component"), F.lit("n").alias("norm"), (F.col("id") * 60).alias("start_at"), F.lit(None).cast("bigint").alias("end_at"), F.lit(None).cast("string").alias("item_key"), F.lit(0).alias("trust"))
    frames = [df._jdf.queryExecution().analyzed().toString().lower() for df in (M.plan(rows), N.filled(rows, "component", ["start_at", "id"], F.col("id")))]
    assert not any("currentrow$(), unboundedfollowing$()" in f for f in frames)
    assert M.plan(rows).where("id = keeper_id").count() == -(-20_000 // 61)
