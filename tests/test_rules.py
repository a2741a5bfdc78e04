"""Rule cases as literal rows: identity, merging, normalisers, dates, places, geometry, maintenance."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from agendry import constants as C
from agendry.functions import dates as D, places as P, text as T
from agendry.operators import geo, graph, merge as M, pairs as R
from agendry.plans import agenda as A, catalog as K
from agendry.sources import extract as X

ROWS = "id long, title string, start_at long, end_at long, venue string, city string, sources array<string>, item_key string"


def plan_of(spark, rows):
    """(keepers, absorbed) of rows that are one component."""
    full = [(*r, *[None] * (8 - len(r))) for r in rows]
    df = spark.createDataFrame(full, ROWS)
    trust = F.coalesce(F.array_min(F.transform(F.coalesce("sources", F.array().cast("array<string>")), P.trust)), F.lit(len(C.TRUST)))
    out = M.plan(df.select("id", F.lit(1).alias("component"), T.norm_title(F.col("title")).alias("norm"), "start_at", "end_at", "item_key", trust.alias("trust"))).collect()
    return sorted(r.id for r in out if r.id == r.keeper_id), {r.id: r.keeper_id for r in out if r.id != r.keeper_id}, {r.id: r.new_end for r in out if r.new_end}


def row(i, start, *sources, title="Show", end=None, item=None):
    return (i, title, start, end, None, None, list(sources), item)


def test_shifted_twin_folds_into_the_trusted_row(spark):
    assert plan_of(spark, [row(19, 1789158600, "leiriagenda"), row(226, 1789155000, "viralagenda")])[:2] == ([19], {226: 19})


def test_double_header_keeps_both(spark):
    rows = [row(9, 1789010400, "leiriagenda"), row(13, 1789015800, "leiriagenda"), row(225, 1789006800, "viralagenda")]
    assert plan_of(spark, rows)[:2] == ([9, 13], {225: 9})


def test_nearest_session(spark):
    rows = [row(1, 1000, "leiriagenda"), row(2, 9000, "leiriagenda"), row(3, 1200, "bol"), row(4, 8800, "bol")]
    assert plan_of(spark, rows)[:2] == ([1, 2], {3: 1, 4: 2})


def test_row_without_source_is_least_trusted(spark):
    assert plan_of(spark, [row(3, 1000), row(4, 1000, "shotgun")])[:2] == ([4], {3: 4})


@pytest.mark.parametrize("gap, keepers", [(3600, [1]), (3601, [1, 2]), (5400, [1, 2])])
def test_window_edge(spark, gap, keepers):
    assert plan_of(spark, [row(1, 1000, "bol"), row(2, 1000 + gap, "bol")])[0] == keepers


def test_anchors_are_not_gaps(spark):
    df = spark.createDataFrame([("x", t) for t in (1000, 4600, 4601, 8201, 8202)], "component string, start_at long")
    assert sorted(r.anchor for r in M.session_anchors(df).collect()) == [1000, 4601, 8202]


def test_span_covers_its_days(spark):
    rows = [row(603, 0, "viralagenda", end=3 * C.DAY), row(865, C.DAY, "leiriagenda")]
    assert plan_of(spark, rows)[:2] == ([603], {865: 603})


def test_one_item_widens_its_run(spark):
    rows = [row(865 + i, i * C.DAY, "municipal", title=f"Day {i}", item="m:1", end=i * C.DAY + 60) for i in range(3)]
    assert plan_of(spark, rows) == ([865], {866: 865, 867: 865}, {865: 2 * C.DAY + 60})


def test_wordings_take_the_most_trusted_row(spark):
    rows = [row(408, 100, "leiriagenda", title="Festas de São Silvestre"), row(549, 50, "viralagenda", title="Festas de São Silvestre - Pousos")]
    assert plan_of(spark, rows)[:2] == ([408], {549: 408})


def components(spark, rows):
    """rows: (id, title, start, end, venue, city)"""
    df = spark.createDataFrame([(*r, None) for r in rows], "id long, title string, start_at long, end_at long, venue string, city string, item_key string")
    found = {}
    for r in R.event_components(R.event_facts(df)).collect():
        found.setdefault(r.component, set()).add(r.id)
    return sorted(map(sorted, found.values()))


def test_venue_naming_joins(spark):
    rows = [(1, "Jazz", 1000, None, "BLACK BOX", "Leiria"), (2, "Jazz", 1000, None, "Black Box - Plataforma de Criação Artística de Leiria", "Leiria")]
    assert components(spark, rows) == [[1, 2]]


def test_two_halls_stay_apart(spark):
    rows = [(1, "Jazz", 1000, None, "Teatro Stephens", "Marinha Grande"), (2, "Jazz", 1000, None, "Auditório Resinagem", "Marinha Grande")]
    assert components(spark, rows) == [[1], [2]]


def test_vague_pair_and_bridge(spark):
    assert components(spark, [(1, "Jazz", 1000, None, "Vários Espaços Culturais", "Leiria"), (2, "Jazz", 1000, None, "Leiria (cidade)", "Leiria")]) == [[1, 2]]
    bridge = [(1, "Jazz", 1000, None, "Leiria", "Leiria"), (2, "Jazz", 1000, None, "Capela Ortigosa Nova", "Ortigosa"), (3, "Jazz", 1000, None, "Salão Milagres Alto", "Milagres")]
    assert components(spark, bridge) == [[1, 2, 3]]


def test_title_variant_and_sub_event(spark):
    same = [(1, "Festas de São Silvestre", 1000, None, "Largo Pousos", "Leiria"), (2, "Festas de São Silvestre - Pousos", 1000, None, "Largo Pousos", "Leiria")]
    assert components(spark, same) == [[1, 2]]
    sub = [(1, "Festival Surfaces", 1000, None, "Parque Verde", "Leiria"), (2, "Neon Run - Festival Surfaces", 1000, None, "Parque Verde", "Leiria")]
    assert components(spark, sub) == [[1], [2]]


def test_adjacent_days_stay_apart(spark):
    rows = [(1, "Jazz", 1000, None, "Black Box", "Leiria"), (2, "Jazz", 1000 + C.DAY, None, "Black Box", "Leiria")]
    assert components(spark, rows) == [[1], [2]]


def test_variant_edges_equal_all_pairs_whatever_the_order(spark):
    titles = ["Jazz", "Jazz em Pousos", "Noite de Jazz Pousos", "Fado", "Fado Leiria", "Jazz Leiria"]
    places = [("Largo Pousos", "Leiria"), ("Leiria", "Leiria"), (None, None), ("Black Box", "Leiria"), ("Pousos", "Pousos")]
    rows = [(i, titles[i % 6], 1000 + i * 7000, 1000 + i * 9000 if i % 3 else None, *places[i % 5], None) for i in range(40)]
    schema = "id long, title string, start_at long, end_at long, venue string, city string, item_key string"
    a = R.variant_edges(R.event_facts(spark.createDataFrame(rows, schema))).collect()
    b = R.variant_edges(R.event_facts(spark.createDataFrame(rows[::-1], schema))).collect()
    assert set(a) == set(b) and a


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(200, 260)] + [(300, 300)] + [(None, 4)]
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {found[i] for i in range(61)} == {0} and {found[i] for i in range(200, 260)} == {100} and found[300] == 300 and len(found) == 61 + 61 + 1
    assert graph.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_normalisers(spark):
    v = lambda fn, s: value(spark, fn(F.lit(s)))
    assert v(T.norm_title, "  Óbidos: VILA-Natal! ") == "obidos vila natal"
    assert v(T.slugify, "D'Orfeu & \"Amigos\" · São João") == "dorfeu-amigos-sao-joao"
    assert v(T.norm_place, "Caldas--da_Rainha ") == "caldas da rainha"
    assert v(T.decode_entities, "a&amp;lt; &#x41;&#66;<!-- x -->&eacute;&nope;&#0;") == "a&lt; ABé&nope;&#0;"
    assert v(T.plain_text, "<p>Olá , ( mundo )</p>") == "Olá, (mundo)"
    assert v(T.title_venue, "Baleia @ O Pica Miolos") == "O Pica Miolos" and v(T.title_venue, "@ x") is None
    assert value(spark, T.venue_tokens(F.lit("Centro Cultural Gonçalves Sapinho"), F.lit("Benedita"))) == ["goncalves", "sapinho"]
    assert value(spark, T.is_vague(F.lit("Óbidos (vila)"), F.lit("Óbidos"))) is True
    assert v(T.norm_city, "Leiria e arredores") == "leiria"


def test_dates(spark):
    v = lambda fn, s: value(spark, fn(F.lit(s)))
    assert v(D.long_date, "Sábado, 19 setembro 2026 at 18:30") == 1789839000
    assert v(D.iso_epoch, "2026-09-19T18:30:00Z") == 1789842600 and v(D.iso_epoch, "2026-09-19T18:30") == 1789839000
    assert v(D.long_date, "29 de fevereiro de 2023") is None
    assert value(spark, D.lisbon_minute(F.lit(1789839000))) == "2026-09-19 18:30"


def test_places(spark):
    cities = ["Pousos", "Oleiros", "N/D", "Leira", "Caldas-da-Rainha", None]
    df = P.with_municipality(spark.createDataFrame([(i, c) for i, c in enumerate(cities)], "id int, city string"), "city").withColumn("ok", P.in_district(F.col("city")))
    got = {r.id: (r.municipality, r.ok) for r in df.collect()}
    assert got == {0: ("Leiria", True), 1: (None, False), 2: (None, False), 3: ("Leiria", True), 4: ("Caldas da Rainha", True), 5: (None, False)}
    assert value(spark, P.record_scope(F.lit("Marinha Grande, Marinha Grande"))) == "concelho" and value(spark, P.record_scope(F.lit("Vieira de Leiria"))) == "lugar"
    assert value(spark, P.title_place(F.lit("Caldas da Rainha Ladies Open"))) == "Caldas da Rainha" and value(spark, P.title_place(F.lit("Marquês de Pombal"))) is None


def test_geometry(spark):
    from agendry.bound.catalogue import shapes

    pts = [(1, -8.98, 39.05), (2, -8.85, 39.2), (3, -8.65, 39.1), (4, 0.0, 0.0), (5, None, None)]
    got = {r.id: r.shape for r in geo.locate(spark.createDataFrame(pts, "id long, x double, y double"), shapes(spark)).collect()}
    assert got == {1: "holed", 2: "wide", 3: "double", 4: None, 5: None}


def test_sessions_merge_in_a_day(spark):
    rows = [(1, "Cine", 7, 1788622200), (2, "CINE!", 7, 1788629400), (3, "Cine", 7, 1788640200), (4, "Cine", 7, 1788715800), (5, "Cine", None, 1788622200)]
    merged = A.merge_sessions(spark.createDataFrame(rows, "id long, title string, venue_id long, start_at long")).collect()
    assert sorted((r.id, r.session_starts) for r in merged) == [(1, [1788622200, 1788629400, 1788640200]), (4, [1788715800]), (5, [1788622200])]


def test_options_are_checked(spark):
    df = spark.createDataFrame([(1, 1)], "id long, start_at long")
    for bad in ({"limit": 0}, {"limit": 2001}, {"offset": -1}):
        with pytest.raises(ValueError):
            A.page(df, **bad)


def test_lifecycle_boundary(spark):
    df = spark.createDataFrame([(1, 100, None, None), (2, 99, None, None), (3, 99, 100, None), (4, 1, None, "TBA"), (5, None, None, None)], "id int, start_at long, end_at long, date_text string")
    got = {r.id: r.x for r in df.select("id", K.is_expired(F.col("start_at"), F.col("end_at"), F.col("date_text"), 100).alias("x")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False, 5: False}


def test_second_upsert_changes_nothing(spark):
    from agendry.bound.catalogue import PAST, old_catalogue

    from helpers import SF

    old = old_catalogue(spark, SF)
    again = old.select(F.col("id").alias("ordinal"), "title", "venue", "source", "slug", "start_at", "end_at", "categories", "url")
    assert {r.action for r in K.upsert(again, old, PAST).select("action").distinct().collect()} <= {"unchanged", "skipped_past"}


def test_balanced_object():
    assert X.balanced('x = 1; W = {"a": "}\\"{", "b": {}}; z', "W") == '{"a": "}\\"{", "b": {}}'
    assert X.balanced("W = {", "W") is None and X.balanced(None, "W") is None


def test_item_lists_are_bounded(spark):
    from agendry.bound import extraction

    n = 3 * extraction.LISTED
    rows = spark.range(n).select("id", F.lit("t").alias("title"), F.lit(0).cast("bigint").alias("start_at"), F.lit("u").alias("url"))
    sizes = [r.n for r in extraction.item_lists(rows).select(F.size(F.from_json("payload", "array<struct<id:bigint>>")).alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) <= extraction.LISTED


def test_variant_links_join_what_all_variant_pairs_join(spark):
    from agendry.runtime import cut

    titles = ["Jazz", "Jazz em Pousos", "Noite de Jazz Pousos", "Jazz Leiria", "Jazz Ordem", "Jazz azul"]
    places = [("Largo Pousos", "Leiria"), ("Leiria", "Leiria"), (None, None), ("Sala Azul", "Ordem"), ("Leiria", ""), ("Pousos", "Pousos"), ("Sala Azul", "")]
    rows = [(i, titles[i * 5 % 6], 1000 + i * 2100, 1000 + i * 2500 if i % 3 else None, *places[i * 3 % 7], None) for i in range(90)]
    # A vague row whose one word is its own comes with a specific one without a city; and many rows of one day are one run.
    rows += [(200, "Fado", 1000, None, "Leiria", None, None), (201, "Fado Leiria", 1000, None, "Sala Azul", None, None)]
    rows += [(1000 + i, "Circo" if i % 2 else "Circo Leiria", 1000 + i, None, "Leiria", "Leiria", None) for i in range(100)]
    facts = cut(R.event_facts(spark.createDataFrame(rows, "id long, title string, start_at long, end_at long, venue string, city string, item_key string")))
    day, links, pairs = ([tuple(r) for r in edges(facts).collect()] for edges in (R.day_edges, R.variant_links, R.variant_edges))

    def joined(edges):
        least = {r[0]: r[0] for r in rows}
        while moved := [(x, y) for a, b in edges for x, y in ((a, b), (b, a)) if least[x] < least[y]]:
            for x, y in moved:
                least[y] = min(least[x], least[y])
        return least

    assert joined(day + links) == joined(day + pairs)
    assert len(pairs) == len(set(pairs)) and (200, 201) in pairs
    circus = lambda edges: sum(a >= 1000 for a, _ in edges)
    assert circus(pairs) == 50 * 50 and circus(links) == 1


def test_copies_of_a_venue_add_no_links(spark, monkeypatch):
    """Components link classes alone, so the links do not grow with the copies of a venue; vague ones stand alone."""
    from agendry.operators import pairs as R

    linked, whole = [], R.connected_components
    monkeypatch.setattr(R, "connected_components", lambda edges: linked.append(edges.count()) or whole(edges))
    names = ["Teatro Miguel Franco", "Teatro Miguel Franco Grande", "Leiria"]
    venues = spark.createDataFrame([(i, names[i % 3], "Leiria") for i in range(60)], "id long, name string, city string")
    got = {r.id: r.component for r in R.venue_components(R.venue_facts(venues)).collect()}
    assert got == {i: i if i % 3 == 2 else 0 for i in range(60)} and linked == [1]


def test_venue_facts_are_found_by_many_tasks(spark):
    from helpers import SF

    from agendry.bound.entities import venue_facts

    assert venue_facts(spark, SF).rdd.getNumPartitions() > 1


def test_pages_are_made_after_slugs_are_unique(spark, monkeypatch, tmp_path):
    """Narrow events, not whole pages, are moved and sorted, and by more tasks than the table has pieces."""
    from agendry.plans import export as E

    made = {}
    monkeypatch.setattr(E, "publish", lambda tables, *_: made.update(tables))
    events = spark.createDataFrame([(f"e{i}", "T", "D", 1_700_000_000, None, None, "V", "C", 1) for i in range(9)], "slug string, title string, description string, start_at long, end_at long, date_text string, venue string, city string, updated_at long").coalesce(1)
    E.export(events, "<head><title></title><meta name=\"description\" content=\"\"></head>", "https://example.org", "Agenda", str(tmp_path))
    plan = made["pages"]._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate [slug" in plan and plan.index("AS html") < plan.index("Deduplicate") and made["pages"].count() == 9


def test_batches_and_catalogues_are_made_by_many_tasks(spark):
    from helpers import SF

    from agendry.bound.catalogue import old_catalogue, raw_batch

    for rows in (old_catalogue, raw_batch):
        assert "RepartitionByExpression [id" in rows(spark, SF)._jdf.queryExecution().analyzed().toString()


def test_texts_without_markup_take_the_short_way_to_the_same_text(spark):
    """What the guards let through unchanged is what the whole rules give; before there was one way, eight passes for any text."""
    texts = ["", " a  b ", "a b", "a ,b", "( a", "a\tb", "a b", "é ç", "<b>a</b>", "&amp;amp; &nope; &#233;&#x1F483; &", "a & b; &lt;i&gt;", "x<!-- & -->y", "a (b) [c], d!", "&&amp;&amp", "\n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", T.plain_text(df.t).alias("p"), T._plain(df.t).alias("q"), T.decode_entities(df.t).alias("d"), T._decoded(df.t, False).alias("e"), T.filled(df.t).alias("f"), (~df.t.rlike(T.UNPLAIN)).alias("short")).collect()
    assert all(r.p == r.q and r.d == r.e and r.f == (r.t or None) for r in got) and {r.t for r in got if r.short} == {"", "a b", "é ç", "a (b) [c], d!"}
    assert [r.d for r in got][9:14] == ["&amp; &nope; é💃 &", "a & b; <i>", "xy", "a (b) [c], d!", "&&&amp"]


@pytest.mark.parametrize("name", ["caldas", "cmleiriarss", "councils", "figueiro"])
def test_rows_of_pages_are_read_once_and_compiled(spark, name):
    """The generator takes a column, and no filter reads the pages again; before it held the whole rule, which Spark does not compile."""
    from agendry.sources import packs

    pages = spark.createDataFrame([(1, "u", "<item>")], "page_id long, url string, html string").repartition(3, "page_id")
    pack = packs.COUNCILS if name == "councils" else packs.PACKS[name]
    plan = packs.extract(pages, pack, C.NOW)._jdf.queryExecution().optimizedPlan()
    lines = str(plan.toString()).splitlines()
    generates = [line for line in lines if "Generate " in line]
    assert len(generates) == 1 and "posexplode(_rows" in generates[0] and not any("Filter" in line and "regexp" in line for line in lines)


def test_shared_venue_words_are_linked_in_order_of_time(spark, monkeypatch):
    """Rows of venues that share a frequent word, in forty small worlds of titles: the links join what all pairs join, and stay few."""
    from agendry.runtime import cut

    rng, hour, rows = random.Random(4), 3600, []
    places = [("Azul Norte", "Leiria"), ("Azul Sul", "Ordem"), ("Verde Azul", ""), ("Verde Praia", "Pombal"), ("Praia Norte", None), ("Largo Oeste", "Azul"), (None, None), ("Leiria", "Leiria")]
    for world in range(40):
        titles = [f"Jazz{world}", f"Jazz{world} Azul", f"Azul Jazz{world}", f"Jazz{world} Norte Azul"][: 1 + world % 4]
        for _ in range(24):
            start = rng.randrange(0, 240) * hour
            end = start + rng.choice([1, 5, 30, 100]) * hour if rng.random() < 0.8 else None
            rows.append((len(rows), rng.choice(titles), start, end, *rng.choice(places), None))
    rows += [(10_000 + i, "Circo", i % 20 * C.DAY, i % 20 * C.DAY + 3 * C.DAY, f"Azul Sala{i}", "Leiria", None) for i in range(200)]
    facts = cut(R.event_facts(spark.createDataFrame(rows, "id long, title string, start_at long, end_at long, venue string, city string, item_key string")))
    monkeypatch.setattr(R, "SHARED", 20)
    monkeypatch.setattr(R, "SLICE", 400)
    day, links, pairs = ([tuple(r) for r in edges(facts).collect()] for edges in (R.day_edges, R.variant_links, R.variant_edges))

    def joined(edges):
        least = {r[0]: r[0] for r in rows}
        while moved := [(x, y) for a, b in edges for x, y in ((a, b), (b, a)) if least[x] < least[y]]:
            for x, y in moved:
                least[y] = min(least[x], least[y])
        return least

    assert joined(day + links) == joined(day + pairs)
    circus = lambda edges: sum(a >= 10_000 for a, _ in edges)
    assert circus(pairs) > 4000 and circus(links) <= 2 * 200


def test_components_make_their_edges_once(spark):
    """The edges are made once though loops are kept, shuffle files go with each cut, and the files of earlier rounds are deleted."""
    import os

    from agendry import runtime

    made = spark.sparkContext.accumulator(0)
    edges = spark.sparkContext.parallelize([(i, i + 1) for i in range(50)] + [(90, 90), (70, 71), (70, 70)]).map(lambda e: (made.add(1), e)[1]).toDF("src long, dst long")
    got = {r.node: r.component for r in graph.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(51)} | {90: 90, 70: 70, 71: 70} and made.value == 53
    one = runtime.cut(spark.range(10).repartition(3))
    file = one._jdf.queryExecution().logical().rdd().getCheckpointFile().get().removeprefix("file:")
    assert spark.conf.get(runtime.CLEANUP, "false") == "false" and os.path.isdir(file)
    runtime.forget(one)
    assert not os.path.exists(file)
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: sum(f.getName().startswith("shuffle_") for f in list(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(folders.getAllFiles())))
    before = shuffles()
    runtime.cut(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count())
    assert shuffles() <= before
