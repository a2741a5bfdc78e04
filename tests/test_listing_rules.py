"""Rules of single listings, ingests and streams on literal rows."""

from __future__ import annotations

import pytest
from helpers import SF
from pyspark.sql import functions as F

from agendry import constants as C, queries as core
from agendry.functions import dates as D, places as P, text as T
from agendry.plans import agenda as A, ingest as I
from agendry.sources import extract as X, packs
from agendry.streaming import jobs as J

REF = 1788300000  # 2026-09-01


def at(spark, rule, *texts):
    """What a rule gives for each text, in order."""
    rows = [(i, x) for i, x in enumerate(texts)]
    got = spark.createDataFrame(rows, "i int, x string").select("i", rule(F.col("x")).alias("v")).collect()
    return [r.v for r in sorted(got)]


def lisbon(y, m, d, h=0, mi=0):
    import datetime
    import zoneinfo

    return int(datetime.datetime(y, m, d, h, mi, tzinfo=zoneinfo.ZoneInfo("Europe/Lisbon")).timestamp())



def test_prose_venues(spark):
    cases = {
        "📌Auditório do Estádio Dr. Magalhães Pessoa (porta 7) Inscrição gratuita": "Auditório do Estádio Dr. Magalhães Pessoa (porta 7)",
        "Conferência às 15h Local: Teatro Miguel Franco": "Teatro Miguel Franco",
        "Sessão aberta com horário a confirmar": "CM Leiria",
        "📍 Mercado Sant'Ana... das 10 às 12": "Mercado Sant'Ana",
        "📍 a confirmar\nLOCAL — Black Box, Leiria": "Black Box",
        "o local a definir": "CM Leiria",
        "Local: A Anunciar": "CM Leiria",
    }
    assert at(spark, lambda x: T.prose_venue(x), *cases) == list(cases.values())


def test_venue_names(spark):
    assert at(spark, lambda x: T.pick_venue(F.lit("Nazaré"), x, F.lit("Teatro")), None, "", " Evento ", "LOCAL  a definir", "n/a", "--", "Sala  1") == ["Teatro"] * 6 + ["Sala 1"]
    assert at(spark, lambda x: T.pick_venue(F.lit("Nazaré"), x), "sem local") == ["Nazaré"]
    assert at(spark, lambda x: T.usable_venue(x), "Portugal", " PT ", "", None, "Casa de Portugal") == [None, None, None, None, "Casa de Portugal"]
    pairs = [("museu-vidro-marinha-grande", "Museu do Vidro - Marinha Grande", True), ("agenda-obidos", "Agenda Cultural Óbidos", True), ("cm-mgrande-eventos", "Câmara Municipal da Marinha Grande - Agenda", True), ("teatro-stephens", "Biblioteca Municipal", False), ("", "Sala", False)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, slug string, venue string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", T.is_feed_venue(F.col("slug"), F.col("venue")).alias("got")).collect())


def test_categories_of_listings(spark):
    assert at(spark, lambda x: P.fair_category(x), "Feira dos Enchidos 2026", "Mercado Barroco 2026", "Festival de Folclore 2026", "Festas da Vila 2026", "A Feira") == ["Mercados e Feiras", "Mercados e Feiras", "Festivais", "Tradição", "Tradição"]
    titles = ("Exposição Coletiva", "FOLIO – Festival Literário", "Mercado Medieval de Óbidos", "Festa das Gaeiras", "ATELIÊ DE RISCADORES", "Concerto")
    assert at(spark, lambda x: P.town_category(x), *titles) == ["Exposições", "Festivais", "Mercados e Feiras", "Tradição", "Oficinas", "Outros"]
    assert at(spark, lambda x: P.genre_categories(x), "rock-pop", "literatura", "conferencia", "exposicao", "eletronica", "outro", "", "surf-de-camarao") == [["Concertos"], ["Literatura"], ["Conferências"], ["Museus & Exposições"], ["Clubbing"], ["Outros"], [], []]
    assert at(spark, lambda x: P.kind_category(x), "Festas de verão", "rota Oxigenio", "outro") == ["Festas", "Atividades ao Ar Livre", "Agenda"]


def test_chip_dates(spark):
    got = at(spark, lambda x: D.chip_dates(x), "29.02.23", 'class="dia">29<span class="mes_curto">fev<span class="ano">23', "29.02.24", "29.02.23 2026/10/04", '<i class="dia">11</i><i class="mes">Set</i>', '<i class=dia>05</i><i class="mes_extenso">Setembro</i> a <i class=dia>05</i><i class="mes_extenso">Dezembro</i><i class="ano">2026</i>', "1.2.70 1.2.69")
    assert [(r.earliest, r.latest) for r in got] == [
        (None, None), (None, None), (lisbon(2024, 2, 29),) * 2, (lisbon(2026, 10, 4),) * 2, (None, None), (lisbon(2026, 9, 5), lisbon(2026, 12, 5)), (lisbon(1970, 2, 1), lisbon(2069, 2, 1)),
    ]


def test_ranges_and_spans(spark):
    got = at(spark, lambda x: D.date_range(x), "13 de Junho, 2026", "8 de Outubro, 2026 - 18 de Outubro, 2026", "27 de Novembro, 2026 – 3 de Janeiro, 2027", "4 de Março, 2026", "A definir", "5 e 6 de Junho", "31 de Junho, 2026")
    assert [(r and (r.start, r.end)) for r in got] == [("2026-06-13", "2026-06-13"), ("2026-10-08", "2026-10-18"), ("2026-11-27", "2027-01-03"), ("2026-03-04", "2026-03-04"), None, None, None]
    got = at(spark, lambda x: D.day_span(x), "4 a 7 de Setembro", "22 de Agosto", "dias 5 e 6", "de 5 e 6 de março", "4 de Jantar")
    assert [(r and (r.first, r.last, r.month)) for r in got] == [(4, 7, 9), (22, 22, 8), None, (5, 6, 3), None]


@pytest.mark.parametrize("now, text, want", [
    ((2026, 9, 5, 12), "4 a 7 de Setembro", ((2026, 9, 4), (2026, 9, 7, 23, 59))), ((2026, 9, 5, 12), "22 de Agosto", None), ((2026, 10, 15, 12), "22 de Agosto", None),
    ((2026, 12, 15, 12), "4 a 7 de Setembro", None), ((2026, 12, 15, 12), "6 de Janeiro", ((2027, 1, 6), (2027, 1, 6, 23, 59))), ((2026, 12, 15, 12), "31 de Junho", None),
])
def test_years_are_inferred(spark, now, text, want):
    (got,) = at(spark, lambda x: D.infer_epochs(D.day_span(x), lisbon(*now)), text)
    assert (got and (got.start, got.end)) == (want and (lisbon(*want[0]), lisbon(*want[1])))


def test_dates_in_prose(spark):
    cases = {
        "A atividade física na redução do risco de quedas. 1 fevereiro às 14h30": (lisbon(2027, 2, 1, 14, 30), True),
        "21 de janeiro às 21h30": (lisbon(2027, 1, 21, 21, 30), True),
        "dias 1 e 2 de março às 18h00": (lisbon(2027, 3, 1, 18), True),
        "12/03/2026 às 20h00": (lisbon(2026, 3, 12, 20), True),
        "12 mar 2026": (lisbon(2026, 3, 12), False),
        "Em memória de 13 de novembro de 2015: 5 de outubro às 18h": (lisbon(2026, 10, 5, 18), True),
        "De 1 de maio de 1974 até 3 de outubro de 2026": (lisbon(2026, 10, 3), False),
        "Sessão aberta à comunidade para partilhar ideias.": None,
    }
    got = at(spark, lambda x: D.free_date(x, F.lit(REF)), *cases)
    assert [(r and (r.at, r.has_time)) for r in got] == list(cases.values())
    assert at(spark, lambda x: D.date_sentence(x), "Olá. — Em setembro, no jardim! Fim", "Sem mês", "março " + "a" * 200) == ["Em setembro, no jardim", None, ("março " + "a" * 200)[:120]]


def test_clocks(spark):
    assert at(spark, lambda x: D.strict_clock(x), "2026-09-05 21:30:00", "", None, "amanhã", "2026-02-30 10:00") == [lisbon(2026, 9, 5, 21, 30), None, None, None, None]
    assert at(spark, lambda x: D.is_placeholder_time(x), "N/D", "T00:59", " ", "21:30") == [True, True, True, False]
    assert at(spark, lambda x: D.start_of_day(F.lit(lisbon(2026, 7, 1, 0, 30))), "a") == [lisbon(2026, 7, 1)]
    assert at(spark, lambda x: X.rfc_epoch(x), "Wed, 02 Sep 2026 10:00:00 +0100", "02 Sep 2026 10:00:00 GMT", "soon") == [1788339600, 1788343200, None]
    assert at(spark, lambda x: X.repair_pairs(x), "a &#55357;&#56525; &#55357; &#233;") == ["a 📍 &#55357; &#233;"]
    assert at(spark, lambda x: D.run_label(F.lit(lisbon(2026, 9, 1, 7)), lisbon(2026, 9, 2, 0, 30)), "a") == ["ontem, 07:00"]


def test_tail_cities(spark):
    got = at(spark, lambda x: P.tail_city(x, "Óbidos"), "A definir", None, "Largo de São Marcos, Gaeiras", "Adro, Amoreira", "Amoreira, Óbidos", "Teatro, Lisboa", "Óbidos")
    assert [r.city for r in got] == ["Óbidos", "Óbidos", "Gaeiras", "Óbidos", "Óbidos", "Lisboa", "Óbidos"] and got[0].venue == got[1].venue == "Óbidos" and got[3].venue == "Adro, Amoreira"


def test_scope_order(spark):
    rows = [("Baleia @ O Pica Miolos", "Coimbra", "Portugal"), ("Festa em Peniche", "Lisboa", ""), ("Festa em Peniche", "", ""), ("Concerto", "Vau", "Sala"), ("Concerto", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, city string, venue string")
    got = sorted(df.select("i", P.resolve_scope(F.col("title"), F.col("title"), F.col("city"), F.col("venue")).alias("r")).collect())
    assert [(g.r.in_scope, g.r.city, g.r.venue) for g in got] == [(True, "Leiria", "O Pica Miolos"), (False, None, None), (True, "Peniche", None), (True, "Vau", "Sala"), (False, None, None)]


def test_feed_pack(spark):
    body = "<rss><item><title>Dança &amp;amp; Música</title><link>https://example.org/a/dança-1</link><category>Evento</category><category>Dança</category><description>&lt;p&gt;Dia 25 de janeiro &amp;agrave;s 18h30 📍 Teatro Miguel Franco&lt;/p&gt;</description><pubDate>Tue, 01 Sep 2026 09:00:00 GMT</pubDate></item><item><title>x</title></item></rss>"
    pages = spark.createDataFrame([(1, "u", body), (2, "u", None), (3, "u", ""), (4, None, "<rss>")], "page_id long, url string, html string")
    (r,) = packs.extract(pages, packs.PACKS["cmleiriarss"], REF).collect()
    assert (r.title, r.slug, r.startAt, r.venueName, r.categories, r.drop_reason) == ("Dança & Música", "dança-1", lisbon(2027, 1, 25, 18, 30), "Teatro Miguel Franco", ["Dança"], None)


@pytest.mark.parametrize("source", sorted(packs.PACKS))
def test_packs_on_odd_pages(spark, source):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>no card</p>"), (4, "u", "<article")], "page_id long, url string, html string")
    rows = packs.extract(pages, packs.PACKS[source], REF).collect()
    assert all(r.drop_reason == "untitled" for r in rows)
    assert packs.extract(pages.limit(0), packs.PACKS[source], REF).count() == 0


@pytest.mark.parametrize("name, key", [("pack_regiaoleiria", "place"), ("pack_turismodocentro", "county")])
def test_rows_are_not_dealt_by_a_roster(spark, name, key):
    """A handful of places or counties would send all rows to as many tasks."""
    plan = core.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f"hashpartitioning({key}#" not in plan and "BroadcastExchange" in plan


def test_lists(spark):
    assert A.repaired({"from": 5, "to": 3, "city": "x"}) == {"to": 3, "city": "x"} and A.repaired({"from": 3, "to": 5}) == {"from": 3, "to": 5} and A.repaired({"from": 5, "to": ""}) == {"from": 5, "to": ""}
    rows = spark.createDataFrame([("Leiria",), ("Vau",), ("",), (None,), ("Lisboa",), ("óbidos",)], "city string")
    got = [tuple(r) for r in A.tally_concelhos(rows, "city").orderBy("ord").collect()]
    assert got == [("Óbidos", 2, True, 1), ("Leiria", 1, True, 2), ("Lisboa", 1, False, 3), ("Sem concelho", 2, False, 4)]


EVENTS = "id long, title string, start_at long, end_at long, venue_id long, venue string, city string, url string, categories array<string>, date_text string, fingerprint string"
BATCH = "ordinal long, title string, venue string, city string, source string, slug string, start_at long, end_at long, date_text string, categories array<string>, url string"


def empty_catalogue(spark):
    return {"venues": spark.createDataFrame([], "id long, name string, slug string, city string"), "events": spark.createDataFrame([], EVENTS), "sources": spark.createDataFrame([], "event_id long, source string, source_event_id string")}


def raw(i, title="Show", venue="Teatro José Lúcio", start=2000, **more):
    row = {"ordinal": i, "title": title, "venue": venue, "city": "Leiria", "source": "bol", "slug": f"s{i}", "start_at": start, "end_at": None, "date_text": None, "categories": ["Música"], "url": None} | more
    return tuple(row[c.split()[0]] for c in BATCH.split(", "))


def test_cycle_writes_then_completes(spark):
    first = spark.createDataFrame([raw(1), raw(2, title="Later", start=None, date_text="em breve"), raw(3, title="Over", start=10), raw(4, title="!!", venue="")], BATCH)
    one = I.cycle(first, empty_catalogue(spark), 1000, "bol")
    events = {r.title: r for r in one["events"].collect()}
    assert set(events) == {"Show", "Later", "!!"} and events["Later"].start_at == 1000 and events["Later"].date_text == "em breve"
    run = one["run"].first()
    assert (run.items_found, run.items_new, run.items_skipped, run.items_purged, run.error) == (4, 3, 1, 0, None)
    assert {r.slug for r in one["venues"].collect()} == {"teatro-jose-lucio", "venue-desconhecido"}
    second = spark.createDataFrame([raw(1, source="shotgun", slug="z", end_at=9000, url="u", categories=["Teatro"]), raw(2, title="Later", start=5000, slug="s2"), raw(5, title="Show", start=2400, slug="s1")], BATCH)
    two = I.cycle(second, one, 1000, "bol")
    rows = {r.title: r for r in two["events"].collect()}
    assert set(rows) == {"Show", "Later", "!!"} and two["events"].count() == 3
    assert rows["Show"].id == events["Show"].id and (rows["Show"].end_at, rows["Show"].url, rows["Show"].categories) == (9000, "u", ["Música", "Teatro"])
    assert rows["Later"].date_text is None and rows["Later"].start_at == 5000
    assert sorted(tuple(r) for r in two["sources"].where(f"event_id = {rows['Show'].id}").collect()) == [(rows["Show"].id, "bol", "s1"), (rows["Show"].id, "shotgun", "z")]
    again = I.cycle(second, two, 1000, "bol")
    assert sorted(map(str, again["events"].collect())) == sorted(map(str, two["events"].collect())) and again["run"].first().items_new == 0


def test_failing_steps_are_recorded(spark):
    def broken(_):
        raise ValueError("no disk")

    done = I.cycle(spark.createDataFrame([raw(1), raw(2, start=500)], BATCH), empty_catalogue(spark), 100, "bol", failed=2, steps={"fuse": broken, "purge": broken})
    run = done["run"].first()
    assert run.error == "purge failed: no disk" and (run.items_found, run.items_failed, run.items_new) == (4, 2, 2)
    assert done["events"].count() == 1  # reconciliation still ran: two starts of one title within the session window


def test_a_failed_cycle_is_no_result(spark, monkeypatch):
    """Neither query gives a catalogue of which a step failed, a failed micro-batch is not taken as done, and engine errors are raised at once."""

    def broken(*_, **__):
        raise ValueError("no rules")

    def engine(*_, **__):
        return spark.range(1).select(F.raise_error(F.lit("lost executor")).alias("id")).collect()

    batch = spark.createDataFrame([raw(1)], BATCH)
    with pytest.raises(Exception, match="lost executor"):
        I.cycle(batch, empty_catalogue(spark), 100, "bol", steps={"fuse": engine})
    monkeypatch.setattr(I, "fuse_venues", broken)
    assert I.cycle(batch, empty_catalogue(spark), 100, "bol")["run"].first().error == "fuse failed: no rules"
    with pytest.raises(RuntimeError, match="fuse failed: no rules"):
        I.whole(I.cycle(batch, empty_catalogue(spark), 100, "bol"))
    with pytest.raises(Exception, match="fuse failed: no rules"):
        core.queries()["ingest_cycle"](spark, SF)
    import uuid

    name, path = uuid.uuid4().hex, f"{J.home_of(spark, None)}/raw"
    batch.write.parquet(path)
    with pytest.raises(Exception, match="fuse failed: no rules"):
        J.ingest(J.source(spark, path), lambda rows: rows, empty_catalogue(spark), 100, name=name)
    assert J.versions(spark, f"{J.home_of(spark, name)}/events") == []
    monkeypatch.undo()
    assert J.ingest(J.source(spark, path), lambda rows: rows, empty_catalogue(spark), 100, name=name)["events"].count() == 1


def test_reconciliation_settles(spark):
    rows = core.queries()["reconcile_twice"](spark, SF).collect()
    assert {r.run: r.absorbed for r in rows}[2] == 0 and rows[0].absorbed > 0


def test_venues_meet_in_their_city(spark):
    old = spark.createDataFrame([(1, "Black Box", "black-box", "Leiria"), (2, "Teatro", "teatro", "Pombal")], "id long, name string, slug string, city string")
    named = [(1, "BLACK BOX", "Leiria"), (2, "Black Box - Plataforma", "Leiria"), (3, "Black Box Plataforma", "Pombal"), (4, "Plataforma Black Box Sul", "Pombal"), (5, "Leiria", "Leiria"), (6, None, None), (7, "!!", "Leiria"), (8, "teatro", "Óbidos")]
    ids, venues = I.resolve_venues(spark.createDataFrame(named, "ordinal long, venue string, city string"), old)
    got = {r.ordinal: r.venue_id for r in ids.collect()}
    assert got[1] == got[2] == 1 and got[3] == got[4] > 2 and got[5] not in (1, 2, None) and got[6] == got[7] and got[8] == 2
    assert venues.where(F.col("id") == got[6]).first().slug == I.NO_SLUG and {r.id for r in venues.collect()} == {1, 2, got[3], got[5], got[6]}


def test_named_streams_resume(spark, tmp_path):
    import uuid

    path, name = str(tmp_path / "in.parquet"), uuid.uuid4().hex
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, k string")
    one.write.mode("append").parquet(path)
    run = lambda: J.drain(J.source(spark, path), "append", J.upsert_first(["k"], "id"), name=name)
    assert sorted(tuple(r) for r in run().collect()) == [("a", 1), ("b", 2)]
    spark.createDataFrame([(0, "a"), (9, "b"), (3, "c")], "id long, k string").write.mode("append").parquet(path)
    assert sorted(tuple(r) for r in run().collect()) == [("a", 0), ("b", 2), ("c", 3)]
    out = f"{J.home_of(spark, name)}/out"
    assert J.versions(spark, out) == [0, 1]
    # A version without its mark was cut off and does not count.
    (spark._jvm.org.apache.hadoop.fs.Path(f"{out}/v=7").getFileSystem(spark._jsc.hadoopConfiguration())).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/v=7"))
    assert J.versions(spark, out) == [0, 1] and run().count() == 3


def test_streamed_ingest_equals_the_batch(spark):
    streamed, whole = (core.queries()[n](spark, SF) for n in ("stream_ingest", "ingest_cycle"))
    keep = ["id", "title", "start_at", "end_at", "fingerprint"]
    assert sorted(streamed.select(keep).collect()) == sorted(whole.select(keep).collect()) and C.NOW


def test_long_rows_meet_short_ones(spark):
    """Rows of days, months, years and centuries: each overlapping pair is found, whatever the block they meet in."""
    from agendry.operators import pairs as R

    day = C.DAY
    spans = [(0, 1), (3, 40), (20, 2000), (35, 36), (100, 900_000), (1500, 1501), (5, 60_000), (2500, 2501), (40, 45)]
    rows = [(i, "Mostra", a * day, b * day, "Sala Azul", "Leiria", None) for i, (a, b) in enumerate(spans)]
    facts = R.event_facts(spark.createDataFrame(rows, "id long, title string, start_at long, end_at long, venue string, city string, item_key string"))
    got = {(r.src, r.dst) for r in R.variant_edges(facts).collect()}
    assert got == {(i, j) for i, a in enumerate(spans) for j, b in enumerate(spans) if i < j and a[0] <= b[1] and b[0] <= a[1]}
    assert R.variant_edges(facts.limit(0)).count() == 0


def test_publication_is_whole(spark, tmp_path):
    from agendry.plans import catalog as K

    folder = f"file://{tmp_path}/mirror"
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, k string")
    assert {tuple(r) for r in K.publish({"t": one, "u": one.limit(1)}, folder).collect()} == {("t", 2), ("u", 1)} and K.current_version(spark, folder) == 0
    with pytest.raises(ValueError, match="t lacks k"):
        K.publish({"t": one.drop("k")}, folder)
    with pytest.raises(ValueError, match="nothing"):
        K.publish({"t": one.limit(0)}, folder)
    assert K.current_version(spark, folder) == 0 and spark.read.parquet(f"{folder}/v=0/t").count() == 2
    K.publish({"t": one.union(one)}, folder)
    assert K.current_version(spark, folder) == 1 and spark.read.parquet(f"{folder}/v=1/t").count() == 4
