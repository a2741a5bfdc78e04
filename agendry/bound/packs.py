"""Each rule pack over pages written from the events, one page for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from agendry import constants as C, oracle as O, tables
from agendry.bound.extraction import ev as venue_rows
from agendry.bound.texts import pick
from agendry.functions import dates as D
from agendry.registry import query
from agendry.runtime import spread
from agendry.sources import extract as X, packs as K

NOW = C.NOW - 5 * C.DAY
CITIES = ("Leiria", "Lisboa", "Nazaré", "Vau")
EV = f"""pe AS (SELECT id, title || ' ' || id AS title, start_at, CAST({O.lisbon_day('start_at')} AS DATE) AS d, CAST(strftime({O.lisbon('start_at')}, '%Y-%m-%d %H:%M:00') AS TIMESTAMP) AS t, {O.arr(CITIES)}[CAST(id % 4 AS INTEGER) + 1] AS city FROM cat_events)"""
DAY, LAST = O.epoch_of("CAST(d AS TIMESTAMP)"), O.epoch_of("CAST(d AS TIMESTAMP) + INTERVAL 1439 MINUTE")
MINUTE = O.epoch_of("t")
INSIDE = "city <> 'Lisboa'"


def rows(spark, sf_dir):
    """id, title, t (Lisbon wall clock), day, y, m, d and a city in or out of the district."""
    e = spread(venue_rows(spark, sf_dir), "id")
    return e.select("id", F.concat("title", F.lit(" "), F.col("id").cast("string")).alias("title"), "start_at", "t", F.substring("t", 1, 10).alias("day"), F.substring("t", 12, 5).alias("clock"), pick(CITIES, F.col("id")).alias("city"))


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def part(i, n):
    return F.substring("day", i, n)


def month(short=False):
    names = F.element_at(F.array(*[F.lit(m) for m in C.MONTHS]), part(6, 2).cast("int"))
    return F.substring(names, 1, 3) if short else names


def number(i, n):
    return part(i, n).cast("int").cast("string")


def run(spark, sf_dir, source, html, url):
    pages = rows(spark, sf_dir).select(F.col("id").alias("page_id"), url.alias("url"), html.alias("html"))
    pack = K.PACKS[source]
    return K.extract(pages, pack, NOW).select("slug", "title", "startAt", "endAt", "venueName", "city", F.array_join("categories", "|").alias("categories"), "drop_reason")


def expected(slug, title="title", start=DAY, end=LAST, venue="city", city="city", categories="''", reason=None, where="true", last=None):
    gate = f"CASE WHEN {city} = 'Lisboa' THEN 'outOfDistrict' WHEN {last or end} < {NOW} THEN 'past' END" if reason is None else reason
    return O.sql(f'SELECT {slug} AS slug, {title} AS title, {start} AS "startAt", {end} AS "endAt", {venue} AS "venueName", {city} AS city, {categories} AS categories, {gate} AS drop_reason FROM pe WHERE {where}', EV)


ID = "CAST(id AS VARCHAR)"
SID = lambda: F.col("id").cast("string")


@query(expected(f"'cl-' || {ID}", venue="'Caldas da Rainha'", city="'Caldas da Rainha'", categories="CASE WHEN id % 2 = 0 THEN 'Feira & Festa' ELSE '' END", reason=f"CASE WHEN {LAST} + 86400 < {NOW} THEN 'past' END"))
def pack_caldas(spark, sf_dir):
    """Listing cards; one without a date and one without a link beside each whole one."""
    span = lambda cls, v: text(f'<span class="x__{cls}">', v, "</span>")
    date = lambda at: text(span(f"{at}-date__day", part(9, 2)), span(f"{at}-date__month", F.upper(month(True))), span(f"{at}-date__year", text("'", part(3, 2))))
    title = text('<h2 class="x__card-title"><span>', F.col("title"), "</span></h2>")
    kind = F.when(F.col("id") % 2 == 0, text('<p class="x__card-category">Feira &amp; Festa</p>')).otherwise("")
    end = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, span("end-date__day", part(9, 2))).otherwise(date("end"))
    card = text('<div class="events-card"><a href="/agenda/', SID(), '">', title, kind, date("start"), end, "</a></div>")
    html = text("<main>", card, '<div class="events-card"><a href="/agenda/none">', title, "</a></div>", '<div class="events-card">', title, date("start"), "</div></main>")
    return run(spark, sf_dir, "caldas", html, F.lit("https://example.org/agenda"))


@query(expected(f"'nocartaz-h' || {ID}", start=f"CASE WHEN id % 2 = 0 THEN {MINUTE} ELSE {DAY} END", end="CAST(NULL AS BIGINT)", venue="CASE WHEN id % 5 = 0 THEN city WHEN city = 'Lisboa' AND id % 3 <> 0 THEN 'Sala Grande' WHEN id % 3 = 0 THEN 'O Pica Miolos' ELSE 'Sala Grande' END",
  city="CASE WHEN city = 'Lisboa' AND (id % 3 <> 0 OR id % 5 = 0) THEN NULL WHEN city = 'Lisboa' THEN 'Leiria' ELSE city END", categories="CASE WHEN id % 2 = 0 THEN 'Concertos' ELSE '' END",
  reason=f"CASE WHEN city = 'Lisboa' AND (id % 3 <> 0 OR id % 5 = 0) THEN 'outOfDistrict' WHEN CASE WHEN id % 2 = 0 THEN {MINUTE} ELSE {DAY} END + 86400 < {NOW} THEN 'past' END").replace("CASE WHEN id % 5 = 0 THEN city WHEN", "CASE WHEN id % 5 = 0 THEN CASE WHEN city = 'Lisboa' THEN 'Agenda de Museus' ELSE city END WHEN"))
def pack_nocartaz(spark, sf_dir):
    """Hub cards with machine-readable attributes; the venue is a room, a curated room, or a feed's own name; a card stands twice."""
    k = F.col("id")
    venue = F.when(k % 5 == 0, "Agenda de Museus").when(k % 3 == 0, "O Pica Miolos").otherwise("Sala Grande")
    attrs = text(' data-id="h', SID(), '" data-date="', F.col("day"), '" data-starts-at="', F.when(k % 2 == 0, F.replace("t", F.lit(" "), F.lit("T"))).otherwise(""), '" data-genre="', F.when(k % 2 == 0, "jazz").otherwise("xadrez"), '" data-venue="salao-nobre"')
    body = text('<h3 class="t">', F.col("title"), '</h3><span class="where"><span>', venue, '</span><span class="concelho">· ', F.col("city"), "</span></span><div></div>")
    card = text('<article class="event-card wide"', attrs, ">", body, "</article>")
    html = text("<section>", card, '<article class="event-card"><h3>No id</h3></article>', card, "</section>")
    return run(spark, sf_dir, "nocartaz", html, F.lit("https://example.org/distrito/"))


@query(expected(f"'e' || {ID}", start=f"CASE WHEN id % 3 = 0 THEN {MINUTE} ELSE {DAY} END", end=f"CASE id % 3 WHEN 0 THEN {O.epoch_of('t + INTERVAL 1 DAY')} WHEN 1 THEN {LAST} ELSE {O.epoch_of('CAST(d + 1 AS TIMESTAMP) + INTERVAL 1439 MINUTE')} END"))
def pack_figueiro(spark, sf_dir):
    """Board items whose time block holds start and end, with and without clocks."""
    k, next_day = F.col("id"), F.date_add(F.col("day").cast("date"), 1)
    names = F.array(*[F.lit(m) for m in C.MONTHS])
    long = lambda d: text("Sábado, ", F.dayofmonth(d).cast("string"), " ", F.element_at(names, F.month(d)), " ", F.year(d).cast("string"))
    own, after = F.col("day").cast("date"), text('<span class="djev_time_to">')
    time = F.when(k % 3 == 0, text(long(own), " at ", F.col("clock"), after, long(next_day), " at ", F.col("clock"))).when(k % 3 == 1, long(own)).otherwise(text(long(own), after, long(next_day)))
    html = text('<div class="row djev_item x"><h2 class="djev_item_title"><a class="l" href="/details/', F.col("day"), "/e", SID(), '?x=1">', F.col("title"), '</a></h2><h4 class="djev_time">', time, '</h4><a class="djev_city" href="#">', F.col("city"), '</a></div><div class="djev_item"><h2>nothing</h2></div>')
    return run(spark, sf_dir, "figueiro", html, F.lit("https://example.org/"))


@query(expected(f"'fe-festas.festa-' || {ID}", end=f"CASE WHEN id % 3 = 0 THEN {DAY} ELSE {O.epoch_of('CAST(d + 2 AS TIMESTAMP)')} + 86399 END", venue="'Largo, ' || city", categories="'Tradição'", last=f"CASE WHEN id % 3 = 0 THEN {DAY} ELSE {O.epoch_of('CAST(d + 2 AS TIMESTAMP)')} + 86399 END"))
def pack_festasearraiais(spark, sf_dir):
    """JSON-LD in a graph beside other nodes; end dates are inclusive, a missing one is the start."""
    k = F.col("id")
    end = F.when(k % 3 == 0, "").otherwise(text(', "endDate": "', F.date_add(F.col("day").cast("date"), 2).cast("string"), '"'))
    node = text('{"@type": ["Event"], "name": "', F.col("title"), '", "startDate": "', F.col("day"), '"', end, ', "location": {"name": "Largo, ', F.col("city"), '", "address": {"addressLocality": "', F.col("city"), '"}}}')
    block = F.when(k % 2 == 0, text('{"@graph": [{"@type": "WebPage"}, ', node, "]}")).otherwise(text('[{"@type": "WebPage"}, ', node, "]"))
    html = text('<script type="application/ld+json">{broken</script><script type="application/ld+json">', block, "</script>")
    return run(spark, sf_dir, "festasearraiais", html, text("https://example.org/eventos/festas/festa-", SID(), "/"))


@query(expected(f"'sg-s' || {ID}", start="start_at // 60 * 60", end="start_at // 60 * 60 + 7200", venue="CASE WHEN id % 3 = 0 THEN 'Local a definir' ELSE 'Clube' END"))
def pack_shotgun(spark, sf_dir):
    """JSON-LD of a music event with instants in UTC."""
    utc = lambda plus: F.date_format(F.timestamp_seconds(F.floor(F.col("start_at") / 60) * 60 + plus), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    node = text('{"@type": "MusicEvent", "name": " ', F.col("title"), ' ", "startDate": "', utc(0), '", "endDate": "', utc(7200), '", "location": {"name": "', F.when(F.col("id") % 3 == 0, " ").otherwise("Clube"), '", "address": {"addressLocality": "', F.col("city"), '"}}}')
    return run(spark, sf_dir, "shotgun", text('<script type="application/ld+json">', node, "</script>"), text("https://example.org/en/events/s", SID()))


@query(expected(f"'ob-e' || {ID}", start=f"CASE WHEN id % 6 = 5 THEN NULL ELSE {DAY} END", end=f"CASE WHEN id % 6 = 5 THEN NULL ELSE {LAST} END", venue="CASE WHEN id % 7 = 0 THEN 'Óbidos' ELSE 'Igreja, ' || city END", city="CASE WHEN id % 7 = 0 THEN 'Óbidos' ELSE city END", categories="'Outros'",
  reason=f"CASE WHEN city = 'Lisboa' AND id % 7 <> 0 THEN 'outOfDistrict' WHEN id % 6 <> 5 AND {LAST} < {NOW} THEN 'past' END"))
def pack_obidos(spark, sf_dir):
    """A banner with title, date and venue; a date that cannot be read stays a text."""
    k = F.col("id")
    date = F.when(k % 6 == 5, "todo o verão").otherwise(text(number(9, 2), " de ", F.initcap(month()), ", ", part(1, 4)))
    venue = F.when(k % 7 == 0, "A definir").otherwise(text("Igreja, ", F.col("city")))
    html = text('<h2 class="banner-title">', F.col("title"), '</h2><div class="date-location"><span> ', date, "</span><span>", venue, "</span></div>")
    return run(spark, sf_dir, "obidos", html, text("https://example.org/evento/e", SID(), "/"))


HALL = f"""ha AS (SELECT *, make_timestamp(y, month(d), least(day(d), 25), 0, 0, 0) AS a, make_timestamp(y, month(d), least(day(d), 25) + 1, 23, 59, 0) AS z FROM (SELECT *, year(d) AS y FROM pe)),
hb AS (SELECT * FROM ha WHERE id % 4 <> 3), hc AS (SELECT id, title, city, 2024 AS y, month(d) AS m, least(day(d), 25) AS k FROM pe),
hd AS (SELECT *, {O.epoch_of("make_timestamp(y, m, k, 0, 0, 0)")} AS a0, {O.epoch_of("make_timestamp(y, m, k + 1, 23, 59, 0)")} AS z0, {O.epoch_of("make_timestamp(y + 1, m, k, 0, 0, 0)")} AS a1, {O.epoch_of("make_timestamp(y + 1, m, k + 1, 23, 59, 0)")} AS z1 FROM hc)"""


@query(O.sql(f"""SELECT 'cf-f' || id AS slug, title, CASE WHEN id % 5 = 4 THEN NULL WHEN z0 >= {NOW - C.DAY} THEN a0 WHEN a1 <= {NOW + 150 * C.DAY} THEN a1 END AS "startAt", CASE WHEN id % 5 = 4 THEN NULL WHEN z0 >= {NOW - C.DAY} THEN z0 WHEN a1 <= {NOW + 150 * C.DAY} THEN z1 END AS "endAt",
  city AS "venueName", city, 'Tradição' AS categories, CASE WHEN id % 5 <> 4 AND z0 < {NOW - C.DAY} AND a1 > {NOW + 150 * C.DAY} THEN 'undated' WHEN city = 'Lisboa' THEN 'outOfDistrict' WHEN id % 5 <> 4 AND z0 >= {NOW - C.DAY} AND z0 < {NOW} THEN 'past' END AS drop_reason FROM hd""", EV, HALL))
def pack_cisterfestas(spark, sf_dir):
    """Headings: a label's value is the next heading; days without a year lie in this or the next."""
    k, day = F.col("id"), F.least(part(9, 2).cast("int"), F.lit(25))
    date = F.when(k % 5 == 4, "dias 5 e 6").otherwise(text(day.cast("string"), " a ", (day + 1).cast("string"), " de ", F.initcap(month())))
    head = lambda v: text('<h2 class="a elementor-heading-title b">', v, "</h2>")
    html = text(head(F.col("title")), head(F.lit("DATA EVENTO")), head(date), head(F.lit("LOCAL")), head(F.col("city")))
    return run(spark, sf_dir, "cisterfestas", html, text("https://example.org/salaodefestas/f", SID(), "/"))


@query(expected(f"'mg-e' || {ID}", start=f"CASE id % 4 WHEN 0 THEN {MINUTE} WHEN 1 THEN {DAY} WHEN 2 THEN {MINUTE} ELSE {DAY} END", end=f"CASE WHEN id % 4 = 3 THEN {O.epoch_of('CAST(d + 3 AS TIMESTAMP)')} WHEN id % 4 = 0 THEN {O.epoch_of('t + INTERVAL 2 HOUR')} END", venue="CASE WHEN id % 3 = 0 THEN 'Sala 1' WHEN id % 3 = 1 THEN 'Largo' ELSE 'Marinha Grande' END",
  city="'Marinha Grande'", categories="'Música|Teatro & Dança'", reason=f"CASE WHEN coalesce(CASE WHEN id % 4 = 3 THEN {O.epoch_of('CAST(d + 3 AS TIMESTAMP)')} WHEN id % 4 = 0 THEN {O.epoch_of('t + INTERVAL 2 HOUR')} END, CASE id % 4 WHEN 1 THEN {DAY} ELSE {MINUTE} END) + 86400 < {NOW} THEN 'past' END"))
def pack_municipal(spark, sf_dir):
    """Widgets, calendar variables and meta elements; the start is typed, the time of publication, a meta date, or the chip's."""
    k, t = F.col("id"), F.col("t")
    var = lambda n, v: text(f'<var class="atc_{n}">', v, "</var>")
    m = lambda n, v: text(f'<meta name="{n}" content="', v, '">')
    start = F.when(k % 4 < 2, var("date_start", text(t, ":00"))).otherwise("")
    later = D.lisbon_minute(D.epoch_of(F.to_timestamp_ntz(text(t, ":00"))) + 7200)
    end = F.when(k % 4 == 0, var("date_end", later)).otherwise("")
    metas = text(F.when(k % 4 == 1, m("published_at", text(t, ":30"))).otherwise(""), F.when(k % 4 == 2, m("content_date", t)).otherwise(""))
    chip = F.when(k % 4 == 3, text('<div class="dates widget_field "><span>', F.date_format(F.col("day").cast("date"), "dd.MM.yy"), " a ", F.date_format(F.date_add(F.col("day").cast("date"), 3), "d.M.yyyy"), '</span></div><div class="addtocalendar">')).otherwise("")
    local = F.when(k % 3 == 0, "Sala  1").otherwise("Local")
    place = F.when(k % 3 == 1, "Largo").otherwise("--")
    widgets = text('<div class="location widget_field "><b class="writer_text">', local, '<div class="writer_text_clear"></div></b></div><div class="categories widget_field"><span>Música</span> <span>Teatro &amp; Dança</span></div><div class="google_map"></div>')
    html = text(metas, "<h1> ", F.col("title"), "</h1>", start, end, var("location", place), widgets, chip)
    return run(spark, sf_dir, "municipal", html, text("https://example.org/evento/e", SID(), "?x=1"))


@query(O.sql(f"""SELECT 'n' || id AS slug, title || ' & mais' AS title, CASE WHEN id % 4 = 3 THEN NULL ELSE {O.epoch_of("t")} END AS "startAt", CAST(NULL AS BIGINT) AS "endAt", CASE WHEN id % 2 = 0 THEN 'Sala Azul' ELSE 'CM Leiria' END AS "venueName", 'Leiria' AS city, 'Música' AS categories,
  CASE WHEN id % 4 = 3 THEN 'undated' WHEN {O.epoch_of("t")} < {NOW} THEN 'past' END AS drop_reason FROM pe""", EV))
def pack_cmleiriarss(spark, sf_dir):
    """A feed whose texts are escaped twice: dates and venues stand in prose, one emoji as two halves, some without any date."""
    k = F.col("id")
    when = F.when(k % 4 == 3, "Brevemente.").otherwise(text("Dia ", number(9, 2), " de ", month(), " de ", part(1, 4), " &amp;agrave;s ", F.substring("clock", 1, 2), "h", F.substring("clock", 4, 2), "."))
    pin = F.when(k % 2 == 0, " &amp;#55357;&amp;#56525; Sala Azul").otherwise("")
    item = text("<item><title>", F.col("title"), " &amp;amp; mais</title><link>https://example.org/noticias/n", SID(), "/</link><category>Evento</category><category>Música</category><description>&lt;p&gt;Venha. ", when, pin, "&lt;/p&gt;</description><pubDate>Mon, 02 Jan 2023 10:00:00 +0100</pubDate></item>")
    return run(spark, sf_dir, "cmleiriarss", text("<rss><channel>", item, "</channel></rss>"), F.lit("https://example.org/feed"))


@query(O.sql(f"""SELECT 'rl-s' || id AS slug, title, CASE WHEN id % 6 = 0 THEN NULL ELSE {MINUTE} END AS "startAt", CASE WHEN id % 3 = 0 THEN NULL ELSE city END AS city, CASE WHEN id % 3 = 0 THEN 'Local a definir' ELSE city END AS "venueName", CASE id % 2 WHEN 0 THEN 'Festas' ELSE 'Atividades ao Ar Livre' END AS category FROM pe WHERE id % 9 <> 0""", EV))
def pack_regiaoleiria(spark, sf_dir):
    """Three JSON interfaces joined: dated rows (some junk), posts with a kind as text or list, place terms."""
    e, k = rows(spark, sf_dir), F.col("id")
    months = e.select(F.when(k % 9 == 0, "<html>").otherwise(text('[{"post_id": "', SID(), '", "date": "', F.when(k % 6 == 0, F.col("day")).otherwise(text(F.col("t"), ":00")), '"}, {"post_id": "", "date": "x"}]')).alias("payload"))
    tipo = F.when(k % 2 == 0, '["Grande", "Festa"]').otherwise('"oxigenio"')
    details = e.select(text('[{"id": ', SID(), ', "slug": "s', SID(), '", "link": "https://example.org/', SID(), '", "title": {"rendered": "<b>', F.col("title"), '</b>"}, "localidade": [', F.when(k % 3 == 0, "99").otherwise((k % 4 + 1).cast("string")), '], "meta": {"tipo": ', tipo, "}}]").alias("payload"))
    places = spark.createDataFrame([("[" + ", ".join(f'{{"id": {i + 1}, "name": "{c}"}}' for i, c in enumerate(CITIES)) + ', {"id": 9}]',)], "payload string")
    return K.newspaper(months, details, places).select("slug", "title", "startAt", "city", "venueName", F.element_at("categories", 1).alias("category"))


@query(O.sql(f"""SELECT 't' || id AS slug, CASE WHEN id % 8 = 0 THEN NULL ELSE {DAY} END AS "startAt", CASE WHEN id % 8 = 0 THEN NULL ELSE {LAST} END AS "endAt", CASE id % 4 WHEN 0 THEN 'Leiria' WHEN 1 THEN 'Nazaré' WHEN 2 THEN 'Nazaré' ELSE 'Vau' END AS city, CASE id % 4 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 1 END AS n_places,
  CASE WHEN id % 8 = 0 THEN 'undated' WHEN {LAST} < {NOW - C.DAY} THEN 'past' END AS drop_reason FROM pe""", EV))
def pack_turismodocentro(spark, sf_dir):
    """Two JSON interfaces: the first of a row's counties in the district is its place, more are counted."""
    e, k = rows(spark, sf_dir), F.col("id")
    ids = F.when(k % 4 == 0, "[1, 2]").when(k % 4 == 1, "[2, 3, 4, 3]").when(k % 4 == 2, "[3, 4]").otherwise("[4]")
    start = F.when(k % 8 == 0, "null").otherwise(F.col("start_at").cast("string"))
    listing = e.select(text('[{"id": ', SID(), ', "slug": "t', SID(), '", "link": "https://example.org/', SID(), '", "title": {"rendered": "', F.col("title"), '"}, "county_mirror": ', ids, ', "centro": {"start_date": ', start, '}}, {"id": null}]').alias("payload"))
    counties = spark.createDataFrame([("[" + ", ".join(f'{{"id": {i + 1}, "name": "{c}"}}' for i, c in enumerate(CITIES)) + "]",)], "payload string")
    return K.region(listing, counties, NOW).select("slug", "startAt", "endAt", "city", "n_places", "drop_reason")


@query(O.sql(f"""SELECT 'eb-' || id AS slug, title, {MINUTE} AS "startAt", CASE WHEN id % 2 = 0 THEN {DAY} END AS "endAt", CASE WHEN id % 3 = 0 THEN 'Local a definir' ELSE 'Sala' END AS "venueName", city FROM pe WHERE id % 5 <> 0 AND id % 7 <> 0""", EV))
def pack_eventbrite(spark, sf_dir):
    """Embedded payloads of buckets; cancelled and online rows go."""
    k = F.col("id")
    end = F.when(k % 2 == 0, text(', "end_date": "', F.col("day"), '"')).otherwise("")
    event = text('{"eid": "', SID(), '", "name": "', F.col("title"), '", "start_date": "', F.col("day"), '", "start_time": "', F.col("clock"), '"', end, ', "is_cancelled": ', F.when(k % 5 == 0, "true").otherwise("false"), ', "is_online_event": ', F.when(k % 7 == 0, "true").otherwise("false"), ', "primary_venue": {"name": "', F.when(k % 3 == 0, " ").otherwise("Sala"), '", "address": {"city": "', F.col("city"), '"}}}')
    html = text('<script>window.__SERVER_DATA__ = {"buckets": [{"events": [', event, ']}, {"events": []}]};</script>')
    pages = rows(spark, sf_dir).select(k.alias("page_id"), html.alias("html"))
    return K.ticket_payloads(pages).select("slug", "title", "startAt", "endAt", "venueName", "city")


@query("SELECT DISTINCT 'https://example.org/sitemap-eventos-' || page_id % 20 || '.xml' AS url FROM pages")
def sitemap_index(spark, sf_dir):
    """Sub-sitemaps of an index that carry events, each once."""
    k = F.col("page_id")
    loc = lambda name: text("<sitemap><loc> https://example.org/sitemap-", name, "-", (k % 20).cast("string"), ".xml </loc></sitemap>")
    body = text("<sitemapindex>", loc("eventos"), loc("noticias"), loc("eventos"), "</sitemapindex>")
    return tables.read(spark, sf_dir, "pages").select(F.explode(X.sitemap_index(body, "sitemap-eventos")).alias("url")).distinct()


@query("SELECT p_partkey AS id, p_name || ' & Cia' AS name FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 11 <> 0")
def taxonomy_terms(spark, sf_dir):
    """Dimension rows from JSON lists: those with id and name; junk gives none."""
    k = F.col("p_partkey")
    row = text('[{"id": ', F.when(k % 5 == 0, "null").otherwise(k.cast("string")), ', "name": "', F.when(k % 7 == 0, " ").otherwise(text(F.col("p_name"), " &amp; Cia")), '", "count": 3}]')
    return tables.read(spark, sf_dir, "part").select(F.explode(X.terms(F.when(k % 11 == 0, "oops").otherwise(row))).alias("t")).select("t.id", "t.name")


def parsed(spark, sf_dir):
    """The rows with a clock as 18h30, the day's parts, and a short month."""
    return rows(spark, sf_dir).withColumns({"clock_h": text(F.substring("clock", 1, 2), "h", F.substring("clock", 4, 2)), "mes": F.upper(month(True)), "dia": number(9, 2), "ano": part(1, 4)})


def listing(e, html):
    return e.select(F.col("id").alias("page_id"), html.alias("html"))


@query(O.sql(f"""SELECT 'e' || id AS slug, CASE WHEN id % 5 <> 0 AND id % 2 = 0 THEN title || ' &' ELSE title END AS title, CASE WHEN id % 5 <> 0 AND id % 7 <> 0 THEN {MINUTE} END AS "startAt",
  CASE WHEN id % 5 <> 0 AND id % 7 <> 0 AND id % 3 = 0 THEN {O.epoch_of('CAST(d + 1 AS TIMESTAMP)')} END AS "endAt", CASE WHEN id % 5 <> 0 AND id % 4 = 0 THEN 'Sala' ELSE 'Largo' END AS "venueName", city,
  CASE WHEN id % 5 <> 0 THEN 'Feira|Música' ELSE 'Cultura' END AS categories, 'https://example.org/i' || id || '.jpg' AS image, CASE WHEN id % 5 = 0 THEN 'no detail page' WHEN id % 7 = 0 THEN 'no start date' END AS error FROM pe""", EV))
def pack_leiriagenda(spark, sf_dir):
    """Cards and their detail pages by selector: wrapped and plain date blocks, a card that stands twice, missing details and dates."""
    e, k = parsed(spark, sf_dir), F.col("id")
    block = text('<span class="dia">', F.col("dia"), '</span><span class="mes">', F.col("mes"), "</span>")
    plain = text('<div class="date">', block, '<span class="ano">', F.col("ano"), '</span><span class="ano">', F.col("clock_h"), "</span></div>")
    tomorrow = F.date_add(F.col("day").cast("date"), 1)
    short = F.element_at(F.array(*[F.lit(m[:3]) for m in C.MONTHS]), F.month(tomorrow))
    until = F.when(k % 3 == 0, text('<div class="data-fim"><i class="dia">', F.dayofmonth(tomorrow).cast("string"), '</i><i class="mes">', short, " ", F.year(tomorrow).cast("string"), "</i></div>")).otherwise("")
    wrapped = text('<div class="data-inicio">', block, '<span class="ano">', F.col("ano"), '</span><span class="hora">às ', F.col("clock_h"), "</span></div>", until)
    card = lambda title: text('<a href="/pt/agenda/e', SID(), '"><div class="imagem7x10" style="background: url(\'https://example.org/i', SID(), '.jpg\')"></div><h3 class="proximo_title"> ', title, ' </h3><p class="local">Largo</p><p class="localidade">', F.col("city"), '</p><p class="categorias"><small>Cultura</small><small> </small></p>', F.when(k % 2 == 0, plain).otherwise(wrapped), "</a>")
    page = text('<ul><li><a href="/pt/agenda/proximos-eventos">todos</a><li>', card(F.lit("First of two")), "<li>", card(F.col("title")), '<li><a href="/pt/agenda/none">no date</a></ul>')
    title = F.when(k % 2 == 0, text('<h1 class="big title">', F.col("title"), " &amp;</h1>")).otherwise('<h1 class="title"></h1>')
    dates = F.when(k % 7 == 0, "").otherwise(wrapped)
    detail = text('<header><p class="local">Elsewhere</p></header><section class="titles">', title, dates, F.when(k % 4 == 0, '<p class="local">Sala</p>').otherwise(""), '<div class="categorias"><small>Feira</small><small>Música</small><small>Feira</small></div></section><div class="text sinopse"><p>About.</p></div>')
    details = e.where("id % 5 <> 0").select(text("https://leiriagenda.cm-leiria.pt/pt/agenda/e", SID()).alias("url"), detail.alias("html"))
    return K.leiriagenda(listing(e, page), details).select("slug", "title", "startAt", "endAt", "venueName", "city", F.array_join("categories", "|").alias("categories"), F.col("imageUrl").alias("image"), "error")


SESSIONS = f"""se AS (SELECT *, unnest(CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN [0] WHEN id % 2 = 0 THEN [0, 1] ELSE [0] END) AS n FROM pe WHERE id % 3 <> 0)"""


@query(O.sql(f"""SELECT 'evento_' || id AS slug, 'Evento ' || id AS title, CASE WHEN id % 5 = 0 OR id % 7 = 0 THEN NULL WHEN id % 4 = 1 THEN {O.epoch_of("CAST(d + n AS TIMESTAMP)")} ELSE {O.epoch_of("t + n * INTERVAL 1 DAY")} END AS "startAt",
  'Teatro Leiria' AS "venueName", CASE WHEN id % 7 = 0 THEN 'no detail page' WHEN id % 5 = 0 THEN 'no session date' END AS error FROM se""", EV, SESSIONS))
def pack_bol(spark, sf_dir):
    """Links that name event and venue, and the sessions of their detail pages: blocks or slashed dates, one time for all."""
    e, k = parsed(spark, sf_dir), F.col("id")
    venue = F.when(k % 3 == 0, "coliseu_porto").otherwise("teatro_leiria")
    link = text('<a href="/Comprar/Bilhetes/', SID(), "-evento_", SID(), "-", venue, '/">x</a>')
    page = text(link, link, '<a href="/Comprar/Bilhetes/9-one/">x</a><a href="/Comprar/">y</a>')
    next_day = F.date_add(F.col("day").cast("date"), 1)
    names = F.array(*[F.lit(m[:3]) for m in C.MONTHS])
    session = lambda d: text('<div class="sessao"><b class="ano">', F.year(d).cast("string"), '</b><b class="mes">', F.element_at(names, F.month(d)), '</b><b class="dia">', F.dayofmonth(d).cast("string"), "</b></div>")
    own = F.col("day").cast("date")
    blocks = text('<div class="datas">', session(own), F.when(k % 2 == 0, session(next_day)).otherwise(""), '</div><div class="proxima-sessao"><span>', F.date_format(own, "dd MM yyyy"), " ", F.col("clock"), "</span><span>mais</span></div>")
    body = F.when(k % 5 == 0, "Esgotado").when(k % 4 == 1, text("Dia ", F.date_format(own, "d/M/yyyy"))).otherwise(blocks)
    details = e.where("id % 7 <> 0").select(text("https://www.bol.pt/Comprar/Bilhetes/", SID(), "-evento_", SID(), "-", venue).alias("url"), text('<div class="datas-sessoes">', body, "</div>").alias("html"))
    return K.box_office(listing(e, page), details).select("slug", "title", "startAt", "venueName", "error")


#: The site's mark of an unknown time is a real minute of the day as well.
REAL = "strftime(t, '%H:%M') <> '00:59'"


@query(O.sql(f"""SELECT 'va-' || id AS slug, title, CASE WHEN id % 3 <> 0 AND {REAL} THEN {MINUTE} WHEN id % 6 = 0 AND id % 5 <> 0 THEN {O.epoch_of("d + INTERVAL 10 HOUR")} ELSE {DAY} END AS "startAt",
  CASE WHEN id % 3 <> 0 AND id % 2 = 0 THEN CASE WHEN {REAL} THEN {O.epoch_of("t + INTERVAL 1 DAY")} ELSE {O.epoch_of("CAST(d + 1 AS TIMESTAMP)")} END END AS "endAt",
  CASE WHEN id % 5 <> 0 AND id % 2 = 0 THEN 'Clube' ELSE 'Sala' END AS "venueName", CASE WHEN id % 5 <> 0 AND id % 8 = 1 THEN 'Nazaré' ELSE city END AS city, 'Concertos' AS categories, CASE WHEN id % 5 = 0 THEN 'no detail page' END AS error
  FROM pe WHERE city <> 'Lisboa' OR (id % 5 <> 0 AND id % 8 = 1)""", EV))
def pack_viralagenda(spark, sf_dir):
    """Cards with their data in attributes and JSON-LD details: a real time on the card wins, a placeholder yields."""
    e, k = parsed(spark, sf_dir), F.col("id")
    iso = lambda t: F.replace(t, F.lit(" "), F.lit("T"))
    start = F.when(k % 3 == 0, text(F.col("day"), "T00:59")).otherwise(iso(F.col("t")))
    tomorrow = F.date_format(F.date_add(F.col("day").cast("date"), 1), "yyyy-MM-dd")
    end = F.when((k % 3 != 0) & (k % 2 == 0), text(' data-date-end="', tomorrow, "T", F.col("clock"), '"')).otherwise("")
    card = text('<li id="c1" data-id="', SID(), '" data-url="/e/', SID(), '" data-date-start="', start, '"', end, '><div class="viral-event-title"><a class="viral-linked"><span>', F.col("title"), '</span></a></div><div class="viral-event-hour">', F.when(k % 3 == 0, " N/D ").otherwise(F.col("clock")), '</div><a class="node-name x"><span>', F.col("city"), '</span></a><a class="viral-event-place"><span>Sala</span></a><a title="Ver eventos desta categoria">Concertos</a><a title="Ver eventos desta categoria">Concertos</a></li>')
    page = text("<ul>", card, card, '<li data-id="0">no url</li></ul>')
    from_ = F.when(k % 6 == 0, text(', "startDate": "', F.col("day"), 'T10:00"')).otherwise("")
    room = F.when(k % 2 == 0, '"name": " Clube "').otherwise('"name": 5')
    town = F.when(k % 8 == 1, ', "address": {"addressLocality": "Nazaré"}').otherwise("")
    html = text('<script type="application/ld+json">oops</script><script type="application/ld+json">{"@graph": [{"name": " ', F.col("title"), '"', from_, ', "location": {', room, town, "}}]}</script>")
    details = e.where("id % 5 <> 0").select(text("https://www.viralagenda.com/e/", SID()).alias("url"), html.alias("html"))
    return K.viralagenda(listing(e, page), details).select("slug", "title", "startAt", "endAt", "venueName", "city", F.array_join("categories", "|").alias("categories"), "error")


@query(O.sql(f"""SELECT 'tl-' || id AS slug, CASE WHEN id % 3 <> 0 AND id % 2 = 0 THEN title || ' show' ELSE title END AS title, CASE WHEN id % 3 <> 0 THEN {MINUTE} ELSE {DAY} END AS "startAt", CASE WHEN id % 3 <> 0 THEN 'Sala 2' WHEN id % 2 = 0 THEN 'Teatro' ELSE 'Arena' END AS "venueName",
  'Leiria' AS city, 'Música' AS categories, CAST(NULL AS VARCHAR) AS error FROM pe WHERE {DAY} >= {O.epoch_of(f"CAST(CAST({O.lisbon(NOW)} AS DATE) AS TIMESTAMP)")} AND (id % 4 = 0 OR CASE WHEN id % 3 <> 0 THEN city <> 'Lisboa' ELSE id % 2 = 0 END)""", EV))
def pack_ticketline(spark, sf_dir):
    """Search rows in microdata and the first session of their detail pages; aggregators have none."""
    e, k = parsed(spark, sf_dir), F.col("id")
    venue = F.when(k % 2 == 0, "Teatro, Leiria").otherwise("Arena")
    row = text('<li itemscope itemtype="http://schema.org/Event"><a itemprop="url" href="/evento/x-', SID(), '"><p itemprop="name"> ', F.col("title"), ' </p><p class="date" data-date="', F.col("day"), '"></p><p itemprop="location">', venue, '</p><p class="metadata categories">Música</p></a>')
    page = text("<ul>", row, row, '<li itemscope itemtype="http://schema.org/Event"><a itemprop="url" href="/none">x</a></ul>')
    show = F.when(k % 2 == 0, text('<div itemprop="name" content="', F.col("title"), ' show"></div>')).otherwise("")
    session = text('<ul><li itemprop="Event">', show, '<p class="date" itemprop="startDate" content="', F.col("day"), "T", F.col("clock"), '"></p><p class="venue" itemprop="name">Sala 2</p><span itemprop="addressLocality">', F.col("city"), '</span></li><li itemprop="Event">later</li></ul>')
    html = text('<article class="event_detail"><h2 class="title">', F.col("title"), "</h2></article>", F.when(k % 3 == 0, "").otherwise(session))
    details = e.select(text("https://www.ticketline.pt/evento/x-", SID()).alias("url"), html.alias("html"))
    searches = e.select(k.alias("page_id"), page.alias("html"), (k % 4 == 0).alias("venue_scoped"))
    return K.ticketline(searches, details, NOW).select("slug", "title", "startAt", "venueName", "city", F.array_join("categories", "|").alias("categories"), "error")


MANY = f"CASE CAST(id % 7 AS INTEGER) {' '.join(f'WHEN {i} THEN {O.lit(p)}' for i, (_, p, _) in enumerate(C.COUNCILS))} END"
TOWN = f"CASE CAST(id % 7 AS INTEGER) {' '.join(f'WHEN {i} THEN {O.lit(c)}' for i, (_, _, c) in enumerate(C.COUNCILS))} END"


@query(O.sql(f"""SELECT {MANY} || '-e' || id AS slug, title, {MINUTE} AS "startAt", CASE WHEN id % 3 = 0 THEN 'Largo' ELSE {TOWN} END AS "venueName", {TOWN} AS city, CASE WHEN {MINUTE} + 86400 < {NOW} THEN 'past' END AS drop_reason FROM pe""", EV))
def pack_councils(spark, sf_dir):
    """Pages of the seven councils, each read with its own prefix and place."""
    e, k = rows(spark, sf_dir), F.col("id")
    html = text('<h1>', F.col("title"), '</h1><var class="atc_date_start">', F.col("t"), ':00</var><var class="atc_location">', F.when(k % 3 == 0, "Largo").otherwise("--"), "</var>")
    host = F.element_at(F.array(*[F.lit(h) for h, _, _ in C.COUNCILS]), (k % 7 + 1).cast("int"))
    pages = e.select(k.alias("page_id"), text("https://", host, "/evento/e", SID(), "?x=1").alias("url"), html.alias("html"))
    return K.extract(pages, K.COUNCILS, NOW).select("slug", "title", "startAt", "venueName", "city", "drop_reason")


@query(O.sql(f"""SELECT item, arg_min(title, (hub, id)) AS title, min(hub) AS hub FROM (SELECT id, 'h' || (id // 3) AS item, CASE WHEN id % 7 = 0 THEN title || ' @ O Pica Miolos' ELSE title END AS title, CAST(id % 21 AS INTEGER) AS hub, id % 4 = 0 OR id % 7 = 0 AS known FROM pe)
  WHERE hub = 0 OR (hub < 20 AND known) GROUP BY item""", EV))
def hub_allowlist(spark, sf_dir):
    """Cards of all hubs: those of the first, and of the others what a known venue names; the first of an item stays."""
    k = F.col("id")
    hub = F.element_at(F.array(*[F.lit(h) for h in [*C.HUBS, "nowhere"]]), (k % 21 + 1).cast("int"))
    title = F.when(k % 7 == 0, text(F.col("title"), " @ O Pica Miolos")).otherwise(F.col("title"))
    venue = F.when(k % 4 == 0, "Bar O Pica Miolos").when(k % 4 == 1, "Portugal").otherwise("Sala Grande")
    cards = rows(spark, sf_dir).select(hub.alias("hub"), k.alias("page_id"), F.lit(0).alias("pos"), text("h", F.floor(k / 3).cast("string")).alias("id"), title.alias("title"), venue.alias("venue"))
    at = F.array_position(F.array(*[F.lit(h) for h in C.HUBS]), F.col("hub")) - 1
    return K.hub_rows(cards).select(F.col("id").alias("item"), "title", at.cast("int").alias("hub"))


HEX = "lower(hex(id))"


@query(O.sql(f"""SELECT 'nocartaz-c' || {HEX} AS slug, CASE WHEN id % 2 = 0 THEN title || ' & mais' ELSE title END AS title, CASE WHEN id % 2 = 0 THEN {MINUTE} ELSE {DAY} END AS "startAt", CASE WHEN id % 6 = 0 THEN {O.epoch_of('t + INTERVAL 2 HOUR')} END AS "endAt",
  CASE WHEN id % 2 = 0 THEN 'Sala Nova' ELSE 'Sala Grande' END AS "venueName", CASE WHEN id % 2 = 1 THEN 'Leiria' WHEN city <> 'Lisboa' THEN city END AS city,
  CASE WHEN id % 2 = 0 AND city = 'Lisboa' THEN 'outOfDistrict' WHEN CASE WHEN id % 6 = 0 THEN {O.epoch_of('t + INTERVAL 2 HOUR')} WHEN id % 2 = 0 THEN {MINUTE} ELSE {DAY} END + 86400 < {NOW} THEN 'past' END AS drop_reason FROM pe
  UNION ALL SELECT 'nocartaz-e' || {HEX}, title || ' item', CASE WHEN id % 4 = 0 THEN {DAY} END, NULL, CASE WHEN id % 4 = 0 THEN 'Casa' ELSE '' END, CASE WHEN id % 4 = 0 THEN 'Leiria' END, CASE WHEN id % 4 <> 0 THEN 'undated' WHEN {DAY} + 86400 < {NOW} THEN 'past' END FROM pe""", EV))
def pack_nocartaz_details(spark, sf_dir):
    """Cards and item lists of a hub, overridden by the JSON-LD of detail pages; entries without a detail have no date."""
    e, k = rows(spark, sf_dir), F.col("id")
    own = F.lower(F.hex("id"))
    iso = F.replace("t", F.lit(" "), F.lit("T"))
    card = text('<article class="event-card" data-id="c', own, '" data-date="', F.col("day"), '" data-concelho="Leiria"><h3>', F.col("title"), '</h3><span class="where"> <span>Sala Grande</span></span></article>')
    lists = text('<script type="application/ld+json">{"@type": "ItemList", "itemListElement": [{"name": "', F.col("title"), ' item", "url": "https://example.org/eventos/e', own, '/"}, {"name": "", "url": "/eventos/1/"}, {"name": "x", "url": "/other/"}]}</script>')
    pages = e.select(F.lit("leiria").alias("hub"), k.alias("page_id"), text(lists, "<main>", card, "</main>").alias("html"))
    later = F.replace(D.lisbon_minute(D.epoch_of(F.to_timestamp_ntz(text(F.col("t"), ":00"))) + 7200), F.lit(" "), F.lit("T"))
    node = lambda name, start, end, room, town: text('<script type="application/ld+json">[{"@type": "WebPage"}, {"@type": "Event", "name": "', name, '", "startDate": "', start, '"', end, ', "location": {"name": "', room, '", "address": {"addressLocality": "', town, '"}}}]</script>')
    end = F.when(k % 6 == 0, text(', "endDate": "', later, '"')).when(k % 6 == 2, text(', "endDate": "', iso, '"')).otherwise("")
    own_page = e.where("id % 2 = 0").select(text("https://example.org/eventos/c", own, "/").alias("url"), node(text(F.col("title"), " &amp; mais"), iso, end, "Sala Nova", F.col("city")).alias("html"))
    listed = e.where("id % 4 = 0").select(text("https://example.org/eventos/e", own, "/").alias("url"), node(text(F.col("title"), "  item"), F.col("day"), "", "Casa", "Leiria").alias("html"))
    return K.hub_events(pages, own_page.union(listed), NOW).select("slug", "title", "startAt", "endAt", "venueName", "city", "drop_reason")
