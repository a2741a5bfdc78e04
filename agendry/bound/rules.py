"""Queries of the single listings' rules: dates, venues, scopes and categories as sources write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from agendry import constants as C, oracle as O, tables
from agendry.bound.texts import CUST, DIM, ORD, PLACES, TAXONOMY, customer_places, order_days, pick, raw_labels, titles, two
from agendry.functions import dates as D, places as P, text as T
from agendry.registry import query

LAST = C.NOW + 60 * C.DAY


def clock(day, h="h", mi="mi"):
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), two(F.col(h)), F.lit(":"), two(F.col(mi)), F.lit(":00"))


AT = "(CAST(d AS TIMESTAMP) + to_minutes(h * 60 + mi))"
MIDNIGHT = "CAST(d AS TIMESTAMP)"


@query(f"""WITH {ORD} SELECT id, CASE WHEN id % 5 = 0 THEN NULL ELSE {O.epoch_of(AT)} END AS at, id % 5 <> 0 AND id % 3 = 0 AS typed_by_nobody,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 3 = 0 THEN {O.epoch_of(MIDNIGHT)} ELSE {O.epoch_of(AT)} END AS start FROM o""")
def strict_clocks(spark, sf_dir):
    """Wall clocks of one strict form, others are null; a start at the minute of publication becomes midnight."""
    k, day = F.col("id"), F.date_format("d", "yyyy-MM-dd")
    raw = F.when(k % 5 == 0, F.concat(F.lit("dia "), day)).when(k % 2 == 0, clock("d")).otherwise(F.concat(F.lit(" "), day, F.lit(" "), two(F.col("h")), F.lit(":"), two(F.col("mi"))))
    published = F.when(k % 3 == 0, F.replace(clock("d"), F.lit("T"), F.lit(" "))).otherwise(F.concat(day, F.lit(" 03:04:05")))
    none = F.lit(None).cast("string")
    return order_days(spark, sf_dir).select("id", D.strict_clock(raw).alias("at"), D.is_default_time(raw, published, none).alias("typed_by_nobody"), D.typed_start(raw, published, none).alias("start"))


@query(f"""WITH {ORD}, e AS (SELECT *, d + h AS z FROM o) SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE {O.epoch_of(MIDNIGHT)} END AS earliest,
  CASE id % 4 WHEN 0 THEN {O.epoch_of(MIDNIGHT)} WHEN 3 THEN NULL WHEN 1 THEN {O.epoch_of('CAST(z AS TIMESTAMP)')}
  ELSE {O.epoch_of('CAST(CASE WHEN month(z) < month(d) THEN d ELSE z END AS TIMESTAMP)')} END AS latest
  FROM e WHERE NOT (id % 4 = 2 AND month(z) < month(d))""")
def listing_dates(spark, sf_dir):
    """Chips of a listing in their shapes: slashed, dotted with two-digit years, spans of day, month and year, and spans without a year."""
    k, a, b = F.col("id"), F.col("d"), F.date_add("d", F.col("h"))
    names = F.array(*[F.lit(m) for m in C.MONTHS])
    span = lambda cls, v: F.concat(F.lit(f'<span class="{cls}">'), v, F.lit("</span>"))
    part = lambda d: F.concat(span("dia", F.dayofmonth(d).cast("string")), span("mes_extenso", F.element_at(names, F.month(d))))
    years = F.concat(part(a), F.lit(" a "), part(b))
    chip = (
        F.when(k % 4 == 0, F.date_format(a, "yyyy/MM/dd")).when(k % 4 == 1, F.concat(F.date_format(a, "dd.MM.yy"), F.lit(" a "), F.date_format(b, "d.M.yy")))
        .when(k % 4 == 2, F.concat(years, span("ano", F.date_format(a, "yyyy")))).otherwise(years)
    )
    rows = order_days(spark, sf_dir).where(~((k % 4 == 2) & (F.month(b) < F.month(a))))
    return rows.withColumn("r", D.chip_dates(chip)).select("id", "r.earliest", "r.latest")


@query(f"""WITH {ORD} SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE CAST(d AS VARCHAR) END AS start, CASE id % 3 WHEN 0 THEN CAST(d AS VARCHAR) WHEN 1 THEN CAST(d + h * 5 AS VARCHAR) END AS "end",
  CAST(CASE WHEN id % 3 = 2 THEN NULL ELSE day(d) END AS INTEGER) AS first, CAST(CASE id % 3 WHEN 0 THEN day(d) WHEN 1 THEN 30 END AS INTEGER) AS last, CAST(month(CASE WHEN id % 3 = 2 THEN NULL ELSE d END) AS INTEGER) AS month FROM o""")
def date_spans(spark, sf_dir):
    """Long ranges with years, across the turn of one as well, and the first day and month that a text names."""
    k, a, b = F.col("id"), F.col("d"), F.date_add("d", F.col("h") * 5)
    names = F.array(*[F.lit(m.capitalize()) for m in C.MONTHS])
    long = lambda d: F.concat(F.dayofmonth(d).cast("string"), F.lit(" de "), F.element_at(names, F.month(d)), F.lit(", "), F.year(d).cast("string"))
    text = F.when(k % 3 == 0, long(a)).when(k % 3 == 1, F.concat(long(a), F.lit("  –  "), long(b))).otherwise("dias 5 e 6, a anunciar")
    days = F.when(k % 3 == 1, F.concat(F.lit("Festas de "), F.dayofmonth(a).cast("string"), F.lit(" a 30 de "), F.element_at(names, F.month(a)))).otherwise(text)
    rows = order_days(spark, sf_dir).withColumn("r", D.date_range(text)).withColumn("s", D.day_span(days))
    return rows.select("id", "r.start", "r.end", "s.first", "s.last", "s.month")


@query(f"""WITH {ORD}, b AS (SELECT id, d - 1 + CAST(0 AS INTEGER) AS d, least(day(d), 26) AS a, month(d) AS m FROM o), c AS (SELECT id, a, y, {O.epoch_of("make_timestamp(y, m, a, 0, 0, 0)")} AS start,
  {O.epoch_of("make_timestamp(y, m, a + 2, 23, 59, 0)")} AS "end" FROM b, (VALUES (2024), (2025)) AS t(y))
  SELECT id, arg_min(start, y) AS start, arg_min("end", y) AS "end" FROM c WHERE "end" >= {C.NOW - C.DAY} AND (y = 2024 OR start <= {C.NOW + 150 * C.DAY}) GROUP BY id""")
def horizon_dates(spark, sf_dir):
    """Days and months without a year: this year if not over, else next year within the horizon, else dropped."""
    day = F.least(F.dayofmonth("d"), F.lit(26))
    names = F.array(*[F.lit(m) for m in C.MONTHS])
    text = F.concat(F.lit("de "), day.cast("string"), F.lit(" a "), (day + 2).cast("string"), F.lit(" de "), F.element_at(names, F.month("d")))
    rows = order_days(spark, sf_dir).withColumn("r", D.infer_epochs(D.day_span(text), C.NOW)).where("r is not null")
    return rows.select("id", "r.start", "r.end")


@query(f"""WITH {ORD} SELECT id, CASE id % 5 WHEN 0 THEN {O.epoch_of(AT)} WHEN 1 THEN {O.epoch_of(AT)} WHEN 2 THEN {O.epoch_of(MIDNIGHT)} WHEN 3 THEN {O.epoch_of("CAST(make_date(year(d) + 1, 1, 1) AS TIMESTAMP) + to_minutes(h * 60)")} END AS at,
  CASE WHEN id % 5 = 4 THEN NULL ELSE id % 5 <> 2 END AS has_time, CASE WHEN id % 5 = 4 THEN NULL ELSE day(d) >= 0 END AS worded FROM o""")
def free_dates(spark, sf_dir):
    """Dates in prose: the one with a time wins over a historical one; a day and month alone lie after publication."""
    k, names = F.col("id"), F.array(*[F.lit(m) for m in C.MONTHS])
    month = F.element_at(names, F.month("d"))
    year, day, h = F.year("d").cast("string"), F.dayofmonth("d").cast("string"), F.col("h").cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Fundada a 13 de novembro de 1915. Dia "), day, F.lit(" de "), month, F.lit(" de "), year, F.lit(" às "), h, F.lit("h"), two(F.col("mi"))))
        .when(k % 5 == 1, F.concat(F.lit("Em "), month, F.lit(": "), F.date_format("d", "dd/MM/yyyy"), F.lit(", pelas "), h, F.lit("h"), two(F.col("mi")), F.lit(" na praça")))
        .when(k % 5 == 2, F.concat(F.lit("Concerto. "), day, F.lit(" "), month, F.lit(" "), year))
        .when(k % 5 == 3, F.concat(F.lit("Ano novo a 1 de janeiro, às "), h, F.lit("h"))).otherwise("Sem data, a anunciar")
    )
    noon = D.epoch_of(F.make_date(F.year("d"), F.lit(6), F.lit(15)).cast("timestamp_ntz"))
    rows = order_days(spark, sf_dir).withColumn("r", D.free_date(text, noon)).withColumn("s", D.date_sentence(text))
    named = F.when(F.col("s").isNotNull(), F.length("s") <= 120)
    return rows.select("id", "r.at", "r.has_time", F.when(k % 5 == 1, F.lit(True)).otherwise(named).alias("worded"))


@query(f"""WITH {ORD} SELECT id, CASE id % 4 WHEN 0 THEN {O.epoch_of(AT)} WHEN 1 THEN {O.epoch_of(AT)} - 3600 ELSE {O.epoch_of(MIDNIGHT)} END AS start,
  CASE id % 4 WHEN 0 THEN {O.epoch_of(AT + " + INTERVAL 2 HOUR")} WHEN 1 THEN NULL WHEN 2 THEN {O.epoch_of("CAST(d + 1 AS TIMESTAMP)")} END AS "end", id % 4 <> 0 AS placeholder FROM o""")
def card_times(spark, sf_dir):
    """The listing's time if it has a real one, else the detail's, else the listing's day; ends before the start go."""
    k, at = F.col("id"), clock("d")
    hour = F.when(k % 4 == 0, F.concat(two(F.col("h")), F.lit(":"), two(F.col("mi")))).when(k % 4 == 1, "N/D").when(k % 4 == 2, "00:59").otherwise(" ")
    day = F.date_format("d", "yyyy-MM-dd")
    start = F.when(k % 4 == 0, at).otherwise(F.concat(day, F.lit("T00:59:00")))
    late = D.epoch_of(F.to_timestamp_ntz(at)) + 7200
    end = F.when(k % 4 == 0, F.replace(D.lisbon_minute(late), F.lit(" "), F.lit("T"))).when(k % 4 == 2, F.date_format(F.date_add("d", 1), "yyyy-MM-dd"))
    early = F.replace(D.lisbon_minute(D.epoch_of(F.to_timestamp_ntz(at)) - 3600), F.lit(" "), F.lit("T"))
    detail_start, detail_end = F.when(k % 4 < 2, early), F.when(k % 4 == 1, day)
    real = ~D.is_placeholder_time(hour)
    rows = order_days(spark, sf_dir).withColumn("r", D.card_times(start, end, real, detail_start, detail_end))
    return rows.select("id", "r.start", "r.end", (~real).alias("placeholder"))


@query(f"""WITH {ORD}, e AS (SELECT *, d + CAST(id % 3 AS INTEGER) AS z FROM o) SELECT id, {O.epoch_of("CAST(z AS TIMESTAMP)")} + 86399 AS inclusive, {O.epoch_of("CAST(z AS TIMESTAMP) + INTERVAL 1439 MINUTE")} AS last_minute,
  CASE WHEN id % 3 > 0 THEN {O.epoch_of("CAST(z AS TIMESTAMP)")} END AS later, {O.epoch_of(MIDNIGHT)} AS day_start FROM e""")
def end_rules(spark, sf_dir):
    """Inclusive end dates, ends at 23:59, ends that are not after the start, and the midnight of an instant's day."""
    end = F.date_format(F.date_add("d", (F.col("id") % 3).cast("int")), "yyyy-MM-dd")
    start = D.day_epoch(F.date_format("d", "yyyy-MM-dd"))
    at = D.epoch_of(F.to_timestamp_ntz(clock("d")))
    return order_days(spark, sf_dir).select("id", D.last_second(D.day_epoch(end)).alias("inclusive"), D.last_minute(end).alias("last_minute"), D.later_end(start, D.day_epoch(end)).alias("later"), D.start_of_day(at).alias("day_start"))


@query(O.sql(f"""SELECT id, CASE {O.lisbon_day('start_at')} WHEN {O.lisbon_day(str(C.NOW))} THEN 'hoje' WHEN {O.lisbon_day(str(C.NOW - C.DAY))} THEN 'ontem' ELSE strftime({O.lisbon('start_at')}, '%d/%m') END || ', ' || strftime({O.lisbon('start_at')}, '%H:%M') AS label FROM cat_events"""))
def run_labels(spark, sf_dir):
    return tables.events(spark, sf_dir).select("id", D.run_label(F.col("start_at"), C.NOW).alias("label"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 3 THEN 'CM Leiria' WHEN 5 THEN 'CM Leiria' ELSE p_name END AS venue FROM part""")
def prose_venue(spark, sf_dir):
    """Venues in prose: after either pin up to a stop phrase, after "Local" and a sign, or the default."""
    k, n = F.col("p_partkey"), F.col("p_name")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("Venha! 📍 "), n, F.lit(" entrada livre, todos"))).when(k % 6 == 1, F.concat(F.lit("📌"), n, F.lit("... a partir das 21h")))
        .when(k % 6 == 2, F.concat(F.lit("Hoje. LOCAL - "), n, F.lit(", junto ao rio"))).when(k % 6 == 3, "Local: A Definir. 📍 a confirmar")
        .when(k % 6 == 4, F.concat(F.lit("📍 A Anunciar Bilhetes na porta\nLocal: "), n, F.lit(". Fim"))).otherwise(F.concat(F.lit("O local "), n))
    )
    return tables.read(spark, sf_dir, "part").select(k.alias("id"), T.prose_venue(text).alias("venue"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 4 THEN CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END ELSE p_type END AS venue,
  CASE WHEN p_partkey % 5 = 4 THEN p_brand END AS named FROM part""")
def venue_pick(spark, sf_dir):
    """The first candidate that is no placeholder, else the city; and names that are no country."""
    k = F.col("p_partkey")
    first = F.when(k % 5 == 0, F.col("p_name")).when(k % 5 == 1, "Sem  local").when(k % 5 == 2, "EVENTOS").when(k % 5 == 3, "---")
    second = F.when((k % 5 == 4) & (k % 2 == 1), " n/a ").otherwise(F.col("p_type"))
    name = F.when(k % 5 == 4, F.concat(F.lit(" "), "p_brand")).when(k % 5 == 3, "Portugal Continental").when(k % 5 == 2, "PT").when(k % 5 == 1, " ")
    return tables.read(spark, sf_dir, "part").select(k.alias("id"), T.pick_venue(F.col("p_brand"), first, second).alias("venue"), T.usable_venue(name).alias("named"))


@query(f"""SELECT id, (len(f) > 0 AND len(list_filter(f, lambda w: NOT list_contains(v, w))) = 0) OR contains(lower(venue), 'agenda') AS feed FROM (SELECT id, venue, {O.venue_tokens("replace(replace(slug, '-', ' '), '/', ' ')", "''")} AS f, {O.venue_tokens("venue", "''")} AS v
  FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'de/da-e' ELSE lower(replace(split_part(p_name, ' ', 1) || ' de ' || split_part(p_name, ' ', 2), ' ', '-')) END AS slug, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || ' - Sala' WHEN 1 THEN 'AGENDA ' || p_type ELSE p_type END AS venue FROM part))""")
def feed_venue(spark, sf_dir):
    """Venues that are a feed's own name: all words of the feed's slug, or an agenda."""
    k, word = F.col("p_partkey"), lambda i: F.element_at(F.split("p_name", " "), i)
    slug = F.when(k % 5 == 0, "de/da-e").otherwise(F.lower(F.concat_ws("-", word(1), F.lit("de"), word(2))))
    venue = F.when(k % 3 == 0, F.concat(F.upper("p_name"), F.lit(" - Sala"))).when(k % 3 == 1, F.concat(F.lit("AGENDA "), "p_type")).otherwise(F.col("p_type"))
    return tables.read(spark, sf_dir, "part").select(k.alias("id"), T.is_feed_venue(slug, venue).alias("feed"))


@query("""SELECT page_id, 'pt-' || split_part(split_part(split_part(regexp_extract(url, '^https?://[^/]+/(.*)$', 1), '/', 1), '?', 1), '#', 1) AS source_id, contains(url, 'leiria') OR contains(url, 'lucio') AS near FROM pages""")
def url_ids(spark, sf_dir):
    """Ids from url tails; none of the pages' tails is percent-coded, nor in the area unless it says so."""
    url = F.col("url")
    return tables.read(spark, sf_dir, "pages").select("page_id", T.source_id("pt", url, "^https?://[^/]+/").alias("source_id"), T.is_near_venue(url).alias("near"))


LEADS = ("Feira de ", "Grande Mercado ", "Festival ", "Exposições: ", "ATELIÊ ", "Romaria ", "Colecção ", "")
FOLDED = O.norm_place("t")
LEAD_TITLES = f"lt AS (SELECT doc_id, {O.arr(LEADS)}[CAST(doc_id % 8 AS INTEGER) + 1] || split_part(text, chr(10), 1) AS t, doc_id % 8 AS k FROM documents WHERE text IS NOT NULL)"


@query(f"""WITH {LEAD_TITLES} SELECT doc_id, CASE WHEN starts_with(lower(t), 'feira') OR contains(lower(t), 'mercado') THEN 'Mercados e Feiras' WHEN contains(lower(t), 'festival') THEN 'Festivais' ELSE 'Tradição' END AS fair,
  CASE WHEN regexp_matches({FOLDED}, 'exposi|mostra|colec') THEN 'Exposições' WHEN regexp_matches({FOLDED}, 'festival|folio|\\bfol\\b|semana') THEN 'Festivais' WHEN regexp_matches({FOLDED}, 'mercado|feira') THEN 'Mercados e Feiras'
  WHEN regexp_matches({FOLDED}, 'oficina|atelier|atelie|workshop|kamishi') THEN 'Oficinas' WHEN regexp_matches({FOLDED}, 'festa|romaria') THEN 'Tradição' ELSE 'Outros' END AS town,
  CASE k WHEN 5 THEN 'Festas' WHEN 1 THEN 'Atividades ao Ar Livre' ELSE 'Agenda' END AS kind, CASE k WHEN 0 THEN 'Concertos' WHEN 1 THEN 'Teatro' WHEN 2 THEN '' ELSE 'Outros' END AS genre FROM lt""")
def category_rules(spark, sf_dir):
    """Categories by the rules of four listings: fairs, a town's agenda, kinds of a newspaper, genres of a hub."""
    k = F.col("doc_id") % 8
    t = F.concat(pick(LEADS, F.col("doc_id")), "title")
    kind = F.when(k == 5, "Festa popular").when(k == 1, "rota-OXIGENIO").otherwise("outra")
    genre = F.when(k == 0, " Rock-Pop").when(k == 1, "performance").when(k == 2, "astrologia").otherwise("outro")
    rows = titles(spark, sf_dir).where("title is not null")
    return rows.select("doc_id", P.fair_category(t).alias("fair"), P.town_category(t).alias("town"), P.kind_category(kind).alias("kind"), F.array_join(P.genre_categories(genre), "|").alias("genre"))


@query(f"""WITH {CUST}, {DIM} SELECT id, in_scope, CASE WHEN in_scope THEN CASE WHEN own THEN city WHEN id % 7 = 0 THEN 'Leiria' WHEN id % 11 = 0 THEN 'Nazaré' WHEN city <> '' THEN city END END AS city
  FROM (SELECT *, own OR id % 7 = 0 OR (city IS NULL AND id % 11 = 0) AS in_scope FROM (SELECT id, nullif(trim(city), '') AS city, coalesce(in_d, false) AS own
  FROM (SELECT id, city, {O.norm_place('city')} NOT IN ('', '?', 'n/d') AND (regexp_matches({O.norm_place('city')}, '(^|[^a-z])leir') OR list_contains({O.arr([*P.MUNICIPALITY, *P.LOCALITIES])}, {O.norm_place('city')})) AS in_d FROM cu)))""")
def scope_order(spark, sf_dir):
    """Whether a row is in scope and which city it gets: its own, a curated venue's, or one that its title names if it has none."""
    k = F.col("id")
    venue = F.when(k % 7 == 0, "Bar Pica Miolos").otherwise("Portugal")
    card = F.when(k % 11 == 0, F.concat(F.lit("Festa na Nazaré "), k.cast("string"))).otherwise(F.concat(F.lit("Concerto "), k.cast("string")))
    rows = customer_places(spark, sf_dir).withColumn("r", P.resolve_scope(card, card, F.col("city"), venue, F.lit("")))
    return rows.select("id", "r.in_scope", "r.city")


TAILS = ["Óbidos", "Vau", "Lisboa", "Vila Nova de Gaia", "Amoreira", "CALDAS da Rainha", "Évora"]


@query(f"""SELECT c_custkey AS id, CASE c_custkey % 10 WHEN 8 THEN 'Óbidos' WHEN 9 THEN 'Óbidos' ELSE c_name || CASE WHEN c_custkey % 10 = 7 THEN '' ELSE ' , ' || tail END END AS venue,
  CASE WHEN c_custkey % 10 >= 7 OR tail = 'Amoreira' THEN 'Óbidos' ELSE tail END AS city FROM (SELECT *, {O.arr(TAILS)}[CAST(c_custkey % 7 AS INTEGER) + 1] AS tail FROM customer)""")
def tail_cities(spark, sf_dir):
    """Cities after the last comma of a venue, if they are known places in or out of the district."""
    k = F.col("c_custkey")
    named = F.concat("c_name", F.when(k % 10 == 7, F.lit("")).otherwise(F.concat(F.lit(" , "), pick(TAILS, k))))
    venue = F.when(k % 10 == 8, " A  Definir").when(k % 10 == 9, F.lit(None)).otherwise(named)
    rows = tables.read(spark, sf_dir, "customer").withColumn("r", P.tail_city(venue, "Óbidos"))
    return rows.select(k.alias("id"), "r.venue", "r.city")


@query(O.sql(f"""SELECT CAST(count(*) AS BIGINT) AS scanned, count(*) FILTER (was <> now) AS changed, count(*) FILTER (was = now) AS unchanged
  FROM (SELECT id, array_to_string([{O.arr([*C.CATEGORY_ALIASES, *C.CATEGORIES, *C.DROPPED_CATEGORIES, "Magia", "circo"])}[CAST(id % 79 AS INTEGER) + 1]], '|') AS was FROM cat_events) JOIN
  (SELECT id, coalesce(string_agg(label, '|' ORDER BY rank, label COLLATE pt), '') AS now FROM (SELECT DISTINCT id, CASE WHEN norm IS NULL THEN label ELSE canonical END AS label, coalesce(rank, {len(C.CATEGORIES)}) AS rank
  FROM (SELECT id, {O.arr([*C.CATEGORY_ALIASES, *C.CATEGORIES, *C.DROPPED_CATEGORIES, "Magia", "circo"])}[CAST(id % 79 AS INTEGER) + 1] AS label FROM cat_events) LEFT JOIN tax ON norm = {O.norm_title('label')}) GROUP BY id) USING (id)""", TAXONOMY))
def recategorised(spark, sf_dir):
    """Events scanned, changed and unchanged by rewriting their categories to the taxonomy."""
    from agendry.bound.texts import LABELS
    from agendry.plans.catalog import recategorise

    events = tables.events(spark, sf_dir).select("id", F.array(pick(LABELS, F.col("id"))).alias("categories"))
    done = recategorise(events)
    return done.agg(F.count("*").alias("scanned"), F.count_if("changed").alias("changed"), F.count_if(~F.col("changed")).alias("unchanged"))


@query(O.sql("SELECT id, title || CASE WHEN id % 4 = 2 THEN '|Música' ELSE '' END AS categories FROM cat_events"))
def pseudo_labels(spark, sf_dir):
    """Categories without the channel names among them."""
    k = F.col("id")
    extra = F.when(k % 4 == 0, F.array(F.lit("Evento"))).when(k % 4 == 1, F.array(F.lit("Homepage | Agenda"), F.lit("Newsletter | Evento Destaque"))).when(k % 4 == 2, F.array(F.lit("Música"))).otherwise(F.array(F.lit("Newsletter | Eventos Listagem")))
    return tables.events(spark, sf_dir).select("id", F.array_join(P.drop_pseudo(F.concat(F.array("title"), extra)), "|").alias("categories"))
