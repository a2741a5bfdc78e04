from __future__ import annotations

from pyspark.sql import functions as F

from agendry import constants as C, oracle as O, tables
from agendry.functions import dates as D, places as P, text as T
from agendry.registry import query

FIRST = "split_part(text, chr(10), 1)"


def titles(spark, sf_dir):
    """doc_id and the first line of each document."""
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), "source")


def _title(fn_sql: str) -> str:
    return f"SELECT doc_id, {fn_sql} AS value FROM documents"


@query(_title(O.norm_title(FIRST)))
def norm_title(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.norm_title(F.col("title")).alias("value"))


@query(_title(O.norm_title_ascii(FIRST)))
def norm_title_ascii(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.norm_title_ascii(F.col("title")).alias("value"))


@query(_title(O.norm_place(FIRST)))
def norm_place(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.norm_place(F.col("title")).alias("value"))


@query(_title(O.slugify(FIRST)))
def slugify(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.slugify(F.col("title")).alias("value"))


@query(_title(O.fold(FIRST)))
def fold(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.fold(F.col("title")).alias("value"))


@query(f"SELECT doc_id, array_to_string({O.title_core('t')}, ' ') AS core FROM (SELECT doc_id, 'Festival de ' || doc_id % 90 || ' ' || {FIRST} AS t FROM documents)")
def title_core(spark, sf_dir):
    t = F.concat(F.lit("Festival de "), (F.col("doc_id") % 90).cast("string"), F.lit(" "), F.col("title"))
    return titles(spark, sf_dir).select("doc_id", F.array_join(T.title_core(t), " ").alias("core"))


PREFIX = ["Centro Cultural ", "Teatro ", "Galeria de Arte da ", "", "Vários Espaços ", "Biblioteca Municipal "]
CITY = ["Leiria", "Óbidos (vila)", "Leiria e arredores", "Caldas da Rainha", ""]
PART_VENUES = f"pv AS (SELECT p_partkey AS id, {O.arr(PREFIX)}[CAST(p_partkey % 6 AS INTEGER) + 1] || CASE WHEN p_partkey % 4 = 0 THEN 'Leiria' ELSE p_name END || CASE WHEN p_partkey % 5 = 0 THEN '  da Cidade' ELSE '' END AS name, {O.arr(CITY)}[CAST(p_partkey % 5 AS INTEGER) + 1] AS city FROM part)"


def pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int") + 1)


def part_venues(spark, sf_dir):
    """Venue names of several kinds, made of part names."""
    k = F.col("p_partkey")
    name = F.concat(pick(PREFIX, k), F.when(k % 4 == 0, "Leiria").otherwise(F.col("p_name")), F.when(k % 5 == 0, "  da Cidade").otherwise(""))
    return tables.read(spark, sf_dir, "part").select(k.alias("id"), name.alias("name"), pick(CITY, k).alias("city"))


@query(f"WITH {PART_VENUES} SELECT id, array_to_string({O.venue_tokens('name', 'city')}, ' ') AS tokens, {O.norm_city('city')} AS city FROM pv")
def venue_tokens(spark, sf_dir):
    v = part_venues(spark, sf_dir)
    return v.select("id", F.array_join(T.venue_tokens(F.col("name"), F.col("city")), " ").alias("tokens"), T.norm_city(F.col("city")).alias("city"))


@query(f"WITH {PART_VENUES} SELECT id, {O.is_vague('name', 'city')} AS vague FROM pv")
def vague_venues(spark, sf_dir):
    return part_venues(spark, sf_dir).select("id", T.is_vague(F.col("name"), F.col("city")).alias("vague"))


@query(f"SELECT doc_id, array_to_string(list_transform(string_split(regexp_replace(s, '[_-]+', ' ', 'g'), ' '), lambda w: replace(upper(w[1:1]), 'ẞ', 'SS') || w[2:]), ' ') AS title FROM (SELECT doc_id, {O.slugify(FIRST)} AS s FROM documents)")
def slug_titles(spark, sf_dir):
    return titles(spark, sf_dir).select("doc_id", T.slug_to_title(T.slugify(F.col("title"))).alias("title"))


@query(r"""SELECT page_id, 'site-' || regexp_replace(regexp_replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/+$', ''), '[^A-Za-z0-9]+', '-', 'g') AS source_id FROM pages""")
def source_ids(spark, sf_dir):
    tail = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/+$", "")
    return tables.read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("site-"), F.regexp_replace(tail, "[^A-Za-z0-9]+", "-")).alias("source_id"))


@query(f"""SELECT doc_id, CASE WHEN contains(t, '@') AND trim(regexp_replace(t, '@[^@]*$', '')) <> '' AND length(v) BETWEEN 1 AND 60 THEN v END AS venue
  FROM (SELECT doc_id, t, trim(regexp_extract(t, '([^@]*)$', 1)) AS v FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(split_part(text, chr(10), 1), '@', '') ELSE split_part(text, chr(10), 1) || ' @ ' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE source END END AS t FROM documents))""")
def title_suffix_venue(spark, sf_dir):
    n = F.col("doc_id")
    t = F.when(n % 3 == 0, F.replace("title", F.lit("@"), F.lit(""))).otherwise(F.concat("title", F.lit(" @ "), F.when(n % 5 == 0, "").otherwise(F.col("source"))))
    return titles(spark, sf_dir).select("doc_id", T.title_venue(t).alias("venue"))


ORD = "o AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(8 + o_orderkey % 16 AS INTEGER) AS h, CAST(o_orderkey % 60 AS INTEGER) AS mi FROM orders)"


def order_days(spark, sf_dir):
    k = F.col("o_orderkey")
    return tables.read(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderdate").cast("date").alias("d"), (k % 16 + 8).cast("int").alias("h"), (k % 60).cast("int").alias("mi"))


def two(c):
    return F.lpad(c.cast("string"), 2, "0")


@query(f"WITH {ORD} SELECT id, {O.epoch_of('CAST(d AS TIMESTAMP) + CASE WHEN id % 3 = 0 THEN INTERVAL 0 MINUTE ELSE to_minutes(h * 60 + mi) END')} AS t FROM o")
def pt_dates(spark, sf_dir):
    """Portuguese long dates, full or short months, with or without a time, read back to epochs."""
    months = F.element_at(F.array(*[F.lit(m) for m in C.MONTHS]), F.month("d"))
    month = F.when(F.col("id") % 2 == 0, months).otherwise(F.substring(months, 1, 3))
    time = F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit(", às "), two(F.col("h")), F.lit("h"), two(F.col("mi"))))
    text = F.concat(F.lit("Sábado, "), F.dayofmonth("d").cast("string"), F.when(F.col("id") % 5 == 0, " ").otherwise(" de "), month, F.when(F.col("id") % 5 == 0, " ").otherwise(" de "), F.year("d").cast("string"), time)
    return order_days(spark, sf_dir).select("id", D.long_date(text).alias("t"))


@query(f"""WITH {ORD} SELECT id, CASE id % 4 WHEN 0 THEN {O.epoch_of('CAST(d AS TIMESTAMP)')} WHEN 1 THEN {O.epoch_of('CAST(d AS TIMESTAMP) + to_minutes(h * 60 + mi)')}
  WHEN 2 THEN CAST(epoch(CAST(d AS TIMESTAMP) + to_minutes(h * 60 + mi)) AS BIGINT) ELSE CAST(epoch(CAST(d AS TIMESTAMP) + to_minutes(h * 60 + mi)) AS BIGINT) - 7200 END AS t FROM o""")
def iso_dates(spark, sf_dir):
    """Dates alone and bare wall clocks are Lisbon's; Z and offsets name instants."""
    day = F.date_format("d", "yyyy-MM-dd")
    clock = F.concat(day, F.lit("T"), two(F.col("h")), F.lit(":"), two(F.col("mi")), F.lit(":00"))
    k = F.col("id") % 4
    text = F.when(k == 0, day).when(k == 1, clock).when(k == 2, F.concat(clock, F.lit("Z"))).otherwise(F.concat(clock, F.lit("+02:00")))
    return order_days(spark, sf_dir).select("id", D.iso_epoch(text).alias("t"))


@query(f"WITH {ORD} SELECT id, {O.epoch_of('CAST(d AS TIMESTAMP)')} AS first, {O.epoch_of('CAST(d + h AS TIMESTAMP)')} AS last FROM o")
def date_ranges(spark, sf_dir):
    """First and last of the dotted or slashed dates in a chunk of text; two-digit years pivot at 70."""
    a, b = F.col("d"), F.date_add("d", F.col("h"))
    dotted = F.concat(F.lit("de "), F.date_format(b, "d.M.yy"), F.lit(" desde "), F.date_format(a, "d.M.yyyy"))
    slashed = F.concat(F.date_format(a, "yyyy/MM/dd"), F.lit(" - "), F.date_format(b, "dd/MM/yyyy"))
    text = F.when(F.col("id") % 2 == 0, dotted).otherwise(slashed)
    found = F.regexp_extract_all(text, F.lit(r"\d{4}/\d{1,2}/\d{1,2}|\d{1,2}[./]\d{1,2}[./]\d{2,4}"), F.lit(0))

    def epoch(s):
        p = F.split(s, "[./]")
        iso = s.rlike(r"^\d{4}/")
        y = F.when(iso, p[0]).otherwise(p[2]).cast("int")
        year = F.when(y >= 100, y).when(y >= 70, y + 1900).otherwise(y + 2000)
        return D.wall_clock(year, p[1], F.when(iso, p[2]).otherwise(p[0]))

    all_ = F.transform(found, epoch)
    return order_days(spark, sf_dir).select("id", F.array_min(all_).alias("first"), F.array_max(all_).alias("last"))


@query(f"""WITH {ORD}, c AS (SELECT id, d, make_date(year(d) + CASE WHEN month(e) * 100 + day(e) < month(d) * 100 + day(d) THEN 1 ELSE 0 END, month(e), day(e)) AS after_published, make_date(year(d), month(e), day(e)) AS this, make_date(year(d) + 1, month(e), day(e)) AS next
  FROM (SELECT *, make_date(2001, month(d + h * 15), least(day(d + h * 15), 28)) AS e FROM o))
  SELECT id, CAST(after_published AS VARCHAR) AS after_published, CAST(CASE WHEN this >= d - 1 THEN this WHEN next <= d + 150 THEN next END AS VARCHAR) AS within_horizon FROM c""")
def year_inference(spark, sf_dir):
    """The year of a month and day: not before the publication; or this year, else the next within 150 days."""
    e = F.date_add("d", F.col("h") * 15)
    m, dd = F.month(e), F.least(F.dayofmonth(e), F.lit(28))
    before = m * 100 + dd < F.month("d") * 100 + F.dayofmonth("d")
    this, nxt = F.make_date(F.year("d"), m, dd), F.make_date(F.year("d") + 1, m, dd)
    horizon = F.when(this >= F.date_sub("d", 1), this).when(nxt <= F.date_add("d", 150), nxt)
    return order_days(spark, sf_dir).select("id", F.when(before, nxt).otherwise(this).cast("string").alias("after_published"), horizon.cast("string").alias("within_horizon"))


PLACES = [*C.MUNICIPALITIES, "São Pedro de Moel", "Ordem", "Vau", "Leira", "Leiria e arredores", "Lisboa", "Oleiros", "Coimbra", "?", "N/D", "", "Mira d'Aire", "Telhada", "Foz do Arelho"]
CUST = f"cu AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 1 THEN upper(p) WHEN 2 THEN replace(p, ' ', '-') ELSE p END AS city, c_name AS venue FROM (SELECT *, {O.arr(PLACES)}[CAST(c_custkey % {len(PLACES)} AS INTEGER) + 1] AS p FROM customer))"
DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"({O.lit(n)}, {O.lit(m)}, {O.lit(k)})" for n, m, k in P.place_rows()) + ") AS t(norm, municipality, kind))"


def customer_places(spark, sf_dir):
    k, p = F.col("c_custkey"), pick(PLACES, F.col("c_custkey"))
    return tables.read(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 3 == 1, F.upper(p)).when(k % 3 == 2, F.replace(p, F.lit(" "), F.lit("-"))).otherwise(p).alias("city"), F.col("c_name").alias("venue"))


@query(f"WITH {CUST}, {DIM} SELECT id, municipality, coalesce(municipality, city, '') AS label FROM cu LEFT JOIN dim ON norm = {O.norm_place('city')}")
def place_fold(spark, sf_dir):
    return P.with_municipality(customer_places(spark, sf_dir), "city").select("id", "municipality", F.coalesce("municipality", "city", F.lit("")).alias("label"))


def _gate(x):
    n = O.norm_place(f"coalesce({x}, '')")
    return f"({n} NOT IN ('', '?', 'n/d') AND (regexp_matches({n}, '(^|[^a-z])leir') OR list_contains({O.arr([*P.MUNICIPALITY, *P.LOCALITIES])}, {n})))"


GATED = f"ga AS (SELECT id, city, CASE id % 10 WHEN 0 THEN 'Bar O Pica Miolos' WHEN 1 THEN 'Castelo de Leiria' ELSE venue END AS venue FROM cu)"


@query(f"""WITH {CUST}, {GATED} SELECT id, {_gate('city')} AS in_district, {O.norm_place('city')} NOT IN ('', '?', 'n/d') AND list_contains({O.arr(P.LOCALITIES)}, {O.norm_place('city')}) AS locality,
  {_gate('city')} OR {_gate('venue')} OR contains(' ' || {O.norm_title('venue')} || ' ', ' pica miolos ') AS in_scope FROM ga""")
def district_gate(spark, sf_dir):
    g = customer_places(spark, sf_dir).withColumn("venue", F.when(F.col("id") % 10 == 0, "Bar O Pica Miolos").when(F.col("id") % 10 == 1, "Castelo de Leiria").otherwise(F.col("venue")))
    city, venue = F.col("city"), F.col("venue")
    return g.select("id", P.in_district(city).alias("in_district"), P.is_locality(city).alias("locality"), P.in_scope(city, venue).alias("in_scope"))


NAMED = "na AS (SELECT id, CASE id % 4 WHEN 0 THEN city || ' (cidade)' WHEN 1 THEN city || ', ' || city WHEN 2 THEN city || ' &amp; ' || venue ELSE city END AS name FROM cu)"


@query(f"""WITH {CUST}, {NAMED} SELECT id, CASE WHEN list_contains({O.arr([*P.MUNICIPALITY, *C.MUNICIPALITY_ALIASES])}, n) THEN 'concelho' WHEN list_contains({O.arr(sorted(P.PARISH))}, n) THEN 'lugar' ELSE 'venue' END AS scope
  FROM (SELECT id, {O.norm_place(r"trim(regexp_replace(regexp_extract(replace(name, '&amp;', '&'), '^[^,/]*'), '\s*\([^)]*\)\s*$', ''))")} AS n FROM na)""")
def record_scope(spark, sf_dir):
    k, city = F.col("id"), F.col("city")
    name = F.when(k % 4 == 0, F.concat(city, F.lit(" (cidade)"))).when(k % 4 == 1, F.concat(city, F.lit(", "), city)).when(k % 4 == 2, F.concat(city, F.lit(" &amp; "), "venue")).otherwise(city)
    return customer_places(spark, sf_dir).select("id", P.record_scope(name).alias("scope"))


@query(f"""WITH {CUST} SELECT id, CASE {' '.join(f"WHEN contains(' ' || t || ' ', ' {p} ') THEN {O.lit(P.MUNICIPALITY[p])}" for p in (*C.TITLE_PHRASES, *C.TITLE_SINGLES))} END AS place
  FROM (SELECT id, {O.norm_title("'Festa em ' || city || ' ' || venue")} AS t FROM cu)""")
def title_place(spark, sf_dir):
    return customer_places(spark, sf_dir).select("id", P.title_place(F.concat(F.lit("Festa em "), "city", F.lit(" "), "venue")).alias("place"))


LABELS = [*C.CATEGORY_ALIASES, *C.CATEGORIES, *C.DROPPED_CATEGORIES, "Magia", "circo"]
RAW = f"raw AS (SELECT id, unnest([{O.arr(LABELS)}[CAST(id % {len(LABELS)} AS INTEGER) + 1], upper({O.arr(LABELS)}[CAST(id * 7 % {len(LABELS)} AS INTEGER) + 1]), title]) AS label FROM cat_events)"
TAXONOMY = "tax AS (SELECT * FROM (VALUES " + ", ".join(f"({O.lit(n)}, {'NULL' if c is None else O.lit(c)}, {r})" for n, c, r in P.category_rows()) + ") AS t(norm, canonical, rank))"


def raw_labels(spark, sf_dir):
    k = F.col("id")
    return tables.events(spark, sf_dir).select("id", F.array(pick(LABELS, k), F.upper(pick(LABELS, k * 7)), F.col("title")).alias("labels"))


@query(O.sql(f"""SELECT id, coalesce(string_agg(label, '|' ORDER BY rank, label COLLATE pt), '') AS categories FROM (SELECT DISTINCT id, CASE WHEN norm IS NULL THEN label ELSE canonical END AS label, coalesce(rank, {len(C.CATEGORIES)}) AS rank
  FROM raw LEFT JOIN tax ON norm = {O.norm_title('label')}) GROUP BY id""", RAW, TAXONOMY))
def canonical_categories(spark, sf_dir):
    return P.canonical_categories(raw_labels(spark, sf_dir), "id", "labels").select("id", F.array_join("categories", "|").alias("categories"))


@query(O.sql(f"SELECT label, count(*) AS count FROM raw WHERE {O.norm_title('label')} NOT IN (SELECT norm FROM tax) GROUP BY 1", RAW, TAXONOMY))
def unmapped_labels(spark, sf_dir):
    return P.unmapped_labels(raw_labels(spark, sf_dir).select(F.explode("labels").alias("label")))


EV = "ev AS (SELECT e.id, e.title, e.start_at, v.name AS venue FROM cat_events e LEFT JOIN cat_venues v ON v.id = e.venue_id)"
PRINT = f"sha1({O.norm_title('title')} || '|' || {O.slugify(O.norm_venue(chr(99) + 'oalesce(venue, ' + chr(39) * 2 + ')'))} || '|' || {O.lisbon_minute('start_at')})"


def venue_events(spark, sf_dir):
    v = tables.venues(spark, sf_dir).select(F.col("id").alias("venue_id"), F.col("name").alias("venue"))
    return tables.events(spark, sf_dir).join(v, "venue_id", "left")


@query(O.sql(f"SELECT id, {PRINT} AS fingerprint, sha1({O.norm_title('title')} || '|' || {O.slugify(O.norm_venue('coalesce(venue, ' + chr(39) * 2 + ')'))} || '|UNDATED') AS undated FROM ev", EV))
def fingerprints(spark, sf_dir):
    t, v, s = F.col("title"), F.col("venue"), F.col("start_at")
    return venue_events(spark, sf_dir).select("id", P.fingerprint(t, v, s).alias("fingerprint"), P.fingerprint_undated(t, v).alias("undated"))


@query(O.sql(f"SELECT id, {O.norm_title('title')} || '|' || {O.slugify('coalesce(venue, ' + chr(39) * 2 + ')')} || '|' || {O.lisbon_day('start_at')} AS identity, {O.norm_title('title')} || '|' || {O.lisbon_day('start_at')} AS day_key FROM ev", EV))
def identity_keys(spark, sf_dir):
    t, v, s = F.col("title"), F.col("venue"), F.col("start_at")
    return venue_events(spark, sf_dir).select("id", P.identity_key(t, v, s).alias("identity"), P.day_key(t, s).alias("day_key"))


@query(O.sql(f"SELECT id, CASE WHEN {O.slugify('title')} = '' THEN 'evento' ELSE {O.slugify('title')} END || '-' || left({PRINT}, 12) AS slug FROM (SELECT id, CASE WHEN id % 11 = 0 THEN '!!' ELSE title END AS title, start_at, venue FROM ev)", EV))
def public_slugs(spark, sf_dir):
    rows = venue_events(spark, sf_dir).withColumn("title", F.when(F.col("id") % 11 == 0, "!!").otherwise(F.col("title")))
    return rows.select("id", P.public_slug(F.col("title"), P.fingerprint(F.col("title"), F.col("venue"), F.col("start_at"))).alias("slug"))


@query(O.sql(f"SELECT event_id, CAST(min(coalesce(list_position({O.arr(C.TRUST)}, source) - 1, {len(C.TRUST)})) AS INTEGER) AS trust FROM cat_sources GROUP BY 1"))
def source_trust(spark, sf_dir):
    return tables.event_sources(tables.events(spark, sf_dir)).groupBy("event_id").agg(F.min(P.trust(F.col("source"))).alias("trust"))
