from __future__ import annotations

from pyspark.sql import functions as F

from agendry import constants as C, oracle as O, tables
from agendry.bound.entities import cc, sql as rsql
from agendry.bound.texts import venue_events
from agendry.functions import places as P, text as T
from agendry.functions.dates import lisbon_day, lisbon_minute
from agendry.operators import geo as G
from agendry.plans import catalog as K, export as E
from agendry.registry import query
from agendry.streaming.jobs import home_of
from agendry.runtime import cut, spread

PAST = C.NOW - 8 * C.DAY
VENUE = "coalesce(venue, '')"
PRINT = f"sha1({O.norm_title('title')} || '|' || {O.slugify(O.norm_venue(VENUE))} || '|' || {O.lisbon_minute('start_at')})"
FULL = f"""fu AS (SELECT e.*, v.name AS venue, v.city FROM cat_events e LEFT JOIN cat_venues v ON v.id = e.venue_id),
oldc AS (SELECT *, source_event_id AS slug, {PRINT} AS fingerprint, CASE WHEN id % 5 <> 1 THEN 'u' || id END AS url, {O.lisbon_day('start_at')} AS day FROM fu WHERE id % 3 <> 0 AND date_text IS NULL),
raw AS (SELECT id AS ordinal, title, venue, source, source_event_id AS slug, start_at + id % 4 * 600 AS start_at, end_at, list_concat(categories, CASE WHEN id % 7 = 0 THEN ['extra'] ELSE [] END) AS categories, CASE WHEN id % 2 = 0 THEN 'u' || id END AS url FROM fu WHERE id % 4 <> 1 AND date_text IS NULL),
rk AS (SELECT *, {PRINT} AS fingerprint, {O.lisbon_day('start_at')} AS day FROM raw WHERE coalesce(end_at, start_at) >= {PAST}),
rm AS (SELECT rk.*, coalesce((SELECT min(o.id) FROM oldc o WHERE o.fingerprint = rk.fingerprint), (SELECT min(o.id) FROM oldc o WHERE o.source = rk.source AND o.slug = rk.slug AND o.day = rk.day)) AS event_id FROM rk),
fresh AS (SELECT ordinal AS id, * FROM rm WHERE event_id IS NULL),
fe AS (SELECT ordinal AS dst, min(ordinal) OVER (PARTITION BY fingerprint) AS src FROM fresh UNION SELECT ordinal, min(ordinal) OVER (PARTITION BY source, slug, day) FROM fresh WHERE slug IS NOT NULL)"""


def old_catalogue(spark, sf_dir):
    rows = spread(venue_events(spark, sf_dir).where("id % 3 <> 0 and date_text is null"), "id").withColumnRenamed("source_event_id", "slug")
    return rows.withColumn("fingerprint", P.fingerprint(F.col("title"), F.col("venue"), F.col("start_at"))).withColumn("url", F.when(F.col("id") % 5 != 1, F.concat(F.lit("u"), F.col("id").cast("string"))))


def raw_batch(spark, sf_dir):
    k = F.col("id")
    rows = spread(venue_events(spark, sf_dir).where("id % 4 <> 1 and date_text is null"), "id")
    labels = F.when(k % 7 == 0, F.array_append("categories", F.lit("extra"))).otherwise(F.col("categories"))
    return rows.select(k.alias("ordinal"), "title", "venue", "source", F.col("source_event_id").alias("slug"), (F.col("start_at") + k % 4 * 600).alias("start_at"), "end_at", labels.alias("categories"), F.when(k % 2 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("url"))


@query(rsql(f"""SELECT ordinal, CASE WHEN len(list_filter(rm.categories, lambda c: NOT list_contains(o.categories, c))) > 0 OR (o.end_at IS NULL AND rm.end_at IS NOT NULL) OR (o.url IS NULL AND rm.url IS NOT NULL) THEN 'updated' ELSE 'unchanged' END AS action, event_id
  FROM rm JOIN oldc o ON o.id = event_id UNION ALL SELECT id, CASE WHEN id = component THEN 'new' ELSE 'merged' END, -component FROM fcc UNION ALL SELECT ordinal, 'skipped_past', NULL FROM raw WHERE coalesce(end_at, start_at) < {PAST}""", FULL, cc("fresh", "fe", "fcc")))
def upsert_batch(spark, sf_dir):
    return K.upsert(raw_batch(spark, sf_dir), old_catalogue(spark, sf_dir), PAST)


SEEN_IN = f"si AS (SELECT event_id AS id, s.source, s.source_event_id, {O.lisbon_day('start_at')} AS day FROM cat_sources s JOIN cat_events e ON e.id = event_id WHERE s.source_event_id IS NOT NULL)"


@query(O.sql("SELECT DISTINCT a.id, b.id AS prior_id FROM si a JOIN si b USING (source, source_event_id, day) WHERE a.id > b.id", SEEN_IN))
def prior_occurrence(spark, sf_dir):
    """Earlier rows of the same source item on the same Lisbon day."""
    ev = tables.events(spark, sf_dir)
    days = ev.select(F.col("id").alias("event_id"), lisbon_day(F.col("start_at")).alias("day"))
    seen = tables.event_sources(ev).where("source_event_id is not null").join(days, "event_id").withColumnRenamed("event_id", "id")
    prior = seen.withColumnRenamed("id", "prior_id")
    return seen.join(prior, ["source", "source_event_id", "day"]).where("id > prior_id").select("id", "prior_id").distinct()


@query(O.sql(f"SELECT id FROM cat_events e WHERE date_text IS NOT NULL AND EXISTS (SELECT 1 FROM cat_events d WHERE d.date_text IS NULL AND d.id % 9 = 4 AND d.title = e.title AND d.venue_id = e.venue_id)"))
def ghost_cleanup(spark, sf_dir):
    """Undated events whose dated twin came; venues here are told apart by their number."""
    ev = tables.events(spark, sf_dir).withColumn("venue", F.concat(F.lit("Venue "), F.col("venue_id").cast("string")))
    return K.ghosts(ev.where("id % 9 = 4"), ev)


@query(O.sql(f"SELECT id, start_at, end_at FROM cat_events WHERE date_text IS NOT NULL OR coalesce(end_at, start_at) >= {C.NOW}"))
def purge(spark, sf_dir):
    return K.purge(tables.events(spark, sf_dir), C.NOW).select("id", "start_at", "end_at")


@query(O.sql(f"SELECT event_id, cat_sources.source FROM cat_sources JOIN cat_events ON id = event_id WHERE date_text IS NOT NULL OR coalesce(end_at, start_at) >= {C.NOW}"))
def cascade_delete(spark, sf_dir):
    ev = tables.events(spark, sf_dir)
    return K.cascade(tables.event_sources(ev), K.purge(ev, C.NOW)).select("event_id", "source")


@query(O.sql(f"SELECT id, date_text IS NULL AND coalesce(end_at, start_at) < {C.NOW} AS expired FROM cat_events"))
def expiry_flags(spark, sf_dir):
    return tables.events(spark, sf_dir).select("id", K.is_expired(F.col("start_at"), F.col("end_at"), F.col("date_text"), C.NOW).alias("expired"))


@query(O.sql(f"SELECT id, CASE WHEN id % 13 = 0 THEN 'missing' WHEN date_text IS NOT NULL THEN 'undated' WHEN coalesce(end_at, start_at) < {C.NOW - C.DAY} THEN 'past' END AS drop_reason FROM cat_events"))
def drop_reasons(spark, sf_dir):
    """Why a row is dropped, first reason first; sources that tolerate a day keep what ended yesterday."""
    title = F.when(F.col("id") % 13 == 0, None).otherwise(F.col("title"))
    over = ~K.alive(F.col("start_at"), F.col("end_at"), C.NOW - C.DAY)
    return tables.events(spark, sf_dir).select("id", F.when(title.isNull(), "missing").when(F.col("date_text").isNotNull(), "undated").when(over, "past").alias("drop_reason"))


@query(O.sql("SELECT id, title, source FROM cat_events WHERE id % 6 <> 0 AND id % 10 <> 0 AND title <> ''"))
def row_exclusions(spark, sf_dir):
    """Cancelled and online rows and rows without id, title or date go."""
    k = F.col("id")
    rows = tables.events(spark, sf_dir).withColumns({"is_cancelled": k % 6 == 0, "is_online": k % 10 == 0})
    return rows.where(~F.col("is_cancelled") & ~F.col("is_online") & k.isNotNull() & (F.coalesce("title", F.lit("")) != "") & F.col("start_at").isNotNull()).select("id", "title", "source")


@query(O.sql(f"""SELECT 'catalogue' AS step, count(*) AS n FROM cat_events UNION ALL SELECT 'purged', count(*) FROM cat_events WHERE date_text IS NULL AND coalesce(end_at, start_at) < {C.NOW}
  UNION ALL SELECT 'attributions', count(*) FROM cat_sources JOIN cat_events ON id = event_id WHERE date_text IS NOT NULL OR coalesce(end_at, start_at) >= {C.NOW}
  UNION ALL SELECT 'items', count(DISTINCT (source, source_event_id)) FROM cat_events WHERE source_event_id IS NOT NULL AND (date_text IS NOT NULL OR coalesce(end_at, start_at) >= {C.NOW})"""))
def maintenance_cycle(spark, sf_dir):
    """Rows after each step of a cycle: catalogue, purge, cascade, one row for each source item."""
    ev = tables.events(spark, sf_dir)
    left = cut(K.purge(ev, C.NOW))
    steps = [("catalogue", ev), ("purged", ev.join(left.select("id"), "id", "left_anti")), ("attributions", K.cascade(tables.event_sources(ev), left)), ("items", K.first_wins(left.where("source_event_id is not null"), ["source", "source_event_id"], ["start_at", "id"]))]
    out = None
    for name, df in steps:
        one = df.agg(F.lit(name).alias("step"), F.count("*").alias("n"))
        out = one if out is None else out.union(one)
    return out


@query(O.sql("SELECT source, source_event_id AS slug, min(id) AS id FROM (SELECT * FROM cat_events WHERE source_event_id IS NOT NULL UNION ALL SELECT 100000000 + s_suppkey, 'Manual', 0, NULL, s_suppkey, NULL, [], 'manual', 'p' || (s_suppkey % 40) FROM supplier) GROUP BY ALL"))
def manual_row(spark, sf_dir):
    """Pasted links join the catalogue under the source "manual", once for each item."""
    have = K.first_wins(tables.events(spark, sf_dir).where("source_event_id is not null").select("source", F.col("source_event_id").alias("slug"), "id"), ["source", "slug"], ["id"])
    k = F.col("s_suppkey")
    pasted = tables.read(spark, sf_dir, "supplier").select(F.lit("manual").alias("source"), F.concat(F.lit("p"), (k % 40).cast("string")).alias("slug"), (k + 100000000).alias("id"))
    return K.insert_ignore(have, pasted, ["source", "slug"], ["id"])


PAGES = "pg AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, 1700000000 + page_id % 97 * 3600 AS lastmod FROM pages), known AS (SELECT url, max(lastmod) AS lastmod FROM pg WHERE page_id % 3 = 0 GROUP BY 1), latest AS (SELECT url, max(lastmod) + CASE WHEN min(page_id) % 2 = 0 THEN 1 ELSE 0 END AS lastmod FROM pg GROUP BY 1)"


def page_urls(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), (F.lit(1700000000).cast("bigint") + F.col("page_id") % 97 * 3600).alias("lastmod"))


def known_urls(spark, sf_dir):
    return page_urls(spark, sf_dir).where("page_id % 3 = 0").groupBy("url").agg(F.max("lastmod").alias("lastmod"))


def latest_urls(spark, sf_dir):
    return page_urls(spark, sf_dir).groupBy("url").agg((F.max("lastmod") + F.when(F.min("page_id") % 2 == 0, 1).otherwise(0)).alias("lastmod"))


@query("WITH " + PAGES + " SELECT url, lastmod FROM latest WHERE url NOT IN (SELECT url FROM known) ORDER BY lastmod DESC, url LIMIT 400")
def fetch_frontier(spark, sf_dir):
    """What to fetch next: unseen urls, latest first, up to a run's budget of 400."""
    return latest_urls(spark, sf_dir).join(known_urls(spark, sf_dir).select("url"), "url", "left_anti").orderBy(F.desc("lastmod"), "url").limit(400)


@query("WITH " + PAGES + " SELECT l.url, l.lastmod FROM latest l LEFT JOIN known k USING (url) WHERE k.lastmod IS DISTINCT FROM l.lastmod")
def changed_urls(spark, sf_dir):
    old = known_urls(spark, sf_dir).withColumnRenamed("lastmod", "before")
    return latest_urls(spark, sf_dir).join(old, "url", "left").where(~F.col("before").eqNullSafe(F.col("lastmod"))).select("url", "lastmod")


@query("WITH " + PAGES + " SELECT page_id, url FROM pg WHERE url NOT IN (SELECT url FROM known)")
def seen_exclusion(spark, sf_dir):
    return page_urls(spark, sf_dir).join(known_urls(spark, sf_dir).select("url"), "url", "left_anti").select("page_id", "url")


@query("WITH " + PAGES + " SELECT url, max(lastmod) AS lastmod FROM (SELECT * FROM known UNION ALL SELECT url, lastmod FROM pg WHERE page_id % 3 = 1) WHERE url IN (SELECT url FROM pg WHERE page_id % 5 <> 0) GROUP BY 1")
def state_update(spark, sf_dir):
    """Seen and fetched together, the latest lastmod of each, pruned to urls that are still listed."""
    fetched = page_urls(spark, sf_dir).where("page_id % 3 = 1").select("url", "lastmod")
    live = page_urls(spark, sf_dir).where("page_id % 5 <> 0").select("url")
    return known_urls(spark, sf_dir).union(fetched).groupBy("url").agg(F.max("lastmod").alias("lastmod")).join(live, "url", "left_semi")


CARDS = "ca AS (SELECT source, CAST(start_at % 86400 // 3600 AS INTEGER) AS page, 'u' || (venue_id % 30) AS url FROM cat_events)"


@query(O.sql("""SELECT DISTINCT source, page, url FROM ca WHERE page <= coalesce((SELECT min(page) FROM (SELECT DISTINCT source AS s, page FROM ca) p WHERE s = ca.source AND NOT EXISTS
  (SELECT 1 FROM (SELECT source, url, min(page) AS f FROM ca GROUP BY ALL) x WHERE x.source = p.s AND x.f = p.page)), 99)""", CARDS))
def novel_page_stop(spark, sf_dir):
    page = F.floor(F.col("start_at") % 86400 / 3600).cast("int")
    cards = tables.events(spark, sf_dir).select("source", page.alias("page"), F.concat(F.lit("u"), (F.col("venue_id") % 30).cast("string")).alias("url")).distinct()
    return K.until_stale(cards)


ITEMS = f"it AS (SELECT source, {O.lisbon_day('start_at')} AS day, start_at AS ts, id % 3 = 0 AS is_new, CASE WHEN title = 'error' THEN 'bad row ' || id END AS error FROM cat_events)"


def run_items(spark, sf_dir):
    k = F.col("id")
    return tables.events(spark, sf_dir).select("source", lisbon_day(F.col("start_at")).alias("day"), F.col("start_at").alias("at"), (k % 3 == 0).alias("is_new"), F.when(F.col("title") == "error", F.concat(F.lit("bad row "), k.cast("string"))).alias("error"))


@query(O.sql("SELECT source, day, min(ts) AS started_at, count(*) AS items_found, count(*) FILTER (is_new) AS items_new, count(error) AS items_failed, arg_min(error, (ts, error)) FILTER (error IS NOT NULL) AS first_error FROM it GROUP BY ALL", ITEMS))
def run_log(spark, sf_dir):
    return K.run_log(run_items(spark, sf_dir))


@query(O.sql(f"""SELECT source, day FROM (SELECT *, lag(n) OVER (PARTITION BY source ORDER BY day) AS p FROM (SELECT g.source, g.day, coalesce(f.n, 0) AS n FROM (SELECT source, strftime(d, '%Y-%m-%d') AS day FROM (SELECT DISTINCT source FROM fz),
  (SELECT unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM fz)) g LEFT JOIN fz f ON f.source = g.source AND f.day = g.day)) WHERE n = 0 AND p = 0""",
  f"fz AS (SELECT source, {O.lisbon_day('start_at')} AS day, count(*) AS n FROM cat_events WHERE venue_id % 50 = id % 50 GROUP BY ALL)"))
def zero_found_alert(spark, sf_dir):
    few = tables.events(spark, sf_dir).where("venue_id % 50 = id % 50").groupBy("source", lisbon_day(F.col("start_at")).alias("day")).agg(F.count("*").alias("n"))
    return K.zero_runs(few)


@query(O.sql("SELECT source, count(*) FILTER (id % 17 <> 0) AS ok, count(*) FILTER (id % 17 = 0) AS failed, arg_min('broken ' || id, id) FILTER (id % 17 = 0) AS first_error FROM cat_events GROUP BY 1"))
def run_isolation(spark, sf_dir):
    """Payloads are parsed row by row: a broken one is counted for its source and stops nothing."""
    k = F.col("id")
    payload = F.when(k % 17 == 0, F.concat(F.lit("broken "), k.cast("string"))).otherwise(F.to_json(F.struct("id", "title")))
    parsed = tables.events(spark, sf_dir).select("source", "id", payload.alias("payload")).withColumn("row", F.try_parse_json("payload"))
    bad = F.col("row").isNull()
    return parsed.groupBy("source").agg(F.count_if(~bad).alias("ok"), F.count_if(bad).alias("failed"), F.min_by("payload", F.when(bad, F.col("id"))).alias("first_error"))


@query(O.sql("SELECT id, title, venue_id FROM cat_events WHERE source = 'leiriagenda' OR (source IN ('bol', 'other') AND venue_id % 9 = 0) QUALIFY row_number() OVER (PARTITION BY title, venue_id ORDER BY source <> 'leiriagenda', id) = 1"))
def multi_hub_allowlist(spark, sf_dir):
    """All rows of the first hub, of the others only known venues; the first of an item wins."""
    ev = tables.events(spark, sf_dir)
    first = ev.where("source = 'leiriagenda'").withColumn("hub", F.lit(0))
    others = ev.where("source in ('bol', 'other') and venue_id % 9 = 0").withColumn("hub", F.lit(1))
    return K.first_wins(first.unionByName(others).select("id", "title", "venue_id", "hub"), ["title", "venue_id"], ["hub", "id"]).select("id", "title", "venue_id")


# Shapes in their order: a square with a hole, then two squares, then one that overlaps the first.
SQUARES = {"holed": [[(-9.0, 39.0, -8.7, 39.4), (-8.9, 39.1, -8.8, 39.3)]], "double": [[(-8.7, 39.0, -8.6, 39.2)], [(-8.7, 39.5, -8.5, 39.9)]], "wide": [[(-8.95, 39.05, -8.55, 39.85)]]}


def shapes(spark):
    ring = lambda b: [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]
    return spark.createDataFrame([(n, i, [[ring(b) for b in rings] for rings in polygons]) for i, (n, polygons) in enumerate(SQUARES.items())], G.SHAPES)


def _edges_sql():
    rows = []
    for i, (n, polygons) in enumerate(SQUARES.items()):
        for p, rings in enumerate(polygons):
            for b in rings:
                pts = [(b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3])]
                rows += [f"({i}, {O.lit(n)}, {p}, {x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1])]
    return "ed AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(ord, name, poly, x1, y1, x2, y2))"


POINTS = "pt AS (SELECT e.id, v.lng + (e.id % 40) / 100.0::DOUBLE AS x, v.lat - (e.id % 60) / 300.0::DOUBLE AS y, v.city FROM cat_events e JOIN cat_venues v ON v.id = e.venue_id)"
HIT = """hit AS (SELECT id, arg_min(name, ord) AS shape FROM (SELECT id, ord, name FROM pt JOIN ed ON y1 <> y2 AND (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 GROUP BY id, ord, name, poly HAVING count(*) % 2 = 1) GROUP BY 1)"""


def points(spark, sf_dir):
    v = tables.venues(spark, sf_dir).select(F.col("id").alias("venue_id"), "lat", "lng", "city")
    k = F.col("id")
    return tables.events(spark, sf_dir).join(v, "venue_id").select("id", (F.col("lng") + k % 40 / F.lit(100.0)).alias("x"), (F.col("lat") - k % 60 / F.lit(300.0)).alias("y"), "city")


@query(O.sql("SELECT pt.id, shape FROM pt LEFT JOIN hit USING (id)", POINTS, _edges_sql(), HIT))
def geo_pip(spark, sf_dir):
    return G.locate(points(spark, sf_dir), shapes(spark))


@query(O.sql("SELECT pt.id, shape FROM pt LEFT JOIN hit USING (id)", POINTS, _edges_sql(), HIT))
def geo_grid(spark, sf_dir):
    """geo_pip by the cells of a grid: an equi-join, and ray casts in border cells alone."""
    return G.locate_by_grid(points(spark, sf_dir), shapes(spark), 0.05)


@query(O.sql("SELECT shape, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, count(*) AS n FROM pt JOIN hit USING (id) GROUP BY 1", POINTS, _edges_sql(), HIT))
def geo_bbox(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.join(G.locate(p, shapes(spark)), "id").where("shape is not null").groupBy("shape").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count("*").alias("n"))


@query(O.sql("SELECT id, coalesce(shape, '-') AS shape, CASE WHEN shape IS NULL THEN 'none' ELSE 'elsewhere' END AS reason FROM pt LEFT JOIN hit USING (id) WHERE y IS NOT NULL AND shape IS DISTINCT FROM CASE WHEN city IN ('NATION_1', 'NATION_5') THEN 'holed' ELSE 'wide' END", POINTS, _edges_sql(), HIT))
def coord_audit(spark, sf_dir):
    """Placed rows that lie in another shape than their place should, or in none."""
    p = points(spark, sf_dir).where("y is not null")
    expected = F.when(F.col("city").isin("NATION_1", "NATION_5"), "holed").otherwise("wide")
    found = p.join(G.locate(p, shapes(spark)), "id")
    return found.where(~F.col("shape").eqNullSafe(expected)).select("id", F.coalesce("shape", F.lit("-")).alias("shape"), F.when(F.col("shape").isNull(), "none").otherwise("elsewhere").alias("reason"))


TRIES = "tr AS (SELECT venue_id AS id, CAST(id % 3 AS INTEGER) AS attempt, CAST(id AS INTEGER) AS hit, id % 97 = venue_id % 97 AS accepted, 'note ' || id AS note FROM cat_events)"


@query(O.sql("""SELECT id, coalesce(a.attempt, r.attempt) AS attempt, coalesce(a.hit, r.hit) AS hit, a IS NOT NULL AS accepted, CASE WHEN a IS NULL THEN r.note END AS note
  FROM (SELECT id, min({'attempt': attempt, 'hit': hit}) FILTER (accepted) AS a, max({'attempt': attempt, 'hit': hit, 'note': note}) FILTER (NOT accepted) AS r FROM tr GROUP BY 1)""", TRIES))
def geocode_pick(spark, sf_dir):
    k = F.col("id")
    tries = tables.events(spark, sf_dir).select(F.col("venue_id").alias("vid"), (k % 3).cast("int").alias("attempt"), k.cast("int").alias("hit"), (k % 97 == F.col("venue_id") % 97).alias("accepted"), F.concat(F.lit("note "), k.cast("string")).alias("note"))
    return K.pick_candidate(tries.withColumnRenamed("vid", "id"))


@query(O.sql("SELECT id, name FROM cat_venues WHERE lat IS NULL AND contains(lower(name), 'supplier') ORDER BY id DESC LIMIT 250"))
def geocode_backlog(spark, sf_dir):
    """Venues without coordinates, latest first, up to a run's budget of 250."""
    return tables.venues(spark, sf_dir).where(F.col("lat").isNull() & F.contains(F.lower("name"), F.lit("supplier"))).orderBy(F.desc("id")).limit(250).select("id", "name")


LD = f"""SELECT e.id, e.title AS name, strftime({O.lisbon('e.start_at')}, '%Y-%m-%dT%H:%M:00') AS "startDate", strftime({O.lisbon('e.end_at')}, '%Y-%m-%dT%H:%M:00') AS "endDate", coalesce(v.name, 'Leiria') AS place, coalesce(v.city, 'Leiria') AS locality FROM cat_events e LEFT JOIN cat_venues v ON v.id = e.venue_id WHERE date_text IS NULL"""


def jsonld(df):
    """One JSON-LD text for each dated row (id, title, start_at, end_at, venue, city); fields without a value are left out."""
    iso = lambda c: F.replace(lisbon_minute(F.col(c)), F.lit(" "), F.lit("T"))
    place = F.struct(F.lit("Place").alias("@type"), F.coalesce("venue", F.lit("Leiria")).alias("name"), F.struct(F.coalesce("city", F.lit("Leiria")).alias("addressLocality")).alias("address"))
    node = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), F.col("title").alias("name"), F.concat(iso("start_at"), F.lit(":00")).alias("startDate"), F.concat(iso("end_at"), F.lit(":00")).alias("endDate"), place.alias("location"))
    return df.where("date_text is null").select("id", F.to_json(node).alias("ld"))


def city_events(spark, sf_dir):
    v = tables.venues(spark, sf_dir).select(F.col("id").alias("venue_id"), F.col("name").alias("venue"), "city")
    return tables.events(spark, sf_dir).join(v, "venue_id", "left")


@query(O.sql(LD))
def export_jsonld(spark, sf_dir):
    """Exported texts, read back field by field."""
    v = F.parse_json("ld")
    field = lambda path, name: F.variant_get("v", path, "string").alias(name)
    return jsonld(city_events(spark, sf_dir)).withColumn("v", v).select("id", field("$.name", "name"), field("$.startDate", "startDate"), field("$.endDate", "endDate"), field("$.location.name", "place"), field("$.location.address.addressLocality", "locality"))


@query(O.sql(f"""SELECT 'https://example.org/evento/' || {O.slugify('title')} || '-' || id AS loc, strftime(make_timestamp(CAST(start_at AS BIGINT) * 1000000), '%Y-%m-%d') AS lastmod FROM cat_events
  UNION ALL SELECT 'https://example.org/', strftime(make_timestamp(CAST(max(start_at) AS BIGINT) * 1000000), '%Y-%m-%d') FROM cat_events"""))
def export_sitemap(spark, sf_dir):
    ev = tables.events(spark, sf_dir)
    day = lambda c: F.date_format(F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), c.cast("decimal(18,6)")), "yyyy-MM-dd")
    each = ev.select(F.concat(F.lit("https://example.org/evento/"), T.slugify(F.col("title")), F.lit("-"), F.col("id").cast("string")).alias("loc"), day(F.col("start_at")).alias("lastmod"))
    return each.union(ev.agg(F.lit("https://example.org/").alias("loc"), F.max("start_at").alias("t")).select("loc", day(F.col("t"))))


@query(O.sql("SELECT id, '<title>' || replace(replace(replace(title || ' <' || coalesce(venue, '?') || '> & \"mais\"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</title>' AS page FROM (SELECT e.id, e.title, v.name AS venue FROM cat_events e LEFT JOIN cat_venues v ON v.id = e.venue_id)").replace("'&gt;') || '</title>'", "'&gt;').replace('\"', '&quot;') || '</title>'"))
def export_pages(spark, sf_dir):
    text = F.concat("title", F.lit(" <"), F.coalesce("venue", F.lit("?")), F.lit('> & "mais"'))
    page = F.replace(F.lit("<title>{{t}}</title>"), F.lit("{{t}}"), T.escape_html(text))
    return venue_events(spark, sf_dir).select("id", page.alias("page"))


SITE, TEMPLATE = "https://example.org", '<html><head><title></title><meta name="description" content=""></head><body></body></html>'


def site_events(spark, sf_dir):
    e, k = city_events(spark, sf_dir), F.col("id")
    return e.select(F.concat(F.lit("e"), k.cast("string")).alias("slug"), F.concat("title", F.lit(' &amp; "mais"')).alias("title"), F.when(k % 3 == 0, F.concat(F.lit("<b>"), "title")).alias("description"), "start_at", "end_at", "date_text", "venue", "city", F.col("start_at").alias("updated_at"))


DAY_OF = "strftime(make_timestamp(CAST(start_at AS BIGINT) * 1000000), '%Y-%m-%d')"


@query(O.sql(f"""SELECT 'evento/e' || id || '/index.html' AS path, title || ' &amp; &quot;mais&quot; — Agenda' AS title, CASE WHEN id % 3 = 0 THEN '&lt;b&gt;' || title ELSE title || ' &amp; &quot;mais&quot;' END AS description, 'https://example.org/evento/e' || id AS canonical, 12 - CAST(date_text IS NOT NULL AS INTEGER) AS n_tags FROM cat_events"""))
def site_pages(spark, sf_dir):
    """Pages as they are published: title, description, canonical link and number of head tags, read back from the html."""
    folder = f"{home_of(spark, None)}/site"
    E.export(site_events(spark, sf_dir), TEMPLATE, SITE, "Agenda", folder)
    part = lambda pattern, name: F.regexp_extract("html", pattern, 1).alias(name)
    tags = F.regexp_count("html", F.lit(r"<meta |<link |ld\+json")).cast("int").alias("n_tags")
    return spark.read.parquet(f"{folder}/v=0/pages").select("path", part("<title>(.*?)</title>", "title"), part('name="description" content="(.*?)"', "description"), part('rel="canonical" href="(.*?)"', "canonical"), tags)


@query(O.sql(f"""SELECT 'sitemap-' || lpad(CAST(ceil(p / 400.0) AS INTEGER)::VARCHAR, 5, '0') || '.xml' AS path, loc, lastmod FROM (SELECT *, row_number() OVER (ORDER BY home DESC, loc) AS p FROM (
  SELECT 'https://example.org/evento/e' || id AS loc, {DAY_OF} AS lastmod, false AS home FROM cat_events UNION ALL SELECT 'https://example.org/', max({DAY_OF}), true FROM cat_events))
  UNION ALL SELECT 'sitemap.xml', 'https://example.org/sitemap-' || lpad(f::VARCHAR, 5, '0') || '.xml', max(lastmod) FROM (SELECT CAST(ceil(row_number() OVER (ORDER BY home DESC, loc) / 400.0) AS INTEGER) AS f, lastmod FROM (
  SELECT 'https://example.org/evento/e' || id AS loc, {DAY_OF} AS lastmod, false AS home FROM cat_events UNION ALL SELECT 'https://example.org/', max({DAY_OF}), true FROM cat_events)) GROUP BY f"""))
def site_sitemaps(spark, sf_dir):
    """Sitemap files of 400 urls and their index, read back entry by entry."""
    e = site_events(spark, sf_dir)
    urls = e.select(F.concat(F.lit(f"{SITE}/evento/"), "slug").alias("loc"), F.date_format(F.timestamp_seconds("updated_at"), "yyyy-MM-dd").alias("lastmod"))
    entry = r"<loc>(.*?)</loc><lastmod>(.*?)</lastmod>"
    each = F.arrays_zip(*[F.regexp_extract_all("body", F.lit(entry), F.lit(i)).alias(n) for i, n in ((1, "loc"), (2, "lastmod"))])
    return E.sitemaps(urls, SITE, 400).select("path", F.explode(each).alias("u")).select("path", "u.loc", "u.lastmod")


@query(O.sql("SELECT 'venues' AS tbl, count(*) AS n, '' AS missing FROM cat_venues UNION ALL SELECT 'events', count(*), '' FROM cat_events UNION ALL SELECT 'event_sources', count(*), 'source_event_id' FROM cat_sources"))
def publish_mirror(spark, sf_dir):
    """Rows of each mirrored table, and the columns that the mirror lacks."""
    ev = tables.events(spark, sf_dir)
    links = tables.event_sources(ev)
    out = None
    for name, df, mirror in (("venues", tables.venues(spark, sf_dir), None), ("events", ev, None), ("event_sources", links, links.drop("source_event_id"))):
        one = df.agg(F.lit(name).alias("tbl"), F.count("*").alias("n"), F.lit(",".join(K.missing_columns(df, mirror if mirror is not None else df))).alias("missing"))
        out = one if out is None else out.union(one)
    return out
