"""Queries of whole ingests: snapshots after an upsert, venue resolution, gates, lists and write-backs."""

from __future__ import annotations

from pyspark.sql import functions as F

from agendry import constants as C, oracle as O, tables
from agendry.bound.catalogue import FULL, PAST, old_catalogue, raw_batch
from agendry.bound.entities import COMPONENTS, FACTS, IDS, VC, VF, VP, cc, facts, sql as rsql
from agendry.bound.texts import CITY, CUST, DIM, PART_VENUES, customer_places, part_venues
from agendry.functions import places as P, text as T
from agendry.operators import pairs as R
from agendry.plans import agenda as A, ingest as I
from agendry.registry import query
from agendry.runtime import cut


def catalogue(spark, sf_dir):
    """The old events with one attribution each, and their venues; events are made once, since an upsert reads them several times."""
    old = cut(old_catalogue(spark, sf_dir).withColumn("city", F.lit(None).cast("string")))
    sources = old.select(F.col("id").alias("event_id"), "source", F.col("slug").alias("source_event_id"))
    events = old.select("id", "title", "start_at", "end_at", "venue_id", "venue", "city", "url", "categories", "date_text", "fingerprint")
    venues = tables.venues(spark, sf_dir).select("id", "name", I.venue_slug(F.col("name")).alias("slug"), "city")
    return {"events": events, "sources": sources, "venues": venues}


def batch(spark, sf_dir):
    return raw_batch(spark, sf_dir).withColumns({"date_text": F.lit(None).cast("string"), "city": F.lit(None).cast("string"), "venue_id": F.lit(None).cast("bigint")})


GAINED = """ga AS (SELECT event_id, arg_min(end_at, ordinal) FILTER (end_at IS NOT NULL) AS end_at, arg_min(url, ordinal) FILTER (url IS NOT NULL) AS url, flatten(list(categories)) AS categories FROM rm WHERE event_id IS NOT NULL GROUP BY 1),
top AS (SELECT max(id) AS base FROM oldc),
nw AS (SELECT base + 1 + component AS id, arg_min(title, ordinal) AS title, arg_min(start_at, ordinal) AS start_at, arg_min(end_at, ordinal) FILTER (end_at IS NOT NULL) AS end_at, arg_min(url, ordinal) FILTER (url IS NOT NULL) AS url,
  list_sort(list_distinct(flatten(list(categories)))) AS categories, arg_min(fingerprint, ordinal) AS fingerprint FROM fresh JOIN fcc USING (id) JOIN top ON true GROUP BY base, component),
snap AS (SELECT o.id, title, start_at, coalesce(o.end_at, ga.end_at) AS end_at, coalesce(o.url, ga.url) AS url, CASE WHEN ga.event_id IS NULL THEN o.categories ELSE list_sort(list_distinct(list_concat(o.categories, ga.categories))) END AS categories, fingerprint
  FROM oldc o LEFT JOIN ga ON ga.event_id = o.id UNION ALL SELECT * FROM nw)"""


@query(rsql("SELECT id, title, start_at, end_at, url, array_to_string(categories, '|') AS categories, fingerprint FROM snap", FULL, cc("fresh", "fe", "fcc"), GAINED))
def upsert_snapshot(spark, sf_dir):
    """The events after a batch: unions of categories, ends and urls completed, new events from the least ordinal."""
    c = catalogue(spark, sf_dir)
    events, _, _ = I.upsert(batch(spark, sf_dir), c["events"], c["sources"], PAST)
    return events.select("id", "title", "start_at", "end_at", "url", F.array_join("categories", "|").alias("categories"), "fingerprint")


@query(rsql("""SELECT event_id, source, arg_min(slug, (was, ordinal)) AS source_event_id FROM (SELECT id AS event_id, source, slug, 0 AS was, id AS ordinal FROM oldc UNION ALL SELECT event_id, source, slug, 1, ordinal FROM rm WHERE event_id IS NOT NULL
  UNION ALL SELECT base + 1 + component, source, slug, 1, ordinal FROM fresh JOIN fcc USING (id) JOIN top ON true) GROUP BY 1, 2""", FULL, cc("fresh", "fe", "fcc"), GAINED))
def upsert_attributions(spark, sf_dir):
    """The attributions after a batch: one for each event and source, the first that came."""
    c = catalogue(spark, sf_dir)
    return I.upsert(batch(spark, sf_dir), c["events"], c["sources"], PAST)[1]


def named_venues(spark, sf_dir):
    """(ordinal, venue, city): names of which a third are venues already, with empty cities and names without letters."""
    v = part_venues(spark, sf_dir)
    return v.select(F.col("id").alias("ordinal"), F.when(F.col("id") % 17 == 0, "!!").otherwise(F.col("name")).alias("venue"), "city")


RAW_VENUES = f"rv AS (SELECT id AS ordinal, CASE WHEN id % 17 = 0 THEN '!!' ELSE name END AS venue, nullif(city, '') AS city FROM pv)"
SLUG = lambda x: f"coalesce(nullif({O.slugify(O.norm_venue(x))}, ''), 'venue-desconhecido')"
RESOLVED = f"""kv AS (SELECT min(id) AS id, arg_min(name, id) AS name, {SLUG('name')} AS slug, arg_min(city, id) AS city FROM pv WHERE id % 3 = 0 GROUP BY 3),
rs AS (SELECT ordinal, {O.norm_venue('venue')} AS name, {SLUG('venue')} AS slug, city FROM rv),
un AS (SELECT slug, city, arg_min(name, ordinal) AS name, (SELECT max(id) FROM kv) + 1 + min(ordinal) AS id FROM rs WHERE slug NOT IN (SELECT slug FROM kv) GROUP BY ALL),
ft AS (SELECT id, {O.venue_tokens('name', 'city')} AS tokens, city, {O.is_vague('name', 'city')} AS vague, true AS old FROM kv WHERE city IS NOT NULL UNION ALL SELECT id, {O.venue_tokens('name', 'city')}, city, {O.is_vague('name', 'city')}, false FROM un WHERE city IS NOT NULL),
st AS (SELECT a.id AS a, b.id AS b, b.old AS b_old FROM ft a JOIN ft b ON a.city = b.city AND NOT a.old AND a.id <> b.id AND NOT a.vague AND NOT b.vague AND (list_has_all(a.tokens, b.tokens) OR list_has_all(b.tokens, a.tokens))),
mt AS (SELECT a AS id, min(b) AS old_id FROM st WHERE b_old GROUP BY 1),
lo AS (SELECT * FROM un WHERE id NOT IN (SELECT id FROM mt)),
le AS (SELECT a AS src, b AS dst FROM st WHERE NOT b_old AND a IN (SELECT id FROM lo) AND b IN (SELECT id FROM lo) UNION SELECT x.id, y.id FROM lo x JOIN lo y USING (slug))"""


@query(rsql("""SELECT ordinal, coalesce(kv.id, mt.old_id, lcc.component) AS venue_id FROM rs LEFT JOIN kv ON kv.slug = rs.slug LEFT JOIN un ON un.slug = rs.slug AND un.city IS NOT DISTINCT FROM rs.city
  LEFT JOIN mt ON mt.id = un.id LEFT JOIN lcc ON lcc.id = un.id""", PART_VENUES, RAW_VENUES, RESOLVED, cc("lo", "le", "lcc")))
def venue_resolution(spark, sf_dir):
    """Venues of names: of the same slug, of the same city by the strict rule, or created."""
    v = part_venues(spark, sf_dir).where("id % 3 = 0").withColumn("slug", I.venue_slug(F.col("name")))
    known = v.groupBy("slug").agg(F.min(F.struct("id", "name", "city")).alias("v")).select("v.id", "v.name", "slug", F.nullif("v.city", F.lit("")).alias("city"))
    return I.resolve_venues(named_venues(spark, sf_dir), known)[0]


@query()
def ingest_cycle(spark, sf_dir):
    """Events after a whole cycle: upsert, purge, venue fusion and reconciliation."""
    done = I.whole(I.cycle(batch(spark, sf_dir).drop("venue_id"), catalogue(spark, sf_dir), PAST, "batch"))
    return done["events"].select("id", "title", "start_at", "end_at", "venue_id", F.array_join("categories", "|").alias("categories"), "fingerprint")


@query(rsql("SELECT component, count(*) AS rows, count(DISTINCT id % 4) AS prints, count(*) >= 2 AND count(DISTINCT id % 4) >= 2 AS acted FROM comp GROUP BY 1", IDS, FACTS, COMPONENTS))
def component_gate(spark, sf_dir):
    """Components that a reconciliation acts on: two rows and two fingerprints at least."""
    members = R.event_components(cut(facts(spark, sf_dir))).select("component", (F.col("id") % 4).alias("fingerprint"))
    return I.acted_on(members)


@query(O.sql("SELECT event_id AS id, min(source || ':' || source_event_id) AS item_key FROM cat_sources WHERE source_event_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source || ':' || source_event_id) = 1"))
def item_keys(spark, sf_dir):
    """The source item of events that exactly one item owns."""
    return I.item_keys(tables.event_sources(tables.events(spark, sf_dir)))


ANSWERS = "an AS (SELECT id, id % 4 <> 0 AS accepted, 39.5::DOUBLE + id % 10 AS lat, -8.5::DOUBLE - id % 10 AS lng, CASE WHEN id % 6 = 1 THEN 'Rua ' || id END AS address FROM ge WHERE id % 5 <> 0)"
GEO = f"""cn AS (SELECT id, city AS name, {O.norm_place('city')} AS n FROM cu), ge AS (SELECT id, name, CASE WHEN list_contains({O.arr([*P.MUNICIPALITY, *C.MUNICIPALITY_ALIASES])}, n) THEN 'concelho' WHEN list_contains({O.arr(sorted(P.PARISH))}, n) THEN 'lugar' ELSE 'venue' END AS scope FROM cn)"""


def placed_names(spark, sf_dir):
    """Venues named after places, without coordinates, and a geocoder's answers to most of them."""
    v = customer_places(spark, sf_dir).select("id", F.col("city").alias("name"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.lit("?").alias("scope"), F.lit("-").alias("address"))
    k = F.col("id")
    answers = v.where(k % 5 != 0).select("id", (k % 4 != 0).alias("accepted"), (F.lit(39.5) + k % 10).alias("lat"), (F.lit(-8.5) - k % 10).alias("lng"), F.when(k % 6 == 1, F.concat(F.lit("Rua "), k.cast("string"))).alias("address"))
    return v, answers


@query(f"""WITH {CUST}, {GEO}, {ANSWERS} SELECT ge.id, name, CASE WHEN accepted AND scope <> 'concelho' THEN lat END AS lat, CASE WHEN accepted AND scope <> 'concelho' THEN lng END AS lng,
  CASE WHEN scope = 'concelho' OR accepted THEN scope ELSE '?' END AS scope, CASE WHEN accepted AND scope <> 'concelho' THEN coalesce(address, '-') ELSE '-' END AS address FROM ge LEFT JOIN an USING (id)""")
def geocode_writeback(spark, sf_dir):
    return I.geocode_writeback(*placed_names(spark, sf_dir))


@query(f"WITH {CUST}, {GEO}, {ANSWERS} SELECT CASE WHEN scope = 'concelho' THEN 'skipped' WHEN accepted THEN 'placed' WHEN accepted IS NOT NULL THEN 'rejected' ELSE 'miss' END AS status, count(*) AS count FROM ge LEFT JOIN an USING (id) GROUP BY 1")
def geocode_tally(spark, sf_dir):
    return I.geocode_tally(*placed_names(spark, sf_dir))


@query(f"""WITH {CUST}, {DIM}, p AS (SELECT nullif(coalesce(municipality, city, ''), '') AS name FROM cu LEFT JOIN dim ON norm = {O.norm_place('city')}), t AS (SELECT name, count(*) AS count FROM p GROUP BY 1)
  SELECT coalesce(name, 'Sem concelho') AS name, count, coalesce(list_contains({O.arr(C.MUNICIPALITIES)}, name), false) AS mappable, CAST(row_number() OVER (ORDER BY name IS NULL, count DESC, name COLLATE pt) AS INTEGER) AS ord FROM t""")
def concelho_ranking(spark, sf_dir):
    """Rows of each concelho, parishes folded into theirs, rows without a place last."""
    return A.tally_concelhos(customer_places(spark, sf_dir), "city")


LISTED = f"li AS (SELECT e.id, e.start_at, e.categories, v.name AS venue_name, v.city AS venue_city, {O.slugify('v.name')} AS slug FROM cat_events e LEFT JOIN cat_venues v ON v.id = e.venue_id WHERE date_text IS NULL)"


@query(O.sql(f"""SELECT 'venue' AS filter, id FROM li WHERE slug = 'supplier-000000003' UNION ALL SELECT 'city', id FROM li WHERE venue_city = 'NATION_3' AND start_at <= {C.NOW} UNION ALL
  SELECT 'wild', id FROM li WHERE len(list_filter(categories, lambda c: c ILIKE 'c%k')) > 0 AND start_at >= {C.NOW} UNION ALL SELECT 'case', id FROM li WHERE list_contains(categories, 'view') UNION ALL SELECT 'backwards', id FROM li WHERE start_at <= {C.NOW}""", LISTED))
def list_filters(spark, sf_dir):
    """Lists by venue, city, category (any case, with wildcards) and time; a backwards range loses its start, empty options filter nothing."""
    ev, v = tables.events(spark, sf_dir), tables.venues(spark, sf_dir)
    options = {
        "venue": {"venue": "supplier-000000003", "city": ""},
        "city": {"city": "NATION_3", "to": C.NOW, "from": ""},
        "wild": {"category": "C%k", "from": C.NOW},
        "case": {"category": "VIEW", "venue": None},
        "backwards": A.repaired({"from": C.NOW + 1, "to": C.NOW}),
    }
    out = None
    for name, chosen in options.items():
        one = A.list_events(ev, v, chosen).select(F.lit(name).alias("filter"), "id")
        out = one if out is None else out.union(one)
    return out


SERVED = f"""sv AS (SELECT e.id, e.title, 's-' || e.id AS slug, e.start_at AS "startAt", e.end_at AS "endAt", e.venue_id AS "venueId", v.name AS "venueName", v.city AS "venueCity", {O.slugify('v.name')} AS "venueSlug", v.lat AS "venueLat", v.lng AS "venueLng", v.scope AS "venueScope",
  CASE WHEN e.id % 3 = 0 THEN 'img' || e.id END AS "imageUrl", 'u' || e.id AS url, CASE WHEN e.id % 7 = 0 THEN '' ELSE array_to_string(e.categories, '|') END AS categories, e.date_text AS "dateText", 'about ' || e.id AS description, e.start_at - 60 AS "updatedAt"
  FROM cat_events e LEFT JOIN cat_venues v ON v.id = e.venue_id)"""


@query(O.sql("SELECT * FROM sv", SERVED))
def public_details(spark, sf_dir):
    """All served columns of events and those of their pages."""
    k = F.col("id")
    text = lambda s: F.concat(F.lit(s), k.cast("string"))
    more = {"slug": text("s-"), "image_url": F.when(k % 3 == 0, text("img")), "url": text("u"), "description": text("about "), "updated_at": F.col("start_at") - 60, "categories": F.when(k % 7 != 0, F.col("categories"))}
    rows = A.with_venues(tables.events(spark, sf_dir).withColumns(more), tables.venues(spark, sf_dir)).withColumn("venue_slug", T.slugify(F.col("venue_name")))
    return A.public(rows, detail=True).withColumn("categories", F.array_join("categories", "|"))


@query("SELECT o_custkey AS user_id, o_orderkey AS slug, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def saved_newest(spark, sf_dir):
    saved = tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("slug"), F.col("o_orderdate").cast("date").alias("created_at"))
    return A.newest_saved(saved)


@query(O.sql("SELECT venue_id AS slug, arg_max(title, (start_at, id)) AS title, arg_max(id, (start_at, id)) AS id FROM cat_events GROUP BY 1"))
def last_cards(spark, sf_dir):
    """The last card of each slug, in the order of pages."""
    from agendry.plans.catalog import last_wins

    cards = tables.events(spark, sf_dir).select(F.col("venue_id").alias("slug"), "title", "start_at", "id")
    return last_wins(cards, ["slug"], ["start_at", "id"]).select("slug", "title", "id")


@query(O.sql("SELECT 'venues' AS tbl, count(*) AS n FROM cat_venues UNION ALL SELECT 'events', count(*) FROM cat_events UNION ALL SELECT 'event_sources', count(*) FROM cat_sources"))
def publish_tables(spark, sf_dir):
    """Rows of each table of a mirror that was written anew, all tables together."""
    import uuid

    from agendry.plans.catalog import publish
    from agendry.runtime import checkpoint_dir

    ev = tables.events(spark, sf_dir)
    return publish({"venues": tables.venues(spark, sf_dir), "events": ev, "event_sources": tables.event_sources(ev)}, f"{checkpoint_dir(spark)}/mirror-{uuid.uuid4().hex}")


@query(O.sql("SELECT id, CASE WHEN id % 5 > 0 THEN 'd' || d.i END AS date, CASE WHEN id % 5 > 0 AND id % 4 > 0 THEN 't' || least(d.i, id % 4) END AS time, CASE WHEN id % 5 = 0 THEN 'no date' END AS error FROM cat_events, unnest(range(1, 1 + greatest(id % 5, 1))) AS d(i)"))
def session_rows(spark, sf_dir):
    """Sessions of a page, or one row with an error where the page names no date."""
    from agendry.sources.extract import sessions_or_error

    k = F.col("id")
    numbered = lambda letter, n: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.concat(F.lit(letter), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    each = tables.events(spark, sf_dir).select("id", F.explode(sessions_or_error(numbered("d", k % 5), numbered("t", k % 4))).alias("s"))
    return each.select("id", "s.date", "s.time", "s.error")
