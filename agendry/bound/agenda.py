from __future__ import annotations

from pyspark.sql import functions as F

from agendry import constants as C, oracle as O, tables
from agendry.functions import text as T
from agendry.functions.dates import lisbon_day
from agendry.plans import agenda as A
from agendry.operators.order import positions
from agendry.registry import query

FROM, TO = C.NOW - 10 * C.DAY, C.NOW + 80 * C.DAY
TODAY = "2024-01-15"
COLUMNS = ("id", "title", "start_at", "end_at", "venue_id", "venue_name", "venue_city", "venue_lat", "venue_lng", "venue_scope")
JOINED = "j AS (SELECT e.*, v.name AS venue_name, v.city AS venue_city, v.lat AS venue_lat, v.lng AS venue_lng, v.scope AS venue_scope FROM cat_events e LEFT JOIN cat_venues v ON e.venue_id = v.id)"
SEEN = f"w AS (SELECT * FROM j WHERE date_text IS NULL AND start_at >= {FROM} AND start_at <= {TO})"
GROUPED = f"""g AS (SELECT *, {O.norm_title_ascii('title')} AS k, {O.lisbon_day('start_at')} AS day FROM w),
m AS (SELECT * FROM (SELECT *, row_number() OVER p AS n, list_sort(list_distinct(list(start_at) OVER (PARTITION BY k, venue_id, day))) AS starts FROM g WINDOW p AS (PARTITION BY k, venue_id, day ORDER BY start_at, id)) WHERE n = 1)"""
SHOWN = ", ".join(COLUMNS)


def rows(spark, sf_dir):
    return A.with_venues(tables.events(spark, sf_dir), tables.venues(spark, sf_dir))


def seen(spark, sf_dir):
    return A.window(rows(spark, sf_dir), FROM, TO)


def flat(df, *more):
    return df.select(*COLUMNS, F.array_join("categories", ",").alias("categories"), *more)


def starts():
    return F.array_join("session_starts", ",").alias("session_starts")


@query(O.sql(f"SELECT {SHOWN}, array_to_string(categories, ',') AS categories, array_to_string(starts, ',') AS session_starts FROM m ORDER BY start_at, id LIMIT 2000", JOINED, SEEN, GROUPED))
def agenda_window(spark, sf_dir):
    return flat(A.page(A.merge_sessions(seen(spark, sf_dir))), starts())


@query(O.sql(f"SELECT {SHOWN}, array_to_string(categories, ',') AS categories, array_to_string(starts, ',') AS session_starts FROM m", JOINED, f"w AS (SELECT * FROM j WHERE date_text IS NULL AND start_at >= {C.NOW})", GROUPED))
def agenda_upcoming(spark, sf_dir):
    return flat(A.merge_sessions(A.window(rows(spark, sf_dir), C.NOW)), starts())


@query(O.sql(f"SELECT {SHOWN}, array_to_string(categories, ',') AS categories FROM j WHERE date_text IS NOT NULL", JOINED))
def agenda_undated(spark, sf_dir):
    return flat(rows(spark, sf_dir).where("date_text is not null").orderBy(F.desc("id")))


SLUGGED = f"sl AS (SELECT *, {O.slugify('title')} || '-' || CAST(id AS VARCHAR) AS slug FROM j)"


def slugged(df):
    return df.withColumn("slug", F.concat_ws("-", T.slugify(F.col("title")), F.col("id").cast("string")))


@query(O.sql(f"SELECT slug, {SHOWN} FROM sl WHERE slug IN (SELECT slug FROM sl WHERE id % 1000 = 7)", JOINED, SLUGGED))
def event_by_slug(spark, sf_dir):
    """Point lookups of a list of slugs: a semi join, so any number of slugs is one pass."""
    all_rows = slugged(rows(spark, sf_dir))
    asked = slugged(tables.events(spark, sf_dir).where("id % 1000 = 7")).select("slug")
    return all_rows.join(asked, "slug", "left_semi").select("slug", *COLUMNS)


@query(O.sql(f"SELECT slug, {SHOWN}, 'Detail of ' || title AS description FROM sl", JOINED, SLUGGED))
def event_directory(spark, sf_dir):
    return slugged(rows(spark, sf_dir)).select("slug", *COLUMNS, F.concat(F.lit("Detail of "), "title").alias("description")).orderBy(F.desc("start_at"), "id")


@query(O.sql("SELECT id, name, city, district, lat, lng, scope FROM cat_venues"))
def venue_list(spark, sf_dir):
    return tables.venues(spark, sf_dir).orderBy("name")


@query(O.sql(
    f"""SELECT id, title, start_at, venue_id, city, {O.norm_title_ascii("concat_ws(' ', title, venue_name, city)")} AS haystack FROM (SELECT *, coalesce(venue_city, '') AS city FROM m)
    WHERE contains({O.norm_title_ascii("concat_ws(' ', title, venue_name, city)")}, 'supplier') AND list_contains(categories, title) AND {O.lisbon_day('start_at')} BETWEEN '2024-01-08' AND '2024-01-20'""", JOINED, SEEN, GROUPED))
def agenda_filters(spark, sf_dir):
    m = A.merge_sessions(seen(spark, sf_dir)).withColumn("city", A.concelho(F.col("venue_city")))
    hay = T.haystack(F.col("title"), F.col("venue_name"), F.col("city"))
    day = lisbon_day(F.col("start_at"))
    return m.withColumn("haystack", hay).where(F.contains("haystack", F.lit("supplier")) & F.array_contains("categories", F.col("title")) & day.between("2024-01-08", "2024-01-20")).select("id", "title", "start_at", "venue_id", "city", "haystack")


@query(O.sql("SELECT id, title, start_at, venue_id, venue_lat, venue_lng, venue_scope FROM m WHERE list_contains(categories, 'click')", JOINED, SEEN, GROUPED))
def agenda_map_rows(spark, sf_dir):
    """The filters of the list without city and venue."""
    return A.merge_sessions(seen(spark, sf_dir)).where(F.array_contains("categories", "click")).select("id", "title", "start_at", "venue_id", "venue_lat", "venue_lng", "venue_scope")


def _facet(value, label):
    return O.sql(f"SELECT {value} AS value, min_by({label}, (start_at, id)) AS label, count(*) AS count FROM m WHERE {value} IS NOT NULL AND {value} <> '' GROUP BY 1", JOINED, SEEN, GROUPED)


@query(_facet("venue_city", "venue_city"))
def facet_city(spark, sf_dir):
    return A.ranked(A.facet(A.merge_sessions(seen(spark, sf_dir)), F.col("venue_city")))


@query(_facet("CAST(venue_id AS VARCHAR)", "venue_name"))
def facet_venue(spark, sf_dir):
    return A.ranked(A.facet(A.merge_sessions(seen(spark, sf_dir)), F.col("venue_id").cast("string"), F.col("venue_name")))


@query(O.sql("SELECT c AS value, c AS label, count(*) AS count FROM (SELECT id, unnest(list_distinct(categories)) AS c FROM m) GROUP BY 1", JOINED, SEEN, GROUPED))
def facet_category(spark, sf_dir):
    each = A.merge_sessions(seen(spark, sf_dir)).select("start_at", "id", F.explode(F.array_distinct("categories")).alias("c"))
    return A.ranked(A.facet(each, F.col("c")))


@query(O.sql("SELECT venue_city, title, venue_scope, count(*) AS count FROM w GROUP BY GROUPING SETS ((venue_city), (title), (venue_scope), ())", JOINED, SEEN))
def facets_grouping_sets(spark, sf_dir):
    cols = [F.col(c) for c in ("venue_city", "title", "venue_scope")]
    return seen(spark, sf_dir).groupingSets([[c] for c in cols] + [[]], *cols).agg(F.count("*").alias("count"))


@query(O.sql(
    f"""SELECT day, CASE WHEN day = '{TODAY}' THEN 'Hoje' WHEN CAST(day AS DATE) = DATE '{TODAY}' + 1 THEN 'Amanhã' ELSE {O.arr(C.WEEKDAYS)}[isodow(CAST(day AS DATE))] END AS label,
    count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY start_at, id) AS ids FROM m GROUP BY day""", JOINED, SEEN, GROUPED))
def day_groups(spark, sf_dir):
    m = A.merge_sessions(seen(spark, sf_dir)).withColumn("day", lisbon_day(F.col("start_at")))
    members = F.array_sort(F.collect_list(F.struct("start_at", "id")))
    return m.groupBy("day").agg(F.count("*").alias("n"), F.array_join(F.transform(members, lambda s: s["id"].cast("string")), ",").alias("ids")).select("day", A.day_label(F.col("day"), TODAY).alias("label"), "n", "ids")


@query(O.sql("SELECT day, row_number() OVER (PARTITION BY day ORDER BY start_at, id) AS position, id FROM m", JOINED, SEEN, GROUPED))
def day_positions(spark, sf_dir):
    """The rows of day_groups, one a row: (day, position, id), whatever a day holds."""
    m = A.merge_sessions(seen(spark, sf_dir)).withColumn("day", lisbon_day(F.col("start_at")))
    return positions(m.select("day", "start_at", "id"), "day", "start_at", "id").select("day", "position", "id")


@query(O.sql(f"SELECT '{TODAY}' AS min_day, max(day) AS max_day, count(*) >= 2000 AS truncated FROM (SELECT day FROM m ORDER BY start_at, id LIMIT 2000)", JOINED, SEEN, GROUPED))
def range_bounds(spark, sf_dir):
    shown = A.page(A.merge_sessions(seen(spark, sf_dir)))
    return shown.agg(F.lit(TODAY).alias("min_day"), F.max(lisbon_day(F.col("start_at"))).alias("max_day"), (F.count("*") >= A.MAX_ROWS).alias("truncated"))


TALLY = "t AS (SELECT coalesce(venue_city, '') AS city, count(*) AS count FROM m GROUP BY 1)"


def tally(spark, sf_dir):
    return A.merge_sessions(seen(spark, sf_dir)).groupBy(A.concelho(F.col("venue_city")).alias("city")).agg(F.count("*").alias("count"))


@query(O.sql("SELECT CASE WHEN city = '' THEN 'Sem concelho' ELSE city END AS city, city <> '' AS mappable, count FROM t", JOINED, SEEN, GROUPED, TALLY))
def concelho_tally(spark, sf_dir):
    t = tally(spark, sf_dir).orderBy(F.col("city") == "", F.desc("count"), F.collate(F.col("city"), "pt"))
    return t.select(F.when(F.col("city") == "", "Sem concelho").otherwise(F.col("city")).alias("city"), (F.col("city") != "").alias("mappable"), "count")


@query(O.sql("SELECT n_name AS city, coalesce(count, 0) AS count FROM nation LEFT JOIN t ON city = n_name", JOINED, SEEN, GROUPED, TALLY))
def district_roster(spark, sf_dir):
    """Every place of the roster, with 0 where nothing is on."""
    roster = tables.read(spark, sf_dir, "nation").select(F.col("n_name").alias("city"))
    return roster.join(tally(spark, sf_dir), "city", "left").select("city", F.coalesce("count", F.lit(0).cast("bigint")).alias("count"))


@query(O.sql("""SELECT city, count, round(CASE WHEN count = 0 THEN 0.05 ELSE 0.12 + 0.78 * sqrt(count / CAST(peak AS DOUBLE)) END, 6) AS opacity
  FROM (SELECT n_name AS city, coalesce(count, 0) AS count, max(coalesce(count, 0)) OVER () AS peak FROM nation LEFT JOIN t ON city = n_name)""", JOINED, SEEN, GROUPED, TALLY))
def heat_ramp(spark, sf_dir):
    r = district_roster(spark, sf_dir)
    peak = r.agg(F.greatest(F.max("count"), F.lit(1)).alias("peak"))
    return r.crossJoin(F.broadcast(peak)).select("city", "count", F.round(A.ramp(F.col("count"), F.col("peak"), 0.12, 0.78, 0.05), 6).alias("opacity"))


PINS = """p AS (SELECT CAST(venue_id AS VARCHAR) AS key, min_by(venue_name, (start_at, id)) AS name, min_by(venue_city, (start_at, id)) AS city, min_by(venue_lat, (start_at, id)) AS lat, min_by(venue_lng, (start_at, id)) AS lng, count(*) AS count
  FROM m WHERE venue_lat IS NOT NULL AND venue_lng IS NOT NULL AND abs(venue_lat) <= 90 AND abs(venue_lng) <= 180 AND venue_scope <> 'concelho' AND coalesce(venue_name, '') <> '' GROUP BY 1)"""


@query(O.sql("SELECT * FROM p", JOINED, SEEN, GROUPED, PINS))
def pin_tally(spark, sf_dir):
    return A.pins(A.merge_sessions(seen(spark, sf_dir))).orderBy(F.desc("count"), F.collate(F.col("name"), "pt"))


@query(O.sql("SELECT key, count, round(3.5 + 9.5 * sqrt(count / CAST(max(count) OVER () AS DOUBLE)), 6) AS radius FROM p", JOINED, SEEN, GROUPED, PINS))
def pin_radius(spark, sf_dir):
    p = A.pins(A.merge_sessions(seen(spark, sf_dir))).select("key", "count")
    peak = p.agg(F.max("count").alias("peak"))
    return p.crossJoin(F.broadcast(peak)).select("key", "count", F.round(A.ramp(F.col("count"), F.col("peak"), 3.5, 9.5), 6).alias("radius"))


@query(O.sql("SELECT * FROM p ORDER BY count DESC, name LIMIT 12", JOINED, SEEN, GROUPED, PINS))
def top_places(spark, sf_dir):
    return A.pins(A.merge_sessions(seen(spark, sf_dir))).orderBy(F.desc("count"), F.collate(F.col("name"), "pt")).limit(12)


@query(O.sql("""SELECT count(*) FILTER (venue_lat IS NOT NULL) AS placed, count(*) FILTER (venue_lat IS NOT NULL AND venue_scope <> 'concelho') AS pinned,
  count(*) FILTER (venue_lat IS NOT NULL AND venue_scope = 'lugar') AS settlements, count(*) AS total FROM m""", JOINED, SEEN, GROUPED))
def pin_coverage(spark, sf_dir):
    ok = A.valid_place(F.col("venue_lat"), F.col("venue_lng"))
    return A.merge_sessions(seen(spark, sf_dir)).agg(
        F.count_if(ok).alias("placed"), F.count_if(ok & (F.col("venue_scope") != "concelho")).alias("pinned"), F.count_if(ok & (F.col("venue_scope") == "lugar")).alias("settlements"), F.count("*").alias("total")
    )


DAYS = "days AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, CAST(o_orderdate AS DATE) AS d FROM orders)"
PERIODS = """pr AS (SELECT day, period, ord, strftime(f, '%Y-%m-%d') AS from_day, strftime(t, '%Y-%m-%d') AS to_day FROM (
  SELECT day, 'hoje' AS period, 0 AS ord, d AS f, d AS t FROM days UNION ALL SELECT day, 'amanha', 1, d + 1, d + 1 FROM days
  UNION ALL SELECT day, 'fim-de-semana', 2, greatest(d, d + CAST(6 - isodow(d) AS INTEGER)), d + CAST(7 - isodow(d) AS INTEGER) FROM days
  UNION ALL SELECT day, '7-dias', 3, d, d + 6 FROM days UNION ALL SELECT day, '30-dias', 4, d, d + 29 FROM days))"""


def days(spark, sf_dir):
    return tables.read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).distinct()


@query(O.sql("SELECT day, period, ord, from_day, to_day FROM pr", DAYS, PERIODS))
def period_ranges(spark, sf_dir):
    return A.periods(days(spark, sf_dir))


@query(O.sql("""SELECT r.day, r.from_day, r.to_day, min_by(period, ord) AS period FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d') AS from_day,
  strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 9 AS INTEGER), '%Y-%m-%d') AS to_day FROM orders) r LEFT JOIN pr ON r.day = pr.day AND r.from_day = pr.from_day AND r.to_day = pr.to_day GROUP BY ALL""", DAYS, PERIODS))
def active_period(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    to = F.date_format(F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 9).cast("int")), "yyyy-MM-dd")
    return A.active_period(tables.read(spark, sf_dir, "orders").select(day.alias("day"), day.alias("from_day"), to.alias("to_day")).distinct())


@query(O.sql(f"SELECT id, strftime({O.lisbon('s')}, '%H:%M') <> '00:00' AS has_clock FROM (SELECT id, start_at - start_at % CASE WHEN id % 3 = 0 THEN 86400 ELSE 1 END AS s FROM cat_events)"))
def has_clock(spark, sf_dir):
    s = F.col("start_at") - F.col("start_at") % F.when(F.col("id") % 3 == 0, C.DAY).otherwise(1)
    return tables.events(spark, sf_dir).select("id", A.has_clock(s).alias("has_clock"))


@query(O.sql(f"""SELECT (SELECT count(*) FROM cat_events) AS n_events, (SELECT count(*) FROM cat_venues) AS n_venues, max(started_at) AS last_run, max_by(items, started_at) AS last_items
  FROM (SELECT {O.lisbon_day('start_at')} AS day, min(start_at) AS started_at, count(*) AS items FROM cat_events GROUP BY 1)"""))
def catalogue_stats(spark, sf_dir):
    ev = tables.events(spark, sf_dir)
    runs = ev.groupBy(lisbon_day(F.col("start_at")).alias("day")).agg(F.min("start_at").alias("started_at"), F.count("*").alias("items"))
    last = runs.agg(F.max("started_at").alias("last_run"), F.max_by("items", "started_at").alias("last_items"))
    n_events, n_venues = ev.agg(F.count("*").alias("n_events")), tables.venues(spark, sf_dir).agg(F.count("*").alias("n_venues"))
    return n_events.crossJoin(n_venues).crossJoin(last)  # three rows of one


KEYWORDS = " Click, supplier#000000007 ,, "
MATCH = f"""(contains({O.fold("concat_ws(' ', title, venue_name)")}, 'click') OR contains({O.fold("concat_ws(' ', title, venue_name)")}, 'supplier#000000007'))"""
FANNED = f"f AS (SELECT j.id, j.title, j.start_at, j.venue_name, j.venue_city, s.source, {MATCH} AS hit FROM j LEFT JOIN cat_sources s ON s.event_id = j.id WHERE date_text IS NULL AND start_at >= {C.NOW})"


def fanned(spark, sf_dir):
    kws = T.keywords(F.lit(KEYWORDS))
    ev = A.window(rows(spark, sf_dir), C.NOW)
    sources = tables.event_sources(tables.events(spark, sf_dir)).select(F.col("event_id").alias("id"), F.col("source").alias("seen_in"))
    return ev.join(sources, "id", "left").select("id", "title", "start_at", "venue_name", "venue_city", F.col("seen_in").alias("source"), T.matches_keywords(F.concat_ws(" ", "title", "venue_name"), kws).alias("hit"))


@query(O.sql("SELECT * FROM f ORDER BY start_at, id, source LIMIT 500", JOINED, FANNED))
def digest(spark, sf_dir):
    return fanned(spark, sf_dir).orderBy("start_at", "id", "source").limit(500)


@query(O.sql("SELECT count(*) AS total, count(*) FILTER (hit) AS hits FROM (SELECT * FROM f ORDER BY start_at, id, source LIMIT 500)", JOINED, FANNED))
def digest_totals(spark, sf_dir):
    return digest(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"))


@query(O.sql(f"""SELECT row_number() OVER (ORDER BY NOT hit, start_at, id, source) AS n, CASE WHEN hit THEN '* ' ELSE '  ' END || {O.lisbon_minute('start_at')} || ' ' || title || ' @ ' || coalesce(venue_name, '?') || ' [' || source || ']' AS line
  FROM (SELECT * FROM f ORDER BY start_at, id, source LIMIT 500)""", JOINED, FANNED))
def digest_lines(spark, sf_dir):
    """Starred matches first; the digest has 500 rows at most, so numbering them needs one small task."""
    from pyspark.sql import Window

    from agendry.functions.dates import lisbon_minute

    line = F.concat(F.when(F.col("hit"), "* ").otherwise("  "), lisbon_minute(F.col("start_at")), F.lit(" "), "title", F.lit(" @ "), F.coalesce("venue_name", F.lit("?")), F.lit(" ["), "source", F.lit("]"))
    n = F.row_number().over(Window.orderBy(~F.col("hit"), "start_at", "id", "source"))
    return digest(spark, sf_dir).select(n.cast("bigint").alias("n"), line.alias("line"))


SAVED = "sv AS (SELECT o_custkey AS user_id, 's' || (o_orderkey % 12000) AS slug, o_orderkey AS id FROM orders), se AS (SELECT 's' || id AS slug, start_at, end_at FROM cat_events)"


def saved(spark, sf_dir):
    return tables.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.concat(F.lit("s"), (F.col("o_orderkey") % 12000).cast("string")).alias("slug"), F.col("o_orderkey").alias("id"))


def saved_events(spark, sf_dir):
    return tables.events(spark, sf_dir).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("slug"), "start_at", "end_at")


@query(O.sql(f"""SELECT user_id, slug, bucket, CAST(row_number() OVER (PARTITION BY user_id, bucket ORDER BY CASE WHEN t >= {C.NOW} THEN t ELSE -t END NULLS LAST, slug) AS INTEGER) AS rank
  FROM (SELECT user_id, slug, t, CASE WHEN t IS NULL THEN 'missing' WHEN t >= {C.NOW} THEN 'upcoming' ELSE 'past' END AS bucket FROM (SELECT user_id, slug, coalesce(end_at, start_at) AS t FROM (SELECT DISTINCT user_id, slug FROM sv) LEFT JOIN se USING (slug)))""", SAVED))
def saved_split(spark, sf_dir):
    return A.split_saved(saved(spark, sf_dir).select("user_id", "slug").distinct(), saved_events(spark, sf_dir), C.NOW)


@query(O.sql("SELECT DISTINCT user_id, slug FROM sv WHERE slug NOT IN (SELECT slug FROM se)", SAVED))
def saved_missing(spark, sf_dir):
    return saved(spark, sf_dir).select("user_id", "slug").distinct().join(saved_events(spark, sf_dir), "slug", "left_anti").select("user_id", "slug")


@query(O.sql("SELECT user_id, slug, min(id) AS id FROM sv WHERE user_id % 7 <> 0 OR id % 2 = 0 GROUP BY ALL", SAVED))
def save_unsave(spark, sf_dir):
    """Bookmarks are added once for each user and slug; removals by user and slug are an anti join on the requests."""
    s = saved(spark, sf_dir)
    removed = s.where("user_id % 7 = 0 and id % 2 <> 0").select("id")
    return s.join(removed, "id", "left_anti").groupBy("user_id", "slug").agg(F.min("id").alias("id"))
