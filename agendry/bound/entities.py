from __future__ import annotations

from pyspark.sql import functions as F

from agendry import constants as C, oracle as O, tables
from agendry.bound.texts import PART_VENUES, part_venues
from agendry.functions import places as P
from agendry.operators import merge as M, pairs as R
from agendry.registry import query
from agendry.runtime import cut, spread

RECURSIVE = "WITH RECURSIVE "


def cc(nodes: str, edges: str, name: str = "cc") -> str:
    """Least label of each node: labels travel along edges (src, dst) until none falls."""
    return f"""{name}_e AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}),
{name}(id, component) USING KEY (id) AS (SELECT id, id FROM {nodes} UNION
  SELECT e.b, min(c.component) FROM {name} c JOIN {name}_e e ON e.a = c.id JOIN recurring.{name} k ON k.id = e.b WHERE c.component < k.component GROUP BY e.b)"""


def sql(body: str, *parts: str) -> str:
    return RECURSIVE + ",\n".join([O.VENUES, O.EVENTS, O.LINKS, *parts]) + "\n" + body


VF = f"vf AS (SELECT id, {O.venue_tokens('name', 'city')} AS tokens, {O.norm_city('city')} AS city, {O.is_vague('name', 'city')} AS vague FROM pv)"
VC = "vc AS (SELECT tokens, city, min(id) AS id FROM vf WHERE NOT vague GROUP BY ALL)"
VP = "vp AS (SELECT a.id AS src, b.id AS dst FROM vc a JOIN vc b ON a.id < b.id AND (a.city = b.city OR a.city = '' OR b.city = '') AND (list_has_all(a.tokens, b.tokens) OR list_has_all(b.tokens, a.tokens)))"
VE = "ve AS (SELECT * FROM vp UNION SELECT vc.id, vf.id FROM vf JOIN vc USING (tokens, city) WHERE NOT vague)"


def venue_facts(spark, sf_dir):
    """Facts of the venues, found once and by many tasks, though the table is one small file."""
    return cut(R.venue_facts(spread(part_venues(spark, sf_dir), "id")))


@query(sql("SELECT * FROM vp", PART_VENUES, VF, VC, VP))
def venue_pairs(spark, sf_dir):
    return R.venue_pairs(venue_facts(spark, sf_dir))


@query(sql("SELECT id, component FROM vcc", PART_VENUES, VF, VC, VP, VE, cc("vf", "ve", "vcc")))
def venue_components(spark, sf_dir):
    return R.venue_components(venue_facts(spark, sf_dir))


@query(sql("""SELECT id, first_value(id) OVER (PARTITION BY component ORDER BY vague, len(tokens), n DESC, id) AS canonical FROM (SELECT vf.id, vf.vague, vf.tokens, vcc.component, coalesce(n, 0) AS n
  FROM vf JOIN vcc USING (id) LEFT JOIN (SELECT venue_id, count(*) AS n FROM cat_events GROUP BY 1) ON venue_id = vf.id)""", PART_VENUES, VF, VC, VP, VE, cc("vf", "ve", "vcc")))
def venue_fusion(spark, sf_dir):
    """Each venue and the canonical one of its component: specific, fewest words, most events, least id."""
    facts = venue_facts(spark, sf_dir)
    used = tables.events(spark, sf_dir).groupBy(F.col("venue_id").alias("id")).agg(F.count("*").alias("n"))
    scored = facts.join(R.venue_components(facts), "id").join(used, "id", "left")
    best = scored.groupBy("component").agg(F.min(F.struct("vague", F.size("tokens").alias("words"), (-F.coalesce("n", F.lit(0))).alias("n"), "id")).alias("best"))
    return scored.select("id", "component").join(best, "component").select("id", F.col("best.id").alias("canonical"))


IDS = """ids AS (SELECT e.id, CASE e.id % 6 WHEN 0 THEN 'Festival de ' || e.title WHEN 1 THEN e.title || ' em ' || coalesce(v.city, '') WHEN 2 THEN upper(e.title) || '!' ELSE e.title END AS title, e.start_at, e.end_at,
  CASE WHEN v.id % 4 = 0 THEN v.city ELSE replace(v.name, 'Supplier#', 'Sala') END AS venue, v.city, CASE WHEN e.id % 60 < 3 THEN 'i' || (e.id // 3) END AS item_key, e.categories
  FROM cat_events e LEFT JOIN (SELECT id, name, CASE WHEN id % 9 = 0 THEN 'Ordem' ELSE city END AS city FROM cat_venues) v ON v.id = e.venue_id WHERE date_text IS NULL)"""
FACTS = f"""facts AS (SELECT id, start_at, end_at, item_key, venue, city, {O.norm_title('title')} AS norm, {O.norm_title('title')} || '|' || {O.lisbon_day('start_at')} AS day_key, {O.title_core('title')} AS core,
  {O.venue_tokens('venue', 'city')} AS tokens, {O.norm_city('city')} AS ncity, {O.is_vague("coalesce(venue, '')", 'city')} AS vague, list_contains({O.arr(P.LOCALITIES)}, {O.norm_place("coalesce(city, '')")}) AS locality,
  CASE WHEN end_at > start_at THEN end_at ELSE start_at + {C.DAY - 1} END AS until FROM ids)"""
STRICT = "(NOT a.vague AND NOT b.vague AND (a.ncity = b.ncity OR a.ncity = '' OR b.ncity = '') AND (list_has_all(a.tokens, b.tokens) OR list_has_all(b.tokens, a.tokens)))"
COMPATIBLE = f"""((a.venue IS NULL AND b.venue IS NULL) OR (a.venue IS NOT NULL AND b.venue IS NOT NULL AND ((a.vague AND b.vague) OR (a.vague <> b.vague AND (a.ncity = b.ncity OR
  (CASE WHEN a.vague THEN b.locality ELSE a.locality END AND abs(a.start_at - b.start_at) <= {C.SESSION_WINDOW}))) OR {STRICT})))"""
DAY_PAIRS = f"dp AS (SELECT a.id AS src, b.id AS dst FROM facts a JOIN facts b ON a.day_key = b.day_key AND a.id < b.id WHERE {COMPATIBLE})"
A_PLACES, B_PLACES = "list_concat(a.tokens, string_split(a.ncity, ' '))", "list_concat(b.tokens, string_split(b.ncity, ' '))"
VENUE_LEVEL = f"({STRICT} OR (len(a.tokens) > 0 AND list_has_all({B_PLACES}, a.tokens)) OR (len(b.tokens) > 0 AND list_has_all({A_PLACES}, b.tokens)) OR list_has_any(a.tokens, b.tokens))"
ADDED = "list_filter(b.core, lambda w: NOT list_contains(a.core, w))"
ALLOWED = f"CASE WHEN len(a.tokens) = 0 OR a.vague THEN {A_PLACES} ELSE a.tokens END"
VARIANT_PAIRS = f"""sc AS (SELECT *, unnest(core) AS t FROM facts), cand AS (SELECT DISTINCT a.id AS x, b.id AS y FROM facts a JOIN sc b ON a.core[1] = b.t AND a.id <> b.id AND len(a.core) <= len(b.core) AND a.start_at <= b.until AND b.start_at <= a.until
  AND NOT (a.day_key = b.day_key AND a.norm = b.norm)),
vpairs AS (SELECT DISTINCT least(x, y) AS src, greatest(x, y) AS dst FROM cand JOIN facts a ON a.id = x JOIN facts b ON b.id = y WHERE list_has_all(b.core, a.core)
  AND CASE WHEN len({ADDED}) = 0 THEN {VENUE_LEVEL} ELSE list_has_all({ALLOWED}, {ADDED}) AND ({VENUE_LEVEL} OR (a.ncity <> '' AND a.ncity = b.ncity) OR {COMPATIBLE}) END)"""
ITEM_PAIRS = "ip AS (SELECT min(id) OVER (PARTITION BY item_key) AS src, id AS dst FROM facts WHERE item_key IS NOT NULL)"
ALL_EDGES = "ae AS (SELECT * FROM dp UNION SELECT * FROM vpairs UNION SELECT * FROM ip WHERE src <> dst)"
COMPONENTS = ", ".join([DAY_PAIRS, VARIANT_PAIRS, ITEM_PAIRS, ALL_EDGES, cc("facts", "ae", "comp")])


def id_events(spark, sf_dir):
    """Dated events with titles worded in several ways, specific, vague and missing venues, and shared items."""
    v = tables.venues(spark, sf_dir)
    city = F.when(F.col("id") % 9 == 0, "Ordem").otherwise(F.col("city"))
    v = v.select(F.col("id").alias("venue_id"), city.alias("city"), F.when(F.col("id") % 4 == 0, city).otherwise(F.replace("name", F.lit("Supplier#"), F.lit("Sala"))).alias("venue"))
    k, t = F.col("id"), F.col("title")
    title = F.when(k % 6 == 0, F.concat(F.lit("Festival de "), t)).when(k % 6 == 1, F.concat(t, F.lit(" em "), F.coalesce("city", F.lit("")))).when(k % 6 == 2, F.concat(F.upper(t), F.lit("!"))).otherwise(t)
    item = F.when(k % 60 < 3, F.concat(F.lit("i"), F.floor(k / 3).cast("string")))
    return spread(tables.events(spark, sf_dir).where("date_text is null"), "id").join(v, "venue_id", "left").select("id", title.alias("title"), "start_at", "end_at", "venue", "city", item.alias("item_key"), "categories")


def facts(spark, sf_dir):
    return R.event_facts(id_events(spark, sf_dir))


@query(sql("SELECT id, component FROM dcc", IDS, FACTS, DAY_PAIRS, cc("facts", "dp", "dcc")))
def event_pairs_day(spark, sf_dir):
    """What the same-day rule joins. Edges hang on hubs, so the classes are compared, not the edges."""
    from agendry.operators.graph import connected_components

    f = cut(facts(spark, sf_dir))
    found = connected_components(R.day_edges(f)).withColumnRenamed("node", "id")
    return f.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query(sql("SELECT src, dst FROM vpairs", IDS, FACTS, VARIANT_PAIRS))
def event_pairs_variant(spark, sf_dir):
    return R.variant_edges(facts(spark, sf_dir))


@query(sql("SELECT src, dst FROM ip WHERE src <> dst", IDS, FACTS, ITEM_PAIRS))
def event_pairs_item(spark, sf_dir):
    return R.item_edges(facts(spark, sf_dir))


@query(sql("SELECT id, component FROM comp", IDS, FACTS, COMPONENTS))
def event_components(spark, sf_dir):
    return R.event_components(cut(facts(spark, sf_dir)))


ROWS = f"""tr AS (SELECT event_id, min(coalesce(list_position({O.arr(C.TRUST)}, source) - 1, {len(C.TRUST)})) AS trust FROM cat_sources GROUP BY 1),
rows AS (SELECT f.id, comp.component, norm, start_at, end_at, item_key, trust FROM facts f JOIN comp USING (id) JOIN tr ON event_id = f.id)"""
# Clusters by the anchor rule: the next anchor is the first start more than the window after the last one.
ANCHORS = f"""tops AS (SELECT DISTINCT component, start_at FROM (SELECT *, min(trust) OVER (PARTITION BY component) AS best FROM rows) WHERE trust = best),
walk AS (SELECT component, min(start_at) AS anchor FROM tops GROUP BY 1 UNION ALL SELECT w.component, (SELECT min(t.start_at) FROM tops t WHERE t.component = w.component AND t.start_at > w.anchor + {C.SESSION_WINDOW}) AS anchor FROM walk w WHERE w.anchor IS NOT NULL),
anchors AS (SELECT component, anchor FROM walk WHERE anchor IS NOT NULL)"""
PLAN = f"""sp AS (SELECT *, coalesce(end_at - start_at >= {C.DAY} AND start_at <= min(start_at) OVER c AND end_at >= max(start_at) OVER c, false) AS spans FROM rows WINDOW c AS (PARTITION BY component)),
cf AS (SELECT component, arg_min(id, (trust, start_at, id)) FILTER (spans) AS span, count(DISTINCT item_key) AS items, count(*) FILTER (item_key IS NULL) AS loose, count(DISTINCT norm) AS wordings, arg_min(id, (trust, start_at, id)) AS best, min(trust) AS top,
  arg_min(id, (start_at, id)) AS first, max(coalesce(end_at, start_at)) AS last FROM sp GROUP BY 1),
kd AS (SELECT *, CASE WHEN span IS NOT NULL THEN 'span' WHEN items = 1 AND loose = 0 THEN 'item' WHEN wordings > 1 THEN 'wordings' ELSE 'sessions' END AS kind FROM cf),
keep AS (SELECT a.component, min(r.id) AS kid, a.anchor AS kstart FROM anchors a JOIN rows r ON r.component = a.component AND r.start_at = a.anchor JOIN kd ON kd.component = a.component AND r.trust = kd.top GROUP BY ALL),
near AS (SELECT r.id, arg_min(kid, (abs(kstart - r.start_at), kstart)) AS kid FROM rows r JOIN keep USING (component) GROUP BY 1),
pl AS (SELECT r.id, r.component, kind, CASE kind WHEN 'span' THEN span WHEN 'item' THEN first WHEN 'wordings' THEN best ELSE coalesce(k2.kid, near.kid) END AS keeper_id, CASE WHEN kind = 'item' AND r.id = first THEN last END AS new_end
  FROM rows r JOIN kd USING (component) JOIN near ON near.id = r.id LEFT JOIN keep k2 ON k2.kid = r.id)"""


def planned(spark, sf_dir):
    f = cut(facts(spark, sf_dir))  # three kinds of pairs and the plan read them
    trust = tables.event_sources(tables.events(spark, sf_dir)).groupBy(F.col("event_id").alias("id")).agg(F.min(P.trust(F.col("source"))).alias("trust"))
    rows = f.join(R.event_components(f), "id").join(trust, "id").select("id", "component", "norm", "start_at", "end_at", "item_key", "trust")
    return M.plan(cut(rows))


@query(sql("SELECT * FROM pl", IDS, FACTS, COMPONENTS, ROWS, ANCHORS, PLAN))
def merge_plan(spark, sf_dir):
    return planned(spark, sf_dir)


TITLE_DAY = f"td AS (SELECT {O.norm_title('title')} || '|' || {O.lisbon_day('start_at')} || '|' || venue_id AS component, start_at FROM cat_events)"
DAY_WALK = f"""st AS (SELECT DISTINCT * FROM td), walk AS (SELECT component, min(start_at) AS anchor FROM st GROUP BY 1 UNION ALL
  SELECT w.component, (SELECT min(t.start_at) FROM st t WHERE t.component = w.component AND t.start_at > w.anchor + {C.SESSION_WINDOW}) AS anchor FROM walk w WHERE w.anchor IS NOT NULL)"""


@query(sql("SELECT component, anchor FROM walk WHERE anchor IS NOT NULL", TITLE_DAY, DAY_WALK))
def session_clusters(spark, sf_dir):
    key = F.concat_ws("|", P.day_key(F.col("title"), F.col("start_at")), F.col("venue_id").cast("string"))
    return M.session_anchors(tables.events(spark, sf_dir).select(key.alias("component"), "start_at"))


PRINT = f"sha1({O.norm_title('title')} || '|' || {O.slugify(O.norm_venue(chr(99) + 'oalesce(venue, ' + chr(39) * 2 + ')'))} || '|' || {O.lisbon_minute('start_at')})"
KEPT = f"""lab AS (SELECT component, list_sort(list_distinct(list(c))) AS cs FROM (SELECT component, unnest(categories) AS c FROM ids JOIN pl USING (id)) GROUP BY 1),
kept AS (SELECT id, component, title, venue, city, start_at, coalesce(new_end, end_at) AS end_at, array_to_string(cs, ',') AS categories, {PRINT} AS fingerprint FROM ids JOIN pl USING (id) JOIN lab USING (component) WHERE id = keeper_id)"""


def kept(spark, sf_dir):
    return M.survivors(id_events(spark, sf_dir), planned(spark, sf_dir))


@query(sql("SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY id) = 1", IDS, FACTS, COMPONENTS, ROWS, ANCHORS, PLAN, KEPT))
def survivors(spark, sf_dir):
    return kept(spark, sf_dir).withColumn("categories", F.array_join("categories", ","))


@query(sql("SELECT keeper_id AS event_id, source, arg_min(coalesce(source_event_id, '-'), (event_id <> keeper_id, event_id)) AS source_event_id FROM cat_sources JOIN pl ON pl.id = event_id GROUP BY ALL", IDS, FACTS, COMPONENTS, ROWS, ANCHORS, PLAN))
def attribution_moves(spark, sf_dir):
    sources = tables.event_sources(tables.events(spark, sf_dir)).withColumn("source_event_id", F.coalesce("source_event_id", F.lit("-")))
    return M.move_attributions(sources, planned(spark, sf_dir))


@query()
def reconcile_twice(spark, sf_dir):
    """(run, rows, absorbed): a reconciliation goes on until nothing merges, so a second run absorbs none."""
    from agendry.plans.ingest import reconcile

    rows = id_events(spark, sf_dir).withColumns({"venue_id": F.lit(None).cast("bigint"), "url": F.lit(None).cast("string"), "date_text": F.lit(None).cast("string")})
    print_ = P.fingerprint(F.col("title"), F.col("venue"), F.col("start_at"))
    columns = ("id", "title", "start_at", "end_at", "venue_id", "venue", "city", "url", "categories", "date_text")
    events = cut(rows.select(*columns, print_.alias("fingerprint")))
    sources = cut(tables.event_sources(tables.events(spark, sf_dir)))
    once, moved, absorbed = reconcile(events, sources)
    _, _, again = reconcile(once, moved)
    return spark.createDataFrame([(1, events.count(), absorbed), (2, once.count(), again)], "run int, rows long, absorbed long")
