"""SQL twins of the Column functions, and the common views, as DuckDB can run them."""

from __future__ import annotations

from agendry import constants as C


def lit(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


def norm_title(x: str) -> str:
    return rf"trim(regexp_replace({fold(x)}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def norm_title_ascii(x: str) -> str:
    return f"trim(regexp_replace({fold(x)}, '[^a-z0-9]+', ' ', 'g'))"


def norm_place(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({fold(x)}, '[-_]+', ' ', 'g'), '[\s\x{{a0}}]+', ' ', 'g'))"


def slugify(x: str) -> str:
    return rf"""regexp_replace(regexp_replace(regexp_replace({fold(x)}, '[''’"|·•&]', '', 'g'), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"""


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def norm_venue(x: str) -> str:
    flat = rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
    cases = " ".join(f"WHEN starts_with({flat}, {lit(p)}) THEN trim(substr({flat}, {len(p) + 1}))" for p in C.VENUE_PREFIXES)
    return f"(CASE {cases} ELSE {flat} END)"


def norm_city(x: str) -> str:
    base = norm_title(rf"regexp_replace(coalesce({x}, ''), '\s*\([^)]*\)\s*', ' ', 'g')")
    kept = f"list_filter(string_split({base}, ' '), lambda w: w <> '' AND NOT list_contains({arr(C.CITY_FILLERS)}, w))"
    return f"(CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {base} END)"


def venue_tokens(name: str, city: str) -> str:
    named = f"coalesce({name}, '')"
    all_words = f"string_split({norm_title(norm_venue(named))}, ' ')"
    stop = arr([*C.VENUE_STOPWORDS, *C.GENERIC_VENUE_WORDS])
    return f"list_sort(list_distinct(list_filter({all_words}, lambda w: length(w) >= 3 AND NOT list_contains({stop}, w) AND NOT list_contains(string_split({norm_city(city)}, ' '), w))))"


def is_vague(name: str, city: str) -> str:
    return f"(len(list_filter({venue_tokens(name, city)}, lambda w: NOT list_contains({arr(C.DISTRICT_WORDS)}, w) AND NOT list_contains(string_split({norm_city(city)}, ' '), w))) = 0)"


def title_core(x: str) -> str:
    """Distinct words in their order: the first place of each decides."""
    kept = rf"list_filter(string_split({norm_title(x)}, ' '), lambda w: w <> '' AND NOT list_contains({arr(C.TITLE_NOISE)}, w) AND NOT regexp_full_match(w, '\d+'))"
    return f"list_filter({kept}, lambda w, i: list_position({kept}, w) = i)"


def lisbon(t: str) -> str:
    return f"timezone('Europe/Lisbon', to_timestamp({t}))"


def lisbon_day(t: str) -> str:
    return f"strftime({lisbon(t)}, '%Y-%m-%d')"


def lisbon_minute(t: str) -> str:
    return f"strftime({lisbon(t)}, '%Y-%m-%d %H:%M')"


def epoch_of(ts: str, zone: str = C.LISBON) -> str:
    return f"CAST(epoch(timezone('{zone}', {ts})) AS BIGINT)"


SOURCES = [*C.TRUST, "other"]

VENUES = """cat_venues AS (SELECT s_suppkey AS id, s_name AS name, n_name AS city, r_name AS district,
  CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(39 AS DOUBLE) + (s_suppkey % 100) / CAST(100 AS DOUBLE) END AS lat,
  CAST(-9 AS DOUBLE) + (s_suppkey % 50) / CAST(100 AS DOUBLE) AS lng,
  CASE s_suppkey % 10 WHEN 0 THEN 'concelho' WHEN 1 THEN 'lugar' ELSE 'venue' END AS scope
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EVENTS = f"""cat_events0 AS (SELECT event_id AS id, event_type AS title, CAST(floor(epoch(ts)) AS BIGINT) AS start_at, user_id AS venue_id, value,
  CASE WHEN event_id % 50 = 0 THEN 'TBA' END AS date_text, [event_type, 'k' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10)] AS categories,
  {arr(SOURCES)}[CAST(event_id % 8 AS INTEGER) + 1] AS source, CASE WHEN event_id % 4 <> 0 THEN 'i' || CAST(event_id // 3 AS BIGINT) END AS source_event_id FROM events),
cat_events AS (SELECT id, title, start_at, CASE WHEN id % 5 = 0 THEN start_at + CAST(floor(value * 3600) AS BIGINT) END AS end_at, venue_id, date_text, categories, source, source_event_id FROM cat_events0)"""
LINKS = "cat_sources AS (SELECT id AS event_id, " + arr(SOURCES) + "[CAST((id + k) % 8 AS INTEGER) + 1] AS source, source_event_id FROM cat_events, unnest(range(0, id % 3 + 1)) AS t(k))"


def sql(body: str, *extra: str) -> str:
    return "WITH " + ",\n".join([VENUES, EVENTS, LINKS, *extra]) + "\n" + body
