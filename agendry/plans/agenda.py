"""Reads of the catalogue: lists, session merging, filters, facets, tallies and periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agendry import constants as C
from agendry.functions import text as T
from agendry.functions.dates import lisbon, lisbon_day, shift_day, weekday

MAX_ROWS = 2000


def with_venues(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events with their venue's columns, null where the venue is unknown."""
    v = venues.select(F.col("id").alias("venue_id"), *[F.col(c).alias(f"venue_{c}") for c in ("name", "city", "lat", "lng", "scope")])
    return events.join(v, "venue_id", "left")


def window(events: DataFrame, start: int | None = None, end: int | None = None, undated: bool = False, category: str | None = None, include_running: bool = False) -> DataFrame:
    """Rows of a time range; null options filter nothing. ``include_running`` keeps rows that began before and still run."""
    out = events if undated else events.where("date_text is null")
    if start is not None:
        out = out.where((F.coalesce("end_at", "start_at") if include_running else F.col("start_at")) >= start)
    if end is not None:
        out = out.where(F.col("start_at") <= end)
    return out.where(F.exists("categories", lambda c: F.lower(c) == category.lower())) if category else out


def page(rows: DataFrame, limit: int = MAX_ROWS, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= MAX_ROWS or offset < 0:
        raise ValueError(f"limit must be 1 to {MAX_ROWS} and offset not negative")
    return rows.orderBy("start_at", "id").offset(offset).limit(limit)


def merge_sessions(rows: DataFrame) -> DataFrame:
    """One row for the sessions of a title at a venue on a Lisbon day: the earliest row and all starts."""
    keyed = rows.withColumn("_key", T.norm_title_ascii(F.col("title"))).withColumn("_day", lisbon_day(F.col("start_at")))
    first = F.min_by(F.struct(*rows.columns), F.struct("start_at", "id"))
    merged = keyed.groupBy("_key", "venue_id", "_day").agg(first.alias("row"), F.array_sort(F.collect_set("start_at")).alias("session_starts"))
    return merged.select("row.*", "session_starts")


def concelho(city: Column) -> Column:
    return F.coalesce(city, F.lit(""))


def facet(rows: DataFrame, value: Column, label: Column | None = None) -> DataFrame:
    """(value, label, count): the label is the first seen by start and id."""
    label = value if label is None else label
    return rows.where(value.isNotNull() & (value != "")).groupBy(value.alias("value")).agg(F.min_by(label, F.struct("start_at", "id")).alias("label"), F.count("*").alias("count"))


def ranked(tally: DataFrame, take: int | None = None) -> DataFrame:
    """By count, then by label in Portuguese order."""
    out = tally.orderBy(F.desc("count"), F.collate(F.col("label"), "pt"), "value")
    return out.limit(take) if take else out


def day_label(day: Column, today: str) -> Column:
    tomorrow = F.lit(today).cast("date") + F.expr("interval 1 day")
    names = F.array(*[F.lit(w) for w in C.WEEKDAYS])
    return F.when(day == today, "Hoje").when(day.cast("date") == tomorrow.cast("date"), "Amanhã").otherwise(F.element_at(names, weekday(day) + 1))


def has_clock(t: Column) -> Column:
    return F.date_format(lisbon(t), "HH:mm") != "00:00"


def valid_place(lat: Column, lng: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c)
    return finite(lat) & finite(lng) & (F.abs(lat) <= 90) & (F.abs(lng) <= 180)


def pins(rows: DataFrame) -> DataFrame:
    """(key, name, city, lat, lng, count) of places on the map: located, named and no whole concelho."""
    key = F.coalesce(F.col("venue_id").cast("string"), F.lower("venue_name"))
    first = F.min_by(F.struct(F.col("venue_name").alias("name"), F.col("venue_city").alias("city"), F.col("venue_lat").alias("lat"), F.col("venue_lng").alias("lng")), F.struct("start_at", "id"))
    shown = rows.where(valid_place(F.col("venue_lat"), F.col("venue_lng")) & (F.col("venue_scope") != "concelho") & (F.coalesce("venue_name", F.lit("")) != ""))
    return shown.groupBy(key.alias("key")).agg(first.alias("v"), F.count("*").alias("count")).select("key", "v.*", "count")


def ramp(count: Column, peak: Column, low: float, high: float, empty: float | None = None) -> Column:
    """Grows with the root of the share of the peak."""
    grown = F.lit(low) + F.lit(high) * F.sqrt(count / peak)
    return grown if empty is None else F.when(count == 0, F.lit(empty)).otherwise(grown)


PERIODS = ("hoje", "amanha", "fim-de-semana", "7-dias", "30-dias")


def periods(days: DataFrame, today: str = "day") -> DataFrame:
    """(day, period, ord, from_day, to_day): each preset as seen from each day."""
    d = F.col(today)
    saturday, sunday = F.greatest(d, shift_day(d, 5 - weekday(d))), shift_day(d, 6 - weekday(d))
    ranges = ((d, d), (shift_day(d, 1), shift_day(d, 1)), (saturday, sunday), (d, shift_day(d, 6)), (d, shift_day(d, 29)))
    all_ = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(name).alias("period"), a.alias("from_day"), b.alias("to_day")) for i, (name, (a, b)) in enumerate(zip(PERIODS, ranges))])
    return days.select(d.alias("day"), F.explode(all_).alias("p")).select("day", "p.period", "p.ord", "p.from_day", "p.to_day")


def active_period(ranges: DataFrame) -> DataFrame:
    """(day, from_day, to_day, period): the first preset that equals a range, or null."""
    known = periods(ranges.select("day").distinct())
    met = ranges.join(known, ["day", "from_day", "to_day"], "left")
    return met.groupBy("day", "from_day", "to_day").agg(F.min_by("period", "ord").alias("period"))


def split_saved(saved: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """(user_id, slug, bucket, rank): upcoming by time, past by time falling, missing last."""
    t = F.coalesce("end_at", "start_at")
    met = saved.join(events.select("slug", "start_at", "end_at"), "slug", "left")
    bucket = F.when(F.col("start_at").isNull(), "missing").when(t >= now, "upcoming").otherwise("past")
    key = F.when(t >= now, t).otherwise(-t)
    per_user = Window.partitionBy("user_id", "bucket").orderBy(F.col("_key").asc_nulls_last(), "slug")
    return met.withColumn("bucket", bucket).withColumn("_key", key).withColumn("rank", F.row_number().over(per_user)).select("user_id", "slug", "bucket", "rank")


def list_events(events: DataFrame, venues: DataFrame, options: dict | None = None) -> DataFrame:
    """Events (with a slug of their venue) that an options dict selects: undated, venue, from, to, city, category.

    Empty and absent options filter nothing. A category is looked for in the JSON text of the list, ASCII letters
    in any case; % and _ in it are wildcards, as in LIKE.
    """
    o = {k: v for k, v in (options or {}).items() if v not in (None, "")}
    rows = with_venues(events, venues).withColumn("venue_slug", T.slugify(F.col("venue_name")))
    rows = window(rows, o.get("from"), o.get("to"), bool(o.get("undated")))
    if "venue" in o:
        rows = rows.where(F.col("venue_slug") == o["venue"])
    if "city" in o:
        rows = rows.where(F.col("venue_city") == o["city"])
    if "category" in o:
        low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        rows = rows.where(low(F.to_json("categories")).like(f'%"{o["category"].translate({i: i + 32 for i in range(65, 91)})}"%'))
    return rows


def repaired(options: dict) -> dict:
    """The options without their ``from`` where it lies after ``to``."""
    first, last = options.get("from"), options.get("to")
    backwards = first not in (None, "") and last not in (None, "") and first > last
    return {k: v for k, v in options.items() if not (backwards and k == "from")}


def tally_concelhos(rows: DataFrame, city: str) -> DataFrame:
    """(name, count, mappable, ord): rows of each concelho by count, then name; rows without a place come last.

    A parish counts for its concelho; a place that is not of the district keeps its own name and cannot be mapped.
    """
    from agendry.functions import places as P

    folded = P.with_municipality(rows, city, "_municipality")
    name = F.nullif(F.coalesce("_municipality", F.col(city), F.lit("")), F.lit(""))
    counted = folded.groupBy(name.alias("name")).agg(F.count("*").alias("count"))
    named = counted.select(F.coalesce("name", F.lit("Sem concelho")).alias("name"), "count", F.coalesce(F.col("name").isin(*C.MUNICIPALITIES), F.lit(False)).alias("mappable"), F.col("name").isNull().alias("_last"))
    ord_ = F.row_number().over(Window.orderBy("_last", F.desc("count"), F.collate("name", "pt"))).alias("ord")
    return named.select("name", "count", "mappable", ord_)  # one row for each place name


#: Columns of the public list and of an event's page, by the names under which they are served.
PUBLIC = {
    "id": "id", "title": "title", "slug": "slug", "startAt": "start_at", "endAt": "end_at", "venueId": "venue_id", "venueName": "venue_name", "venueCity": "venue_city", "venueSlug": "venue_slug",
    "venueLat": "venue_lat", "venueLng": "venue_lng", "venueScope": "venue_scope", "imageUrl": "image_url", "url": "url", "categories": "categories", "dateText": "date_text",
}
DETAIL = {"description": "description", "updatedAt": "updated_at"}


def public(rows: DataFrame, detail: bool = False) -> DataFrame:
    """The served columns of events with their venue's; missing categories are an empty list, descriptions come with ``detail`` only."""
    none = F.array().cast("array<string>")
    names = PUBLIC | (DETAIL if detail else {})
    return rows.select(*[(F.coalesce(c, none) if c == "categories" else F.col(c)).alias(n) for n, c in names.items()])


def newest_saved(saved: DataFrame) -> DataFrame:
    """(user_id, slug, rank) of saved rows (user_id, slug, created_at): the newest first, then by slug."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), "slug")
    return saved.select("user_id", "slug", F.row_number().over(w).alias("rank"))
