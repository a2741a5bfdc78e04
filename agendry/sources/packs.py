"""Rule packs: how single listings are read, as data for the extraction jobs.

A pack names a source, reads rows of fields from a payload column, and says what each field of a raw event is.
``extract`` runs a pack over a table of fetched payloads (url, html), explodes its rows and gives staging rows with
the reason why a row cannot be an event, if any. Patterns are the formats that the sites publish.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from agendry import constants as C
from agendry.functions import dates as D, places as P, text as T
from agendry.sources import extract as X, selectors as S

UNKNOWN = "Local a definir"
EMPTY = ("description", "endAt", "dateText", "imageUrl")


@dataclass(frozen=True)
class Pack:
    """``read`` gives an array of structs of a payload; ``raw`` gives raw event columns of such a struct and the page's url.

    ``tolerance`` is how long after its end an event is still taken; ``gated`` packs drop rows out of the district.
    """

    source: str
    read: Callable[[Column], Column]
    raw: Callable[[Column, Column, int], dict[str, Column]]
    tolerance: int = 0
    gated: bool = True
    #: Values of a row that ``raw`` reads several times, as further fields of the struct; they are computed once.
    bind: Callable[[Column, Column, int], dict[str, Column]] | None = None


def _page(**fields: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A reader of pages that hold one row each."""
    return lambda html: F.array(F.struct(*[f(html).alias(n) for n, f in fields.items()]))


def _jsonld(html: Column) -> Column:
    node = X.first_event(X.jsonld_nodes(html))
    get = lambda v, path: F.nullif(F.trim(F.try_variant_get(v, path, "string")), F.lit(""))
    row = lambda v: F.struct(*X.jsonld_fields(v), get(v, "$.description").alias("description"), get(v, "$.url").alias("url"))
    return F.filter(F.transform(F.array(node), lambda v: F.when(v.isNotNull(), row(v))), lambda r: r.isNotNull())


def _tail(url: Column, marker: str, joined: str = ".") -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, marker + "(.*)$", 1), "^/+|/+$", ""), "/+", joined)


def _named(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _card_day(r: Column, at: str) -> Column:
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    year = F.lit(2000) + F.right(digits(r[f"{at}_year"]), F.lit(2)).cast("int")
    return D.wall_clock(year, D.month_number(r[f"{at}_month"]), digits(r[f"{at}_day"]))


def _end_of(day: Column) -> Column:
    return D.last_minute(D.lisbon_day(day))


def _feed(r: Column, url: Column, now: int) -> dict[str, Column]:
    date = r["announced"]
    slug = F.element_at(F.filter(F.split(r["link"], "/"), lambda p: p != ""), -1)
    return {
        "title": r["title"], "slug": slug, "description": F.substring(r["description"], 1, 600), "startAt": date["at"],
        "dateText": F.when(date.isNull(), D.date_sentence(r["description"])), "venueName": T.prose_venue(r["description"]),
        "city": F.lit("Leiria"), "categories": P.drop_pseudo(r["categories"]), "url": r["link"],
    }


def _fair(r: Column, url: Column, now: int) -> dict[str, Column]:
    start = r["start"]
    locality, place = (F.nullif(F.trim(r[n]), F.lit("")) for n in ("locality", "place"))
    return {
        "title": F.trim(r["name"]), "slug": _named("fe-", _tail(url, "/eventos/")), "description": r["description"], "startAt": start,
        "endAt": F.when(start.isNotNull(), F.coalesce(D.last_second(D.day_epoch(r["end_date"])), F.when(F.coalesce(r["end_date"], F.lit("")) == "", start))),
        "venueName": F.coalesce(place, locality, F.lit(UNKNOWN)), "city": F.coalesce(locality, F.trim(F.substring_index(place, ",", 1))),
        "categories": F.array(P.fair_category(r["name"])), "imageUrl": r["image"], "url": url,
    }


def _club(r: Column, url: Column, now: int) -> dict[str, Column]:
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return {
        "title": some(r["name"]), "slug": _named("sg-", _tail(url, "/events/")), "description": r["description"], "startAt": D.iso_epoch(r["start_date"]), "endAt": D.iso_epoch(r["end_date"]),
        "venueName": F.coalesce(some(r["place"]), F.lit(UNKNOWN)), "city": some(r["locality"]), "imageUrl": r["image"], "url": F.coalesce(r["url"], url),
    }


def _town(r: Column, url: Column, now: int) -> dict[str, Column]:
    span, place = r["span"], r["placed"]
    return {
        "title": r["title"], "slug": _named("ob-", _tail(url, "/evento/")), "description": r["description"], "startAt": D.day_epoch(span["start"]), "endAt": D.last_minute(span["end"]),
        "dateText": F.when(span.isNull(), r["date"]), "venueName": place["venue"], "city": place["city"], "categories": F.array(P.town_category(r["title"])), "imageUrl": r["image"], "url": url,
    }


def _hall(r: Column, url: Column, now: int) -> dict[str, Column]:
    at, undated = r["at"], r["span"].isNull()
    venue = F.nullif(F.trim(r["venue"]), F.lit(""))
    return {
        "title": F.coalesce(F.nullif(F.trim(r["title"]), F.lit("")), venue), "slug": _named("cf-", _tail(url, "/salaodefestas/")), "startAt": at["start"], "endAt": at["end"],
        "dateText": F.when(undated, r["date"]), "venueName": F.coalesce(venue, F.lit(UNKNOWN)), "city": venue, "categories": F.array(F.lit("Tradição")), "url": url,
    }


def council(prefix: str | None = None, town: str | None = None) -> Pack:
    """A council's agenda, or that of whichever council a page's host is: widgets, add-to-calendar variables and meta elements of a detail page."""
    read = _page(
        title=lambda h: F.coalesce(X.calendar_var(h, "title"), X.field(h, r"(?s)<h1[^>]*>(.*?)</h1>"), X.meta(h, "og:title")), start=lambda h: X.calendar_var(h, "date_start"), end=lambda h: X.calendar_var(h, "date_end"),
        place=lambda h: X.calendar_var(h, "location"), local=lambda h: X.widget_text(h, "location"), categories=lambda h: X.widget_spans(h, "categories"),
        description=lambda h: F.coalesce(X.widget_text(h, "summary"), X.meta(h, "description")), image=lambda h: X.meta(h, "og:image"), content=lambda h: X.meta(h, "content_date"),
        published=lambda h: X.meta(h, "published_at"), modified=lambda h: X.meta(h, "last_modified_date"), chip=lambda h: D.chip_dates(X.widget_part(h, "dates")),
    )

    host = lambda url, i: F.create_map(*[F.lit(x) for row in C.COUNCILS for x in (row[0], row[i])])[F.regexp_extract(url, "^[a-z]+://([^/]*)", 1)]

    def raw(r: Column, url: Column, now: int) -> dict[str, Column]:
        start, city = r["begins"], r["city"]
        return {
            "title": r["title"], "slug": F.concat(r["prefix"], T.source_id("", url, "/evento/")), "description": r["description"], "startAt": start,
            "endAt": D.later_end(start, F.coalesce(D.strict_clock(r["end"]), r["chip"]["latest"])), "venueName": T.pick_venue(city, r["local"], r["place"]), "city": city,
            "categories": r["categories"], "imageUrl": r["image"], "url": url,
        }

    begins = lambda r, url, now: {
        "begins": F.coalesce(D.typed_start(r["start"], r["published"], r["modified"]), D.strict_clock(r["content"]), r["chip"]["earliest"]),
        "prefix": F.lit(prefix) if prefix else host(url, 1), "city": F.lit(town) if town else host(url, 2),
    }
    return Pack("municipal", read, raw, C.DAY, bind=begins)


def _listing(r: Column, url: Column, now: int) -> dict[str, Column]:
    start = r["begins"]
    return {
        "title": r["title"], "slug": _named("cl-", F.regexp_replace(r["slug"], "^/+|/+$", "")), "startAt": start, "endAt": F.coalesce(_end_of(_card_day(r, "end")), _end_of(start)),
        "venueName": F.lit("Caldas da Rainha"), "city": F.lit("Caldas da Rainha"), "categories": F.array_compact(F.array(r["category"])), "url": _named("/agenda/", r["slug"]),
    }


def _hub(r: Column, url: Column, now: int) -> dict[str, Column]:
    scope = r["scope"]
    label, venue = F.coalesce(scope["city"], F.lit("")), F.coalesce(scope["venue"], F.lit(""))
    named = F.when(T.is_feed_venue(F.coalesce(r["venue_slug"], F.lit("")), venue), F.coalesce(F.nullif(label, F.lit("")), venue)).otherwise(F.coalesce(F.nullif(venue, F.lit("")), label))
    return {
        "title": r["title"], "slug": _named("nocartaz-", r["id"]), "description": r["pitch"], "startAt": F.coalesce(D.iso_epoch(r["starts_at"]), D.iso_epoch(r["date"])), "venueName": named, "city": scope["city"],
        "categories": P.genre_categories(F.coalesce(r["genre"], F.lit(""))), "imageUrl": r["image"], "url": _named("/eventos/", r["id"], "/"), "_in_scope": scope["in_scope"],
    }


def _board_times(r: Column) -> tuple[Column, Column]:
    return F.substring_index(r["time"], "djev_time_to", 1), F.when(F.contains(r["time"], F.lit("djev_time_to")), F.substring_index(r["time"], "djev_time_to", -1))


def _board_dates(r: Column, url: Column, now: int) -> dict[str, Column]:
    first, last = _board_times(r)
    return {"begins": F.coalesce(D.long_date(first), D.day_epoch(D.captured(r["href"], r"/details/(\d{4}-\d{2}-\d{2})/", 1))), "to": D.long_date(last)}


def _hub_scope(r: Column, url: Column, now: int) -> dict[str, Column]:
    return {"scope": P.resolve_scope(r["title"], r["title"], F.coalesce(F.regexp_replace(r["chip"], r"^[·\s]+", ""), r["concelho"]), r["venue"])}


def _board(r: Column, url: Column, now: int) -> dict[str, Column]:
    """The start is before the mark of the end; a start without a time ends with its day, and so does an end."""
    timed = lambda c: D.captured(c, D.LONG_DATE, 4).isNotNull()
    (first, last), start, to = _board_times(r), r["begins"], r["to"]
    end = F.when(to.isNotNull(), F.when(timed(last), to).otherwise(_end_of(to))).when(~timed(first), _end_of(start))
    bare = F.regexp_replace(F.regexp_replace(r["href"], "[?#].*$", ""), "/+$", "")
    return {
        "title": r["title"], "slug": F.element_at(F.split(bare, "/"), -1), "description": r["intro"], "startAt": start, "endAt": end, "venueName": F.coalesce(r["city"], F.lit(UNKNOWN)), "city": r["city"],
        "categories": F.array_compact(F.array(r["category"])), "imageUrl": r["image"], "url": r["href"],
    }


CALDAS = {
    "slug": r'href="/agenda/([^"]+)"', "title": r'__card-title"><span>([^<]*)</span></h2>', "category": r'__card-category">([^<]*)<',
    "start_day": r'__start-date__day">([^<]*)<', "start_month": r'__start-date__month">([^<]*)<', "start_year": r'__start-date__year">([^<]*)<',
    "end_day": r'__end-date__day">([^<]*)<', "end_month": r'__end-date__month">([^<]*)<', "end_year": r'__end-date__year">([^<]*)<',
}
NOCARTAZ = {
    "id": r'^[^>]*data-id="([^"]*)"', "concelho": r'^[^>]*data-concelho="([^"]*)"', "date": r'^[^>]*data-date="([^"]*)"', "starts_at": r'^[^>]*data-starts-at="([^"]*)"', "genre": r'^[^>]*data-genre="([^"]*)"',
    "venue_slug": r'^[^>]*data-venue="([^"]*)"', "title": r"(?s)<h3[^>]*>(.*?)</h3>", "venue": r'(?s)class="where">\s*<span>(.*?)</span>', "chip": r'(?s)<span class="concelho">(.*?)</span>',
    "pitch": r'(?s)<p class="pitch-line">(.*?)</p>', "image": r'(?s)<div class="card-thumb">.*?<img[^>]+src="([^"]+)"',
}
FIGUEIRO = {
    "href": r'(?is)<h2[^>]*class="[^"]*djev_item_title[^"]*".{0,200}?<a[^>]*href="([^"]+)"', "title": r'(?is)<h2[^>]*class="[^"]*djev_item_title[^"]*".{0,200}?<a[^>]*>(.*?)</a>',
    "city": r'(?is)<a[^>]*class="[^"]*djev_city[^"]*"[^>]*>(.*?)</a>', "category": r'(?is)<a[^>]*class="[^"]*djev_category[^"]*"[^>]*>(.*?)</a>',
    "intro": r'(?is)<div[^>]*class="[^"]*djev_intro[^"]*"[^>]*>(.*?)</div>', "image": r'(?is)<img[^>]*class="[^"]*djev_image[^"]*"[^>]*src="([^"]+)"',
}


def _board_items(html: Column) -> Column:
    """Cards of the board; the time block keeps its markup, which tells the end from the start."""
    parts = F.split(html, r'<div[^>]*class="[^"]*\bdjev_item\b', -1)
    time = lambda b: F.regexp_extract(b, r'(?is)<h4[^>]*class="[^"]*djev_time[^"]*"[^>]*>(.*?)</h4>', 1).alias("time")
    rows = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda b: X.fielded(b, FIGUEIRO, time(b)))
    return F.filter(rows, lambda r: r["href"].isNotNull() & r["title"].isNotNull())


def _headings(html: Column) -> Column:
    cells = X.all_groups(html, r'<h[12][^>]*class="[^"]*elementor-heading-title[^"]*"[^>]*>([^<]*)</h[12]>')
    og = F.regexp_replace(X.meta(html, "og:title"), r"(?i)\s*-\s*Cister FM.*$", "")
    row = lambda h: F.struct(F.coalesce(F.nullif(F.trim(F.try_element_at(h, F.lit(1))), F.lit("")), og).alias("title"), X.after_label(h, "data evento").alias("date"), X.after_label(h, "local").alias("venue"))
    return F.transform(F.array(F.transform(cells, lambda c: F.trim(c))), row)


def _spans(html: Column) -> Column:
    block = F.regexp_extract(html, r'(?is)<div class="date-location">(.*?)</div>', 1)
    return F.filter(F.transform(X.all_groups(block, r"(?is)<span>(.*?)</span>"), lambda s: T.plain_text(s)), lambda s: s != "")


PACKS = {
    p.source: p
    for p in (
        Pack("cmleiriarss", X.rss_items, _feed, gated=False, bind=lambda r, url, now: {"announced": D.free_date(r["description"], F.coalesce(r["published"], F.lit(now)))}),
        Pack("festasearraiais", _jsonld, _fair, bind=lambda r, url, now: {"start": D.day_epoch(r["start_date"])}),
        Pack("shotgun", _jsonld, _club),
        Pack("obidos", _page(
            title=lambda h: F.coalesce(X.field(h, r'(?is)<h2 class="banner-title">(.*?)</h2>'), F.regexp_replace(X.meta(h, "og:title"), r"(?is)\s*-\s*Agenda Cultural.*$", "")),
            date=lambda h: F.try_element_at(_spans(h), F.lit(1)), venue=lambda h: F.try_element_at(_spans(h), F.lit(2)),
            description=lambda h: X.field(h, r'(?is)<div class="etn-event-content-body">(.*?)<div class="event-share">'), image=lambda h: X.meta(h, "og:image")), _town,
            bind=lambda r, url, now: {"span": D.date_range(r["date"]), "placed": P.tail_city(r["venue"], "Óbidos")}),
        Pack("cisterfestas", _headings, _hall, bind=lambda r, url, now: {"span": D.day_span(r["date"]), "at": D.infer_epochs(D.day_span(r["date"]), now)}),
        council("mg", "Marinha Grande"),
        Pack("caldas", lambda h: X.cards(h, '<div class="events-card">', CALDAS, ("slug", "title", "start_day", "start_month", "start_year")), _listing, C.DAY, bind=lambda r, url, now: {"begins": _card_day(r, "start")}),
        Pack("nocartaz", lambda h: X.cards(h, '<article class="event-card', NOCARTAZ, ("id",), "id"), _hub, C.DAY, bind=_hub_scope),
        Pack("figueiro", _board_items, _board, bind=_board_dates),
    )
}


#: The agendas of all councils, each page with the prefix and the place of its host; pages of other hosts have neither.
COUNCILS = council()


def hub_rows(cards: DataFrame) -> DataFrame:
    """Cards (hub, page_id, pos, id, title, venue, ...) of all hubs, of an id the first in the order of hubs.

    All cards of the first hub are taken. Of the others only those that a known venue names, in their venue or, without a
    usable one, after the title's @, or in the title itself: another district's roster is never taken whole. Cards of unknown hubs go.
    """
    rank = F.array_position(F.array(*[F.lit(h) for h in C.HUBS]), F.col("hub"))
    evidence = F.coalesce(T.usable_venue(F.col("venue")), T.title_venue(F.col("title")))
    known = P.known_venue(evidence).isNotNull() | P.known_venue(F.col("title")).isNotNull()
    kept = cards.withColumn("rank", rank).where((F.col("rank") == 1) | ((F.col("rank") > 1) & known))
    return first_by(kept, "id", "rank", "page_id", "pos").drop("rank")


def hub_events(pages: DataFrame, details: DataFrame, now: int) -> DataFrame:
    """Raw events of an aggregator's hub pages (hub, page_id, html) and detail pages (url, html), with drop reasons.

    Candidates are a page's cards and then the entries of its item lists, by hub_rows(). A detail's JSON-LD node with a start overrides
    title, time, venue and place; entries have no date but their detail's. Reasons are those of extract().
    """
    fields = [*NOCARTAZ]
    cards = pages.select("hub", "page_id", F.posexplode(X.cards(F.col("html"), '<article class="event-card', NOCARTAZ, ("id",), "id")).alias("pos", "r")).select("hub", "page_id", "pos", *[F.col(f"r.{n}").alias(n) for n in fields])
    lists = F.filter(X.jsonld_nodes(F.col("html")), lambda v: F.try_variant_get(v, "$['@type']", "string") == "ItemList")
    entries = F.flatten(F.transform(lists, lambda v: F.coalesce(F.try_variant_get(v, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))))
    entry = pages.select("hub", "page_id", F.posexplode(entries).alias("pos", "v")).select(
        "hub", "page_id", (F.col("pos") + (1 << 20)).alias("pos"), F.regexp_extract(F.coalesce(F.try_variant_get("v", "$.url", "string"), F.lit("")), "/eventos/([0-9a-f]+)/", 1).alias("id"),
        F.trim(T.decode_entities(F.try_variant_get("v", "$.name", "string"))).alias("title"),
    ).where("id <> '' and title <> ''")
    named = hub_rows(cards.unionByName(entry, allowMissingColumns=True))
    dated = F.filter(X.jsonld_nodes(F.col("html")), lambda v: F.schema_of_variant(F.try_variant_get(v, "$.startDate", "variant")) == "STRING")
    node = details.select(F.regexp_extract("url", "/eventos/([0-9a-f]+)/", 1).alias("id"), F.try_element_at(dated, F.lit(1)).alias("v"))
    get = lambda *paths: _some(T.decode_entities(F.coalesce(*[F.try_variant_get("v", p, "string") for p in paths])))
    detail = node.select("id", get("$.name").alias("d_title"), get("$.startDate").alias("d_start"), get("$.endDate").alias("d_end"), get("$.location.name").alias("d_venue"), get("$.location.address.addressLocality").alias("d_city"), get("$.description").alias("d_text"), get("$.image[0]", "$.image").alias("d_image"))
    clean = F.trim(F.regexp_replace(F.coalesce("d_title", "title"), r"\s+", " "))
    own = F.coalesce("d_city", F.regexp_replace("chip", r"^[·\s]+", ""), "concelho")
    joined = named.join(detail, "id", "left").withColumn("_title", clean).withColumn("_scope", P.resolve_scope(F.col("_title"), F.col("title"), own, F.col("d_venue"), F.col("venue")))
    start = F.coalesce(D.iso_epoch(F.col("d_start")), D.iso_epoch(F.col("starts_at")), D.iso_epoch(F.col("date")))
    timed = joined.withColumn("startAt", start).withColumn("endAt", D.later_end(F.col("startAt"), D.iso_epoch(F.col("d_end"))))
    label, venue = F.coalesce("_scope.city", F.lit("")), F.coalesce("_scope.venue", F.lit(""))
    room = F.when(T.is_feed_venue(F.coalesce("venue_slug", F.lit("")), venue), F.coalesce(F.nullif(label, F.lit("")), venue)).otherwise(F.coalesce(F.nullif(venue, F.lit("")), label))
    reason = F.when(F.col("_title") == "", "untitled").when(F.col("startAt").isNull(), "undated").when(~F.coalesce("_scope.in_scope", F.lit(False)), "outOfDistrict").when(F.coalesce("endAt", "startAt") + C.DAY < now, "past")
    return timed.select(
        F.lit("nocartaz").alias("source"), F.col("_title").alias("title"), _named("nocartaz-", F.col("id")).alias("slug"), F.coalesce("d_text", "pitch").alias("description"), "startAt", "endAt", room.alias("venueName"), F.col("_scope.city").alias("city"),
        P.genre_categories(F.coalesce("genre", F.lit(""))).alias("categories"), F.coalesce("image", "d_image").alias("imageUrl"), _named("/eventos/", F.col("id"), "/").alias("url"), reason.alias("drop_reason"),
    )


def extract(pages: DataFrame, pack: Pack, now: int) -> DataFrame:
    """Staging rows (source, ordinal, the raw event's fields, drop_reason) of pages (page_id, url, html).

    Reasons, the first that fits: untitled, undated (neither a time nor a date text), outOfDistrict, past. A date text
    alone stands for a date. Pages without rows give none; ``ordinal`` numbers a page's rows.
    """
    # Rows are a column before they are exploded: a generator's input is not compiled, and what it repeats is computed anew.
    # The outer form keeps Spark from reading them a second time, in a filter that it would move before the pages are dealt.
    read = pages.select("page_id", "url", pack.read(F.col("html")).alias("_rows"))
    each = read.select("page_id", "url", F.posexplode_outer("_rows").alias("ordinal", "r")).where("ordinal is not null")
    if pack.bind:
        each = each.select("page_id", "url", "ordinal", F.struct("r.*", *[c.alias(n) for n, c in pack.bind(F.col("r"), F.col("url"), now).items()]).alias("r"))
    raw = {"description": F.lit(None).cast("string"), "endAt": F.lit(None).cast("bigint"), "dateText": F.lit(None).cast("string"), "imageUrl": F.lit(None).cast("string"), "categories": F.array().cast("array<string>")}
    raw |= pack.raw(F.col("r"), F.col("url"), now)
    scoped = raw.pop("_in_scope", None)
    rows = each.select("page_id", F.lit(pack.source).alias("source"), F.col("ordinal").cast("bigint").alias("ordinal"), *[c.alias(n) for n, c in raw.items()], (F.lit(None).cast("boolean") if scoped is None else scoped).alias("_scope"))
    inside = F.coalesce("_scope", P.in_scope(F.col("city"), F.col("venueName"))) if pack.gated else F.lit(True)
    over = F.coalesce("endAt", "startAt") + pack.tolerance < now
    reason = (
        F.when(F.coalesce("title", F.lit("")) == "", "untitled").when(F.col("startAt").isNull() & F.col("dateText").isNull(), "undated")
        .when(~F.coalesce(inside, F.lit(False)), "outOfDistrict").when(F.coalesce(over, F.lit(False)), "past")
    )
    return rows.withColumn("drop_reason", reason).drop("_scope")


def newspaper(months: DataFrame, details: DataFrame, places: DataFrame) -> DataFrame:
    """Raw events of a newspaper's three JSON interfaces: dated rows, posts and place terms (payload columns).

    Each (post, date) is an event of the post's title at its first place; no title starts twice at one time.
    """
    month = months.select(F.explode(F.from_json("payload", "array<struct<post_id:string,date:string>>")).alias("m")).select(F.trim("m.post_id").alias("post"), F.trim("m.date").alias("date")).where("post <> '' and date <> ''")
    v = details.select(F.explode(F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")).alias("v"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    tipo = F.coalesce(F.array_join(get("$.meta.tipo", "array<string>"), " "), get("$.meta.tipo"), F.lit(""))
    post = v.select(get("$.id").alias("post"), get("$.slug").alias("slug"), get("$.link").alias("link"), T.plain_text(get("$.title.rendered")).alias("title"), get("$.localidade[0]", "bigint").alias("place"), tipo.alias("tipo"))
    names = places.select(F.explode(X.terms(F.col("payload"))).alias("t")).select(F.col("t.id").alias("place"), F.col("t.name").alias("name"))
    rows = month.join(post, "post").join(F.broadcast(names), "place", "left")  # a roster: dealt by place, all rows would go to a few tasks
    start = D.strict_clock(F.col("date"))
    raw = rows.select(
        F.lit("regiaoleiria").alias("source"), "title", F.concat(F.lit("rl-"), "slug").alias("slug"), start.alias("startAt"), start.alias("endAt"), F.when(start.isNull(), F.col("date")).alias("dateText"),
        F.coalesce("name", F.lit(UNKNOWN)).alias("venueName"), F.col("name").alias("city"), F.array(P.kind_category(F.col("tipo"))).alias("categories"), F.col("link").alias("url"),
    )
    key = ["title", "startAt", "dateText"]
    rest = [c for c in raw.columns if c not in key]
    return raw.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("slug", "url")).alias("_r")).select(*key, "_r.*")


def region(listing: DataFrame, counties: DataFrame, now: int, gate: Callable[[Column], Column] = P.in_district) -> DataFrame:
    """Rows of a region's two JSON interfaces (payload columns): events and county terms, with drop reasons.

    Dates are days of epochs; the place is the first of the row's counties that the gate lets through.
    """
    names = counties.select(F.explode(X.terms(F.col("payload"))).alias("t")).select(F.col("t.id").alias("county"), F.col("t.name").alias("name"))
    v = listing.select(F.explode(F.try_variant_get(F.try_parse_json("payload"), "$", "array<variant>")).alias("v"))
    get = lambda path, kind="string": F.try_variant_get("v", path, kind)
    rows = v.select(
        get("$.id", "bigint").alias("id"), F.trim(get("$.slug")).alias("slug"), get("$.link").alias("url"), T.plain_text(get("$.title.rendered")).alias("title"),
        get("$.centro.start_date", "bigint").alias("start"), get("$.centro.end_date", "bigint").alias("end"), F.coalesce(get("$.county_mirror", "array<bigint>"), F.array().cast("array<bigint>")).alias("counties"),
    ).where("id is not null and slug <> '' and url <> '' and title <> ''")
    named = rows.select("id", F.posexplode("counties").alias("pos", "county")).join(F.broadcast(names.where(gate(F.col("name")))), "county")
    first = named.groupBy("id").agg(F.min_by("name", "pos").alias("city"), F.count_distinct("name").alias("n_places"))
    start, end = D.start_of_day(F.col("start")), D.last_minute(D.lisbon_day(F.coalesce("end", "start")))
    reason = F.when(F.col("start").isNull(), "undated").when(end < now - C.DAY, "past").when(F.col("city").isNull(), "outOfDistrict")
    return rows.join(first, "id", "left").select(
        F.lit("turismodocentro").alias("source"), "id", "slug", "url", "title", start.alias("startAt"), end.alias("endAt"), F.col("city").alias("venueName"), "city", F.coalesce("n_places", F.lit(0).cast("bigint")).alias("n_places"), reason.alias("drop_reason")
    )


def ticket_payloads(pages: DataFrame) -> DataFrame:
    """Raw events of pages with an embedded payload of buckets (page_id, html); cancelled and online rows go."""
    schema = "struct<buckets:array<struct<events:array<struct<eid:string,id:string,name:string,summary:string,start_date:string,start_time:string,end_date:string,end_time:string,is_cancelled:boolean,is_online_event:boolean,url:string,image:struct<url:string>,primary_venue:struct<name:string,address:struct<city:string>>>>>>>"
    buckets = F.from_json("payload", schema)["buckets"]
    e = lambda path: F.col(f"e.{path}")
    each = X.server_data(pages).select(F.explode(F.flatten(F.transform(buckets, lambda b: b["events"]))).alias("e"))
    at = lambda day, time: D.iso_epoch(F.concat_ws("T", F.substring(day, 1, 10), F.lpad(D.captured(time, r"^(\d{1,2}:\d{2})", 1), 5, "0")))
    eid = F.coalesce(e("eid"), e("id"))
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    kept = each.where(eid.isNotNull() & some(e("name")).isNotNull() & ~F.coalesce(e("is_cancelled"), F.lit(False)) & ~F.coalesce(e("is_online_event"), F.lit(False)))
    rows = kept.select(
        F.lit("eventbrite").alias("source"), F.trim(e("name")).alias("title"), F.concat(F.lit("eb-"), eid).alias("slug"), some(e("summary")).alias("description"), at(e("start_date"), e("start_time")).alias("startAt"),
        at(e("end_date"), e("end_time")).alias("endAt"), F.coalesce(some(e("primary_venue.name")), F.lit(UNKNOWN)).alias("venueName"), some(e("primary_venue.address.city")).alias("city"), e("image.url").alias("imageUrl"), e("url").alias("url"),
    )
    return rows.where("startAt is not null")


# Listings whose cards are read by selector, and the detail pages that override them.


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return D.captured(F.coalesce(text, F.lit("")), pattern, group)


def _absolute(site: str, href: Column) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(site), href))


def _last_part(url: Column) -> Column:
    return F.element_at(F.filter(F.split(url, "/"), lambda p: p != ""), -1)


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def first_by(rows: DataFrame, key: str, *order: str, last: bool = False) -> DataFrame:
    """The first row of each key in an order, or the last; values are kept by an aggregate, so a hot key combines before it moves."""
    best = (F.max_by if last else F.min_by)(F.struct("*"), F.struct(*order)).alias("_b")
    return rows.groupBy(F.col(key).alias("_key")).agg(best).select("_b.*")


def _date_picks(kind: str, *scope: tuple[str, ...]) -> S.Pick:
    """Parts of a date block: its wrapper, for a start also a plain block or the element itself."""
    steps = (*scope, (f".data-{kind}", ".date", "") if kind == "inicio" else (f".data-{kind}",))
    return S.Pick(within=steps, fields=(("dia", S.Pick(".dia")), ("mes", S.Pick(".mes")), ("ano", S.Pick(".ano", many=True)), ("hora", S.Pick(".hora"))))


def _block_epoch(d: Column) -> Column:
    """Epoch of a date block; its time stands in an element of its own, else beside the year. Null if a part is missing."""
    clock = r"(\d{1,2})h(\d{0,2})"
    year = F.coalesce(F.nullif(_first(F.try_element_at(d["ano"], F.lit(1)), r"^\s*(\d+)").cast("int"), F.lit(0)), _first(d["mes"], r"(\d{4})").cast("int"))
    month = D.month_number(_first(d["mes"], "([A-Za-z]{3})"))
    timed = F.try_element_at(F.filter(F.concat(F.array(d["hora"]), F.coalesce(d["ano"], F.array().cast("array<string>"))), lambda t: t.rlike(clock)), F.lit(1))
    minute = F.coalesce(_first(timed, clock, 2), F.lit("0"))
    return F.when(year >= 2000, D.wall_clock(year, month, _first(d["dia"], r"^\s*(\d+)"), _first(timed, clock), minute))


LEIRIAGENDA = "https://leiriagenda.cm-leiria.pt"


def leiriagenda(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Raw events of a council's listing pages (page_id, html) and of its detail pages (url, html), with an error.

    Of cards of one slug the last stays. Fields of the detail page win where they are not empty, its dates always; a
    card without a detail page, or whose detail names no start, is a failure: a row with an error and no dates.
    """
    cards = S.select(listings, 'a[href*="/pt/agenda/"]', {
        "href": S.Pick(attr="href"), "title": S.Pick(".proximo_title"), "venue": S.Pick(".local"), "city": S.Pick(".localidade"), "categories": S.Pick(".categorias small", many=True),
        "style": S.Pick(".imagem7x10", attr="style"), "start": _date_picks("inicio"),
    })
    href = F.trim("href")
    cards = cards.where(~F.contains("href", F.lit("proximos-eventos"))).select(
        "page_id", "pos", _last_part(href).alias("slug"), _absolute(LEIRIAGENDA, href).alias("url"), "title", "venue", "city", "categories", X.style_image(F.col("style")).alias("image"), _block_epoch(F.col("start")).alias("start")
    ).where("start is not null and slug <> ''")
    cards = first_by(cards.drop("start"), "slug", "page_id", "pos", last=True)
    scope = (".titles",)
    detail = S.select(details, "", {
        "d_title": S.Pick("h1.title", within=(scope,)), "d_venue": S.Pick(".local", within=(scope,)), "d_city": S.Pick(".localidade", within=(scope,)), "d_categories": S.Pick(".categorias small", many=True, within=(scope,)),
        "d_text": S.Pick("p", within=((".text.sinopse",),)), "from": _date_picks("inicio", scope), "to": _date_picks("fim", scope),
    }, key="url")
    detail = detail.select("url", "d_title", "d_venue", "d_city", "d_categories", "d_text", _block_epoch(F.col("from")).alias("at"), _block_epoch(F.col("to")).alias("until"), F.lit(True).alias("read"))
    error = F.when(F.col("read").isNull(), "no detail page").when(F.col("at").isNull(), "no start date")
    own = F.array_distinct(F.filter("d_categories", lambda c: c != ""))
    listed = F.array_distinct(F.filter("categories", lambda c: c != ""))
    return cards.join(detail, "url", "left").select(
        F.lit("leiriagenda").alias("source"), F.coalesce(_some(F.col("d_title")), F.col("title")).alias("title"), "slug", _some(F.col("d_text")).alias("description"), F.col("at").alias("startAt"), F.when(F.col("at").isNotNull(), F.col("until")).alias("endAt"),
        F.coalesce(_some(F.col("d_venue")), F.col("venue")).alias("venueName"), F.coalesce(_some(F.col("d_city")), _some(F.col("city"))).alias("city"),
        F.when(F.size(own) > 0, own).otherwise(listed).alias("categories"), F.col("image").alias("imageUrl"), "url", error.alias("error"),
    )


BOL = "https://www.bol.pt"
BOL_LINK = r"(?i)/Comprar/Bilhetes/(\d+)-([a-z0-9_]+(?:-[a-z0-9_]+)*)"


def _clock(text: Column) -> Column:
    """struct(h, m) of the first time in a text, as 21h30 or 21:30; null without one."""
    h, colon = r"(\d{1,2})h(\d{0,2})\b", r"(\d{1,2}):(\d{2})\b"
    time = F.when(text.rlike(h), F.struct(_first(text, h).alias("h"), F.coalesce(_first(text, h, 2), F.lit("0")).alias("m")))
    return time.otherwise(F.when(text.rlike(colon), F.struct(_first(text, colon).alias("h"), _first(text, colon, 2).alias("m"))))


def box_office(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Raw events of a box office's listing pages (page_id, html) and detail pages (url, html), one for each session, with an error.

    A link names its event and its venue; the first link of an id counts, and venues outside the area go. Sessions are
    the dates of a detail page with its times, the last time serving the dates beyond; a link without a
    detail page, or whose page names no date, is a row with an error.
    """
    links = S.select(listings, 'a[href*="/Comprar/Bilhetes/"]', {"href": S.Pick(attr="href")})
    tail = F.filter(F.split(F.regexp_extract("href", BOL_LINK, 2), "-"), lambda p: p != "")
    clean = F.regexp_replace(F.regexp_replace(F.trim("href"), "/+$", ""), r"[?#].*$", "")
    links = links.select("page_id", "pos", _absolute(BOL, clean).alias("url"), F.regexp_extract("href", BOL_LINK, 1).cast("bigint").alias("id"), tail.alias("tail")).where("id is not null and size(tail) >= 2")
    named = links.select("page_id", "pos", "id", "url", F.array_join(F.slice("tail", F.lit(1), F.size("tail") - 1), "-").alias("slug"), F.element_at("tail", -1).alias("place"))
    cards = first_by(named, "id", "page_id", "pos").where(T.is_near_venue(F.col("place")))
    box = (".datas-sessoes", ".datas")
    page = S.select(details, "", {
        "days": S.Pick(".sessao", many=True, within=(box,), fields=(("ano", S.Pick(".ano")), ("mes", S.Pick(".mes")), ("dia", S.Pick(".dia")))),
        "spans": S.Pick(".proxima-sessao span", many=True, within=(box,)), "whole": S.Pick(within=(box,)),
    }, key="url")
    ymd = lambda y, m, d: F.struct(y.cast("int").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))
    named_days = F.filter(F.transform("days", lambda s: ymd(_first(s["ano"], r"^\s*(\d+)"), D.month_number(_first(s["mes"], "([A-Za-z]{3})")), _first(s["dia"], r"^\s*(\d+)"))), lambda x: (x["y"] >= 2000) & x["m"].isNotNull() & x["d"].isNotNull())
    slashed = F.transform(X.all_groups(F.coalesce("whole", F.lit("")), r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), lambda t: T.let(F.split(t, "/"), lambda p: ymd(p[2], p[1], p[0])))
    times = F.filter(F.transform("spans", _clock), lambda t: t.isNotNull())
    dates = T.let(named_days, lambda n: F.when(F.size(n) > 0, n).otherwise(slashed))
    read = page.select("url", dates.alias("dates"), times.alias("times"), F.lit(True).alias("read"))
    session = F.transform(X.zip_sessions(F.col("dates"), F.col("times")), lambda s: F.struct(
        D.wall_clock(s["date"]["y"], s["date"]["m"], s["date"]["d"], s["time"]["h"], s["time"]["m"]).alias("at"), s["time"].isNotNull().alias("timed"), F.lit(None).cast("string").alias("error")))
    failed = F.array(F.struct(F.lit(None).cast("bigint").alias("at"), F.lit(False).alias("timed"), F.when(F.col("read").isNull(), "no detail page").otherwise("no session date").alias("error")))
    each = cards.join(read, "url", "left").select("slug", "place", "url", F.explode(F.when(F.coalesce(F.size("dates"), F.lit(0)) > 0, session).otherwise(failed)).alias("s"))
    display = lambda c: T.slug_to_title(F.trim(F.regexp_replace(c, "[_-]+", " ")))
    return each.select(
        F.lit("bol").alias("source"), display(F.col("slug")).alias("title"), "slug", F.col("s.at").alias("startAt"), F.col("s.timed").alias("hasTime"), display(F.col("place")).alias("venueName"), F.lit(None).cast("string").alias("city"), "url", F.col("s.error").alias("error")
    )


VIRAL = "https://www.viralagenda.com"


def viralagenda(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Raw events of a portal's listing pages (page_id, html) and detail pages (url, html) with JSON-LD, with an error.

    The first card of an id counts. The listing's time wins if it is a real one, else the detail's, else the
    listing's day. Rows of which neither the card's places nor the detail's lie in the district go; a card without a
    detail page is a failure, one whose detail holds no JSON-LD stands by itself.
    """
    picks = {
        "id": S.Pick(attr="data-id"), "href": S.Pick(attr="data-url"), "title": S.Pick(".viral-event-title .viral-linked span"), "hour": S.Pick(".viral-event-hour"), "cities": S.Pick("a.node-name span", many=True),
        "venue": S.Pick("a.viral-event-place span"), "categories": S.Pick('a[title="Ver eventos desta categoria"]', many=True), "card_start": S.Pick(attr="data-date-start"), "card_end": S.Pick(attr="data-date-end"),
        "image": S.Pick(".viral-event-image", attr="data-img"), "thumb": S.Pick(".viral-event-image img", attr="src"),
    }
    cards = S.select(listings, "li[data-id]", picks).withColumns({"id": F.trim("id"), "href": F.trim("href")}).where("id <> '' and href <> ''")
    cards = first_by(cards, "id", "page_id", "pos").withColumn("url", _absolute(VIRAL, F.col("href"))).drop("page_id", "pos")
    get = lambda path: F.try_variant_get("node", path, "string")
    text = lambda path: F.when(F.schema_of_variant(F.try_variant_get("node", path, "variant")) == "STRING", get(path))
    node = details.select("url", F.try_element_at(X.jsonld_nodes(F.col("html")), F.lit(1)).alias("node"))
    fields = {"name": "$.name", "from": "$.startDate", "to": "$.endDate", "photo": "$.image", "text": "$.description", "room": "$.location.name", "town": "$.location.address.addressLocality"}
    detail = node.select("url", F.lit(True).alias("read"), *[text(p).alias(n) for n, p in fields.items()])
    joined = cards.join(detail, "url", "left")
    inside = F.exists("cities", P.in_district) | P.in_district(F.col("town"))
    timed = ~D.is_placeholder_time(F.coalesce("hour", F.lit("")))
    times = D.card_times(F.col("card_start"), F.col("card_end"), timed, F.col("from"), F.col("to"))
    staged = joined.where(inside).withColumn("times", times)
    city = F.coalesce(F.col("town"), F.try_element_at(F.filter("cities", lambda c: c != ""), F.lit(1)))
    return staged.select(
        F.lit("viralagenda").alias("source"), F.coalesce(_some(F.col("name")), F.trim("title")).alias("title"), F.concat(F.lit("va-"), "id").alias("slug"), _some(F.col("text")).alias("description"), F.col("times.start").alias("startAt"), F.col("times.end").alias("endAt"),
        F.coalesce(_some(F.col("room")), _some(F.col("venue")), F.lit(UNKNOWN)).alias("venueName"), F.coalesce(F.trim(city), F.lit("Leiria")).alias("city"), F.array_distinct(F.filter("categories", lambda c: c != "")).alias("categories"),
        F.coalesce("photo", "image", "thumb").alias("imageUrl"), "url", F.when(F.col("read").isNull(), "no detail page").alias("error"),
    )


TICKETLINE = "https://www.ticketline.pt"


def ticketline(searches: DataFrame, details: DataFrame, now: int) -> DataFrame:
    """Raw events of a ticket shop's search pages (page_id, html, venue_scoped) and detail pages (url, html), with an error.

    The first row of an id counts; rows before today go before their detail is looked at. The detail's first session
    overrides the row; without one the row stands by itself. The place is the district's for a search by venue, else the session's, else
    the row's venue if it names the town; rows without a place in the district go.
    """
    rows = S.select(searches, 'li[itemscope][itemtype*="Event"]', {
        "href": S.Pick('a[itemprop="url"]', attr="href"), "title": S.Pick('p[itemprop="name"]'), "day": S.Pick(".date[data-date]", attr="data-date"), "venue": S.Pick('p[itemprop="location"]'), "categories": S.Pick(".metadata.categories", many=True),
    }).join(searches.select("page_id", "venue_scoped"), "page_id")
    rows = rows.withColumn("href", F.trim("href")).withColumn("id", D.captured(F.col("href"), r"-(\d+)$", 1)).where("id is not null")
    rows = first_by(rows, "id", "page_id", "pos").withColumn("url", _absolute(TICKETLINE, F.col("href"))).drop("page_id", "pos")
    rows = rows.where(F.coalesce(D.day_epoch(F.col("day")) >= D.start_of_day(F.lit(now)), F.lit(True)))
    session = ('li[itemprop="Event"]',)
    page = S.select(details, "", {
        "heading": S.Pick("article.event_detail h2.title"), "content": S.Pick(".date[itemprop='startDate']", attr="content", within=(session,)), "locality": S.Pick('span[itemprop="addressLocality"]', within=(session,)),
        "region": S.Pick('span[itemprop="addressRegion"]', within=(session,)), "show": S.Pick('div[itemprop="name"]', attr="content", within=(session,)), "room": S.Pick('p.venue[itemprop="name"]', within=(session,)),
    }, key="url")
    date = D.captured(F.col("content"), r"^(\d{4}-\d{2}-\d{2})", 1)
    whole = lambda c: F.when(date.isNotNull(), _some(c))
    detail = page.select(
        "url", F.lit(True).alias("read"), date.alias("d_day"), D.captured(F.col("content"), r"T(\d{2}:\d{2})$", 1).alias("d_time"), whole(F.coalesce(_some(F.col("show")), F.col("heading"))).alias("d_title"),
        whole(F.coalesce(_some(F.col("locality")), F.col("region"))).alias("d_city"), whole(F.col("room")).alias("d_room"),
    )
    joined = rows.join(detail, "url", "left")
    city = F.when(F.col("venue_scoped"), "Leiria").when(F.col("d_city").isNotNull(), F.col("d_city")).when(F.col("venue").rlike("(?i)leiria"), "Leiria")
    title = F.coalesce("d_title", _some(F.col("title")))
    kept = joined.withColumn("_title", title).where(F.col("_title").isNotNull() & P.in_district(city))
    day = F.coalesce("d_day", "day")
    start = F.when(F.col("d_time").isNotNull(), D.strict_clock(F.concat_ws(" ", day, "d_time"))).otherwise(D.day_epoch(day))
    return kept.select(
        F.lit("ticketline").alias("source"), F.col("_title").alias("title"), F.concat(F.lit("tl-"), "id").alias("slug"), start.alias("startAt"), F.coalesce("d_room", _some(F.element_at(F.split("venue", ","), 1)), F.lit(UNKNOWN)).alias("venueName"),
        F.lit("Leiria").alias("city"), F.filter("categories", lambda c: c != "").alias("categories"), "url", F.when(F.col("read").isNull(), "no detail page").alias("error"),
    )
