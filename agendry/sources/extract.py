"""Extraction jobs over a table of fetched payloads: rules per field, no fetching.

Patterns run on columns wherever they can. Only two jobs need Python: cutting a balanced object out
of a script, and cards by selector over a parsed page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agendry.functions import dates as D, text as T
from agendry.runtime import share_code

RAW_EVENT = (
    "source STRING, ordinal BIGINT, title STRING, slug STRING, description STRING, startAt BIGINT, endAt BIGINT, dateText STRING, venueName STRING, city STRING, "
    "categories ARRAY<STRING>, imageUrl STRING, url STRING"
)


def all_groups(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def sitemap_rows(body: Column) -> Column:
    """Array of (url, lastmod) of a sitemap, bare or in CDATA; an absent lastmod is empty."""
    blocks = all_groups(body, r"(?s)<url>(.*?)</url>")
    clean = lambda b, tag: F.trim(F.regexp_replace(F.regexp_extract(b, rf"(?s)<{tag}>(.*?)</{tag}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    return F.transform(blocks, lambda b: F.struct(clean(b, "loc").alias("url"), clean(b, "lastmod").alias("lastmod")))


def sitemap_index(body: Column, pattern: str) -> Column:
    """Distinct addresses of a sitemap index that match a pattern, in their order."""
    found = F.transform(all_groups(body, r"<loc>\s*([^<]*?)\s*</loc>"), lambda u: F.trim(u))
    return F.array_distinct(F.filter(found, lambda u: u.rlike(pattern)))


def repair_pairs(c: Column) -> Column:
    """Character references to the two halves of a surrogate pair become the character they mean together."""
    pair = r"&#(5[56]\d{3});\s*&#(5[67]\d{3});"
    found = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(pair), F.lit(0)))
    half = lambda whole, i: F.regexp_extract(whole, pair, i).cast("int")
    code = lambda whole: (half(whole, 1) - 0xD800) * 0x400 + half(whole, 2) - 0xDC00 + 0x10000
    whole = lambda w: (half(w, 1) < 0xDC00) & (half(w, 1) >= 0xD800) & half(w, 2).between(0xDC00, 0xDFFF)
    one = lambda text, w: F.when(whole(w), F.replace(text, w, F.decode(F.unhex(F.lpad(F.hex(code(w)), 8, "0")), "UTF-32"))).otherwise(text)
    return T.let(c, lambda t: F.when(F.contains(t, F.lit("&#5")), F.aggregate(found(t), t, one)).otherwise(t))


def rfc_epoch(c: Column) -> Column:
    """Epoch of a feed's date such as "Wed, 02 Sep 2026 10:00:00 +0100"; null for other texts."""
    pattern = r"(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}):(\d{2})(?::(\d{2}))?\s*(GMT|UT|Z|[+-]\d{4})?"
    months = F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()])

    def clock(c: Column) -> Column:
        d, name, y, h, mi, s = (F.regexp_extract(c, pattern, i) for i in range(1, 7))
        month = F.array_position(months, F.lower(name))
        return F.concat(y, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(d, 2, "0"), F.lit(" "), h, F.lit(":"), mi, F.lit(":"), F.lpad(s, 2, "0"))

    def offset(zone: Column) -> Column:
        sign = F.when(zone.startswith("-"), -1).otherwise(1)
        return F.when(zone.rlike("^[+-]"), sign * (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 4, 2).cast("int") * 60)).otherwise(0)

    seconds = lambda c: F.timestamp_diff("SECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), clock(c).try_cast("timestamp_ntz"))
    return T.let(c, lambda c: seconds(c) - T.let(F.regexp_extract(c, pattern, 7), offset))


def rss_items(body: Column) -> Column:
    """Array of (title, link, categories, description, published) of a feed; items without title or link go.

    Texts are decoded twice, and halves of surrogate pairs are joined; ``published`` is an epoch.
    """
    tag = lambda b, t: F.trim(F.regexp_replace(F.regexp_extract(b, rf"(?s)<{t}>(.*?)</{t}>", 1), r"<!\[CDATA\[|\]\]>", ""))
    decoded = lambda c: T.decode_entities(repair_pairs(T.decode_entities(repair_pairs(c))))
    item = lambda b: F.struct(decoded(tag(b, "title")).alias("title"), tag(b, "link").alias("link"), all_groups(b, r"(?s)<category>(.*?)</category>").alias("categories"), T.plain_text(decoded(tag(b, "description"))).alias("description"), rfc_epoch(tag(b, "pubDate")).alias("published"))
    return F.filter(F.transform(all_groups(body, r"(?s)<item>(.*?)</item>"), item), lambda i: (i["title"] != "") & (i["link"] != ""))


def terms(payload: Column) -> Column:
    """Array of (id, name) of a taxonomy's JSON list; rows without id or name go, and junk gives none."""
    rows = F.coalesce(F.from_json(payload, "array<struct<id:bigint,name:string>>"), F.array().cast("array<struct<id:bigint,name:string>>"))
    named = F.transform(rows, lambda r: F.struct(r["id"].alias("id"), F.trim(T.decode_entities(r["name"])).alias("name")))
    return F.filter(named, lambda r: (F.coalesce(r["id"], F.lit(0)) != 0) & (F.coalesce(r["name"], F.lit("")) != ""))


def jsonld_nodes(html: Column) -> Column:
    """Array of the nodes of all JSON-LD blocks, those of lists and of a @graph each; malformed blocks go."""
    blocks = all_groups(html, r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>")
    parsed = F.filter(F.transform(blocks, lambda b: F.try_parse_json(b)), lambda v: v.isNotNull())
    many = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    return F.flatten(F.transform(parsed, lambda v: F.coalesce(many(v, "$['@graph']"), many(v, "$"), F.array(v))))


def first_event(nodes: Column) -> Column:
    """The first node of an event type, else the first with a start date."""
    kind_of = lambda v: F.coalesce(F.try_variant_get(v, "$['@type'][0]", "string"), F.try_variant_get(v, "$['@type']", "string"), F.lit(""))
    kind = lambda every: F.filter(every, lambda v: kind_of(v).rlike("Event$"))
    dated = lambda every: F.filter(every, lambda v: F.try_variant_get(v, "$.startDate", "string").isNotNull())
    return T.let(nodes, lambda every: F.coalesce(F.try_element_at(kind(every), F.lit(1)), F.try_element_at(dated(every), F.lit(1))))


def jsonld_fields(node: Column) -> list[Column]:
    """name, start_date, end_date, place, locality, image (a text, the first of a list, or the url of an object)."""
    get = lambda path: F.try_variant_get(node, path, "string")
    image = F.coalesce(get("$.image[0]"), get("$.image.url"), F.when(F.schema_of_variant(F.try_variant_get(node, "$.image", "variant")) == "STRING", get("$.image")))
    return [get("$.name").alias("name"), get("$.startDate").alias("start_date"), get("$.endDate").alias("end_date"), get("$.location.name").alias("place"), get("$.location.address.addressLocality").alias("locality"), image.alias("image")]


def links(html: Column) -> Column:
    return F.array_distinct(all_groups(html, r'(?i)<a\s[^>]*href="([^"]*)"'))


def link_chunks(html: Column, limit: int = 3000) -> Column:
    """Array of (href, chunk, earliest, latest): each link, the plain text up to the next one, cut after ``limit`` characters, and the dates in it."""
    split = F.split(html, r'(?i)<a\s[^>]*href="', -1)
    parts = F.slice(split, F.lit(2), F.size(split))
    text = lambda p: T.strip_tags(F.regexp_replace(F.substring(p, 1, limit), '^[^>]*>', ""))
    dated = lambda p, d: F.struct(F.substring_index(p, '"', 1).alias("href"), text(p).alias("chunk"), d["earliest"].alias("earliest"), d["latest"].alias("latest"))
    return F.transform(parts, lambda p: T.let(D.chip_dates(F.substring(p, 1, limit)), lambda d: dated(p, d)))


def field(block: Column, pattern: str) -> Column:
    """The plain text of a pattern's first group in a block of markup; null if it is not there or empty."""
    return F.nullif(T.plain_text(F.regexp_extract(block, pattern, 1)), F.lit(""))


def fielded(block: Column, fields: dict[str, str], *more: Column) -> Column:
    """A struct of the plain texts of patterns in a block (see field()), and of what else is given."""
    texts = F.transform(F.array(*[F.regexp_extract(block, p, 1) for p in fields.values()]), lambda v: T.filled(T.plain_text(v)))
    return T.let(texts, lambda found: F.struct(*[F.element_at(found, i).alias(n) for i, n in enumerate(fields, 1)], *more))


def cards(html: Column, marker: str, fields: dict[str, str], need: tuple[str, ...], key: str | None = None) -> Column:
    """Array of the cards of a listing: the page is split at a marker and fields are read from each part by pattern.

    Cards that lack a needed field go; of cards with the same ``key`` the first stays.
    """
    parts = F.split(html, marker, -1)
    rows = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda b: fielded(b, fields))
    whole = F.filter(rows, lambda r: F.coalesce(*[F.when(r[n].isNull(), F.lit(False)) for n in need], F.lit(True)))
    if key is None:
        return whole
    seen = lambda every: F.filter(every, lambda r, i: F.array_position(F.transform(every, lambda x: x[key]), r[key]) == i + 1)
    return F.element_at(F.transform(F.array(whole), seen), 1)


def meta(html: Column, name: str) -> Column:
    """The content of a meta element by name, else by property."""
    get = lambda attr: F.regexp_extract(html, rf'<meta[^>]+{attr}="{name}"[^>]+content="([^"]*)"', 1)
    texts = F.transform(F.array(get("name"), get("property")), lambda v: F.trim(T.decode_entities(v)))
    return F.try_element_at(F.filter(texts, lambda v: v != ""), F.lit(1))


def calendar_var(html: Column, name: str) -> Column:
    """A variable of an add-to-calendar block."""
    return F.nullif(F.trim(T.decode_entities(F.regexp_extract(html, rf'class="atc_{name}"[^>]*>([^<]*)<', 1))), F.lit(""))


def widget_part(html: Column, name: str) -> Column:
    """The markup of a widget, up to the next one; empty if there is none."""
    return F.regexp_extract(html, rf'(?s)class="{name} widget_field\s*"[^>]*>(.*?)(?=<div class="(?:[a-z_]+ widget_field|addtocalendar|google_map)|$)', 1)


def widget_text(html: Column, name: str) -> Column:
    """The text that a writer put into a widget."""
    return F.nullif(T.strip_tags(T.decode_entities(F.regexp_extract(widget_part(html, name), r'(?s)class="writer_text"[^>]*>(.*?)(?:<div class="writer_text_clear"|$)', 1))), F.lit(""))


def widget_spans(html: Column, name: str) -> Column:
    """The values of a widget's spans."""
    values = F.transform(all_groups(widget_part(html, name), r"<span[^>]*>([^<]+)</span>"), lambda v: F.trim(F.regexp_replace(T.decode_entities(v), r"\s+", " ")))
    return F.filter(values, lambda v: v != "")


def after_label(cells: Column, label: str) -> Column:
    """The cell that follows the one with a label; null without it."""
    at = F.array_position(F.transform(cells, lambda c: T.fold(c)), T.fold(F.lit(label)))
    return F.when(at > 0, F.try_element_at(cells, (at + 1).cast("int")))


def zip_sessions(dates: Column, times: Column) -> Column:
    """Array of (date, time): the last time serves dates beyond the times; no dates give none."""
    return F.transform(dates, lambda d, i: F.struct(d.alias("date"), F.when(F.size(times) > 0, F.element_at(times, F.least(i + 1, F.size(times)))).alias("time")))


def sessions_or_error(dates: Column, times: Column, error: str = "no date") -> Column:
    """Array of (date, time, error): a page's sessions, or one row with the error if it names no date."""
    session = F.transform(zip_sessions(dates, times), lambda s: F.struct(s["date"].alias("date"), s["time"].alias("time"), F.lit(None).cast("string").alias("error")))
    none = F.array(F.struct(F.lit(None).cast("string").alias("date"), F.lit(None).cast("string").alias("time"), F.lit(error).alias("error")))
    return F.when(F.coalesce(F.size(dates), F.lit(0)) > 0, session).otherwise(none)


def max_page(html: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(all_groups(html, r"[?&]page=(\d{1,6})"), lambda n: n.cast("int"))), F.lit(1))


def style_image(style: Column) -> Column:
    return F.nullif(F.regexp_extract(style, r"""url\(\s*['"]?([^'")]+)""", 1), F.lit(""))


def merge_detail(cards: DataFrame, details: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Cards with a detail's fields where they are not empty; a card without detail stays as it is."""
    d = details.select(key, *[F.col(f).alias(f"_d_{f}") for f in fields])
    return cards.join(d, key, "left").select(key, *[F.coalesce(F.nullif(F.trim(F.col(f"_d_{f}")), F.lit("")), F.col(f)).alias(f) for f in fields])


def balanced(text: str | None, marker: str) -> str | None:
    """The object that follows a marker, to its closing brace; strings and escapes are passed over."""
    start = text.find(marker) if text else -1
    start = text.find("{", start) if start >= 0 else -1
    if start < 0:
        return None
    depth, quoted = 0, False
    for m in re.finditer(r'\\.|["{}]', text[start:], re.S):
        ch = m[0]
        if ch == '"':
            quoted = not quoted
        elif not quoted and ch in "{}":
            depth += 1 if ch == "{" else -1
            if depth == 0:
                return text[start : start + m.end()]
    return None


def server_data(pages: DataFrame, marker: str = "window.__SERVER_DATA__", key: str = "page_id") -> DataFrame:
    """(page_id, payload): the embedded object of each page that has one whole."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "payload": [balanced(h, marker) for h in b["html"]]}).dropna()

    return share_code(pages).select(key, "html").mapInPandas(cut, f"{key} long, payload string")


class _Cards(HTMLParser):
    """Text and first link of each element of a tag and class; nested cards belong to the outer one."""

    def __init__(self, tag: str, cls: str | None):
        super().__init__()
        self.tag, self.cls, self.depth, self.cards = tag, cls, 0, []

    def handle_starttag(self, tag, attrs):
        at = dict(attrs)
        if self.depth:
            self.depth += tag == self.tag
            if tag == "a" and self.cards[-1][1] is None:
                self.cards[-1][1] = at.get("href")
        elif tag == self.tag and (self.cls is None or self.cls in (at.get("class") or "").split()):
            self.depth = 1
            self.cards.append(["", None])

    def handle_endtag(self, tag):
        if self.depth and tag == self.tag:
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.cards[-1][0] += data


def dom_cards(pages: DataFrame, tag: str, cls: str | None = None, key: str = "page_id") -> DataFrame:
    """(page_id, pos, text, href) of the cards of each page."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for page, html in zip(b[key], b["html"]):
                p = _Cards(tag, cls)
                p.feed(html or "")
                p.close()
                rows += [(page, i, re.sub(r"\s+", " ", t).strip(), h) for i, (t, h) in enumerate(p.cards)]
            yield pd.DataFrame(rows, columns=[key, "pos", "text", "href"])

    return share_code(pages).select(key, "html").mapInPandas(parse, f"{key} long, pos int, text string, href string")


def staging_files(spark: SparkSession, path: str) -> DataFrame:
    """Raw events of files of JSON lines, read with the fixed schema; columns that are not asked for are not parsed. Malformed lines give no row."""
    rows = spark.read.schema(f"{RAW_EVENT}, _corrupt STRING").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def _xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The elements of a tag in XML files, each a row, split over tasks; broken ones go."""
    rows = spark.read.format("xml").options(rowTag=tag, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt", ignoreNamespace="true").schema(f"{schema}, _corrupt STRING").load(path)
    return rows.where("_corrupt is null").drop("_corrupt")


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """(url, lastmod) of sitemap files; what sitemap_rows() gives of their bodies."""
    return _xml(spark, path, "url", "loc STRING, lastmod STRING").select(F.trim(F.coalesce("loc", F.lit(""))).alias("url"), F.trim(F.coalesce("lastmod", F.lit(""))).alias("lastmod"))


def feed_files(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, categories, description, published) of feed files; what rss_items() gives of their bodies.

    Texts are decoded as there; the reader has decoded those outside CDATA once already, which changes no plain text.
    """
    rows = _xml(spark, path, "item", "title STRING, link STRING, category ARRAY<STRING>, description STRING, pubDate STRING")
    text = lambda c: T.decode_entities(repair_pairs(T.decode_entities(repair_pairs(F.trim(F.coalesce(c, F.lit("")))))))
    found = rows.select(text("title").alias("title"), F.trim(F.coalesce("link", F.lit(""))).alias("link"), F.coalesce("category", F.array().cast("array<string>")).alias("categories"), T.plain_text(text("description")).alias("description"), rfc_epoch(F.trim("pubDate")).alias("published"))
    return found.where("title <> '' and link <> ''")
