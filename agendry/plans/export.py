"""The site's export: a page for each event, sitemaps of bounded size with an index, published as one version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from agendry.functions import text as T
from agendry.functions.dates import lisbon_minute
from agendry.operators.order import positions
from agendry.plans.catalog import publish
from agendry.runtime import spread

#: Urls of a sitemap file, at most: the protocol's own limit.
URLS = 50_000
#: What a template must hold.
TITLE, DESCRIPTION, HEAD = "<title></title>", '<meta name="description" content="">', "</head>"


def event_node(title: Column, start: Column, end: Column, venue: Column, city: Column) -> Column:
    """JSON-LD of a dated event, fit to stand in a script element; fields without a value are left out."""
    iso = lambda c: F.concat(F.replace(lisbon_minute(c), F.lit(" "), F.lit("T")), F.lit(":00"))
    place = F.struct(F.lit("Place").alias("@type"), F.coalesce(venue, F.lit("Leiria")).alias("name"), F.struct(F.coalesce(city, F.lit("Leiria")).alias("addressLocality")).alias("address"))
    node = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Event").alias("@type"), title.alias("name"), iso(start).alias("startDate"), iso(end).alias("endDate"), place.alias("location"))
    return F.replace(F.to_json(node), F.lit("<"), F.lit("\\u003c"))


def pages(events: DataFrame, template: str, site: str, brand: str) -> DataFrame:
    """(path, html) of events (slug, title, description, start_at, end_at, date_text, venue, city).

    A template's empty title and description are filled and the canonical link, the cards' meta fields and, for dated events, the
    JSON-LD node stand before its head ends. Titles and descriptions are decoded, then escaped. A template
    without one of these places raises a ValueError.
    """
    for place in (TITLE, DESCRIPTION, HEAD):
        if template.count(place) != 1:
            raise ValueError(f"the template must hold {place} once")
    url = F.concat(F.lit(f"{site}/evento/"), "slug")
    image = F.concat(F.lit(f"{site}/og/"), "slug", F.lit(".png"))
    decoded = lambda c: T.decode_entities(F.coalesce(c, F.lit("")))
    named = events.withColumns({"_t": decoded(F.col("title")), "_d": decoded(F.col("description"))})
    title, text = T.escape_html(F.coalesce(F.nullif("_t", F.lit("")), F.lit("Evento"))), T.escape_html(F.coalesce(F.nullif("_d", F.lit("")), F.col("_t")))
    node = F.when(F.col("date_text").isNull() & (F.col("start_at") > 0), event_node(F.coalesce(F.nullif("_t", F.lit("")), F.lit("Evento")), F.col("start_at"), F.col("end_at"), F.col("venue"), F.col("city")))
    meta = lambda attr, name, value: F.concat(F.lit(f'<meta {attr}="{name}" content="'), value, F.lit('" />\n'))
    head = F.concat(
        F.coalesce(F.concat(F.lit('<script type="application/ld+json">'), node, F.lit("</script>\n")), F.lit("")), F.lit('<link rel="canonical" href="'), url, F.lit('" />\n'), meta("property", "og:type", F.lit("article")),
        meta("property", "og:title", F.col("_title")), meta("property", "og:description", F.col("_text")), meta("property", "og:image", image), meta("property", "og:url", url), meta("name", "twitter:card", F.lit("summary_large_image")),
        meta("name", "twitter:title", F.col("_title")), meta("name", "twitter:description", F.col("_text")), meta("name", "twitter:image", image),
    )
    fill = {TITLE: F.concat(F.lit("<title>"), "_title", F.lit(f" — {brand}</title>")), DESCRIPTION: F.concat(F.lit('<meta name="description" content="'), "_text", F.lit('">')), HEAD: F.concat(head, F.lit(HEAD))}
    order = sorted(fill, key=template.index)
    parts, rest = [], template
    for place in order:
        before, rest = rest.split(place, 1)
        parts += [F.lit(before), fill[place]]
    return named.withColumns({"_title": title, "_text": text}).select(F.concat(F.lit("evento/"), "slug", F.lit("/index.html")).alias("path"), F.concat(*parts, F.lit(rest)).alias("html"))


def sitemaps(urls: DataFrame, site: str, limit: int = URLS) -> DataFrame:
    """(path, body): files of at most ``limit`` urls (loc, lastmod) in the order of loc, and the index that lists them.

    The home page is the first file's first url, as new as the newest. A file's entries are bounded by ``limit``; the index has a line for each file.
    """
    every = urls.unionByName(urls.agg(F.lit(f"{site}/").alias("loc"), F.max("lastmod").alias("lastmod")))
    dealt = positions(every.withColumns({"one": F.lit(0), "rank": (F.col("loc") != f"{site}/").cast("int")}), "one", "rank", "loc").withColumn("file", F.ceil(F.col("position") / limit).cast("int"))
    line = F.concat(F.lit("<url><loc>"), T.escape_html(F.col("loc")), F.lit("</loc><lastmod>"), "lastmod", F.lit("</lastmod></url>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<{0} xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
    whole = lambda kind, lines: F.concat(F.lit(head.format(kind)), F.array_join(F.transform(F.array_sort(lines), lambda s: s["line"]), "\n"), F.lit(f"\n</{kind}>\n"))
    files = dealt.groupBy("file").agg(whole("urlset", F.collect_list(F.struct("position", line.alias("line")))).alias("body"), F.max("lastmod").alias("lastmod"))
    name = F.concat(F.lit("sitemap-"), F.lpad(F.col("file").cast("string"), 5, "0"), F.lit(".xml"))
    entry = F.concat(F.lit(f"<sitemap><loc>{site}/"), name, F.lit("</loc><lastmod>"), "lastmod", F.lit("</lastmod></sitemap>"))
    index = files.agg(whole("sitemapindex", F.collect_list(F.struct("file", entry.alias("line")))).alias("body")).select(F.lit("sitemap.xml").alias("path"), "body")
    return files.select(name.alias("path"), "body").union(index)


def export(events: DataFrame, template: str, site: str, brand: str, folder: str, limit: int = URLS) -> DataFrame:
    """(tbl, n) after publishing the pages, sitemaps and robots file of events (slug, ..., updated_at) as one version of ``folder``.

    No events, an event without a slug, and a page count that isn't the count of events raise a ValueError, and the
    version before stays the current one.
    """
    rows = events.count()
    if not rows:
        raise ValueError("no events: refusing to publish a site without pages")
    if not events.where("coalesce(trim(slug), '') = ''").isEmpty():
        raise ValueError("an event has no slug")
    spark = events.sparkSession
    day = F.date_format(F.timestamp_seconds("updated_at"), "yyyy-MM-dd")
    urls = events.select(F.concat(F.lit(f"{site}/evento/"), "slug").alias("loc"), day.alias("lastmod"))
    robots = spark.createDataFrame([("robots.txt", f"User-agent: *\nAllow: /\nSitemap: {site}/sitemap.xml\n")], "path string, body string")
    # Two events of one slug would be one page. Events are narrow and pages are not, so the former are dealt and sorted.
    made = pages(spread(events, "slug").dropDuplicates(["slug"]), template, site, brand)
    return publish({"pages": made, "sitemaps": sitemaps(urls, site, limit), "robots": robots}, folder, {"pages": rows})
