from __future__ import annotations

from pyspark.sql import functions as F

from agendry import constants as C, oracle as O, tables
from agendry.bound.texts import pick
from agendry.functions import text as T
from agendry.functions.dates import lisbon_minute
from agendry.registry import query
from agendry.sources import extract as X
from agendry.streaming.jobs import home_of


def pages(spark, sf_dir):
    return tables.read(spark, sf_dir, "pages")


@query("SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title, len(list_distinct(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1, 'i'))) AS n_links FROM pages")
def html_title_links(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.size(X.links(F.col("html"))).cast("bigint").alias("n_links"))


ENT = "replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&middot;', '&middot;'), '&amp;', '&')"
PARAGRAPH = "regexp_extract(html, '<p>(.*?)</p>', 1, 's')"


@query(rf"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace({ENT.format(x=f"regexp_replace({PARAGRAPH}, '<[^>]*>', ' ', 'g')")}, '[\s\x{{a0}}]+', ' ', 'g'), '\s+([,.;:!?%)\]])', '\1', 'g'), '([(\[])\s+', '\1', 'g')) AS text FROM pages""")
def html_plain_text(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.plain_text(F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1)).alias("text"))


@query(rf"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<(script|style)\b.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip_tags(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query(f"SELECT page_id, {ENT.format(x=PARAGRAPH)} || ' é &nope; &#0; 💃' AS text FROM pages")
def html_entities(spark, sf_dir):
    text = F.concat(F.regexp_extract("html", "(?s)<p>(.*?)</p>", 1), F.lit(" &#233;<!-- x --> &nope; &#0; &#x1F483;"))
    return pages(spark, sf_dir).select("page_id", T.decode_entities(text).alias("text"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", T.escape_html(F.col("url")).alias("escaped"))


@query("SELECT page_id, href, string_split(regexp_replace(href, '^/', ''), '-')[-1] AS tail FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1, 'i')) AS href FROM pages)")
def page_links(spark, sf_dir):
    each = pages(spark, sf_dir).select("page_id", F.explode(X.links(F.col("html"))).alias("href"))
    return each.select("page_id", "href", F.element_at(F.split(F.regexp_replace("href", "^/", ""), "-"), -1).alias("tail"))


@query("SELECT page_id, coalesce(list_max(list_transform(regexp_extract_all(url, '[?&]page=(\\d{1,6})', 1), lambda n: CAST(n AS INTEGER))), 1) AS page FROM pages")
def page_numbers(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", X.max_page(F.col("url")).alias("page"))


@query()
def link_chunks(spark, sf_dir):
    each = pages(spark, sf_dir).select("page_id", F.posexplode(X.link_chunks(F.col("html"))).alias("pos", "c"))
    return each.select("page_id", "pos", "c.href", "c.chunk")


@query()
def html_dom_cards(spark, sf_dir):
    return X.dom_cards(pages(spark, sf_dir), "article")


EV = f"ev AS (SELECT e.id, e.title, e.start_at, e.end_at, v.name AS venue, v.city, {O.lisbon_minute('start_at')} AS t FROM cat_events e LEFT JOIN cat_venues v ON v.id = e.venue_id)"


def ev(spark, sf_dir):
    v = tables.venues(spark, sf_dir).select(F.col("id").alias("venue_id"), F.col("name").alias("venue"), "city")
    return tables.events(spark, sf_dir).join(v, "venue_id", "left").withColumn("t", lisbon_minute(F.col("start_at")))


@query(O.sql("SELECT id, title AS name, replace(t, ' ', 'T') AS start_date, coalesce(venue, 'Leiria') AS place, city AS locality, CASE id % 3 WHEN 0 THEN 'a' || id WHEN 1 THEN 'b' || id ELSE 'c' || id END AS image FROM ev WHERE id % 10 <> 9", EV))
def jsonld_fields(spark, sf_dir):
    """Pages with several script blocks, one of them broken; images as a text, a list or an object; some without an event."""
    k = F.col("id")
    image = F.when(k % 3 == 0, F.concat(F.lit('"a'), k, F.lit('"'))).when(k % 3 == 1, F.concat(F.lit('["b'), k, F.lit('", "z"]'))).otherwise(F.concat(F.lit('{"url": "c'), k, F.lit('"}')))
    place = F.concat(F.lit('{"name": "'), F.coalesce("venue", F.lit("Leiria")), F.lit('", "address": {'), F.coalesce(F.concat(F.lit('"addressLocality": "'), "city", F.lit('"')), F.lit("")), F.lit("}}"))
    block = lambda body: F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"))
    node = F.concat(F.lit('{"@type": "'), F.when(k % 10 == 9, "Organization").otherwise("MusicEvent"), F.lit('", "name": "'), "title", F.when(k % 10 == 9, F.lit("")).otherwise(F.concat(F.lit('", "startDate": "'), F.replace("t", F.lit(" "), F.lit("T")))), F.lit('", "location": '), place, F.lit(', "image": '), image, F.lit("}"))
    html = F.concat(F.lit("<html>"), block(F.lit("{broken")), block(F.lit('{"@type": "WebSite"}')), block(node), F.lit("</html>"))
    found = ev(spark, sf_dir).select("id", X.first_event(X.jsonld_nodes(html)).alias("node")).where("node is not null")
    return found.select("id", *[c for c in X.jsonld_fields(F.col("node"))]).drop("end_date")


#: Ids that share an item list; events of a day meet in lists by ranges of ids, so no list grows with a day.
LISTED = 1000


def item_lists(rows):
    """(d, part, payload): JSON lists of the events of a day, LISTED ids at most in one."""
    keys = F.floor(F.col("start_at") / C.DAY).alias("d"), F.floor(F.col("id") / LISTED).alias("part")
    return rows.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "title", "url")))).alias("payload"))


@query(O.sql("SELECT lower(hex(venue_id)) AS item, arg_min(title, id) AS name FROM cat_events GROUP BY 1"))
def itemlist(spark, sf_dir):
    """Item lists of the events of each day: ids from urls, the first name of an id wins."""
    rows = tables.events(spark, sf_dir).withColumn("url", F.concat(F.lit("https://example.org/eventos/"), F.lower(F.hex("venue_id")), F.lit("/")))
    lists = item_lists(rows)
    each = lists.select(F.explode(F.from_json("payload", "array<struct<id:bigint,title:string,url:string>>")).alias("e"))
    item = F.regexp_extract("e.url", r"/eventos/([0-9a-f]+)/", 1)
    return each.where(item != "").groupBy(item.alias("item")).agg(F.min_by("e.title", "e.id").alias("name"))


@query(O.sql("SELECT id, title AS name FROM cat_events WHERE id % 12 <> 0"))
def server_data(spark, sf_dir):
    """Embedded script objects, cut at their balancing brace; titles hold braces and quotes on their way through."""
    k = F.col("id")
    payload = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.concat("title", F.lit(' }{"')).alias("name"), k.alias("eid"))).alias("events"))).alias("buckets")))
    html = F.concat(F.lit("<script>var a = {}; "), F.when(k % 12 == 0, "").otherwise("window.__SERVER_DATA__ = "), payload, F.lit("; var b = {};</script>"))
    cut = X.server_data(tables.events(spark, sf_dir).select(k.alias("page_id"), html.alias("html")))
    buckets = F.from_json("payload", "struct<buckets:array<struct<events:array<struct<name:string,eid:bigint>>>>>")
    each = cut.select(F.explode(F.flatten(F.transform(buckets["buckets"], lambda b: b["events"]))).alias("e"))
    return each.select(F.col("e.eid").alias("id"), F.regexp_replace("e.name", r' \}\{"$', "").alias("name"))


@query(O.sql("SELECT id, title || ' & ' || coalesce(venue, '?') AS title, 'l' || id AS link, title || '|x' AS categories, CASE WHEN city IS NULL THEN 'Olá,?!' ELSE 'Olá, ' || city || '!' END AS description FROM ev WHERE id % 8 <> 0", EV))
def rss_items(spark, sf_dir):
    k = F.col("id")
    item = F.concat(F.lit("<item><title>"), "title", F.lit(" &amp;amp; "), F.coalesce("venue", F.lit("?")), F.lit("</title><link>"), F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("l"), k.cast("string"))), F.lit("</link><category>"), "title", F.lit("</category><category>x</category><description><![CDATA[<p>Ol&aacute; , "), F.coalesce("city", F.lit("?")), F.lit(" !</p>]]></description></item>"))
    each = ev(spark, sf_dir).select("id", F.explode(X.rss_items(F.concat(F.lit("<rss>"), item, F.lit("</rss>")))).alias("i"))
    return each.select("id", "i.title", "i.link", F.array_join("i.categories", "|").alias("categories"), "i.description")


@query("SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN '' ELSE '2024-01-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') END AS lastmod FROM pages")
def sitemap_rows(spark, sf_dir):
    k = F.col("page_id")
    day = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    body = F.concat(F.lit("<urlset><url><loc>"), F.when(k % 2 == 0, F.concat(F.lit("<![CDATA["), "url", F.lit("]]>"))).otherwise(F.col("url")), F.lit("</loc>"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>"))), F.lit("</url></urlset>"))
    return pages(spark, sf_dir).select(k, F.explode(X.sitemap_rows(body)).alias("r")).select("page_id", "r.url", "r.lastmod")


@query(O.sql("SELECT id, title, venue_id, CASE WHEN id % 2 = 0 THEN title || ' ' || source ELSE title END AS tipo FROM cat_events WHERE id % 14 <> 0"))
def api_rows(spark, sf_dir):
    """Rows of a JSON interface; junk payloads give none, and a field is a text or a list of texts."""
    k = F.col("id")
    tipo = F.when(k % 2 == 0, F.to_json(F.array("title", "source"))).otherwise(F.concat(F.lit('"'), "title", F.lit('"')))
    payload = F.when(k % 14 == 0, "<html>busy</html>").otherwise(F.concat(F.lit('{"id": '), k, F.lit(', "title": {"rendered": "'), "title", F.lit('"}, "meta": {"tipo": '), tipo, F.lit('}, "venue": '), "venue_id", F.lit("}")))
    v = tables.events(spark, sf_dir).select(F.try_parse_json(payload).alias("v")).where("v is not null")
    get = lambda path, kind: F.try_variant_get("v", path, kind)
    kinds = F.coalesce(F.array_join(get("$.meta.tipo", "array<string>"), " "), get("$.meta.tipo", "string"))
    return v.select(get("$.id", "bigint").alias("id"), get("$.title.rendered", "string").alias("title"), get("$.venue", "bigint").alias("venue_id"), kinds.alias("tipo"))


@query(O.sql("SELECT id, 'Rua ' || venue_id AS morada, CASE WHEN id % 3 = 0 THEN NULL ELSE title END AS tipo FROM cat_events"))
def detail_labels(spark, sf_dir):
    """Labelled details: the value is the cell after the label, whatever the label's accents and case."""
    k = F.col("id")
    html = F.concat(F.lit("<dl><dt>MORADA</dt><dd>Rua "), F.col("venue_id").cast("string"), F.lit("</dd>"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("<dt>Tipo de Sessão</dt><dd>"), "title", F.lit("</dd>"))), F.lit("</dl>"))
    cells = X.all_groups(html, r"<d[td]>(.*?)</d[td]>")
    return tables.events(spark, sf_dir).select("id", X.after_label(cells, "Morada").alias("morada"), X.after_label(cells, "tipo de sessao").alias("tipo"))


@query(O.sql("SELECT id, d.i AS n, 'd' || d.i AS date, CASE WHEN id % 4 > 0 THEN 't' || least(d.i, id % 4) END AS time FROM cat_events, unnest(range(1, 1 + id % 5)) AS d(i)"))
def session_zip(spark, sf_dir):
    k = F.col("id")
    numbered = lambda letter, n: F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("bigint"), n), lambda i: F.concat(F.lit(letter), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    each = tables.events(spark, sf_dir).select("id", F.posexplode(X.zip_sessions(numbered("d", k % 5), numbered("t", k % 4))).alias("p", "s"))
    return each.select("id", (F.col("p") + 1).cast("bigint").alias("n"), "s.date", "s.time")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'detail ' || o_orderkey ELSE o_orderstatus END AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'prio ' || o_orderpriority ELSE o_orderpriority END AS venue FROM orders")
def card_detail_merge(spark, sf_dir):
    """A detail's value wins where it is not empty; cards whose detail failed stay."""
    k = F.col("o_orderkey")
    cards = tables.read(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("venue"))
    details = tables.read(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(k.alias("id"), F.when(k % 2 == 0, F.concat(F.lit("detail "), k.cast("string"))).otherwise("  ").alias("title"), F.concat(F.lit("prio "), "o_orderpriority").alias("venue"))
    return X.merge_detail(cards, details, "id", ["title", "venue"])


@query("SELECT o_orderkey AS post_id, strftime(l_shipdate, '%Y-%m-%d') AS day, min(l_partkey) AS part, arg_min(p_name, (l_linenumber, l_partkey)) AS place FROM orders JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def three_way_source(spark, sf_dir):
    """Dated rows with their post's detail and the first place term; one row for each post and date."""
    li = tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    terms = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = tables.read(spark, sf_dir, "orders").select("o_orderkey").join(li, "o_orderkey").join(terms, "l_partkey", "left")
    return rows.groupBy(F.col("o_orderkey").alias("post_id"), "day").agg(F.min("l_partkey").alias("part"), F.min_by("p_name", F.struct("l_linenumber", "l_partkey")).alias("place"))


@query("SELECT p_partkey AS id, p_name AS county, n > 1 AS several FROM (SELECT p_partkey, p_name, p_size % 4 AS n FROM part) WHERE n > 0")
def first_in_scope(spark, sf_dir):
    """The first of a row's places that the gate lets through, and whether there were more."""
    k, n = F.col("p_partkey"), (F.col("p_size") % 4).cast("int")
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: k + i - 1)).otherwise(F.array().cast("array<bigint>"))
    each = tables.read(spark, sf_dir, "part").select(k.alias("id"), "p_name", F.posexplode(ids).alias("pos", "place"))
    named = each.groupBy("id").agg(F.min_by("p_name", "pos").alias("county"), (F.count("*") > 1).alias("several"))
    return named.select("id", "county", "several")


@query(O.sql("SELECT id, title, venue_id, source FROM cat_events WHERE id % 25 <> 0"))
def staging_scan(spark, sf_dir):
    """Staging rows as JSON lines, read with the fixed schema; malformed lines give no row."""
    k = F.col("id")
    line = F.when(k % 25 == 0, "{bad").otherwise(F.to_json(F.struct("source", k.alias("ordinal"), "title", F.col("venue_id").cast("string").alias("venueName"), F.col("start_at").alias("startAt"), "categories")))
    rows = tables.events(spark, sf_dir).select(F.from_json(line, X.RAW_EVENT, {"mode": "PERMISSIVE"}).alias("r"))
    return rows.where("r.ordinal is not null").select(F.col("r.ordinal").alias("id"), "r.title", F.col("r.venueName").cast("bigint").alias("venue_id"), "r.source")


@query(O.sql("SELECT id, title, venue_id, source FROM cat_events WHERE id % 25 <> 0"))
def staging_files(spark, sf_dir):
    """Staging rows in files of JSON lines."""
    k, folder = F.col("id"), home_of(spark, None)
    line = F.when(k % 25 == 0, '{"source": "x", bad').otherwise(F.to_json(F.struct("source", k.alias("ordinal"), "title", F.col("venue_id").cast("string").alias("venueName"), F.col("start_at").alias("startAt"), "categories")))
    tables.events(spark, sf_dir).select(line.alias("value")).write.text(folder)
    return X.staging_files(spark, folder).select(F.col("ordinal").alias("id"), "title", F.col("venueName").cast("bigint").alias("venue_id"), "source")


def documents(entries, head, tail):
    """One document for each file of entries (file, entry)."""
    return entries.groupBy("file").agg(F.concat(F.lit(head), F.array_join(F.collect_list("entry"), ""), F.lit(tail)).alias("value")).select("value")


@query("SELECT url, CASE WHEN page_id % 4 = 0 THEN '' ELSE '2024-01-' || lpad(CAST(1 + page_id % 28 AS VARCHAR), 2, '0') END AS lastmod FROM pages")
def sitemap_files(spark, sf_dir):
    """The rows of sitemap_rows from XML files."""
    k, folder = F.col("page_id"), home_of(spark, None)
    day = F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
    entry = F.concat(F.lit("<url><loc>"), F.when(k % 2 == 0, F.concat(F.lit("<![CDATA["), "url", F.lit("]]>"))).otherwise(F.replace("url", F.lit("&"), F.lit("&amp;"))), F.lit("</loc>"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("<lastmod> "), day, F.lit("</lastmod>"))), F.lit("<extra a='1'/></url>"))
    documents(pages(spark, sf_dir).select(F.floor(k / 500).alias("file"), entry.alias("entry")), "<urlset>", "</urlset>").write.option("maxRecordsPerFile", 1).text(folder)
    return X.sitemap_files(spark, folder)


@query(O.sql("SELECT title || ' & ' || coalesce(venue, '?') AS title, 'l' || id AS link, title || '|x' AS categories, CASE WHEN city IS NULL THEN 'Olá,?!' ELSE 'Olá, ' || city || '!' END AS description, CASE WHEN id % 3 = 0 THEN 1788343200 END AS published FROM ev WHERE id % 8 <> 0", EV))
def feed_files(spark, sf_dir):
    """The rows of rss_items from XML files."""
    k, folder = F.col("id"), home_of(spark, None)
    item = F.concat(
        F.lit("<item><title>"), "title", F.lit(" &amp;amp; "), F.coalesce("venue", F.lit("?")), F.lit("</title><link>"), F.when(k % 8 == 0, "").otherwise(F.concat(F.lit("l"), k.cast("string"))), F.lit("</link><category>"), "title",
        F.lit("</category><category>x</category><description><![CDATA[<p>Ol&aacute; , "), F.coalesce("city", F.lit("?")), F.lit(" !</p>]]></description>"), F.when(k % 3 == 0, "<pubDate>Wed, 02 Sep 2026 10:00:00 +0000</pubDate>").otherwise(""), F.lit("</item>"),
    )
    documents(ev(spark, sf_dir).select(F.floor(k / 500).alias("file"), item.alias("entry")), "<rss><channel>", "</channel></rss>").write.option("maxRecordsPerFile", 1).text(folder)
    return X.feed_files(spark, folder).select("title", "link", F.array_join("categories", "|").alias("categories"), "description", "published")


@query("SELECT page_id, 'img' || page_id || '.jpg' AS image FROM pages WHERE page_id % 5 <> 0")
def style_images(spark, sf_dir):
    k = F.col("page_id")
    style = F.when(k % 5 == 0, "color: red").otherwise(F.concat(F.lit("background-image: url( 'img"), k.cast("string"), F.lit(".jpg' )")))
    return pages(spark, sf_dir).select("page_id", X.style_image(style).alias("image")).where("image is not null")
