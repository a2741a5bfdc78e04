from __future__ import annotations

from pyspark.sql import functions as F

from agendry import constants as C, oracle as O, tables
from agendry.functions.dates import EPOCH
from agendry.registry import query
from agendry.streaming import jobs as J, parts


def events(spark, sf_dir):
    """The event stream; the event time is read as UTC."""
    at = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    return J.source(spark, f"{sf_dir}/events.parquet").withColumn("at", at)


def day_of(c):
    return F.date_format(F.timestamp_seconds(F.unix_seconds(c)), "yyyy-MM-dd")


@query("SELECT DISTINCT user_id, event_type, strftime(ts, '%Y-%m-%d') AS day FROM events")
def stream_dedupe(spark, sf_dir):
    """Each user and type once a day."""
    daily = events(spark, sf_dir).withColumn("day", F.date_trunc("day", "at"))
    once = J.first_seen(daily.select("user_id", "event_type", "day"), ["user_id", "event_type"], "day", "2 days")
    return J.drain(once).select("user_id", "event_type", day_of(F.col("day")).alias("day"))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, {O.arr(tables.SOURCES)}[CAST(event_id % 8 AS INTEGER) + 1] AS source, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_counts(spark, sf_dir):
    counts = J.windowed_counts(events(spark, sf_dir), "at", tables.source_at(F.col("event_id")).alias("source"), "1 day")
    return J.drain(counts, "complete").select(day_of(F.col("w.start")).alias("day"), "source", "n")


@query("SELECT strftime(CAST(ts AS DATE) - CAST(k AS INTEGER), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, unnest(range(0, 7)) AS t(k) GROUP BY ALL")
def stream_sliding(spark, sf_dir):
    """Counts of seven days, a window from each day on."""
    counts = J.windowed_counts(events(spark, sf_dir), "at", F.col("event_type"), "7 days", "1 day")
    return J.drain(counts, "complete").select(day_of(F.col("w.start")).alias("day"), "event_type", "n")


@query(f"""WITH RECURSIVE st AS (SELECT DISTINCT event_type || '|' || user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
walk AS (SELECT key, min(t) AS anchor FROM st GROUP BY 1 UNION ALL SELECT w.key, (SELECT min(s.t) FROM st s WHERE s.key = w.key AND s.t > w.anchor + {C.SESSION_WINDOW}) AS anchor FROM walk w WHERE w.anchor IS NOT NULL)
SELECT key, anchor FROM walk WHERE anchor IS NOT NULL""")
def stream_anchor_sessions(spark, sf_dir):
    t = F.timestamp_diff("SECOND", F.expr(EPOCH), F.col("ts"))
    keyed = events(spark, sf_dir).select(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"), t.alias("t"))
    return J.drain(J.anchor_sessions(keyed, "key", "t"))


def arrivals(spark, folder, schema):
    """A stream of a folder's files; a run takes all that came since the one before as one micro-batch, however many files it lies in."""
    return spark.readStream.schema(schema).parquet(folder)


@query(f"""WITH RECURSIVE st AS (SELECT DISTINCT event_type || '|' || user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
walk AS (SELECT key, min(t) AS anchor FROM st GROUP BY 1 UNION ALL SELECT w.key, (SELECT min(s.t) FROM st s WHERE s.key = w.key AND s.t > w.anchor + {C.SESSION_WINDOW}) AS anchor FROM walk w WHERE w.anchor IS NOT NULL)
SELECT key, anchor FROM walk WHERE anchor IS NOT NULL""")
def stream_anchor_changes(spark, sf_dir):
    """Starts that arrive in three drops, each all over time: late ones move anchors, and the changes net to the sessions of all."""
    home = J.home_of(spark, None)
    name, folder = home.rsplit("stream-", 1)[1], f"{home}/drops"
    rows = tables.read(spark, sf_dir, "events").select(
        F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"), F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).alias("at"), "event_id"
    )
    for part in range(3):
        rows.where(F.col("event_id") % 3 == part).drop("event_id").write.mode("append").parquet(folder)
        changes = J.drain(J.anchor_changes(arrivals(spark, folder, "key string, at timestamp"), "key", "at", "3650 days"), name=name, provider=J.ROCKSDB)
    return changes.groupBy("key", "anchor").agg(F.sum("change").alias("n")).where("n = 1").select("key", "anchor")


@query("""SELECT 'https://example.org/e' || event_id AS url, strftime(ts, '%Y-%m-%d') AS lastmod, 'new' AS kind FROM events WHERE event_id % 11 <> 0
UNION ALL SELECT 'https://example.org/e' || event_id, strftime(CAST(ts AS DATE) + CAST(event_id % 7 = 0 AS INTEGER), '%Y-%m-%d'), CASE WHEN event_id % 11 = 0 THEN 'new' ELSE 'changed' END FROM events WHERE event_id % 11 = 0 OR event_id % 7 = 0""")
def stream_change_feed(spark, sf_dir):
    """Two drops of a sitemap of all events: the second gives new urls and those whose lastmod moved, and comes twice for nothing."""
    home = J.home_of(spark, None)
    name, folder, k = home.rsplit("stream-", 1)[1], f"{home}/drops", F.col("event_id")
    rows = tables.read(spark, sf_dir, "events").select(k, F.concat(F.lit("https://example.org/e"), k.cast("string")).alias("url"), F.to_date("ts").alias("day"))
    drop = lambda n, day: (F.lit(n).cast("bigint").alias("drop"), k.alias("pos"), "url", F.date_format(day, "yyyy-MM-dd").alias("lastmod"))
    drops = [rows.where(k % 11 != 0).select(*drop(0, "day")), *[rows.select(*drop(n, F.when(k % 7 == 0, F.date_add("day", 1)).otherwise(F.col("day")))) for n in (1, 2)]]
    out = None
    for one in drops:
        one.write.mode("append").parquet(folder)
        # The job is stopped and resumed between drops.
        out = J.drain(J.changed_pages(arrivals(spark, folder, "drop long, pos long, url string, lastmod string")), name=name, provider=J.ROCKSDB)
    return out


@query(O.sql("SELECT source, source_event_id AS slug, min(id) AS id FROM cat_events WHERE source_event_id IS NOT NULL GROUP BY ALL"))
def stream_upsert(spark, sf_dir):
    """Items of all batches, the first row of each; a batch that comes twice changes nothing."""
    k = F.col("event_id")
    rows = events(spark, sf_dir).where(k % 4 != 0).select(tables.source_at(k).alias("source"), F.concat(F.lit("i"), F.floor(k / 3).cast("string")).alias("slug"), k.alias("id"))
    return J.drain(rows, "append", J.upsert_first(["source", "slug"], "id"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, user_id, min(event_id) AS event_id FROM events GROUP BY ALL""")
def stream_upsert_days(spark, sf_dir):
    """The first row of each day, type and user over three drops; a drop rewrites the days that it touches and no others."""
    home, k = J.home_of(spark, None), F.col("event_id")
    rows = tables.read(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "user_id", k)
    merge = parts.keep_least(["day", "event_type", "user_id"], "event_id")
    keep = lambda batch, number: parts.upsert(spark, f"{home}/table", batch, F.substring("day", 1, 7), merge, "drops", number)
    for part in range(3):
        rows.where(k % 3 == part).write.mode("append").parquet(f"{home}/drops")
        write = arrivals(spark, f"{home}/drops", rows.schema).writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
        write.foreachBatch(keep).start().awaitTermination()
    return parts.read(spark, f"{home}/table")


@query(f"SELECT CASE WHEN epoch(ts) < {C.NOW} THEN 'late' ELSE 'kept' END AS side, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_late(spark, sf_dir):
    """Rows whose event is over go to a side table."""
    over = F.col("at") < F.timestamp_seconds(F.lit(C.NOW))
    kept, late = J.split_late(events(spark, sf_dir).select("event_type", "at"), over)
    count = lambda df, side: df.groupBy("event_type").agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "event_type", "n")
    return count(kept, "kept").union(count(late, "late"))


@query("""SELECT event_type || '|' || user_id AS key, count(*) AS rows, min(CAST(floor(epoch(ts)) AS BIGINT)) AS first, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last FROM events
  GROUP BY 1 HAVING max(CAST(floor(epoch(ts)) AS BIGINT)) < (SELECT max(epoch(ts)) FROM events) - 2 * 3 * 86400""")
def stream_live_cache(spark, sf_dir):
    """Keys that have not been seen for three days and their number of rows; those alive at the end stay in the state."""
    rows = events(spark, sf_dir).select(F.concat_ws("|", "event_type", F.col("user_id").cast("string")).alias("key"), "at")
    return J.drain(J.live_cache(rows, "key", "at", "3 days"))


@query()
def stream_ingest(spark, sf_dir):
    """Raw rows that arrive as a stream go through whole maintenance cycles; gives the events at the end."""
    from agendry.bound.ingest import PAST, batch, catalogue

    folder = f"{J.home_of(spark, None)}/raw"
    batch(spark, sf_dir).drop("venue_id").write.parquet(folder)
    done = J.ingest(J.source(spark, folder), lambda rows: rows, catalogue(spark, sf_dir), PAST)
    return done["events"].select("id", "title", "start_at", "end_at", "venue_id", "fingerprint")
