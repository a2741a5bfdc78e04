"""Catalogue maintenance: snapshots in, snapshots out. Deletes are anti joins, inserts ignore known keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from agendry import constants as C
from agendry.functions import places as P
from agendry.functions.dates import lisbon_day
from agendry.operators.graph import connected_components


def alive(start: Column, end: Column, now: int) -> Column:
    """Not over yet, or without a time."""
    t = F.coalesce(end, start)
    return t.isNull() | (t >= now)


def is_expired(start: Column, end: Column, date_text: Column, now: int) -> Column:
    return date_text.isNull() & F.coalesce(F.coalesce(end, start) < now, F.lit(False))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; minima combine before the shuffle, so a hot key stays small."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def last_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, as when later pages overwrite earlier ones."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def publish(tables: dict[str, DataFrame], folder: str, expected: dict[str, int] | None = None) -> DataFrame:
    """(tbl, n) after replacing a mirror's tables together: a version of all of them is written, then named as the current one.

    A table that lacks columns of the version before raises a ValueError, and the mirror stays as it was; so does an
    empty catalogue, and a table whose rows aren't as many as ``expected`` says. Readers take the version that ``current`` names, so they see all tables of one version.
    """
    spark = next(iter(tables.values())).sparkSession
    path = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([folder, *parts]))
    fs = path().getFileSystem(spark._jsc.hadoopConfiguration())
    before = current_version(spark, folder)
    for name, df in tables.items():
        if before is not None and fs.exists(path(f"v={before}", name)) and (lost := missing_columns(spark.read.parquet(f"{folder}/v={before}/{name}"), df)):
            raise ValueError(f"{name} lacks {', '.join(lost)}")
    number = 0 if before is None else before + 1
    counts = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/v={number}/{name}")
        one = spark.read.parquet(f"{folder}/v={number}/{name}").agg(F.lit(name).alias("tbl"), F.count("*").alias("n"))
        counts = one if counts is None else counts.union(one)
    rows = counts.collect()
    if not any(r["n"] for r in rows):
        raise ValueError("nothing to publish")
    for r in rows:
        if r["n"] != (expected or {}).get(r["tbl"], r["n"]):
            raise ValueError(f"{r['tbl']} has {r['n']} rows, not {expected[r['tbl']]}")
    spark.range(1).select(F.lit(number).alias("version")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/current/{number:010d}")
    return spark.createDataFrame(rows, "tbl string, n long")


def current_version(spark, folder: str) -> int | None:
    """The newest version that was named; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/current")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    named = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = [int(p.getName()) for p in named if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max(whole, default=None)


def insert_ignore(table: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    fresh = first_wins(new, key, order).join(table.select(*key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def purge(events: DataFrame, now: int) -> DataFrame:
    """Events without the dated ones that are over."""
    return events.where(~is_expired(F.col("start_at"), F.col("end_at"), F.col("date_text"), now))


def cascade(sources: DataFrame, events: DataFrame) -> DataFrame:
    """Attributions of events that still exist."""
    return sources.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def match(batch: DataFrame, events: DataFrame) -> DataFrame:
    """Adds event_id to a batch (fingerprint, source, slug, start_at): by fingerprint, else by source item and Lisbon day."""
    by_print = events.groupBy("fingerprint").agg(F.min("id").alias("by_print"))
    by_item = events.where("slug is not null").groupBy("source", "slug", lisbon_day(F.col("start_at")).alias("_day")).agg(F.min("id").alias("by_item"))
    met = batch.withColumn("_day", lisbon_day(F.col("start_at"))).join(by_print, "fingerprint", "left").join(by_item, ["source", "slug", "_day"], "left")
    return met.withColumn("event_id", F.coalesce("by_print", "by_item")).drop("by_print", "by_item")


def upsert(batch: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """(ordinal, action, event_id) of each row of a batch (ordinal, title, venue, source, slug, start_at, end_at, categories, url).

    Rows that are over are skipped. A row meets an event of the catalogue by fingerprint, else by source
    item and day; rows that meet none become one new event for all that share a fingerprint or an item
    and day, named by minus the least ordinal. An event whose categories gain, or whose end or url was
    open and is now known, is updated.
    """
    keyed = batch.withColumn("fingerprint", P.fingerprint(F.col("title"), F.col("venue"), F.col("start_at"))).withColumn("_over", ~alive(F.col("start_at"), F.col("end_at"), now))
    met = match(keyed.where("not _over"), events)
    old = events.select(F.col("id").alias("event_id"), F.col("categories").alias("_c"), F.col("end_at").alias("_e"), F.col("url").alias("_u"))
    gains = (F.size(F.array_except("categories", "_c")) > 0) | (F.col("_e").isNull() & F.col("end_at").isNotNull()) | (F.col("_u").isNull() & F.col("url").isNotNull())
    known = met.where("event_id is not null").join(old, "event_id").select("ordinal", F.when(gains, "updated").otherwise("unchanged").alias("action"), "event_id")
    fresh = met.where("event_id is null")
    keys = F.array_compact(F.array(F.concat(F.lit("p"), "fingerprint"), F.when(F.col("slug").isNotNull(), F.concat_ws("|", F.lit("i"), "source", "slug", "_day"))))
    each = fresh.select("ordinal", F.explode(keys).alias("k"))
    hub = each.groupBy("k").agg(F.min("ordinal").alias("dst"))
    found = connected_components(each.join(hub, "k").select(F.col("ordinal").alias("src"), "dst")).withColumnRenamed("node", "ordinal")
    new = fresh.select("ordinal").join(found, "ordinal").select("ordinal", F.when(F.col("ordinal") == F.col("component"), "new").otherwise("merged").alias("action"), (-F.col("component")).alias("event_id"))
    skipped = keyed.where("_over").select("ordinal", F.lit("skipped_past").alias("action"), F.lit(None).cast("bigint").alias("event_id"))
    return known.union(new).union(skipped)


def ghosts(inserted: DataFrame, events: DataFrame) -> DataFrame:
    """Ids of undated events whose dated twin was inserted."""
    twin = lambda df: P.fingerprint_undated(F.col("title"), F.col("venue"))
    fresh = inserted.where("date_text is null").select(twin(inserted).alias("k")).distinct()
    return events.where("date_text is not null").withColumn("k", twin(events)).join(fresh, "k", "left_semi").select("id")


def run_log(items: DataFrame) -> DataFrame:
    """(source, day, started_at, items_found, items_new, items_failed, first_error) of items (source, day, at, is_new, error)."""
    return items.groupBy("source", "day").agg(
        F.min("at").alias("started_at"), F.count("*").alias("items_found"), F.count_if(F.col("is_new")).alias("items_new"), F.count_if(F.col("error").isNotNull()).alias("items_failed"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("at", "error"))).alias("first_error"),
    )


def zero_runs(found: DataFrame) -> DataFrame:
    """(source, day) of sources that found nothing on two days running; ``found`` has (source, day, n), absent days count zero."""
    span = found.select("source").distinct().crossJoin(F.broadcast(found.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))))
    grid = span.select("source", F.explode(F.transform(F.sequence(F.col("lo").cast("date"), F.col("hi").cast("date")), lambda d: d.cast("string"))).alias("day"))
    full = grid.join(found, ["source", "day"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("source").orderBy("day")
    return full.withColumn("p", F.lag("n").over(w)).where("n = 0 and p = 0").select("source", "day")


def until_stale(cards: DataFrame) -> DataFrame:
    """Cards (source, page, url) of pages up to the first that brings no url unseen on an earlier page, that page included."""
    w = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    first = cards.groupBy("source", "url").agg(F.min("page").alias("first_page"))
    novel = cards.select("source", "page").distinct().join(first.groupBy("source", F.col("first_page").alias("page")).agg(F.count("*").alias("n")), ["source", "page"], "left")
    stopped = novel.withColumn("stale", F.coalesce(F.max(F.col("n").isNull().cast("int")).over(w), F.lit(0)))
    return cards.join(stopped.where("stale = 0").select("source", "page"), ["source", "page"], "left_semi")


def pick_candidate(attempts: DataFrame) -> DataFrame:
    """(id, attempt, hit, accepted, note): the first accepted hit of each id, else its last rejection."""
    accepted = F.min(F.when(F.col("accepted"), F.struct("attempt", "hit")))
    last = F.max(F.when(~F.col("accepted"), F.struct("attempt", "hit", "note")))
    best = attempts.groupBy("id").agg(accepted.alias("a"), last.alias("r"))
    return best.select("id", F.coalesce("a.attempt", "r.attempt").alias("attempt"), F.coalesce("a.hit", "r.hit").alias("hit"), F.col("a").isNotNull().alias("accepted"), F.when(F.col("a").isNull(), F.col("r.note")).alias("note"))


def recategorise(events: DataFrame) -> DataFrame:
    """(id, categories, changed) of events (id, categories) after rewriting their categories to the taxonomy."""
    done = P.canonical_categories(events, "id", "categories").withColumnRenamed("categories", "_new")
    return events.select("id", "categories").join(done, "id").select("id", F.col("_new").alias("categories"), (~F.col("_new").eqNullSafe(F.col("categories"))).alias("changed"))


def missing_columns(local: DataFrame, remote: DataFrame) -> list[str]:
    return sorted(set(local.columns) - set(remote.columns))
