"""One ingest of a batch into the catalogue: venues, events and attributions in, the next snapshot out.

A catalogue is a dict of DataFrames:

* venues (id, name, slug, city),
* events (id, title, start_at, end_at, venue_id, venue, city, url, categories, date_text, fingerprint),
* sources (event_id, source, source_event_id).

A batch has (ordinal, title, venue, city, source, slug, start_at, end_at, date_text, categories, url); start_at is
null for undated rows.
"""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from agendry.functions import places as P, text as T
from agendry.functions.dates import lisbon_day
from agendry.operators import merge as M, pairs as R
from agendry.operators.graph import connected_components
from agendry.plans import catalog as K
from agendry.runtime import cut

NO_CITY, NO_SLUG = "Leiria (distrito)", "venue-desconhecido"

#: What says that the engine could not do its work, not that a step refused its data.
ENGINE = (Py4JError, PySparkException, OSError, MemoryError)


def venue_slug(name) -> F.Column:
    slug = T.slugify(T.norm_venue(name))
    return F.when(slug == "", NO_SLUG).otherwise(slug)


def _top(df: DataFrame, column: str = "id"):
    """The largest id, as a one-row frame (_base); 0 for an empty table."""
    return F.broadcast(df.agg(F.coalesce(F.max(column), F.lit(0)).cast("bigint").alias("_base")))


def resolve_venues(named: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((ordinal, venue_id) of each row of ``named`` (ordinal, venue, city), and ``venues`` with those created).

    A venue of the same slug is taken; else the least id of the same city that the strict venue rule joins to the
    name; else a venue is created. Names of one batch that the rule joins within their city are one new venue, that
    of the least ordinal. Names without a city are joined by slug alone.
    """
    rows = named.select("ordinal", T.norm_venue(F.coalesce("venue", F.lit(""))).alias("name"), venue_slug(F.coalesce("venue", F.lit(""))).alias("slug"), F.nullif("city", F.lit("")).alias("city"))
    known = venues.select("slug", F.col("id").alias("by_slug"))
    # One row for each slug and city that no venue has yet, named by its least ordinal.
    unknown = cut(rows.join(known, "slug", "left_anti").groupBy("slug", "city").agg(F.min_by("name", "ordinal").alias("name"), F.min("ordinal").alias("ordinal")))
    fact = lambda df: df.where("city is not null").select("id", T.venue_tokens(F.col("name"), F.col("city")).alias("tokens"), "city", T.is_vague(F.col("name"), F.col("city")).alias("vague"))
    # Old venues keep their ids; new names stand beyond them all, in their order.
    lifted = unknown.crossJoin(_top(venues)).select((F.col("_base") + 1 + F.col("ordinal")).alias("id"), "slug", "city", "name")
    facts = cut(fact(venues).withColumn("old", F.lit(True)).union(fact(lifted).withColumn("old", F.lit(False))))
    # Equal token sets of a city are a class, one old and one new name stand for it.
    rep = facts.where("not vague").groupBy("tokens", "city", "old").agg(F.min("id").alias("rep"))
    members = facts.where("not vague and not old").join(rep.withColumnRenamed("old", "of_old"), ["tokens", "city"]).where("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst"), F.col("of_old"))
    pairs = _strict_pairs(rep)
    own = members.where("not of_old").select("src", "dst").union(pairs.where("not a_old and not b_old").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    new_rep = facts.where("not vague and not old").join(rep.where("not old").select("tokens", "city", "rep"), ["tokens", "city"]).select("id", "rep")
    direct = members.where("of_old").select(F.col("src").alias("id"), F.col("dst").alias("old_id")).union(new_rep.join(pairs.where("not a_old and b_old").select(F.col("a").alias("rep"), F.col("b").alias("old_id")), "rep").select("id", "old_id"))
    met = cut(direct.groupBy("id").agg(F.min("old_id").alias("old_id")))
    # Slugs are unique, so rows of one slug in two cities are one venue as well.
    loose = cut(lifted.join(met, "id", "left_anti"))
    same_slug = loose.join(loose.groupBy("slug").agg(F.min("id").alias("dst")), "slug").select(F.col("id").alias("src"), "dst")
    free = loose.select(F.col("id").alias("src"))
    joined = own.join(free, "src", "left_semi").join(free.withColumnRenamed("src", "dst"), "dst", "left_semi").select("src", "dst")
    found = connected_components(joined.union(same_slug)).withColumnRenamed("node", "id")
    made = loose.join(found, "id").select("id", "slug", "city", "name", F.col("component").alias("venue_id"))
    created = made.where("id = venue_id").select("id", "name", "slug", F.coalesce("city", F.lit(NO_CITY)).alias("city"))
    named_new = lifted.join(met, "id").select("slug", "city", F.col("old_id").alias("venue_id")).union(made.select("slug", "city", "venue_id"))
    by_name = named_new.select(F.col("slug").alias("_s"), F.col("city").alias("_c"), "venue_id")
    placed = rows.join(known, "slug", "left").join(by_name, (F.col("slug") == F.col("_s")) & F.col("city").eqNullSafe(F.col("_c")), "left")
    return placed.select("ordinal", F.coalesce("by_slug", "venue_id").alias("venue_id")), venues.unionByName(created)


def _strict_pairs(rep: DataFrame) -> DataFrame:
    """(a, b, a_old, b_old), both ways, of classes of one city of which one's tokens contain the other's."""
    rarest = R.with_rarest(rep.withColumnRenamed("rep", "id"), "tokens")
    short = rarest.select(F.col("id").alias("a"), F.col("old").alias("a_old"), "city", F.col("tokens").alias("ta"), F.col("rarest").alias("t"))
    long = rep.select(F.col("rep").alias("b"), F.col("old").alias("b_old"), "city", F.col("tokens").alias("tb"), F.explode("tokens").alias("t"))
    met = short.join(long, ["city", "t"]).where((F.col("a") != F.col("b")) & R.contained(F.col("ta"), F.col("tb"))).select("a", "b", "a_old", "b_old")
    return met.union(met.select("b", "a", "b_old", "a_old")).distinct()


def upsert(batch: DataFrame, events: DataFrame, sources: DataFrame, now: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, sources, actions) after a batch with venue_id; actions are (ordinal, action, event_id).

    Rows that are over are skipped. A row meets an event by fingerprint, else, if dated, by a source item of the same
    Lisbon day. An event that rows meet gets the sorted union of categories, and the first known end and url where it
    had none. Rows that meet no event become one for all that share a fingerprint or an item and day; its values
    are those of the least ordinal, completed in the same way, its id follows the largest known one. A new dated event
    removes its undated twin. Attributions are added once for each event and source.
    """
    dated = F.col("start_at").isNotNull()
    print_ = F.when(dated, P.fingerprint(F.col("title"), F.col("venue"), F.col("start_at"))).otherwise(P.fingerprint_undated(F.col("title"), F.col("venue")))
    keyed = batch.withColumn("fingerprint", print_).withColumn("_day", F.when(dated, lisbon_day(F.col("start_at")))).withColumn("_over", ~K.alive(F.col("start_at"), F.col("end_at"), now))
    canonical = P.canonical_categories(keyed, "ordinal", "categories").withColumnRenamed("categories", "_canonical")
    rows = cut(keyed.join(canonical, "ordinal", "left").withColumn("categories", F.coalesce("_canonical", F.array().cast("array<string>"))).drop("_canonical"))
    by_print = events.groupBy("fingerprint").agg(F.min("id").alias("by_print"))
    items = sources.where("source_event_id is not null").join(events.where("date_text is null").select(F.col("id").alias("event_id"), lisbon_day(F.col("start_at")).alias("_day")), "event_id")
    by_item = items.groupBy("source", F.col("source_event_id").alias("slug"), "_day").agg(F.min("event_id").alias("by_item"))
    met = cut(rows.where("not _over").join(by_print, "fingerprint", "left").join(by_item, ["source", "slug", "_day"], "left").withColumn("_old", F.coalesce("by_print", "by_item")))

    fresh = met.where("_old is null")
    keys = F.array_compact(F.array(F.concat(F.lit("p"), "fingerprint"), F.when(F.col("slug").isNotNull() & F.col("_day").isNotNull(), F.concat_ws("|", F.lit("i"), "source", "slug", "_day"))))
    each = fresh.select("ordinal", F.explode(keys).alias("k"))
    hub = each.groupBy("k").agg(F.min("ordinal").alias("dst"))
    found = connected_components(each.join(hub, "k").select(F.col("ordinal").alias("src"), "dst")).withColumnRenamed("node", "ordinal")
    named = found.crossJoin(_top(events)).select("ordinal", (F.col("_base") + 1 + F.col("component")).alias("_new"), (F.col("component") == F.col("ordinal")).alias("_first"))
    placed = cut(met.join(named, "ordinal", "left").withColumn("event_id", F.coalesce("_old", "_new")))

    known = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ordinal"))).alias(f"_{c}")
    gained = placed.groupBy("event_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("categories")))).alias("_c"), known("end_at"), known("url"), F.count("*").alias("_n"))
    created = placed.where("_first").select(
        F.col("event_id").alias("id"), "title", F.coalesce("start_at", F.lit(now).cast("bigint")).alias("start_at"), "end_at", "venue_id", "venue", "city", "url", "categories", "date_text", "fingerprint",
    )
    both = events.withColumn("_created", F.lit(False)).unionByName(created.select(*events.columns).withColumn("_created", F.lit(True)))
    merged = both.join(gained.withColumnRenamed("event_id", "id"), "id", "left")
    alone = F.col("_n").isNull() | (F.col("_created") & (F.col("_n") == 1))
    union = F.array_sort(F.array_distinct(F.concat("categories", F.coalesce("_c", F.array().cast("array<string>")))))
    full = merged.withColumn("categories", F.when(alone, F.col("categories")).otherwise(union)).withColumn("end_at", F.coalesce("end_at", F.when(F.col("date_text").isNull(), F.col("_end_at")))).withColumn("url", F.coalesce("url", "_url"))
    twins = full.where("_created and date_text is null").select(P.fingerprint_undated(F.col("title"), F.col("venue")).alias("fingerprint")).distinct()
    left = cut(full.join(twins, "fingerprint", "left_anti").select(*events.columns))
    added = K.first_wins(placed.select("event_id", "source", F.col("slug").alias("source_event_id"), "ordinal"), ["event_id", "source"], ["ordinal"]).select("event_id", "source", "source_event_id")
    fresh_links = added.join(sources.select("event_id", "source"), ["event_id", "source"], "left_anti")
    links = K.cascade(sources.select("event_id", "source", "source_event_id").unionByName(fresh_links), left)

    old = events.select(F.col("id").alias("event_id"), F.col("categories").alias("_oc"), F.col("end_at").alias("_oe"), F.col("url").alias("_ou"))
    gains = (F.size(F.array_except("categories", "_oc")) > 0) | (F.col("_oe").isNull() & F.col("end_at").isNotNull()) | (F.col("_ou").isNull() & F.col("url").isNotNull())
    action = F.when(F.col("_old").isNull(), F.when(F.col("_first"), "inserted").otherwise("merged")).when(gains, "updated").otherwise("unchanged")
    acted = placed.join(old, "event_id", "left").select("ordinal", action.alias("action"), "event_id")
    skipped = rows.where("_over").select("ordinal", F.lit("skipped_past").alias("action"), F.lit(None).cast("bigint").alias("event_id"))
    return left, links, acted.union(skipped)


def fuse_venues(events: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, venues, aliases (id, canonical)): venues of a component become the canonical one, events follow it.

    The canonical venue is specific, of the fewest words, of the most events, of the least id, in this order.
    """
    facts = cut(R.venue_facts(venues))
    used = events.groupBy(F.col("venue_id").alias("id")).agg(F.count("*").alias("n"))
    scored = facts.join(R.venue_components(facts), "id").join(used, "id", "left")
    best = scored.groupBy("component").agg(F.min(F.struct("vague", F.size("tokens").alias("words"), (-F.coalesce("n", F.lit(0))).alias("n"), "id")).alias("best"))
    aliases = cut(scored.select("id", "component").join(best, "component").where("id <> best.id").select("id", F.col("best.id").alias("canonical")))
    moved = events.join(aliases.select(F.col("id").alias("venue_id"), "canonical"), "venue_id", "left").withColumn("venue_id", F.coalesce("canonical", "venue_id")).select(*events.columns)
    return moved, venues.join(aliases.select("id"), "id", "left_anti"), aliases


def item_keys(sources: DataFrame) -> DataFrame:
    """(id, item_key): the one source item of each event that has exactly one."""
    items = sources.where("coalesce(source_event_id, '') <> ''").groupBy(F.col("event_id").alias("id")).agg(F.count_distinct("source", "source_event_id").alias("n"), F.max(F.concat_ws(":", "source", "source_event_id")).alias("item_key"))
    return items.where("n = 1").select("id", "item_key")


def acted_on(members: DataFrame) -> DataFrame:
    """(component, rows, prints, acted) of members (component, fingerprint): two rows and two fingerprints at least are a case."""
    counted = members.groupBy("component").agg(F.count("*").alias("rows"), F.count_distinct("fingerprint").alias("prints"))
    return counted.withColumn("acted", (F.col("rows") >= 2) & (F.col("prints") >= 2))


def reconcile(events: DataFrame, sources: DataFrame, max_rounds: int = 10) -> tuple[DataFrame, DataFrame, int]:
    """(events, sources, absorbed): rows of one occurrence merged, until nothing merges any more.

    A merge can widen an end and so meet a further row; repeating until no row is absorbed makes a second run a no-op.
    Undated events stand aside. An event whose fingerprint another keeper came to goes as well.
    """
    absorbed = 0
    for _ in range(max_rounds):
        venues = events.select("id", "venue_id", "url", "date_text")
        dated = events.where("date_text is null").join(item_keys(sources), "id", "left")
        facts = cut(R.event_facts(dated))  # three kinds of pairs and the plan read them
        trust = sources.groupBy(F.col("event_id").alias("id")).agg(F.min(P.trust(F.col("source"))).alias("trust"))
        found = R.event_components(facts)
        cases = acted_on(found.join(dated.select("id", "fingerprint"), "id")).where("acted").select("component")
        rows = facts.join(found.join(cases, "component", "left_semi"), "id").join(trust, "id", "left").withColumn("trust", F.coalesce("trust", P.trust(F.lit(None).cast("string"))))
        planned = cut(M.plan(cut(rows.select("id", "component", "norm", "start_at", "end_at", "item_key", "trust"))))
        kept = M.survivors(dated, planned).join(venues.drop("date_text"), "id").withColumn("date_text", F.lit(None).cast("string"))
        both = cut(events.join(planned.select("id"), "id", "left_anti").unionByName(kept.select(*events.columns)))
        lost = events.count() - both.count()
        if not lost:
            return events, sources, absorbed
        absorbed += lost
        keeper = planned.select(F.col("id").alias("event_id"), "keeper_id")
        moved = M.move_attributions(sources.join(keeper.select("event_id"), "event_id", "left_semi"), planned)
        rest = sources.join(keeper.select("event_id"), "event_id", "left_anti")
        events, sources = both, cut(K.cascade(rest.unionByName(moved.select(*rest.columns)), both))
    raise RuntimeError("events did not settle")


def cycle(batch: DataFrame, catalogue: dict[str, DataFrame], now: int, source: str, failed: int = 0, steps: dict[str, Callable] | None = None) -> dict[str, DataFrame]:
    """The next catalogue and its run row: upsert, purge, venue fusion, reconciliation.

    A step that fails leaves the catalogue as the step before left it; the first error is recorded, and later
    steps still run; who takes the catalogue without its run row asks whole() for it. What the engine fails at is no
    matter of a step and is raised. ``steps`` replaces steps by name. ``failed`` counts items that extraction could not read.
    """
    state, counts, error = dict(catalogue), {"new": 0, "updated": 0, "skipped": 0, "purged": 0}, None

    def ingest(c):
        ids, venues = resolve_venues(batch.where(K.alive(F.col("start_at"), F.col("end_at"), now)).select("ordinal", "venue", "city"), c["venues"])
        events, sources, actions = upsert(batch.join(ids, "ordinal", "left"), c["events"], c["sources"], now)
        n = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
        counts.update(new=n.get("inserted", 0), updated=n.get("updated", 0), skipped=n.get("skipped_past", 0))
        return {"events": events, "sources": sources, "venues": venues}

    def purge(c):
        left = cut(K.purge(c["events"], now))
        counts["purged"] = c["events"].count() - left.count()
        return {"events": left, "sources": K.cascade(c["sources"], left)}

    def fuse(c):
        events, venues, _ = fuse_venues(c["events"], c["venues"])
        return {"events": events, "venues": venues}

    def settle(c):
        events, sources, _ = reconcile(c["events"], c["sources"])
        return {"events": events, "sources": sources}

    for name, step in ({"upsert": ingest, "purge": purge, "fuse": fuse, "reconcile": settle} | (steps or {})).items():
        try:
            state |= {k: cut(df) for k, df in step(state).items()}
        except ENGINE:
            raise
        except Exception as e:  # noqa: BLE001  what a step refuses is recorded in the run row
            error = error or f"{name} failed: {e}".split("\n")[0]
    spark = batch.sparkSession
    row = (source, batch.count() + failed, counts["new"], counts["updated"], counts["skipped"], counts["purged"], failed, error)
    state["run"] = spark.createDataFrame([row], "source string, items_found long, items_new long, items_updated long, items_skipped long, items_purged long, items_failed long, error string")
    return state


def whole(state: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """``state`` of a cycle, if no step failed; else a RuntimeError with the first error of its run rows."""
    if error := state["run"].where("error is not null").first():
        raise RuntimeError(f"ingest of {error['source']}: {error['error']}")
    return state


def geocode_writeback(venues: DataFrame, picked: DataFrame) -> DataFrame:
    """``venues`` (id, name, lat, lng, scope, address) after a geocoder's answers (id, accepted, lat, lng, address).

    Names of a whole concelho only get that scope. Accepted answers set coordinates and the scope that the name says, and the address if there is one.
    """
    a = picked.select("id", "accepted", F.col("lat").alias("_lat"), F.col("lng").alias("_lng"), F.col("address").alias("_address"))
    scope = P.record_scope(F.col("name"))
    known = F.coalesce(F.col("accepted"), F.lit(False)) & (scope != "concelho")
    new = lambda c: F.when(known, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    return venues.join(a, "id", "left").select(
        "id", "name", new("lat"), new("lng"), F.when(known | (scope == "concelho"), scope).otherwise(F.col("scope")).alias("scope"),
        F.when(known, F.coalesce("_address", "address")).otherwise(F.col("address")).alias("address"),
    )


def geocode_tally(venues: DataFrame, picked: DataFrame) -> DataFrame:
    """(status, count): skipped for names of a concelho, placed, rejected, or miss for venues that nothing answered."""
    a = picked.select("id", "accepted")
    status = F.when(P.record_scope(F.col("name")) == "concelho", "skipped").when(F.col("accepted"), "placed").when(F.col("accepted").isNotNull(), "rejected").otherwise("miss")
    return venues.join(a, "id", "left").groupBy(status.alias("status")).agg(F.count("*").alias("count"))
