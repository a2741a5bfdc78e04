"""Streaming forms of the catalogue's incremental work. Each job reads what is available and stops.

Results and state go to the shared folder. A job with a name finds both again: a second run reads only what came
since, and a run that was cut off goes on where it stopped.
"""

from __future__ import annotations

import contextlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from agendry import constants as C
from agendry.runtime import checkpoint_dir, share_code


def source(spark: SparkSession, path: str) -> DataFrame:
    """A file stream, with the schema of what is there; the path may be one file or a folder."""
    glob = f"{path[:-1]}[{path[-1]}]"  # a glob can name a single file, which a plain path of a stream cannot
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(glob)


def home_of(spark: SparkSession, name: str | None) -> str:
    """The folder of a job's state and result; jobs without a name get one of their own."""
    return f"{checkpoint_dir(spark)}/stream-{name or uuid.uuid4().hex}"


#: Groups that keys with a processor of their own are dealt over, fixed for the life of a job: a call costs about a millisecond, so it serves all keys of a group.
GROUPS = 1024


def group_of(key: Column | str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("group")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_store(spark: SparkSession, provider: str | None) -> Iterator[None]:
    """Streams that start within keep their state with this provider; the session's own setting comes back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if provider:
        spark.conf.set(key, provider)
    try:
        yield
    finally:
        if provider:
            spark.conf.set(key, before) if before else spark.conf.unset(key)


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int, str], None] | None = None, name: str | None = None, provider: str | None = None) -> DataFrame:
    """Run a stream over all that is available and read its result.

    ``each`` gets every micro-batch, its number and the folder of the result; by default batches are appended, and
    in complete mode the newest replaces the result. ``name`` names the job whose state is to be resumed, ``provider`` its
    state store: jobs with a processor of their own need ROCKSDB.
    """
    spark = stream.sparkSession
    home = home_of(spark, name)
    write = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
    if each is None and mode == "append":
        with state_store(spark, provider):
            query = write.format("parquet").option("path", f"{home}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{home}/out")
    keep = each or (lambda batch, number, out: write_version(batch, number, out))
    write.foreachBatch(lambda batch, number: keep(batch, number, f"{home}/out")).start().awaitTermination()
    return read_version(spark, f"{home}/out", stream.schema)


def versions(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the whole versions of a table, in rising order; a version that was not finished has no mark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    whole = [p.getName()[2:] for p in found if p.getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(v) for v in whole)


def read_version(spark: SparkSession, out: str, schema=None, before: int | None = None) -> DataFrame | None:
    """The newest whole version (of those before a number); an empty table of the schema, or None, if there is none."""
    known = [v for v in versions(spark, out) if before is None or v < before]
    if known:
        return spark.read.parquet(f"{out}/v={known[-1]}")
    return spark.createDataFrame([], schema) if schema is not None else None


def write_version(rows: DataFrame, number: int, out: str) -> None:
    """Write a version whole; no earlier one is touched, so a crash loses nothing and a repeated batch writes the same."""
    rows.write.mode("overwrite").parquet(f"{out}/v={number}")


def first_seen(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Each key once; state older than the watermark is dropped, and the event time must be part of the key or bounded by it."""
    return stream.withWatermark(at, delay).dropDuplicates([*keys, at])


def windowed_counts(stream: DataFrame, at: str, by: Column, size: str, slide: str | None = None) -> DataFrame:
    """(day, by, n) for tumbling or sliding windows; days name the start of the window."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"))


def anchor_sessions(stream: DataFrame, key: str, at: str, window: int = C.SESSION_WINDOW) -> DataFrame:
    """(key, anchor) for rows (key, at in seconds): the last anchor of a key is its state.

    A batch's rows of a key are taken in order of time. Rows that come a batch late but before the last
    anchor belong to sessions that are already out and open none.
    """

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        lasts = dict(json.loads(state.get[0])) if state.exists else {}
        times: dict = {}
        for b in batches:
            for k, t in zip(b["key"], b["t"]):
                times.setdefault(k, set()).add(int(t))
        opened = []
        for k, own in times.items():
            for t in sorted(own):
                if k not in lasts or t - lasts[k] > window:
                    lasts[k] = t
                    opened.append((k, t))
        if opened:
            state.update((json.dumps([*lasts.items()]),))
        yield pd.DataFrame({"key": pd.Series([k for k, _ in opened], dtype="object"), "anchor": pd.Series([t for _, t in opened], dtype="int64")})

    own = share_code(stream).select(group_of(key), F.col(key).alias("key"), F.col(at).alias("t"))
    return own.groupBy("group").applyInPandasWithState(step, "key string, anchor long", "lasts string", "append", "NoTimeout")


class _Changes(StatefulProcessor):
    """The last state of each url of a group that was given on, and when; a url that comes again as it was gives nothing."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "urls string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest: dict = {}
        for batch in rows:
            for url, drop, pos, lastmod in zip(batch["url"], batch["drop"], batch["pos"], batch["lastmod"]):
                if url not in newest or (drop, pos) > newest[url][0]:
                    newest[url] = (drop, pos), lastmod or ""
        known = json.loads(self.known.get()[0]) if self.known.exists() else {}
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        if self.ttl_ms:
            known = {url: held for url, held in known.items() if held[1] + self.ttl_ms > now}
        changed = [(url, lastmod, "changed" if url in known else "new") for url, (_, lastmod) in newest.items() if url not in known or known[url][0] != lastmod]
        if changed:
            known |= {url: (lastmod, now) for url, lastmod, _ in changed}
            self.known.update((json.dumps(known),))
            yield pd.DataFrame(changed, columns=["url", "lastmod", "kind"])

    def close(self) -> None:
        pass


def changed_pages(entries: DataFrame, ttl: str | None = None) -> DataFrame:
    """(url, lastmod, kind) of sitemap entries (drop, pos, url, lastmod) that are new, or whose lastmod isn't the last one seen.

    Urls are dealt over groups by hash, so a site of any size spreads over tasks. Of a url's entries in a micro-batch the last
    by (drop, pos) counts; a null lastmod is an empty one. State goes ``ttl`` after it was last written, and then
    the url is new again. Rows without a url go. Run it with drain(..., provider=ROCKSDB).
    """
    own = share_code(entries).where("url is not null").select(group_of("url"), "drop", "pos", "url", "lastmod")
    processor = _Changes(int(pd.Timedelta(ttl).total_seconds() * 1000) if ttl else None)
    return own.groupBy("group").transformWithStateInPandas(processor, "url string, lastmod string, kind string", "append", "processingTime" if ttl else "none")


class _Sessions(StatefulProcessor):
    """For each key of a group the starts that can still move anchors, and the last anchor before them."""

    def __init__(self, window: int, settle: int):
        self.window, self.settle = window, settle

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "keys string")

    def anchors(self, starts: list[int], last: int | None) -> list[int]:
        out = []
        for t in starts:
            if last is None or t - last > self.window:
                last = t
                out.append(t)
        return out

    def held(self) -> dict:
        """key: (last anchor of starts that have left, starts in order)."""
        return {k: (last, starts) for k, last, starts in json.loads(self.known.get()[0])} if self.known.exists() else {}

    def keep(self, held: dict) -> None:
        self.known.update((json.dumps([(k, last, starts) for k, (last, starts) in held.items()]),))
        # A timer for the time when nothing before the last start of some key can come any more.
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        ends = [starts[-1] for _, starts in held.values() if starts]
        if ends:
            self.handle.registerTimer((min(ends) + self.settle) * 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, fresh, moved = self.held(), {}, []
        for batch in rows:
            for k, t in zip(batch["key"], batch["start"]):
                fresh.setdefault(k, set()).add(int(t))
        for k, new in fresh.items():
            last, starts = held.get(k, (None, []))
            both = sorted({*starts, *new})
            before, after = set(self.anchors(starts, last)), set(self.anchors(both, last))
            held[k] = last, both
            moved += [(k, t, -1) for t in sorted(before - after)] + [(k, t, 1) for t in sorted(after - before)]
        self.keep(held)
        if moved:
            yield pd.DataFrame(moved, columns=["key", "anchor", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, until = self.held(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for k, (last, starts) in held.items():
            if starts and (starts[-1] + self.settle) * 1000 <= until:
                held[k] = [last, *self.anchors(starts, last)][-1], []
        self.keep(held)
        yield pd.DataFrame({"key": pd.Series([], dtype="object"), "anchor": pd.Series([], dtype="int64"), "change": pd.Series([], dtype="int32")})

    def close(self) -> None:
        pass


def anchor_changes(stream: DataFrame, key: str, at: str, delay: str, window: int = C.SESSION_WINDOW) -> DataFrame:
    """(key, anchor, change) for rows (key, at, an event time): anchors that open (1) and that a start between older ones takes back (-1).

    A start opens a session if it is more than ``window`` seconds after the last anchor of its key. A start that comes late, before anchors
    that are out already, moves what follows it: the changes of an anchor sum to 1 if it stands and to 0 if not, and
    what stands is what the whole set of starts gives, in whatever order they came, as long as none is later than ``delay``. A
    key's starts leave the state that long after its last one; its last anchor stays. Run it with drain(..., provider=ROCKSDB).
    """
    watched = share_code(stream).withWatermark(at, delay).select(group_of(key), F.col(key).alias("key"), at, F.unix_seconds(at).alias("start"))
    processor = _Sessions(window, int(pd.Timedelta(delay).total_seconds()))
    return watched.groupBy("group").transformWithStateInPandas(processor, "key string, anchor long, change int", "append", "eventTime")


def split_late(stream: DataFrame, over: Column, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows): rows whose event is over go to a side table instead of the main one."""
    spark = stream.sparkSession
    out = f"{home_of(spark, name)}/out"

    def keep(batch: DataFrame, number: int, out: str) -> None:
        marked = batch.withColumn("_late", F.coalesce(over, F.lit(False)))
        marked.write.mode("overwrite").partitionBy("_late").parquet(f"{out}/v={number}")

    write = stream.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    write.foreachBatch(lambda batch, number: keep(batch, number, out)).start().awaitTermination()
    # The versions are one partitioned table, read as such: the plan does not grow with the batches.
    schema = StructType([*stream.schema.fields, StructField("_late", BooleanType()), StructField("v", LongType())])
    known = versions(spark, out)
    paths = [f"{out}/v={v}" for v in known]
    every = (spark.read.schema(schema).option("basePath", out).parquet(*paths) if known else spark.createDataFrame([], schema)).drop("v")
    return every.where("not _late").drop("_late"), every.where("_late").drop("_late")


def live_cache(stream: DataFrame, key: str, at: str, ttl: str) -> DataFrame:
    """(key, rows, first, last) each time that a key expires: keyed state that goes ``ttl`` after the key's last event time.

    ``at`` is an event time under a watermark of ``ttl``; keys that are still alive at the end of the data stay in the state.
    """
    seconds = int(pd.Timedelta(ttl).total_seconds())

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = {k: own for k, *own in json.loads(state.get[0])} if state.exists else {}
        watermark, touched = state.getCurrentWatermarkMs(), set()
        for b in batches if not state.hasTimedOut else ():
            for k, n, first, last in b.groupby("key", dropna=False)["t"].agg(["size", "min", "max"]).itertuples():
                k = None if k != k else k
                had = held.get(k, (0, first, last))
                held[k] = [had[0] + n, min(had[1], first), max(had[2], last), 0]
                touched.add(k)
        for k in touched:
            held[k][3] = max((held[k][2] + seconds) * 1000, watermark + 1)
        gone = [(k, *own[:3]) for k, own in held.items() if own[3] < watermark]
        held = {k: own for k, own in held.items() if own[3] >= watermark}
        if held:
            state.update((json.dumps([(k, *map(int, own)) for k, own in held.items()]),))
            state.setTimeoutTimestamp(max(min(own[3] for own in held.values()), watermark + 1))
        elif state.exists:
            state.remove()
        if gone:
            yield pd.DataFrame(gone, columns=["key", "rows", "first", "last"])

    watched = share_code(stream).withWatermark(at, ttl).select(group_of(key), F.col(key).alias("key"), at, F.unix_seconds(at).alias("t"))
    return watched.groupBy("group").applyInPandasWithState(step, "key string, rows long, first long, last long", "held string", "append", "EventTimeTimeout")


def upsert_first(keys: list[str], order: str) -> Callable[[DataFrame, int, str], None]:
    """A batch writer that keeps the least ``order`` of each key over all batches, one version of the table for each."""

    def keep(batch: DataFrame, number: int, out: str) -> None:
        known = read_version(batch.sparkSession, out, before=number)
        both = batch if known is None else known.unionByName(batch)
        write_version(both.groupBy(*keys).agg(F.min(order).alias(order)), number, out)

    return keep


def ingest(batches: DataFrame, to_batch: Callable[[DataFrame], DataFrame], start: dict[str, DataFrame], now: int, name: str | None = None) -> dict[str, DataFrame]:
    """The catalogue after every micro-batch went through a whole maintenance cycle; run rows of all batches are kept.

    ``to_batch`` makes raw rows of a micro-batch. Each batch reads the catalogue that the batch before it left and writes
    its own version, so a batch that runs twice gives the same. A batch of which a step failed writes nothing and fails the
    stream, so the next run takes it again.
    """
    from agendry.plans.ingest import cycle, whole

    spark = batches.sparkSession
    home = home_of(spark, name)
    tables = ("venues", "events", "sources")

    def step(batch: DataFrame, number: int) -> None:
        known = {t: read_version(spark, f"{home}/{t}", before=number) for t in tables}
        state = whole(cycle(to_batch(batch), {t: start[t] if known[t] is None else known[t] for t in tables}, now, "stream"))
        for t in (*tables, "run"):
            write_version(state[t], number, f"{home}/{t}")

    write = batches.writeStream.option("checkpointLocation", f"{home}/state").trigger(availableNow=True)
    write.foreachBatch(step).start().awaitTermination()
    runs = None
    for v in versions(spark, f"{home}/run"):
        one = spark.read.parquet(f"{home}/run/v={v}")
        runs = one if runs is None else runs.unionByName(one)
    return {t: read_version(spark, f"{home}/{t}") or start[t] for t in tables} | ({"run": runs} if runs is not None else {})
