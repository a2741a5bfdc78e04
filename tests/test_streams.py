"""Streams with processors of their own: orders of arrival, repeats, resumption and expiry."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from agendry.streaming import jobs as J, parts


def files(spark, folder, rows, schema):
    """Write each group of rows as one file, in their order."""
    for group in rows:
        spark.createDataFrame(group, schema).coalesce(1).write.mode("append").parquet(folder)


def one_by_one(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def plain_anchors(starts, window):
    out = []
    for t in sorted(starts):
        if not out or t - out[-1] > window:
            out.append(t)
    return out


def test_any_order_of_arrival_ends_at_the_same_sessions(spark, tmp_path):
    rng = random.Random(1)
    starts = {k: [rng.randrange(1_700_000_000, 1_700_000_000 + 40_000) for _ in range(14)] for k in "abc"}
    rows = [(k, t) for k, ts in starts.items() for t in [*ts, ts[0]]]
    rng.shuffle(rows)
    folder = f"{tmp_path}/in"
    files(spark, folder, [[(k, t) for k, t in rows[i::4]] for i in range(4)], "key string, t long")
    stream = one_by_one(spark, folder, "key string, t long").withColumn("at", F.timestamp_seconds("t"))
    changes = J.drain(J.anchor_changes(stream, "key", "at", "2 days", 3600), provider=J.ROCKSDB).collect()
    net = {}
    for r in changes:
        net[r.key, r.anchor] = net.get((r.key, r.anchor), 0) + r.change
    assert set(net.values()) <= {0, 1} and any(r.change < 0 for r in changes)
    assert sorted(a for a, n in net.items() if n) == [(k, t) for k in "abc" for t in plain_anchors(starts[k], 3600)]


def test_closed_sessions_keep_their_last_anchor(spark, tmp_path):
    """Starts leave the state once nothing can come before them; a start soon after the last anchor still opens nothing."""
    day, t0 = 86_400, 1_700_000_000
    folder = f"{tmp_path}/in"
    files(spark, folder, [[("a", t0), ("z", t0)], [("z", t0 + 30 * day)], [("z", t0 + 60 * day)], [("a", t0 + 60 * day + 100), ("a", t0 + 60 * day + 200)], [("a", t0 + 5)]], "key string, t long")
    stream = one_by_one(spark, folder, "key string, t long").withColumn("at", F.timestamp_seconds("t"))
    got = sorted((r.key, r.anchor, r.change) for r in J.drain(J.anchor_changes(stream, "key", "at", "1 day", 3600), provider=J.ROCKSDB).collect())
    assert got == [("a", t0, 1), ("a", t0 + 60 * day + 100, 1), ("z", t0, 1), ("z", t0 + 30 * day, 1), ("z", t0 + 60 * day, 1)]


SITEMAP = "drop long, pos long, url string, lastmod string"


def test_change_feed(spark, tmp_path):
    folder, name = f"{tmp_path}/in", f"feed-{random.Random().getrandbits(64):x}"
    run = lambda: sorted((r.url, r.lastmod, r.kind) for r in J.drain(J.changed_pages(one_by_one(spark, folder, SITEMAP)), name=name, provider=J.ROCKSDB).collect())
    files(spark, folder, [[(1, 0, "a", "1"), (1, 1, "b", None), (1, 2, "a", "2"), (1, 3, None, "9")]], SITEMAP)
    first = run()
    assert first == [("a", "2", "new"), ("b", "", "new")]
    files(spark, folder, [[(2, 0, "a", "2"), (2, 1, "b", "")]], SITEMAP)
    assert run() == first
    files(spark, folder, [[(3, 0, "a", "1"), (3, 1, "b", ""), (3, 2, "c", "5")]], SITEMAP)
    assert run() == sorted([*first, ("a", "1", "changed"), ("c", "5", "new")])


def test_versions_are_read_as_one_table(spark, tmp_path):
    folder = f"{tmp_path}/in"
    files(spark, folder, [[(i, i % 2 == 0)] for i in range(5)], "n long, over boolean")
    kept, late = J.split_late(one_by_one(spark, folder, "n long, over boolean"), F.col("over"))
    assert sorted(r.n for r in kept.collect()) == [1, 3] and sorted(r.n for r in late.collect()) == [0, 2, 4] and kept.columns == ["n", "over"]
    assert "Union" not in kept._jdf.queryExecution().analyzed().toString()


def state_rows(spark, name, **options):
    return spark.read.format("statestore").options(**options).load(f"{J.home_of(spark, name)}/state").count()


def test_keys_share_calls_and_state(spark, tmp_path):
    """A processor's call serves a group of keys: state has a row a group, not a row a key."""
    n, name = 3 * J.GROUPS, f"{random.Random().getrandbits(64):x}"
    spark.range(n).selectExpr("1L drop", "id pos", "concat('u', id) url", "cast(id % 3 as string) lastmod", "timestamp_seconds(1700000000 + id % 9) at").write.parquet(f"{tmp_path}/in")
    rows = one_by_one(spark, f"{tmp_path}/in", f"{SITEMAP}, at timestamp").drop("at")
    timed = one_by_one(spark, f"{tmp_path}/in", f"{SITEMAP}, at timestamp").select(F.col("url").alias("key"), "at")
    with_state = {"feed": J.changed_pages(rows), "anchors": J.anchor_changes(timed, "key", "at", "2 days"), "cache": J.live_cache(timed, "key", "at", "3 days")}
    counts = {k: J.drain(df, name=name + k, provider=None if k == "cache" else J.ROCKSDB).count() for k, df in with_state.items()}
    assert counts == {"feed": n, "anchors": n, "cache": 0}
    assert state_rows(spark, name + "feed", stateVarName="known") <= J.GROUPS and state_rows(spark, name + "anchors", stateVarName="known") <= J.GROUPS and state_rows(spark, name + "cache") <= J.GROUPS


def test_a_drop_is_one_batch_however_many_files(spark, tmp_path):
    from agendry.bound.streams import arrivals

    files(spark, f"{tmp_path}/in", [[(i,)] for i in range(4)], "n long")
    seen = []
    arrivals(spark, f"{tmp_path}/in", "n long").writeStream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda b, i: seen.append(b.count())).start().awaitTermination()
    assert seen == [4]


def test_large_part_is_written_by_several_tasks(spark, tmp_path):
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(200_000).selectExpr("'a' day", "xxhash64(id) k", "id n")
        parts.upsert(spark, f"file://{tmp_path}/table", rows, F.col("day"), parts.keep_least(["day", "k"], "n"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert len(list((tmp_path / "table" / "data").glob("*/_part=a/*.parquet"))) > 1 and parts.read(spark, f"file://{tmp_path}/table").count() == 200_000


def test_table_in_parts(spark, tmp_path):
    """A batch writes the parts that it touches; a repeated batch nothing; a late commit fails and is tried again on what is there."""
    home, schema = f"file://{tmp_path}/table", "day string, k long, n long"
    make = lambda *rows: spark.createDataFrame(list(rows), schema)
    put = lambda rows, number, job="j": parts.upsert(spark, home, rows, F.col("day"), parts.keep_least(["day", "k"], "n"), job, number)
    rows = lambda **kw: sorted(((r.day, r.k, r.n) for r in parts.read(spark, home, **kw).collect()), key=str)
    assert parts.read(spark, home) is None and put(make(), 0) == 0
    assert put(make(("a", 1, 5), ("b", 1, 5), ("b b/%", 2, 2), (None, 3, 3)), 1) == 1
    first = parts.manifest(spark, home)["parts"]
    assert set(first) == {"a", "b", "b b/%", "none"}
    assert put(make(("a", 1, 3), ("a", 2, 9), ("c", 1, 1)), 2) == 2 and put(make(("a", 1, 0)), 2) == 2
    second = parts.manifest(spark, home)["parts"]
    assert {p for p in first if second[p] == first[p]} == {"b", "b b/%", "none"} and second["a"] != first["a"]
    want = sorted([("a", 1, 3), ("a", 2, 9), ("b", 1, 5), ("b b/%", 2, 2), ("c", 1, 1), (None, 3, 3)], key=str)
    assert rows() == want and rows(parts=["c"]) == [("c", 1, 1)] and ("a", 1, 5) in rows(version=1)

    base = parts.manifest(spark, home)
    assert put(make(("b", 1, 4)), 1, "other") == 3
    with pytest.raises(parts.Conflict):
        parts.commit(spark, home, base, make(("a", 7, 7)), F.col("day"), ["a"])
    assert ("b", 1, 4) in rows() and ("a", 7, 7) not in rows()
    assert put(make(("a", 7, 7)), 2, "other") == 4 and {("b", 1, 4), ("a", 7, 7)} < set(rows())

    now = rows()
    held = lambda: len(list((tmp_path / "table" / "data").glob("*/_part=*")))
    assert held() == 8 and parts.expire(spark, home) == 3 and rows() == now and held() == 5
    assert put(make(("b", 1, 1)), 3, "other") == 5 and ("b", 1, 1) in rows()
