"""A table in parts that batches change by copy on write: only the parts that a batch touches are written again.

A table is a folder of manifests and data. Manifest n names the files of each part (a day, say) at version n and the last batch of each
job that is in it. A writer reads the parts that its rows fall in, writes them anew beside the old ones, and commits by
renaming a manifest to the next number, which fails if another writer was first; it then starts again from what that one
left. Readers of a version never see half a batch, a batch that runs twice changes nothing, and bytes written
grow with the parts touched. Old versions stay until expire() drops them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Commits that a writer tries before it gives up.
TRIES = 20


class Conflict(RuntimeError):
    """Another writer committed the version first."""


def _fs(spark: SparkSession, home: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(home)
    return hadoop, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, home: str) -> list[int]:
    hadoop, fs = _fs(spark, home)
    path = hadoop.Path(home)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))


def manifest(spark: SparkSession, home: str, version: int | None = None) -> dict:
    """A version's manifest, the newest by default; of no version yet, an empty one."""
    known = _versions(spark, home)
    if not known:
        return {"version": 0, "parts": {}, "jobs": {}, "schema": None}
    path = f"{home}/manifest-{(version or known[-1]):010d}.json"
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def read(spark: SparkSession, home: str, parts: list[str] | None = None, version: int | None = None) -> DataFrame | None:
    """The rows of a version, of some parts or of all; None if there is no version."""
    held = manifest(spark, home, version)
    if held["schema"] is None:
        return None
    schema = StructType.fromJson(held["schema"])
    paths = [f"{home}/{p}" for part, p in held["parts"].items() if parts is None or part in set(parts)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def commit(spark: SparkSession, home: str, base: dict, rows: DataFrame, part: Column, touched: list[str], job: str | None = None, batch: int | None = None) -> int:
    """Put ``rows`` in place of the touched parts of version ``base`` and give the new version; raises Conflict if there is one already."""
    hadoop, fs = _fs(spark, home)
    own = f"data/{uuid.uuid4().hex}"
    # Rows of a part lie together, and a part beyond the session's advisory size is split over tasks, so parts are few files and no task writes a large one whole.
    rows.withColumn("_part", part).hint("rebalance", F.col("_part")).write.partitionBy("_part").parquet(f"{home}/{own}")
    written = {s.getPath().getName() for s in fs.listStatus(hadoop.Path(f"{home}/{own}")) if s.isDirectory()}
    named = lambda p: spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("_part", p)
    left = {p: path for p, path in base["parts"].items() if p not in set(touched)}
    new = {p: f"{own}/{named(p)}" for p in touched if named(p) in written}
    version = base["version"] + 1
    held = {"version": version, "parts": left | new, "jobs": base["jobs"] | ({job: batch} if job else {}), "schema": rows.schema.jsonValue()}
    draft = hadoop.Path(f"{home}/{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(json.dumps(held).encode())
    out.close()
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(draft, hadoop.Path(f"{home}/manifest-{version:010d}.json"), none)
    except Exception as e:
        fs.delete(draft, False)
        fs.delete(hadoop.Path(f"{home}/{own}"), True)
        if "FileAlreadyExists" in str(e):
            raise Conflict(f"version {version} is there already") from e
        raise
    return version


def upsert(spark: SparkSession, home: str, rows: DataFrame, part: Column, merge: Callable[[DataFrame, DataFrame], DataFrame], job: str | None = None, batch: int | None = None) -> int:
    """Merge ``rows`` into the parts that they fall in; gives the table's version.

    ``merge`` takes a part's old rows and the new ones, and must keep rows in their part. ``part`` is a string of the row's
    own columns, null for a part of its own. A batch of a job that is in the table already changes nothing. Only the
    names of the parts touched come to the driver.
    """
    for _ in range(TRIES):
        base = manifest(spark, home)
        if job is not None and base["jobs"].get(job, -1) >= batch:
            return base["version"]
        whole = F.coalesce(part, F.lit("none"))
        touched = [r[0] for r in rows.select(whole).distinct().collect()]
        if not touched:
            return base["version"]
        old = read(spark, home, touched) if base["schema"] else rows.limit(0)
        try:
            return commit(spark, home, base, merge(old, rows), whole, touched, job, batch)
        except Conflict:
            continue
    raise Conflict(f"{TRIES} commits were all late")


def expire(spark: SparkSession, home: str, keep: int = 1) -> int:
    """Drop all but the newest ``keep`` versions and the parts that no version left names; gives the number of parts dropped.

    Writers that are at work on an older version fail to commit; readers of a version dropped fail as well.
    """
    hadoop, fs = _fs(spark, home)
    known = _versions(spark, home)
    used = {p for v in known[-keep:] for p in manifest(spark, home, v)["parts"].values()}
    for v in known[:-keep]:
        fs.delete(hadoop.Path(f"{home}/manifest-{v:010d}.json"), False)
    dropped = 0
    for batch in fs.listStatus(hadoop.Path(f"{home}/data")) if known else []:
        held = [s.getPath() for s in fs.listStatus(batch.getPath()) if s.isDirectory()]
        stale = [p for p in held if f"data/{batch.getPath().getName()}/{p.getName()}" not in used]
        for path in stale if len(stale) < len(held) else [batch.getPath()]:
            fs.delete(path, True)
        dropped += len(stale)
    return dropped


def keep_least(keys: list[str], order: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps the least ``order`` of each key."""
    return lambda old, new: old.unionByName(new).groupBy(*keys).agg(F.min(order).alias(order))
