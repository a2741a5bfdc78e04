"""Catalogue views over the driver's tables: venues, events and their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from agendry import constants as C
from agendry.functions.dates import EPOCH

SOURCES = [*C.TRUST, "other"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_at(n) -> F.Column:
    return F.element_at(F.array(*[F.lit(s) for s in SOURCES]), (n % 8).cast("int") + 1)


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, city, district, lat, lng, scope. Nations and regions are dimensions of fixed size."""
    places = read(spark, sf_dir, "nation").join(F.broadcast(read(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(
        s.alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("city"), F.col("r_name").alias("district"),
        F.when(s % 7 != 0, F.lit(39.0) + (s % 100) / F.lit(100.0)).alias("lat"), (F.lit(-9.0) + (s % 50) / F.lit(100.0)).alias("lng"),
        F.when(s % 10 == 0, "concelho").when(s % 10 == 1, "lugar").otherwise("venue").alias("scope"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, title, start_at, end_at, venue_id, date_text, categories, source, source_event_id."""
    e = F.col("event_id")
    start = F.timestamp_diff("SECOND", F.expr(EPOCH), F.col("ts"))
    k = F.get_json_object("props", "$.k").cast("int") % 10
    return read(spark, sf_dir, "events").select(
        e.alias("id"), F.col("event_type").alias("title"), start.alias("start_at"),
        F.when(e % 5 == 0, start + F.floor(F.col("value") * 3600).cast("bigint")).alias("end_at"), F.col("user_id").alias("venue_id"),
        F.when(e % 50 == 0, "TBA").alias("date_text"), F.array(F.col("event_type"), F.concat(F.lit("k"), k.cast("string"))).alias("categories"),
        source_at(e).alias("source"), F.when(e % 4 != 0, F.concat(F.lit("i"), F.floor(e / 3).cast("string"))).alias("source_event_id"),
    )


def event_sources(events: DataFrame) -> DataFrame:
    """event_id, source, source_event_id: one to three attributions of each event."""
    each = events.select("id", "source_event_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("id") % 3)).alias("k"))
    return each.select(F.col("id").alias("event_id"), source_at(F.col("id") + F.col("k")).alias("source"), "source_event_id")
