"""The registered queries of the catalogue engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from agendry import registry
from agendry.bound import agenda, catalogue, entities, extraction, ingest, packs, rules, streams, texts  # noqa: F401  importing lists their queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconcile the events and list the survivors of the agenda's window in order."""
    kept = entities.survivors(spark, sf_dir)
    return kept.where((kept.start_at >= agenda.FROM) & (kept.start_at <= agenda.TO)).orderBy("start_at", "id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
