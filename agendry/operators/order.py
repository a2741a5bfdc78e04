"""Positions in ordered groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from agendry.runtime import cut


def positions(rows: DataFrame, group: str, *order: str, name: str = "position") -> DataFrame:
    """``rows`` with each one's place in its group, from 1 on, by rising ``order``; nulls come first.

    Rows are dealt by ranges of group and order and sorted where they lie, so no task holds a whole group. A place is
    the row's place in its range plus the rows of its group in the ranges before; for that there is one count for
    each group and range. Rows that agree in group and order get places in any order; ``order`` should hold a key.
    """
    keys = [group, *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = cut(dealt.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    per_range = held.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_low"))
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_range.select(F.col(group).alias("_g"), F.col("_range").alias("_r"), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + 1 - F.col("_low")).alias("_shift"))
    met = held.join(offset, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_r")))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("_at") + F.col("_shift")).alias(name))
