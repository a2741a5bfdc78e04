"""Connected components over an edge table (alternating large-star and small-star rounds)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from agendry.runtime import cut, forget


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star then one small-star round; edges are (a, b) with a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.where("a > m").select("a", F.col("m").alias("b"))).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    hung = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, materialised, and what tells whether a round changed them, gathered in the same job."""
    seen = Observation()
    total = F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))
    out = cut(edges.observe(seen, F.count(F.lit(1)).alias("n"), total.alias("total")))
    return out, (seen.get["n"], seen.get["total"])


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node that has an edge, with the least node it can reach.

    Self-loops and repeated edges are allowed; rows with a null end are ignored. A node whose only
    edges are self-loops is its own component. An edge never leaves its component, and each round
    shortens paths by a constant factor, so the number of rounds is logarithmic in the diameter.
    Hubs stay cheap: minima combine before the shuffle and the joins can be split by AQE.
    """
    pairs = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).where("x is not null and y is not null")
    # Loops are kept apart only after this, else the edges would be made a second time for them.
    every, before = _settled(pairs.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    loops, now = every.where("a = b").select(F.col("a").alias("node")), every.where("a <> b")
    for n in range(max_rounds):
        if before[0] == 0:
            break
        last = now
        now, after = _settled(_stars(last))
        if n:
            forget(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
    return found.union(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
