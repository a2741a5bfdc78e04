"""Point in polygon: even-odd ray casts over all rings, after a join by bounding boxes or by the cells of a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SHAPES = "name string, ord int, polygons array<array<array<struct<x:double,y:double>>>>"


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Edges of the ring (closed by its first point) that a ray to the right crosses are odd in number."""
    shifted = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, F.lit(1), F.lit(1)))
    crosses = lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
    hits = F.zip_with(ring, shifted, lambda a, b: F.when(a["y"] == b["y"], F.lit(False)).otherwise(crosses(a, b)))
    return F.size(F.filter(hits, lambda h: h)) % 2 == 1


def inside(x: Column, y: Column, polygons: Column) -> Column:
    """Even-odd over all rings of a polygon, so holes are out; any polygon of a shape counts."""
    return F.exists(polygons, lambda rings: F.size(F.filter(rings, lambda ring: inside_ring(x, y, ring))) % 2 == 1)


def boxes(shapes: DataFrame) -> DataFrame:
    points = F.flatten(F.flatten("polygons"))
    low = lambda axis: F.array_min(F.transform(points, lambda p: p[axis]))
    high = lambda axis: F.array_max(F.transform(points, lambda p: p[axis]))
    return shapes.withColumns({"min_x": low("x"), "max_x": high("x"), "min_y": low("y"), "max_y": high("y")})


def locate(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """(id, shape): the first shape in their order that holds each point (id, x, y), or null.

    Shapes are a curated dimension of known size and are broadcast.
    """
    boxed = F.broadcast(boxes(shapes))
    near = (F.col("x") >= F.col("min_x")) & (F.col("x") <= F.col("max_x")) & (F.col("y") >= F.col("min_y")) & (F.col("y") <= F.col("max_y"))
    hit = points.join(boxed, near, "left").withColumn("hit", F.when(inside(F.col("x"), F.col("y"), F.col("polygons")), F.struct("ord", "name")))
    return hit.groupBy("id").agg(F.min("hit").alias("h")).select("id", F.col("h.name").alias("shape"))


def cells(shapes: DataFrame, size: float) -> DataFrame:
    """(cx, cy, ord, name, border): the cells of a grid that shapes cover, and whether an edge may run through them.

    Cells in an edge's box are border cells. In any other cell all points lie on the same side, so its middle
    decides; cells outside are left out.
    """
    cell = lambda v: F.floor(v / size)
    span = lambda low, high: F.sequence(cell(low), cell(high))
    rings = shapes.select("ord", F.explode(F.flatten("polygons")).alias("ring"))
    ends = F.concat(F.slice("ring", F.lit(2), F.size("ring")), F.slice("ring", F.lit(1), F.lit(1)))
    edges = rings.select("ord", F.explode(F.arrays_zip(F.col("ring").alias("a"), ends.alias("b"))).alias("e")).select("ord", *[F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"])
    crossed = edges.select("ord", F.explode(span(F.least("ax", "bx"), F.greatest("ax", "bx"))).alias("cx"), "ay", "by").select("ord", "cx", F.explode(span(F.least("ay", "by"), F.greatest("ay", "by"))).alias("cy")).distinct()
    boxed = boxes(shapes).select("ord", "name", "polygons", "min_y", "max_y", F.explode(span(F.col("min_x"), F.col("max_x"))).alias("cx"))
    every = boxed.select("ord", "name", "polygons", "cx", F.explode(span(F.col("min_y"), F.col("max_y"))).alias("cy")).join(crossed.withColumn("border", F.lit(True)), ["ord", "cx", "cy"], "left")
    middle = lambda c: (F.col(c) + 0.5) * size
    return every.where(F.col("border") | inside(middle("cx"), middle("cy"), F.col("polygons"))).select("cx", "cy", "ord", "name", F.coalesce("border", F.lit(False)).alias("border"))


def locate_by_grid(points: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """locate() for shapes of any number: points and cells of ``size`` meet by equal cells, and only points of border cells are cast.

    Nothing is broadcast by hint and no join compares ranges. Points without a coordinate lie in no shape.
    """
    placed = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    met = placed.join(cells(shapes, size), ["cx", "cy"])
    sure = met.where("not border").select("id", "ord", "name")
    cast = met.where("border").select("id", "x", "y", "ord", "name").join(shapes.select("ord", "polygons"), "ord").where(inside(F.col("x"), F.col("y"), F.col("polygons"))).select("id", "ord", "name")
    first = sure.union(cast).groupBy("id").agg(F.min(F.struct("ord", "name")).alias("h"))
    return points.select("id").join(first, "id", "left").select("id", F.col("h.name").alias("shape"))
