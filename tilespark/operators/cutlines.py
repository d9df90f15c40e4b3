"""Covers of polygons by scanlines.

A polygon's tiles are those that its edges pass and those whose middles are inside it. An
edge is dealt to the rows of tiles that it passes, and touches one span of tiles in each;
the line through the middles of a row crosses edges in places that, sorted, open and
close spans of tiles in turn, holes included. So the work is near the tiles on edges, the crossings and the
spans, whatever the polygons' areas are, and tiles are rows only where they are asked for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.functions.mercator import MAX_LAT

#: Rows of tiles, or tiles of a span, that are made at once.
STRETCH = 1 << 14


def read_cutlines(spark, path: str) -> DataFrame:
    """Rings of polygon features of a GeoJSON file: polygon (a number for each), ring (lon/lat points). Other geometry is an error."""
    rings = "array<array<array<double>>>"
    geometry = "struct<type: string, coordinates: string>"
    text = spark.read.text(path, wholetext=True)
    features = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.features"), f"array<struct<geometry: {geometry}>>")).alias("feature", "f"))
    kind, raw = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(raw, rings))).when(kind == "MultiPolygon", F.from_json(raw, f"array<{rings}>"))
    polygons = polygons.otherwise(F.raise_error(F.lit("a cutline must be polygons")).cast(f"array<{rings}>"))
    return features.select("feature", F.explode(polygons).alias("rings")).select(F.xxhash64("feature", F.to_json("rings")).alias("polygon"), F.explode("rings").alias("ring"))


def _world(point: Column) -> Column:
    """Projected place of a point, 0 to 1 each way, rows downwards."""
    sine = F.sin(F.radians(F.least(F.greatest(F.get(point, 1), F.lit(-MAX_LAT)), F.lit(MAX_LAT))))
    return F.struct(((F.get(point, 0) + 180) / 360).alias("x"), (0.5 - F.log((1 + sine) / (1 - sine)) / (4 * math.pi)).alias("y"))


def edges(cutlines: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Edges of rings (polygon, ring) at every zoom, in tiles: polygon, z, from the upper end (ax, ay) to the lower (bx, by)."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("ring") - 2), lambda i: F.struct(F.get("ring", i).alias("a"), F.get("ring", i + 1).alias("b")))
    ends = cutlines.where("size(ring) > 1").select("polygon", F.inline(pairs)).select("polygon", _world(F.col("a")).alias("a"), _world(F.col("b")).alias("b"))
    upper, n = F.col("a.y") <= F.col("b.y"), F.pow(F.lit(2.0), "z")
    ends = ends.select("polygon", F.when(upper, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(upper, F.col("b")).otherwise(F.col("a")).alias("b"))
    zooms = ends.withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    return zooms.select("polygon", "z", (F.col("a.x") * n).alias("ax"), (F.col("a.y") * n).alias("ay"), (F.col("b.x") * n).alias("bx"), (F.col("b.y") * n).alias("by"))


def _rows(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """``df`` with y from first to last; many rows of one edge are dealt out."""
    inside = lambda v: F.least(F.greatest(v, F.lit(0)), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("z")) - 1).cast("long")
    df = df.withColumn("_first", inside(first)).withColumn("_last", inside(last)).where(first <= last)
    ones = df.where(F.col("_last") - F.col("_first") < STRETCH).withColumn("y", F.explode(F.sequence("_first", "_last")))
    many = df.where(F.col("_last") - F.col("_first") >= STRETCH).withColumn("_from", F.explode(F.sequence(F.col("_first"), F.col("_last"), F.lit(STRETCH).cast("long")))).repartition("_from", "ax", "ay")
    many = many.withColumn("y", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + STRETCH - 1, F.col("_last"))))).drop("_from")
    return ones.unionByName(many).drop("_first", "_last")


def _x_at(y: Column) -> Column:
    """Where an edge is at a height, exactly its end's place at an end."""
    between = F.col("ax") + (y - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    return F.when(y <= F.col("ay"), F.col("ax")).when(y >= F.col("by"), F.col("bx")).otherwise(F.least(F.greatest(between, F.least("ax", "bx")), F.greatest("ax", "bx")))


def touched(edges: DataFrame) -> DataFrame:
    """Spans (z, y, x0, x1) of the tiles that an edge passes or touches, row by row."""
    rows = _rows(edges, F.ceil("ay") - 1, F.floor("by"))
    top, bottom = _x_at(F.col("y").cast("double")), _x_at(F.col("y") + 1.0)
    level = F.col("ay") == F.col("by")
    low, high = F.when(level, F.least("ax", "bx")).otherwise(F.least(top, bottom)), F.when(level, F.greatest("ax", "bx")).otherwise(F.greatest(top, bottom))
    return rows.select("z", "y", (F.ceil(low) - 1).alias("x0"), F.floor(high).alias("x1"))


def inner(edges: DataFrame) -> DataFrame:
    """Spans (z, y, x0, x1) of tiles whose middles are inside a polygon, by the even-odd rule."""
    crossed = _rows(edges, F.ceil(F.col("ay") - 0.5), F.ceil(F.col("by") - 0.5) - 1).select("polygon", "z", "y", _x_at(F.col("y") + 0.5).alias("c"))
    order = Window.partitionBy("polygon", "z", "y").orderBy("c")
    pairs = crossed.withColumn("i", F.row_number().over(order)).withColumn("d", F.lead("c").over(order)).where("i % 2 = 1 AND d IS NOT NULL")
    return pairs.select("z", "y", F.ceil(F.col("c") - 0.5).alias("x0"), (F.ceil(F.col("d") - 0.5) - 1).alias("x1")).where("x0 <= x1")


def cutline_spans(cutlines: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Disjoint spans (z, y, x0, x1, inclusive) of the tiles that touch any polygon of ``cutlines`` (polygon, ring).

    Spans that begin in one tile are one before they are sorted, so a row has no more of them than tiles, however many edges it has.
    """
    sides = edges(cutlines, min_zoom, max_zoom)
    right = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("z")) - 1
    drawn = lambda c: F.least(F.greatest(F.col(c), F.lit(0)), right).cast("long").alias(c)
    spans = touched(sides).unionAll(inner(sides)).where((F.col("x1") >= 0) & (F.col("x0") <= right)).select("z", "y", drawn("x0"), drawn("x1"))
    spans = spans.groupBy("z", "y", "x0").agg(F.max("x1").alias("x1"))
    order = Window.partitionBy("z", "y").orderBy("x0")
    reach = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("begins", F.coalesce(F.col("x0") > reach + 1, F.lit(True)).cast("long")).withColumn("island", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("z", "y", "island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("island")


def cutline_cover(cutlines: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Distinct tiles (z, x, y) that touch a polygon of ``cutlines`` (as ``read_cutlines`` gives them)."""
    parts = cutline_spans(cutlines, min_zoom, max_zoom).withColumn("_from", F.explode(F.sequence(F.col("x0"), F.col("x1"), F.lit(STRETCH).cast("long"))))
    return parts.select("z", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + STRETCH - 1, F.col("x1")))).alias("x"), "y")
