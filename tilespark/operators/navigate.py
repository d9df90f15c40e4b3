"""Parents, children, neighbours, boxes and outlines of tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions.hilbert import MAX_ZOOM, is_address, try_zxy
from tilespark.functions.mercator import tile_bounds, tile_centre
from tilespark.operators.cover import tile_rectangles


def parent(tiles: DataFrame) -> DataFrame:
    """``tiles`` (z, x, y) with struct parent; null at zoom 0."""
    up = F.struct((F.col("z") - 1).alias("z"), F.floor(F.col("x") / 2).alias("x"), F.floor(F.col("y") / 2).alias("y"))
    return tiles.withColumn("parent", F.when(F.col("z") > 0, up))


def children(tiles: DataFrame) -> DataFrame:
    """The four tiles below each: child_z, child_x, child_y; none below the deepest zoom."""
    corners = F.array(*[F.struct((F.col("z") + 1).alias("child_z"), (F.col("x") * 2 + dx).alias("child_x"), (F.col("y") * 2 + dy).alias("child_y")) for dy in (0, 1) for dx in (0, 1)])
    return tiles.where(F.col("z") < MAX_ZOOM).select("*", F.inline(corners))


def neighbours(tiles: DataFrame) -> DataFrame:
    """Up to eight tiles around each: near_x, near_y; none beyond the edges."""
    around = F.array(*[F.struct((F.col("x") + dx).alias("near_x"), (F.col("y") + dy).alias("near_y")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy])
    return tiles.select("*", F.inline(around)).where(is_address("z", "near_x", "near_y"))


def bbox_cover(boxes: DataFrame, min_zoom: int, max_zoom: int, most: int = 1 << 14) -> DataFrame:
    """``boxes`` (west, south, east, north) and the tiles (z, x, y) that each covers at each zoom, one row a tile.

    Columns of tiles are made first and dealt out, in stretches of at most ``most``
    rows, so that a world at a deep zoom is many tasks' work. ``cover.box_intervals`` gives the same tiles
    as intervals.
    """
    columns = tile_rectangles(boxes, min_zoom, max_zoom).withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("_y", F.explode(F.sequence(F.col("y0"), F.col("y1"), F.lit(most).cast("long"))))
    rows = columns.repartition("z", "x", "_y").withColumn("y", F.explode(F.sequence(F.col("_y"), F.least(F.col("_y") + most - 1, F.col("y1")))))
    return rows.select(*boxes.columns, "z", "x", "y")


def entry_lines(entries: DataFrame, stretch: int = 1024) -> DataFrame:
    """Outlines of entries: the box of a single tile; for a run, a line through its tiles' middles in order.

    A long run is several rows, ``stretch`` tiles each, numbered by ``part``, which are dealt out.
    """
    parts = F.when(F.col("run_length") > 0, F.sequence(F.lit(0), F.floor((F.col("run_length") - 1) / stretch).cast("int"))).otherwise(F.array(F.lit(0)))
    rows = entries.withColumn("part", F.explode(parts)).repartition("tile_id", "part")
    first = F.col("tile_id") + F.col("part").cast("long") * stretch
    count = F.least(F.col("run_length") - F.col("part").cast("long") * stretch, F.lit(stretch).cast("long"))
    middle = lambda i: F.get(F.transform(F.array(try_zxy(i)), lambda t: tile_centre(t["z"], t["x"], t["y"])), 0)
    middles = F.transform(F.sequence(first, first + count - 1), middle)
    box = F.get(F.transform(F.array(try_zxy("tile_id")), lambda t: tile_bounds(t["z"], t["x"], t["y"])), 0)
    return rows.select("*", F.when(F.col("run_length") == 1, box).alias("box"), F.when(F.col("run_length") > 1, middles).alias("line"))
