"""Covers of boxes as intervals of tile ids.

The tiles of a box at one zoom are few intervals of the Hilbert curve: about a
quarter of the tiles on its edge, where the box itself has as many as its area.
``box_intervals`` finds them by quadtree descent. A cell inside the box is an interval, a cell outside is
none, and only cells on the edge are parted, all cells of a level at once. A box with a very
long edge is parted down to cells of ``CELL`` tiles a side first, which are dealt out.

``interval_union`` merges overlapping intervals of any number of covers in a sweep over id
ranges; how many tiles a cover has is then a sum, and no tile is ever a row
before ``tiles_of``.

``box_union`` merges all boxes of one table without the intervals of each: boxes are drawn into blocks
of tiles at the deepest zoom, where equal and overlapping ones cost no more rows, and a tile at a zoom
above is covered if one below it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.functions.hilbert import LEVEL_STARTS, _encode, bulk_zxy, turns, zoom_of
from tilespark.functions.mercator import clamp_bounds, lonlat_to_tile
from tilespark.operators.build import expanded
from tilespark.shared import settle

#: Tiles on the edge of a box that one task parts whole, and the side of the cells that larger ones are dealt as (a power of two).
EDGE, CELL = 1 << 15, 1 << 12
#: Tiles on edges that are worked on at once.
AT_ONCE = 1 << 18
#: Side (as a power of two) of the blocks of tiles in which a union is drawn, and as how many of them a box is drawn at most.
BLOCK, BLOCKS = 8, 64
#: Boxes narrower or lower than so many degrees may have tiles at some zooms and none below them.
THIN = 1e-6
_RECTANGLE = ("z", "x0", "x1", "y0", "y1")
_CELL = ("level", "cx", "cy", "at", "turned")
#: By orientation and digit: the column and row bits of a child, and its orientation.
_BITS, _TURNED = (np.array([[next(t[i] for t in turns() if t[0] == flags and t[2] == digit) for digit in range(4)] for flags in range(4)], np.int64) for i in (1, 3))


def tile_rectangles(boxes: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """``boxes`` (west, south, east, north) as rectangles of tiles (z, x0, x1, y0, y1), inclusive, at each zoom.

    A box whose east is west of its west crosses the antimeridian: it is two rectangles where these
    have no column in common, else one of all columns. What lies beyond the projection is
    drawn in; a box without width or height on an edge of tiles, or with its north south of its south, has none.
    """
    edge = 1e-11
    zooms = boxes.withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    inside = zooms.withColumn("_in", clamp_bounds("west", "south", "east", "north")).withColumn("_crosses", F.col("east") < F.col("west"))
    first = lonlat_to_tile(F.col("_in.west"), F.col("_in.north"), "z")
    last = lonlat_to_tile(F.col("_in.east") - edge, F.col("_in.south") + edge, "z")
    corners = inside.withColumn("_a", first).withColumn("_b", last).where("_a.y <= _b.y AND (_crosses OR _a.x <= _b.x)")
    right = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("z")) - 1
    rectangle = lambda x0, x1: F.struct(x0.cast("long").alias("x0"), x1.cast("long").alias("x1"))
    halves = F.array(rectangle(F.lit(0), F.col("_b.x")), rectangle(F.col("_a.x"), right))
    across = F.when(F.col("_b.x") >= F.col("_a.x"), F.array(rectangle(F.lit(0), right))).otherwise(halves)
    columns = F.when(F.col("_crosses"), across).otherwise(F.array(rectangle(F.col("_a.x"), F.col("_b.x"))))
    rows = corners.withColumn("_x", F.explode(columns))
    return rows.select(*boxes.columns, "z", "_x.x0", "_x.x1", F.col("_a.y").alias("y0"), F.col("_b.y").alias("y1"))


def _parted(rectangles: dict[str, np.ndarray], cells: dict[str, np.ndarray], stop: int) -> tuple[list, list]:
    """Intervals (owner, first, end) of rectangles below their cells, and what is still open at cells of ``stop`` tiles a side (as a power of two)."""
    starts = np.array(LEVEL_STARTS, np.int64)
    owner = np.arange(len(cells["level"]))
    level, cx, cy, at, turned = (cells[c].astype(np.int64) for c in _CELL)
    done, still = [], []
    while len(owner):
        z, x0, x1, y0, y1 = (rectangles[c][owner] for c in _RECTANGLE)
        down = z - level
        left, top, side = cx << down, cy << down, np.left_shift(1, down)
        within = (x0 <= left) & (left + side - 1 <= x1) & (y0 <= top) & (top + side - 1 <= y1)
        apart = (left > x1) | (left + side - 1 < x0) | (top > y1) | (top + side - 1 < y0)
        first = starts[z[within]] + (at[within] << 2 * down[within])
        done.append((owner[within], first, first + (np.left_shift(1, 2 * down[within]))))
        partly = ~within & ~apart
        if stop:
            wait = partly & (down <= stop)
            still.append((owner[wait], level[wait], cx[wait], cy[wait], at[wait], turned[wait]))
            partly &= ~wait
        owner, level, cx, cy, at, turned = (np.repeat(a[partly], 4) for a in (owner, level, cx, cy, at, turned))
        digit = np.tile(np.arange(4), len(owner) // 4)
        bits = _BITS[turned, digit]
        level, cx, cy, at, turned = level + 1, 2 * cx + (bits >> 1), 2 * cy + (bits & 1), 4 * at + digit, _TURNED[turned, digit]
    return done, still


def _joined(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals in order, those of an owner that touch as one."""
    owner, first, end = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((first, owner))
    owner, first, end = owner[order], first[order], end[order]
    begins = np.ones(len(owner), bool)
    begins[1:] = (owner[1:] != owner[:-1]) | (first[1:] != end[:-1])
    last = np.append(np.flatnonzero(begins)[1:] - 1, len(owner) - 1) if len(owner) else np.zeros(0, np.int64)
    return owner[begins], first[begins], end[last]


def _descended(batches: Iterator[pa.RecordBatch], columns: list[str], stop: int, begun: bool) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        rectangles = {c: batch.column(c).to_numpy().astype(np.int64) for c in _RECTANGLE}
        cells = {c: batch.column(c).to_numpy() if begun else np.zeros(batch.num_rows, np.int64) for c in _CELL}
        edge = np.minimum(rectangles["x1"] - rectangles["x0"] + rectangles["y1"] - rectangles["y0"] + 2, 2 * CELL if begun else 1 << 62)
        chunk = np.cumsum(edge) // AT_ONCE
        for places in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(chunk)) + 1):
            done, still = _parted({c: a[places] for c, a in rectangles.items()}, {c: a[places] for c, a in cells.items()}, stop)
            owner, first, end = _joined(done)
            own = lambda who, names, places=places: [batch.column(c).take(pa.array(places[who])) for c in names]
            if not stop:
                yield pa.RecordBatch.from_arrays([*own(owner, [*columns, "z"]), pa.array(first), pa.array(end)], [*columns, "z", "first_id", "end_id"])
                continue
            # intervals go on as cells that lie within their rectangle: one kind of row is dealt out
            who, *cell = (np.concatenate(c) for c in zip(*still))
            none = pa.nulls(len(owner), pa.int64())
            names = [*columns, *_RECTANGLE]
            fields = [*_CELL, "first_id", "end_id"]
            yield pa.RecordBatch.from_arrays([*own(owner, names), *[none] * 5, pa.array(first), pa.array(end)], [*names, *fields])
            yield pa.RecordBatch.from_arrays([*own(who, names), *map(pa.array, cell), *[pa.nulls(len(who), pa.int64())] * 2], [*names, *fields])


def _finished(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        known = batch.column("level").is_null().to_numpy(zero_copy_only=False)
        names = [*columns, "z", "first_id", "end_id"]
        yield batch.take(pa.array(np.flatnonzero(known))).select(names)
        yield from _descended(iter([batch.take(pa.array(np.flatnonzero(~known)))]), columns, 0, True)


def box_intervals(boxes: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """``boxes`` (west, south, east, north) with z and the intervals first_id to end_id (exclusive) of the tiles that each covers at each zoom.

    The intervals of a box do not overlap; equal boxes are boxes of their own.
    """
    columns = boxes.columns
    rectangles = tile_rectangles(boxes, min_zoom, max_zoom)
    edge = F.col("x1") - F.col("x0") + F.col("y1") - F.col("y0") + 2
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in boxes.schema)
    out = f"{plain}, z int, first_id long, end_id long"
    cells = f"{plain}, z int, x0 long, x1 long, y0 long, y1 long, level long, cx long, cy long, at long, turned long, first_id long, end_id long"
    small = rectangles.where(edge <= EDGE).mapInArrow(partial(_descended, columns=columns, stop=0, begun=False), out)
    large = rectangles.where(edge > EDGE).mapInArrow(partial(_descended, columns=columns, stop=CELL.bit_length() - 1, begun=False), cells)
    dealt = large.repartition(int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return small.unionAll(dealt.mapInArrow(partial(_finished, columns=columns), out))


def _merged(batches: Iterator[pa.RecordBatch], sort: bool) -> Iterable[pa.RecordBatch]:
    """Overlapping and touching intervals of one zoom as one; ``sort``: of each batch alone, before a shuffle."""
    held: tuple[int, int] | None = None  # an id where a zoom begins begins an interval

    def made(first: list, end: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(end, pa.int64())], ["first_id", "end_id"])

    for batch in batches:
        first, end = (batch.column(c).to_numpy() for c in ("first_id", "end_id"))
        if not len(first):
            continue
        if sort:
            order = np.argsort(first, kind="stable")
            first, end, held = first[order], end[order], None
        if held:
            first, end = np.append(held[0], first), np.append(held[1], end)
        reach = np.maximum.accumulate(end)
        begins = np.flatnonzero(np.append(True, (first[1:] > reach[:-1]) | (first[1:] == reach[:-1]) & np.isin(first[1:], LEVEL_STARTS)))
        ends = reach[np.append(begins[1:] - 1, len(first) - 1)]
        held = (int(first[begins[-1]]), int(ends[-1]))
        yield made(first[begins[:-1]], ends[:-1])
        if sort:
            yield made([held[0]], [held[1]])
    if held and not sort:
        yield made([held[0]], [held[1]])


def interval_union(*covers: DataFrame) -> DataFrame:
    """Disjoint intervals (first_id, end_id) of the tiles in any of the covers.

    Each task merges what it has, intervals are dealt into ranges of their first id and merged
    there, and what an earlier range reaches over a seam is cut off, by one number a range; so
    intervals that only touch at a seam stay two.
    """
    rows = covers[0].select("first_id", "end_id")
    for cover in covers[1:]:
        rows = rows.unionAll(cover.select("first_id", "end_id"))
    pair = "first_id long, end_id long"
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.where("first_id < end_id").mapInArrow(partial(_merged, sort=True), pair)
    ranged = rows.repartitionByRange(ranges, "first_id").sortWithinPartitions("first_id").mapInArrow(partial(_merged, sort=False), pair)
    ranged = settle(ranged.withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    reach = ranged.groupBy("range").agg(F.max("end_id").alias("reach")).select("range", F.coalesce(F.max("reach").over(before), F.lit(0)).alias("reach"))
    cut = ranged.join(F.broadcast(reach), "range").select(F.greatest("first_id", "reach").alias("first_id"), "end_id")
    return cut.where("first_id < end_id")


def _above(first: np.ndarray, end: np.ndarray, zoom: int, min_zoom: int) -> Iterable[pa.RecordBatch]:
    """Intervals of a zoom, disjoint and in order, and those of the tiles over them at the zooms down to ``min_zoom``."""
    first, end = first - LEVEL_STARTS[zoom], end - LEVEL_STARTS[zoom]
    for z in range(zoom, min_zoom - 1, -1):
        if z < zoom:
            first, end = first >> 2, ((end - 1) >> 2) + 1
        if not len(first):
            return
        begins = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
        first, end = first[begins], end[np.append(begins[1:] - 1, len(end) - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(first + LEVEL_STARTS[z]), pa.array(end + LEVEL_STARTS[z])], ["first_id", "end_id"])


def _drawn(batches: Iterator[pa.RecordBatch], zoom: int, min_zoom: int) -> Iterable[pa.RecordBatch]:
    """Intervals of what rectangles (bx, by, salt; x0, x1, y0, y1 in their block) cover; those of a block and salt arrive one after the other."""
    side = 1 << min(BLOCK, zoom)
    wide = side + 1
    orders: dict[tuple, np.ndarray] = {}
    held, drawn = None, np.zeros(wide * wide, np.int64)

    def tiles(block: tuple, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return _encode(np.full(len(x), zoom, np.int64), block[0] * side + x, block[1] * side + y)

    def made() -> Iterable[pa.RecordBatch]:
        # how the curve runs through a block follows from its corners
        corners = tiles(held, np.array([0, side - 1, 0, side - 1]), np.array([0, 0, side - 1, side - 1]))
        start = int(corners.min())
        kind = tuple((corners - start).tolist())
        if kind not in orders:
            y, x = np.divmod(np.arange(side * side), side)
            orders[kind] = np.argsort(tiles(held, x, y))
        covered = (drawn.reshape(wide, wide).cumsum(0).cumsum(1)[:side, :side] > 0).ravel()[orders[kind]]
        turns_ = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
        yield from _above(start + turns_[::2], start + turns_[1::2], zoom, min_zoom)

    for batch in batches:
        bx, by, salt, x0, x1, y0, y1 = (batch.column(c).to_numpy().astype(np.int64) for c in ("bx", "by", "salt", "x0", "x1", "y0", "y1"))
        changes = np.flatnonzero((np.diff(bx) != 0) | (np.diff(by) != 0) | (np.diff(salt) != 0)) + 1
        for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(bx)]):
            if a == b:
                continue
            own = (int(bx[a]), int(by[a]), int(salt[a]))
            if held is not None and own != held:
                yield from made()
                drawn[:] = 0
            held = own
            for sign, x, y in ((1, x0, y0), (-1, x1 + 1, y0), (-1, x0, y1 + 1), (1, x1 + 1, y1 + 1)):
                if b - a < wide:
                    np.add.at(drawn, y[a:b] * wide + x[a:b], sign)
                else:
                    drawn += sign * np.bincount(y[a:b] * wide + x[a:b], minlength=wide * wide)
    if held is not None:
        yield from made()


def _lifted(batches: Iterator[pa.RecordBatch], zoom: int, min_zoom: int) -> Iterable[pa.RecordBatch]:
    """Intervals of one zoom in any order, merged batch by batch, with those of the tiles over them."""
    for merged in _merged(batches, True):
        if merged.num_rows:
            yield from _above(merged.column("first_id").to_numpy(), merged.column("end_id").to_numpy(), zoom, min_zoom)


def box_union(boxes: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Disjoint intervals of the tiles that any of ``boxes`` covers: as ``interval_union`` of ``box_intervals``, but found at the deepest zoom.

    Boxes of very many blocks are intervals there at once. Thin ones, which a zoom may have and the next may not, are intervals at all zooms.
    """
    boxes = boxes.select("west", "south", "east", "north")
    inside = clamp_bounds("west", "south", "east", "north")
    thin = F.coalesce((inside["north"] - inside["south"] < THIN) | (F.col("east") >= F.col("west")) & (inside["east"] - inside["west"] < THIN), F.lit(True))
    rest = boxes.where(~thin)
    k, pair = min(BLOCK, max_zoom), "first_id long, end_id long"
    left, right, top, bottom = (F.shiftright(F.col(c), k) for c in ("x0", "x1", "y0", "y1"))
    many = (right - left + 1) * (bottom - top + 1) > BLOCKS
    rectangles = tile_rectangles(rest, max_zoom, max_zoom)
    blocks = rectangles.where(~many).withColumn("bx", F.explode(F.sequence(left, right))).withColumn("by", F.explode(F.sequence(top, bottom)))
    within = lambda c, b: F.greatest(F.lit(0), F.least(F.lit((1 << k) - 1), F.col(c) - F.shiftleft(F.col(b), k))).cast("int").alias(c)
    # where the blocks are few, each is drawn in several tasks
    salts = max(1, 64 >> 2 * max(0, max_zoom - BLOCK))
    salt = F.pmod(F.xxhash64("x0", "x1", "y0", "y1"), F.lit(salts)).cast("int").alias("salt")
    dealt = blocks.select("bx", "by", salt, within("x0", "bx"), within("x1", "bx"), within("y0", "by"), within("y1", "by"))
    ranges = int(boxes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(ranges, "bx", "by", "salt").sortWithinPartitions("bx", "by", "salt")
    drawn = dealt.mapInArrow(partial(_drawn, zoom=max_zoom, min_zoom=min_zoom), pair)
    wide = rectangles.where(many).select("west", "south", "east", "north").distinct()
    lifted = box_intervals(wide, max_zoom, max_zoom).select("first_id", "end_id").mapInArrow(partial(_lifted, zoom=max_zoom, min_zoom=min_zoom), pair)
    return interval_union(drawn, lifted, box_intervals(boxes.where(thin), min_zoom, max_zoom))


def tile_counts(intervals: DataFrame) -> DataFrame:
    """z and the number of tiles of disjoint intervals."""
    return intervals.groupBy(zoom_of("first_id").alias("z")).agg(F.sum(F.col("end_id") - F.col("first_id")).alias("tiles"))


def tiles_of(intervals: DataFrame) -> DataFrame:
    """(tile_id, z, x, y) of intervals, one row a tile; long ones are dealt out in stretches."""
    runs = intervals.select(F.col("first_id").alias("tile_id"), (F.col("end_id") - F.col("first_id")).alias("run_length"))
    return expanded(runs).withColumn("t", bulk_zxy("tile_id")).select("tile_id", "t.z", "t.x", "t.y")
