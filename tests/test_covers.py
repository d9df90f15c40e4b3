"""Interval and scanline covers against tiles worked out one by one."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tilespark.functions.hilbert import LEVEL_STARTS
from tilespark.operators import cover, cutlines, navigate

BOX = "n long, west double, south double, east double, north double"


def boxes(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], BOX)


def some_boxes(rng, count, size):
    out = []
    for _ in range(count):
        w, s = rng.uniform(-180, 179), rng.uniform(-90, 89)
        e = w + rng.uniform(0, size)
        out.append((w, s, e - 360 if e > 180 else e, min(90, s + rng.uniform(0, size))))
    return out


def test_intervals_are_the_tiles_of_their_boxes(spark):
    rng = random.Random(4)
    rows = some_boxes(rng, 60, 40) + [(-180, -90, 180, 90), (170, -10, -170, 10), (1, 1, 0.5, 2), (5, 5, 5, 5), (5, 6, 7, 5), (179.99, -85, 180, 85)]
    rows.append(rows[0])  # equal boxes are two
    df = boxes(spark, rows)
    found = cover.box_intervals(df, 0, 7)
    assert found.columns == [*df.columns, "z", "first_id", "end_id"]
    tiles = cover.tiles_of
    ours, number = {}, {}
    for r in found.collect():
        for i in range(r.first_id, r.end_id):
            assert i not in ours.setdefault(r.n, set()) and LEVEL_STARTS[r.z] <= i < LEVEL_STARTS[r.z + 1]
            ours[r.n].add(i)
        number[r.n] = number.get(r.n, 0) + 1
    from tilespark.functions.hilbert import zxy_to_tile_id

    want = {}
    for r in navigate.bbox_cover(df, 0, 7).select("n", zxy_to_tile_id("z", "x", "y").alias("i")).collect():
        assert r.i not in want.setdefault(r.n, set())
        want[r.n].add(r.i)
    assert ours == want and ours[0] == ours[len(rows) - 1]
    assert number[60] == 8  # the world is one interval a zoom
    union = cover.interval_union(found, found)
    assert sorted(r.tile_id for r in tiles(union).collect()) == sorted(set().union(*want.values()))


def test_union_of_deep_covers_is_counted_without_tiles(spark):
    rows = some_boxes(random.Random(9), 150, 0.05) + some_boxes(random.Random(9), 40, 0.02) + [(10, 10, 10.05, 10.05), (10.01, 10.01, 10.04, 10.2)]
    df = boxes(spark, rows)
    found = {r.z: r.tiles for r in cover.tile_counts(cover.interval_union(cover.box_intervals(df, 20, 20))).collect()}
    rectangles = [(r.x0, r.x1 + 1, r.y0, r.y1 + 1) for r in cover.tile_rectangles(df, 20, 20).collect()]
    area, xs = 0, sorted({x for r in rectangles for x in r[:2]})
    for a, b in zip(xs, xs[1:]):
        reach, height = -1, 0
        for y0, y1 in sorted(r[2:] for r in rectangles if r[0] <= a and b <= r[1]):
            height += max(0, y1 - max(reach, y0))
            reach = max(reach, y1)
        area += (b - a) * height
    assert found == {20: area}


def test_a_box_with_a_long_edge_is_dealt_out(spark):
    df = boxes(spark, [(-179.9, -84.9, 179.9, 84.9), (-179.9, -84.9, 179.9, 84.9), (0, 0, 0.1, 0.1)])
    r = cover.tile_rectangles(df.where("n = 0"), 16, 16).first()
    assert r.x1 - r.x0 + r.y1 - r.y0 > cover.EDGE
    sums = {x.n: x.tiles for x in cover.box_intervals(df, 16, 16).groupBy("n").agg(F.sum(F.col("end_id") - F.col("first_id")).alias("tiles")).collect()}
    assert sums[0] == sums[1] == (r.x1 - r.x0 + 1) * (r.y1 - r.y0 + 1)
    union = cover.interval_union(cover.box_intervals(df, 16, 16))
    assert cover.tile_counts(union).first().tiles == sums[0]


def test_no_boxes(spark):
    none = cover.box_intervals(boxes(spark, []), 0, 3)
    assert none.count() == 0 and cover.interval_union(none).count() == 0


def touching(rings, z):
    """Tiles that an edge meets, borders included, or whose middle is inside."""
    n = 1 << z
    row = lambda lat: (0.5 - math.log((1 + math.sin(math.radians(lat))) / (1 - math.sin(math.radians(lat)))) / (4 * math.pi)) * n
    sides = [((a[0] + 180) / 360 * n, row(a[1]), (b[0] + 180) / 360 * n, row(b[1])) for ring in rings for a, b in zip(ring, ring[1:])]
    out = set()
    for x in range(n):
        for y in range(n):
            odd = touched = False
            for ax, ay, bx, by in sides:
                if min(ax, bx) <= x + 1 and max(ax, bx) >= x and min(ay, by) <= y + 1 and max(ay, by) >= y:
                    at = [(bx - ax) * (q - ay) - (by - ay) * (p - ax) for p in (x, x + 1) for q in (y, y + 1)]
                    touched |= min(at) <= 0 <= max(at)
                if (ay > y + 0.5) != (by > y + 0.5) and x + 0.5 < ax + (y + 0.5 - ay) * (bx - ax) / (by - ay):
                    odd = not odd
            if touched or odd:
                out.add((x, y))
    return out


def star(rng, lon, lat, size, corners):
    points = [[lon + size * r * math.cos(a), lat + size * r * math.sin(a) / 2] for a, r in ((2 * math.pi * i / corners, rng.uniform(0.3, 1)) for i in range(corners))]
    return [*points, points[0]]


def test_scanlines(spark):
    rng = random.Random(8)
    shapes = [[star(rng, rng.uniform(-100, 100), rng.uniform(-30, 30), rng.uniform(1, 70), rng.choice([3, 5, 40]))] for _ in range(6)]
    shapes += [[star(rng, 20, 10, 60, 12), star(rng, 20, 10, 20, 7)], [[[0, 0], [90, 0], [90, 66.51326044311186], [0, 66.51326044311186], [0, 0]]]]  # a hole; borders on borders of tiles
    rows = [(i, ring) for i, rings in enumerate(shapes) for ring in rings]
    df = spark.createDataFrame([(i, [[float(v) for v in p] for p in ring]) for i, ring in rows] + [(98, [[0.0, 0.0]]), (99, [])], "polygon long, ring array<array<double>>")
    for z in (0, 2, 5):
        found = [(r.x, r.y) for r in cutlines.cutline_cover(df, z, z).collect()]
        assert len(found) == len(set(found))
        assert set(found) == set().union(*(touching(rings, z) for rings in shapes))


def test_scanline_spans_do_not_grow_with_area(spark):
    square = [[-60.0, -40.0], [60.0, -40.0], [60.0, 40.0], [-60.0, 40.0], [-60.0, -40.0]]
    df = spark.createDataFrame([(1, square)], "polygon long, ring array<array<double>>")
    spans = cutlines.cutline_spans(df, 15, 15).agg(F.count("*").alias("n"), F.sum(F.col("x1") - F.col("x0") + 1).alias("tiles")).first()
    rows = cover.tile_rectangles(boxes(spark, [(-60, -40, 60, 40)]), 15, 15).first()
    assert spans.n == rows.y1 - rows.y0 + 1 and spans.tiles >= (rows.x1 - rows.x0 + 1) * spans.n


@pytest.mark.parametrize("lat", [-85.0, 84.9])
def test_boxes_at_all_latitudes(spark, lat):
    assert cover.box_intervals(boxes(spark, [(0, lat - 0.3, 0.7, lat)]), 4, 8).count() >= 5


@pytest.mark.parametrize("zooms", [(0, 11), (3, 6), (0, 0), (9, 9)])
def test_the_union_that_is_drawn_is_that_of_the_intervals(spark, monkeypatch, zooms):
    rng = random.Random(5)
    rows = some_boxes(rng, 60, 3) + some_boxes(rng, 6, 60) + [(-180, -90, 180, 90)][: zooms[1] < 8] + [(170, -10, -170, 10), (179, 0, -179.5, 1), (1, 1, 0.5, 2), (5, 5, 5, 5), (5, 6, 7, 5), (0, 0, 0, 10), (22.5, 3, 22.5, 4), (179.99, -85, 180, 85), (3, -90, 4, -89), (3, 0, 4, 0)]
    df = boxes(spark, rows + rows[:9])
    rows_of = []
    whole = cover.interval_union
    monkeypatch.setattr(cover, "interval_union", lambda *covers: (rows_of.append(covers[0].count()), whole(*covers))[1])
    found = sorted(map(tuple, cover.box_union(df, *zooms).collect()))
    tiles = lambda intervals: {i for a, b in intervals for i in range(a, b)}
    assert tiles(found) == tiles(whole(cover.box_intervals(df, *zooms)).collect()) and sum(b - a for a, b in found) == len(tiles(found))
    # equal boxes cost nothing: what is drawn has as many intervals as it has without them
    cover.box_union(boxes(spark, rows * 3), *zooms)
    assert rows_of[0] == rows_of[1] or zooms[1] < 11
