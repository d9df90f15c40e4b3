"""Set-at-a-time operators against sequential models and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from tilespark.operators import build, cover, cutlines, inspect, lookup, navigate, ordered
from tilespark.plans import serve
from tilespark.queries import _archives, _vector_tile
from tilespark.streaming import serve_stream, status_counts


def sequential(rows):
    """(tile_id, data) in order of arrival -> offsets and entries, one row at a time."""
    offsets, end, placed, entries = {}, 0, [], []
    for tile_id, data in rows:
        if data not in offsets:
            offsets[data] = end
            end += len(data)
        placed.append((tile_id, offsets[data]))
        last = entries[-1] if entries else None
        if last and last[0] + last[3] == tile_id and last[1] == offsets[data]:
            last[3] += 1
        else:
            entries.append([tile_id, offsets[data], len(data), 1])
    return placed, entries


@pytest.mark.parametrize("seed", range(4))
def test_build_is_sequential(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(400), 300)
    ids = ids if seed % 2 else sorted(ids)
    rows = [(i, rng.choice(["a", "bb", "ccc"]) * rng.choice([1, 1, 1, 2])) for i in ids]
    tiles = spark.createDataFrame([(n, i, d) for n, (i, d) in enumerate(rows)], "seq long, tile_id long, data string").repartition(5)
    placed, entries = sequential(rows)
    found = build.deduplicated(tiles)
    assert [(r.tile_id, r.offset) for r in found.orderBy("seq").collect()] == placed
    runs = build.runs(found)
    assert sorted(map(list, runs.select("tile_id", "offset", "length", "run_length").collect())) == sorted(entries)
    assert build.clustered(tiles).first()[0] == (ids == sorted(ids))
    one = build.counters(runs).first()
    assert (one.addressed, one.entries, one.contents) == (300, len(entries), len({o for _, o, _, _ in entries}))
    assert sorted(r.tile_id for r in build.expanded(runs, 3).collect()) == sorted(ids)


def test_order_over_seams(spark):
    rng = random.Random(9)
    rows = [(k, rng.choice([None, rng.randrange(100)]), rng.randrange(10)) for k in rng.sample(range(10000), 500)]
    df = spark.createDataFrame(rows, "k long, v long, n long").repartition(7)
    ranged = ordered.into_ranges(df, "k", 6)
    rows.sort()
    assert ranged.select("_range").distinct().count() > 3
    total, last, want = 0, None, {}
    before = (None, None)
    for k, v, n in rows:
        total, last = total + n, v if v is not None else last
        want[k] = (total, last, *before)
        before = (v, n)
    sums = {r.k: r.s for r in ordered.running_sum(ranged, "n", "s", "k").collect()}
    known = {r.k: r.l for r in ordered.last_known(ranged, "v", "l", "k").collect()}
    prev = {r.k: (r.prev_v, r.prev_n) for r in ordered.previous(ranged, ["v", "n"], "k").collect()}
    assert all((sums[k], known[k], *prev[k]) == w for k, w in want.items())
    assert ordered.running_sum(ordered.into_ranges(df.limit(0), "k"), "n", "s", "k").count() == 0


@pytest.mark.parametrize(("entries", "asked", "want"), [([], 0, None), ([(100, 1, 1, 1)], 100, 1), ([(100, 1, 1, 1)], 101, None), ([(3, 3, 1, 2), (5, 5, 1, 2)], 4, 3), ([(50, 1, 1, 2), (100, 2, 2, 1), (150, 3, 3, 1)], 51, 1), ([(100, 1, 1, 0)], 150, None), ([(0, 1, 1, 10), (2, 7, 1, 1)], 5, None)])
@pytest.mark.parametrize("find", [lookup.lookup, lookup.lookup_small])
def test_find(spark, find, entries, asked, want):
    table = spark.createDataFrame(entries, "tile_id long, offset long, length long, run_length long")
    rows = find(spark.createDataFrame([(1, asked), (2, asked), (3, None)], "request_id long, tile_id long"), table).orderBy("request_id").collect()
    assert [r.offset for r in rows] == [want, want, None]


def test_many_archives(spark):
    rng = random.Random(7)
    entries, held = [], {}
    for archive in "abcde":
        at = 0
        while at < 300:
            at += rng.randrange(1, 9)
            run = rng.randrange(0, 5)
            entries.append((archive, at, len(entries), 1, run))
            held |= {(archive, i): len(entries) - 1 for i in range(at, at + run)}
            at += run
    asked = [(rng.choice("abcdef"), rng.randrange(320)) for _ in range(500)] + [("a", 3)] * 50 + [("c", (1 << 62) + 1), (None, 5)]
    table = spark.createDataFrame(entries, "archive string, tile_id long, offset long, length long, run_length long")
    found = lookup.lookup_archives(spark.createDataFrame(asked, "archive string, tile_id long"), table)
    assert sorted(map(str, ((r.archive, r.tile_id, r.offset) for r in found.collect()))) == sorted(map(str, ((a, i, held.get((a, i))) for a, i in asked)))


def test_large_entry_tables_are_merged(spark):
    entries = spark.range(50).select((F.col("id") * 3).alias("tile_id"), F.col("id").alias("offset"), F.lit(1).cast("long").alias("length"), F.lit(2).cast("long").alias("run_length"))
    asked = spark.range(160).select(F.col("id").alias("tile_id"))
    same = lookup.lookup_small(asked, entries, most=10)
    assert sorted(map(str, same.collect())) == sorted(map(str, lookup.lookup_small(asked, entries).collect()))
    assert [r.tile_id for r in lookup.missing(asked, entries).orderBy("tile_id").collect()] == [i for i in range(160) if i % 3 == 2 or i >= 150]


def test_navigation(spark):
    tiles = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (31, 0, 2**31 - 1)], "z int, x long, y long")
    ups = {r.z: r.parent for r in navigate.parent(tiles).collect()}
    assert ups[0] is None and tuple(ups[1]) == (0, 0, 0) and tuple(ups[31]) == (30, 0, 2**30 - 1)
    assert navigate.children(tiles).count() == 8 and navigate.neighbours(tiles).count() == 0 + 3 + 3


def test_boxes(spark):
    box = lambda *b: spark.createDataFrame([b], "west double, south double, east double, north double")
    assert navigate.bbox_cover(box(-180.0, -90.0, 180.0, 90.0), 0, 3).count() == 85
    over = navigate.bbox_cover(box(170.0, -10.0, -170.0, 10.0), 2, 2).select("x").distinct().collect()
    assert {r.x for r in over} == {0, 3}
    union = cover.interval_union(cover.box_intervals(box(0.0, 0.0, 1.0, 1.0), 0, 2), cover.box_intervals(box(0.0, 0.0, 1.0, 1.0), 1, 3))
    assert sorted(r.z for r in cover.tiles_of(union).collect()) == [0, 1, 2, 3]
    assert navigate.bbox_cover(box(0.5, 0.5, 0.6, 0.6), 3, 3, most=1).count() == 1


def test_cutlines(spark, tmp_path):
    triangle = '{"type":"Polygon","coordinates":[[[-90,0],[90,0],[0,80],[-90,0]]]}'
    path = tmp_path / "c.geojson"
    path.write_text('{"type":"FeatureCollection","features":[{"geometry":%s}]}' % triangle)
    found = cutlines.cutline_cover(cutlines.read_cutlines(spark, f"file://{path}"), 0, 4).collect()
    assert {(0, 0), (1, 0)} <= {(r.x, r.y) for r in found if r.z == 1}
    deep = {(r.x, r.y) for r in found if r.z == 4}
    assert (7, 6) in deep and (8, 3) in deep and (1, 1) not in deep and (4, 2) not in deep
    path.write_text('{"features":[{"geometry":{"type":"Point","coordinates":[0,0]}}]}')
    with pytest.raises(Exception, match="polygons"):
        cutlines.read_cutlines(spark, f"file://{path}").collect()


def test_vector_tiles(spark):
    import gzip

    tile = _vector_tile({"roads": 3, "water": 1})
    tiles = spark.createDataFrame([(1, tile), (2, gzip.compress(tile)), (3, None)], "tile_id long, data binary")
    found = inspect.features(tiles)
    assert found.count() == 8 and inspect.largest_extent(found).first()[0] == 4096
    declared = spark.createDataFrame([("roads", True), ("water", False), ("none", True)], "id string, visible boolean")
    assert {tuple(r) for r in inspect.layer_counts(found, declared).collect()} == {("roads", 6), ("water", 2), ("none", 0)}
    assert inspect.visible(found, declared).count() == 6
    order = [r.geom_type for r in inspect.drawing_order(found).collect()]
    assert order == sorted(order, reverse=True)


def test_feature_properties(spark):
    field = lambda n, body: bytes([n << 3 | 2, len(body)]) + body
    feature = bytes([8, 7]) + field(2, bytes([0, 0, 1, 1])) + bytes([24, 2])
    layer = field(1, b"l") + field(2, feature) + field(3, b"name") + field(3, b"up") + field(4, field(1, b"x")) + field(4, bytes([56, 1]))
    row = inspect.features(spark.createDataFrame([(field(3, layer),)], "data binary")).first()
    assert (row.layer, row.geom_type, row.id, row.properties) == ("l", 2, 7, {"name": "x", "up": "true"})


def test_histogram_over_zooms(spark):
    entries = spark.createDataFrame([(0, 6), (21, 1), (5, 0)], "tile_id long, run_length long")
    assert {tuple(r) for r in inspect.zoom_histogram(entries).collect()} == {(0, 1), (1, 4), (2, 1), (3, 1)}


ASKED = [("/view/3/1/1.mvt", 200), ("/view/3/1/1.png", 400), ("/view/9/1/1.mvt", 404), ("/nope/0/0/0.mvt", 403), ("junk", 400), ("/view.json", 200), (None, 500), ("/click/0/0/0.xyz", 200)]


def test_serving(spark):
    requests = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(ASKED)], "i int, path string")
    found = {r.i: r for r in serve.serve(requests, _archives(spark), "example.com").collect()}
    assert [found[i].status for i in range(len(ASKED))] == [s for _, s in ASKED]
    assert found[1].message == "Bad request: requested .png but archive has type .mvt" and '"tilejson":"3.0.0"' in found[5].message
    assert found[0].content_type == "application/vnd.mapbox-vector-tile" and found[0].cache_control
    assert {r.i: r.status for r in serve.serve(requests, _archives(spark)).collect()}[5] == 501
    edge = requests.withColumn("method", F.lit("GET")).withColumn("origin", F.lit("http://b"))
    there = {r.i: r for r in serve.serve(edge, _archives(spark), "h", "edge", "http://a,http://b").collect()}
    assert (there[3].status, there[4].status, there[0].allow_origin) == (404, 404, "http://b")
    assert serve.serve(edge.withColumn("method", F.lit("POST")), _archives(spark), "h", "edge").where("status = 405").count() == len(ASKED)
    for method in ("HEAD", "OPTIONS", "PUT"):
        assert {r.i: r.status for r in serve.serve(edge.withColumn("method", F.lit(method)), _archives(spark), "h", "edge").collect()} == {i: r.status for i, r in there.items()}
    assert there[0].vary == there[2].vary == "Origin" and there[2].cache_control and there[4].vary is None and found[5].cache_control is None and found[0].vary is None
    tiles = spark.createDataFrame([("/view", 21 + 2, b"x")], "archive string, tile_id long, data binary")
    full = {r.i: r for r in serve.with_tiles(serve.serve(requests, _archives(spark), "h"), tiles).collect()}
    assert full[0].status == 200 and bytes(full[0].data) == b"x" and full[0].etag.startswith('"') and full[7].status == 204 and full[4].status == 400
    states = {r.i: r.state for r in serve.loaded_state(serve.with_tiles(serve.serve(requests, _archives(spark), "h"), tiles)).collect()}
    assert (states[0], states[4], states[7]) == ("LOADED", "ERROR", "EMPTY")


def test_protocol(spark):
    urls = spark.createDataFrame([("tiles://view/3/1/1",), ("tiles://view/30/1/1",), ("x",), ("tiles://search/0/0/0",)], "url string")
    rows = serve.protocol(urls, _archives(spark), "tiles").collect()
    assert {(r.state, r.missing) for r in rows} == {("FOUND", "empty"), ("OUTSIDE", "empty"), ("INVALID", "null"), ("FOUND", "null")}
    assert serve.protocol(urls, _archives(spark), "tiles", error_on_missing=True).where("missing = 'error'").count() == 2


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(p, "2024-01-01 00:00:30") for p, _ in ASKED if p], "path string, at string").withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(source))
    stream = spark.readStream.schema("path string, at timestamp").parquet(str(source))
    answers = serve_stream(stream, _archives(spark), hostname="example.com")
    for name, df, mode in (("answers", answers, "append"), ("counts", status_counts(answers, "at"), "complete")):
        running = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        running.processAllAvailable()
        running.stop()
    assert spark.table("answers").count() == 7
    assert {(r.status, r.answers) for r in spark.table("counts").collect()} == {(200, 3), (400, 2), (404, 1), (403, 1)}


def test_find_in_a_directory_with_pointers(spark):
    """A pointer to a leaf directory (run 0) answers for all ids up to the next entry."""
    table = spark.createDataFrame([(0, 1, 1, 2), (100, 7, 9, 0), (200, 8, 9, 0)], "tile_id long, offset long, length long, run_length long")
    asked = spark.createDataFrame([(1,), (2,), (100,), (150,), (199,), (5000,)], "tile_id long")
    found = {r.tile_id: r.offset for r in lookup.lookup(asked, table, pointers=True).collect()}
    assert found == {1: 1, 2: None, 100: 7, 150: 7, 199: 7, 5000: 8}
    assert {r.tile_id: r.offset for r in lookup.lookup(asked, table).collect()} == {1: 1, 2: None, 100: None, 150: None, 199: None, 5000: None}


def test_long_runs_are_drawn_whole(spark):
    from tilespark.operators import navigate

    runs = spark.createDataFrame([(0, 1), (21845, 5000)], "tile_id long, run_length long")
    lines = navigate.entry_lines(runs, 1024).collect()
    assert sorted((r.tile_id, r.part, len(r.line or [])) for r in lines) == [(0, 0, 0), *[(21845, i, 1024) for i in range(4)], (21845, 4, 904)]
