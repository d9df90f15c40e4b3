"""Scalar functions: addresses, geography, facts, paths."""

import math

import pytest
from pyspark.sql import functions as F

from tilespark.functions import facts, hilbert, mercator, paths


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_golden_ids(spark):
    want = {(0, 0, 0): 0, (1, 0, 0): 1, (1, 0, 1): 2, (1, 1, 1): 3, (1, 1, 0): 4, (2, 0, 0): 5, (12, 3423, 1763): 19078479, (31, 2**31 - 1, 0): 6148914691236517204}
    rows = spark.createDataFrame([(*k, v) for k, v in want.items()], "z int, x long, y long, want long")
    for encode, decode in ((hilbert.zxy_to_tile_id, hilbert.tile_id_to_zxy), (hilbert.bulk_tile_id, hilbert.bulk_zxy)):
        found = rows.withColumn("id", encode("z", "x", "y")).withColumn("t", decode("id"))
        assert found.where("id <> want OR t.z <> z OR t.x <> x OR t.y <> y OR id IS NULL").isEmpty()


def test_round_trips(spark):
    tiles = spark.range(sum(4**z for z in range(7))).withColumn("t", hilbert.try_zxy("id")).withColumn("b", hilbert.bulk_zxy("id"))
    bad = (hilbert.try_tile_id("t.z", "t.x", "t.y") != F.col("id")) | (F.col("t") != F.col("b")) | (hilbert.zoom_of("id") != F.col("t.z"))
    assert tiles.where(bad).isEmpty() and tiles.select("t").distinct().count() == 5461
    corners = spark.createDataFrame([(z, x, y) for z in range(32) for x in (0, 2**z - 1) for y in (0, 2**z - 1)], "z int, x long, y long").withColumn("i", hilbert.try_tile_id("z", "x", "y"))
    back = corners.withColumn("t", hilbert.try_zxy("i")).withColumn("j", hilbert.bulk_tile_id("z", "x", "y"))
    assert back.where("t.z <> z OR t.x <> x OR t.y <> y OR i <> j OR i IS NULL").isEmpty()


@pytest.mark.parametrize("address", [(32, 0, 0), (0, 1, 1), (31, 2**31, 2**31), (3, -1, 0), (-1, 0, 0)])
def test_no_such_tile(spark, address):
    rows = spark.createDataFrame([address], "z int, x long, y long")
    assert rows.select(hilbert.try_tile_id("z", "x", "y"), hilbert.bulk_tile_id("z", "x", "y")).first()[:] == (None, None)
    with pytest.raises(Exception, match="no such tile"):
        rows.select(hilbert.zxy_to_tile_id("z", "x", "y")).collect()


def test_no_such_id(spark):
    rows = spark.createDataFrame([(-1,), (hilbert.END,), (None,)], "i long")
    assert [r[0] for r in rows.select(hilbert.try_zxy("i")).collect()] == [None] * 3
    assert [r[0] for r in rows.select(hilbert.zoom_of("i")).collect()] == [None] * 3
    with pytest.raises(Exception, match="no such tile id"):
        rows.where("i < 0").select(hilbert.tile_id_to_zxy("i")).collect()


def test_geography(spark):
    found = one(spark, mercator.lonlat_to_tile(F.lit(-122.4), F.lit(37.8), F.lit(10)), mercator.lonlat_to_tile(F.lit(180.0), F.lit(-90.0), F.lit(2)), mercator.tile_bounds(F.lit(0), F.lit(0), F.lit(0)))
    assert tuple(found[0]) == (163, 395) and tuple(found[1]) == (3, 3)
    assert found[2].west == -180 and found[2].east == 180 and abs(found[2].north - 85.0511287798) < 1e-9
    there = one(spark, mercator.to_metres(F.lit(180.0), F.lit(45.0)))[0]
    back = one(spark, mercator.to_degrees(F.lit(there.x), F.lit(there.y)))[0]
    assert abs(there.x - 20037508.34) < 1 and math.isclose(back.lat, 45) and math.isclose(back.lon, 180)
    world = [F.lit(v) for v in (-180.0, -85.05112878, 180.0, 85.05112878)]
    over = [F.lit(v) for v in (179.0, -10.0, -179.0, 10.0)]
    zooms = one(spark, *[mercator.guess_max_zoom(F.lit(n), F.lit(n), *world) for n in (256, 512)], mercator.guess_max_zoom(F.lit(512), F.lit(5120), *over))
    assert zooms[:2] == (0, 1) and 6 <= zooms[2] <= 9
    assert one(spark, mercator.best_overview(F.array(*[F.lit(f) for f in (2, 4, 8)]), F.lit(1), F.lit(5)), mercator.best_overview(F.array(F.lit(2)), F.lit(5), F.lit(5)))[:] == (1, None)
    assert one(spark, mercator.elevation(F.lit(128), F.lit(1), F.lit(128)))[0] == 1.5
    assert one(spark, mercator.clamp_bounds(F.lit(-200.0), F.lit(-90.0), F.lit(200.0), F.lit(90.0)))[0].north == mercator.MAX_LAT


def test_facts(spark):
    assert [r[0] for r in spark.range(8).select(facts.tile_extension("id")).collect()] == ["", ".mvt", ".png", ".jpg", ".webp", ".avif", ".mlt", ""]
    assert [r[0] for r in spark.range(6).select(facts.compression_name("id")).collect()] == ["unknown", "none", "gzip", "brotli", "zstd", "out of spec"]
    names = spark.createDataFrame([("pbf", None), ("jpg", None), ("mlt", "gzip"), ("?", None)], "f string, c string")
    assert [tuple(r) for r in names.select(facts.tile_type_of_format("f"), facts.compression_of_format("f", "c")).collect()] == [(1, 2), (3, 1), (6, 2), (0, 1)]
    assert one(spark, facts.media_type(F.lit(1)), facts.media_type(F.lit(5), "edge"), facts.to_e7(F.lit(-1.10000009)), facts.format_bytes(F.lit(1536)), facts.format_bytes(F.lit(0)), facts.format_bytes(F.lit(1152)), facts.format_bytes(F.lit(100 << 20)), facts.format_bytes(F.lit(1023)))[:] == ("application/vnd.mapbox-vector-tile", None, -11000000, "1.5 KiB", "0 Bytes", "1.13 KiB", "100 MiB", "1023 Bytes")
    rows = spark.createDataFrame([('{"type":"overlay","version":"1.0.0","vector_layers":[]}', 1), ('{"type":"x","version":"1"}', 1), ("[1]", 2)], "json string, tile_type int")
    assert [r[0] for r in rows.select(facts.metadata_faults("json")).collect()] == [[], ["type", "version", "vector_layers"], ["not an object"]]


def test_paths(spark):
    rows = spark.createDataFrame([("/foo/bar/3/2/1.mvt",), ("/foo.json",), ("/foo/1/2.png",), (None,)], "p string").select(paths.parse_request("p").alias("r")).select("r.*").collect()
    assert tuple(rows[0]) == (True, "foo/bar", 3, 2, 1, "mvt") and tuple(rows[1]) == (True, "foo", None, None, None, "json")
    assert not rows[2].ok and not rows[3].ok
    name = F.lit("foo")
    assert one(spark, paths.archive_path(name, "{name}.tiles"), paths.archive_path(F.lit("foo/bar"), "folder/{name}/file.tiles"), paths.archive_path(F.lit("slug"), "folder/{name}/{name}.tiles"))[:] == ("foo.tiles", "folder/foo/bar/file.tiles", "folder/slug/slug.tiles")
    url = paths.parse_tile_url(F.lit("tiles://https://x.y/z.tiles/3/2/1"), "tiles")
    assert tuple(one(spark, url)[0]) == ("https://x.y/z.tiles", 3, 2, 1) and one(spark, paths.parse_tile_url(F.lit("http://x"), "tiles"))[0] is None
    ranges = spark.createDataFrame([("1..5",), ("..5",), ("1..",)], "r string").select(paths.parse_zoom_range("r", 0, 9).alias("z")).select("z.*").collect()
    assert [tuple(r) for r in ranges] == [(1, 5), (0, 5), (1, 9)]
    assert one(spark, paths.parse_hash(F.lit("#a=1&b=2")), paths.parse_zxy(F.lit("1/2/3")), paths.fill_template(F.lit("{z}/{x}/{y}.png"), F.lit(1), F.lit(2), F.lit(3)))[:] == ({"a": "1", "b": "2"}, (1, 2, 3), "1/2/3.png")
    assert one(spark, paths.build_hash(F.create_map(F.lit("a"), F.lit("1"))), paths.allowed_origin(F.lit("http://a,http://b"), F.lit("http://b")), paths.allowed_origin(F.lit("http://a"), F.lit("http://b")))[:] == ("#a=1", "http://b", None)


def test_tile_json(spark):
    fields = "tile_type int, min_zoom int, max_zoom int, min_lon_e7 int, min_lat_e7 int, max_lon_e7 int, max_lat_e7 int, center_zoom int, center_lon_e7 int, center_lat_e7 int, json string"
    rows = spark.createDataFrame([(1, 0, 0, 0, 0, 9999999, 10000000, 0, 0, 0, '{"version":"2","vector_layers":[{"id":"a"}]}')], fields)
    import json

    found = json.loads(rows.select(facts.tile_json(F.lit("https://example.com/foo"), "json")).first()[0])
    assert found["tilejson"] == "3.0.0" and found["scheme"] == "xyz" and found["tiles"] == ["https://example.com/foo/{z}/{x}/{y}.mvt"] and found["version"] == "2" and "name" not in found
    assert found["vector_layers"] == [{"id": "a"}] and found["bounds"] == [0, 0, 0.9999999, 1]
    short = json.loads(rows.select(facts.protocol_tile_json(F.lit("u"))).first()[0])
    assert short == {"tiles": ["u/{z}/{x}/{y}"], "minzoom": 0, "maxzoom": 0, "bounds": [0.0, 0.0, 0.9999999, 1.0]}
