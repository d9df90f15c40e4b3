"""Archives written and read back, in every layout; databases, trees, errors."""

import gzip
import http.server
import json
import os
import sqlite3
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilespark.functions.hilbert import tile_id_to_zxy
from tilespark.plans import convert, pyramid
from tilespark.schema import HEADER_FIELDS
from tilespark.sources import codec
from tilespark.sources.archive import read_tiles
from tilespark.sources.sink import write_archives


def read(spark, path, table="tiles", **options):
    return spark.read.format("tile_archive").options(path=str(path), table=table, **options).load()


def tiles_of(spark, rows):
    return spark.createDataFrame([(i, d if isinstance(d, bytes) else d.encode()) for i, d in rows], "tile_id long, data binary")


@pytest.mark.parametrize("layout", ["header_first", "data_first"])
@pytest.mark.parametrize("archives", [1, 3])
def test_round_trip(spark, tmp_path, layout, archives):
    rows = spark.range(30000).select(F.col("id").alias("tile_id"), F.concat(F.lit("v"), (F.col("id") * 7919 % 5003).cast("string")).cast("binary").alias("data"))
    write_archives(rows, str(tmp_path / "a"), archives, layout=layout, metadata='{"key":"value"}', internal_compression="1")
    back = read(spark, tmp_path / "a")
    assert back.count() == 30000
    assert back.join(rows.withColumnRenamed("data", "want"), "tile_id").where("data = want").count() == 30000
    header = read(spark, tmp_path / "a", "header")
    assert header.agg(F.sum("addressed_tiles_count")).first()[0] == 30000 and header.count() == archives
    assert read(spark, tmp_path / "a", "metadata").first()["json"] == '{"key":"value"}'
    entries = read(spark, tmp_path / "a", "entries")
    assert entries.where("run_length > 0").agg(F.sum("run_length")).first()[0] == 30000
    if archives == 1:  # too many entries for a root directory
        assert entries.where("depth = 1").count() > 0
    pruned = lambda **only: read_tiles(spark, str(tmp_path / "a"), **only)
    point = pruned(z=7, x=3, y=5)
    assert point.count() == 1 and point.rdd.getNumPartitions() == 1
    assert pruned(z=[2, 3]).count() == 80 and pruned(tile_id=[5, 29999, 40000]).count() == 2 and pruned(tile_id=[]).count() == 0
    assert pruned(z=31).count() == 0 and pruned(z=3, x=99, y=0).count() == 0 and pruned(from_id=10, below_id=20).count() == 10
    assert pruned(z=7, x=[3, 4]).count() == back.where("z = 7 AND x IN (3, 4)").count() == 256
    # scans of one table do not disturb each other
    assert back.where("tile_id < 10").union(back.where("tile_id >= 29990")).count() == 20 and back.count() == 30000
    assert back.where("z BETWEEN 2 AND 3").count() == 80 and back.where("tile_id IN (5, 29999, 40000)").count() == 2
    assert back.where("z > 30").count() == 0 and back.where("z = 3 AND x = 99 AND y = 0").count() == 0


def test_runs_and_contents(spark, tmp_path):
    write_archives(tiles_of(spark, [(0, "1"), (1, "1"), (5, "2")]), str(tmp_path / "a"))
    header = read(spark, tmp_path / "a", "header").first()
    assert (header.addressed_tiles_count, header.tile_entries_count, header.tile_contents_count, header.min_zoom, header.max_zoom, header.clustered) == (3, 2, 2, 0, 2, True)
    assert [(r.z, r.x, r.y, bytes(r.data)) for r in read(spark, tmp_path / "a").orderBy("tile_id").collect()] == [(0, 0, 0, b"1"), (1, 0, 0, b"1"), (2, 0, 0, b"2")]


def test_unsorted_arrival(spark, tmp_path):
    write_archives(tiles_of(spark, [(1, "b"), (0, "a")]).coalesce(1), str(tmp_path / "a"), order=None)
    assert not read(spark, tmp_path / "a", "header").first().clustered
    assert [bytes(r.data) for r in read(spark, tmp_path / "a").orderBy("tile_id").collect()] == [b"a", b"b"]


def test_refused(spark, tmp_path):
    for rows, what in (([(0, "")], "no bytes"), ([(3, "a"), (3, "b")], "twice"), ([], "no tiles")):
        with pytest.raises(Exception, match=what):
            write_archives(tiles_of(spark, rows), str(tmp_path / "bad"))
    assert not [f for f in os.listdir(tmp_path / "bad")]
    write_archives(tiles_of(spark, [(3, "a"), (3, "b")]).coalesce(1), str(tmp_path / "one"), on_duplicate="first")
    assert read(spark, tmp_path / "one").count() == 1
    with pytest.raises(Exception, match="exists"):
        write_archives(tiles_of(spark, [(0, "a")]), str(tmp_path / "one"))
    write_archives(tiles_of(spark, [(9, "z")]), str(tmp_path / "one"), mode="overwrite")
    assert [r.tile_id for r in read(spark, tmp_path / "one").collect()] == [9]
    write_archives(tiles_of(spark, []), str(tmp_path / "none"), allow_empty="true")
    assert read(spark, tmp_path / "none").count() == 0


def test_not_archives(spark, tmp_path):
    (tmp_path / "text").write_text("this is no archive" * 9)
    with pytest.raises(Exception, match="not an archive"):
        read(spark, tmp_path / "text").collect()
    write_archives(tiles_of(spark, [(0, "a")]), str(tmp_path / "good"))
    good = [str(p) for p in (tmp_path / "good").iterdir()][0]
    assert read(spark, f"{tmp_path / 'text'},{good}", mode="PERMISSIVE").count() == 1
    with pytest.raises(Exception, match="no table"):
        read(spark, good, "nothing")
    with pytest.raises(Exception):  # noqa: B017
        read(spark, tmp_path / "absent").collect()


def _archive(root, leaves, data, packing=1, **fields):
    """An archive put together by hand: leaves before the data."""
    at = 127 + len(root)
    values = dict.fromkeys([n for n, _ in HEADER_FIELDS], 0) | {
        "root_offset": 127, "root_length": len(root), "metadata_offset": at, "leaf_directory_offset": at, "leaf_directory_length": len(leaves), "tile_data_offset": at + len(leaves),
        "tile_data_length": len(data), "internal_compression": packing, "tile_compression": 1, "max_zoom": 4,
    } | fields
    return codec.encode_header(values) + root + leaves + data


def test_leaves_in_leaves_and_circles(spark, tmp_path):
    inner = codec.encode_directory(np.array([[3, 0, 2, 2]]))
    outer = codec.encode_directory(np.array([[3, 0, len(inner), 0]]))
    root = codec.encode_directory(np.array([[0, len(inner), len(outer), 0]]))
    (tmp_path / "nested").write_bytes(_archive(root, inner + outer, b"ab"))
    assert [(r.tile_id, bytes(r.data)) for r in read(spark, tmp_path / "nested").collect()] == [(3, b"ab"), (4, b"ab")]
    circle = codec.encode_directory(np.array([[0, 0, 5, 0]]))
    (tmp_path / "circle").write_bytes(_archive(circle, circle, b""))
    with pytest.raises(Exception, match="circle"):
        read(spark, tmp_path / "circle").collect()


def test_long_runs_are_cut(spark, tmp_path):
    root = codec.encode_directory(np.array([[21845, 0, 1, 200000]]))
    (tmp_path / "run").write_bytes(_archive(root, b"", b"x", max_zoom=9))
    tiles = read(spark, tmp_path / "run")
    assert tiles.rdd.getNumPartitions() > 2 and tiles.agg(F.count("*"), F.countDistinct("tile_id"), F.min("tile_id"), F.max("tile_id")).first()[:] == (200000, 200000, 21845, 221844)


def test_strict_zoom(spark, tmp_path):
    root = codec.encode_directory(np.array([[0, 0, 1, 21]]))
    (tmp_path / "zooms").write_bytes(_archive(root, b"", b"x", min_zoom=1, max_zoom=1))
    assert read(spark, tmp_path / "zooms").count() == 4
    assert read(spark, tmp_path / "zooms", strict_zoom="false").count() == 21


def test_decompressed(spark, tmp_path):
    write_archives(tiles_of(spark, [(0, gzip.compress(b"tile"))]), str(tmp_path / "a"), tile_compression="2")
    assert bytes(read(spark, tmp_path / "a", decompress="true").first().data) == b"tile"
    assert bytes(read(spark, tmp_path / "a").first().data)[:2] == b"\x1f\x8b"


def test_changed_archives_are_noticed(spark, tmp_path):
    from tilespark.sources.archive import ArchiveReader

    write_archives(tiles_of(spark, [(0, "a")]), str(tmp_path / "a"))
    path = next((tmp_path / "a").iterdir())
    reader = ArchiveReader({"path": str(path)}, "tiles")
    (part,) = reader.partitions()
    assert next(reader.read(part)).num_rows == 1
    os.utime(path, (1, 1))
    with pytest.raises(codec.ChangedError):
        next(reader.read(part))


def test_web_ranges(spark, tmp_path):
    write_archives(tiles_of(spark, [(i, f"tile {i}") for i in range(50)]), str(tmp_path / "a"))
    data = next((tmp_path / "a").iterdir()).read_bytes()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            first, last = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
            if last >= len(data) and first == 0 and last > 1:  # as some servers answer for short files
                self.send_response(416)
                self.send_header("Content-Range", f"bytes */{len(data)}")
                self.end_headers()
                return
            body = data[first : last + 1]
            self.send_response(206)
            self.send_header("Content-Length", str(len(body)))
            self.send_header("ETag", '"1"')
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        found = read(spark, f"http://127.0.0.1:{server.server_port}/a").orderBy("tile_id").collect()
        assert [bytes(r.data).decode() for r in found] == [f"tile {i}" for i in range(50)]
    finally:
        server.shutdown()


def test_database_and_tree(spark, tmp_path):
    rows = tiles_of(spark, [(i, str(i)) for i in range(8)])
    layers = {"vector_layers": [{"id": "a"}], "tilestats": {"n": 1}, "name": "set"}
    write_archives(rows, str(tmp_path / "a"), metadata=json.dumps(layers), tile_type="1", tile_compression="2")
    convert.archive_to_database(spark, str(tmp_path / "a"), str(tmp_path / "set.db"))
    with sqlite3.connect(tmp_path / "set.db") as db:
        found = dict(db.execute("SELECT name, value FROM metadata"))
        assert json.loads(found["json"]) == {k: layers[k] for k in ("vector_layers", "tilestats")} and found["format"] == "pbf" and found["minzoom"] == "0" and found["maxzoom"] == "2"
        assert db.execute("SELECT tile_row FROM tiles WHERE zoom_level = 1 AND tile_column = 0 ORDER BY tile_data").fetchall() == [(1,), (0,)]
    convert.database_to_archive(spark, str(tmp_path / "set.db"), str(tmp_path / "b"), max_zoom=1)
    back = read(spark, tmp_path / "b", decompress="true")
    assert [(r.tile_id, bytes(r.data)) for r in back.orderBy("tile_id").collect()] == [(i, str(i).encode()) for i in range(5)]
    convert.archive_to_tree(spark, str(tmp_path / "b"), str(tmp_path / "tree"))
    assert json.loads((tmp_path / "tree" / "metadata.json").read_text())["name"] == "set"
    convert.tree_to_archive(spark, str(tmp_path / "tree"), str(tmp_path / "c"))
    assert read(spark, tmp_path / "c").count() == 5 and read(spark, tmp_path / "c", "header").first().tile_type == 1
    (tmp_path / "bare").mkdir()
    with pytest.raises(codec.ArchiveError, match="metadata.json"):
        convert.tree_to_archive(spark, str(tmp_path / "bare"), str(tmp_path / "d"))


def test_database_refuses_repeated_addresses(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 0, b"a"), (0, 0, 0, b"b")], "z int, x long, y long, data binary").coalesce(1)
    with pytest.raises(Exception, match="UNIQUE"):
        rows.write.format("tile_database").mode("append").options(path=str(tmp_path / "set.db")).save()


@pytest.mark.parametrize(("scheme", "name"), [("zxy", "3/1/2.png"), ("tms", "3/1/5.png"), ("zyx", "3/2/1.png"), ("ags", "L03/R00000002/C00000001.png"), ("gwc", "EPSG_900913_03/0_1/0001_0005.png")])
def test_tree_schemes(spark, tmp_path, scheme, name):
    from tilespark.sources.database import read_tree

    path = tmp_path / "tree" / name
    path.parent.mkdir(parents=True)
    path.write_bytes(b"x")
    (path.parent / ".DS_Store").write_bytes(b"")
    assert [tuple(r)[:3] for r in read_tree(spark, f"file://{tmp_path / 'tree'}", scheme).collect()] == [(3, 1, 2)]


def test_header_facts(spark):
    def facts_of(**pairs):
        return convert.header_facts(spark.createDataFrame(list(pairs.items()), "name string, value string")).first()

    full = facts_of(minzoom="1", maxzoom="2", bounds="-180.0,-85,180,85", center="-122.1906,37.7599,11", format="pbf")
    assert (full.min_lon_e7, full.max_lat_e7, full.center_lon_e7, full.center_lat_e7, full.center_zoom, full.tile_type, full.tile_compression) == (-1800000000, 850000000, -1221906000, 377599000, 11, 1, 2)
    bare = facts_of(minzoom="1", maxzoom="2", format="png")
    assert (bare.min_lat_e7, bare.max_lat_e7, bare.center_lon_e7, bare.center_lat_e7, bare.center_zoom) == (-850511287, 850511287, 0, 0, 1)


def test_pyramid(spark, tmp_path):
    draw = lambda z, x, y: None if z == 1 and x == 1 else f"{z}/{x}/{y}".encode()
    pyramid.build_pyramid(spark, draw, str(tmp_path / "p"), bounds=(-179.0, -80.0, 179.0, 80.0), max_zoom=2, tile_type="2")
    assert read(spark, tmp_path / "p").count() == 1 + 2 + 16
    pyramid.build_pyramid(spark, draw, str(tmp_path / "q"), bounds=(-179.0, -80.0, 179.0, 80.0), max_zoom=1, keep_empty=b"-")
    assert read(spark, tmp_path / "q").count() == 5
    for bad in ({"bounds": None}, {"min_zoom": 5, "max_zoom": 2}, {"resampling": "cubic"}):
        with pytest.raises(codec.ArchiveError):
            pyramid.build_pyramid(spark, draw, str(tmp_path / "r"), **({"bounds": (0.0, 0.0, 1.0, 1.0)} | bad))


def test_pyramid_options(spark, tmp_path):
    draw = lambda z, x, y: f"{z}/{x}/{y}".encode()
    pyramid.build_pyramid(spark, draw, str(tmp_path / "p"), bounds=(-180.0, -85.0511287798066, 180.0, 85.0511287798066), zooms="1..", size=(1024, 1024), name="n", attribution="all", layer_type="baselayer", tile_format="PNG", jobs=3)
    header, facts = read(spark, tmp_path / "p", "header").first(), json.loads(read(spark, tmp_path / "p", "metadata").first()["json"])
    assert (header.tile_type, header.min_zoom, header.max_zoom, header.addressed_tiles_count) == (2, 1, 2, 20)
    assert facts == {"name": "n", "type": "baselayer", "description": str(tmp_path / "p"), "attribution": "all", "tileSize": 256}
    ring = [[-10.0, -5.0], [30.0, -5.0], [30.0, 40.0], [-10.0, -5.0]]
    (tmp_path / "c").write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    pyramid.build_pyramid(spark, draw, str(tmp_path / "q"), cutline=f"file://{tmp_path / 'c'}", zooms="..1")
    header = read(spark, tmp_path / "q", "header").first()
    assert (header.min_lon_e7, header.max_lat_e7, header.max_zoom) == (-100000000, 400000000, 1)
    for bad in ({"layer_type": "x"}, {"tile_format": "tiff"}, {"zooms": "3..2"}):
        with pytest.raises(codec.ArchiveError):
            pyramid.build_pyramid(spark, draw, str(tmp_path / "r"), **({"bounds": (0.0, 0.0, 1.0, 1.0)} | bad))


def test_cli(spark, tmp_path, capsys):
    from tilespark.__main__ import main

    tiles = tiles_of(spark, [(i, f"t{i}") for i in range(5)]).withColumn("t", tile_id_to_zxy("tile_id")).select("t.z", "t.x", "t.y", "data")
    source = tmp_path / "set.mbtiles"
    tiles.coalesce(1).write.format("tile_database").mode("append").options(path=str(source), metadata='{"format":"png","minzoom":"0","maxzoom":"1"}').save()
    main(["convert", str(source), str(tmp_path / "out")])
    main(["show", str(tmp_path / "out")])
    assert "addressed_tiles_count" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["convert", str(source), str(tmp_path / "out")])


def test_leaves_are_packed_into_few_partitions(spark, tmp_path, monkeypatch):
    """Many leaf directories of small tiles are read by few partitions, and what a filter leaves by one."""
    from tilespark.sources import archive
    from tilespark.sources.archive import ArchiveReader

    tiles = spark.range(0, 400_000, 2).select(F.col("id").alias("tile_id"), F.xxhash64("id").cast("string").cast("binary").alias("data"))
    write_archives(tiles, str(tmp_path / "a"), 1)
    options = {"path": str(tmp_path / "a")}
    parts = ArchiveReader(options, "tiles").partitions()
    assert len(parts) == 1 and len(parts[0].entries) > 20
    found = spark.read.format("tile_archive").option("path", options["path"]).load()
    assert found.count() == 200_000 and found.where("tile_id = 199998").count() == 1
    assert found.agg(F.sum("tile_id")).first()[0] == sum(range(0, 400_000, 2))
    monkeypatch.setattr(archive, "PART_BYTES", 1 << 18)
    parts = ArchiveReader(options, "tiles").partitions()
    assert 5 < len(parts) < 30 and sum(len(list(b.to_pylist())) for p in parts for b in ArchiveReader(options, "tiles").read(p)) == 200_000
    few = ArchiveReader({**options, "only": '{"tile_id": [399998]}'}, "tiles").partitions()
    assert len(few) == 1 and len(few[0].entries) == 1
