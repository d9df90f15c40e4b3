"""Tile sets of several databases, trees that tasks list, and archives of a bounded size."""

import pytest

from tilespark.plans import convert
from tilespark.session import register
from tilespark.sources import database
from tilespark.sources.database import read_tree, write_database, write_tree
from tilespark.sources.manifest import current
from tilespark.sources.probe import kind_of, open_tiles
from tilespark.sources.sink import write_archives


def tiles_of(spark, n=340):
    from tilespark.functions.hilbert import tile_id_to_zxy

    return spark.range(n).selectExpr("id AS tile_id", "cast(concat('tile ', id) AS binary) AS data").withColumn("t", tile_id_to_zxy("tile_id")).select("t.z", "t.x", "t.y", "data")


def content(rows):
    return sorted((r.z, r.x, r.y, bytes(r.data)) for r in rows.select("z", "x", "y", "data").collect())


def test_databases_of_one_name(spark, tmp_path, monkeypatch):
    tiles, path = tiles_of(spark), str(tmp_path / "set.mbtiles")
    monkeypatch.setattr(database, "DATABASE_BYTES", 1000)
    write_database(tiles, path, '{"format":"png","minzoom":"0","maxzoom":"4"}')
    assert sorted(f.name for f in tmp_path.iterdir()) == [f"set-{i:05d}.mbtiles" for i in range(3)] and kind_of(path) == "database"
    assert content(open_tiles(spark, path)) == content(tiles)
    convert.database_to_archive(spark, path, str(tmp_path / "back"))
    assert content(register(spark).read.format("tile_archive").option("path", str(tmp_path / "back")).load()) == content(tiles)
    with pytest.raises(Exception, match="FileExists|set.mbtiles"):
        write_database(tiles, path)
    write_database(tiles.where("z < 2"), path, databases=1, mode="overwrite")
    assert [f.name for f in tmp_path.iterdir() if f.is_file()] == ["set.mbtiles"] and len(content(open_tiles(spark, path))) == 5


def test_trees_are_listed_by_tasks_and_only_asked_zooms_are_read(spark, tmp_path):
    tiles, out = tiles_of(spark), tmp_path / "tree"
    write_tree(tiles, str(out), ".png", '{"format":"png"}')
    for hidden in ("4/0/_x.png", "4/_0/1.png", ".4/0/0.png"):
        (out / hidden).parent.mkdir(exist_ok=True, parents=True)
        (out / hidden).write_bytes(b"no")
    assert content(read_tree(spark, f"file://{out}")) == content(tiles)
    for unread in (out / "4").rglob("*.png"):  # a link to nothing can be listed, not read
        unread.unlink()
        unread.mkdir()
    assert content(read_tree(spark, str(out), "zxy", 1, 3)) == content(tiles.where("z BETWEEN 1 AND 3"))
    assert read_tree(spark, f"file://{out}", max_zoom=3)._jdf.queryExecution().toString().count("binaryFile") == 0
    assert database.tree_zooms(spark, str(out), "zxy", 1, 9) == (1, 3)


def test_archives_of_a_bounded_size(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id AS tile_id", "cast(concat('tile ', id) AS binary) AS data")
    write_archives(rows, str(tmp_path / "a"), 2, archive_bytes=1000)
    found = current(str(tmp_path / "a"))
    assert len(found) == 8 and sum(r["tiles"] for r in found) == 1000
