"""Archives that several tasks write together, against those that one task writes."""

import pytest

from tilespark.session import register
from tilespark.sources import sink
from tilespark.sources.manifest import current
from tilespark.sources.sink import write_archives


def rows_of(spark, n=4000):
    # runs of ten ids with one content, also over the seams of parts, one long run, contents that come again, and gaps
    return spark.range(n).where("id % 500 <> 250").selectExpr("id AS tile_id", "CASE WHEN id BETWEEN 1000 AND 2600 THEN 'same' WHEN id % 40 < 10 THEN 'a' ELSE concat('content ', id div 10 % 90) END AS data")


def facts(spark, path):
    read = lambda table: register(spark).read.format("tile_archive").options(path=path, table=table).load()
    header = read("header").drop("archive", "root_length", "metadata_offset", "leaf_directory_offset", "leaf_directory_length", "tile_data_offset")
    return (
        sorted(map(tuple, header.collect())), sorted(map(tuple, read("entries").where("run_length > 0").select("tile_id", "offset", "length", "run_length").collect())),
        sorted((r.tile_id, bytes(r.data)) for r in read("tiles").select("tile_id", "data").collect()),
    )


@pytest.mark.parametrize("layout", ["header_first", "data_first"])
def test_tasks_write_one_archive_together(spark, tmp_path, monkeypatch, layout):
    rows = rows_of(spark)
    write_archives(rows, str(tmp_path / "one"), 1, layout=layout)
    monkeypatch.setattr(sink, "TASK_TILES", 500)
    tasks = []
    whole = sink._write_together
    monkeypatch.setattr(sink, "_write_together", lambda rows, path, archives, shares, *more: (tasks.append(archives * shares), whole(rows, path, archives, shares, *more)))
    write_archives(rows, str(tmp_path / "many"), 1, layout=layout)
    assert tasks == [8] and len(current(str(tmp_path / "many"))) == 1
    assert facts(spark, str(tmp_path / "one")) == facts(spark, str(tmp_path / "many"))


def test_more_leaves_than_a_root_holds_and_two_archives(spark, tmp_path, monkeypatch):
    rows = spark.range(30000).selectExpr("id * 3 AS tile_id", "concat('content ', id * 7919 % 30011) AS data")
    monkeypatch.setattr(sink, "TASK_TILES", 4000)
    monkeypatch.setattr(sink, "LEAF_ENTRIES", 4)
    write_archives(rows, str(tmp_path / "two"), 2)
    assert len(current(str(tmp_path / "two"))) == 2
    found = register(spark).read.format("tile_archive").option("path", str(tmp_path / "two")).load()
    assert sorted((r.tile_id, bytes(r.data).decode()) for r in found.collect()) == sorted(map(tuple, rows.collect()))


def test_faults_leave_the_folder_as_it_was(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "a")
    write_archives(rows_of(spark, 100), path, 1)
    before = facts(spark, path)
    monkeypatch.setattr(sink, "TASK_TILES", 10)
    twice = rows_of(spark, 100).unionAll(rows_of(spark, 5))
    with pytest.raises(Exception, match="comes twice"):
        write_archives(twice, path, 1, mode="overwrite")
    with pytest.raises(Exception, match="has no bytes"):
        write_archives(rows_of(spark, 100).selectExpr("tile_id", "CASE WHEN tile_id <> 7 THEN data ELSE '' END AS data"), path, 1, mode="overwrite")
    assert facts(spark, path) == before and not [f.name for f in (tmp_path / "a").iterdir() if f.name.startswith(".")]
    write_archives(rows_of(spark, 100), path, 2, mode="overwrite")
    assert facts(spark, path)[2] == before[2] and len(current(path)) == 2
