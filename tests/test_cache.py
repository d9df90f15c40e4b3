"""The edge's response cache over a stream, and in a table."""

import datetime
import os

from pyspark.sql import functions as F

from tilespark.plans.serve import serve
from tilespark.queries import _archives
from tilespark.sources.sink import write_archives
from tilespark.streaming.cache import cached_answers, fetch_tile
from test_archives import tiles_of

DAY = datetime.datetime(2024, 1, 1)


def test_a_second_request_does_not_reach_the_tiles(spark, tmp_path):
    write_archives(tiles_of(spark, [(0, "zero"), (1, "one")]), str(tmp_path / "tiles"))
    archive = next(str(f) for f in (tmp_path / "tiles").iterdir() if f.name.startswith("part"))
    log = str(tmp_path / "log")

    def fetch(name, tile_id):
        with open(log, "a") as out:
            out.write(f"{tile_id}\n")
        return fetch_tile(archive, tile_id)

    asked = tmp_path / "asked"
    os.makedirs(asked)
    stream = spark.readStream.schema("path string, at timestamp, n long").parquet(str(asked)).withWatermark("at", "0 seconds")
    answers = serve(stream, _archives(spark), "example.com", flavor="edge")
    found = cached_answers(answers, "at", fetch, max_age=600)
    query = found.writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()

    def ask(*rows):
        # one file a micro-batch
        spark.createDataFrame([(p, DAY + datetime.timedelta(seconds=s), n) for p, s, n in rows], "path string, at timestamp, n long").coalesce(1).write.mode("append").parquet(str(asked))
        query.processAllAvailable()
        with open(log) as file:
            fetched = file.read().split()
        return fetched, {r.n: r for r in spark.table("cached").collect()}

    try:
        fetched, rows = ask(("/view/0/0/0.mvt", 0, 1), ("/view/0/0/0.mvt", 5, 2), ("/view/1/0/0.mvt", 0, 3), ("/view/1/1/1.mvt", 1, 4))
        assert sorted(fetched) == ["0", "1", "3"]
        assert [rows[n].cached for n in (1, 2, 3, 4)] == [False, True, False, False] and rows[2].age == 5 and [rows[n].status for n in (1, 2, 3, 4)] == [200, 200, 200, 204]
        assert bytes(rows[2].data) == b"zero" and rows[1].etag == rows[2].etag is not None
        fetched, rows = ask(("/view/0/0/0.mvt", 599, 5), ("/view/1/1/1.mvt", 300, 6), ("/nowhere", 300, 7))
        assert len(fetched) == 3 and rows[5].cached and rows[5].age == 599 and bytes(rows[5].data) == b"zero"
        assert rows[6].cached and rows[6].status == 204 and rows[7].status == 404 and not rows[7].cached
        fetched, rows = ask(("/view/0/0/0.mvt", 600, 8), ("/view/0/0/0.mvt", 601, 9))
        assert len(fetched) == 4 and not rows[8].cached and rows[9].cached and rows[9].age == 1
        ask(("/view/2/0/0.mvt", 5000, 10))
        ask(("/view/2/0/0.mvt", 5001, 11))  # the watermark has passed the end of the first ones
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    finally:
        query.stop()


def test_places_and_what_is_not_kept(spark):
    rows = [("/view/0/0/0.mvt", DAY + datetime.timedelta(seconds=i), i) for i in range(200)] + [(None, DAY, -1), (None, DAY, -2), ("/view/0/0/0.mvt", DAY, None)]
    answers = serve(spark.createDataFrame(rows, "path string, at timestamp, n long"), _archives(spark), "example.com", flavor="edge")
    found = cached_answers(answers, "at", lambda archive, tile_id: b"x", places=4)
    assert found.columns[-5:] == ["content_type", "data", "etag", "cached", "age"]
    counts = {(r.status, r.cached): r["count"] for r in found.groupBy("status", "cached").count().collect()}
    assert counts == {(200, False): 4, (200, True): 197, (404, False): 2}
    assert cached_answers(answers.where(F.lit(False)), "at").count() == 0


def test_requests_of_one_address_pass_in_batches(spark, tmp_path):
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    log = str(tmp_path / "log")

    def fetch(archive, tile_id):
        import sys

        frame = sys._getframe(1)
        while "rows" not in frame.f_locals:
            frame = frame.f_back
        with open(log, "a") as out:
            out.write(f"{len(frame.f_locals['rows'])}\n")
        return b"x"

    rows = [("/view/0/0/0.mvt", DAY + datetime.timedelta(minutes=i), i) for i in range(3000)]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        answers = serve(spark.createDataFrame(rows, "path string, at timestamp, n long").repartition(7), _archives(spark), "example.com", flavor="edge")
        found = {r.n: r for r in cached_answers(answers, "at", fetch).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert sorted(n for n, r in found.items() if not r.cached) == [0, 1440, 2880] and len(found) == 3000
    assert all(r.age == n % 1440 * 60 for n, r in found.items())
    with open(log) as file:
        assert max(map(int, file.read().split())) <= 100
