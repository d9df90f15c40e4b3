"""Commits that stop anywhere, manifests, requests of web reads, and archives that change under a plan."""

import http.server
import os
import re
import threading
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType
from test_archives import _archive, read, tiles_of

from tilespark.functions.hilbert import LEVEL_STARTS
from tilespark.sources import codec, manifest
from tilespark.sources.archive import SESSION, ArchiveReader, planned_anew, read_tiles
from tilespark.sources.ranges import WebRanges
from tilespark.sources.sink import ArchiveWriter, write_archives
from tilespark.sources.stores import LocalFolder

SCHEMA = StructType([StructField("tile_id", LongType()), StructField("data", BinaryType())])


def written(folder, ids, word, overwrite=False, files=2):
    """A writer and the messages of its tasks, not committed yet."""
    writer = ArchiveWriter({"path": str(folder), "append": "true"}, SCHEMA, overwrite)
    parts = np.array_split(np.array(ids), files)
    batches = [pa.RecordBatch.from_arrays([pa.array(p), pa.array([f"{word} {i}".encode() for i in p.tolist()])], ["tile_id", "data"]) for p in parts]
    messages = [writer.write(iter([b])) for b in batches]
    for i, m in enumerate(m for m in messages if m.staged):
        m.name = re.sub(r"part-\d+", f"part-{i:05d}", m.name)
    return writer, messages


def tiles_in(folder):
    reader = ArchiveReader({"path": str(folder)}, "tiles")
    return sorted(d.as_py().decode() for p in reader.partitions() for b in reader.read(p) for d in b.column("data"))


class Stopped(Exception):
    pass


@pytest.mark.parametrize("first", ["none", "manifest", "no manifest"])
@pytest.mark.parametrize("overwrite", [True, False])
def test_a_commit_that_stops_leaves_all_or_nothing(tmp_path, monkeypatch, first, overwrite):
    new = [f"new {i}" for i in range(10, 20)]
    for stop in range(40):
        folder = tmp_path / f"{first} {overwrite} {stop}"
        before = []
        if first != "none":
            writer, messages = written(folder, range(10), "old")
            writer.commit(messages)
            before = [f"old {i}" for i in range(10)]
            if first == "no manifest":
                for f in folder.glob("_archives-*"):
                    f.unlink()
        writer, messages = written(folder, range(10, 20), "new", overwrite)
        calls = 0
        with monkeypatch.context() as patch:
            for name in ("replace", "link", "remove", "fsync"):

                def stopping(*args, own=getattr(os, name)):
                    nonlocal calls
                    calls += 1
                    if calls > stop:
                        raise Stopped
                    return own(*args)

                patch.setattr(os, name, stopping)
            try:
                writer.commit(messages)
                done = True
            except Stopped:
                done = False
        after = sorted(new if overwrite else before + new)
        assert tiles_in(folder) in ([after] if done else [sorted(before), after])
        if not done:
            whole = tiles_in(folder)
            writer.abort(messages)
            manifest.vacuum(str(folder))
            assert tiles_in(folder) == whole
            # the next write goes on from there
            writer, messages = written(folder, range(20, 30), "next", overwrite)
            writer.commit(messages)
            assert tiles_in(folder) == sorted([f"next {i}" for i in range(20, 30)] + ([] if overwrite else whole))
        if done:
            assert stop > 3
            return
    raise AssertionError("a commit takes more steps than were tried")


def test_overwriting_with_nothing_keeps_what_there_is(spark, tmp_path):
    write_archives(tiles_of(spark, [(0, "a"), (1, "b")]), str(tmp_path / "a"))
    with pytest.raises(Exception, match="no tiles to write"):
        write_archives(tiles_of(spark, []), str(tmp_path / "a"), 1, mode="overwrite")
    assert tiles_in(tmp_path / "a") == ["a", "b"] and not [f for f in os.listdir(tmp_path / "a") if f.startswith(".")]
    (tmp_path / "a" / "own").write_bytes((next(f for f in (tmp_path / "a").iterdir() if f.name.startswith("part-"))).read_bytes())
    write_archives(tiles_of(spark, [(2, "c")]), str(tmp_path / "a"), 1, mode="overwrite")
    assert tiles_in(tmp_path / "a") == ["a", "b", "c"]  # files of other origin stay and are read


def test_two_writers_lose_nothing_of_each_other(tmp_path, monkeypatch):
    writer, messages = written(tmp_path / "a", range(5), "old")
    writer.commit(messages)
    one, of_one = written(tmp_path / "a", range(5, 10), "one")
    two, of_two = written(tmp_path / "a", range(10, 15), "two")
    create = LocalFolder.create

    def late(self, name, write):  # the other commits when this one has read the manifest
        monkeypatch.setattr(LocalFolder, "create", create)
        two.commit(of_two)
        return create(self, name, write)

    monkeypatch.setattr(LocalFolder, "create", late)
    one.commit(of_one)
    assert len(tiles_in(tmp_path / "a")) == 15


def test_a_reader_during_an_overwrite_gets_the_new_set(spark, tmp_path):
    folder = tmp_path / "a"
    writer, messages = written(folder, range(10), "old")
    writer.commit(messages)
    reader = ArchiveReader({"path": str(folder)}, "tiles")
    parts = reader.partitions()
    writer, messages = written(folder, range(10), "new", True)
    writer.commit(messages)
    with pytest.raises(codec.ChangedError):
        [list(reader.read(p)) for p in parts]

    runs = []

    def query():
        df = read(spark, folder)
        rows = df.select("tile_id", F.col("data").cast("string").alias("data"))
        rows.explain()  # the plan is made here, and pinned
        if not runs:
            writer, messages = written(folder, range(10), "newest", True)
            writer.commit(messages)
        runs.append(1)
        return sorted(r.data for r in rows.collect())

    assert planned_anew(query) == [f"newest {i}" for i in range(10)]


def test_an_archive_that_changes_is_planned_anew(tmp_path):
    def put(word, ids):
        root = codec.encode_directory(np.array([[i, 4 * k, 4, 1] for k, i in enumerate(ids)]))
        (tmp_path / "staged").write_bytes(_archive(root, b"", b"".join(b"%s%03d" % (word, i) for i in ids)))
        os.replace(tmp_path / "staged", tmp_path / "a")

    def tiles(reader, parts):
        return [bytes(d.as_py()) for p in parts for b in reader.read(p) for d in b.column("data")]

    for on_change in ("error", "replan"):
        put(b"x", range(20))
        reader = ArchiveReader({"path": str(tmp_path / "a"), "on_change": on_change}, "tiles")
        parts = reader.partitions()
        assert [p.alone for p in parts] == [True] and tiles(reader, parts)[3] == b"x003"
        put(b"y", range(10, 30))
        if on_change == "error":
            with pytest.raises(codec.ChangedError):
                tiles(reader, parts)
        else:
            assert tiles(reader, parts) == [b"y%03d" % i for i in range(10, 30)]
    # a task that has begun reads its version to the end
    put(b"x", range(20))
    reader = ArchiveReader({"path": str(tmp_path / "a")}, "tiles")
    batches = reader.read(reader.partitions()[0])
    first = next(batches)
    put(b"y", range(20))
    assert [bytes(d.as_py())[:1] for b in (first, *batches) for d in b.column("data")] == [b"x"] * 20


class Store:
    """A server of files by address, with strong tags, that counts its answers."""

    def __init__(self, files, conditional=True):
        self.files, self.asked, store = dict(files), [], self

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                data = store.files[self.path]
                first, last = map(int, self.headers["Range"].removeprefix("bytes=").split("-"))
                tag = f'"{hash(data)}"'
                store.asked.append((self.path, first))
                if conditional and self.headers.get("If-Match", tag) != tag:
                    self.send_response(412)
                    self.end_headers()
                    return
                body = data[first : last + 1]
                self.send_response(206)
                self.send_header("Content-Length", str(len(body)))
                self.send_header("ETag", tag)
                self.end_headers()
                self.wfile.write(body)

            def log_message(self, *_):
                pass

        self.server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.at = f"http://127.0.0.1:{self.server.server_port}"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def count(self, query):
        before = len(self.asked)
        return query(), len(self.asked) - before


def small(word, ids):
    """An archive whose tiles are in its root directory."""
    root = codec.encode_directory(np.array([[i, 4 * k, 4, 1] for k, i in enumerate(ids)]))
    return _archive(root, b"", b"".join(b"%s%03d" % (word, i) for i in ids))


def leafy(first, count, data=b"tile"):
    """An archive with all its tiles below one leaf, over many zooms."""
    leaf = codec.encode_directory(np.array([[first + i, 4 * i, 4, 1] for i in range(count)]))
    root = codec.encode_directory(np.array([[first, 0, len(leaf), 0]]))
    return _archive(root, leaf, b"".join(b"%04d" % ((first + i) % 10000) for i in range(count)), max_zoom=12)


@pytest.mark.parametrize("conditional", [True, False])
def test_requests_of_a_web_read(spark, conditional):
    SESSION.held.clear()
    store = Store({"/a": small(b"x", range(30)), "/b": leafy(0, 20)}, conditional)
    get = lambda name, **only: [bytes(r.data) for r in read_tiles(spark, f"{store.at}/{name}", **only).collect()]
    assert store.count(lambda: get("a", z=0, x=0, y=0)) == ([b"x000"], 2)  # header and root, tile
    assert store.count(lambda: get("a", z=0, x=0, y=0)) == ([b"x000"], 1)
    assert store.count(lambda: get("a", tile_id=[17])) == ([b"x017"], 1)
    assert store.count(lambda: get("a", tile_id=500)) == ([], 0)
    assert store.count(lambda: get("b", tile_id=[5])) == ([b"0005"], 3)  # a leaf too
    assert store.count(lambda: get("b", tile_id=[6, 7])) == ([b"0006", b"0007"], 1)
    store.files["/a"] = small(b"y", range(30))
    assert store.count(lambda: get("a", z=0, x=0, y=0)) == ([b"y000"], 3)  # refused, header and root again, tile
    whole = store.count(lambda: read(spark, f"{store.at}/b").count())
    assert whole == (20, 3)  # planning and its one task ask nothing twice
    assert store.count(lambda: read(spark, f"{store.at}/a").count()) == (30, 2)
    store.server.shutdown()


def test_a_silent_server_is_given_up(monkeypatch):
    import socket

    with socket.create_server(("127.0.0.1", 0)) as silent:
        monkeypatch.setattr(WebRanges, "TIMEOUT", 0.3)
        began = time.monotonic()
        with pytest.raises(OSError):
            WebRanges(f"http://127.0.0.1:{silent.getsockname()[1]}/a").read(0, 10)
        assert time.monotonic() - began < 5


def test_one_address_in_a_thousand_archives(spark, tmp_path):
    at = lambda i: LEVEL_STARTS[12] + 1000 * i
    store = Store({f"/{i}": leafy(at(i), 20) for i in range(1000)})
    out = str(tmp_path / "manifest")
    manifest.write_manifest(spark, [f"{store.at}/{i}" for i in range(1000)], out)
    rows = spark.read.parquet(out)
    assert rows.count() == 1000 and rows.agg(F.min("first_id"), F.max("end_id"), F.sum("leaves")).first()[:] == (at(0), at(999) + 20, 1000)
    get = lambda **only: read_tiles(spark, options={"manifest": out}, **only)
    found, asked = store.count(lambda: [r.tile_id for r in get(tile_id=at(417) + 3).collect()])
    assert found == [at(417) + 3] and asked == 3 and {p for p, _ in store.asked[-3:]} == {"/417"}  # header and root, leaf, tile
    assert store.count(lambda: get(tile_id=at(417) + 30).count()) == (0, 0)
    assert store.count(lambda: get(z=3).count()) == (0, 0)
    # all of them: planning asks nothing, each task its header, leaf and tiles
    found, asked = store.count(lambda: get().agg(F.count("*"), F.countDistinct("tile_id"), F.countDistinct("archive")).first()[:])
    assert found == (20_000, 20_000, 1000) and asked == 3000
    store.server.shutdown()


def test_manifests_of_folders_leave_archives_out(spark, tmp_path):
    tiles = spark.range(0, 9000).select(F.col("id").alias("tile_id"), F.xxhash64("id").cast("string").cast("binary").alias("data"))
    write_archives(tiles, str(tmp_path / "a"), 80)
    rows = manifest.current(str(tmp_path / "a"))
    assert len(rows) == len({r["archive"] for r in rows}) > PLANNED_AT_LEAST and sum(r["tiles"] for r in rows) == 9000
    assert all(r["first_id"] < r["end_id"] for r in rows) and sorted(r["end_id"] for r in rows)[:-1] == sorted(r["first_id"] for r in rows)[1:]
    assert read(spark, tmp_path / "a").agg(F.sum("tile_id")).first()[0] == sum(range(9000))
    assert read_tiles(spark, str(tmp_path / "a"), from_id=100, below_id=8000).count() == 7900
    for f in (tmp_path / "a").glob("part-*"):  # what cannot match is not opened
        row = next(r for r in rows if r["archive"] == f.name)
        if not row["first_id"] <= 4500 < row["end_id"]:
            f.write_bytes(b"broken")
    assert read_tiles(spark, str(tmp_path / "a"), tile_id=4500).count() == 1


PLANNED_AT_LEAST = 64


def test_commas_in_paths(spark, tmp_path):
    for name in ("a,b", "c"):
        write_archives(tiles_of(spark, [(0, name)]), str(tmp_path / name))
    assert read(spark, tmp_path / "a,b").count() == 1
    assert read(spark, f"{tmp_path / 'a,b'}, {tmp_path / 'c'}").count() == 2
