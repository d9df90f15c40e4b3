"""Object stores in both directions: an in-process one, and one that tasks share."""

import hashlib

import pytest
from test_archives import read, tiles_of
from test_manifests import tiles_in, written

from tilespark.sources import codec, manifest
from tilespark.sources.archive import ArchiveReader, read_tiles
from tilespark.sources.sink import write_archives
from tilespark.sources.stores import STORES


class Memory:
    def __init__(self):
        self.held, self.asked, self.late = {}, [], None

    def get(self, key, start, length, version=None):
        self.asked.append(key)
        if key not in self.held:
            raise FileNotFoundError(key)
        data = self.held[key]
        tag = hashlib.md5(data).hexdigest()
        if version not in (None, tag):
            raise codec.ChangedError(key)
        return data[start : start + length], tag

    def put(self, key, data, absent=False):
        if absent and self.late:
            late, self.late = self.late, None
            late()
        if absent and key in self.held:
            raise FileExistsError(key)
        self.held[key] = data.read()
        return hashlib.md5(self.held[key]).hexdigest()

    def names(self, prefix):
        return [k for k in self.held if k.startswith(prefix)]

    def delete(self, key):
        self.held.pop(key, None)


@pytest.fixture
def store(monkeypatch):
    store = Memory()
    monkeypatch.setitem(STORES, "mem://", store)
    return store


def test_both_directions_in_process(store):
    folder = "mem://bucket/a"
    writer, messages = written(folder, range(10), "old")
    assert manifest.current(folder) == [] and ArchiveReader({"path": folder}, "tiles").partitions() == []
    writer.commit(messages)
    assert tiles_in(folder) == [f"old {i}" for i in range(10)]
    # half a write is not seen, and goes
    writer, messages = written(folder, range(10, 20), "new", True)
    assert tiles_in(folder) == [f"old {i}" for i in range(10)]
    writer.abort(messages)
    assert len(store.held) == 4 and tiles_in(folder) == [f"old {i}" for i in range(10)]
    reader = ArchiveReader({"path": folder}, "tiles")
    parts = reader.partitions()
    writer, messages = written(folder, range(10, 20), "new", True)
    writer.commit(messages)
    assert tiles_in(folder) == [f"new {i}" for i in range(10, 20)]
    with pytest.raises(codec.ChangedError):
        [list(reader.read(p)) for p in parts]
    (kept,) = [f"{folder}/{r['archive']}" for r in manifest.current(folder) if r["first_id"] == 10]
    assert tiles_in(kept) == [f"new {i}" for i in range(10, 15)]
    # an archive that is another one by now is planned anew where that is asked for
    reader = ArchiveReader({"path": kept, "on_change": "replan"}, "tiles")
    (part,) = reader.partitions()
    writer, messages = written("mem://bucket/b", range(3), "other", files=1)
    writer.commit(messages)
    store.held[kept] = next(v for k, v in store.held.items() if "/b/part" in k)
    assert [bytes(d.as_py()) for b in reader.read(part) for d in b.column("data")] == [b"other 0", b"other 1", b"other 2"]


def test_writers_of_one_store_lose_nothing_of_each_other(store):
    folder = "mem://bucket/a"
    writer, messages = written(folder, range(5), "old")
    writer.commit(messages)
    one, of_one = written(folder, range(5, 10), "one")
    two, of_two = written(folder, range(10, 15), "two")
    store.late = lambda: two.commit(of_two)
    one.commit(of_one)
    assert len(tiles_in(folder)) == 15


def test_requests_of_a_store(store):
    writer, messages = written("mem://bucket/a", range(10), "old", files=1)
    writer.commit(messages)
    (key,) = [k for k in store.held if "part" in k]
    store.asked.clear()
    assert tiles_in(key) == [f"old {i}" for i in range(10)] and store.asked == [key, key]


def test_tasks_write_and_read_a_store(spark, tmp_path):
    folder, how = f"disk://{tmp_path}/a", {"stores": "tests.disk_store:register"}
    write_archives(tiles_of(spark, [(i, f"tile {i}") for i in range(100)]), folder, 3, **how)
    assert sorted(bytes(r.data).decode() for r in read(spark, folder, **how).collect()) == sorted(f"tile {i}" for i in range(100))
    assert [bytes(r.data) for r in read_tiles(spark, folder, tile_id=[17], options=how).collect()] == [b"tile 17"]
    with pytest.raises(Exception, match="exists"):
        write_archives(tiles_of(spark, [(0, "x")]), folder, 1, **how)
    write_archives(tiles_of(spark, [(0, "x")]), folder, 1, mode="overwrite", **how)
    write_archives(tiles_of(spark, [(1, "y")]), folder, 1, mode="append", **how)
    with pytest.raises(Exception, match="no tiles"):
        write_archives(tiles_of(spark, []), folder, 1, mode="overwrite", **how)
    assert sorted(bytes(r.data) for r in read(spark, folder, **how).collect()) == [b"x", b"y"]
    assert len([f for f in (tmp_path / "a").iterdir() if f.name.startswith("part")]) == 2
