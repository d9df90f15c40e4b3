"""Version 2 gets, kinds told by content, and TileJSON over a local server."""

import http.server
import json
import sqlite3
import struct
import threading
import time

import pytest

from tilespark.sources import tile_json
from tilespark.sources.archive_v2 import ENTRY_V2, ReaderV2, get_tiles
from tilespark.sources.codec import ArchiveError
from tilespark.sources.probe import kind_of, open_tiles
from tilespark.sources.ranges import SOURCES, FileRanges
from tilespark.sources.sink import write_archives
from tilespark.sources.tile_json import read_document, read_tile_json
from test_archives import tiles_of


def entry(z, x, y, offset, length):
    return bytes([z]) + x.to_bytes(3, "little") + y.to_bytes(3, "little") + offset.to_bytes(6, "little") + length.to_bytes(4, "little")


def old_archive(path):
    """Zooms 0 to 2 in the root, zoom 4 below leaves of zoom 2; the tiles of an odd leaf are missing."""
    payload, own, pointers = bytearray(), [], []
    for z in range(3):
        for x in range(1 << z):
            for y in range(1 << z):
                own.append(entry(z, x, y, 512000 + len(payload), 8))
                payload += f"{z}/{x}/{y}".ljust(8).encode()
    for lx in range(4):
        for ly in range(4):
            if (lx + ly) % 2:
                continue
            leaf = b""
            for x in range(4 * lx, 4 * lx + 4):
                for y in range(4 * ly, 4 * ly + 4):
                    leaf += entry(4, x, y, 512000 + len(payload), 8)
                    payload += f"4/{x}/{y}".ljust(8).encode()
            pointers.append(entry(128 | 2, lx, ly, 512000 + len(payload), len(leaf)))
            payload += leaf
    head = b"PM" + struct.pack("<HIH", 2, 2, len(own) + len(pointers)) + b"{}" + b"".join(own + pointers)
    path.write_bytes(head.ljust(512000, b"\0") + bytes(payload))


def test_version_2_gets_read_one_leaf(spark, tmp_path, monkeypatch):
    old_archive(tmp_path / "old")
    asked = [(4, 5, 5), (4, 6, 7), (4, 0, 4), (1, 1, 0), (3, 0, 0), (9, 0, 0), (0, 0, 0)]
    found = {(r.z, r.x, r.y): bytes(r.data).decode().strip() for r in get_tiles(spark, str(tmp_path / "old"), asked).collect()}
    assert found == {(4, 5, 5): "4/5/5", (4, 6, 7): "4/6/7", (1, 1, 0): "1/1/0", (0, 0, 0): "0/0/0"}
    assert spark.read.format("tile_archive_v2").option("path", str(tmp_path / "old")).load().count() == 21 + 8 * 16
    reads = []

    class Counted(FileRanges):
        def read(self, offset, length):
            reads.append(length)
            return super().read(offset, length)

    monkeypatch.setitem(SOURCES, "", Counted)
    reader = ReaderV2({"path": str(tmp_path / "old"), "only": json.dumps([[4, 5, 5]])})
    (part,) = reader.partitions()
    assert sum(b.num_rows for b in reader.read(part)) == 1
    assert len(reads) == 4 and reads[2:] == [16 * ENTRY_V2, 8]  # head, root, one leaf, one tile
    assert ReaderV2({"path": str(tmp_path / "old"), "only": "[[4, 0, 4], [9, 200, 9]]"}).partitions() == []


def test_kinds(spark, tmp_path):
    write_archives(tiles_of(spark, [(0, "a"), (3, "b")]), str(tmp_path / "folder"))
    archive = next(f for f in (tmp_path / "folder").iterdir() if f.name.startswith("part"))
    old_archive(tmp_path / "name.json")  # names say nothing
    with sqlite3.connect(tmp_path / "database") as db:
        db.execute("CREATE TABLE tiles (zoom_level, tile_column, tile_row, tile_data)")
        db.execute("INSERT INTO tiles VALUES (1, 0, 1, X'61')")
    (tmp_path / "document").write_bytes(b"\xef\xbb\xbf \n" + json.dumps({"tiles": ["0/{z}/{x}/{y}"], "maxzoom": 1}).encode())
    (tmp_path / "tree").mkdir()
    (tmp_path / "tree" / "metadata.json").write_text("{}")
    (tmp_path / "junk").write_text("junk")
    kinds = {"folder": "folder", "name.json": "archive_v2", "database": "database", "document": "tile_json", "tree": "tree"}
    assert {name: kind_of(str(tmp_path / name)) for name in kinds} == kinds and kind_of(str(archive)) == kind_of(f"file://{archive}") == "archive"
    with pytest.raises(ArchiveError):
        kind_of(str(tmp_path / "junk"))
    counts = {"folder": 2, "name.json": 149, "database": 1, "document": 0}
    assert {name: open_tiles(spark, str(tmp_path / name)).count() for name in counts} == counts
    assert [tuple(r)[:4] for r in open_tiles(spark, str(tmp_path / "database")).collect()] == [(1, 1, 0, 0)]


def test_tile_json(spark, monkeypatch):
    state = {"now": 0, "most": 0, "asked": 0, "failed": set()}
    lock = threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                state["now"] += 1
                state["most"] = max(state["most"], state["now"])
                state["asked"] += 1
            try:
                if self.path == "/set.json":
                    status, body = 200, json.dumps({"tilejson": "3.0.0", "tiles": ["tiles/{z}/{x}/{y}.png", f"http://localhost:{self.server.server_port}/tiles/{{z}}/{{x}}/{{y}}.png"], "minzoom": 1, "maxzoom": 4, "bounds": [0.0, -60.0, 179.9, 60.0]}).encode()
                else:
                    time.sleep(0.005)
                    z, x, y = self.path.removeprefix("/tiles/").removesuffix(".png").split("/")
                    status, body = (404, b"") if x == y else (204, b"") if x == "9" else (200, self.path.encode())
                    with lock:
                        if x == "10" and self.path not in state["failed"]:  # once only
                            state["failed"].add(self.path)
                            status = 503
                self.send_response(status)
                self.send_header("Content-Length", str(len(body) if status == 200 else 0))
                self.end_headers()
                self.wfile.write(body if status == 200 else b"")
            finally:
                with lock:
                    state["now"] -= 1

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    address = f"http://127.0.0.1:{server.server_port}/set.json"
    assert read_document(address)["tiles"][0] == f"http://127.0.0.1:{server.server_port}/tiles/{{z}}/{{x}}/{{y}}.png"
    from tilespark.operators.navigate import bbox_cover

    box = spark.createDataFrame([(0.0, -60.0, 179.9, 60.0)], "west double, south double, east double, north double")
    cover = {(r.z, r.x, r.y) for r in bbox_cover(box, 1, 4).collect()}
    found = {(r.z, r.x, r.y): bytes(r.data).decode() for r in read_tile_json(spark, address, lanes=1).collect()}
    assert found == {(z, x, y): f"/tiles/{z}/{x}/{y}.png" for z, x, y in cover if x != y and x != 9}
    assert state["most"] <= 2  # one for each of two hosts
    assert kind_of(address) == "tile_json"
    assert {r.z for r in open_tiles(spark, address, min_zoom="2", max_zoom="2").collect()} == {2}
    assert read_tile_json(spark, address, min_zoom=7, max_zoom=9).count() == 0
    assert read_tile_json(spark, address, bounds="10,10,11,11").select("z").distinct().count() == 4
    monkeypatch.setattr(tile_json, "TRIES", 1)
    state["failed"].clear()
    with pytest.raises(ArchiveError):
        tile_json._fetch(f"http://127.0.0.1:{server.server_port}/tiles/4/10/3.png", 1)
    server.shutdown()


def test_tile_json_rows_turned_round(spark, tmp_path):
    (tmp_path / "1" / "0").mkdir(parents=True)
    (tmp_path / "1" / "0" / "0").write_text("south")
    (tmp_path / "doc").write_text(json.dumps({"scheme": "tms", "tiles": ["{z}/{x}/{y}"], "minzoom": 1, "maxzoom": 1}))
    assert [(r.z, r.x, r.y, bytes(r.data)) for r in read_tile_json(spark, str(tmp_path / "doc")).collect()] == [(1, 0, 1, b"south")]
    (tmp_path / "doc").write_text(json.dumps({"tiles": ["{z}/{x}/{y}"]}))
    with pytest.raises(ArchiveError):
        read_tile_json(spark, str(tmp_path / "doc"))
