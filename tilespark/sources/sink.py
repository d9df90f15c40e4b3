"""Writing archives: each task streams its rows into one archive of its own.

A 100 TB tile set is a folder of archives, each over a range of tile ids, written side
by side by the tasks; nothing passes through the driver but the names of the files. One
partition gives one archive file. ``write_archives`` deals the rows out that way, over as
many archives as their bytes ask for. Archives that hold more than ``TASK_BYTES`` or ``TASK_TILES`` each
are written by several tasks each (``_write_together``), in a mounted folder, so neither what a task reads nor
what it holds grows with the tile set or depends on the number of archives.

In a task, equal contents are stored once (by SHA-256), neighbouring ids with equal
contents become one entry, and the entries are packed into a root directory of at most
16,257 bytes, with leaf directories if need be. Files are staged under hidden names, named when
the job commits, and part of the folder when its manifest names them, all at once; what they
replace is removed after that. A job that fails, wherever it stops, leaves the folder as it was.

Options: ``path``, ``metadata`` (a JSON object), ``tile_type``, ``tile_compression``,
``internal_compression`` (numbers as in the format), ``bounds`` and ``center``
(degrees, parted by commas), ``layout`` (header_first or data_first), ``on_duplicate``
(error or first), ``allow_empty``, ``suffix`` (of the file names, such as ``.tiles``),
``stores`` (what registers object stores, see ``sources.stores``).
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from tilespark.functions.hilbert import END, LEVEL_STARTS
from tilespark.schema import FIRST_READ_BYTES, HEADER_BYTES, LEAF_ENTRIES, MAX_ROOT_BYTES
from tilespark.shared import discard, settle
from tilespark.sources.codec import ArchiveError, compress, encode_directory, encode_header
from tilespark.sources.manifest import current, cuts_of, publish
from tilespark.sources.ranges import FileRanges
from tilespark.sources.stores import StoreFolder, folder_of, registered, store_of

#: Bytes and tiles of an archive where no number of archives is asked for.
ARCHIVE_BYTES, ARCHIVE_TILES = 1 << 30, 1 << 22
#: About so many bytes of tiles are one partition of a scan.
SHARE_BYTES = 1 << 27
#: Bytes and tiles that one task writes; archives of more are written by several tasks.
TASK_BYTES, TASK_TILES = 1 << 26, 1 << 20


def pack_directories(entries: np.ndarray, compression: int = 2, most: int = MAX_ROOT_BYTES, leaf_entries: int = LEAF_ENTRIES, allow_empty: bool = False) -> tuple[bytes, bytes]:
    """The root directory and the leaf directories, one after the other, of sorted entries.

    Everything is in the root if it fits; else leaves get twice as many entries until
    their pointers do.
    """
    root, leaves = compress(encode_directory(entries, allow_empty), compression), b""
    while len(root) > most:
        packed = [compress(encode_directory(entries[i : i + leaf_entries]), compression) for i in range(0, len(entries), leaf_entries)]
        sizes = np.array([len(p) for p in packed])
        pointers = np.stack([entries[::leaf_entries, 0], np.cumsum(sizes) - sizes, sizes, np.zeros(len(sizes), np.int64)], axis=1)
        root, leaves = compress(encode_directory(pointers), compression), b"".join(packed)
        leaf_entries *= 2
    return root, leaves


def header_fields(options: dict, ends: tuple[int, int], root: int, leaves: int, size: int, addressed: int, entries: int, contents: int, clustered: bool) -> tuple[dict, bytes]:
    """The header of an archive with ids from and below ``ends``, directories and tile data of such lengths, and the packed metadata."""
    packing, metadata = int(options.get("internal_compression", 2)), options.get("metadata") or "{}"
    if not isinstance(json.loads(metadata), dict):
        raise ArchiveError("metadata must be a JSON object")
    packed = compress(metadata.encode(), packing)
    level = lambda tile_id: sum(s <= tile_id for s in LEVEL_STARTS) - 1
    zooms = (level(ends[0]), level(ends[1] - 1)) if entries else (0, 0)
    bounds = [int(float(v) * 1e7) for v in options.get("bounds", "-180,-90,180,90").split(",")]
    if "center" in options:
        lon, lat, zoom = options["center"].split(",")
        center = (int(float(zoom)), int(float(lon) * 1e7), int(float(lat) * 1e7))
    else:
        center = (zooms[0], round((bounds[0] + bounds[2]) / 2), round((bounds[1] + bounds[3]) / 2))
    first = options.get("layout", "header_first") == "data_first"
    data_at = FIRST_READ_BYTES if first else HEADER_BYTES + root + len(packed) + leaves
    root_at = HEADER_BYTES
    metadata_at = data_at + size if first else root_at + root
    fields = {
        "root_offset": root_at, "root_length": root, "metadata_offset": metadata_at, "metadata_length": len(packed),
        "leaf_directory_offset": metadata_at + len(packed), "leaf_directory_length": leaves, "tile_data_offset": data_at, "tile_data_length": size,
        "addressed_tiles_count": addressed, "tile_entries_count": entries, "tile_contents_count": contents,
        "clustered": clustered, "internal_compression": packing, "tile_compression": int(options.get("tile_compression", 1)), "tile_type": int(options.get("tile_type", 0)),
        "min_zoom": zooms[0], "max_zoom": zooms[1], **dict(zip(("min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7"), bounds)),
        **dict(zip(("center_zoom", "center_lon_e7", "center_lat_e7"), center)),
    }
    return fields, packed


class Build:
    """One archive, from (tile_id, bytes) in any order of ids."""

    def __init__(self, path: str, options: dict) -> None:
        self.path, self.options = path, options
        self.first = options.get("layout", "header_first") == "data_first"
        self.reserved = FIRST_READ_BYTES if self.first else 0
        self.payload = open(path, "w+b") if self.first else tempfile.TemporaryFile(dir=os.path.dirname(path))  # noqa: SIM115
        self.payload.seek(self.reserved)
        self.size, self.addressed, self.clustered = 0, 0, True
        self.offsets: dict[bytes, tuple[int, int]] = {}
        self.entries: list[list[int]] = []

    def add(self, tile_id: int, data: bytes) -> None:
        if not data:
            raise ArchiveError(f"tile {tile_id} has no bytes")
        if not 0 <= tile_id < END:
            raise ArchiveError(f"there is no tile {tile_id}")
        digest = hashlib.sha256(data).digest()
        known = self.offsets.get(digest)
        if known is None:
            known = self.offsets[digest] = (self.size, len(data))
            self.payload.write(data)
            self.size += len(data)
        self.addressed += 1
        last = self.entries[-1] if self.entries else None
        if last and tile_id < last[0]:
            self.clustered = False
        if last and last[0] + last[3] == tile_id and last[1] == known[0]:
            last[3] += 1
        else:
            self.entries.append([tile_id, *known, 1])

    def _sorted(self) -> np.ndarray:
        entries = np.array(self.entries, np.int64).reshape(-1, 4)
        entries = entries[np.argsort(entries[:, 0], kind="stable")]
        twice = entries[1:, 0] < entries[:-1, 0] + entries[:-1, 3]
        if twice.any():
            if self.options.get("on_duplicate", "error") != "first":
                raise ArchiveError(f"tile {int(entries[1:][twice][0, 0])} comes twice")
            kept: list[list[int]] = []
            for tile_id, offset, length, run in entries.tolist():
                start = max(tile_id, kept[-1][0] + kept[-1][3]) if kept else tile_id
                if start < tile_id + run:
                    kept.append([start, offset, length, tile_id + run - start])
            entries = np.array(kept, np.int64).reshape(-1, 4)
            self.addressed = int(entries[:, 3].sum())
        return entries

    def finish(self) -> dict:
        """Write what is not written yet; the archive's row of a manifest, without its name."""
        entries = self._sorted()
        packing = int(self.options.get("internal_compression", 2))
        root, leaves = pack_directories(entries, packing, allow_empty=self.options.get("allow_empty", "false").lower() == "true")
        ends = (int(entries[0, 0]), int((entries[:, 0] + entries[:, 3]).max())) if len(entries) else (0, 0)
        fields, packed = header_fields(self.options, ends, len(root), len(leaves), self.size, self.addressed, len(entries), len(self.offsets), self.clustered)
        zooms = fields["min_zoom"], fields["max_zoom"]
        if self.first:
            self.payload.write(packed + leaves)
            self.payload.seek(0)
            self.payload.write(encode_header(fields) + root)
        else:
            with open(self.path, "wb") as out:
                out.write(encode_header(fields) + root + packed + leaves)
                self.payload.seek(0)
                shutil.copyfileobj(self.payload, out, 1 << 20)
        self.payload.close()
        with open(self.path, "rb") as out:
            os.fsync(out.fileno())
        return {
            "version": FileRanges(self.path).version(), "first_id": ends[0], "end_id": ends[1], "min_zoom": zooms[0], "max_zoom": zooms[1], "tiles": self.addressed,
            "entries": len(entries), "leaves": -(-len(entries) // LEAF_ENTRIES) if leaves else 0, "bytes": self.size, "cuts": cuts_of(entries[:, 0], entries[:, 2], SHARE_BYTES),
        }


@dataclass
class Staged(WriterCommitMessage):
    staged: str
    name: str
    facts: dict | None = None


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        self.options, self.overwrite = options, overwrite
        self._register()
        self.folder = options["path"].removeprefix("file://").rstrip("/")
        self.job = uuid.uuid4().hex
        missing = {"tile_id", "data"} - set(schema.names)
        if missing:
            raise ArchiveError(f"an archive needs the columns tile_id and data; {', '.join(sorted(missing))} is missing")
        folder = folder_of(self.folder)
        if not overwrite and options.get("append", "false") != "true" and any(not f.startswith(("_", ".")) for f in folder.names()):
            raise ArchiveError(f"{self.folder} exists; overwrite it or append to it")
        if isinstance(folder, StoreFolder) and current(self.folder) is None:
            publish(self.folder, lambda rows: rows)  # objects show when they are named, and not before

    def _register(self) -> None:
        """Tasks, commits and aborts run in processes of their own."""
        if "stores" in self.options:
            registered(self.options["stores"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        from pyspark import TaskContext

        self._register()
        context, folder = TaskContext.get(), folder_of(self.folder)
        number = context.partitionId() if context else 0
        stored = isinstance(folder, StoreFolder)
        place = tempfile.mkdtemp() if stored else self.folder  # what is put in a store is built beside the task first
        os.makedirs(place, exist_ok=True)
        staged = f"{place}/.{self.job}-{number}-{uuid.uuid4().hex}"
        try:
            build = Build(staged, self.options)
            for batch in batches:
                for tile_id, data in zip(batch.column("tile_id").to_pylist(), batch.column("data").to_pylist()):
                    build.add(tile_id, data.encode() if isinstance(data, str) else data or b"")
            if not build.entries and self.options.get("allow_empty", "false").lower() != "true":
                build.payload.close()
                if os.path.exists(staged):
                    os.remove(staged)
                return Staged("", "")
            facts = build.finish()
            # each attempt puts an object of its own in a store, where nothing can be renamed
            name = f"part-{number:05d}-{(uuid.uuid4().hex if stored else self.job)[:8]}{self.options.get('suffix', '')}"
            if stored:
                facts["version"] = folder.put(name, staged)
            return Staged("" if stored else staged, name, facts)
        finally:
            if stored:
                shutil.rmtree(place, ignore_errors=True)

    def commit(self, messages: list[Staged | None]) -> None:
        self._register()
        kept, folder = [m for m in messages if m and m.name], folder_of(self.folder)
        if not kept:
            self._sweep()
            raise ArchiveError("there are no tiles to write")
        if isinstance(folder, StoreFolder):
            old = publish(self.folder, lambda rows: self._after(rows, kept))
        else:
            if current(self.folder) is None:
                publish(self.folder, lambda rows: rows)  # from now on a file shows when it is named, and not before
            for m in kept:
                os.replace(m.staged, f"{self.folder}/{m.name}")
            old = publish(self.folder, lambda rows: self._after(rows, kept))
        for row in old if self.overwrite else []:
            folder.remove(row["archive"])
        self._sweep()

    def _after(self, rows: list[dict], kept: list[Staged]) -> list[dict]:
        own = {m.name for m in kept}  # of a store without manifests all objects were rows
        new = [{"archive": m.name, **(m.facts or {})} for m in kept]
        return new if self.overwrite else [r for r in rows if r["archive"] not in own] + new

    def abort(self, messages: list[Staged | None]) -> None:
        self._register()
        folder = folder_of(self.folder)
        rows = current(self.folder)
        if rows is not None or isinstance(folder, StoreFolder):
            named = {row["archive"] for row in rows or []}
            for m in messages:
                if m and m.name and m.name not in named:
                    folder.remove(m.name)
        self._sweep()

    def _sweep(self) -> None:
        for f in os.listdir(self.folder) if os.path.isdir(self.folder) else []:
            if f.startswith(f".{self.job}-"):
                os.remove(f"{self.folder}/{f}")


def _runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of one part's tiles (part, tile_id, offset, length), which arrive in order of ids: neighbours with one content are one."""
    held: list[int] | None = None  # part, tile_id, offset, length, run_length
    names = ["part", "tile_id", "offset", "length", "run_length"]
    for batch in batches:
        if not batch.num_rows:
            continue
        part, ids, offsets, lengths = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names[:4])
        if not lengths.all():
            raise ArchiveError(f"tile {int(ids[lengths == 0][0])} has no bytes")
        if ids[0] < 0 or ids[-1] >= END:
            raise ArchiveError(f"there is no tile {int(ids[0] if ids[0] < 0 else ids[-1])}")
        before = np.append(held[1] + held[4] - 1 if held else ids[0] - 2, ids[:-1])
        if (twice := ids == before).any():
            raise ArchiveError(f"tile {int(ids[twice][0])} comes twice")
        begins = np.flatnonzero((ids != before + 1) | (offsets != np.append(held[2] if held else -1, offsets[:-1])))
        counts = np.diff(np.append(begins, len(ids)))
        rows = np.stack([part[begins], ids[begins], offsets[begins], lengths[begins], counts])
        if held:
            held[4] += int(begins[0]) if len(begins) else len(ids)
            rows = np.concatenate([np.array(held).reshape(5, 1), rows], axis=1)
        held = rows[:, -1].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, :-1]], names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in held], names)


def _packed_leaves(batches: Iterator[pa.RecordBatch], packing: int, leaf_entries: int) -> Iterator[pa.RecordBatch]:
    """Leaf directories of one part's entries."""
    held = np.zeros((0, 5), np.int64)

    def made(rows: np.ndarray) -> pa.RecordBatch:
        packed = compress(encode_directory(rows[:, 1:]), packing)
        return pa.RecordBatch.from_pydict({"part": [int(rows[0, 0])], "first_id": [int(rows[0, 1])], "size": [len(packed)], "packed": [packed]})

    for batch in batches:
        rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("part", "tile_id", "offset", "length", "run_length")], axis=1)
        held = np.concatenate([held, rows])
        while len(held) >= leaf_entries:
            yield made(held[:leaf_entries])
            held = held[leaf_entries:]
    if len(held):
        yield made(held)


def _put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Write (file, place, data) where it belongs; places without data are those of the next row, which has data alone."""
    out, at, name, size = None, -1, None, 0
    place = file = None
    try:
        for batch in batches:
            for known, where, data in zip(batch.column("file").to_pylist(), batch.column("place").to_pylist(), batch.column("data")):
                if known is not None:
                    file, place = known, where
                data = data.as_py()
                if data is None or place is None:
                    continue  # a place, or a content that another tile has stored
                if file != name:
                    if out:
                        os.fsync(out.fileno())
                        out.close()
                    out, name, at = open(file, "r+b", buffering=1 << 20), file, -1  # noqa: SIM115
                if place != at:
                    out.seek(place)
                out.write(data)
                at, size, place = place + len(data), size + len(data), None
        if out:
            out.flush()
            os.fsync(out.fileno())
    finally:
        if out:
            out.close()
    yield pa.RecordBatch.from_pydict({"bytes": [size]})


def _write_together(rows: DataFrame, path: str, archives: int, shares: int, overwrite: bool, options: dict) -> None:
    """Archives over ranges of ids, each written by ``shares`` tasks.

    Rows are dealt into parts by ranges of ids. Contents, entries and leaf directories are found with Spark,
    so all places in a file are known before its tile data are written: each task then writes a part into the file.
    The driver holds some numbers a part, and those of the root directories. Files are staged and named like any.
    """
    spark, parts = rows.sparkSession, archives * shares
    writer = ArchiveWriter({**options, "path": path}, rows.schema, overwrite)
    packing, folder = int(options.get("internal_compression", 2)), writer.folder
    if options.get("on_duplicate", "error") == "first":
        rows = rows.dropDuplicates(["tile_id"])
    own = rows.repartitionByRange(parts, "tile_id").sortWithinPartitions("tile_id")
    own = settle(own.select("tile_id", "data", F.sha2("data", 256).alias("hash"), F.coalesce(F.octet_length("data"), F.lit(0)).cast("long").alias("length"), F.spark_partition_id().alias("part")))
    of = F.floor(F.col("part") / shares).cast("int")
    held = [own]
    try:
        tiles = own.select("tile_id", "hash", "length", "part", of.alias("archive"))
        # contents lie in order of the first id that has them
        found = tiles.groupBy("archive", "hash").agg(F.min(F.struct("tile_id", "part")).alias("first"), F.max("length").alias("length"))
        found = found.select("archive", "hash", F.col("first.tile_id").alias("first_id"), F.col("first.part").alias("part"), "length").repartitionById(parts, "part")
        ahead = Window.partitionBy("part").orderBy("first_id").rowsBetween(Window.unboundedPreceding, -1)
        contents = settle(found.withColumn("within", F.coalesce(F.sum("length").over(ahead), F.lit(0))))
        held.append(contents)
        base, size, distinct = {}, [0] * archives, [0] * archives
        for r in sorted(contents.groupBy("part").agg(F.sum("length").alias("s"), F.count("*").alias("n")).collect()):  # a row a part
            k = r.part // shares
            base[r.part] = size[k]
            size[k], distinct[k] = size[k] + r.s, distinct[k] + r.n
        bases = F.broadcast(spark.createDataFrame([(p, b) for p, b in base.items()] or [(-1, 0)], "part int, base long"))
        placed = contents.join(bases, "part").select("archive", "hash", "first_id", "part", (F.col("base") + F.col("within")).alias("offset"))
        entry = tiles.join(placed.select("archive", "hash", "offset"), ["archive", "hash"]).select(F.col("part").cast("long").alias("part"), "tile_id", "offset", "length")
        runs = entry.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("tile_id").mapInArrow(_runs_of, "part long, tile_id long, offset long, length long, run_length long")
        runs = settle(runs)
        held.append(runs)
        one = F.struct("tile_id", "offset", "run_length")
        ends = sorted(runs.groupBy("part").agg(F.min(one).alias("first"), F.max(one).alias("last"), F.count("*").alias("n"), F.sum("run_length").alias("tiles")).collect())  # a row a part
        # a run that goes on in the next part is one entry
        seams: dict[int, list[int]] = {}  # part: entry that the one before it has, last entry, tiles that this one has from the next parts
        whole: list[list[int]] = [[0, 0, 0, 0] for _ in range(archives)]  # first id, end, entries, tiles
        firsts: list[list[int]] = [[] for _ in range(archives)]
        last: tuple | None = None
        for r in ends:
            k = r.part // shares
            own_k = whole[k]
            goes_on = last is not None and last[0] == k and last[2] == r.first.tile_id and last[3] == r.first.offset
            seams[r.part] = [r.first.tile_id if goes_on else -1, r.last.tile_id, 0]
            if goes_on:
                seams[last[1]][2] += r.first.run_length
            firsts[k].append(r.first.tile_id)
            own_k[0] = own_k[0] if own_k[2] else r.first.tile_id
            own_k[1], own_k[2], own_k[3] = r.last.tile_id + r.last.run_length, own_k[2] + r.n - goes_on, own_k[3] + r.tiles
            # the entry that may go on begins in an earlier part if all of this part belongs to it
            last = (k, last[1] if goes_on and r.n == 1 else r.part, own_k[1], r.last.offset)
        if not ends:
            raise ArchiveError("there are no tiles to write")
        fixes = F.broadcast(spark.createDataFrame([(p, *v) for p, v in seams.items()], "part long, skip long, last long, more long"))
        length = F.col("run_length") + F.when(F.col("tile_id") == F.col("last"), F.col("more")).otherwise(F.lit(0))
        entries = runs.join(fixes, "part").where("tile_id <> skip").select("part", "tile_id", "offset", "length", length.alias("run_length"))
        leaf_entries = LEAF_ENTRIES
        while True:
            leaves = entries.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("tile_id")
            leaves = settle(leaves.mapInArrow(lambda b, n=leaf_entries: _packed_leaves(b, packing, n), "part long, first_id long, size long, packed binary"))
            pointers = np.array(sorted(map(tuple, leaves.select("first_id", "size", "part").collect())), np.int64).reshape(-1, 3)  # as many as a root directory holds
            roots, starts = [], []
            for k in range(archives):
                mine = pointers[pointers[:, 2] // shares == k]
                starts.append(np.cumsum(mine[:, 1]) - mine[:, 1])
                root = np.stack([mine[:, 0], starts[-1], mine[:, 1], np.zeros(len(mine), np.int64)], axis=1)
                roots.append(compress(encode_directory(root), packing) if len(mine) else b"")
            if max(map(len, roots)) <= MAX_ROOT_BYTES:
                held.append(leaves)
                break
            discard(leaves)
            if leaf_entries > TASK_TILES:
                raise ArchiveError(f"an archive of {shares} parts has too many leaf directories: write more archives")
            leaf_entries *= 2
        os.makedirs(folder, exist_ok=True)
        files, at, staged, chosen = [], [], [], [k for k in range(archives) if whole[k][2]]
        for k in range(archives):
            sizes = pointers[pointers[:, 2] // shares == k][:, 1]
            fields, packed = header_fields(options, (whole[k][0], whole[k][1]), len(roots[k]), int(sizes.sum()), size[k], whole[k][3], whole[k][2], distinct[k], True)
            files.append(f"{folder}/.{writer.job}-{k}-{uuid.uuid4().hex}")
            at.append((fields["tile_data_offset"], fields["leaf_directory_offset"]))
            staged.append(fields)
            if k not in chosen:
                continue
            with open(files[k], "wb") as out:
                out.write(encode_header(fields) + roots[k])
                out.seek(fields["metadata_offset"])
                out.write(packed)
                out.truncate(max(fields["tile_data_offset"] + size[k], fields["leaf_directory_offset"] + int(sizes.sum())))
        where = F.broadcast(spark.createDataFrame([(k, files[k], *at[k]) for k in chosen], "archive int, file string, data_at long, leaves_at long"))
        file_of = placed.join(where, "archive").select("part", F.col("first_id").alias("tile_id"), F.lit(0).alias("kind"), "file", (F.col("data_at") + F.col("offset")).alias("place"), F.lit(None).cast("binary").alias("data"))
        data = own.select("part", "tile_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("place"), "data")
        together = file_of.unionByName(data).repartitionById(parts, "part").sortWithinPartitions("tile_id", "kind").select("file", "place", "data")
        done = together.mapInArrow(_put, "bytes long").agg(F.sum("bytes")).first()[0]
        tops = [(int(p), int(i), k, int(s)) for k in chosen for (i, _, p), s in zip(pointers[pointers[:, 2] // shares == k].tolist(), starts[k])]
        leaf_at = F.broadcast(spark.createDataFrame(tops, "part long, first_id long, archive int, start long"))
        put = leaves.join(leaf_at, ["part", "first_id"]).join(where, "archive").select("file", (F.col("leaves_at") + F.col("start")).alias("place"), F.col("packed").alias("data"))
        done += put.mapInArrow(_put, "bytes long").agg(F.sum("bytes")).first()[0]
        if done != sum(size) + int(pointers[:, 1].sum()):
            raise ArchiveError(f"{done} bytes were written of {sum(size) + int(pointers[:, 1].sum())}")
        messages = []
        for number, k in enumerate(chosen):
            fields, leaf_count = staged[k], int((pointers[:, 2] // shares == k).sum())
            facts = {
                "version": FileRanges(files[k]).version(), "first_id": whole[k][0], "end_id": whole[k][1], "min_zoom": fields["min_zoom"], "max_zoom": fields["max_zoom"], "tiles": whole[k][3],
                "entries": whole[k][2], "leaves": leaf_count, "bytes": size[k], "cuts": firsts[k][1:],
            }
            messages.append(Staged(files[k], f"part-{number:05d}-{writer.job[:8]}{options.get('suffix', '')}", facts))
        writer.commit(messages)
    except BaseException:
        writer.abort([])
        raise
    finally:
        discard(*held)


def _filled(rows: DataFrame) -> tuple[int, int]:
    """Bytes and number of the rows."""
    size, count = rows.agg(F.sum(F.octet_length("data")), F.count("*")).first()
    return size or 0, count


def write_archives(tiles: DataFrame, path: str, archives: int | None = None, mode: str = "errorifexists", order: str | None = "tile_id", archive_bytes: int | None = None, **options: str) -> None:
    """Write (tile_id, data) as ``archives`` archives over ranges of ids, each sorted; None: as many as they fill.

    With ``archive_bytes`` there are as many more as it takes that each holds about so many bytes.

    ``order`` None keeps the order in which rows arrive, which need not be that of the ids. In order of ids, archives that are
    too large for one task are written by several.
    """
    from tilespark.session import register  # it imports the formats, this module among them

    register(tiles.sparkSession)
    rows = tiles.select("tile_id", F.col("data").cast("binary").alias("data"), *([order] if order and order not in ("tile_id", "data") else []))
    local = order == "tile_id" and "stores" not in options and not store_of(path)
    size, count = _filled(rows) if local or not archives or archive_bytes else (0, 0)
    if archive_bytes or not archives:
        archives = max(archives or 1, -(-size // (archive_bytes or ARCHIVE_BYTES)), -(-count // ARCHIVE_TILES))
    overwrite = {"overwrite": "overwrite", "errorifexists": "append", "append": "append"}[mode]
    if mode == "append":
        options["append"] = "true"
    shares = max(-(-size // (archives * TASK_BYTES)), -(-count // (archives * TASK_TILES)))
    if local and shares > 1:
        _write_together(rows.withColumn("tile_id", F.col("tile_id").cast("long")), path, archives, shares, mode == "overwrite", options)
        return
    if order:
        rows = (rows.repartitionByRange(archives, "tile_id") if archives > 1 else rows.coalesce(1)).sortWithinPartitions(order).select("tile_id", "data")
    rows.write.format("tile_archive").mode(overwrite).options(path=path, **options).save()
