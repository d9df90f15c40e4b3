"""``spark.read.format("tile_archive")``: headers, metadata, entries and tiles of archives.

Planning reads each archive's header and root directory once (one read of 16 KiB), those
of many archives side by side. Neighbouring leaf directories, as many as stand for about
128 MiB of tiles, and each stretch of root entries are a partition, so an archive spreads
over the cluster; what ``read_tiles`` is asked for (archive, tile_id, z, x, y) leaves out
the leaves, and inside them the entries, that cannot match. Tiles are read in order of
their place, neighbouring ones in one read.

Where there is a manifest (``sources.manifest``: every folder that the sink wrote has one),
archives whose ids or zooms cannot match are not opened at all. If more than ``PLANNED`` are left, planning
opens none of them: a partition is a share of an archive's ids, and its task reads the root directory.

A plan is pinned to the versions that it met. A task that finds another version fails with
``ChangedError``, unless its partition is all that is asked of the archive and ``on_change`` is
``replan``: then it plans anew, once, and reads the new version alone. ``planned_anew`` does so for whole queries.

Options: ``path`` (a file, a folder, or several parted by commas or as a JSON list; folders are searched
for archives), ``manifest`` (in place of a path), ``table`` (tiles, entries, header, metadata),
``mode`` (FAILFAST or PERMISSIVE: unreadable archives give no rows),
``decompress`` (tile bytes are decompressed), ``strict_zoom`` (tiles outside the
header's zooms are left out; default true), ``on_change`` (error or replan), ``stores`` (what registers object
stores), ``only`` and ``pinned`` (what ``read_tiles`` asks for, and has found out).
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tilespark.functions.hilbert import END, LEVEL_STARTS, MAX_ZOOM, _decode, _encode
from tilespark.schema import ENTRIES, FIRST_READ_BYTES, HEADER, MAX_DEPTH, METADATA, TILES
from tilespark.sources.codec import ArchiveError, ChangedError, DirectoryError, decode_directory, decode_header, decompress
from tilespark.sources.manifest import OWN_FILE, current, cuts_of, rows_of
from tilespark.sources.ranges import BytesRanges, Kept, open_ranges
from tilespark.sources.sink import ArchiveWriter
from tilespark.sources.stores import folder_of, registered, store_of

#: Headers and root directories that this process has decoded, by path and version.
ROOTS = Kept(100)
#: What the session has found out about web archives, by address (and place, for leaves), for ``FRESH`` seconds.
SESSION, FRESH = Kept(100), 60.0
#: Archives that planning opens; beyond them tasks do. Ids and leaves that ``read_tiles`` looks up itself.
PLANNED, LOOKED_UP = 64, 16
T = TypeVar("T")
#: Archives whose headers are read at the same time.
HEADER_READS = 32
TABLES = {"tiles": TILES, "entries": ENTRIES, "header": HEADER, "metadata": METADATA}
#: Addressed tiles of one partition, tiles of one batch, bytes of one read.
PART_TILES, BATCH_TILES, READ_BYTES = 1 << 16, 1 << 12, 1 << 23
#: About so many bytes of tiles stand below the leaves of one partition.
PART_BYTES = 1 << 27


def paths_in(path: str) -> list[str]:
    """The paths of an option: a JSON list, or parted by commas where another path or address begins."""
    if path.lstrip().startswith("["):
        return list(json.loads(path))
    return [one.strip() for one in re.split(r",(?=\s*(?:/|\w+://))", path)] if not os.path.exists(path) else [path]


def archives_in(path: str, low: int | None = None, high: int | None = None) -> list[str]:
    """Archives of files, folders and addresses; of those that a folder's manifest names, such as can hold ids from low to high."""
    found = []
    for one in paths_in(path):
        local = one.removeprefix("file://")
        if store_of(one):
            names, base = folder_of(one).names(), one.rstrip("/")
            rows = current(base, low, high)
            own = set(names) if rows is None else {r["archive"] for r in rows}
            # an address without names below it is an archive
            found += [f"{base}/{f}" for f in names if not f.startswith(("_", ".")) and (f in own or not OWN_FILE.fullmatch(f))] if names else [one]
            continue
        if not os.path.isdir(local):
            found.append(one)
            continue
        for d, _, names in os.walk(local):
            named = current(d, low, high)
            own = set(names) if named is None else {r["archive"] for r in named}
            found += [os.path.join(d, f) for f in names if not f.startswith(("_", ".")) and (f in own or not OWN_FILE.fullmatch(f))]
    return sorted(found)


@dataclass
class Part(InputPartition):
    """Entries of one archive: some of the root's, or neighbouring leaves (and what is below them)."""

    archive: str
    version: str | None
    header: dict | None
    entries: list[tuple[int, int, int, int]] | None  # None: the task reads the root directory
    low: int = 0
    high: int = END
    depth: int = 0
    alone: bool = False  # it is all that is asked of the archive


class Ranges:
    """What a scan is asked for: sets of archives, ids, zooms, columns and rows, and bounds on ids; from the option ``only``.

    It is an option of the scan, and not a filter that Spark pushes down, because scans of one
    table share what was pushed down last: two filters on it would both read the same part.
    """

    def __init__(self, only: str | None = None) -> None:
        asked = json.loads(only or "{}")
        self.low, self.high = asked.pop("from_id", 0), asked.pop("below_id", END)
        self.only: dict[str, set] = {name: set(values) for name, values in asked.items()}
        if unknown := self.only.keys() - {"archive", "tile_id", "z", "x", "y"}:
            raise ArchiveError(f"a scan cannot be asked for {', '.join(sorted(unknown))}")

    def bounds(self, header: dict, strict: bool) -> tuple[int, int]:
        """Ids that can match in an archive with this header."""
        first, last = 0, MAX_ZOOM
        if strict:
            first, last = max(first, header["min_zoom"]), min(last, header["max_zoom"])
        if "z" in self.only:
            first, last = max(first, min(self.only["z"], default=1)), min(last, max(self.only["z"], default=0))
        first, last = max(first, 0), min(last, MAX_ZOOM)
        if first > last:
            return 0, 0
        low, high = max(self.low, LEVEL_STARTS[first]), min(self.high, LEVEL_STARTS[last] + 4**last)
        if "tile_id" in self.only:
            low, high = max(low, min(self.only["tile_id"], default=1)), min(high, max(self.only["tile_id"], default=-1) + 1)
        point = [self.only.get(n) for n in ("z", "x", "y")]
        if all(p and len(p) == 1 for p in point):
            z, x, y = (next(iter(p)) for p in point)
            if not (0 <= z <= MAX_ZOOM and 0 <= x < 1 << z and 0 <= y < 1 << z):
                return 0, 0
            own = int(_encode(*(np.array([v], np.int64) for v in (z, x, y)))[0])
            low, high = max(low, own), min(high, own + 1)
        return low, high

    def keeps(self, ids: np.ndarray) -> np.ndarray:
        keep = np.ones(len(ids), bool)
        for name, values in zip(("tile_id", "z", "x", "y"), (ids, *_decode(ids))):
            if name in self.only:
                keep &= np.isin(values, list(self.only[name]))
        return keep


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, table: str) -> None:
        self.options, self.table, self.filters, self.open = options, table, Ranges(options.get("only")), open_ranges
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"
        self.replan = options.get("on_change", "error") == "replan"
        self.strict = options.get("strict_zoom", "true").lower() == "true"
        self._register()

    def _register(self) -> None:
        if "stores" in self.options:
            registered(self.options["stores"])

    def _root(self, path: str) -> tuple[dict, str | None, np.ndarray]:
        """Header, version and root directory of an archive; what was decoded before is not decoded again."""
        source = self.open(path)
        version = source.version()

        def load() -> tuple[dict, np.ndarray]:
            first = source.read(0, FIRST_READ_BYTES)
            header = decode_header(first)
            start, length = header["root_offset"], header["root_length"]
            raw = first[start : start + length] if start + length <= len(first) else source.read(start, length)
            return header, decode_directory(decompress(raw, header["internal_compression"]))

        header, root = load() if version is None else ROOTS.get((path, version), load)
        return header, source.version(), root

    def facts(self, path: str) -> dict:
        """An archive's row of a manifest; its last leaves are read for the end of its ids."""
        header, version, root = self._root(path)
        source, last = self.open(path), root[-1].tolist() if len(root) else [0, 0, 0, 0]
        for _ in range(MAX_DEPTH):
            if last[3] or not len(root):
                break
            last = decode_directory(decompress(source.read(header["leaf_directory_offset"] + last[1], last[2]), header["internal_compression"]))[-1].tolist()
        leaves = root[root[:, 3] == 0]
        share = np.full(len(leaves), header["tile_data_length"] // max(len(leaves), 1), np.int64)
        return {
            "archive": path, "version": version, "first_id": int(root[0, 0]) if len(root) else 0, "end_id": last[0] + last[3], "min_zoom": header["min_zoom"], "max_zoom": header["max_zoom"], "tiles": header["addressed_tiles_count"],
            "entries": header["tile_entries_count"], "leaves": len(leaves), "bytes": header["tile_data_length"], "cuts": cuts_of(leaves[:, 0], share, PART_BYTES),
        }

    def partitions(self) -> list[Part]:
        if "path" not in self.options and "manifest" not in self.options:
            raise ArchiveError("the option path names the archives")
        wanted = self.filters.only.get("archive")
        low, high = self.filters.bounds({"min_zoom": 0, "max_zoom": MAX_ZOOM}, False) if self.table == "tiles" else (None, None)
        pinned = json.loads(self.options.get("pinned", "{}"))
        if "manifest" in self.options:
            rows = rows_of(self.options["manifest"].removeprefix("file://"), low, high)
        else:
            rows = [{"archive": p} for p in archives_in(self.options["path"], low, high)]
        rows = [r for r in rows if (wanted is None or r["archive"] in wanted) and self._may_match(r)]
        if len(rows) > PLANNED and self.table == "tiles" and "manifest" not in self.options:
            rows = self._with_facts(rows)

        def planned(row: dict) -> list[Part]:
            path = row["archive"]
            if path in pinned:
                found = pinned[path]
                return [Part(path, found["version"], found["header"], [tuple(e) for e in found["entries"]], low, high, alone=True)] if found["entries"] else []
            if len(rows) > PLANNED and row.get("version"):
                ends = [max(low or 0, row["first_id"]), *(c for c in row["cuts"] or [] if (low or 0) < c < (high or END)), min(high or END, row["end_id"])] if self.table == "tiles" else [0, END]
                return [Part(path, row["version"], None, None, a, b, alone=len(ends) == 2) for a, b in zip(ends, ends[1:]) if a < b]
            try:
                return self._parts(path, None if self.replan else row.get("version"))
            except ArchiveError:
                if not self.permissive:
                    raise
                return []

        with ThreadPoolExecutor(HEADER_READS) as pool:
            return [part for parts in pool.map(planned, rows) for part in parts]

    def _may_match(self, row: dict) -> bool:
        """Whether an archive can hold anything that is asked for, by its row of a manifest."""
        if self.table != "tiles" or row.get("max_zoom") is None:
            return True
        low, high = self.filters.bounds(row, self.strict)
        return low < high

    def _with_facts(self, rows: list[dict]) -> list[dict]:
        """Rows of archives in folders, with what the folders' manifests say."""
        known = {f"{d}/{r['archive']}": r for d in {os.path.dirname(r["archive"]) for r in rows} if os.path.isdir(d) or store_of(d) for r in current(d) or []}
        found = [{**known.get(r["archive"], {}), **r} for r in rows]
        return [r for r in found if self._may_match(r)]

    def _parts(self, path: str, version: str | None = None, within: tuple[int, int] = (0, END)) -> list[Part]:
        """The partitions of an archive, of ids within bounds; another version than the one that is asked for is an error."""
        header, found, root = self._root(path)
        if version and found and found != version:
            raise ChangedError(f"{path} changed while it was read")
        whole = Part(path, found, header, [])
        if self.table in ("header", "metadata"):
            return [replace(whole, alone=True)]
        low, high = self.filters.bounds(header, self.strict) if self.table == "tiles" else (0, END)
        low, high = max(low, within[0]), min(high, within[1])
        leaves = int((root[:, 3] == 0).sum())
        together = max(1, PART_BYTES * leaves // max(header["tile_data_length"], 1))
        held: list[tuple[int, int, int, int]] = []
        held_to = 0
        parts, own, size = [], [], 0
        for number, entry in enumerate(root.tolist()):
            tile_id, _, _, run = entry
            if run == 0 or self.table == "entries":
                after = int(root[number + 1][0]) if number + 1 < len(root) else END
            else:
                after = tile_id + run
            if after <= low or tile_id >= high:
                continue
            if run == 0:
                held.append(tuple(entry))
                held_to = min(high, after)
                if len(held) >= together:
                    parts.append(replace(whole, entries=held, low=low, high=held_to, depth=1))
                    held = []
                if self.table == "entries":
                    own.append(tuple(entry))
                continue
            # a long run is dealt over several partitions
            for a in range(max(tile_id, low), min(after, high), PART_TILES) if self.table == "tiles" else [tile_id]:
                own.append(tuple(entry))
                size += min(after, high, a + PART_TILES) - a
                if self.table == "tiles" and (after - tile_id > PART_TILES):
                    parts.append(replace(whole, entries=[own.pop()], low=max(low, a), high=min(high, a + PART_TILES)))
                elif size >= PART_TILES:
                    parts.append(replace(whole, entries=own, low=low, high=high))
                    own, size = [], 0
        if held:
            parts.append(replace(whole, entries=held, low=low, high=held_to, depth=1))
        if own:
            parts.append(replace(whole, entries=own, low=low, high=high))
        return [replace(parts[0], alone=True)] if len(parts) == 1 else parts

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no partitions
            return
        self._register()  # a task's process may be another one
        begun = False
        try:
            for batch in self._pinned(part):
                yield batch
                begun = True
        except ChangedError:
            if begun or not (self.replan and part.alone):
                raise
            for anew in self._parts(part.archive):
                yield from self._read(anew)

    def _pinned(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.entries is not None or self.table in ("header", "metadata"):
            yield from self._read(part)
            return
        try:
            parts = self._parts(part.archive, part.version, (part.low, part.high))
        except FileNotFoundError as e:
            raise ChangedError(f"{part.archive} is gone") from e
        for own in parts:
            yield from self._read(own)

    def _read(self, part: Part) -> Iterator[pa.RecordBatch]:
        try:
            source = self.open(part.archive)
            source.expect(part.version)
        except FileNotFoundError as e:
            raise ChangedError(f"{part.archive} is gone") from e
        if part.header is None:
            part = replace(part, header=self._root(part.archive)[0])
        if self.table == "header":
            yield _batch(HEADER, [(part.archive, *part.header.values())])
        elif self.table == "metadata":
            raw = source.read(part.header["metadata_offset"], part.header["metadata_length"])
            text = decompress(raw, part.header["internal_compression"]).decode() if raw else "{}"
            json.loads(text)
            yield _batch(METADATA, [(part.archive, text)])
        else:
            for entries, depth in self._walk(source, part):
                yield from self._entries(part, entries, depth) if self.table == "entries" else self._tiles(source, part, entries)

    def _walk(self, source, part: Part) -> Iterator[tuple[np.ndarray, int]]:
        """Tile entries of a partition, directory by directory; leaf pointers too for the table of entries."""
        if part.depth == 0:
            yield np.array(part.entries, np.int64).reshape(-1, 4), 0
            return
        stack = [(e, 1) for e in part.entries]
        seen = set()
        while stack:
            (_, offset, length, _), depth = stack.pop()
            if depth >= MAX_DEPTH or offset in seen:
                raise DirectoryError("directories are nested too deeply" if depth >= MAX_DEPTH else "directories form a circle")
            seen.add(offset)
            raw = source.read(part.header["leaf_directory_offset"] + offset, length)
            found = decode_directory(decompress(raw, part.header["internal_compression"]))
            if not len(found):
                raise DirectoryError("a leaf directory is empty")
            leaves = found[:, 3] == 0
            ends = np.concatenate([found[1:, 0], [END]])
            stack += [(tuple(e), depth + 1) for e, after in zip(found[leaves].tolist(), ends[leaves].tolist()) if after > part.low and e[0] < part.high]
            yield (found if self.table == "entries" else found[~leaves]), depth

    def _entries(self, part: Part, entries: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
        base = np.where(entries[:, 3] == 0, part.header["leaf_directory_offset"], part.header["tile_data_offset"])
        columns = [[part.archive] * len(entries), *entries.T, entries[:, 1] + base, [depth] * len(entries)]
        yield _columns(ENTRIES, columns)

    def _tiles(self, source, part: Part, entries: np.ndarray) -> Iterator[pa.RecordBatch]:
        base, code = part.header["tile_data_offset"], part.header["tile_compression"] if self.options.get("decompress", "false").lower() == "true" else 1
        starts = np.maximum(entries[:, 0], part.low)
        counts = np.maximum(np.minimum(entries[:, 0] + entries[:, 3], part.high) - starts, 0)
        live = np.flatnonzero(counts)
        at = 0
        while at < len(live):
            # a batch is some whole entries, or a stretch of one long run
            upto = at + max(1, int(np.searchsorted(np.cumsum(counts[live[at:]]), BATCH_TILES, "right")))
            group = live[at:upto]
            blobs = _blobs(source, base, entries[group])
            for first in range(0, int(counts[group].max()), BATCH_TILES):
                span = np.clip(counts[group] - first, 0, BATCH_TILES)
                which = np.repeat(np.arange(len(group)), span)
                ids = np.repeat(starts[group] + first, span) + np.arange(len(which)) - np.repeat(np.cumsum(span) - span, span)
                keep = self.filters.keeps(ids)
                ids, which = ids[keep], which[keep]
                z, x, y = _decode(ids)
                own = entries[group][which]
                data = [decompress(blobs[i], code) for i in which.tolist()]
                yield _columns(TILES, [[part.archive] * len(ids), ids, z, x, y, own[:, 1], own[:, 1] + base, own[:, 2], data])
            at = upto


def _looked_up(path: str, ids: list[int], strict: bool) -> dict | None:
    """Version, header and entries of a web archive for a few ids; None if they lie below too many leaves.

    Headers, roots and leaves stay with the session for a while: a second question asks the server for tiles only.
    """
    reader = ArchiveReader({"path": path}, "tiles")

    def kept(key: tuple, make: Callable):
        held = SESSION.get(key, lambda: (time.monotonic(), make()))
        if time.monotonic() - held[0] > FRESH:
            SESSION.held.pop(key, None)
            return kept(key, make)
        return held[1]

    header, version, root = kept((path,), lambda: reader._root(path))
    if not version:  # without one nothing that is kept can be told from what has changed
        SESSION.held.pop((path,), None)
    ids = [i for i in ids if not strict or LEVEL_STARTS[header["min_zoom"]] <= i < LEVEL_STARTS[header["max_zoom"]] + 4 ** header["max_zoom"]]
    found, directories, read = [], [(root, ids)], 0
    for _ in range(MAX_DEPTH):
        below: dict[tuple, list[int]] = {}
        for entries, own in directories:
            at = np.searchsorted(entries[:, 0], own, "right") - 1
            for i, k in zip(own, at.tolist()):
                entry = tuple(entries[k].tolist()) if k >= 0 else None
                if entry and entry[3] == 0:
                    below.setdefault(entry, []).append(i)
                elif entry and i < entry[0] + entry[3]:
                    found.append(entry)
        read += len(below)
        if read > LOOKED_UP:
            return None
        source = open_ranges(path)
        source.expect(version)

        def leaf(place: tuple, source=source) -> np.ndarray:
            return decode_directory(decompress(source.read(header["leaf_directory_offset"] + place[1], place[2]), header["internal_compression"]))

        directories = [(kept((path, version, *place), lambda place=place: leaf(place)) if version else leaf(place), own) for place, own in below.items()]
        if not directories:
            return {"version": version, "header": header, "entries": sorted(set(found))}
    raise DirectoryError("directories are nested too deeply")


def read_tiles(spark: SparkSession, path: str | None = None, from_id: int | None = None, below_id: int | None = None, options: dict[str, str] | None = None, **only: int | str | list) -> DataFrame:
    """Tiles of archives, of which only those asked for are read: by ``archive``, ``tile_id``, ``z``, ``x``, ``y`` (a value or a list) and bounds on the id.

    Leaf directories, and byte ranges, that hold none of them are not read. A few tiles of one web archive are looked up
    here, in directories that the session keeps, so the scan asks the server for the tiles alone. If the archive is another one by
    then, it is planned anew. ``manifest`` among the options stands for the path.
    """
    from tilespark.session import register

    asked: dict = {name: values if isinstance(values, list) else [values] for name, values in only.items()}
    asked |= {name: value for name, value in (("from_id", from_id), ("below_id", below_id)) if value is not None}
    options = {"on_change": "replan", **({"path": path} if path is not None else {}), **(options or {})}
    if "stores" in options:
        registered(options["stores"])
    one = paths_in(path) if path is not None else []
    if len(one) == 1 and "://" in one[0] and not one[0].startswith("file://") and (ids := _few_ids(asked)) is not None and not (store_of(one[0]) and folder_of(one[0]).names()):
        try:
            found = _looked_up(one[0], ids, options.get("strict_zoom", "true").lower() == "true")
        except ChangedError:
            SESSION.held.clear()
            found = _looked_up(one[0], ids, options.get("strict_zoom", "true").lower() == "true")
        if found is not None:
            options["pinned"] = json.dumps({one[0]: found})
    return register(spark).read.format("tile_archive").options(only=json.dumps(asked), **options).load()


def _few_ids(asked: dict) -> list[int] | None:
    """The ids that are asked for, if these are a few by id or one by address."""
    if set(asked) == {"tile_id"} and len(asked["tile_id"]) <= LOOKED_UP:
        return sorted(asked["tile_id"])
    if set(asked) == {"z", "x", "y"} and all(len(v) == 1 for v in asked.values()):
        z, x, y = (asked[n][0] for n in ("z", "x", "y"))
        if 0 <= z <= MAX_ZOOM and 0 <= x < 1 << z and 0 <= y < 1 << z:
            return _encode(*(np.array([v], np.int64) for v in (z, x, y))).tolist()
    return None


def planned_anew(query: Callable[[], T]) -> T:
    """What ``query`` (which makes a scan and runs it) gives; run once more if an archive changed between its plan and its tasks."""
    try:
        return query()
    except Exception as e:
        if ChangedError.__name__ not in str(e):
            raise
        SESSION.held.clear()
        return query()


def read_archives(archives: DataFrame, table: str = "tiles", **options: str) -> DataFrame:
    """The ``table`` of archives that are values of a BINARY column: ``archives`` has archive (a name) and data."""
    schema = TABLES[table]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("archive").to_pylist(), batch.column("data")):
                reader = ArchiveReader({**options, "path": name}, table)
                reader.open = lambda _, own=data: BytesRanges(own.as_py())
                try:
                    for part in reader._parts(name):
                        yield from reader.read(part)
                except ArchiveError:
                    if not reader.permissive:
                        raise

    return archives.select("archive", "data").mapInArrow(read, schema)


def _blobs(source, base: int, entries: np.ndarray) -> list[bytes]:
    """Bytes of entries; neighbours are read together."""
    out: list[bytes] = [b""] * len(entries)
    order = np.argsort(entries[:, 1], kind="stable").tolist()
    at = 0
    while at < len(order):
        start = end = int(entries[order[at], 1])
        upto = at
        while upto < len(order) and (offset := int(entries[order[upto], 1])) <= end and (upto == at or offset + int(entries[order[upto], 2]) - start <= READ_BYTES):
            end = max(end, offset + int(entries[order[upto], 2]))
            upto += 1
        data = source.read(base + start, end - start)
        for i in order[at:upto]:
            offset = int(entries[i, 1]) - start
            out[i] = data[offset : offset + int(entries[i, 2])]
        at = upto
    return out


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "boolean": pa.bool_(), "binary": pa.binary()}


def _columns(schema: str, columns: list) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds)], list(names))


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    return _columns(schema, list(zip(*rows)))


class TileArchive(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_archive"

    def schema(self) -> str:
        table = self.options.get("table", "tiles")
        if table not in TABLES:
            raise ArchiveError(f"there is no table {table}: tables are {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(dict(self.options), self.options.get("table", "tiles"))

    def writer(self, schema: StructType, overwrite: bool):
        return ArchiveWriter(dict(self.options), schema, overwrite)
