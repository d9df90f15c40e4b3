"""``tile_archive_v2``: archives of the deprecated second version, read only.

Their directories are fixed records of 17 bytes (zoom, column, row, offset, length); a
zoom with the top bit set points to a leaf directory, keyed by an ancestor tile. Each
distinct leaf directory is a partition. ``get_tiles`` asks for addresses: an address is in the
root directory, or in the leaf of its ancestor at the level of leaves, and no other leaf is read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from tilespark.sources.archive import archives_in
from tilespark.sources.codec import ArchiveError, MagicError, VersionError
from tilespark.sources.ranges import open_ranges

# Fixed values of the old format.
MAGIC_V2, HEADER_V2, ENTRY_V2 = b"PM", 512000, 17
TILES_V2 = "archive string, z int, x bigint, y bigint, offset bigint, length bigint, data binary"
BATCH = 4096


def decode_entries(data: bytes) -> np.ndarray:
    """Rows of zoom, column, row, offset, length, leaf (0 or 1)."""
    raw = np.frombuffer(data[: len(data) // ENTRY_V2 * ENTRY_V2], np.uint8).reshape(-1, ENTRY_V2).astype(np.int64)
    number = lambda a, b: (raw[:, a:b] << (8 * np.arange(b - a))).sum(axis=1)
    return np.stack([raw[:, 0] & 127, number(1, 4), number(4, 7), number(7, 13), number(13, 17), raw[:, 0] >> 7], axis=1)


@dataclass
class Stretch(InputPartition):
    archive: str
    entries: list[list[int]]
    leaf: tuple[int, int] | None = None
    asked: list[tuple[int, int, int]] | None = None  # None: all
    version: str | None = None


class ReaderV2(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def partitions(self) -> list[Stretch]:
        asked = sorted({tuple(a) for a in json.loads(self.options["only"])}) if "only" in self.options else None
        parts = []
        for path in archives_in(self.options["path"]):
            source = open_ranges(path)
            head = source.read(0, 10)
            if head[:2] != MAGIC_V2:
                raise MagicError(f"{path} is not an archive")
            version, json_length, count = (int.from_bytes(head[a:b], "little") for a, b in ((2, 4), (4, 8), (8, 10)))
            if version != 2:
                raise VersionError(f"{path} has version {version}, not 2")
            rest = source.read(10, json_length + count * ENTRY_V2)
            json.loads(rest[:json_length] or b"{}")
            entries = decode_entries(rest[json_length:])
            parts += self._planned(path, source.version(), entries[entries[:, 5] == 0], entries[entries[:, 5] == 1], asked)
        return parts

    @staticmethod
    def _planned(path: str, version: str | None, tiles: np.ndarray, leaves: np.ndarray, asked: list | None) -> list[Stretch]:
        if asked is None:
            whole = [Stretch(path, tiles.tolist(), version=version)] if len(tiles) else []
            return whole + [Stretch(path, [], place, version=version) for place in sorted(set(map(tuple, leaves[:, 3:5].tolist())))]
        root = {tuple(t[:3]): t for t in tiles.tolist()}
        place = {tuple(e[:3]): (e[3], e[4]) for e in leaves.tolist()}
        level = int(leaves[0, 0]) if len(leaves) else 0
        below: dict[tuple[int, int], list] = {}
        for z, x, y in asked:
            if (z, x, y) not in root and z >= level and (found := place.get((level, x >> (z - level), y >> (z - level)))):
                below.setdefault(found, []).append((z, x, y))
        own = [root[a] for a in asked if a in root]
        return ([Stretch(path, own, version=version)] if own else []) + [Stretch(path, [], at, wanted, version) for at, wanted in sorted(below.items())]

    def read(self, part: Stretch | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no partitions
            return
        source = open_ranges(part.archive)
        source.expect(part.version)
        entries = np.array(part.entries, np.int64).reshape(-1, 6)
        if part.leaf:
            entries = decode_entries(source.read(*part.leaf))
            if (entries[:, 5] == 1).any():
                raise ArchiveError("leaf directories of version 2 do not nest")
            if part.asked is not None:
                wanted = set(part.asked)
                entries = entries[[tuple(e) in wanted for e in entries[:, :3].tolist()]]
        for start in range(0, len(entries), BATCH):
            rows = entries[start : start + BATCH]
            data = [source.read(o, n) for o, n in rows[:, 3:5].tolist()]
            arrays = [pa.array([part.archive] * len(rows)), pa.array(rows[:, 0], pa.int32()), *(pa.array(rows[:, i]) for i in range(1, 5)), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["archive", "z", "x", "y", "offset", "length", "data"])


class TileArchiveV2(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_archive_v2"

    def schema(self) -> str:
        return TILES_V2

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReaderV2(dict(self.options))


def get_tiles(spark: SparkSession, path: str, addresses: list[tuple[int, int, int]]) -> DataFrame:
    """Tiles of version 2 archives at (z, x, y) addresses; addresses without a tile give no row."""
    from tilespark.session import register

    return register(spark).read.format("tile_archive_v2").options(path=path, only=json.dumps(addresses)).load()
