"""``tile_database``: SQLite tile sets, read by ranges of row numbers and written by task.

``table`` is tiles or metadata. A task writes one database of its own; one partition
gives the usual single file, several give ``<name>-00000.<suffix>`` and on, which are read together by the
name without a number. ``write_database`` deals tiles over as many as they fill. Rows are counted from the south in these files, and from
the north in the columns here.
"""

from __future__ import annotations

import os
import re
import sqlite3
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tilespark.functions.hilbert import flip_row

SCHEMAS = {"tiles": "z int, x bigint, y bigint, data binary", "metadata": "name string, value string"}
PART_ROWS, BATCH_ROWS = 1 << 16, 1 << 10
#: Bytes of a database where no number of databases is asked for, and bytes of tree files of one batch.
DATABASE_BYTES, BATCH_BYTES = 1 << 26, 1 << 23


def databases_of(path: str) -> list[str]:
    """The files of a database: the one of that name, or those that several tasks wrote for it."""
    path = path.removeprefix("file://")
    if os.path.exists(path):
        return [path]
    (folder, name), own = os.path.split(path), []
    stem, suffix = os.path.splitext(name)
    for f in os.listdir(folder or ".") if os.path.isdir(folder or ".") else []:
        if re.fullmatch(rf"{re.escape(stem)}-\d{{5,}}{re.escape(suffix)}", f):
            own.append(os.path.join(folder, f))
    return sorted(own)


@dataclass
class Rows(InputPartition):
    path: str
    low: int
    high: int


class DatabaseReader(DataSourceReader):
    def __init__(self, options: dict, table: str) -> None:
        self.path, self.table = options["path"].removeprefix("file://"), table
        self.max_zoom = int(options.get("max_zoom") or 99)

    def partitions(self) -> list[Rows]:
        files = databases_of(self.path)
        if not files:
            raise FileNotFoundError(self.path)
        if self.table == "metadata":  # each has them all
            return [Rows(files[0], 0, 0)]
        return [part for path in files for part in self._parts(path)]

    def _parts(self, path: str) -> list[Rows]:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            (kind,) = db.execute("SELECT type FROM sqlite_master WHERE name = 'tiles'").fetchone() or (None,)
            if kind == "view":  # a view has no row numbers
                return [Rows(path, 0, -1)]
            low, high = db.execute("SELECT min(rowid), max(rowid) FROM tiles").fetchone()
        return [Rows(path, a, min(a + PART_ROWS, high + 1)) for a in range(low, high + 1, PART_ROWS)] if low is not None else []

    def read(self, part: Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # there are no partitions
            return
        with sqlite3.connect(f"file:{part.path}?mode=ro", uri=True) as db:
            db.text_factory = lambda b: b.decode("utf-8", "replace")
            if self.table == "metadata":
                rows = db.execute("SELECT CAST(name AS TEXT), CAST(value AS TEXT) FROM metadata").fetchall()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["name", "value"])
                return
            where = "" if part.high < part.low else f" AND rowid >= {part.low} AND rowid < {part.high}"
            found = db.execute(f"SELECT zoom_level, tile_column, (1 << zoom_level) - 1 - tile_row, tile_data FROM tiles WHERE zoom_level <= ?{where}", (self.max_zoom,))  # noqa: S608
            while rows := found.fetchmany(BATCH_ROWS):
                z, x, y, data = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(data, pa.binary())], ["z", "x", "y", "data"])


@dataclass
class Written(WriterCommitMessage):
    staged: str


class DatabaseWriter(DataSourceArrowWriter):
    """Writes (z, x, y, data); rows with null z and (name, value) in x and y are not needed: see ``metadata``."""

    def __init__(self, options: dict) -> None:
        import json

        self.path, self.job = options["path"].removeprefix("file://"), uuid.uuid4().hex
        self.metadata = json.loads(options.get("metadata") or "{}")
        self.old = databases_of(self.path)
        if self.old and options.get("replace", "false") != "true":
            raise FileExistsError(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        staged = f"{self.path}.{self.job}-{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(staged) or ".", exist_ok=True)
        db = sqlite3.connect(staged)
        db.execute("CREATE TABLE metadata (name text, value text)")
        db.execute("CREATE TABLE tiles (zoom_level integer, tile_column integer, tile_row integer, tile_data blob)")
        db.executemany("INSERT INTO metadata VALUES (?, ?)", self.metadata.items())
        count = 0
        for batch in batches:
            rows = [(z, x, (1 << z) - 1 - y, data) for z, x, y, data in zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y", "data")))]
            db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", rows)
            count += len(rows)
        db.execute("CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row)")  # fails on repeated addresses
        db.commit()
        db.close()
        return Written(staged if count else "")

    def commit(self, messages: list[Written | None]) -> None:
        files = [m.staged for m in messages if m and m.staged]
        stem, suffix = os.path.splitext(self.path)
        named = [self.path if len(files) == 1 else f"{stem}-{number:05d}{suffix}" for number in range(len(files))]
        for staged, name in zip(files, named):
            os.replace(staged, name)
        for gone in set(self.old) - set(named) if named else ():
            os.remove(gone)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        folder = os.path.dirname(self.path) or "."
        for f in os.listdir(folder) if os.path.isdir(folder) else []:
            if f.startswith(f"{os.path.basename(self.path)}.{self.job}-"):
                os.remove(f"{folder}/{f}")


class TileDatabase(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tile_database"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "tiles")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return DatabaseReader(dict(self.options), self.options.get("table", "tiles"))

    def writer(self, schema: StructType, overwrite: bool) -> DatabaseWriter:
        return DatabaseWriter(dict(self.options) | ({"replace": "true"} if overwrite else {}))


def write_database(tiles: DataFrame, path: str, metadata: str = "{}", databases: int | None = None, mode: str = "append") -> None:
    """Write (z, x, y, data) as ``databases`` databases over ranges of addresses; None: as many as they fill, one at least."""
    from tilespark.session import register

    register(tiles.sparkSession)
    if databases is None:
        databases = max(1, -(-(tiles.agg(F.sum(F.octet_length("data"))).first()[0] or 0) // DATABASE_BYTES))
    rows = tiles.repartitionByRange(databases, "z", "x", "y") if databases > 1 else tiles.coalesce(1)
    rows.write.format("tile_database").mode(mode).options(path=path, metadata=metadata).save()


#: Path schemes of tile trees: pattern of zoom, column and row, their number base, and whether rows count from the south.
TREES = {
    "zxy": (r"/(?<z>\d+)/(?<x>\d+)/(?<y>\d+)\.[^/]*$", 10, False),
    "tms": (r"/(?<z>\d+)/(?<x>\d+)/(?<y>\d+)\.[^/]*$", 10, True),
    "zyx": (r"/(?<z>\d+)/(?<y>\d+)/(?<x>\d+)\.[^/]*$", 10, False),
    "ags": (r"/L(?<z>\d+)/R(?<y>[0-9a-fA-F]+)/C(?<x>[0-9a-fA-F]+)\.[^/]*$", 16, False),
    "gwc": (r"/[^/]*(?<z>\d\d)/[^/]+/(?<x>\d+)_(?<y>\d+)\.[^/]*$", 10, True),
}


def read_tree(spark, path: str, scheme: str = "zxy", min_zoom: int = 0, max_zoom: int = 99) -> DataFrame:
    """(z, x, y, data) of a folder of tile files. Files that the scheme's pattern does not fit are passed over.

    Tasks list a mounted folder and read the files of the zooms that are asked for; other places are read by Spark's files.
    """
    pattern, base, south = TREES[scheme]
    if os.path.isdir(local := path.removeprefix("file://")):
        rows = _walked(spark, local, scheme, min_zoom, max_zoom, True)
        return rows.withColumn("y", flip_row("z", "y")) if south else rows
    names = re.findall(r"\?<(\w)>", pattern)
    plain = re.sub(r"\?<\w>", "", pattern)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    part = {n: F.regexp_extract("path", plain, i + 1) for i, n in enumerate(names)}
    number = lambda n, b: F.conv(part[n], b, 10).cast("long")
    rows = files.where(F.col("path").rlike(plain)).select(part["z"].cast("int").alias("z"), number("x", base).alias("x"), number("y", base).alias("y"), F.col("content").alias("data"))
    rows = rows.where(F.col("z").between(min_zoom, max_zoom))
    return rows.withColumn("y", flip_row("z", "y")) if south else rows


def _walked(spark, root: str, scheme: str, min_zoom: int, max_zoom: int, contents: bool) -> DataFrame:
    """(z, x, y, data) of a mounted folder; without ``contents`` data are null and no file is opened. The driver lists the top folder alone."""
    pattern, base, _ = TREES[scheme]
    fits = re.compile(pattern.replace("(?<", "(?P<"), re.ASCII)
    shown = lambda found: sorted((f for f in found if not f.name.startswith(("_", "."))), key=lambda f: f.name)
    top = [root.rstrip("/"), *(f.path for f in shown(os.scandir(root)) if f.is_dir())]

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A folder for its own files, and those right below it with all that they hold."""
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                below = [] if folder == top[0] else [f.path for f in shown(os.scandir(folder)) if f.is_dir()]
                yield pa.RecordBatch.from_pydict({"folder": [folder, *below], "whole": [False, *[True] * len(below)]})

    def files(folder: str, whole: bool) -> Iterator[str]:
        found = shown(os.scandir(folder))
        yield from (f.path for f in found if f.is_file())
        for f in found if whole else []:
            if f.is_dir():
                yield from files(f.path, True)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def made() -> pa.RecordBatch:
            z, x, y, data = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(z, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(data, pa.binary())], ["z", "x", "y", "data"])

        for batch in batches:
            for folder, whole in zip(batch.column("folder").to_pylist(), batch.column("whole").to_pylist()):
                for path in files(folder, whole):
                    found = fits.search(path)
                    if not found or not min_zoom <= int(found["z"]) <= max_zoom or max(x := int(found["x"], base), y := int(found["y"], base)) >= 1 << 63:
                        continue
                    data = None
                    if contents:
                        with open(path, "rb") as file:
                            data = file.read()
                        size += len(data)
                    held.append((int(found["z"]), x, y, data))
                    if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield made()
                        held, size = [], 0
        if held:
            yield made()

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = spark.createDataFrame([(f,) for f in top], "folder string").repartition(ranges, "folder").mapInArrow(folders, "folder string, whole boolean")
    return listed.repartition(ranges).mapInArrow(read, SCHEMAS["tiles"])


def tree_zooms(spark, path: str, scheme: str, min_zoom: int, max_zoom: int) -> tuple[int | None, int | None]:
    """The least and the greatest zoom of a tree between two; no file is read."""
    local = path.removeprefix("file://")
    tiles = _walked(spark, local, scheme, min_zoom, max_zoom, False) if os.path.isdir(local) else read_tree(spark, path, scheme, min_zoom, max_zoom)
    return tuple(tiles.agg(F.min("z"), F.max("z")).first())


def write_tree(tiles: DataFrame, path: str, extension: str = ".mvt", metadata: str = "{}") -> None:
    """Write (z, x, y, data) as z/x/y files and metadata.json; each task writes its own rows."""
    import json

    root = path.removeprefix("file://")
    json.loads(metadata)
    os.makedirs(root, exist_ok=True)
    with open(f"{root}/metadata.json", "w", encoding="utf-8") as out:
        out.write(metadata)

    def write(rows) -> None:
        for row in rows:
            os.makedirs(f"{root}/{row.z}/{row.x}", exist_ok=True)
            with open(f"{root}/{row.z}/{row.x}/{row.y}{extension}", "wb") as file:
                file.write(row.data)

    tiles.select("z", "x", "y", "data").foreachPartition(write)
