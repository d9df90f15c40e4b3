"""What a path or an address holds, from its first bytes, and its tiles whatever it is."""

from __future__ import annotations

import os
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.hilbert import zxy_to_tile_id
from tilespark.schema import MAGIC, VERSION
from tilespark.sources.archive_v2 import MAGIC_V2
from tilespark.sources.codec import ArchiveError
from tilespark.sources.database import databases_of, read_tree
from tilespark.sources.ranges import WebRanges, open_ranges

#: Fixed value: how the files of the database begin.
DATABASE_MAGIC = b"SQLite format 3\0"


def _first(path: str, length: int) -> bytes:
    if not path.startswith(("http://", "https://")):
        return open_ranges(path).read(0, length)
    asked = urllib.request.Request(path, headers={"Range": f"bytes=0-{length - 1}"})
    with urllib.request.urlopen(asked, timeout=WebRanges.TIMEOUT) as answer:  # noqa: S310  a document's server need not serve ranges
        return answer.read(length)


def kind_of(path: str) -> str:
    """archive, archive_v2, database, tile_json, tree (a folder with metadata.json) or folder (of archives)."""
    local = path.removeprefix("file://")
    if os.path.isdir(local):
        return "tree" if os.path.exists(f"{local}/metadata.json") else "folder"
    if "://" not in local and not os.path.exists(local) and databases_of(local):
        path = databases_of(local)[0]
    first = _first(path, 16)
    if first[: len(MAGIC) + 1] == MAGIC + bytes([VERSION]):
        return "archive"
    if first[:4] == MAGIC_V2 + b"\2\0":
        return "archive_v2"
    if first == DATABASE_MAGIC:
        return "database"
    if first.removeprefix(b"\xef\xbb\xbf").lstrip()[:1] == b"{":
        return "tile_json"
    raise ArchiveError(f"{path} is neither an archive nor a database nor a JSON document")


def open_tiles(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(tile_id, z, x, y, data) of whatever ``path`` holds; options are those of its kind."""
    from tilespark.session import register
    from tilespark.sources.tile_json import read_tile_json

    register(spark)
    kind = kind_of(path)
    if kind == "tile_json":
        tiles = read_tile_json(spark, path, **options)
    elif kind == "tree":
        tiles = read_tree(spark, path, **options)
    else:
        name = {"database": "tile_database", "archive_v2": "tile_archive_v2"}.get(kind, "tile_archive")
        tiles = spark.read.format(name).options(path=path, **options).load()
    return tiles.select(zxy_to_tile_id("z", "x", "y").alias("tile_id"), F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "data")
