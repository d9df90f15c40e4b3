"""``python -m tilespark convert|show``; what a source is says its content, not its name."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from tilespark.plans.convert import archive_to_database, archive_to_tree, database_to_archive, tree_to_archive
from tilespark.session import register
from tilespark.sources.archive import read_tiles
from tilespark.sources.archive_v2 import get_tiles
from tilespark.sources.probe import kind_of, open_tiles
from tilespark.sources.sink import write_archives

DATABASE = ".mbtiles"  # fixed value: what tile databases are called


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tilespark")
    commands = parser.add_subparsers(dest="command", required=True)
    convert = commands.add_parser("convert", help="between a tile database, a folder of tiles, TileJSON, old archives and archives")
    convert.add_argument("source")
    convert.add_argument("out")
    convert.add_argument("--maxzoom")
    convert.add_argument("--format")
    convert.add_argument("--scheme", default="zxy", choices=["zxy", "tms", "zyx", "ags", "gwc"])
    convert.add_argument("--archives", type=int, help="how many; as many as the tiles fill if left out")
    convert.add_argument("--overwrite", action="store_true")
    show = commands.add_parser("show", help="header and metadata, or the bytes of one tile")
    show.add_argument("source")
    show.add_argument("address", nargs="*", type=int, help="zoom, column and row")
    given = parser.parse_args(args)
    spark = register(SparkSession.builder.appName("tilespark").getOrCreate())
    if given.command == "show":
        read = spark.read.format("tile_archive").option("path", given.source)
        kind = kind_of(given.source)
        if given.address:
            z, x, y = given.address
            if kind in ("archive", "folder"):
                found = read_tiles(spark, given.source, z=z, x=x, y=y)
            else:
                found = get_tiles(spark, given.source, [(z, x, y)]) if kind == "archive_v2" else open_tiles(spark, given.source).where(f"z = {z} AND x = {x} AND y = {y}")
            found.show(vertical=True, truncate=False)
        elif kind not in ("archive", "folder"):
            open_tiles(spark, given.source).groupBy("z").count().orderBy("z").show()
        else:
            for table in ("header", "metadata"):
                read.option("table", table).load().show(vertical=True, truncate=False)
        return
    if os.path.exists(given.out) and not given.overwrite:
        parser.error(f"{given.out} exists; use --overwrite")
    mode = "overwrite" if given.overwrite else "errorifexists"
    kind = kind_of(given.source)
    if kind == "database":
        database_to_archive(spark, given.source, given.out, int(given.maxzoom) if given.maxzoom else None, given.archives, mode)
    elif kind in ("archive_v2", "tile_json"):
        write_archives(open_tiles(spark, given.source, **({"max_zoom": given.maxzoom} if given.maxzoom and kind == "tile_json" else {})).select("tile_id", "data"), given.out, given.archives, mode)
    elif kind == "tree":
        tree_to_archive(spark, given.source, given.out, given.scheme, given.format, given.maxzoom, given.archives, mode)
    elif given.out.endswith(DATABASE):
        archive_to_database(spark, given.source, given.out, given.archives, "overwrite" if given.overwrite else "append")
    else:
        archive_to_tree(spark, given.source, given.out)


if __name__ == "__main__":
    main()
