"""Converting tile sets: databases and trees to archives and back."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.facts import FORMATS, compression_of_format, from_e7, parse_bounds, parse_center, tile_type_of_format
from tilespark.functions.hilbert import zxy_to_tile_id
from tilespark.session import register
from tilespark.sources.codec import ArchiveError, compress
from tilespark.sources.database import read_tree, tree_zooms, write_database, write_tree
from tilespark.sources.sink import write_archives


def gzipped(data):
    """Bytes that are gzip already as they are, others compressed (no time stamp, so that builds repeat)."""

    @F.pandas_udf("binary")
    def pack(values):
        return values.map(lambda b: None if b is None else compress(b, 2))

    return F.when(F.substring(data, 1, 2) == F.lit(b"\x1f\x8b"), data).otherwise(pack(data))


def header_facts(metadata: DataFrame) -> DataFrame:
    """One row of header columns from the (name, value) rows of a tile database.

    Bounds and centre that are absent or unreadable fall back to the world and to the
    middle of the bounds; the format decides type and compression.
    """
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value"))).alias(n)
    one = metadata.agg(*[value(n) for n in ("minzoom", "maxzoom", "bounds", "center", "format", "compression")])
    one = one.withColumn("b", parse_bounds(F.coalesce("bounds", F.lit("")))).withColumn("min_zoom", F.col("minzoom").cast("int"))
    one = one.withColumn("c", parse_center(F.coalesce("center", F.lit("")), F.col("b"), "min_zoom"))
    return one.select("min_zoom", F.col("maxzoom").cast("int").alias("max_zoom"), "b.*", "c.*", tile_type_of_format(F.coalesce("format", F.lit(""))).alias("tile_type"), compression_of_format(F.coalesce("format", F.lit("")), "compression").alias("tile_compression"), "format")


def metadata_rows(header: DataFrame, metadata: DataFrame) -> DataFrame:
    """(archive, name, value) rows of a tile database, from headers and metadata JSON.

    What the JSON lacks is filled in from the header: zooms, bounds, centre, format.
    ``vector_layers`` and ``tilestats`` go into one ``json`` row; values that are not
    strings are JSON text.
    """
    top = F.from_json("json", "map<string,string>")
    rows = header.join(metadata, "archive").withColumn("kv", F.coalesce(top, F.create_map().cast("map<string,string>")))
    degrees = lambda *names: F.concat_ws(",", *[from_e7(n).cast("string") for n in names])
    formats = {v: k for k, v in FORMATS.items() if k != "jpg"}
    name_of = F.get(F.array(*[F.lit(formats.get(i)) for i in range(7)]), F.col("tile_type").cast("int"))
    given = F.map_filter("kv", lambda k, v: ~k.isin("vector_layers", "tilestats"))
    filled = F.create_map(
        F.lit("minzoom"), F.col("min_zoom").cast("string"), F.lit("maxzoom"), F.col("max_zoom").cast("string"),
        F.lit("bounds"), degrees("min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7"),
        F.lit("center"), F.concat_ws(",", degrees("center_lon_e7", "center_lat_e7"), F.col("center_zoom").cast("string")), F.lit("format"), name_of,
    )
    absent = F.map_filter(filled, lambda k, v: v.isNotNull() & ~F.map_contains_key("kv", k))
    part = lambda n: F.when(F.map_contains_key("kv", n), F.concat(F.lit(f'"{n}":'), F.col("kv")[n]))
    nested = F.concat_ws(",", part("vector_layers"), part("tilestats"))
    extra = F.when(nested != "", F.create_map(F.lit("json"), F.concat(F.lit("{"), nested, F.lit("}")))).otherwise(F.create_map().cast("map<string,string>"))
    return rows.select("archive", F.explode(F.map_concat(given, absent, extra)).alias("name", "value"))


def _write(spark: SparkSession, tiles: DataFrame, facts, metadata: dict, out: str, archives: int | None, mode: str) -> None:
    """``tiles`` (z, x, y, data) as archives, with the header columns of ``facts``."""
    data = gzipped(F.col("data")) if facts.tile_type == 1 else F.col("data")
    rows = tiles.select(zxy_to_tile_id("z", "x", "y").alias("tile_id"), data.alias("data"))
    e7 = lambda *names: ",".join(repr(facts[n] / 1e7) for n in names)
    write_archives(
        rows, out, archives, mode, tile_type=str(facts.tile_type), tile_compression=str(facts.tile_compression), metadata=json.dumps(metadata, ensure_ascii=False),
        bounds=e7("min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7"), center=f"{e7('center_lon_e7', 'center_lat_e7')},{facts.center_zoom}",
    )


def database_to_archive(spark: SparkSession, source: str, out: str, max_zoom: int | None = None, archives: int | None = None, mode: str = "errorifexists") -> None:
    read = register(spark).read.format("tile_database").option("path", source)
    pairs = read.option("table", "metadata").load()
    facts = header_facts(pairs).first()
    tiles = (read.option("max_zoom", str(max_zoom)) if max_zoom else read).option("table", "tiles").load()
    _write(spark, tiles, facts, {r["name"]: r["value"] for r in pairs.collect()}, out, archives, mode)  # a handful of rows


def archive_to_database(spark: SparkSession, source: str, out: str, databases: int | None = 1, mode: str = "append") -> None:
    read = register(spark).read.format("tile_archive").option("path", source)
    pairs = metadata_rows(read.option("table", "header").load(), read.option("table", "metadata").load())
    metadata = {r["name"]: r["value"] for r in pairs.groupBy("name").agg(F.min("value").alias("value")).collect()}  # a handful of rows
    tiles = read.option("table", "tiles").load().select("z", "x", "y", "data")
    write_database(tiles, out, json.dumps(metadata, ensure_ascii=False), databases, mode)


def archive_to_tree(spark: SparkSession, source: str, out: str, extension: str = ".mvt") -> None:
    read = register(spark).read.format("tile_archive").option("path", source)
    first = read.option("table", "metadata").load().first()
    write_tree(read.option("table", "tiles").load(), out, extension, first["json"] if first else "{}")


def tree_to_archive(spark: SparkSession, source: str, out: str, scheme: str = "zxy", tile_format: str | None = None, max_zoom: int | str | None = None, archives: int | None = None, mode: str = "errorifexists") -> None:
    """``max_zoom`` None takes what the metadata says (else all); ``auto`` takes all and says so in the header."""
    local = source.removeprefix("file://")
    if not os.path.exists(f"{local}/metadata.json"):
        raise ArchiveError("metadata.json is missing")
    with open(f"{local}/metadata.json", encoding="utf-8") as file:
        metadata = json.load(file)
    tile_format = tile_format or metadata.get("format")
    if not tile_format:
        raise ArchiveError("neither an option nor metadata.json names the tile format")
    most = 99 if max_zoom in (None, "auto") and (max_zoom == "auto" or "maxzoom" not in metadata) else int(metadata["maxzoom"] if max_zoom is None else max_zoom)
    register(spark)
    tiles = read_tree(spark, source, scheme, int(metadata.get("minzoom", 0)), most)
    zooms = tree_zooms(spark, source, scheme, int(metadata.get("minzoom", 0)), most)
    metadata = {**metadata, "format": tile_format, "minzoom": metadata.get("minzoom", zooms[0]), "maxzoom": zooms[1]}
    pairs = spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in metadata.items()], "name string, value string")
    _write(spark, tiles, header_facts(pairs).first(), metadata, out, archives, mode)


def found_by_zoom(tiles: DataFrame) -> DataFrame:
    """z and the number of tiles found there."""
    return tiles.groupBy("z").agg(F.count("*").alias("tiles"))
