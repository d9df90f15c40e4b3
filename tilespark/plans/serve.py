"""Answers to tile requests, for a table or a stream of them.

``serve`` parses each path, finds its archive by name, and gives the status, headers and
address of the tile; ``with_tiles`` adds the bytes. Archives are a table with the
columns of headers, ``name`` and ``json``; it is joined as it is, so a stream of
requests works as well (a stream-static join).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.functions.facts import REQUEST_EXTENSIONS, bounds_are_valid, choose, entity_tag, media_type, tile_extension, tile_json
from tilespark.functions.hilbert import try_tile_id
from tilespark.functions.paths import allowed_origin, parse_request, parse_tile_url
from tilespark.sources.codec import compress, decompress

# What the two servers answer, by the reason for it.
CACHE_CONTROL = "public, max-age=86400"
SAYS = {
    "lambda": {"no path": (500, "Invalid event configuration"), "bad path": (400, "Invalid tile URL"), "no archive": (403, "Bucket access unauthorized")},
    "edge": {"no path": (404, "Invalid URL"), "bad path": (404, "Invalid URL"), "no archive": (404, "Archive not found")},
}
NO_HOST = (501, "PUBLIC_HOSTNAME must be set for TileJSON")
WRONG_TYPE = "Bad request: requested .%s but archive has type %s"


def _wrong_type(flavor_types: dict[str, int]) -> Column:
    asked = choose(F.col("ext"), flavor_types, F.lit(-1))
    return (asked != F.col("tile_type")) & (tile_extension("tile_type") != "")


def serve(requests: DataFrame, archives: DataFrame, hostname: str | None = None, flavor: str = "lambda", origins: str | None = None) -> DataFrame:
    """``requests`` (path; for edge also method and origin) with the answer's columns.

    status, message, content_type, cache_control, allow_origin, and name, z, x, y, ext,
    tile_id and archive. Tiles that may exist have status 200 until ``with_tiles`` has
    looked; TileJSON is the message of its request. ``lambda`` and ``edge`` differ in
    what they do for unknown paths (400, 404), the method POST (405 at the edge),
    unknown archives (404 at the edge, 403 else) and media types. At the edge all answers
    to paths that it knows can be cached and vary by origin; else only tiles can be cached.
    """
    edge = flavor == "edge"
    parsed = requests.withColumn("_r", parse_request("path"))
    parsed = parsed.select(*requests.columns, "_r.ok", "_r.name", "_r.z", "_r.x", "_r.y", "_r.ext")
    known = archives.select("name", "archive", "tile_type", "min_zoom", "max_zoom", "min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7", "center_zoom", "center_lon_e7", "center_lat_e7", "json")
    rows = parsed.join(known.withColumnRenamed("name", "_name"), F.col("name") == F.col("_name"), "left").drop("_name")
    tileset = F.col("ok") & F.col("z").isNull()
    extension = tile_extension("tile_type")
    wrong = F.format_string(WRONG_TYPE, "ext", extension)
    said = lambda why: (SAYS[flavor][why][0], F.lit(SAYS[flavor][why][1]))
    posted = F.upper("method") == "POST" if edge and "method" in requests.columns else F.lit(False)
    rules = [
        (posted, 405, F.lit("")),
        (F.col("path").isNull(), *said("no path")),
        (~F.col("ok"), *said("bad path")),
        (F.col("archive").isNull(), *said("no archive")),
        *([] if hostname else [(tileset, NO_HOST[0], F.lit(NO_HOST[1]))]),
        (tileset, 200, tile_json(F.concat(F.lit(f"https://{hostname or ''}/"), F.col("name")), "json")),
        ((F.col("z") < F.col("min_zoom")) | (F.col("z") > F.col("max_zoom")), 404, F.lit("")),
        (_wrong_type(REQUEST_EXTENSIONS), 400, wrong),
    ]
    status, message = None, None
    for condition, code, text in rules:
        status = F.when(condition, code) if status is None else status.when(condition, code)
        message = F.when(condition, text) if message is None else message.when(condition, text)
    rows = rows.withColumn("status", status.otherwise(200)).withColumn("message", message.otherwise(""))
    cached = F.coalesce(F.col("ok"), F.lit(False)) & ~F.coalesce(posted, F.lit(False))
    is_tile = (F.col("status") == 200) & F.col("z").isNotNull()
    if origins and "origin" in requests.columns:
        allow = allowed_origin(F.lit(origins), "origin")
    else:
        allow = F.lit(origins)
    return rows.select(
        *requests.columns, "name", "z", "x", "y", "ext", F.when(is_tile, try_tile_id("z", "x", "y")).alias("tile_id"), F.when(is_tile, F.col("archive")).alias("archive"), "status", "message",
        F.when(is_tile, media_type("tile_type", flavor)).when((F.col("status") == 200), F.lit("application/json")).alias("content_type"),
        F.when(cached if edge else is_tile, F.lit(CACHE_CONTROL)).alias("cache_control"), allow.alias("allow_origin"),
        F.when(cached & F.lit(edge), F.lit("Origin")).alias("vary"),
    )


def with_tiles(answers: DataFrame, tiles: DataFrame, archives: DataFrame | None = None, postprocess: Callable[[bytes, int], bytes] | None = None, gateway: bool = False, flavor: str = "lambda") -> DataFrame:
    """Answers with data and etag of their tiles (archive, tile_id, data); 204 where there is none.

    What is sent is decompressed: ``archives`` (headers) says how ``tiles`` are compressed;
    without it they must have been read with ``decompress``. ``postprocess`` gets the
    decompressed bytes and the tile type (which needs ``archives``). The tag is of the bytes
    after that. Behind a ``gateway`` they are sent as gzip, with ``content_encoding``. At
    the edge an empty answer keeps its headers; else it has none.
    """
    if postprocess is not None and archives is None:
        raise ValueError("what is done to tiles depends on their archives' headers")
    found = tiles.select("archive", "tile_id", "data")
    if archives is not None:
        codes = archives.select("archive", F.col("tile_compression").cast("int").alias("_code"), F.col("tile_type").cast("int").alias("_type"))
        found = found.join(codes, "archive").select("archive", "tile_id", _prepared(postprocess)("data", "_code", "_type").alias("data"))
    rows = answers.join(found, ["archive", "tile_id"], "left")
    asked = F.col("archive").isNotNull()
    gone = asked & F.col("data").isNull()
    kept = ~gone | F.lit(flavor == "edge")
    sent = asked & ~gone
    return rows.select(
        *[c for c in answers.columns if c not in ("status", "content_type", "cache_control")], F.when(gone, 204).otherwise(F.col("status")).alias("status"),
        F.when(kept, F.col("content_type")).alias("content_type"), F.when(kept, F.col("cache_control")).alias("cache_control"),
        F.when(sent & F.lit(gateway), F.lit("gzip")).alias("content_encoding"), (_gzipped()("data") if gateway else F.col("data")).alias("data"),
        F.when(sent, entity_tag("data")).alias("etag"),
    )


def _prepared(postprocess: Callable[[bytes, int], bytes] | None):
    """Decompressed bytes by compression, and what ``postprocess`` makes of them by tile type."""

    @F.pandas_udf("binary")
    def prepare(data: pd.Series, code: pd.Series, kind: pd.Series) -> pd.Series:
        plain = [None if d is None else decompress(d, int(c)) for d, c in zip(data, code)]
        return pd.Series([d if d is None or postprocess is None else postprocess(d, int(k)) for d, k in zip(plain, kind)], dtype=object)

    return prepare


def _gzipped():
    @F.pandas_udf("binary")
    def pack(data: pd.Series) -> pd.Series:
        return data.map(lambda d: None if d is None else compress(d, 2))

    return pack


def protocol(requests: DataFrame, archives: DataFrame, scheme: str, error_on_missing: bool = False) -> DataFrame:
    """Requests of map clients (url ``scheme://archive/z/x/y``) with state and address.

    state: INVALID (no such URL), OUTSIDE (beyond the zooms) or FOUND (to be looked up);
    ``bounds_valid`` says whether the archive's bounds make sense. For missing tiles,
    ``missing`` is what the client gets: empty bytes or an error for vector tiles,
    nothing for pictures.
    """
    rows = requests.withColumn("_u", parse_tile_url("url", scheme))
    rows = rows.select(*requests.columns, F.col("_u.url").alias("name"), "_u.z", "_u.x", "_u.y")
    known = archives.withColumn("bounds_valid", bounds_are_valid()).select(F.col("name").alias("_name"), "archive", "tile_type", "min_zoom", "max_zoom", "bounds_valid")
    rows = rows.join(known, F.col("name") == F.col("_name"), "left").drop("_name")
    state = F.when(F.col("z").isNull(), "INVALID").when(F.col("archive").isNull() | ~F.col("z").between(F.col("min_zoom"), F.col("max_zoom")), "OUTSIDE").otherwise("FOUND")
    vector = F.col("tile_type").isin(1, 6)
    missing = F.when(vector & F.lit(error_on_missing), "error").when(vector, "empty").otherwise("null")
    return rows.select(*requests.columns, "name", "z", "x", "y", "archive", try_tile_id("z", "x", "y").alias("tile_id"), state.alias("state"), missing.alias("missing"), "bounds_valid")


def loaded_state(answers: DataFrame) -> DataFrame:
    """The state that a map layer gives a tile: EMPTY, ERROR or LOADED, from status (null: no answer)."""
    return answers.withColumn("state", F.when(F.col("status").isNull() | (F.col("status") >= 400), "ERROR").when(F.col("status") == 204, "EMPTY").otherwise("LOADED"))
