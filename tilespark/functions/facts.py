"""Facts of archives as columns: names, extensions, media types, bounds, TileJSON, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespark.functions.hilbert import _col
from tilespark.schema import COMPRESSIONS, EXTENSIONS, TILE_TYPES, VECTOR_LAYERS

# Media types, and formats of tile databases with the types they stand for.
MEDIA_TYPES = {1: "application/vnd.mapbox-vector-tile", 2: "image/png", 3: "image/jpeg", 4: "image/webp", 5: "image/avif"}
EDGE_MEDIA_TYPES = {1: "application/x-protobuf", 2: "image/png", 3: "image/jpeg", 4: "image/webp"}
PROTOCOL_MEDIA_TYPES = {2: "image/png", 3: "image/jpeg", 4: "image/webp", 5: "image/avif"}
FORMATS = {"pbf": 1, "png": 2, "jpeg": 3, "jpg": 3, "webp": 4, "avif": 5, "mlt": 6}
REQUEST_EXTENSIONS = {"mvt": 1, "pbf": 1, "png": 2, "jpg": 3, "webp": 4, "avif": 5, "mlt": 6}
SIZE_UNITS = ("Bytes", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
WORLD = (-180.0, -85.05112878, 180.0, 85.05112878)


def choose(value: Column, names: dict, otherwise: Column | None = None) -> Column:
    """The entry of a small table, as one CASE; ``otherwise`` (null) if there is none."""
    out = None
    for k, v in names.items():
        out = F.when(value == k, F.lit(v)) if out is None else out.when(value == k, F.lit(v))
    return out.otherwise(otherwise if otherwise is not None else F.lit(None))


def tile_extension(tile_type: Column | str) -> Column:
    return choose(_col(tile_type), EXTENSIONS, F.lit(""))


def tile_type_name(tile_type: Column | str) -> Column:
    return choose(_col(tile_type), TILE_TYPES, F.lit("out of spec"))


def compression_name(compression: Column | str) -> Column:
    return choose(_col(compression), COMPRESSIONS, F.lit("out of spec"))


def media_type(tile_type: Column | str, flavor: str = "lambda") -> Column:
    """The media type that a server of this flavour (lambda, edge, protocol) names; null for none."""
    return choose(_col(tile_type), {"lambda": MEDIA_TYPES, "edge": EDGE_MEDIA_TYPES, "protocol": PROTOCOL_MEDIA_TYPES}[flavor])


def tile_type_of_format(name: Column | str) -> Column:
    return choose(F.lower(_col(name)), FORMATS, F.lit(0)).cast("smallint")


def compression_of_format(name: Column | str, compression: Column | str) -> Column:
    """Vector tiles and those said to be gzip are gzip (2), all others plain (1)."""
    return F.when((F.lower(_col(name)) == "pbf") | F.coalesce(_col(compression) == "gzip", F.lit(False)), 2).otherwise(1).cast("smallint")


def to_e7(degrees: Column | str) -> Column:
    """Degrees to ten-millionths, cut towards zero."""
    return (_col(degrees) * 1e7).cast("int")


def from_e7(e7: Column | str) -> Column:
    return _col(e7) / 1e7


def parse_bounds(text: Column | str) -> Column:
    """struct(min_lon_e7, min_lat_e7, max_lon_e7, max_lat_e7) of ``w,s,e,n``; the world if it can't be read."""
    parts = F.transform(F.split(_col(text), ","), lambda p: F.trim(p).try_cast("double"))
    good = F.coalesce((F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull()), F.lit(False))
    names = ("min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7")
    return F.struct(*[to_e7(F.when(good, F.get(parts, i)).otherwise(F.lit(WORLD[i]))).alias(n) for i, n in enumerate(names)])


def parse_center(text: Column | str, bounds: Column, min_zoom: Column | str) -> Column:
    """struct(center_lon_e7, center_lat_e7, center_zoom) of ``lon,lat,zoom``; the middle of the bounds if it can't be read."""
    parts = F.transform(F.split(_col(text), ","), lambda p: F.trim(p).try_cast("double"))
    good = F.coalesce((F.size(parts) >= 3) & F.get(parts, 0).isNotNull() & F.get(parts, 1).isNotNull() & F.get(parts, 2).isNotNull(), F.lit(False))
    middle = lambda a, b: F.floor((a.cast("long") + b.cast("long")) / 2).cast("int")
    return F.struct(
        F.when(good, to_e7(F.get(parts, 0))).otherwise(middle(bounds["min_lon_e7"], bounds["max_lon_e7"])).alias("center_lon_e7"),
        F.when(good, to_e7(F.get(parts, 1))).otherwise(middle(bounds["min_lat_e7"], bounds["max_lat_e7"])).alias("center_lat_e7"),
        F.when(good, F.get(parts, 2).cast("int")).otherwise(_col(min_zoom).cast("int")).alias("center_zoom"),
    )


def entity_tag(data: Column | str) -> Column:
    return F.concat(F.lit('"'), F.sha2(_col(data), 256), F.lit('"'))


def format_bytes(size: Column | str) -> Column:
    """A size in units of 1024 bytes, with two decimals at most and no zeros at their end."""
    size = _col(size)
    out = F.concat(size.cast("string"), F.lit(f" {SIZE_UNITS[0]}"))
    for power, unit in enumerate(SIZE_UNITS[1:], 1):
        # halves are rounded up
        value = F.format_string("%.2f", F.floor(size / 1024**power * 100 + 0.5) / 100)
        plain = F.regexp_replace(F.regexp_replace(value, "0+$", ""), r"\.$", "")
        out = F.when(size >= 1024**power, F.concat(plain, F.lit(f" {unit}"))).otherwise(out)
    return F.when(size.isNotNull(), out)


def metadata_value(json: Column | str, name: str) -> Column:
    return F.get_json_object(_col(json), f"$.{name}")


def vector_layers(json: Column | str) -> Column:
    return F.from_json(F.get_json_object(_col(json), "$.vector_layers"), VECTOR_LAYERS)


def tile_json(base_url: Column | str, json: Column | str) -> Column:
    """TileJSON 3.0.0 of an archive, from header columns of the same row; absent keys are left out."""
    degrees = lambda *names: F.array(*[from_e7(n) for n in names])
    return F.to_json(
        F.struct(
            F.lit("3.0.0").alias("tilejson"), F.lit("xyz").alias("scheme"),
            F.array(F.concat(_col(base_url), F.lit("/{z}/{x}/{y}"), tile_extension("tile_type"))).alias("tiles"),
            vector_layers(json).alias("vector_layers"),
            *[metadata_value(json, n).alias(n) for n in ("attribution", "description", "name", "version")],
            degrees("min_lon_e7", "min_lat_e7", "max_lon_e7", "max_lat_e7").alias("bounds"),
            F.array(from_e7("center_lon_e7"), from_e7("center_lat_e7"), F.col("center_zoom").cast("double")).alias("center"),
            F.col("min_zoom").alias("minzoom"), F.col("max_zoom").alias("maxzoom"),
        )
    )


def protocol_tile_json(url: Column | str) -> Column:
    """The short TileJSON that map clients ask for by protocol URL."""
    return F.to_json(
        F.struct(
            F.array(F.concat(_col(url), F.lit("/{z}/{x}/{y}"))).alias("tiles"), F.col("min_zoom").alias("minzoom"), F.col("max_zoom").alias("maxzoom"),
            F.array(from_e7("min_lon_e7"), from_e7("min_lat_e7"), from_e7("max_lon_e7"), from_e7("max_lat_e7")).alias("bounds"),
        )
    )


def bounds_are_valid() -> Column:
    return (F.col("min_lon_e7") < F.col("max_lon_e7")) & (F.col("min_lat_e7") < F.col("max_lat_e7"))


def metadata_faults(json: Column | str) -> Column:
    """What is wrong with an archive's metadata (header column tile_type in the same row): an array of names."""
    json = _col(json)
    kind, version = metadata_value(json, "type"), metadata_value(json, "version")
    semver = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$"
    checks = {
        "not an object": ~F.coalesce(F.trim(json).startswith("{") & F.get_json_object(json, "$").isNotNull(), F.lit(False)),
        "type": kind.isNotNull() & ~kind.isin("overlay", "baselayer"),
        "version": version.isNotNull() & ~version.rlike(semver),
        "vector_layers": (F.col("tile_type") == 1) & F.get_json_object(json, "$.vector_layers").isNull(),
    }
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
