"""Looking into archives: features and layers of vector tiles, histograms, pages, tileset facts."""

from __future__ import annotations

import gzip
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.functions.facts import from_e7, metadata_value, vector_layers
from tilespark.functions.hilbert import LEVEL_STARTS, MAX_ZOOM, zoom_of
from tilespark.sources.codec import decode_varints, fields_of

FEATURES = "layer string, geom_type int, id long, properties map<string,string>, extent int"


def _value(message: bytes) -> str:
    """A tagged value as text: string, float, double, numbers or boolean."""
    for field, value in fields_of(message):
        if field == 1:
            return value.decode("utf-8", "replace")
        if field in (2, 3):
            number = float(np.frombuffer(value, "<f4" if field == 2 else "<f8")[0])
            return str(int(number)) if number.is_integer() else str(number)
        if field == 6:
            return str((value >> 1) ^ -(value & 1))
        if field == 7:
            return "true" if value else "false"
        return str(value if field != 4 or value < 1 << 63 else value - (1 << 64))
    return ""


def decode_tags(packed: bytes) -> list[int]:
    return decode_varints(packed).astype(np.int64).tolist()


def _layer(message: bytes) -> Iterator[tuple]:
    name, extent, keys, values, features = "", 4096, [], [], []
    for field, value in fields_of(message):
        if field == 1:
            name = value.decode("utf-8", "replace")
        elif field == 2:
            features.append(value)
        elif field == 3:
            keys.append(value.decode("utf-8", "replace"))
        elif field == 4:
            values.append(_value(value))
        elif field == 5:
            extent = value
    for feature in features:
        number, kind, tags = 0, 0, []
        for field, value in fields_of(feature):
            if field == 1:
                number = value
            elif field == 2:
                tags = decode_tags(value)
            elif field == 3:
                kind = value
        yield name, kind, number, [(keys[k], values[v]) for k, v in zip(tags[::2], tags[1::2])], extent


def features(tiles: DataFrame) -> DataFrame:
    """One row a feature of (tile columns, data): layer, geom_type, id, properties, extent. Data may be gzip."""
    keep = [f for f in tiles.schema.fields if f.name != "data"]
    names = [f.name for f in keep]

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, data in enumerate(batch.column("data").to_pylist()):
                plain = gzip.decompress(data) if data and data[:2] == b"\x1f\x8b" else data or b""
                for field, layer in fields_of(plain):
                    if field == 3:
                        found = list(_layer(layer))
                        rows += found
                        at += [i] * len(found)
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.int32()]
            made = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(pa.array(at, pa.int64())) for n in names), *made], [*names, "layer", "geom_type", "id", "properties", "extent"])

    schema = T.StructType([*keep, *T.StructType.fromDDL(FEATURES).fields])
    return tiles.mapInArrow(decoded, schema)


def layer_counts(found: DataFrame, declared: DataFrame) -> DataFrame:
    """Features of each declared layer (id), 0 for layers without any."""
    counts = found.groupBy("layer").agg(F.count("*").alias("features"))
    return declared.join(counts, declared["id"] == counts["layer"], "left").select("id", F.coalesce("features", F.lit(0)).alias("features"))


def largest_extent(found: DataFrame) -> DataFrame:
    return found.agg(F.max("extent").alias("extent"))


def visible(found: DataFrame, layers: DataFrame) -> DataFrame:
    """Features of layers (id, visible) that are shown; layers that are not listed are hidden."""
    return found.join(layers.where("visible"), found["layer"] == layers["id"], "left_semi")


def drawing_order(found: DataFrame) -> DataFrame:
    """Areas before lines before points; ties by layer and id."""
    return found.orderBy(F.desc("geom_type"), "layer", "id")


def zoom_histogram(entries: DataFrame) -> DataFrame:
    """Tiles at each zoom: z and tiles. A run that passes from one zoom to the next is split there."""
    own = entries.where("run_length > 0").select("tile_id", (F.col("tile_id") + F.col("run_length") - 1).alias("last"))
    zooms = own.withColumn("z", F.explode(F.sequence(zoom_of("tile_id"), zoom_of("last"))))
    bounds = F.array(*[F.lit(s).cast("long") for s in [*LEVEL_STARTS, LEVEL_STARTS[-1] + 4**MAX_ZOOM]])
    tiles = F.least("last", F.get(bounds, F.col("z") + 1) - 1) - F.greatest("tile_id", F.get(bounds, F.col("z"))) + 1
    return zooms.groupBy("z").agg(F.sum(tiles).cast("long").alias("tiles"))


def tms_order(tiles: DataFrame) -> DataFrame:
    """By zoom, column, and row from the south."""
    return tiles.orderBy("z", "x", F.desc("y"))


def page(entries: DataFrame, number: int, size: int = 1000) -> DataFrame:
    """A page of entries by id, as a viewer shows them."""
    return entries.orderBy("tile_id").offset(number * size).limit(size)


def tileset_facts(header: DataFrame, metadata: DataFrame) -> DataFrame:
    """What a viewer asks of each archive: bounds, zooms, layers, encoding, whether vector, whether overlay."""
    rows = header.join(metadata, "archive")
    return rows.select(
        "archive", F.array(*[from_e7(f"{a}_{b}_e7") for a, b in (("min", "lon"), ("min", "lat"), ("max", "lon"), ("max", "lat"))]).alias("bounds"),
        "min_zoom", "max_zoom", F.transform(vector_layers("json"), lambda v: v["id"]).alias("layers"), metadata_value("json", "encoding").alias("encoding"),
        F.col("tile_type").isin(1, 6).alias("is_vector"), F.coalesce(metadata_value("json", "type") == "overlay", F.lit(False)).alias("is_overlay"),
    )
