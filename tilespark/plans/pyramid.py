"""Building pyramids: cover, render by a user's function, drop empty tiles, write."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.facts import FORMATS
from tilespark.functions.hilbert import zxy_to_tile_id
from tilespark.functions.mercator import guess_max_zoom
from tilespark.operators.cutlines import cutline_cover, read_cutlines
from tilespark.operators.navigate import bbox_cover
from tilespark.session import register
from tilespark.sources.codec import ArchiveError
from tilespark.sources.sink import write_archives

Render = Callable[[int, int, int], bytes | None]


def rendered(cover: DataFrame, render: Render, keep_empty: bytes | None = None) -> DataFrame:
    """(tile_id, z, x, y, data) of a cover; tiles that render to None go, or get ``keep_empty``."""

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            data = [render(*a) for a in zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([d if d is not None else keep_empty for d in data], pa.binary())], [*batch.schema.names, "data"])

    rows = cover.select(zxy_to_tile_id("z", "x", "y").alias("tile_id"), F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))
    return rows.mapInArrow(drawn, "tile_id long, z int, x long, y long, data binary").where("data IS NOT NULL")


def without(tiles: DataFrame, empties: DataFrame) -> DataFrame:
    """Tiles whose content is none of ``empties`` (hash, a SHA-256 in hexadecimal)."""
    return tiles.withColumn("hash", F.sha2("data", 256)).join(empties, "hash", "left_anti").drop("hash")


def build_pyramid(
    spark: SparkSession, render: Render, out: str, bounds: tuple[float, float, float, float] | None = None, cutline: str | None = None, min_zoom: int | None = None, max_zoom: int | None = None,
    archives: int = 1, mode: str = "errorifexists", keep_empty: bytes | None = None, name: str | None = None, description: str | None = None, attribution: str | None = None,
    layer_type: str = "overlay", tile_size: int = 256, tile_format: str | None = None, zooms: str | None = None, size: tuple[int, int] | None = None, jobs: int | None = None, **options: str,
) -> None:
    """Render every tile of a box or cutline and write archives, data first.

    Zooms are ``min_zoom`` and ``max_zoom`` or a range such as ``2..7``, either end of which can be left out; the deepest is then
    what a raster of ``size`` pixels over the bounds resolves (5 where no size is given). ``name``, ``description``, ``attribution``,
    ``layer_type`` (overlay or baselayer) and ``tile_size`` become metadata, ``tile_format`` (such as png) the tile type, and
    ``jobs`` tasks render at a time. A cutline's bounds are those of its points.
    Options that only a raster library could honour (resampling, nodata, rgba, warp and
    creation options) are refused: rendering is the caller's function.
    """
    refused = {"resampling", "src_nodata", "dst_nodata", "rgba", "warp", "creation", "open"} & set(options)
    if refused:
        raise ArchiveError(f"not supported without a raster library: {', '.join(sorted(refused))}")
    if (bounds is None) == (cutline is None):
        raise ArchiveError("a pyramid needs either bounds or a cutline")
    if layer_type not in ("overlay", "baselayer"):
        raise ArchiveError("a layer is an overlay or a baselayer")
    if tile_format is not None and tile_format.lower() not in FORMATS:
        raise ArchiveError(f"there is no tile format {tile_format}")
    rings = read_cutlines(spark, cutline) if cutline else None
    if rings is not None:
        bounds = rings.select(F.explode("ring").alias("p")).agg(*[f(F.get("p", i)) for f, i in ((F.min, 0), (F.min, 1), (F.max, 0), (F.max, 1))]).first()[:]
    if zooms is not None:
        min_zoom, max_zoom = (int(part) if part else given for part, given in zip(zooms.split(".."), (min_zoom, max_zoom), strict=True))
    if max_zoom is None:
        max_zoom = 5 if size is None else spark.range(1).select(guess_max_zoom(*map(F.lit, (*size, *bounds)), tile_size=tile_size)).first()[0]
    min_zoom = 0 if min_zoom is None else min_zoom
    if not 0 <= min_zoom <= max_zoom <= 31:
        raise ArchiveError("zooms must be between 0 and 31, the lower one first")
    register(spark)
    cover = cutline_cover(rings, min_zoom, max_zoom) if rings is not None else bbox_cover(spark.createDataFrame([bounds], "west double, south double, east double, north double"), min_zoom, max_zoom)
    facts = {"name": name or os.path.basename(out.rstrip("/")), "type": layer_type, "description": description or out, "attribution": attribution, "tileSize": tile_size}
    options = {"bounds": ",".join(map(repr, bounds)), "metadata": json.dumps({k: v for k, v in facts.items() if v is not None}), **({"tile_type": str(FORMATS[tile_format.lower()])} if tile_format else {}), **options}
    write_archives(rendered(cover.repartition(jobs) if jobs else cover, render, keep_empty), out, archives, mode, layout="data_first", allow_empty="true", **options)
