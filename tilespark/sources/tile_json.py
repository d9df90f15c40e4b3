"""TileJSON documents as a source: the template is filled in over a cover and fetched by tasks.

The cover is that of the document's bounds and zooms, or of narrower ones that are asked for, as intervals of
ids, so planning is small however many tiles there are. Tiles are dealt into ``lanes`` for each
host of the templates. A lane fetches one tile after another, so a host never has more than
``lanes`` requests at a time from the whole cluster, whatever number of tasks run.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterable, Iterator
from functools import partial
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.functions.paths import fill_template
from tilespark.operators.cover import box_intervals, interval_union, tiles_of
from tilespark.sources.codec import ArchiveError

#: Requests of one host at a time, tries of one tile, seconds without a byte, and where bounds are not given.
LANES, TRIES, TIMEOUT, WORLD = 8, 3, 30.0, (-180.0, -85.051129, 180.0, 85.051129)
#: Answers that stand for no tile, and for a server that may answer later.
MISSING, LATER = (204, 404, 410), (429, 500, 502, 503, 504)


def _fetch(url: str, tries: int = TRIES) -> bytes | None:
    """The bytes at an address; None where there is no tile."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:  # noqa: S310
                return None if answer.status == 204 else answer.read()
        except urllib.error.HTTPError as e:
            if e.code in MISSING:
                return None
            if e.code not in LATER or attempt + 1 == tries:
                raise ArchiveError(f"{url}: status {e.code}") from e
        except (OSError, urllib.error.URLError) as e:
            if isinstance(getattr(e, "reason", e), FileNotFoundError):
                return None
            if attempt + 1 == tries:
                raise ArchiveError(f"{url}: {e}") from e
        time.sleep(0.2 * 2**attempt)
    return None


def read_document(path: str) -> dict:
    """A TileJSON document of a file or an address, its templates as whole addresses."""
    address = path if "://" in path else f"file://{path}"
    found = _fetch(address)
    if found is None:
        raise FileNotFoundError(path)
    document = json.loads(found.decode("utf-8-sig"))
    if not isinstance(document, dict) or not document.get("tiles"):
        raise ArchiveError(f"{path} names no tiles")
    return {**document, "tiles": [urljoin(address, t) if "://" not in t else t for t in document["tiles"]]}


def _fetched(batches: Iterator[pa.RecordBatch], most: int = 1 << 24) -> Iterable[pa.RecordBatch]:
    names = ["tile_id", "z", "x", "y", "data"]
    for batch in batches:
        places, data, size = [], [], 0

        def made(places: list[int], data: list[bytes], batch: pa.RecordBatch = batch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(places, pa.int64())) for c in names[:4]), pa.array(data, pa.binary())], names)

        for i, url in enumerate(batch.column("url").to_pylist()):
            if found := _fetch(url):
                places.append(i)
                data.append(found)
                size += len(found)
            if size > most:
                yield made(places, data)
                places, data, size = [], [], 0
        yield made(places, data)


def read_tile_json(spark: SparkSession, path: str, min_zoom: int | str | None = None, max_zoom: int | str | None = None, bounds: str | None = None, lanes: int | str = LANES) -> DataFrame:
    """(tile_id, z, x, y, data) of the tiles that a TileJSON document stands for; those that its server lacks give no row.

    A document without maxzoom needs ``max_zoom``. Several templates share the tiles. Rows (``scheme`` tms) are turned round.
    """
    document, lanes = read_document(path), int(lanes)
    low = max(int(document.get("minzoom", 0)), int(min_zoom or 0))
    most = [int(v) for v in (document.get("maxzoom"), max_zoom) if v is not None]
    if not most:
        raise ArchiveError(f"{path} has no maxzoom: say what max_zoom is")
    west, south, east, north = map(float, bounds.split(",") if bounds else document.get("bounds") or WORLD)
    box = spark.createDataFrame([(west, south, east, north)], "west double, south double, east double, north double")
    tiles = tiles_of(interval_union(box_intervals(box, low, max(low, min(most))))) if low <= min(most) else tiles_of(interval_union(box_intervals(box.limit(0), 0, 0)))
    templates = document["tiles"]
    hosts = sorted({urlsplit(t).netloc for t in templates})
    which = F.pmod(F.col("x") + F.col("y"), F.lit(len(templates))).cast("int")
    row = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("z")) - 1 - F.col("y") if document.get("scheme") == "tms" else F.col("y")
    host = F.get(F.array(*[F.lit(hosts.index(urlsplit(t).netloc)) for t in templates]), which)
    lane = host * lanes + F.pmod(F.xxhash64("tile_id"), F.lit(lanes)).cast("int")
    asked = tiles.select("*", fill_template(F.get(F.array(*[F.lit(t) for t in templates]), which), "z", "x", row).alias("url"), lane.alias("lane"))
    return asked.repartition(lanes * len(hosts), "lane").mapInArrow(partial(_fetched), "tile_id long, z int, x long, y long, data binary")
