"""Web-Mercator geography of tiles, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespark.functions.hilbert import _col

#: The northern limit of the projection, degrees; the equator, metres.
MAX_LAT, EQUATOR_M = 85.051129, 40075016.68
EPSILON = 1e-14


def _tiles(z: Column) -> Column:
    return F.pow(F.lit(2.0), z)


def lonlat_to_tile(lon: Column | str, lat: Column | str, z: Column | str) -> Column:
    """struct(x, y) of the tile that holds a point; points beyond the edges fall into the outer tiles."""
    lon, lat, z = _col(lon), _col(lat), _col(z)
    n = _tiles(z)
    sine = F.sin(F.radians(F.least(F.greatest(lat, F.lit(-MAX_LAT)), F.lit(MAX_LAT))))
    inside = lambda v: F.least(F.greatest(F.floor(v), F.lit(0)), (n - 1).cast("long")).cast("long")
    x = (lon + 180) / 360 * n
    y = (F.lit(0.5) - F.log((1 + sine) / (1 - sine)) / (4 * math.pi)) * n
    return F.struct(inside(x).alias("x"), inside(y).alias("y"))


def _lat_of(y: Column, n: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * y / n))))


def tile_bounds(z: Column | str, x: Column | str, y: Column | str) -> Column:
    """struct(west, south, east, north), degrees."""
    z, x, y = _col(z), _col(x), _col(y)
    n = _tiles(z)
    return F.struct((x / n * 360 - 180).alias("west"), _lat_of(y + 1, n).alias("south"), ((x + 1) / n * 360 - 180).alias("east"), _lat_of(y, n).alias("north"))


def tile_centre(z: Column | str, x: Column | str, y: Column | str) -> Column:
    z, x, y = _col(z), _col(x), _col(y)
    n = _tiles(z)
    return F.struct(((x + 0.5) / n * 360 - 180).alias("lon"), _lat_of(y + 0.5, n).alias("lat"))


def to_metres(lon: Column | str, lat: Column | str) -> Column:
    """struct(x, y): degrees to the projection's metres."""
    lon, lat = _col(lon), _col(lat)
    r = EQUATOR_M / (2 * math.pi)
    return F.struct((F.radians(lon) * r).alias("x"), (F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * r).alias("y"))


def to_degrees(x: Column | str, y: Column | str) -> Column:
    """struct(lon, lat): the projection's metres to degrees."""
    x, y = _col(x), _col(y)
    r = EQUATOR_M / (2 * math.pi)
    return F.struct(F.degrees(x / r).alias("lon"), F.degrees(F.atan(F.sinh(y / r))).alias("lat"))


def clamp_bounds(west: Column | str, south: Column | str, east: Column | str, north: Column | str) -> Column:
    """Bounds drawn in from the antimeridian and the projection's limits."""
    edge = 1e-10
    inside = lambda v, a, b: F.least(F.greatest(_col(v), F.lit(a)), F.lit(b))
    return F.struct(
        inside(west, -180 + edge, 180 - edge).alias("west"), inside(south, -MAX_LAT, MAX_LAT).alias("south"),
        inside(east, -180 + edge, 180 - edge).alias("east"), inside(north, -MAX_LAT, MAX_LAT).alias("north"),
    )


def guess_max_zoom(width: Column | str, height: Column | str, west: Column | str, south: Column | str, east: Column | str, north: Column | str, tile_size: int = 256) -> Column:
    """The zoom whose tiles resolve a raster of so many pixels over bounds in degrees.

    Bounds whose east is west of their west cross the antimeridian.
    """
    width, height = _col(width), _col(height)
    west, east = _col(west), _col(east)
    east = F.when(east < west, east + 360).otherwise(east)
    a = to_metres(west, F.greatest(_col(south), F.lit(-MAX_LAT)))
    b = to_metres(east, F.least(_col(north), F.lit(MAX_LAT)))
    finest = F.least((b["x"] - a["x"]) / width, (b["y"] - a["y"]) / height)
    # a ratio that is a power of two but for rounding counts as that power
    return F.greatest(F.ceil(F.round(F.log2(F.lit(EQUATOR_M) / (tile_size * finest)), 9)), F.lit(0)).cast("int")


def best_overview(factors: Column | str, zoom: Column | str, max_zoom: Column | str) -> Column:
    """The place of the largest overview factor not above a quarter of the scale; null for none."""
    target = F.pow(F.lit(2.0), _col(max_zoom) - _col(zoom)) / 4
    fitting = F.array_max(F.filter(_col(factors), lambda f: f <= target))
    return F.when(fitting.isNotNull(), F.array_position(_col(factors), fitting).cast("int") - 1)


def elevation(r: Column | str, g: Column | str, b: Column | str) -> Column:
    """Metres of a terrain pixel."""
    return _col(r) * 256 + _col(g) + _col(b) / 256 - 32768
