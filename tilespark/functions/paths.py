"""Request paths and URLs as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilespark.functions.hilbert import _col

# The paths that tile servers answer (one character parts row and extension).
TILE_PATH = r"^/([0-9a-zA-Z/!\-_.*'()]+)/(\d+)/(\d+)/(\d+).([a-z]+)$"
TILESET_PATH = r"^/([0-9a-zA-Z/!\-_.*'()]+).json$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def parse_request(path: Column | str) -> Column:
    """struct(ok, name, z, x, y, ext): a tile, a tileset (ext json, no address) or neither."""
    path = _col(path)
    tile, tileset = F.coalesce(path.rlike(TILE_PATH), F.lit(False)), F.coalesce(path.rlike(TILESET_PATH), F.lit(False))
    number = lambda g: F.when(tile, _part(path, TILE_PATH, g).try_cast("long"))
    return F.struct(
        (tile | tileset).alias("ok"),
        F.when(tile, _part(path, TILE_PATH, 1)).when(tileset, _part(path, TILESET_PATH, 1)).otherwise("").alias("name"),
        number(2).alias("z"), number(3).alias("x"), number(4).alias("y"),
        F.when(tile, _part(path, TILE_PATH, 5)).when(tileset, F.lit("json")).otherwise("").alias("ext"),
    )


def archive_path(name: Column | str, template: str) -> Column:
    """Where the archive of a name lies: a template such as ``{name}.tiles``, every ``{name}`` of it put in."""
    return F.replace(F.lit(template), F.lit("{name}"), _col(name))


def parse_tile_url(url: Column | str, scheme: str) -> Column:
    """struct(url, z, x, y) of ``scheme://url/z/x/y``; null if it is none."""
    url = _col(url)
    pattern = rf"{scheme}://(.+)/(\d+)/(\d+)/(\d+)"
    at = lambda g: _part(url, pattern, g)
    return F.when(url.rlike(pattern), F.struct(at(1).alias("url"), *[at(g).try_cast("long").alias(n) for g, n in ((2, "z"), (3, "x"), (4, "y"))]))


def parse_zoom_range(text: Column | str, lowest: int = 0, highest: Column | int = 31) -> Column:
    """struct(min_zoom, max_zoom) of ``a..b``; either side can be left out."""
    parts = F.split(_col(text), r"\.\.")
    side = lambda i: F.trim(F.get(parts, i)).try_cast("int")
    return F.struct(F.coalesce(side(0), F.lit(lowest)).alias("min_zoom"), F.coalesce(side(1), highest if isinstance(highest, Column) else F.lit(highest)).alias("max_zoom"))


def parse_hash(text: Column | str) -> Column:
    """A map of ``#k=v&k=v``."""
    return F.str_to_map(F.regexp_replace(_col(text), "^#", ""), F.lit("&"), F.lit("="))


def build_hash(pairs: Column | str) -> Column:
    """``#k=v&k=v`` of a map."""
    return F.concat(F.lit("#"), F.array_join(F.transform(F.map_entries(_col(pairs)), lambda e: F.concat_ws("=", e["key"], e["value"])), "&"))


def parse_zxy(text: Column | str) -> Column:
    """struct(z, x, y) of ``z/x/y``; null if it is none."""
    text = _col(text)
    pattern = r"^(\d+)/(\d+)/(\d+)$"
    return F.when(text.rlike(pattern), F.struct(*[_part(text, pattern, i + 1).try_cast("long").alias(n) for i, n in enumerate("zxy")]))


def fill_template(template: Column | str, z: Column | str, x: Column | str, y: Column | str) -> Column:
    """``{z}``, ``{x}`` and ``{y}`` of a tile URL template put in."""
    out = _col(template)
    for name, value in (("{z}", z), ("{x}", x), ("{y}", y)):
        out = F.replace(out, F.lit(name), _col(value).cast("string"))
    return out


def allowed_origin(origins: Column | str, origin: Column | str) -> Column:
    """The last entry of a comma list that is the origin or ``*``; null for none."""
    origin = _col(origin)
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.split(_col(origins), ","), lambda o: (o == origin) | (o == "*"))), -1)
