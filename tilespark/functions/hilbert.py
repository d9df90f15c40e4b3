"""Tile addresses: (zoom, column, row) to and from the cumulative Hilbert position.

A tile id counts all tiles of the lower zooms and then the position along the Hilbert
curve of its own zoom. Read from the top bit down, each level gives one base-4 digit of
the position; what orientation the curve has below is two flags, swapped axes and
inverted axes, that the bits so far decide. ``zxy_to_tile_id`` and its inverse fold over
the levels as plain columns: the position so far and the two flags are one number, and a
level is one look-up in a table of sixteen; ``bulk_tile_id`` and ``bulk_zxy`` do the same
levels on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ZOOM = 31
#: The first id of each zoom.
LEVEL_STARTS = [(4**z - 1) // 3 for z in range(MAX_ZOOM + 1)]
#: The id after the last of the deepest zoom.
END = LEVEL_STARTS[-1] + 4**MAX_ZOOM


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def level_start(z: Column | str) -> Column:
    """The first id of a zoom; null outside 0 to 31."""
    return F.get(F.array(*[_long(s) for s in LEVEL_STARTS]), _col(z).cast("int"))


def zoom_of(tile_id: Column | str) -> Column:
    """The zoom of an id, by comparison with the level starts (no arithmetic near 2^63)."""
    tile_id = _col(tile_id)
    zoom = F.size(F.filter(F.array(*[_long(s) for s in LEVEL_STARTS]), lambda s: s <= tile_id)) - 1
    return F.when((tile_id >= 0) & (tile_id < _long(END)), zoom)


def is_address(z: Column | str, x: Column | str, y: Column | str) -> Column:
    z, x, y = _col(z), _col(x), _col(y)
    inside = F.call_function("shiftleft", _long(1), F.greatest(F.least(z.cast("int"), F.lit(MAX_ZOOM)), F.lit(0)))
    return F.coalesce((z >= 0) & (z <= MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < inside) & (y < inside), F.lit(False))


def _levels(z: Column) -> Column:
    return F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))


def _shift(value: Column, by: Column, left: bool = False, unsigned: bool = False) -> Column:
    return F.call_function("shiftleft" if left else "shiftrightunsigned" if unsigned else "shiftright", value, by)


def turns() -> list[tuple[int, int, int, int]]:
    """By flags (swap, flip) and bits of column and row, as one number: the digit, the bits back from it, and the next flags."""
    out = []
    for state in range(4):
        swap, flip = state >> 1, state & 1
        for bits in range(4):
            a, b = (bits >> 1) ^ flip, (bits & 1) ^ flip
            a, b = (b, a) if swap else (a, b)
            turned = 1 - b
            out.append((state, bits, (3 * a) ^ b, (swap ^ turned) << 1 | (flip ^ (turned & a))))
    return out


#: By flags and bits: digit and next flags. By flags and digit: bits, parted as columns and rows are kept, and next flags.
_ENCODE = [digit << 2 | after for _, _, digit, after in turns()]
_DECODE = [(bits >> 1) << 33 | (bits & 1) << 2 | after for _, _, bits, after in sorted((state, digit, bits, after) for state, bits, digit, after in turns())]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _looked_up(table: list[int], flags: Column, two_bits: Column) -> Column:
    return F.get(F.array(*[_long(v) for v in table]), (_shift(flags.bitwiseAND(_long(3)), F.lit(2), True).bitwiseOR(two_bits)).cast("int"))


def try_tile_id(z: Column | str, x: Column | str, y: Column | str) -> Column:
    """The id of an address, null where there is none."""
    z, x, y = _col(z).cast("int"), _col(x).cast("long"), _col(y).cast("long")

    def encode(at: Column) -> Column:
        def step(kept: Column, level: Column) -> Column:
            bits = _shift(_shift(at["x"], level).bitwiseAND(_long(1)), F.lit(1), True).bitwiseOR(_shift(at["y"], level).bitwiseAND(_long(1)))
            return _shift(kept.bitwiseAND(_long(-4)), F.lit(2), True).bitwiseOR(_looked_up(_ENCODE, kept, bits))

        # 62 bits of the position and two flags fill a long
        return _shift(F.aggregate(_levels(at["z"]), _long(0), step), F.lit(2), unsigned=True)

    at = F.struct(z.alias("z"), x.alias("x"), y.alias("y"))
    return F.when(is_address(z, x, y), level_start(z) + _let(at, encode))


def zxy_to_tile_id(z: Column | str, x: Column | str, y: Column | str) -> Column:
    """The id of an address; an error where zoom, column or row is out of range."""
    zc, xc, yc = _col(z), _col(x), _col(y)
    bad = F.concat(F.lit("no such tile: "), F.concat_ws("/", zc.cast("string"), xc.cast("string"), yc.cast("string")))
    missing = zc.isNull() | xc.isNull() | yc.isNull()
    return F.when(missing, F.lit(None).cast("long")).when(is_address(z, x, y), try_tile_id(z, x, y)).otherwise(F.raise_error(bad).cast("long"))


def try_zxy(tile_id: Column | str) -> Column:
    """struct(z int, x long, y long) of an id, null where there is none."""
    tile_id = _col(tile_id).cast("long")

    def decode(at: Column) -> Column:
        def step(kept: Column, level: Column) -> Column:
            digit = _shift(at["rest"], _shift(level, F.lit(1), True)).bitwiseAND(_long(3))
            return _shift(kept.bitwiseAND(_long(-4)), F.lit(1), True).bitwiseOR(_looked_up(_DECODE, kept, digit))

        # column and row, 31 bits each, and two flags fill a long
        both = F.aggregate(_levels(at["z"]), _long(0), step)
        return _let(both, lambda v: F.struct(at["z"].alias("z"), _shift(v, F.lit(33), unsigned=True).alias("x"), _shift(v, F.lit(2)).bitwiseAND(_long((1 << 31) - 1)).alias("y")))

    rest = lambda z: F.struct(z.alias("z"), (tile_id - level_start(z)).alias("rest"))
    return F.when((tile_id >= 0) & (tile_id < _long(END)), _let(_let(zoom_of(tile_id), rest), decode))


def tile_id_to_zxy(tile_id: Column | str) -> Column:
    """struct(z, x, y) of an id; an error for a negative id or one past the deepest zoom."""
    tile_id = _col(tile_id)
    bad = F.concat(F.lit("no such tile id: "), tile_id.cast("string"))
    none = F.lit(None).cast("struct<z:int,x:bigint,y:bigint>")
    return F.when(tile_id.isNull(), none).when((tile_id >= 0) & (tile_id < _long(END)), try_zxy(tile_id)).otherwise(F.raise_error(bad).cast("struct<z:int,x:bigint,y:bigint>"))


def flip_row(z: Column | str, y: Column | str) -> Column:
    """Rows counted from the other edge."""
    return F.call_function("shiftleft", _long(1), _col(z).cast("int")) - 1 - _col(y)


def _encode(z: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d, swap, flip = (np.zeros(len(z), np.int64) for _ in range(3))
    for level in range(int(z.max(initial=0)) - 1, -1, -1):
        live = z > level
        bx, by = (x >> level & 1) ^ flip, (y >> level & 1) ^ flip
        diff = (bx ^ by) & swap
        bx, by = bx ^ diff, by ^ diff
        turned = np.where(live, 1 - by, 0)
        d = np.where(live, d * 4 + ((bx * 3) ^ by), d)
        swap, flip = swap ^ turned, flip ^ (turned & bx)
    return np.array(LEVEL_STARTS, np.int64)[z] + d


def _decode(tile_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts = np.array(LEVEL_STARTS, np.int64)
    z = np.searchsorted(starts, tile_id, "right") - 1
    rest = tile_id - starts[z]
    x, y, swap, flip = (np.zeros(len(z), np.int64) for _ in range(4))
    for level in range(int(z.max(initial=0)) - 1, -1, -1):
        live = z > level
        digit = rest >> (2 * level) & 3
        bx = digit >> 1
        by = (digit ^ bx) & 1
        turned = np.where(live, 1 - by, 0)
        diff = (bx ^ by) & swap
        x = np.where(live, x * 2 + (bx ^ diff ^ flip), x)
        y = np.where(live, y * 2 + (by ^ diff ^ flip), y)
        swap, flip = swap ^ turned, flip ^ (turned & bx)
    return z, x, y


def bulk_tile_id(z: Column | str, x: Column | str, y: Column | str) -> Column:
    """``try_tile_id`` on Arrow batches."""

    @F.pandas_udf("long")
    def encode(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        good = z.notna() & x.notna() & y.notna() & (z >= 0) & (z <= MAX_ZOOM) & (x >= 0) & (y >= 0)
        zs, xs, ys = (s.where(good, 0).to_numpy(np.int64) for s in (z, x, y))
        good &= (xs < (1 << zs)) & (ys < (1 << zs))
        ids = _encode(np.where(good, zs, 0), np.where(good, xs, 0), np.where(good, ys, 0))
        return pd.Series(ids, dtype="Int64").where(good.to_numpy(), pd.NA)

    return encode(_col(z), _col(x), _col(y))


def bulk_zxy(tile_id: Column | str) -> Column:
    """``try_zxy`` on Arrow batches."""

    @F.pandas_udf("z int, x long, y long")
    def decode(tile_id: pd.Series) -> pd.DataFrame:
        good = (tile_id.notna() & (tile_id >= 0) & (tile_id < END)).to_numpy()
        z, x, y = _decode(tile_id.where(good, 0).to_numpy(np.int64))
        return pd.DataFrame({"z": pd.Series(z, dtype="Int32").where(good), "x": pd.Series(x, dtype="Int64").where(good), "y": pd.Series(y, dtype="Int64").where(good)})

    return decode(_col(tile_id))
