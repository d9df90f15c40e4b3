"""Bytes of archives: variable-length numbers, directories, headers, compression.

A directory is a handful of columns, so it is coded column by column with NumPy.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Callable, Iterator

import numpy as np

from tilespark.schema import HEADER_BYTES, HEADER_FIELDS, MAGIC, VERSION


class ArchiveError(ValueError):
    """The bytes are not what the archive format asks for."""


class MagicError(ArchiveError):
    """Not an archive at all."""


class VersionError(ArchiveError):
    """An archive of a version that this reader does not read."""


class DirectoryError(ArchiveError):
    """A directory that is cut short, too long, or has impossible numbers."""


class CompressionError(ArchiveError):
    """A compression that cannot be undone here."""


class ChangedError(ArchiveError):
    """The archive changed while it was being read."""


def encode_varints(values: np.ndarray) -> bytes:
    """Numbers in groups of seven bits, lowest first, all but the last group marked."""
    values = np.asarray(values, np.uint64)
    if not len(values):
        return b""
    shifts = np.arange(0, 70, 7, dtype=np.uint64)
    groups = np.where(shifts < 64, values[:, None] >> np.minimum(shifts, 63), 0)
    groups[:, 9] = values >> np.uint64(63)
    size = np.maximum(1, (groups != 0).cumsum(1).argmax(1) + 1)
    size[values == 0] = 1
    place = np.arange(10)
    out = (groups & np.uint64(127)).astype(np.uint8) | np.where(place < size[:, None] - 1, 128, 0).astype(np.uint8)
    return out[place < size[:, None]].tobytes()


def decode_varints(data: bytes) -> np.ndarray:
    """All numbers of ``data``, which must end with a whole one."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    ends = np.flatnonzero(raw < 128)
    if not len(ends) or ends[-1] != len(raw) - 1:
        raise DirectoryError("a number is cut short")
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts + 1
    if size.max() > 10 or (raw[ends[size == 10]] > 1).any():
        raise DirectoryError("a number is too long")
    place = np.arange(len(raw)) - np.repeat(starts, size)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def decode_varint(data: bytes) -> int:
    """The first number of ``data``."""
    end = next((i for i, b in enumerate(data[:11]) if b < 128), None)
    if end is None:
        raise DirectoryError("a number is cut short" if len(data) < 10 else "a number is too long")
    return int(decode_varints(data[: end + 1])[0])


def encode_directory(entries: np.ndarray, allow_empty: bool = False) -> bytes:
    """Entries (rows of tile_id, offset, length, run_length, by tile_id) as one uncompressed directory.

    Ids are differences; an offset is 0 where it follows on the entry before it, else one more than itself.
    """
    entries = np.asarray(entries, np.int64).reshape(-1, 4)
    if not len(entries) and not allow_empty:
        raise DirectoryError("a directory must have entries")
    ids, offsets, lengths, runs = entries.T
    follows = np.zeros(len(ids), bool)
    follows[1:] = offsets[1:] == offsets[:-1] + lengths[:-1]
    columns = [np.array([len(ids)]), np.diff(ids, prepend=0), runs, lengths, np.where(follows, 0, offsets + 1)]
    return encode_varints(np.concatenate(columns).astype(np.uint64))


def decode_directory(data: bytes) -> np.ndarray:
    """Rows of tile_id, offset, length, run_length of an uncompressed directory."""
    values = decode_varints(data)
    if not len(values):
        raise DirectoryError("a directory has no count")
    count = int(values[0])
    if count * 4 > len(data) or len(values) != 1 + 4 * count:
        raise DirectoryError("a directory's count does not fit its bytes")
    if (values >> np.uint64(63)).any():
        raise DirectoryError("a number is out of range")
    deltas, runs, lengths, coded = values[1:].astype(np.int64).reshape(4, count)
    if (runs >> 32).any() or (lengths >> 32).any():
        raise DirectoryError("a length is out of range")
    ids = np.cumsum(deltas)
    if (ids < 0).any() or (np.diff(ids) < 0).any():
        raise DirectoryError("tile ids are out of range")
    if count and coded[0] == 0:
        raise DirectoryError("the first offset follows on nothing")
    # a run of zeros continues from the last written offset: its start plus the lengths since
    written = np.maximum.accumulate(np.where(coded > 0, np.arange(count), 0)) if count else coded
    before = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if count else coded
    offsets = (coded[written] - 1) + before - before[written] if count else coded
    return np.stack([ids, offsets, lengths, runs], axis=1)


def encode_header(fields: dict) -> bytes:
    values = [int(fields[n]) for n, _ in HEADER_FIELDS]
    return MAGIC + bytes([VERSION]) + struct.pack("<" + "".join(k for _, k in HEADER_FIELDS), *values)


def decode_header(data: bytes) -> dict:
    if data[: len(MAGIC)] != MAGIC:
        raise MagicError("this is not an archive: its first bytes are wrong")
    if len(data) <= len(MAGIC) or data[len(MAGIC)] != VERSION:
        raise VersionError(f"archive version {data[len(MAGIC)] if len(data) > len(MAGIC) else None} is not supported")
    if len(data) < HEADER_BYTES:
        raise ArchiveError("the header is cut short")
    values = struct.unpack("<" + "".join(k for _, k in HEADER_FIELDS), data[len(MAGIC) + 1 : HEADER_BYTES])
    fields = {n: v for (n, _), v in zip(HEADER_FIELDS, values)}
    if any(v >= 1 << 63 for v in values):
        raise ArchiveError("a header number is out of range")
    return {"version": VERSION, **fields, "clustered": fields["clustered"] == 1}


def _zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def _to_zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor().compress(data)


#: By code: how to undo and how to do a compression. More can be registered here.
DECOMPRESS: dict[int, Callable[[bytes], bytes]] = {0: bytes, 1: bytes, 2: gzip.decompress, 4: _zstd}
COMPRESS: dict[int, Callable[[bytes], bytes]] = {0: bytes, 1: bytes, 2: lambda data: gzip.compress(data, mtime=0), 4: _to_zstd}


def decompress(data: bytes, code: int) -> bytes:
    if code not in DECOMPRESS:
        raise CompressionError(f"compression {code} is not supported")
    return DECOMPRESS[code](data)


def compress(data: bytes, code: int) -> bytes:
    if code not in COMPRESS:
        raise CompressionError(f"compression {code} is not supported")
    return COMPRESS[code](data)


def fields_of(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a tagged binary message; 64- and 32-bit values are bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        end = at
        while message[end] >= 128:
            end += 1
        out = sum((b & 127) << (7 * i) for i, b in enumerate(message[at : end + 1]))
        at = end + 1
        return out

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(kind) or number()
        yield tag >> 3, message[at : at + size]
        at += size
