"""Bytes of archives: golden values and errors."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tilespark.schema import HEADER_BYTES, HEADER_FIELDS, MAGIC, MAX_ROOT_BYTES
from tilespark.sources import codec
from tilespark.sources.sink import pack_directories


def test_varints():
    assert codec.decode_varints(bytes.fromhex("00017fe58e26")).tolist() == [0, 1, 127, 624485]
    assert codec.decode_varints(bytes.fromhex("ffffffffffffff0f")).tolist() == [9007199254740991]
    assert codec.encode_varints(np.array([0, 1, 127, 624485])) == bytes.fromhex("00017fe58e26")
    assert codec.decode_varint(b"\xe5\x8e\x26\x00") == 624485
    for bad in (b"", b"\x80"):
        with pytest.raises(codec.DirectoryError):
            codec.decode_varint(bad)
    with pytest.raises(codec.DirectoryError):
        codec.decode_varints(b"\xff" * 10 + b"\x01")


@given(st.lists(st.integers(0, 2**64 - 1), max_size=50))
def test_varints_round_trip(values):
    assert codec.decode_varints(codec.encode_varints(np.array(values, np.uint64))).tolist() == values


def test_directory_round_trip():
    entries = np.array([[0, 0, 0, 0], [1, 1, 1, 1], [2, 2, 2, 2]])
    assert codec.decode_directory(codec.encode_directory(entries)).tolist() == entries.tolist()
    # ids 5, 42, 69 are stored as 5, 37, 27
    coded = codec.decode_varints(codec.encode_directory(np.array([[5, 1337, 42, 1], [42, 1379, 8, 1], [69, 0, 1, 1]])))
    assert coded.tolist() == [3, 5, 37, 27, 1, 1, 1, 42, 8, 1, 1338, 0, 1]


@given(st.lists(st.tuples(st.integers(1, 1 << 40), st.integers(0, 1 << 50), st.integers(1, 1 << 30), st.integers(0, 1 << 20)), min_size=1, max_size=40))
def test_directory_of_any_entries(rows):
    entries = np.array(rows)
    entries[:, 0] = np.cumsum(entries[:, 0])
    assert codec.decode_directory(codec.encode_directory(entries)).tolist() == entries.tolist()


@pytest.mark.parametrize("bad", [b"", b"\x05\x01", codec.encode_varints(np.array([1, 1, 1, 1, 0])), codec.encode_varints(np.array([1, 1, 1, 1 << 40, 1])), codec.encode_varints(np.array([1, 1, 1, 1, 1, 7]))])
def test_malformed_directories(bad):
    with pytest.raises(codec.DirectoryError):
        codec.decode_directory(bad)


def test_empty_directory():
    with pytest.raises(codec.DirectoryError):
        codec.encode_directory(np.zeros((0, 4)))
    assert len(codec.decode_directory(codec.encode_directory(np.zeros((0, 4)), allow_empty=True))) == 0


def test_header():
    fields = {n: i + 1 for i, (n, _) in enumerate(HEADER_FIELDS)} | {"clustered": True, "min_lon_e7": -11000000, "center_lat_e7": 32000000}
    data = codec.encode_header(fields)
    assert len(data) == HEADER_BYTES
    assert codec.decode_header(data) == {"version": 3, **fields}
    with pytest.raises(codec.VersionError):
        codec.decode_header(MAGIC + b"\x04" + data[8:])
    with pytest.raises(codec.MagicError):
        codec.decode_header(b"PM\x00\x02")
    with pytest.raises(codec.ArchiveError):
        codec.decode_header(data[:100])


def test_compression():
    for code in (0, 1, 2, 4):
        assert codec.decompress(codec.compress(b"tile" * 9, code), code) == b"tile" * 9
    assert codec.compress(b"x", 2) == codec.compress(b"x", 2)
    with pytest.raises(codec.CompressionError):
        codec.decompress(b"", 3)


def test_packing():
    root, leaves = pack_directories(np.array([[0, 0, 1, 2]]))
    assert not leaves and codec.decode_directory(codec.decompress(root, 2)).tolist() == [[0, 0, 1, 2]]
    ids = np.arange(0, 100000, 2)
    entries = np.stack([ids, ids, np.ones_like(ids), np.full_like(ids, 2)], axis=1)
    root, leaves = pack_directories(entries, compression=1)
    assert len(root) <= MAX_ROOT_BYTES
    back = [codec.decode_directory(leaves[o : o + n]) for _, o, n, run in codec.decode_directory(root).tolist() if run == 0]
    assert np.concatenate(back).tolist() == entries.tolist()
