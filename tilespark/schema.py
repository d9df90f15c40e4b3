"""Schemas of archives, and the values that the archive format fixes."""

from __future__ import annotations

# Fixed values of the archive format.
MAGIC = b"PMTiles"
VERSION = 3
HEADER_BYTES = 127
FIRST_READ_BYTES = 16384
MAX_ROOT_BYTES = 16257
MAX_DEPTH = 4
LEAF_ENTRIES = 4096
COMPRESSIONS = {0: "unknown", 1: "none", 2: "gzip", 3: "brotli", 4: "zstd"}
TILE_TYPES = {0: "unknown", 1: "mvt", 2: "png", 3: "jpeg", 4: "webp", 5: "avif", 6: "mlt"}
EXTENSIONS = {0: "", 1: ".mvt", 2: ".png", 3: ".jpg", 4: ".webp", 5: ".avif", 6: ".mlt"}
HEADER_FIELDS = (
    ("root_offset", "Q"), ("root_length", "Q"), ("metadata_offset", "Q"), ("metadata_length", "Q"),
    ("leaf_directory_offset", "Q"), ("leaf_directory_length", "Q"), ("tile_data_offset", "Q"), ("tile_data_length", "Q"),
    ("addressed_tiles_count", "Q"), ("tile_entries_count", "Q"), ("tile_contents_count", "Q"),
    ("clustered", "B"), ("internal_compression", "B"), ("tile_compression", "B"), ("tile_type", "B"),
    ("min_zoom", "B"), ("max_zoom", "B"), ("min_lon_e7", "i"), ("min_lat_e7", "i"), ("max_lon_e7", "i"), ("max_lat_e7", "i"),
    ("center_zoom", "B"), ("center_lon_e7", "i"), ("center_lat_e7", "i"),
)

_KINDS = {"Q": "bigint", "B": "smallint", "i": "int"}
HEADER = "archive string, version int, " + ", ".join(f"{n} {'boolean' if n == 'clustered' else _KINDS[k]}" for n, k in HEADER_FIELDS)
ENTRY = "tile_id bigint, offset bigint, length bigint, run_length bigint"
ENTRIES = f"archive string, {ENTRY}, abs_offset bigint, depth int"
METADATA = "archive string, json string"
TILES = "archive string, tile_id bigint, z int, x bigint, y bigint, offset bigint, abs_offset bigint, length bigint, data binary"
VECTOR_LAYERS = "array<struct<id: string, description: string, minzoom: int, maxzoom: int, fields: map<string,string>>>"
