"""Manifests: tables of archives, by which writes appear whole and scans leave archives out.

A folder that the sink writes has numbered manifests, ``_archives-00000001.parquet`` and on;
the last one is the folder's content. A row is an archive: its file, version, first and last id, zooms,
counts and bytes, and ids that cut its tiles into shares of about one partition. A commit writes the next
manifest under a hidden name and links it to its number, which fails if another commit had that
number first; then it reads again and tries the next. So readers see all of a write or nothing of it,
whenever it stops, and two writers lose nothing of each other. Files that no manifest
names are no part of the folder; files of other origin beside them are.

``write_manifest`` makes such a table for archives anywhere: tasks read their headers and root directories.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from tilespark.sources.stores import LocalFolder, StoreFolder, folder_of

#: What the sink calls its files, before the suffix that a user may ask for, and its manifests.
OWN_FILE = re.compile(r"part-\d{5}-[0-9a-f]{8}(\.\w+)?")
OWN_MANIFEST = re.compile(r"_archives-(\d{8})\.parquet")
FACTS = {"archive": pa.string(), "version": pa.string(), "first_id": pa.int64(), "end_id": pa.int64(), "min_zoom": pa.int32(), "max_zoom": pa.int32(), "tiles": pa.int64(), "entries": pa.int64(), "leaves": pa.int64(), "bytes": pa.int64(), "cuts": pa.list_(pa.int64())}
MANIFEST = "archive string, version string, first_id long, end_id long, min_zoom int, max_zoom int, tiles long, entries long, leaves long, bytes long, cuts array<long>"


def _last(folder: LocalFolder | StoreFolder) -> tuple[int, str | None]:
    return max(((int(m[1]), f) for f in folder.names() if (m := OWN_MANIFEST.fullmatch(f))), default=(0, None))


def _may_hold(low: int | None, high: int | None) -> ds.Expression | None:
    if low is None:
        return None
    first, end = ds.field("first_id"), ds.field("end_id")
    return (first.is_null() | (first < high)) & (end.is_null() | (end > low))


def rows_of(path: str, low: int | None = None, high: int | None = None) -> list[dict]:
    """Rows of a manifest (a file or folder of Parquet), of archives that can hold ids from low to high (exclusive)."""
    return ds.dataset(path, format="parquet").to_table(filter=_may_hold(low, high)).to_pylist()


def current(path: str, low: int | None = None, high: int | None = None) -> list[dict] | None:
    """Rows of a folder's last manifest; None where there is none. Files stand under their names."""
    folder = folder_of(path)
    while True:
        _, name = _last(folder)
        try:
            return None if name is None else folder.rows(name, _may_hold(low, high))
        except FileNotFoundError:  # a commit has put another in its place
            continue


def publish(path: str, change: Callable[[list[dict]], list[dict]]) -> list[dict]:
    """Put ``change`` of the folder's rows in their place at once; returns the rows that it was given."""
    folder = folder_of(path)
    while True:
        number, name = _last(folder)
        old = [{"archive": f} for f in sorted(folder.names()) if OWN_FILE.fullmatch(f)] if name is None else current(path) or []
        rows = sorted(change(old), key=lambda r: (r.get("first_id") or 0, r["archive"]))
        table = pa.table([pa.array([r.get(c) for r in rows], t) for c, t in FACTS.items()], names=list(FACTS))
        try:
            folder.create(f"_archives-{number + 1:08d}.parquet", lambda out, table=table: pq.write_table(table, out, row_group_size=1 << 14))
        except FileExistsError:
            continue
        for f in folder.names():  # the one before stays for readers that have just found it
            if (m := OWN_MANIFEST.fullmatch(f)) and int(m[1]) < number:
                folder.remove(f)
        return old


def vacuum(path: str) -> list[str]:
    """Remove archives and staged files that no commit came to name; not while a write is under way."""
    folder, rows = folder_of(path), current(path)
    if rows is None:
        return []
    named = {r["archive"] for r in rows}
    gone = [f for f in folder.names() if (OWN_FILE.fullmatch(f) and f not in named) or re.match(r"\.(manifest-)?[0-9a-f]{32}", f)]
    for f in gone:
        folder.remove(f)
    return gone


def cuts_of(ids: np.ndarray, sizes: np.ndarray, share: int) -> list[int]:
    """Of entries in order of ids, those ids where another ``share`` bytes begin."""
    part = np.cumsum(sizes) // share
    return ids[1:][part[1:] != part[:-1]].tolist()


def write_manifest(spark: SparkSession, paths: list[str] | DataFrame, out: str, mode: str = "errorifexists") -> None:
    """Write the manifest of archives, named by a list or by a table's column archive, as a Parquet folder in order of ids.

    Scans take it by the option ``manifest`` in place of a path. Archives that cannot be read are an error.
    """
    names = paths.select("archive") if isinstance(paths, DataFrame) else spark.createDataFrame([(p,) for p in paths], "archive string")

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from tilespark.sources.archive import ArchiveReader

        for batch in batches:
            found = [ArchiveReader({"path": p}, "tiles").facts(p) for p in batch.column("archive").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in FACTS.items()], list(FACTS))

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = names.distinct().repartition(ranges).mapInArrow(facts, MANIFEST)
    rows.repartitionByRange(ranges, "first_id").sortWithinPartitions("first_id").write.mode(mode).parquet(out)
