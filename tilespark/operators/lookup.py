"""Batch lookup: which entry holds each requested tile.

The greatest entry at or below an id holds it if the id is inside the entry's run.
``lookup`` merges sorted ids and entries (any size), ``lookup_archives`` those of many
archives at once; ``lookup_small`` sends the entries
to all tasks after counting them, and else does the same merge.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.operators.ordered import RANGE, into_ranges, last_known
from tilespark.shared import received, send, settle

#: Entries that may be sent to all tasks: 32 bytes each.
BROADCAST_ENTRIES = 1 << 20
_HIT = "struct<tile_id:bigint,offset:bigint,length:bigint,run_length:bigint>"


def _answer(joined: DataFrame, requests: DataFrame) -> DataFrame:
    inside = (F.col("run_length") == 0) | (requests["tile_id"] < F.col("entry_id") + F.col("run_length"))
    hit = F.coalesce(inside, F.lit(False))
    return joined.select(*[requests[c] for c in requests.columns], F.when(hit, F.col("entry_id")).alias("entry_id"), F.when(hit, F.col("offset")).alias("offset"), F.when(hit, F.col("length")).alias("length"))


def lookup(requests: DataFrame, entries: DataFrame, pointers: bool = False) -> DataFrame:
    """``requests`` (with tile_id) and entry_id, offset, length of the tile; null where there is none.

    Pointers to leaf directories (run 0) are left out, for entries of all directories
    together. With ``pointers``, for the entries of one directory, a pointer answers for
    all ids up to the next entry.
    Ids are made distinct before the merge, so an id that a third of all requests ask
    for is one row there; the join back is one that Spark can split.
    """
    ids = requests.select("tile_id").distinct().select("tile_id", F.lit(1).alias("kind"), F.lit(None).cast(_HIT).alias("entry"))
    known = (entries if pointers else entries.where("run_length > 0")).select("tile_id", F.lit(0).alias("kind"), F.struct("tile_id", "offset", "length", "run_length").alias("entry"))
    merged = into_ranges(known.unionByName(ids), "tile_id")
    found = last_known(merged, "entry", "found", "tile_id", ("kind",)).where("kind = 1").drop(RANGE)
    found = found.select(F.col("tile_id").alias("asked"), F.col("found.tile_id").alias("entry_id"), "found.offset", "found.length", "found.run_length")
    return _answer(requests.join(found, requests["tile_id"] == found["asked"], "left"), requests)


def lookup_archives(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """``lookup`` over many archives: both tables have archive and tile_id.

    Archives are numbered, one row each, and number and id make one wide key that keeps
    an archive's ids together, so all archives are merged at once.
    """
    names = entries.select("archive").distinct().select("archive", F.row_number().over(Window.orderBy("archive")).alias("number"))
    key = (F.col("number").cast("decimal(38,0)") * F.lit(str(1 << 63)).cast("decimal(20,0)") + F.col("tile_id")).cast("decimal(38,0)").alias("key")
    numbered = settle(names)
    ids = requests.select("archive", "tile_id").distinct().join(numbered, "archive").select("archive", "tile_id", key, F.lit(1).alias("kind"), F.lit(None).cast(_HIT).alias("entry"))
    known = entries.where("run_length > 0").join(numbered, "archive")
    known = known.select("archive", "tile_id", key, F.lit(0).alias("kind"), F.struct("tile_id", "offset", "length", "run_length").alias("entry"))
    merged = into_ranges(known.unionByName(ids), "key").withColumn("entry", F.when(F.col("entry").isNotNull(), F.struct("archive", "entry")))
    found = last_known(merged, "entry", "found", "key", ("kind",)).where("kind = 1 AND found.archive = archive")
    found = found.select(F.col("archive").alias("of"), F.col("tile_id").alias("asked"), F.col("found.entry.tile_id").alias("entry_id"), "found.entry.offset", "found.entry.length", "found.entry.run_length")
    return _answer(requests.join(found, (requests["archive"] == found["of"]) & (requests["tile_id"] == found["asked"]), "left"), requests)


def lookup_small(requests: DataFrame, entries: DataFrame, most: int = BROADCAST_ENTRIES) -> DataFrame:
    """The same answers, by binary search in broadcast entries if there are at most ``most`` of them."""
    # settled, as it is counted and then read again
    own = settle(entries.where("run_length > 0").select("tile_id", "offset", "length", "run_length"))
    if own.count() > most:
        return lookup(requests, own)
    table = own.orderBy("tile_id").toPandas().to_numpy(np.int64)
    sent = send(requests.sparkSession, table)

    @F.pandas_udf("entry_id long, offset long, length long")
    def search(ids: pd.Series) -> pd.DataFrame:
        rows = received(sent)
        asked = ids.fillna(-1).to_numpy(np.int64)
        at = np.searchsorted(rows[:, 0], asked, "right") - 1
        own = rows[np.maximum(at, 0)] if len(rows) else np.zeros((len(asked), 4), np.int64)
        hit = (at >= 0) & (asked < own[:, 0] + own[:, 3])
        return pd.DataFrame({n: pd.Series(own[:, i], dtype="Int64").where(hit) for i, n in enumerate(("entry_id", "offset", "length"))})

    return requests.withColumn("_hit", search("tile_id")).select(*requests.columns, "_hit.entry_id", "_hit.offset", "_hit.length")


def missing(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """The distinct requested ids that no entry holds."""
    return lookup(requests.select("tile_id").distinct(), entries).where("entry_id IS NULL").select("tile_id")


def zoom_filtered(requests: DataFrame, header: DataFrame) -> DataFrame:
    """Requests (archive, z, ...) within their archive's zooms."""
    zooms = header.select("archive", "min_zoom", "max_zoom")
    return requests.join(zooms, "archive").where(F.col("z").between(F.col("min_zoom"), F.col("max_zoom"))).select(*requests.columns)
