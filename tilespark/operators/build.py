"""What building an archive takes: shared contents, runs, counters, leaf packing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.functions.hilbert import zoom_of
from tilespark.operators.ordered import RANGE, into_ranges, previous, running_sum


def contents(tiles: DataFrame) -> DataFrame:
    """Distinct contents of (seq, tile_id, data): hash, first_seq, length, offset.

    A content lies where the contents that came before it end. Equal bytes are found by
    their SHA-256, summed before the shuffle, so a content that very many tiles share is
    no hot group.
    """
    data = F.col("data").cast("binary")
    found = tiles.groupBy(F.sha2(data, 256).alias("hash")).agg(F.min("seq").alias("first_seq"), F.max(F.octet_length(data)).cast("long").alias("length"))
    found = into_ranges(found, "first_seq")
    return running_sum(found, "length", "offset", "first_seq", ("hash",), inclusive=False).drop(RANGE)


def deduplicated(tiles: DataFrame) -> DataFrame:
    """seq, tile_id, hash, offset, length, first (whether it stored the content) of every tile."""
    placed = contents(tiles)
    rows = tiles.select("seq", "tile_id", F.sha2(F.col("data").cast("binary"), 256).alias("hash"))
    return rows.join(placed, "hash").select("seq", "tile_id", "hash", "offset", "length", (F.col("seq") == F.col("first_seq")).alias("first"))


def runs(tiles: DataFrame, key: str = "seq") -> DataFrame:
    """Entries (tile_id, offset, length, run_length) of deduplicated tiles, in order of ``key``.

    A tile begins a run unless it is the id after the tile before it with the same content.
    """
    ranged = previous(into_ranges(tiles, key), ["tile_id", "offset"], key)
    begins = ~F.coalesce((F.col("prev_tile_id") + 1 == F.col("tile_id")) & (F.col("prev_offset") == F.col("offset")), F.lit(False))
    numbered = running_sum(ranged.withColumn("begins", begins.cast("long")), "begins", "run", key)
    return numbered.groupBy("run").agg(F.min("tile_id").alias("tile_id"), F.min("offset").alias("offset"), F.min("length").alias("length"), F.count("*").alias("run_length")).drop("run")


def counters(entries: DataFrame) -> DataFrame:
    """One row: addressed, entries, contents, min_zoom and max_zoom of tile entries."""
    own = entries.where("run_length > 0")
    return own.agg(
        F.coalesce(F.sum("run_length"), F.lit(0)).cast("long").alias("addressed"), F.count("*").alias("entries"), F.countDistinct("offset", "length").alias("contents"),
        zoom_of(F.min("tile_id")).alias("min_zoom"), zoom_of(F.max(F.col("tile_id") + F.col("run_length") - 1)).alias("max_zoom"),
    )


def clustered(tiles: DataFrame, key: str = "seq") -> DataFrame:
    """One row: whether ids never fall in order of ``key``."""
    ranged = previous(into_ranges(tiles, key), ["tile_id"], key)
    return ranged.agg(F.coalesce(~F.bool_or(F.col("tile_id") < F.col("prev_tile_id")), F.lit(True)).alias("clustered"))


def deltas(entries: DataFrame) -> DataFrame:
    """Entries with what a directory stores: the id's difference, and the coded offset (0: follows on)."""
    ranged = previous(into_ranges(entries, "tile_id"), ["tile_id", "offset", "length"], "tile_id")
    follows = F.coalesce(F.col("offset") == F.col("prev_offset") + F.col("prev_length"), F.lit(False))
    return ranged.select("tile_id", (F.col("tile_id") - F.coalesce("prev_tile_id", F.lit(0))).alias("id_delta"), "run_length", "length", F.when(follows, F.lit(0)).otherwise(F.col("offset") + 1).alias("coded_offset"))


def leaves(entries: DataFrame, leaf_entries: int = 4096) -> DataFrame:
    """Slices of ``leaf_entries`` entries: leaf, first_id, entries, addressed."""
    numbered = running_sum(into_ranges(entries.withColumn("_one", F.lit(1).cast("long")), "tile_id"), "_one", "n", "tile_id")
    leaf = F.floor((F.col("n") - 1) / leaf_entries).cast("long").alias("leaf")
    return numbered.groupBy(leaf).agg(F.min("tile_id").alias("first_id"), F.count("*").alias("entries"), F.sum("run_length").cast("long").alias("addressed"))


def expanded(entries: DataFrame, most: int = 1 << 16) -> DataFrame:
    """One row a tile. Long runs are first cut into stretches of ``most`` ids that are dealt out, so that none swells a task."""
    from_to = F.sequence(F.lit(0).cast("long"), F.col("run_length") - 1, F.lit(most).cast("long"))
    cut = entries.where("run_length > 0").withColumn("_from", F.explode(from_to))
    last = F.least(F.col("_from") + most, F.col("run_length")) - 1
    rows = cut.repartition("tile_id", "_from").withColumn("_at", F.explode(F.sequence("_from", last)))
    return rows.select((F.col("tile_id") + F.col("_at")).alias("tile_id"), *[c for c in entries.columns if c not in ("tile_id", "run_length")])
