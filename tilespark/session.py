"""A session with this package's formats and functions."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known. Safe to call again."""
    from tilespark.sources.archive import TileArchive
    from tilespark.sources.archive_v2 import TileArchiveV2
    from tilespark.sources.database import TileDatabase

    for source in (TileArchive, TileArchiveV2, TileDatabase):
        spark.dataSource.register(source)
    return spark
