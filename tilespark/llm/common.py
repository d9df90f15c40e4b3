"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilespark.shared import discard, received, send, settle, shared_dir  # noqa: F401

#: Java regex of a word in the contracts that split on ASCII white space only.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_pieces(batches: Iterable[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows: what Python makes of a batch of long texts is many times its size, and a worker keeps what it once took."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def partitions(spark: SparkSession) -> int:
    """Partitions of an explicit shuffle: what the session sets for all shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))
