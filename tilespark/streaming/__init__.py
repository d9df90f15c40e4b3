"""Streams of tile requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.plans.serve import serve, with_tiles


def serve_stream(requests: DataFrame, archives: DataFrame, tiles: DataFrame | None = None, **options: str) -> DataFrame:
    """Answers to a stream of requests: joins of the stream with tables, which Spark plans by micro-batch."""
    answers = serve(requests, archives, **options)
    return with_tiles(answers, tiles) if tiles is not None else answers


def status_counts(answers: DataFrame, time: str, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Answers by window and status; a window is final once ``late`` has passed."""
    return answers.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), "status").agg(F.count("*").alias("answers"))
