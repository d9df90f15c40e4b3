"""The response cache of an edge server, as keyed state over a stream of requests.

What an address was answered is state: the first request fetches the tile, later ones get the same
answer until it expires, whatever has become of the archive. Requests are dealt to ``places`` by a hash, as edge
servers each have a cache of their own; so an address that everybody asks for is many groups, and a
tile is fetched at most once a place and lifetime. State goes when the watermark passes its end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilespark.sources.archive import ArchiveReader

#: Seconds that an answer lives, as its Cache-Control says.
MAX_AGE = 86400
_ANSWER = ("status", "message", "content_type", "data", "etag")
_STATE = "begun long, status int, message string, content_type string, data binary, etag string"


def fetch_tile(archive: str, tile_id: int) -> bytes | None:
    """A tile's bytes, decompressed; None if there is none. Root directories stay with the process that asks."""
    reader = ArchiveReader({"path": json.dumps([archive]), "only": json.dumps({"tile_id": [tile_id]}), "decompress": "true", "on_change": "replan"}, "tiles")
    for part in reader.partitions():
        for batch in reader.read(part):
            for data in batch.column("data"):
                return data.as_py()
    return None


def cached_answers(answers: DataFrame, time: str, fetch: Callable[[str, int], bytes | None] = fetch_tile, max_age: int = MAX_AGE, places: int = 1) -> DataFrame:
    """``answers`` (of ``serve``, with a column ``time``) with data, etag, ``cached`` (whether state answered) and ``age`` in seconds.

    Status, message and content_type are those of the request that was answered first. Answers without
    cache_control are never kept. A stream needs a watermark on ``time``; in a table requests are taken in order of time.
    Requests of one address and place in one micro-batch are held together, without bytes of tiles but their one answer; those of
    a table are sorted by Spark and pass batch by batch, with what is kept for the address.
    """
    columns = [c for c in answers.columns if c not in ("status", "message", "content_type")]
    fields = {f.name: f.dataType.simpleString() for f in answers.schema.fields}
    out = ", ".join([*(f"`{c}` {fields[c]}" for c in columns), "status int, message string, content_type string, data binary, etag string, cached boolean, age long"])
    life = max_age * 1000

    def fresh(row) -> tuple:
        """The answer to a request that no state answers."""
        status, data = int(row.status), None
        if row.archive is not None and row.tile_id is not None and not pd.isna(row.tile_id):
            data = fetch(row.archive, int(row.tile_id))
            status = 204 if data is None else status
        tag = None if data is None else f'"{hashlib.sha256(data).hexdigest()}"'
        return status, row.message, row.content_type, data, tag

    def answered(rows: pd.DataFrame, begun: int | None, held: tuple | None) -> tuple[pd.DataFrame, int | None, tuple | None]:
        at = rows[time].astype("datetime64[ns]").astype("int64") // 1_000_000  # milliseconds
        rows = rows.assign(_at=at).sort_values("_at", kind="stable", ignore_index=True)
        found, ages, cached = [], [], []
        for row in rows.itertuples(index=False):
            now = row[-1]
            known = begun is not None and now < begun + life and row.cache_control is not None
            one = held if known else fresh(row)
            if not known and row.cache_control is not None:
                begun, held = now, one
            found.append(one)
            cached.append(known)
            ages.append(max(0, now - begun) // 1000 if known else 0)
        own = {n: pd.Series(values, dtype=object) for n, values in zip(_ANSWER, zip(*found))}
        return rows[columns].assign(**own, cached=cached, age=ages), begun, held

    def streamed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        out, begun, held = answered(pd.concat(list(batches), ignore_index=True), *((state.get[0], tuple(state.get[1:])) if state.exists else (None, None)))
        if held is not None:
            state.update((begun, *held))
            state.setTimeoutTimestamp(max(begun + life, state.getCurrentWatermarkMs() + 1))
        yield out

    place = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns if not fields[c].startswith(("map", "binary"))]), F.lit(places))
    keyed = answers.withColumn("_address", F.coalesce("path", F.lit(""))).withColumn("_place", place)
    if answers.isStreaming:
        return keyed.groupBy("_address", "_place").applyInPandasWithState(streamed, out, _STATE, "append", GroupStateTimeout.EventTimeTimeout)

    def swept(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, begun, held = None, None, None
        for batch in batches:
            for own, rows in batch.groupby(["_address", "_place"], sort=False):
                if own != key:
                    key, begun, held = own, None, None
                found, begun, held = answered(rows, begun, held)
                yield found

    return keyed.repartition("_address", "_place").sortWithinPartitions("_address", "_place", time).mapInPandas(swept, out)
