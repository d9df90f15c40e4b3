"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan
distance of two such vectors is at most the Hamming distance of the fingerprints, so
links of ``DISTANCE`` bits are found by a range join in the embedding. The grid of
that join: the segments form ``DISTANCE + k`` groups, and as two linked vectors differ
in at most ``DISTANCE`` of them, they agree wholly in k groups at least. Each choice
of k groups is a grid whose cells are the vectors over those groups. Within a cell
only vectors within the Manhattan distance are compared bit by bit. The k grows with
the number of distinct fingerprints, so that cells of unlike texts stay small; the links
found are the same whatever k is.

Texts with equal fingerprints are one node. What leaves a cell is a spanning forest of
its links, not all of them, so a cell of near copies yields fewer links than nodes. A
cell of more than ``CELL`` nodes is split into chunks by a hash of the node, and each
pair of chunks is a task's work of its own: nothing is dropped at any size.

Defined cases: a null or blank text has fingerprint zero and is linked like any other;
rows with equal ids are rows of their own; a null id never names a component, and a
component of nothing but null ids has none; very long texts are read whole; no rows give
no rows; columns other than doc_id and text, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import discard, partitions, settle
from tilespark.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 3
SEGMENTS = 32
CELL = 2048
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def simhash(text: str | None) -> int:
    """The fingerprint of a text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - SHINGLE + 1)
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for first in range(0, n, 1 << 16):
        last = min(n, first + (1 << 16))
        stops = ends[np.minimum(np.arange(first, last) + SHINGLE - 1, len(words) - 1)]
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[first:last].tolist(), stops.tolist())), np.uint64, last - first)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def _simhashes(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        prints = [simhash(t) for t in batch.column("text").to_pylist()]
        rest = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(prints, pa.int64())], [*rest, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (tells rows with equal ids apart) and fp of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(_simhashes, "doc_id long, text_hash long, fp long")


def popcounts(fp: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments, two bits each, side by side in 64 bits."""
    fp = fp.astype(np.uint64)
    odd = np.uint64(0x5555555555555555)
    return (fp & odd) + ((fp >> np.uint64(1)) & odd)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of packed bit counts: fields differ by 0, 1 or 2."""
    odd = np.uint64(0x5555555555555555)
    low, high = (a ^ b) & odd, ((a ^ b) >> np.uint64(1)) & odd
    # 0 against 1 and 1 against 2 differ in the low bit; 0 against 2 in the high bit alone
    return np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low)


def groups_that_agree(nodes: int) -> int:
    """How many groups a grid takes: two up to four million fingerprints, one more for each 32 times as many."""
    return min(12, 2 + max(0, ((max(nodes, 1) - 1).bit_length() - 22 + 4) // 5))


def grids(agree: int) -> list[int]:
    """The bits of each grid: of ``DISTANCE + agree`` groups of segments (two bits each) every choice of ``agree``."""
    cuts = [round(SEGMENTS * i / (DISTANCE + agree)) for i in range(DISTANCE + agree + 1)]
    return [sum(3 << (2 * s) for g in chosen for s in range(cuts[g], cuts[g + 1])) for chosen in combinations(range(DISTANCE + agree), agree)]


def _cells(batches: Iterator[pa.RecordBatch], agree: int) -> Iterable[pa.RecordBatch]:
    """Each distinct fingerprint once for every grid, with its cell there."""
    masks = [(np.uint64(bits), np.uint64(i * 0xC2B2AE3D27D4EB4F % (1 << 64))) for i, bits in enumerate(grids(agree))]
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        counts = popcounts(fp.view(np.uint64) if fp.dtype == np.int64 else fp)
        cells = []
        for bits, grid in masks:
            h = (counts & bits) * np.uint64(0x9E3779B97F4A7C15) + grid
            h ^= h >> np.uint64(29)
            cells.append((h * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cells)), pa.array(np.tile(fp, len(masks)))], ["cell", "fp"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the links a-b do."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def near_links(key: np.ndarray, fp: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between rows of one key; with sides, between two sides only."""
    links, kept = [], 0
    counts, bits = popcounts(fp.view(np.uint64)), fp.view(np.uint64)
    ends = np.searchsorted(key, key, "right") if len(key) else key
    live = np.flatnonzero(ends - np.arange(len(key)) > 1)
    step = 1
    while len(live):
        other = live + step
        close = manhattan(counts[live], counts[other]) <= DISTANCE
        if side is not None:
            close &= (side[live] < 0) | (side[live] != side[other])
        x, y = live[close], other[close]
        exact = np.bitwise_count(bits[x] ^ bits[y]) <= DISTANCE
        if exact.any():
            links.append((fp[x[exact]], fp[y[exact]]))
            kept += int(exact.sum())
            if kept > 1 << 20:
                links, kept = [forest(*map(np.concatenate, zip(*links)))], 0
        step += 1
        live = live[ends[live] - live > step]
    return forest(*map(np.concatenate, zip(*links))) if links else (fp[:0], fp[:0])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Links within runs of equal (cell, pair); rows arrive in that order.

    A run is bounded: a cell has at most ``CELL`` rows or was split into chunk pairs.
    """

    def found(rows: np.ndarray) -> pa.RecordBatch:
        run = np.cumsum(np.concatenate([[0], (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)])) if rows.shape[1] else rows[0]
        a, b = near_links(run, np.ascontiguousarray(rows[2]), rows[3])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held = np.zeros((4, 0), np.int64)
    for batch in batches:
        held = np.concatenate([held, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cell", "pair", "fp", "side")])], axis=1)
        if held.shape[1] > 4 * CELL:
            whole = np.flatnonzero((held[0] != held[0, -1]) | (held[1] != held[1, -1]))
            cut = int(whole[-1]) + 1 if len(whole) else 0
            if cut:
                yield found(held[:, :cut])
                held = held[:, cut:]
    yield found(held)


def near_components(prints: DataFrame, agree: int | None = None) -> DataFrame:
    """(fp, root) for every distinct fingerprint that has a link; ``prints`` has distinct fp."""
    spark = prints.sparkSession
    agree = agree or groups_that_agree(prints.count())
    cells = settle(prints.select("fp").mapInArrow(partial(_cells, agree=agree), "cell long, fp long"))
    hot = cells.groupBy("cell").count().where(F.col("count") > CELL).select("cell", F.ceil(2 * F.col("count") / CELL).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1)).cast("long")).cast("int")
    others = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    lower, upper = F.least("mine", "their"), F.greatest("mine", "their")
    dealt = (
        cells.join(hot, "cell", "left")
        .withColumn("mine", mine)
        .withColumn("their", F.explode(others))
        .select("cell", (lower * F.lit(1 << 24) + upper).cast("long").alias("pair"), "fp", F.when(lower == upper, F.lit(-1)).otherwise(F.col("mine")).cast("long").alias("side"))
    )
    links = dealt.repartition(partitions(spark), "cell", "pair").sortWithinPartitions("cell", "pair").mapInArrow(_links, "a long, b long")
    found = components(links)
    discard(cells)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root (the same for a whole component) and component_id (the smallest doc_id reachable) of every document."""
    rows = settle(fingerprints(docs))
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = near_components(classes)
    rooted = settle(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = settle(rooted.join(least, "root").select("fp", "root", "component_id"))
    discard(classes, roots, rooted)
    return rows.join(known, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """The documents without near copies: of each component the row with its smallest id stays, nulls last.

    ``rows`` has doc_id, text_hash and root as ``near_duplicates`` gives them, which finds
    them if none are given. Of rows that share that id the one with the smallest text
    hash stays, and of wholly equal ones any.
    """
    rows = near_duplicates(docs) if rows is None else rows
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = rows.groupBy("root").agg(F.min(first).alias("first"), F.count("*").alias("rows"))
    kept = settle(kept.select(F.col("first.doc_id").alias("kept doc_id"), F.col("first.text_hash").alias("kept text_hash"), "rows"))
    keep = docs["doc_id"].cast("long").eqNullSafe(kept["kept doc_id"]) & (F.xxhash64(docs["text"]) == kept["kept text_hash"])
    found = docs.join(kept, keep, "left_semi")
    if kept.where("rows > 1").isEmpty():
        return found
    return found.dropDuplicates(["doc_id", "text"])
