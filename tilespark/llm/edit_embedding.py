"""Document fingerprints by a randomised edit embedding.

A random walk reads a text character by character. At every step a shared random
function of the step number and the character decides whether the walk moves on to
the next character or repeats this one, so two texts that differ by an insertion
fall back into step soon after it: edit distance becomes Hamming distance between
the two outputs. A character holds the walk until its function next says "move", so
a table of those waiting times gives each character's arrival step by one look-up.

A fingerprint has ``SLOTS`` hexadecimal digits. Digit ``s`` is a 4-bit hash of what
the walk put out at one step, a few characters from where it stood. The steps are
sampled consistently: slot ``s`` looks at the last record of its own random sequence
of record times before the walk's end, which is uniform over the whole walk, and the
same step in two walks of lengths ``a < b`` with probability ``a / b``. Likeness is
the share of equal digits, less what chance gives.

Sampled digits of all fingerprints are banded into keys, and what shares a key is verified
by likeness: ``linked_texts`` gives every document the smallest id that links lead to, without ever making all
pairs of a key, and ``near_texts`` its class and the number of its links. Of texts of 2,000 characters that differ by at most 12 edits, which
come to a likeness of 0.65 or more, a test finds more than nine pairs in ten that way.

Defined cases: null text is empty; the empty text has a fingerprint of its own, and
two equal texts, empty ones included, have likeness 1; rows with equal or null ids
are rows of their own, nulls first, ties by text; a single row is its own successor; very
long texts are walked whole; no documents give no rows; columns other than doc_id and
text, whatever their names, are never read.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterable, Iterator
from functools import partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import discard, partitions, settle
from tilespark.llm.components import components

SLOTS = 128
#: Classes of a band key that meet in one run of a task.
CELL = 2048
GRAM = 4
PERIOD = 4096
CLASSES = 64
SEED = 20
_MASK = (1 << 64) - 1


def waiting_times(seed: int = SEED) -> list[list[int]]:
    """By step (modulo the period) and character class: steps until the walk moves on."""
    moves = np.random.default_rng(seed).integers(0, 2, (PERIOD, CLASSES), dtype=np.uint8)
    moves[-1] = 1
    wait = np.ones((2 * PERIOD + 1, CLASSES), np.int64)
    for step in range(2 * PERIOD - 1, -1, -1):
        wait[step] = np.where(moves[step % PERIOD], 1, wait[step + 1] + 1)
    return wait[:PERIOD].tolist()


def record_steps(seed: int = SEED, longest: int = 1 << 40) -> list[list[int]]:
    """Of each slot, the steps at which its random sequence has a new record."""
    rng, out = np.random.default_rng(seed + 1), []
    for _ in range(SLOTS):
        steps = [0]
        while steps[-1] < longest:
            steps.append(int((steps[-1] + 1) / max(rng.random(), 1e-9)) if steps[-1] else 1 + int(1 / max(rng.random(), 1e-9)) - 1)
            if steps[-1] <= steps[-2]:
                steps[-1] = steps[-2] + 1
        out.append(steps)
    return out


class Walker:
    """Walks and fingerprints texts given as arrays of code points."""

    def __init__(self, seed: int = SEED) -> None:
        self.wait, self.records = waiting_times(seed), record_steps(seed)
        self.salt = np.random.default_rng(seed + 2).integers(1, 1 << 63, SLOTS, dtype=np.uint64)

    @staticmethod
    def points(text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)

    def walk(self, points: np.ndarray, arrived: list[int] | None = None) -> list[int]:
        """Arrival step of each character, and the step after the last; continues ``arrived``."""
        arrived, wait, last = arrived or [0], self.wait, PERIOD - 1
        step, append = arrived[-1], arrived.append
        classes = ((points * np.uint32(2654435761)) >> np.uint32(26)).astype(np.uint8)
        for c in classes[len(arrived) - 1 :].tobytes():
            step += wait[step & last][c]
            append(step)
        return arrived

    def fingerprint(self, points: np.ndarray, arrived: list[int]) -> str:
        if not len(points):
            return "0" * SLOTS
        end = arrived[-1]
        steps = np.array([r[bisect.bisect_left(r, end) - 1] for r in self.records], np.int64)
        at = np.searchsorted(np.asarray(arrived), steps, "right") - 1
        grams = np.concatenate([points, np.zeros(GRAM, np.uint32)]).astype(np.uint64)
        h = self.salt ^ (steps.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for k in range(GRAM):
            h = (h ^ grams[at + k]) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(32)
        return "".join(map("0123456789abcdef".__getitem__, (h >> np.uint64(60)).tolist()))


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, about 0 for those of unrelated texts."""
    same = sum(map(str.__eq__, a, b)) / SLOTS
    return max(0.0, (same - 1 / 16) * 16 / 15)


def _bands(bands: int = 16, digits: int = 6, seed: int = SEED) -> list[list[int]]:
    """Sampled slots of each band."""
    rng = np.random.default_rng(seed + 3)
    return [sorted(rng.choice(SLOTS, digits, replace=False).tolist()) for _ in range(bands)]


_PICKS = [itemgetter(*band) for band in _bands()]


def share_band(a: str, b: str) -> bool:
    """Whether two fingerprints agree in all sampled digits of a band, and so are candidates."""
    return any(pick(a) == pick(b) for pick in _PICKS)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Fingerprints of rows in order of (part, doc_id); a part ends with its successor's copy."""
    walker, out = Walker(), []
    before = None

    def finish(row: tuple, after: tuple) -> None:
        part, doc_id, points, arrived, print_, _ = row
        n, half = len(points), len(points) // 2
        edited = np.concatenate([points[: n - half], after[2][:half]])
        other = walker.fingerprint(edited, walker.walk(edited, arrived[: n - half + 1])) if half else print_
        text = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
        out.append((doc_id, n, hashlib.sha256(text).hexdigest(), print_, other, likeness(print_, other), likeness(print_, after[4]), share_band(print_, other), share_band(print_, after[4])))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 9
        out.clear()
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_candidate", "next_candidate"])

    for batch in batches:
        for part, doc_id, trailer, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if before is not None and before[5] and before[0] == part:
                continue  # ties of a part's trailer: the first stands for the successor
            points = walker.points(text)
            arrived = walker.walk(points)
            row = (part, doc_id, points, arrived, walker.fingerprint(points, arrived), trailer)
            if before is not None and not before[5]:
                finish(before, row)
            before = row
        yield flush()


def _part_of(doc_id: Column, starts: list[int]) -> Column:
    """The number of ``starts`` at or below ``doc_id``, by halving; 0 for null."""
    if not starts:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(starts).bit_length()))])
    bounds = F.array(*[F.lit(x).cast("long") for x in starts])
    find = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= len(starts)) & (F.get(bounds, at + step - 1) <= doc_id), at + step).otherwise(at))
    return F.coalesce(F.when(doc_id.isNull(), F.lit(0)).otherwise(find), F.lit(0))


def edit_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and likeness to the next document.

    ``edited_candidate`` and ``next_candidate`` say whether the two fingerprints share a
    band of sampled digits; the likeness is what verifies a candidate.

    The rows are dealt into consecutive ranges of ``doc_id``. The row that begins a
    range is also sent, as a trailer, to the range before it (the first row of all to
    the last range), so the texts are shuffled once and each task has every successor
    that it needs. The range starts come from a pass over the ids alone.
    """
    spark = docs.sparkSession
    count = partitions(spark)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    # more ranges than tasks, so that tasks that get one more of them do little more
    seams = ids.repartitionByRange(4 * count, "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("start"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).collect()
    nulls = sum(r["nulls"] for r in seams)
    firsts = sorted({r["start"] for r in seams if r["start"] is not None})
    starts = firsts if nulls else firsts[1:]
    first = F.col("doc_id").isNull() if nulls else F.coalesce(F.col("doc_id") == F.lit(firsts[0] if firsts else None), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("part", _part_of(F.col("doc_id"), starts).cast("int"))
    begins = F.col("doc_id").isin(starts) if starts else F.lit(False)
    copies = F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("trailer")), F.when(begins, F.struct((F.col("part") - 1).alias("part"), F.lit(True).alias("trailer"))), F.when(first, F.struct(F.lit(len(starts)).alias("part"), F.lit(True).alias("trailer")))))
    dealt = rows.select("doc_id", "text", F.explode(copies).alias("c")).select("c.part", "doc_id", "c.trailer", "text")
    return (
        dealt.repartition(count, "part")
        .sortWithinPartitions("part", "trailer", "doc_id", "text")
        .mapInArrow(_edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edited_candidate boolean, next_candidate boolean")
    )


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Each class once for every band, with its key there."""
    for batch in batches:
        prints, ids = batch.column("fingerprint").to_pylist(), batch.column("class_id")
        keys = [xxhash.xxh64_intdigest(f"{b}:{''.join(pick(p))}", SEED) - (1 << 63) for b, pick in enumerate(_PICKS) for p in prints]
        bands = np.repeat(np.arange(len(_PICKS), dtype=np.int32), len(prints))
        tiled = pa.concat_arrays([ids] * len(_PICKS)), pa.array(prints * len(_PICKS), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bands), *tiled], ["cell", "band", "class_id", "fingerprint"])


def degrees(prints: list[str], band: int, side: np.ndarray, at_least: float) -> np.ndarray:
    """How many of the others each fingerprint of a band key is like, without pairs that share an earlier band too; with sides, of the other side only."""
    digits = np.frombuffer("".join(prints).encode(), np.uint8).reshape(len(prints), SLOTS)
    out, bands = np.zeros(len(prints), np.int64), np.array(_bands())
    for x in range(len(prints) - 1):
        same = digits[x + 1 :] == digits[x]
        alike = (same.sum(axis=1) / SLOTS - 1 / 16) * 16 / 15 >= at_least - 1e-12
        if side[x] >= 0:
            alike &= side[x + 1 :] != side[x]
        at = np.flatnonzero(alike)
        at = at[same[at][:, bands].all(axis=2).argmax(axis=1) == band]
        out[x] += len(at)
        out[at + x + 1] += 1
    return out


def _degrees(batches: Iterator[pa.RecordBatch], at_least: float) -> Iterable[pa.RecordBatch]:
    """``degrees`` of runs of equal (cell, pair), which arrive one after the other; one run is held at a time."""
    run: tuple | None = None
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        ids, prints, bands, sides = zip(*held) if held else ((),) * 4
        found = degrees(list(prints), bands[0], np.array(sides), at_least) if len(held) > 1 else np.zeros(len(held), np.int64)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found)], ["class_id", "n"])

    for batch in batches:
        for cell, pair, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "pair", "class_id", "fingerprint", "band", "side"))):
            if run != (cell, pair):
                yield made()
                run = (cell, pair)
            held.append(tuple(row))
    yield made()


def classes(prints: DataFrame, at_least: float = 0.8) -> DataFrame:
    """fingerprint, class_id and n_links of every distinct fingerprint of ``prints`` (doc_id, fingerprint).

    A class is a distinct fingerprint, named by its smallest doc_id, and links to the other
    classes that share a band of sampled digits with it and are at least so alike. Band keys
    are counted first; those of several classes meet in tasks, which give counts and no
    pairs; a key of more than ``CELL`` classes is split into chunks by a hash of the class,
    and each pair of chunks is a task's work of its own. Rows without id are a class like
    others, whose class_id is null if it has nothing else.
    """
    spark = prints.sparkSession
    named = settle(prints.groupBy("fingerprint").agg(F.min(F.col("doc_id").cast("long")).alias("class_id")), free=True)
    keyed = named.select(F.xxhash64("fingerprint").alias("class_id"), "fingerprint").mapInArrow(_banded, "cell long, band int, class_id long, fingerprint string")
    chunks = F.when(F.col("count") > CELL, F.ceil(2 * F.col("count") / CELL)).otherwise(1).cast("int")
    shared = settle(keyed.groupBy("cell").count().where("count > 1").select("cell", chunks.alias("chunks")), free=True)
    mine = F.pmod("class_id", F.col("chunks").cast("long")).cast("int")
    lower, upper = F.least("mine", "their"), F.greatest("mine", "their")
    dealt = (
        keyed.join(shared, "cell")
        .withColumn("mine", mine)
        .withColumn("their", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("cell", (lower * F.lit(1 << 24) + upper).cast("long").alias("pair"), "class_id", "fingerprint", "band", F.when(lower == upper, F.lit(-1)).otherwise(F.col("mine")).cast("long").alias("side"))
    )
    counted = dealt.repartition(partitions(spark), "cell", "pair").sortWithinPartitions("cell", "pair").mapInArrow(partial(_degrees, at_least=at_least), "class_id long, n long")
    linked = counted.groupBy("class_id").agg(F.sum("n").alias("n")).withColumnRenamed("class_id", "hash")
    return named.withColumn("hash", F.xxhash64("fingerprint")).join(linked, "hash", "left").select("fingerprint", "class_id", F.coalesce("n", F.lit(0)).alias("n_links"))


def candidate_pairs(prints: DataFrame, at_least: float = 0.8) -> DataFrame:
    """doc_id, class_id and n_links of every document of ``prints`` (doc_id, fingerprint); see ``classes``."""
    prints = prints.select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint")
    prints = settle(prints, free=True)
    return prints.join(classes(prints, at_least), "fingerprint").select("doc_id", "class_id", "n_links")


def near_texts(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """``edit_fingerprints`` of all documents, with the class_id and n_links of each one's fingerprint."""
    found = settle(edit_fingerprints(docs), free=True)
    return found.join(classes(found, at_least), "fingerprint").select(*found.columns, "class_id", "n_links")


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The key of each fingerprint in every band: numbers only, the fingerprints stay behind."""
    for batch in batches:
        prints, nodes = batch.column("fingerprint").to_pylist(), batch.column("node")
        keys = [xxhash.xxh64_intdigest(f"{b}:{''.join(pick(p))}", SEED) - (1 << 63) for b, pick in enumerate(_PICKS) for p in prints]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.concat_arrays([nodes] * len(_PICKS))], ["cell", "node"])


def _digits(prints: list[str]) -> np.ndarray:
    return np.frombuffer("".join(prints).encode(), np.uint8).reshape(len(prints), SLOTS)


def _alike(same: np.ndarray, at_least: float) -> np.ndarray:
    """Whether so many equal digits come to a likeness of ``at_least``."""
    return (same / SLOTS - 1 / 16) * 16 / 15 >= at_least - 1e-12


def _verified(batches: Iterator[pa.RecordBatch], at_least: float) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        a, b = (_digits(batch.column(c).to_pylist()) for c in ("print_a", "print_b"))
        yield batch.select(["a", "b"]).filter(pa.array(_alike((a == b).sum(axis=1), at_least)))


def _joined(batches: Iterator[pa.RecordBatch], at_least: float) -> Iterable[pa.RecordBatch]:
    """Links that connect, in each run of equal (cell, pair), all that are alike and apart so far; one run is held at a time."""
    run: tuple | None = None
    held: list[tuple] = []

    def made() -> pa.RecordBatch:
        links: list[tuple[int, int]] = []
        if len(held) > 1:
            nodes, roots, sides, prints = zip(*held)
            digits, side = _digits(list(prints)), np.array(sides)
            _, label = np.unique(np.array(roots, np.int64), return_inverse=True)
            for x in range(len(nodes) - 1):
                apart = label[x + 1 :] != label[x]
                if side[x] >= 0:
                    apart &= side[x + 1 :] != side[x]
                at = np.flatnonzero(apart) + x + 1
                for y in at[_alike((digits[at] == digits[x]).sum(axis=1), at_least)].tolist():
                    if label[y] != label[x]:
                        links.append((nodes[x], nodes[y]))
                        label[label == label[y]] = label[x]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([link[i] for link in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for cell, pair, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "pair", "node", "root", "side", "fingerprint"))):
            if run != (cell, pair):
                yield made()
                run = (cell, pair)
            held.append(tuple(row))
    yield made()


def linked_classes(prints: DataFrame, at_least: float = 0.8) -> DataFrame:
    """fingerprint and component_id of every distinct fingerprint of ``prints`` (doc_id, fingerprint).

    Fingerprints link if they share a band key and are at least so alike; component_id is the smallest doc_id that links
    lead to. Only keys and hashes of fingerprints are shuffled to find what shares a key. Of each key all are compared with one
    centre first, which joins most of a large group; keys that still have several components meet in tasks, where only what is
    apart is compared, and a forest of links comes out. A key of more than ``CELL`` is split into pairs of
    chunks. So no link between components is lost and no pairs of a group are made. A component of rows without ids alone has no id.
    """
    spark = prints.sparkSession
    named = settle(prints.groupBy("fingerprint").agg(F.min(F.col("doc_id").cast("long")).alias("first_id")).withColumn("node", F.xxhash64("fingerprint")), free=True)
    own = named.select("node", "fingerprint")
    keyed = settle(own.mapInArrow(_keys, "cell long, node long"), free=True)
    shared = keyed.groupBy("cell").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").select("cell", "centre")
    cells = settle(keyed.join(shared, "cell"), free=True)
    discard(keyed)
    of = lambda c: own.select(F.col("node").alias(c), F.col("fingerprint").alias(f"print_{c}"))
    pairs = cells.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    links = settle(pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "print_a", "print_b").mapInArrow(partial(_verified, at_least=at_least), "a long, b long"), free=True)
    labels = components(links)
    known = cells.join(labels, "node", "left").select("cell", "node", F.coalesce("root", "node").alias("root"))
    still = known.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low < high")
    known = settle(known.join(still.select("cell", F.when(F.col("n") > CELL, F.ceil(2 * F.col("n") / CELL)).otherwise(1).cast("int").alias("chunks")), "cell"), free=True)
    mine, lower, upper = F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int"), F.least("mine", "their"), F.greatest("mine", "their")
    dealt = known.withColumn("mine", mine).withColumn("their", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("cell", (lower * F.lit(1 << 24) + upper).cast("long").alias("pair"), "node", "root", F.when(lower == upper, F.lit(-1)).otherwise(F.col("mine")).cast("long").alias("side"))
    met = dealt.join(own, "node").repartition(partitions(spark), "cell", "pair").sortWithinPartitions("cell", "pair")
    more = settle(met.mapInArrow(partial(_joined, at_least=at_least), "a long, b long"), free=True)
    if not more.isEmpty():
        discard(labels)
        labels = components(links.unionByName(more))
    rooted = named.join(labels, "node", "left").select("fingerprint", F.coalesce("root", "node").alias("root"), "first_id")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    out = settle(rooted.join(least, "root").select("fingerprint", "component_id"), free=True)
    discard(named, cells, links, known, more, labels)
    return out


def linked_texts(docs: DataFrame, at_least: float = 0.8) -> DataFrame:
    """``edit_fingerprints`` of all documents, with the component_id of each one's fingerprint."""
    found = settle(edit_fingerprints(docs), free=True)
    return found.join(linked_classes(found, at_least), "fingerprint").select(*found.columns, "component_id")
