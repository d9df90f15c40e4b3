"""Benchmark decontamination: a prefix-filtered set join, verified by exact windows.

An item's windows are its runs of ``WINDOW`` words, or all its words if it has fewer.
A document contains a window only if it contains every shingle of it, so one shingle,
the prefix, is enough to find candidates. Shingles are ordered by rarity, counted over
all documents, and each window is filed under its rarest. The position of that shingle
in the window fixes where the window would begin in the document; candidates that
would begin before or end after the document's words go, and the rest are compared
word by word with the item-sized window.

A benchmark of at most ``SLICE_WORDS`` words, and sixteen bytes for each, is held as one
index that the tasks are sent. A larger one stays a table: its windows and their prefixes
are worked out in tasks, the documents' shingles that a bitmap of fixed size lets through
are joined to them, and each candidate is compared with the words around the shingle. The
documents are read twice either way, once to count and once to find.

Defined cases: null and blank texts have no words and are not contaminated; items
without words have no windows; null item ids are left out of the digest's list but
counted; rows with equal ids are rows of their own; an empty benchmark hits nothing; very
long items and texts are read whole; columns other than those named, whatever their names,
are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilespark.llm.common import discard, in_pieces, received, send, settle

WINDOW = 13
SHINGLE = 3
#: Item words in a broadcast index; a benchmark of more is joined as a table.
SLICE_WORDS = 1 << 20
#: Bits of the map of shingles that documents are filtered by before that join.
MAP_BITS = 1 << 26
#: A shingle with more than this share of all occurrences is dealt to ``SALTS`` tasks.
HOT_SHARE = 1 / 4096
SALTS = 64
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes that belong to words keep themselves or become small letters; all others part words.
_TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Index:
    """Windows of some items, filed under their shingles."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        known = self.vocabulary
        windows: dict[tuple[int, ...], set[int]] = {}
        for number, (_, item) in enumerate(items):
            ids = [known.setdefault(w, len(known)) for w in item]
            for i in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + WINDOW]), set()).add(number)
        self.item_ids = [i for i, _ in items]
        self.windows = list(windows)
        self.owners = [sorted(windows[w]) for w in self.windows]
        self.base = len(known) + 1
        self.codes = [np.unique(np.concatenate([self.shingles(np.array(w), k) for w in self.windows if min(len(w), SHINGLE) == k] or [np.zeros(0, np.int64)])) for k in range(1, SHINGLE + 1)]

    def ids(self, text: str | None) -> np.ndarray:
        found = words(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(-1)), np.int64, len(found))

    def shingles(self, ids: np.ndarray, k: int) -> np.ndarray:
        """A number for each run of k words, -1 where a word is in no item.

        With over two million words in the index, runs of three could share a number;
        that only makes candidates, which are compared word by word.
        """
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code, whole = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k):
            part = ids[j : j + n]
            code = code * self.base + part
            whole &= part >= 0
        return np.where(whole, code & 0x7FFFFFFFFFFFFFFF, -1)

    def occurrences(self, ids: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions in a text, and places in ``codes``, of the shingles that items have."""
        codes, own = self.codes[kind - 1], self.shingles(ids, kind)
        if not len(codes) or not len(own):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.searchsorted(codes, own)
        at = np.flatnonzero(codes[np.minimum(place, len(codes) - 1)] == own)
        return at, place[at]

    def file(self, counts: list[np.ndarray]) -> None:
        """File each window under its rarest shingle (ties: the one that comes first)."""
        self.filed: list[list[list[tuple[int, int]]]] = [[[] for _ in c] for c in self.codes]
        self.prefix = [np.zeros(len(c), bool) for c in self.codes]
        for number, window in enumerate(self.windows):
            kind = min(len(window), SHINGLE)
            place = np.searchsorted(self.codes[kind - 1], self.shingles(np.array(window), kind))
            offset = int(np.argmin(counts[kind - 1][place]))
            self.filed[kind - 1][place[offset]].append((number, offset))
            self.prefix[kind - 1][place[offset]] = True
        self.texts = [np.array(w) for w in self.windows]

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Starts and ends of all windows that occur in a text (two columns), and their items."""
        spans, items = set(), set()
        for kind in range(1, SHINGLE + 1):
            at, place = self.occurrences(ids, kind)
            wanted = self.prefix[kind - 1][place]
            for position, code in zip(at[wanted].tolist(), place[wanted].tolist()):
                for number, offset in self.filed[kind - 1][code]:
                    window, start = self.texts[number], position - offset
                    end = start + len(window)
                    if start >= 0 and end <= len(ids) and (ids[start:end] == window).all():
                        spans.add((start, end))
                        items.update(self.owners[number])
        return np.array(sorted(spans), np.int64).reshape(-1, 2), items


def _joined(spans: np.ndarray) -> list[list[int]]:
    """Sorted spans, united where they touch."""
    out: list[list[int]] = []
    for start, end in spans.tolist():
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _items(benchmark: DataFrame, most: int) -> list[tuple[int | None, list[bytes]]] | None:
    """The items that have words, if these are at most ``most`` and of bounded length; else None."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.regexp_count("text", F.lit(_WORD)).alias("n")).where("n > 0")
    size = items.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if size["words"] > most or size["bytes"] > 16 * most:
        return None
    found = items.select("item_id", "text").toArrow()
    return [(i, words(t)) for i, t in zip(found.column("item_id").to_pylist(), found.column("text").to_pylist())]


def _prepared(texts: DataFrame, items: list[tuple[int | None, list[bytes]]]):
    """A broadcast index whose windows are filed by the shingle counts of all ``texts``."""
    spark = texts.sparkSession
    index = Index(items)
    sent = send(spark, index)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = received(sent)
        totals = [np.zeros(len(c), np.int64) for c in own.codes]
        for batch in in_pieces(batches):
            for text in batch.column(0).to_pylist():
                ids = own.ids(text)
                for kind in range(1, SHINGLE + 1):
                    totals[kind - 1] += np.bincount(own.occurrences(ids, kind)[1], minlength=len(totals[kind - 1]))
        for kind, total in enumerate(totals):
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), kind), pa.int32()), pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["kind", "place", "n"])

    counts = [np.zeros(len(c), np.int64) for c in index.codes]
    # one row at most for each shingle of the slice
    rows = texts.select("text").mapInArrow(counted, "kind int, place long, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toArrow()
    for kind in range(SHINGLE):
        own = rows.filter(pa.compute.equal(rows.column("kind"), kind))
        counts[kind][own.column("place").to_numpy()] = own.column("n").to_numpy()
    index.file(counts)
    sent.unpersist()
    return send(spark, index)


def _found(texts: DataFrame, sent, keep: list[T.StructField]) -> DataFrame:
    """``keep`` columns, n_words, spans (united) and items of every row of ``texts``."""
    names = [f.name for f in keep]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        index = received(sent)
        for batch in in_pieces(batches):
            n_words, spans, items = [], [], []
            for text in batch.column("text").to_pylist():
                ids = index.ids(text)
                where, which = index.hits(ids)
                n_words.append(len(ids))
                spans.append(_joined(where))
                items.append([index.item_ids[i] for i in sorted(which)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.int64()))], [*names, "n_words", "spans", "items"])

    made = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.LongType()))]
    return texts.mapInArrow(found, T.StructType([*keep, *made]))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        hit, digests = [], []
        for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
            hit.append(sum(b - a for a, b in _joined(np.array(sorted(spans), np.int64).reshape(-1, 2))))
            digests.append(hashlib.sha256(",".join(sorted(str(i) for i in items if i is not None)).encode()).hexdigest())
        counts = [len(x) for x in batch.column("items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


class Hashes:
    """A number for each run of words of a text, the same in every task."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def words(self, found: list[bytes]) -> np.ndarray:
        if len(self.known) > 1 << 18:
            self.known.clear()
        known = self.known
        for w in set(found).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))

    def shingles(self, found: list[bytes], k: int) -> np.ndarray:
        own = self.words(found)
        n = len(own) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        code = np.full(n, k, np.uint64)
        for j in range(k):
            code = (code ^ own[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return code.view(np.int64)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The distinct windows of each item, as words joined by a space."""
    for batch in batches:
        for number, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
            item = words(text)
            made = sorted({b" ".join(item[i : i + WINDOW]) for i in range(max(1, len(item) - WINDOW + 1) if item else 0)})
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(made), pa.int64()), pa.array([m.decode("utf-8", "replace") for m in made], pa.string())], ["item", "run"])


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The shingles of each window, with their places in it."""
    hashes = Hashes()
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for number, run in zip(batch.column("number").to_pylist(), batch.column("run").to_pylist()):
            own = run.encode().split(b" ")
            out += [(number, i, h) for i, h in enumerate(hashes.shingles(own, min(len(own), SHINGLE)).tolist())]
        columns = list(zip(*out)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["number", "offset", "shingle"])


def _bitmap(shingles: DataFrame):
    """A broadcast map with the bits of all ``shingle`` values set; its size does not depend on them."""
    bit = F.pmod("shingle", F.lit(MAP_BITS)).cast("long")
    mask = F.expr(f"shiftleft(1L, cast(pmod(shingle, {MAP_BITS}L) % 64 AS int))")
    rows = shingles.groupBy(F.shiftright(bit, 6).alias("at")).agg(F.bit_or(mask).alias("bits")).toArrow()
    bits = np.zeros(MAP_BITS // 64, np.int64)
    bits[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return send(shingles.sparkSession, bits)


def _mapped(shingles: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Positions of the shingles whose bit is set."""
    at = shingles & np.int64(MAP_BITS - 1)
    return np.flatnonzero((bits[at >> 6] >> (at & 63)) & 1)


def _found_by_join(texts: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row, spans and items (null if nothing is hit) of the rows of ``texts`` (row, text) that are hit.

    Windows, prefixes and hits are tables. A shingle that holds more than ``HOT_SHARE`` of
    all occurrences, of which there are fewer than 1 / ``HOT_SHARE``, is dealt to ``SALTS``
    keys. Numbers of shingles that happen to be equal only make candidates.
    """
    spark = texts.sparkSession
    items = settle(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item", F.monotonically_increasing_id()))
    owned = settle(items.select("item", "text").mapInArrow(_windows, "item long, run string"))
    runs = settle(owned.select("run").distinct().withColumn("number", F.monotonically_increasing_id()))
    places = settle(runs.select("number", "run").mapInArrow(_shingled, "number long, offset int, shingle long"))
    every = _bitmap(places)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        bits, hashes = received(every), Hashes()
        for batch in batches:
            seen = [np.zeros(0, np.int64)]
            for text in batch.column("text").to_pylist():
                own = words(text)
                for k in range(1, SHINGLE + 1):
                    codes = hashes.shingles(own, k)
                    seen.append(codes[_mapped(codes, bits)])
            codes, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n, pa.int64())], ["shingle", "n"])

    counts = settle(texts.select("text").mapInArrow(counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")))
    ranked = places.join(counts, "shingle", "left").select("number", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle").alias("place"))
    prefixes = settle(ranked.groupBy("number").agg(F.min("place").alias("place")).select("number", "place.offset", "place.shingle", "place.n"))
    total = prefixes.select("shingle", "n").distinct().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = [r["shingle"] for r in prefixes.where(F.col("n") > F.lit(max(total * HOT_SHARE, SALTS))).select("shingle").distinct().collect()]
    wanted, split = _bitmap(prefixes), send(spark, np.array(sorted(hot), np.int64))

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        bits, often, hashes = received(wanted), received(split), Hashes()
        fields = {"row": pa.int64(), "shingle": pa.int64(), "salt": pa.int32(), "position": pa.int64(), "lead": pa.int32(), "around": pa.string()}
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                own, out = words(text), []
                for k in range(1, SHINGLE + 1):
                    codes = hashes.shingles(own, k)
                    at = _mapped(codes, bits)
                    salts = np.where(np.isin(codes[at], often), (row + at) % SALTS, 0)
                    for i, code, salt in zip(at.tolist(), codes[at].tolist(), salts.tolist()):
                        first = max(0, i - WINDOW + 1)
                        out.append((row, code, salt, i, i - first, b" ".join(own[first : i + WINDOW]).decode("utf-8", "replace")))
                columns = list(zip(*out)) or [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values())], list(fields))

    at = texts.select("row", "text").mapInArrow(occurring, "row long, shingle long, salt int, position long, lead int, around string")
    salts = F.when(F.col("n") > F.lit(max(total * HOT_SHARE, SALTS)), F.lit(SALTS)).otherwise(F.lit(1))
    filed = prefixes.join(runs, "number").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumn("size", F.size(F.split("run", " ")))
    begins = F.col("lead") - F.col("offset")
    same = F.array_join(F.slice(F.split("around", " "), F.greatest(begins, F.lit(0)) + 1, F.col("size")), " ") == F.col("run")
    start = F.col("position") - F.col("offset")
    hits = settle(at.join(filed, ["shingle", "salt"]).where((begins >= 0) & same).select("row", "number", start.alias("start"), (start + F.col("size")).alias("end")).distinct())
    spans = hits.groupBy("row").agg(F.collect_set(F.array("start", "end")).alias("spans"))
    owners = owned.join(runs, "run").select("number", "item")
    hit = hits.select("row", "number").distinct().join(owners, "number").select("row", "item").distinct().join(items.select("item", "item_id"), "item")
    # null ids count, so each is kept as a struct, which collect_list does not leave out
    ids = hit.groupBy("row").agg(F.transform(F.collect_list(F.struct("item_id")), lambda x: x["item_id"]).alias("items"))
    discard(places, counts)
    return spans.join(ids, "row")


def contamination(docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _items(benchmark, slice_words)
    if items is not None:
        rows = _found(texts, _prepared(texts, items), [texts.schema["doc_id"]])
    else:
        # rows of equal id and text are told apart by their number, so that the join by row is exact
        texts = settle(texts.withColumn("row", F.monotonically_increasing_id()))
        hit = _found_by_join(texts, benchmark)
        counted = texts.select("row", "doc_id", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
        none = F.array().cast("array<array<bigint>>"), F.array().cast("array<bigint>")
        rows = counted.join(hit, "row", "left").select("doc_id", "n_words", F.coalesce("spans", none[0]).alias("spans"), F.coalesce("items", none[1]).alias("items"))
    rows = rows.select("doc_id", "n_words", "spans", "items").mapInArrow(_digested, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The documents that the rule does not call contaminated, with their columns as they were."""
    items = _items(benchmark, slice_words)
    if items is None:
        number = "row number"
        while number in {c.lower() for c in docs.columns}:
            number += "_"
        rows = settle(docs.withColumn(number, F.monotonically_increasing_id()))
        bad = contamination(rows.select(F.col(number).alias("doc_id"), "text"), benchmark, slice_words).where("contaminated")
        return rows.join(bad.select(F.col("doc_id").alias(number)), number, "left_anti").select(*[rows[f"`{c}`"] for c in docs.columns])
    sent, names = _prepared(docs, items), docs.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        index = received(sent)
        for batch in in_pieces(batches):
            keep = []
            for text in batch.column(names.index("text")).to_pylist():
                ids = index.ids(text)
                n_hit = sum(b - a for a, b in _joined(index.hits(ids)[0]))
                keep.append(not (n_hit and 20 * n_hit >= len(ids)))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
