"""Best-fit packing of tokenised documents into sequences of one length.

``tokenised`` cuts each document's ids into pieces of at most ``CAPACITY``. White space
parts tokens and is dropped by the vocabulary, so the ids of a text are those of its
white-space-separated chunks, one after another; each task keeps the ids of the chunks
that it has met and asks the tokenizer only for the others.

``packed`` runs in bulk-synchronous supersteps. Pieces without a place and the gaps of open
sequences are range-sorted by size and dealt by their place in that order to stripes of
at most ``STRIPE`` rows, so that each stripe holds an even sample of both. Every stripe sweeps
its pieces from the longest down: a piece goes to its successor among the gaps, the smallest
that takes it; of pieces that want one gap the first by rank (length, then row) gets it, and
the gap moves to what is left of it. What has no place in its stripe meets the
updated gaps of all stripes in the next superstep. A stripe of several opens no more sequences than
its tokens fill or than it has pieces over half of one, and none in every second superstep, so the
remainders of stripes go together. The last stripe, alone, opens what it needs.

Rows that shuffle are numbers only, never texts, and no group is larger than a stripe.

Defined cases: a null or empty text is one piece of the end id alone; rows with equal or
null ids are documents of their own; a longer document is cut at multiples of ``CAPACITY``
and only there; very long texts are read whole; ties of length go by row; no rows give no rows;
columns other than doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from functools import partial
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import discard, partitions, settle

CAPACITY = 4096
#: The id that ends each document.
END = 1
#: Rows, of pieces and gaps, that one task sweeps.
STRIPE = 1 << 16
#: Chunks whose ids a task keeps.
KEPT = 1 << 20
_CHARS = 1 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Kinds of rows in a superstep.
_PIECE, _GAP, _PLACED = 0, 1, 2
_STATE = f"kind int, {PIECE}, row long, sequence_id long, size long"

#: One run of Latin letters, with or without a run of marks after it: one or two words of the vocabulary.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?]+)?")
#: Python's white space that the vocabulary's is not.
_ODD_SPACE = "\x1c\x1d\x1e\x1f"


class Chunks:
    """Ids, as little-endian bytes, of texts by a vocabulary with word ends that drops white space."""

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        words = self.tokenizer.get_vocab()
        self.last = np.zeros(max(words.values()) + 1, bool)
        self.last[[i for word, i in words.items() if word.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Plain chunks are encoded many at a time, and parted at the tokens that end words."""
        plain, words, out = [], [], {}
        for chunk in chunks:
            if found := _PLAIN.fullmatch(chunk):
                plain.append(chunk)
                words.append(2 if found[1] else 1)
        for first in range(0, len(plain), 256):
            (ids,) = self._encode([" ".join(plain[first : first + 256])])
            ends = np.flatnonzero(self.last[ids])[np.cumsum(words[first : first + 256]) - 1] + 1
            out |= {c: part.tobytes() for c, part in zip(plain[first : first + 256], np.split(ids, ends))}
        other = [c for c in chunks if c not in out]
        return out | {c: ids.tobytes() for c, ids in zip(other, self._encode(other))}

    def of(self, texts: list[str]) -> list[bytes]:
        parted = [[] if any(c in t for c in _ODD_SPACE) else t.split() for t in texts]
        new = self._learn(sorted(set().union(*parted).difference(self.known)))
        if len(self.known) + len(new) <= KEPT:
            self.known |= new
            ids = self.known.__getitem__
        else:
            both = lambda c, known=self.known, new=new: known.get(c) or new[c]
            ids = both
        return [b"".join(map(ids, chunks)) if chunks or not t else self._encode([t])[0].tobytes() for t, chunks in zip(texts, parted)]


def _chunks(vocabulary: str) -> Chunks:
    """The chunks that this process has met, for all its tasks: functions of this package come anew with each task, modules stay."""
    held = sys.modules.setdefault("_chunks_of_tasks", ModuleType("_chunks_of_tasks"))
    if getattr(held, "vocabulary", None) != vocabulary:
        held.chunks, held.vocabulary = Chunks(vocabulary), vocabulary
    return held.chunks


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int) -> Iterable[pa.RecordBatch]:
    names, kinds = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    chunks, end = _chunks(vocabulary), END.to_bytes(4, "little")

    def made(ids: list, texts: list[str]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for doc, data in zip(ids, chunks.of(texts)):
            data += end
            for i, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                rows.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part)))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        ids, texts, size = [], [], 0
        for doc, text in zip(batch.column("doc_id"), batch.column("text")):
            ids.append(doc.as_py())
            texts.append(text.as_py() or "")
            size += len(texts[-1])
            if size > _CHARS:
                yield made(ids, texts)
                ids, texts, size = [], [], 0
        if ids:
            yield made(ids, texts)


def tokenised(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length and the crc32 of its ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(_pieces, vocabulary=vocabulary, capacity=capacity), PIECE)


def best_fit(lengths: list[int], free: list[int], capacity: int, opens: int | None) -> tuple[list[int], list[int], list[int]]:
    """Places of pieces, given by rank, in gaps: for each piece its gap (-1: none) and offset, and what every gap has left.

    Gaps beyond those given are sequences that were opened: at most ``opens``, or as many as it takes.
    """
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    sizes = 0  # bit f: there is a gap of f
    free = list(free)
    for gap in range(len(free) - 1, -1, -1):
        at[free[gap]].append(gap)
        sizes |= 1 << free[gap]
    gaps, offsets = [], []
    for length in lengths:
        fits = sizes >> length
        if fits:
            size = length + (fits & -fits).bit_length() - 1
            gap = at[size].pop()
            if not at[size]:
                sizes ^= 1 << size
        elif opens is None or opens > 0:
            size, gap = capacity, len(free)
            free.append(capacity)
            opens = opens and opens - 1
        else:
            gaps.append(-1)
            offsets.append(-1)
            continue
        gaps.append(gap)
        offsets.append(capacity - size)
        free[gap] = left = size - length
        if left:
            at[left].append(gap)
            sizes |= 1 << left
    return gaps, offsets, free


def _swept(table: pa.Table, capacity: int, opening: bool, alone: bool) -> pa.Table:
    """One stripe of a superstep: its pieces, placed or not, and its gaps as they are afterwards."""
    kind = table["kind"].to_numpy()
    rows, size = table["row"].to_numpy(), table["size"].to_numpy()
    pieces, gaps = np.flatnonzero(kind == _PIECE), np.flatnonzero(kind == _GAP)
    pieces = pieces[np.lexsort((rows[pieces], -size[pieces]))]
    gaps = gaps[np.argsort(rows[gaps])]
    lengths = size[pieces]
    opens = None if alone else max(1, int((2 * lengths > capacity).sum()), int(lengths.sum()) // capacity) if opening else 0
    where, offsets, free = best_fit(lengths.tolist(), size[gaps].tolist(), capacity, opens)
    where, left = np.array(where, np.int64), np.array(free, np.int64)
    sequence = rows[gaps]
    if len(left) > len(gaps):  # a sequence has the row of its first piece as its number
        new = np.zeros(len(left) - len(gaps), np.int64)
        first = np.array(offsets) == 0
        new[where[first] - len(gaps)] = rows[pieces[first]]
        sequence = np.concatenate([sequence, new])
    placed = where >= 0
    table = table.select(["doc_id", "piece", "start", "length", "ids_crc32", "row"])
    own = [table.column(c).combine_chunks().take(pa.array(pieces)) for c in table.column_names]
    none = lambda n, like: pa.nulls(n, like.type)
    still = left > 0
    n = int(still.sum())
    columns = [pa.concat_arrays([c, none(n, c) if name != "row" else pa.array(sequence[still])]) for c, name in zip(own, table.column_names)]
    kinds = pa.array(np.concatenate([np.where(placed, _PLACED, _PIECE), np.full(n, _GAP)]).astype(np.int32))
    numbers = pa.array(np.concatenate([np.where(placed, sequence[where] if len(sequence) else 0, 0), sequence[still]]))
    sizes = pa.array(np.concatenate([np.where(placed, offsets, lengths), left[still]]).astype(np.int64))
    return pa.table([kinds, *columns, numbers, sizes], names=["kind", *table.column_names, "sequence_id", "size"])


def _sweep(capacity: int, opening: bool, alone: bool):
    def sweep(table):
        return _swept(table, capacity, opening, alone)

    return sweep


def packed(pieces: DataFrame, capacity: int = CAPACITY, stripe: int = STRIPE) -> DataFrame:
    """``pieces`` (as ``tokenised`` gives them) with sequence_id and offset."""
    spark = pieces.sparkSession
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    whole = settle(pieces.select(*names, F.monotonically_increasing_id().alias("row")))
    out = whole.where(F.col("length") >= capacity).select(*names, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rows = whole.where(F.col("length") < capacity).select(F.lit(_PIECE).alias("kind"), *names, "row", F.lit(None).cast("long").alias("sequence_id"), F.col("length").alias("size"))
    count, opening, before = rows.count(), True, None
    while count:
        stripes = -(-count // stripe)
        dealt = rows
        if stripes > 1:
            ranged = rows.repartitionByRange(partitions(spark), "kind", "size", "row").sortWithinPartitions("kind", "size", "row")
            dealt = ranged.withColumn("stripe", F.monotonically_increasing_id() % stripes)
        else:
            dealt = rows.withColumn("stripe", F.lit(0).cast("long"))
        done = settle(dealt.groupBy("stripe").applyInArrow(_sweep(capacity, opening, stripes == 1), _STATE))
        discard(before)
        out = out.unionAll(done.where(F.col("kind") == _PLACED).select(*names, "sequence_id", F.col("size").alias("offset")))
        left = done.where(F.col("kind") == _PIECE)
        least, pieces_left = left.agg(F.min("size"), F.count("*")).first()
        if not pieces_left:
            break
        rows = left.unionAll(done.where((F.col("kind") == _GAP) & (F.col("size") >= least)))
        count, opening = rows.count(), not opening
    return out
