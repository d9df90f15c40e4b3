"""Labelled rows for the classifiers, and the optimiser that both of them use."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import held_out

#: A classifier is fitted on at most so many labelled rows, those with the smallest hashed ids.
TRAINING_ROWS = 8_000
#: A row of the fit has at most so many features; scoring takes all of a text's.
TRAINING_FEATURES = 1 << 13
#: Width of the hashed feature space.
BITS = 20


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def by_hash(df: DataFrame, key: str, rows: int, of: int) -> DataFrame:
    """A sample of at most ``rows`` rows, those with the smallest hashes of ``key``.

    ``of`` is about how many rows there are. Hashes beyond three times the share wanted
    are left out before the sort, so what meets in its last task does not grow with the
    number of partitions.
    """
    h = F.xxhash64(key)
    if of > 4 * rows:
        df = df.where(h < int(-(1 << 63) + (1 << 64) * 3 * rows / of))
    return df.withColumn("_hash", h).orderBy("_hash", key).limit(rows).drop("_hash")


def training_texts(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAINING_ROWS) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents that are not held out.

    Repeated label rows of a document count as positive if any is; null ids and null
    labels teach nothing. Of rows that share an id the text with the smallest hash
    teaches, so what comes out, and what is broadcast, is bounded by ``rows``.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = by_hash(known, "doc_id", rows, known.count())
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return own.groupBy("doc_id").agg(F.first("label").alias("label"), F.min_by("text", F.xxhash64("text")).alias("text"))


def gather(texts: DataFrame, featurise: Callable[[str], list[np.ndarray]], kinds: list[str], bounded: Callable[[list[np.ndarray]], list[np.ndarray]] = lambda parts: parts) -> list[tuple[int, list[np.ndarray]]]:
    """Labels and hashed features of the training rows, on the driver.

    ``featurise`` gives one array for each of ``kinds`` (int or float), and ``bounded``
    keeps at most ``TRAINING_FEATURES`` of them. Executors hash the texts, so what is
    gathered is bounded by rows times features; it stays in 32-bit numbers.
    """
    names = [f"part{i}" for i in range(len(kinds))]
    arrow = [pa.int64(), pa.int32(), *(pa.list_(pa.int32() if k == "int" else pa.float32()) for k in kinds)]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in arrow]
            for doc_id, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text"))):
                for column, x in zip(out, (doc_id, label, *(v.astype(np.int32 if k == "int" else np.float32) for v, k in zip(bounded(featurise(text or "")), kinds)))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, arrow)], ["doc_id", "label", *names])

    schema = "doc_id long, label int, " + ", ".join(f"{n} array<{k}>" for n, k in zip(names, kinds))
    found: list[tuple] = []
    for batch in texts.mapInArrow(hashed, schema).toArrow().to_batches():
        cuts = [(c.flatten().to_numpy(zero_copy_only=False), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in batch.columns[2:]]
        for row, (doc_id, label) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            found.append((doc_id, label, [values[ends[row] : ends[row + 1]] for values, ends in cuts]))
    # the order of the rows must not depend on how they were dealt out
    found.sort(key=lambda x: (zlib.crc32(str(x[0]).encode()), x[0], x[2][0].tobytes()))
    return [(label, parts) for _, label, parts in found]


class FollowTheLeader:
    """Follow-the-regularised-leader (proximal) logistic regression on sparse rows."""

    def __init__(self, alpha: float = 0.1, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        return float(self.weights(at) @ value + self.bias)

    @property
    def bias(self) -> float:
        """Kept at the last index; like the rest, but not drawn to zero."""
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))

    def update(self, at: np.ndarray, value: np.ndarray, slope: float, bias: bool = True) -> None:
        """One step against the gradient ``slope * value``; ``at`` has no index twice."""
        steps = [(at, slope * value), (np.array([self.z.size - 1]), np.array([slope]))]
        for where, g in steps[: 1 + bias]:
            w = self.weights(where) if where is at else np.array([self.bias])
            sigma = (np.sqrt(self.n[where] + g * g) - np.sqrt(self.n[where])) / self.alpha
            self.z[where] += g - sigma * w
            self.n[where] += g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Indices and values of the weights that are not zero, and the bias."""
        w = self.weights(slice(0, 1 << BITS))
        at = np.flatnonzero(w)
        return at, w[at], self.bias


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-min(max(x, -60.0), 60.0))))
