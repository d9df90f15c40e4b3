"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A word stands for itself and for its shape (runs of capitals, small letters and digits
become one character each, runs of a symbol one symbol; a word equal to the one before
has a shape of its own). The n-grams are single words and one to three neighbouring
shapes, hashed; an n-gram's value is the root of its share of its kind in the text. A
document's score is the sparse dot product of these values with the trained weights.

Defined cases: null and blank texts have no n-grams and score what the bias gives; no
labelled rows, or labels of one kind only, give 0.5 (or the share of that kind, kept
off 0 and 1); a document that stands in several rows teaches once, and all its rows are
scored; very long texts are scored whole; no documents give no rows; columns other than
doc_id and text are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import held_out, in_pieces
from tilespark.llm.labelled import BITS, TRAINING_FEATURES, TRAINING_ROWS, FollowTheLeader, bucket, gather, sigmoid, training_texts

THRESHOLD = 0.3
EPOCHS = 4
_WIDTH = np.uint64((1 << BITS) - 1)
_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 57 if 48 <= c <= 57 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_REPEAT = bucket("\x00again")


class _Words(dict):
    """Word -> bucket of the word and bucket of its shape, in one number; refilled when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        shape = _RUN.sub(rb"\1", word.encode("utf-8", "surrogatepass").translate(_SHAPE))[:12].decode("ascii")
        self[word] = found = bucket("w " + word.lower()) << BITS | bucket("s " + shape)
        return found


def _ngrams(text: str, words: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of a text and their values."""
    found = np.fromiter(map(words.__getitem__, text.split()), np.int64)
    if not len(found):
        return found, np.zeros(0)
    own, shapes = found >> BITS, (found & int(_WIDTH)).astype(np.uint64)
    shapes[1:][own[1:] == own[:-1]] = _REPEAT
    kinds = [own]
    mixed = shapes
    for n in range(1, 4):
        if len(shapes) < n:
            break
        if n > 1:
            mixed = (mixed[: len(shapes) - n + 1] * np.uint64(0x9E3779B1) + shapes[n - 1 :] + np.uint64(n)) * np.uint64(0x85EBCA77)
        kinds.append(((mixed ^ (mixed >> np.uint64(17))) & _WIDTH).astype(np.int64))
    at, counts = np.unique(np.concatenate(kinds), return_counts=True)
    return at, np.sqrt(counts / len(found))


def _featuriser() -> Callable[[str], list[np.ndarray]]:
    words = _Words()
    return lambda text: list(_ngrams(text, words))


def _strongest(parts: list[np.ndarray]) -> list[np.ndarray]:
    """The ``TRAINING_FEATURES`` n-grams of a training row with the greatest values."""
    at, value = parts
    if len(at) <= TRAINING_FEATURES:
        return parts
    kept = np.sort(np.lexsort((at, -value))[:TRAINING_FEATURES])
    return [at[kept], value[kept]]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights fitted to ``labels.quality`` on at most ``rows`` documents that are not held out."""
    sample = gather(training_texts(docs, labels, "quality", rows), _featuriser(), ["int", "float"], _strongest)
    if (found := {label for label, _ in sample}) != {0, 1}:
        return np.zeros(0, np.int64), np.zeros(0), {0: -4.0, 1: 4.0}.get(*found) if found else 0.0
    model = FollowTheLeader(alpha=0.5, l1=0.3, l2=0.1)
    for _ in range(EPOCHS):
        for label, [at, value] in sample:
            model.update(at, value, sigmoid(model.margin(at, value)) - label)
    return model.sparse()


def _scorer(model: tuple[np.ndarray, np.ndarray, float]) -> Callable[[pa.Array], list[float]]:
    """Scores a column of texts."""
    at, value, bias = model
    dense, words = np.zeros(1 << BITS), _Words()
    dense[at] = value

    def scores(texts: pa.Array) -> list[float]:
        found = (_ngrams(text or "", words) for text in texts.to_pylist())
        return [sigmoid(dense[where] @ x + bias) for where, x in found]

    return scores


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        scores = _scorer(weights.value)
        for batch in in_pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text")), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject, with their columns, whatever their names, as they were."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        scores = _scorer(weights.value)
        for batch in in_pieces(batches):
            yield batch.filter(pa.array([x >= THRESHOLD for x in scores(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
