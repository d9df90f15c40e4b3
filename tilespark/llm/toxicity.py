"""Toxicity: a classifier regularised by counterfactuals.

The features are the distinct words of a text and their beginnings of four to eight
letters (so that one weight serves inflected forms), hashed. The weights come from
follow-the-regularised-leader steps on the labelled texts. Every labelled text has one
counterfactual: each identity term in its sentences is swapped for one of the same kind,
chosen by a hash of the text, and a text that names no group gets a neutral mention. The
training loss adds ``COUNTERFACTUAL`` times the squared difference of the two margins, so
that what group a text mentions moves its score as little as can be.

Defined cases: null and blank texts score what the bias gives; no labelled rows, or
labels of one kind only, give the same score to all; a document that stands in several
rows teaches once, and all its rows are scored; very long texts are scored whole; no
documents give no rows; columns other than doc_id and text are never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import held_out
from tilespark.llm.labelled import TRAINING_FEATURES, TRAINING_ROWS, FollowTheLeader, bucket, gather, sigmoid, training_texts

THRESHOLD = 0.5
EPOCHS = 5
#: Weight of a toxic training row; they are the fewer.
POSITIVE = 2.0
COUNTERFACTUAL = 0.2
#: Groups that a text may mention, in the corpus's four languages (others are not known); a term is swapped for the term in the same place of another group.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("immigrants", "refugees", "citizens", "foreigners"),
    ("disabled", "blind", "deaf", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("gays", "hétéros", "lesbiennes", "bisexuels", "transgenres"),
    ("noirs", "blancs", "asiatiques", "arabes", "européens"),
    ("immigrés", "réfugiés", "citoyens", "étrangers"),
    ("handicapés", "aveugles", "sourds", "âgés", "jeunes"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "buddhisten", "atheisten"),
    ("schwule", "lesben", "bisexuelle", "heterosexuelle"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer"),
    ("einwanderer", "flüchtlinge", "bürger", "ausländer"),
    ("behinderte", "blinde", "gehörlose", "alte", "junge"),
    ("mujeres", "hombres", "chicas", "chicos"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos"),
    ("inmigrantes", "refugiados", "ciudadanos", "extranjeros"),
    ("discapacitados", "ciegos", "sordos", "ancianos", "jóvenes"),
)
_SWAPS = {term: group for group in IDENTITY_TERMS for term in group}
_IDENTITY = re.compile(r"\b(" + "|".join(_SWAPS) + r")\b", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")


def _buckets(word: str) -> tuple[int, ...]:
    return (bucket("w " + word), *(bucket("p " + word[:n]) for n in range(4, 9) if len(word) >= n))


class _Buckets(dict):
    """Word -> the buckets of its features; emptied when large."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        self[word] = found = _buckets(word)
        return found


def _words(text: str) -> set[str]:
    return set(_LETTERS.findall(text.lower()))


def _features(text: str, known: _Buckets) -> np.ndarray:
    return np.unique(np.fromiter((b for w in _words(text) for b in known[w]), np.int64))


def _featuriser() -> Callable[[str], list[np.ndarray]]:
    """Gives the features of a text, and those that only it or only its counterfactual has."""
    known = _Buckets()

    def features(text: str) -> list[np.ndarray]:
        turn = zlib.crc32(text.encode("utf-8", "surrogatepass"))

        def other(found: re.Match) -> str:
            group = [t for t in _SWAPS[found.group().lower()] if t != found.group().lower()]
            return group[turn % len(group)]

        swapped, count = _IDENTITY.subn(other, text)
        if not count:
            group = IDENTITY_TERMS[turn % len(IDENTITY_TERMS)]
            swapped = f"{text} {group[turn // 7 % len(group)]}"
        own, swap = _features(text, known), _features(swapped, known)
        return [own, np.setdiff1d(own, swap, True), np.setdiff1d(swap, own, True)]

    return features


def _bounded(parts: list[np.ndarray]) -> list[np.ndarray]:
    """At most ``TRAINING_FEATURES`` features of a training row, those with the smallest scrambled numbers."""
    at = parts[0]
    if len(at) <= TRAINING_FEATURES:
        return parts
    scrambled = (at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    kept = np.sort(at[np.argsort(scrambled, kind="stable")[:TRAINING_FEATURES]])
    return [kept, np.intersect1d(parts[1], kept, True), parts[2][:TRAINING_FEATURES]]


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights fitted to ``labels.toxic`` on at most ``rows`` documents that are not held out."""
    sample = gather(training_texts(docs, labels, "toxic", rows), _featuriser(), ["int", "int", "int"], _bounded)
    if (found := {label for label, _ in sample}) != {0, 1}:
        return np.zeros(0, np.int64), np.zeros(0), {0: -4.0, 1: 4.0}.get(*found) if found else 0.0
    model = FollowTheLeader(alpha=0.4, l1=5.0, l2=1.0)
    for _ in range(EPOCHS):
        for label, [at, only, only_swap] in sample:
            ones = np.ones(len(at))
            slope = sigmoid(model.margin(at, ones)) - label
            model.update(at, ones, slope * (POSITIVE if label else 1.0))
            gap = float(model.weights(only).sum() - model.weights(only_swap).sum())
            if gap:
                for where, sign in ((only, 1.0), (only_swap, -1.0)):
                    model.update(where, np.ones(len(where)), sign * 2 * COUNTERFACTUAL * gap, bias=False)
    return model.sparse()


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, value, bias = weights.value
        dense = dict(zip(at.tolist(), value.tolist()))
        seen: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found: set[int] = set()
                if len(seen) > 400_000:
                    seen.clear()
                for word in _words(text or ""):
                    if (own := seen.get(word)) is None:
                        own = seen[word] = tuple(b for b in _buckets(word) if b in dense)
                    found.update(own)
                out.append(sigmoid(sum(dense[b] for b in sorted(found)) + bias))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
