"""Hard negatives by distributed radix selection.

An anchor's positives are its best rows of the same label; each anchor and positive make a
window of scores, and the best rows of other labels in it are its hard negatives. Both are
selections of the first ``k`` rows of a window, by score and then by id, and ``selected`` makes them
without sorting scores: every pass counts the scores of each window by one digit of their
distance from its top, the digits are summed over all rows, and the digit where the k-th
row lies is refined in the next pass. Where very many rows share the k-th score, the digits of their ids
are next. When no more than ``GATHER`` rows of a window lie up to its k-th digit, these rows alone are gathered.

Rows are dealt into groups that fit a task, and the windows are sent to every group, a
query set against all rows in blocks: scores are exact products of integer matrices, worked out anew in
each pass and never stored. What leaves a task is at most ``RADIX`` counts or k rows a window.

Defined cases: rows with a null label, a null vector or a component that is null or not
finite take no part; a vector is compared with those of its length only; ties go by id, null last;
repeated rows are rows of their own, and another row with an anchor's id can be its positive; rows of
one label or fewer rows than asked for give what there is; no rows give none; columns that
are not named here are never read, whatever their names. Scores are exact up to 2^53 (an error beyond).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import discard, partitions, settle

POSITIVES, NEGATIVES = 5, 10
#: Negatives score from ``LOW`` to ``HIGH`` hundredths of their positive.
LOW, HIGH = 30, 90
SCALE = 256
DIGIT = 8
RADIX = 1 << DIGIT
#: Rows of a window that are gathered rather than counted once more.
GATHER = 32
#: Rows that one task holds while windows pass by, and windows whose scores it works out at once.
GROUP, BLOCK = 1 << 16, 64
_WINDOW = "anchor long, slot int, anchor_id long, positive_id long, positive_score long, label long, vector array<int>, low long, high long"
_STATE = f"{_WINDOW}, base long, shift int, id_base long, id_shift int, before long"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]
COUNTS = "anchor long, slot int, digit int, n long"
FOUND = "anchor long, slot int, anchor_id long, positive_id long, positive_score long, found_id long, score long"


def quantised(vectors: DataFrame, vec_id: Column, vector: Column, label: Column) -> DataFrame:
    """(row, vec_id, label, vector) of the rows that take part, components as integers."""
    good = label.isNotNull() & vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return vectors.where(good).select(F.monotonically_increasing_id().alias("row"), vec_id.cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vector"))


class Group:
    """Rows of one group, by the length of their vectors."""

    def __init__(self, ids: tuple[int, int], exact: str) -> None:
        self.ids, self.exact, self.parts, self.made = ids, exact, [], {}

    def add(self, batch: pa.RecordBatch, places: np.ndarray) -> None:
        self.parts.append(batch.select(["anchor", "anchor_id", "label", "vector"]).take(pa.array(places)))

    def of(self, size: int) -> tuple:
        """Row numbers, ids (null: beyond all others), labels and vectors of one length."""
        if not self.made and self.parts:
            table = pa.Table.from_batches(self.parts).combine_chunks()
            self.parts = []
            vectors = table["vector"].combine_chunks()
            sizes = np.diff(vectors.offsets.to_numpy())
            for n in np.unique(sizes):
                own = table.take(pa.array(np.flatnonzero(sizes == n)))
                flat = own["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                ids = own["anchor_id"].fill_null(self.ids[1] + 1).to_numpy()
                self.made[int(n)] = (own["anchor"].to_numpy(), ids, own["label"].to_numpy(), flat.reshape(len(own), int(n)).astype(self.exact))
        return self.made.get(size)


def _in_window(state: dict, group: tuple, scores: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a window, and how far their scores lie below its top."""
    rows, _, labels, _ = group
    fits = (scores >= state["low"]) & (scores <= state["high"])
    fits &= (labels == state["label"]) & (rows != state["anchor"]) if same else labels != state["label"]
    places = np.flatnonzero(fits)
    return places, state["high"] - scores[places].astype(np.int64)


def _digits(state: dict, group: tuple, scores: np.ndarray, same: bool, ids: tuple[int, int]) -> np.ndarray:
    """How many rows have each digit that is asked for next."""
    places, below = _in_window(state, group, scores, same)
    if state["id_shift"] is None:
        value, shift = below - state["base"], state["shift"]
    else:
        value, shift = group[1][places[below == state["base"]]] - ids[0] - state["id_base"], state["id_shift"]
    value = value[(value >= 0) & (value < 1 << shift)]
    return np.bincount(value >> max(0, shift - DIGIT), minlength=RADIX)


def _qualifying(state: dict, group: tuple, scores: np.ndarray, same: bool, ids: tuple[int, int], k: int) -> list[tuple]:
    """The rows up to the last digit; no task needs more than its first k."""
    places, below = _in_window(state, group, scores, same)
    take = below < state["base"] + (1 << state["shift"])
    if state["id_shift"] is not None:
        take &= (below < state["base"]) | (group[1][places] - ids[0] < state["id_base"] + (1 << state["id_shift"]))
    places, below = places[take], below[take]
    first = np.lexsort((group[1][places], below))[:k]
    own = tuple(state[c] for c in ("anchor", "slot", "anchor_id", "positive_id", "positive_score"))
    return [(*own, None if i > ids[1] else i, state["high"] - b) for i, b in zip(group[1][places[first]].tolist(), below[first].tolist())]


def _passed(batches: Iterator[pa.RecordBatch], same: bool, ids: tuple[int, int], exact: str, k: int, gather: bool) -> Iterable[pa.RecordBatch]:
    """Groups of rows (state is null), each followed by its windows: counts of digits, or the rows that qualify."""
    group, at = None, None
    schema = (FOUND if gather else COUNTS).split(", ")
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in schema]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [c.split()[0] for c in schema])

    for batch in batches:
        groups, is_row = batch.column("group").to_numpy(), batch.column("shift").is_null().to_numpy(zero_copy_only=False)
        for number in dict.fromkeys(groups.tolist()):
            if number != at:
                group, at = Group(ids, exact), number
            mine = groups == number
            if len(places := np.flatnonzero(mine & is_row)):
                group.add(batch, places)
            places = np.flatnonzero(mine & ~is_row)
            for first in range(0, len(places), BLOCK):
                states = batch.take(pa.array(places[first : first + BLOCK])).to_pylist()
                out: list[tuple] = []
                for size in {len(s["vector"]) for s in states}:
                    rows, some = group.of(size), [s for s in states if len(s["vector"]) == size]
                    if rows is None:
                        continue
                    anchors = {s["anchor"]: s["vector"] for s in some}
                    scores = dict(zip(anchors, np.array(list(anchors.values()), exact).reshape(len(anchors), size) @ rows[3].T))
                    for state in some:
                        if gather:
                            out += _qualifying(state, rows, scores[state["anchor"]], same, ids, k)
                        else:
                            counts = _digits(state, rows, scores[state["anchor"]], same, ids)
                            out += [(state["anchor"], state["slot"], d, int(counts[d])) for d in np.flatnonzero(counts).tolist()]
                yield made(out)


def _next(state: DataFrame, counts: DataFrame, k: int, ids: tuple[int, int]) -> DataFrame:
    """The windows after a pass: the digit of the k-th row fixed; ``over`` where no further pass is needed."""
    digits = counts.groupBy("anchor", "slot", "digit").agg(F.sum("n").alias("n")).groupBy("anchor", "slot").agg(F.sort_array(F.collect_list(F.struct("digit", "n"))).alias("digits"))
    joined = state.join(digits, ["anchor", "slot"], "left")
    start = F.struct(F.col("before").alias("c"), F.lit(-1).alias("digit"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.when(acc["digit"] >= 0, acc).when(acc["c"] + x["n"] >= k, F.struct(acc["c"].alias("c"), x["digit"].alias("digit"), x["n"].alias("n"))).otherwise(F.struct((acc["c"] + x["n"]).alias("c"), F.lit(-1).alias("digit"), F.lit(0).cast("long").alias("n")))
    none = F.array().cast("array<struct<digit: int, n: long>>")
    joined = joined.withColumn("at", F.aggregate(F.coalesce("digits", none), start, step))
    hit, by_id = F.col("at.digit") >= 0, F.col("id_shift").isNotNull()
    shift, id_shift = F.greatest(F.col("shift") - DIGIT, F.lit(0)), F.greatest(F.col("id_shift") - DIGIT, F.lit(0))
    bits = (ids[1] + 1 - ids[0]).bit_length()
    few = F.col("at.c") + F.col("at.n") <= GATHER
    placed = lambda base, shift: F.col(base) + F.expr(f"shiftleft(CAST(at.digit AS BIGINT), {shift})")
    turn = hit & ~by_id & (shift == 0) & ~few & F.lit(bits < 62)  # the score is fixed, and too many rows have it
    return joined.select(
        *_WINDOW_COLUMNS,
        F.when(hit & ~by_id, placed("base", f"greatest(shift - {DIGIT}, 0)")).otherwise(F.col("base")).alias("base"),
        F.when(hit & ~by_id, shift).otherwise(F.col("shift")).alias("shift"),
        F.when(turn, F.lit(0).cast("long")).when(hit & by_id, placed("id_base", f"greatest(id_shift - {DIGIT}, 0)")).otherwise(F.col("id_base")).alias("id_base"),
        F.when(turn, F.lit(bits)).when(hit & by_id, id_shift).otherwise(F.col("id_shift")).alias("id_shift"),
        F.col("at.c").alias("before"),
        (~hit | few | (~turn & F.when(by_id, id_shift == 0).otherwise(shift == 0))).alias("over"),
    )


_WINDOW_COLUMNS = _NAMES[:9]


def selected(rows: DataFrame, windows: DataFrame, k: int, same: bool, ids: tuple[int, int], norm: float) -> DataFrame:
    """The first k rows of every window (columns of ``_WINDOW``), of its label or of others: ``FOUND`` and rank.

    ``rows`` has group, row, vec_id, label and vector; ``ids`` are the least and largest id, ``norm`` is the largest squared length.
    """
    spark = rows.sparkSession
    groups = rows.agg(F.max("group")).first()[0] + 1
    exact = "float32" if norm < 1 << 24 else "float64"
    none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in _STATE.split(", ")]
    held = {"anchor": F.col("row").alias("anchor"), "anchor_id": F.col("vec_id").alias("anchor_id"), "label": F.col("label"), "vector": F.col("vector")}
    as_rows = rows.select("group", *[held.get(n, c) for n, c in zip(_NAMES, none)])

    def passed(state: DataFrame, gather: bool) -> DataFrame:
        sent = state.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), *_NAMES)
        dealt = as_rows.unionByName(sent).repartition(groups, "group").sortWithinPartitions(F.col("group"), F.col("shift").asc_nulls_first(), "anchor")
        task = partial(_passed, same=same, ids=ids, exact=exact, k=k, gather=gather)
        return dealt.mapInArrow(task, FOUND if gather else COUNTS)

    width = F.length(F.bin(F.col("high") - F.col("low")))
    state = settle(windows.where("low <= high").select(*_WINDOW_COLUMNS, F.lit(0).cast("long").alias("base"), width.cast("int").alias("shift"), F.lit(None).cast("long").alias("id_base"), F.lit(None).cast("int").alias("id_shift"), F.lit(0).cast("long").alias("before")))
    over, open_ = [], state
    while not open_.isEmpty():
        after = settle(_next(open_, passed(open_, False), k, ids))
        discard(state)
        state, open_ = after, after.where("NOT over").drop("over")
        over.append(settle(after.where("over").drop("over")))
    if not over:
        return spark.createDataFrame([], f"{FOUND}, rank int")
    ended = over[0]
    for more in over[1:]:
        ended = ended.unionAll(more)
    found = settle(passed(ended, True))
    discard(state, *over)
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.col("found_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, group: int = GROUP) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and both scores; ``rows`` as ``quantised`` gives them.

    For every anchor and each of its first ``positives`` rows, the first ``negatives`` rows of other labels
    whose scores are from ``low`` to ``high`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    whole = settle(rows.withColumn("norm", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))
    count, norm, least, most = whole.agg(F.count("*"), F.max("norm"), F.coalesce(F.min("vec_id"), F.lit(0)), F.coalesce(F.max("vec_id"), F.lit(0))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count:
        return spark.createDataFrame([], out)
    if norm >= 1 << 53:
        raise ValueError("scores of 2^53 and more are not exact")
    groups = max(partitions(spark), -(-count // group))
    dealt = settle(whole.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int")))
    discard(whole)
    number = lambda name, kind="long": F.lit(None).cast(kind).alias(name)
    reach = F.ceil(F.sqrt(F.col("norm")) * norm**0.5).cast("long") + 1
    anchors = dealt.where(is_anchor).select(F.col("row").alias("anchor"), F.lit(0).alias("slot"), F.col("vec_id").alias("anchor_id"), number("positive_id"), number("positive_score"), "label", "vector", (-reach).alias("low"), reach.alias("high"))
    near = selected(dealt, anchors, positives, True, (least, most), norm).select("anchor", "anchor_id", F.col("rank").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    of = anchors.select("anchor", "label", "vector")
    top, bottom = F.expr(f"{high} * positive_score div 100"), F.expr(f"({low} * positive_score + 99) div 100")
    windows = near.where("positive_score >= 0").join(of, "anchor").withColumns({"low": bottom, "high": top}).select(*_WINDOW_COLUMNS)
    found = selected(dealt, windows, negatives, False, (least, most), norm)
    return found.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
