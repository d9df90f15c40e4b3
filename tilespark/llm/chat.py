"""Chat formatting in budgeted windows.

A conversation's rows come in order of turn; a running sum of turn tokens cuts them
into spans of whole turns that fit the budget together with the system turn and the
history. Less history is repeated where the next turn needs the room; a window is over the
budget only if the system turn and one turn alone are.
Each window holds the system turn, a limited history of the turns before its span, and
the span. Loss is on the assistant texts of the span only; the system turn and the
history are repeated context and are masked.

A turn is written ``<|turn 7 assistant|>text<|end|>`` and a newline. Control strings
inside texts (these marks, and the common ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``,
``<<SYS>>``, ``<</SYS>>``) get a backslash after their first character, one more if
backslashes already stand there, so undoing it gives the text back exactly. Roles are
percent-encoded.

Where windows begin depends on all turns before, but only on their numbers of tokens: these
are sorted by conversation and streamed, a row of a few numbers a turn, and say of every turn which window it is
new in and which repeat it. Then the texts are dealt out by window, so a conversation that holds a third of all rows
is as many groups as it has windows, and a task holds one window at a time. Windows do not depend on how rows
are dealt, nor on the turns' own numbers but for their order. ``read_back``, which digests conversations
whole, streams the windows of one through one task, as a digest must.

Defined cases: null text and null role are empty; turns are numbered by their place,
so gaps, ties (broken by role and text) and null turns (first) do no harm; only a
``system`` row that comes first is the system turn; rows with a null conversation are one
conversation; very long texts are windows of their own, whole; repeated rows are turns of
their own; an empty table gives no windows; columns that are not named here are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby, islice
from operator import itemgetter
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import partitions, settle

#: Tokens of a window, and of the history that it repeats (words, and four for a turn's marks).
BUDGET, HISTORY = 1024, 128
_CONTROL = r"(?=\||/?s>|<SYS>>|</SYS>>|/?INST\])"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _CONTROL)
_TURN = re.compile(r"<\|turn (\d+) ([^|]*)\|>(.*?)<\|end\|>\n", re.S)
WINDOWS = "conv_id long, window long, formatted string, loss_starts array<long>, loss_ends array<long>"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def tokens(text: str) -> int:
    return 4 + len(text.split())


def render(turns: list[tuple[int, str, str]], first_new: int) -> tuple[str, list[int], list[int]]:
    """The formatted window and the starts and ends of its loss; turns before ``first_new`` are masked."""
    parts, starts, ends, size = [], [], [], 0
    for number, role, text in turns:
        head, body = f"<|turn {number} {quote(role, safe='')}|>", escape(text)
        if role == "assistant" and number >= first_new:
            starts.append(size + len(head))
            ends.append(size + len(head) + len(body))
        parts += [head, body, "<|end|>\n"]
        size += len(head) + len(body) + len("<|end|>\n")
    return "".join(parts), starts, ends


def windows(rows: Iterable[tuple], budget: int, history: int) -> Iterator[tuple]:
    """Of turns (conversation, row, tokens, whether its role is system) in their order: conversation, window, place and row of every turn of every window.

    A window is numbered by the first turn that is new in it. Before its new turns it has the system turn and the longest
    history, without the system turn, that neither ``history`` nor the room beside the first new turn forbids.
    """
    at: object = rows  # no conversation
    for conv, row, size, is_system in rows:
        if conv != at:
            at, place, first, used, kept, tail, held = conv, 0, 0, 0, None, deque(), 0
            if is_system:
                kept = (row, size)
        if place > first and used + size > budget:
            first, used = place, 0
            if kept:
                yield conv, first, 0, kept[0]
                used = kept[1]
            # history goes before the budget does
            room = min(history, budget - used - size)
            repeated = []
            for old in reversed(tail):
                room -= old[2]
                if room < 0:
                    break
                repeated.append(old)
            for old_place, old_row, old_size in repeated:
                yield conv, first, old_place, old_row
                used += old_size
        yield conv, first, place, row
        used += size
        if place or not kept:
            tail.append((place, row, size))
            held += size
        while held > history:
            held -= tail.popleft()[2]
        place += 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        sizes = pa.array([tokens(t) for t in batch.column("text").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns, sizes], [*batch.schema.names, "tokens"])


def _in_order(turns: DataFrame) -> DataFrame:
    """``turns`` without their texts, with ``tie``: the place among rows of one conversation and turn, by role and text."""
    plain = turns.select("conv_id", "turn", "row", "tokens", (F.col("role") == "system").alias("is_system"))
    twice = turns.groupBy("conv_id", "turn").count().where("count > 1").select(F.col("conv_id").alias("of_conv"), F.col("turn").alias("of_turn"))
    if twice.isEmpty():
        return plain.withColumn("tie", F.lit(0))
    tied = turns.join(twice, turns["conv_id"].eqNullSafe(twice["of_conv"]) & turns["turn"].eqNullSafe(twice["of_turn"]), "left_semi")
    ranked = tied.select(F.col("row").alias("of"), F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")).alias("tie"))
    return plain.join(ranked, plain["row"] == ranked["of"], "left").drop("of").withColumn("tie", F.coalesce("tie", F.lit(0)))


def formatted(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row a window: conv_id, window, formatted, loss_starts and loss_ends (code points)."""
    count = partitions(conversations.sparkSession)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "row", "tokens", "is_system"))))
        for some in iter(lambda found=windows(rows, budget, history): list(islice(found, 10_000)), []):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some)], ["conv_id", "window", "place", "row"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names, out, size = ["conv_id", "window", "formatted", "loss_starts", "loss_ends"], [], 0
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "window", "place", "role", "text"))))
        for (conv, window), turns in groupby(rows, key=itemgetter(0, 1)):
            out.append((conv, window, *render([t[2:] for t in turns], window)))
            size += len(out[-1][2])
            if len(out) >= 1000 or size > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    numbered = turns.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_counted, "conv_id long, turn long, role string, text string, row long, tokens long")
    turns = settle(numbered)
    ordered = _in_order(turns).repartition(count, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "tie")
    wanted = ordered.mapInArrow(assigned, "conv_id long, window long, place long, row long").withColumnRenamed("row", "of")
    dealt = turns.select("row", "role", "text").join(wanted, F.col("row") == F.col("of"))
    rows = dealt.select("conv_id", "window", "place", "role", "text").repartition(count, "conv_id", "window")
    return rows.sortWithinPartitions("conv_id", "window", "place").mapInArrow(made, WINDOWS)


def read_back(formatted_windows: DataFrame) -> DataFrame:
    """Digests of turns and loss of every conversation, parsed from its windows in their order."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        out: list[tuple] = []
        state: list | None = None

        def close() -> None:
            if state is not None:
                conv, n, turns, chars, loss, size = state
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends"))):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for number, role, body in _TURN.findall(text):
                    if int(number) == state[1]:
                        state[1] += 1
                        state[2].update(f"{unquote(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                for start, end in zip(starts, ends):
                    plain = unescape(text[start:end])
                    state[3] += len(plain)
                    state[4].update(plain.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            yield flush()
        close()
        yield flush()

    ordered = formatted_windows.repartition(partitions(formatted_windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(digested, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
