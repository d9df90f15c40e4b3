"""The prefix trie of conversations, from one global sort.

A turn becomes ``ITEM`` bytes, a digest of its role and text and the length of its text, and a
conversation the bytes of its turns, so the order of the bytes is an order of
conversations in which those that begin alike stand together. They are range-sorted, equal ones by id, so
a hot group of copies is many parts. In that order a trie node is an interval, and the common prefix of
each conversation with the one before it says which nodes end and begin there: a stack
sweep of each part makes its nodes. A node is known by what its conversations
have in common, so its counts are sums over them, and bubble up when a node is closed.

What stands on the stack at a part's ends, no deeper than the common prefix with the part beside it,
goes on there. Of those nodes the sweeps give fragments, named by depth and by the part
where the node begins, which follows from two numbers a part. Fragments are sent together in order of
parts and summed; node and fragment counts are sums, so nothing else is stitched.

Texts are read once and never shuffled, but for the turns of conversations in which different
turns have one number; a part holds its nodes' numbers, and the ids of copies, in memory.

Defined cases: turns are ordered by number (null first), role and text; null role and text are empty;
repeated rows are turns of their own; rows of a null conversation take no part; very long
texts are read whole; no rows give no nodes, not even the root; columns that are not
named here are never read. Digests have 128 bits; turns that share one count as equal.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import discard, partitions, settle

ITEM = 20
#: Turns of one part, as far as whole conversations go.
PART = 1 << 17
#: Fragments whose parents' ids are broadcast: at most a few megabytes.
SMALL = 1 << 17
_COUNTS = "n_convs long, n_children long, n_leaves long, saved_tokens long"
NODES = f"conv_id long, depth long, parent_conv_id long, {_COUNTS}, ends_sha256 string"
_SWEPT = f"conv_id long, depth long, parent_conv_id long, {_COUNTS}, ends string, start int, parent_start int, part int"
_STITCHED = f"conv_id long, depth long, parent_conv_id long, {_COUNTS}, ends string, start int, parent_start int"


def turn_arrays(conversations: DataFrame) -> DataFrame:
    """(conv_id, items) of every conversation, its turns in order."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    item = F.concat(F.substring(F.unhex(F.sha2(said, 256)), 1, 16), F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), item.alias("item"))

    def arrays(turns: DataFrame) -> DataFrame:
        return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "item"))).alias("turns"))

    made = settle(arrays(rows))
    places = F.sequence(F.lit(1), F.size("turns") - 1)
    a, b = (lambda i: F.col("turns")[i - 1]), (lambda i: F.col("turns")[i])
    tied = (F.size("turns") > 1) & F.exists(places, lambda i: a(i)["turn"].eqNullSafe(b(i)["turn"]) & (a(i)["item"] != b(i)["item"]))
    ties = made.where(tied).select(F.col("conv_id").alias("tied"))
    if not ties.isEmpty():  # only there does the order ask for role and text
        order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
        numbered = rows.join(ties, rows["conv_id"] == ties["tied"], "left_semi").withColumn("turn", F.row_number().over(order))
        made = made.where(~tied).unionAll(arrays(numbered.withColumn("turn", F.col("turn").cast("long"))))
    return made.select("conv_id", F.transform("turns", lambda t: t["item"]).alias("items"))


def branched(arrays: DataFrame) -> DataFrame:
    """Conversations rebuilt: the first turns of the conversation that heads its hundred, then its own after as many."""
    heads = arrays.where("conv_id % 100 = 0").select(F.col("conv_id").alias("head"), F.slice("items", 1, 5).alias("first"))
    own = arrays.withColumn("head", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"))
    rest = F.slice("items", F.col("h") + 1, F.size("items"))
    shared = F.slice(F.coalesce("first", F.array().cast("array<binary>")), 1, F.col("h"))
    return own.join(heads, "head", "left").select("conv_id", F.concat(shared, rest).alias("items"))


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two conversations have in common at their start."""
    low, high = 0, min(len(a), len(b)) // ITEM
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * ITEM : mid * ITEM] == b[low * ITEM : mid * ITEM]:
            low = mid
        else:
            high = mid - 1
    return low


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Turns that a part has in common with the part before it, and those that all of it has in common."""
    for batch in batches:
        before, first, last = (batch.column(c).to_pylist() for c in ("before", "first", "last"))
        shared = [-1 if a is None else common_turns(a, b) for a, b in zip(before, first)]
        yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(shared, pa.int32()), pa.array(map(common_turns, first, last), pa.int32())], ["part", "shared", "through"])


class Sweep:
    """The stack of one part, and the rows that it gives."""

    def __init__(self, number: int, at: int, seams: list[int], through: list[int], root: int) -> None:
        self.number, self.root = number, root
        self.left, self.right = seams[at], seams[at + 1] if at + 1 < len(seams) else -1
        self.starts, first = [], at - 1  # of each depth that goes on from the part before: where it begins
        for depth in range(self.left, -1, -1):
            while seams[first] >= depth and through[first] >= depth:
                first -= 1
            self.starts.append(first)
        self.starts.reverse()
        self.at, self.key, self.stack = at, b"", []
        self.rows: dict[str, list | array] = {c: array("q") for c in ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "parent", "node")} | {c: [] for c in ("ends", "start", "parent_start")}
        self.conv_of: dict[int, int] = {}
        self.nodes = 0

    def _goes_on(self, node: int) -> bool:
        """Whether a node came from the part before: those are pushed first."""
        return node <= self.left + 1

    def _start(self, node: int, depth: int) -> int:
        return self.starts[depth] if self._goes_on(node) else self.at

    def _push(self, size: int) -> None:
        self.nodes += 1
        # number, size, smallest member, members, children, leaves, saved, ids that end here
        self.stack.append([self.nodes, size, None, 0, 0, 0, 0, []])

    def _pop(self, open_right: bool) -> None:
        node, size, conv, n, children, leaves, saved, ends = self.stack.pop()
        depth, rows = len(self.stack), self.rows
        goes_on = self._goes_on(node)
        leaves += not children and not open_right and not (goes_on and depth < self.left)
        saved += (n - (not goes_on)) * size
        above = self.stack[-1] if self.stack else None
        if above:
            above[2] = conv if above[2] is None else min(above[2], conv)
            above[3] += n
            above[5] += leaves
            above[6] += saved
        for name, value in (("conv_id", conv), ("depth", depth), ("n_convs", n), ("n_children", children), ("n_leaves", leaves), ("saved_tokens", saved), ("parent", above[0] if above else 0), ("node", node)):
            rows[name].append(value)
        ids = ",".join(map(str, ends))
        if open_right or goes_on:
            rows["ends"].append(ids)
            rows["start"].append(self._start(node, depth))
        else:
            self.conv_of[node] = conv
            rows["ends"].append(hashlib.sha256(ids.encode()).hexdigest())
            rows["start"].append(None)
        # a parent is known by its start where it goes on beyond this part
        rows["parent_start"].append(self._start(above[0], depth - 1) if above else None)

    def add(self, key: bytes, conv: int) -> None:
        length = len(key) // ITEM
        if self.stack:
            shared = common_turns(self.key, key)
            while len(self.stack) - 1 > shared:
                self._pop(False)
        else:
            shared = self.left
            for depth in range(shared + 1):
                self._push(self._size(key, depth))
        for depth in range(shared + 1, length + 1):
            if depth:
                self.stack[-1][4] += 1
            self._push(self._size(key, depth))
        top = self.stack[-1]
        top[2] = conv if top[2] is None else min(top[2], conv)
        top[3] += 1
        top[7].append(conv)
        self.key = key

    @staticmethod
    def _size(key: bytes, depth: int) -> int:
        return int.from_bytes(key[depth * ITEM - 4 : depth * ITEM], "big") if depth else 0

    def close(self) -> pa.RecordBatch:
        while self.stack:
            self._pop(len(self.stack) - 1 <= self.right)
        rows = self.rows
        conv_of, depths = self.conv_of, rows["depth"]
        above = [self.root if d == 1 else conv_of.get(p) for p, d in zip(rows["parent"], depths)]
        starts = [None if a is not None else s for a, s in zip(above, rows["parent_start"])]
        numbers = [pa.array(rows[c], pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
        columns = [pa.array(rows["conv_id"], pa.int64()), pa.array(depths, pa.int64()), pa.array(above, pa.int64()), *numbers, pa.array(rows["ends"], pa.string()), pa.array(rows["start"], pa.int32()), pa.array(starts, pa.int32()), pa.array([self.number] * len(starts), pa.int32())]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SWEPT.split(", ")])


def _sweeps(batches: Iterator[pa.RecordBatch], parts: list[int], seams: list[int], through: list[int], root: int) -> Iterable[pa.RecordBatch]:
    places, sweep = {part: i for i, part in enumerate(parts)}, None
    for batch in batches:
        for part, key, conv in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "conv_id"))):
            if sweep is None or sweep.number != part:
                if sweep is not None:
                    yield sweep.close()
                sweep = Sweep(part, places[part], seams, through, root)
            sweep.add(key, conv)
    if sweep is not None:
        yield sweep.close()


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Fragments, sorted by depth, start and part: their sums, and the digest of the ids that end there."""
    names = [c.split()[0] for c in _STITCHED.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.int32(), pa.int32()]
    done: list[tuple] = []
    node = ends = None

    def flush() -> pa.RecordBatch:
        columns = list(zip(*done)) or [[]] * len(names)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def close() -> None:
        if node is not None:
            done.append((*node[:7], ends.hexdigest(), *node[8:]))

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            ids = row[7].encode()
            if node is None or (node[1], node[8]) != (row[1], row[8]):
                close()
                node, ends, begun = list(row), hashlib.sha256(ids), bool(ids)
                continue
            node[0] = min(node[0], row[0])
            for i in range(3, 7):
                node[i] += row[i]
            if ids:
                ends.update(b"," + ids if begun else ids)
                begun = True
        if len(done) > 10_000:
            yield flush()
    close()
    yield flush()


def trie(arrays: DataFrame, parts: int | None = None) -> DataFrame:
    """The nodes of the trie of ``arrays`` (conv_id, items), the textless root among them."""
    spark = arrays.sparkSession
    joined = F.unhex(F.array_join(F.transform("items", F.hex), ""))
    rows = settle(arrays.select("conv_id", joined.alias("key")))
    size, root = rows.agg(F.sum(F.length("key")), F.min("conv_id")).first()
    if root is None:
        return spark.createDataFrame([], NODES)
    parts = parts or max(partitions(spark), -(-size // (ITEM * PART)))
    placed = settle(rows.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("part", F.spark_partition_id()))
    discard(rows)
    ends = placed.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    beside = ends.select("part", "first", "last", F.lag("last").over(Window.orderBy("part")).alias("before"))
    found = sorted(map(tuple, beside.mapInArrow(_seams, "part int, shared int, through int").collect()))  # two numbers a part
    numbers, seams, through = map(list, zip(*found))
    sweep = partial(_sweeps, parts=numbers, seams=seams, through=through, root=root)
    swept = settle(placed.repartition(parts, "part").sortWithinPartitions("part", "key", "conv_id").mapInArrow(sweep, _SWEPT))
    discard(placed)
    fragments = swept.where("start is not null").repartition(partitions(spark), "depth", "start").sortWithinPartitions("depth", "start", "part")
    stitched = settle(fragments.mapInArrow(_stitch, _STITCHED))
    nodes = swept.where("start is null").drop("part").unionByName(stitched)
    above = stitched.select((F.col("depth") + 1).alias("of_depth"), F.col("start").alias("of_start"), F.col("conv_id").alias("above"))
    if sum(seams) + len(seams) <= SMALL:
        above = F.broadcast(above)
    nodes = nodes.join(above, (nodes["depth"] == above["of_depth"]) & (nodes["parent_start"] == above["of_start"]), "left")
    return nodes.select("conv_id", "depth", F.coalesce("parent_conv_id", "above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
