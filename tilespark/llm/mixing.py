"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks.

The corpus is cut into shards, hash slices of one source of about ``SHARD_TOKENS``
words each, so a source that holds a third of all rows is many shards. In a shard
the documents stand in seeded order as one stream of words, and the stream is cut
into blocks of ``BLOCK_TOKENS`` words that may begin and end inside documents. Block
quotas go to sources, then to groups of shards of each source, then to the shards of each
group, by highest quotients ``weight / (2 * seats + 1)``; one block of each source is
shortened, or a shortened one added, so that its words are its target. A shard
whose quota is ``q`` of its ``n`` words takes its whole stream ``q // n`` times, and
``q % n`` words once more: blocks spread evenly from a seeded start, and the rest at the
end of the stream and the beginning of a block that was not chosen. What a document
contributes is then a difference of two closed forms of its first and last position in
the stream, so no block is ever a row.

Sources and groups, of which there are at most ``MAX_GROUPS`` besides one a source, are
apportioned on the driver; shards, whose size does not grow with the corpus, in tasks, a
group each.

Defined cases: a null or blank text has size 0 and is never taken; null sources are
one source, after all others; rows with equal ids are rows of their own, and rows that are
equal throughout stand side by side in one shard; very long texts are parts of several
blocks like any other words; an empty corpus gives an empty mix; columns of the input
other than ``doc_id``, ``text`` and ``source``, whatever their names, are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilespark.llm.common import SPACE_WORD, discard, settle

SHARD_TOKENS = 1 << 16
#: At most so many groups of shards besides one a source: their totals are what the driver apportions.
MAX_GROUPS = 1 << 14
#: More sources than this are refused before anything is collected.
MAX_SOURCES = 1 << 18
BLOCK_TOKENS = 64
SEED = 17


def capped_shares(weights: np.ndarray, sizes: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` in proportion to ``weights``, none above ``most`` times its size."""
    caps, shares = most * sizes, np.zeros(len(sizes))
    free = np.ones(len(sizes), bool)
    while free.any():
        left = max(total - caps[~free].sum(), 0.0)
        shares = np.where(free, left * weights / weights[free].sum(), caps)
        over = free & (shares > caps)
        if not over.any():
            break
        free &= ~over
        shares = np.minimum(shares, caps)
    return shares


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients ``weight / (2 * held + 1)``, at most ``caps``; ties go to the earlier.

    Bisection finds a divisor that hands out just under ``seats``, and a heap of
    quotients the few that remain.
    """
    weights, caps = np.asarray(weights, float), np.asarray(caps, np.int64)
    seats = int(min(seats, caps[weights > 0].sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)
    held = lambda d: np.minimum(caps, np.floor(weights / d + 0.5)).astype(np.int64)
    low, high = weights[weights > 0].min() / (4.0 * seats + 4), 2.1 * weights.max()
    for _ in range(200):
        middle = (low + high) / 2
        if held(middle).sum() > seats:
            low = middle
        else:
            high = middle
    out = held(high * (1 + 1e-9))  # so that no rounding parts quotients that are equal
    heap = [(-w / (2 * q + 1), i) for i, (w, q, c) in enumerate(zip(weights, out, caps)) if w > 0 and q < c]
    heapq.heapify(heap)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(heap)
        out[i] += 1
        if out[i] < caps[i]:
            heapq.heappush(heap, (-weights[i] / (2 * out[i] + 1), i))
    return out


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and a hash that orders rows of equal ids."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_hash"))


def quotas(words: np.ndarray, blocks: int, wanted: int, most: float, block: int = BLOCK_TOKENS) -> np.ndarray:
    """``wanted`` words from streams of so many ``words``: so many blocks by highest quotients, one of them shortened, or a shortened one added."""
    words = np.asarray(words, np.int64)
    caps = np.floor(most * words).astype(np.int64)
    wanted = int(min(wanted, caps.sum()))
    out = block * sainte_lague(words, blocks, caps // block)
    rest = wanted - int(out.sum())
    # less than a block, unless streams are shorter than one
    for i in np.argsort(-(caps - out) if rest > 0 else -out, kind="stable").tolist():
        step = min(rest, int(caps[i] - out[i])) if rest > 0 else max(rest, -int(out[i]))
        out[i] += step
        rest -= step
        if not rest:
            break
    return out


def _shard_quotas(shards: pd.DataFrame, most: float) -> pd.DataFrame:
    """The shards of one group with their quotas."""
    shards = shards.sort_values("shard")
    return shards.assign(quota=quotas(shards["tokens"].to_numpy(), int(shards["wanted"].iloc[0]) // BLOCK_TOKENS, int(shards["wanted"].iloc[0]), most))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken, source.

    Sources in code-point order, null last, weigh ``weights``, repeating.
    """
    spark = docs.sparkSession
    rows = settle(sized(docs))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if (found := totals.count()) > MAX_SOURCES:
        raise ValueError(f"{found} sources; at most {MAX_SOURCES} can be weighed, so group them first")
    sources = totals.orderBy(F.col("source").asc_nulls_last()).toPandas()
    sizes = sources["source_size"].to_numpy(np.int64)
    all_tokens = int(sizes.sum())
    targets = capped_shares(np.resize(np.asarray(weights, float), len(sizes)), sizes, share * all_tokens, most) if all_tokens else np.zeros(len(sizes))
    shards = np.maximum(1, -(-sizes // SHARD_TOKENS))
    in_group = max(1, -(-int(shards.sum()) // MAX_GROUPS))
    sources = sources.assign(source_no=np.arange(len(sizes)), shards=shards, groups=-(-shards // in_group), target=targets)
    by_source = spark.createDataFrame(
        [(None if pd.isna(r.source) else r.source, int(r.source_size), int(r.source_no), int(r.shards), int(r.groups), float(r.target)) for r in sources.itertuples()],
        "source string, source_size long, source_no int, shards long, groups long, target double",
    )
    dealt = (
        rows.join(F.broadcast(by_source), rows["source"].eqNullSafe(by_source["source"]))
        .drop(by_source["source"])
        .withColumn("order_hash", F.xxhash64(F.lit(seed), "doc_id", "text_hash"))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(~seed), "order_hash"), F.col("shards")))
        .withColumn("group", F.pmod("shard", "groups"))
    )
    held = settle(dealt.groupBy("source_no", "group", "shard").agg(F.sum("size").alias("tokens")).where("tokens > 0"))
    groups = held.groupBy("source_no", "group").agg(F.sum("tokens").alias("tokens")).orderBy("source_no", "group").toPandas()
    own_words, of = groups["tokens"].to_numpy(np.int64), groups["source_no"].to_numpy()
    words = np.rint(targets).astype(np.int64)
    blocks_of = sainte_lague(targets, round(targets.sum() / BLOCK_TOKENS), np.ceil(targets / BLOCK_TOKENS).astype(np.int64))
    ends = np.searchsorted(of, np.arange(len(sizes) + 1))
    wanted = np.concatenate([quotas(own_words[a:b], int(k), int(w), most) for a, b, k, w in zip(ends[:-1], ends[1:], blocks_of, words)] or [np.zeros(0, np.int64)])
    by_group = spark.createDataFrame([(int(a), int(b), int(w)) for a, b, w in zip(of, groups["group"], wanted)], "source_no int, group long, wanted long")
    apportioned = held.join(F.broadcast(by_group), ["source_no", "group"]).groupBy("source_no", "group").applyInPandas(lambda x: _shard_quotas(x, most), "source_no int, group long, shard long, tokens long, wanted long, quota long")
    block, n = F.lit(BLOCK_TOKENS), F.col("tokens")
    plan = (
        apportioned.withColumn("blocks", F.floor(n / block))
        .withColumn("passes", F.floor(F.col("quota") / n))
        .withColumn("extra", F.least(F.floor(F.pmod("quota", "tokens") / block), "blocks"))
        .withColumn("rest", F.pmod("quota", "tokens") - F.col("extra") * block)
        .withColumn("tail", F.least("rest", F.pmod(n, block)))
        # the start leaves the first block out, for the rest of the rest
        .withColumn("start", F.pmod(F.xxhash64(F.lit(seed), "source_no", "shard"), F.greatest(F.col("blocks") - F.col("extra"), F.lit(1))))
    )
    plan = settle(plan.select("source_no", "shard", "blocks", "passes", "extra", "tail", (F.col("rest") - F.col("tail")).alias("head"), "start"))
    ordered = Window.partitionBy("source_no", "shard").orderBy("order_hash", "doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, 0)

    def extra_before(position):
        """Words before a position of the stream that are taken once more."""
        full = F.least(F.floor(position / block), F.col("blocks"))
        inside = position - full * block
        count = lambda k: F.when(F.col("blocks") == 0, F.lit(0)).otherwise(F.floor((k * F.col("extra") + F.col("start")).cast("decimal(38,0)") / F.col("blocks")))
        chosen = F.when(full < F.col("blocks"), inside * (count(full + 1) - count(full))).otherwise(F.least(inside, F.col("tail")))
        return block * count(full) + chosen + F.least(position, F.col("head"))

    taken = F.col("passes") * F.col("size") + extra_before(F.col("end")) - extra_before(F.col("end") - F.col("size"))
    out = dealt.withColumn("end", F.sum("size").over(ordered)).join(plan, ["source_no", "shard"], "left").withColumn("taken", F.when(F.col("size") == 0, F.lit(0)).otherwise(taken))
    discard(held)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), rows["source"].alias("source"))
