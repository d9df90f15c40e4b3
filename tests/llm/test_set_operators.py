"""Hard negatives, the prefix trie and packing, against brute force."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilespark.llm import hard_negatives, packing, prefix_trie
from tilespark.llm.queries import oracle_sql, queries

LAST = 1 << 62  # orders like a null id


def mined(df, **how):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(df, F.col("vec_id"), F.col("embedding"), label)
    return sorted(map(tuple, hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, **how).collect()), key=str)


def mined_plainly(rows, positives=5, negatives=10):
    good = []
    for v, e, label in rows:
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.append((v, [math.floor(256 * x) for x in e], (label + 1) % 10 if v is not None and v % 7 == 0 else label))
    out = []
    for i, (v, e, label) in enumerate(good):
        if v is None or v % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(e, f)), LAST if w is None else w, m) for j, (w, f, m) in enumerate(good) if j != i and len(f) == len(e)]
        for p, p_id, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted((n, n_id) for n, n_id, m in scored if m != label and 30 * -p <= 100 * -n <= 90 * -p)[:negatives]
            out += [(v, None if p_id == LAST else p_id, r, None if n_id == LAST else n_id, -p, -n) for r, (n, n_id) in enumerate(fits, 1)]
    return sorted(out, key=str)


def vector(rng, size=4):
    return [float(np.float32(rng.uniform(-1, 1))) for _ in range(size)]


def mining_cases():
    rng = random.Random(1)
    same = [0.5, 0.25, 0.75, 0.5]
    yield "random", [(i, vector(rng), rng.randrange(10)) for i in range(300)]
    # half of all rows are one vector: the ties at the tenth row go on to the digits of ids
    yield "ties", [(i * 10**9, same if rng.random() < 0.5 else vector(rng), rng.randrange(3)) for i in range(500)]
    odd = [None, [], vector(rng, 3), [None, 1.0, 2.0, 3.0], [math.nan] * 4, [math.inf] * 4]
    mixed = [(rng.choice([None, i, i]), rng.choice([*odd, *[vector(rng)] * 6]), rng.choice([None, 1, 2])) for i in range(300)]
    yield "nulls and repeated rows", mixed + [(0, same, 1)] * 3 + [(7, same, 2)] * 60
    yield "one row", [(0, vector(rng), 1)]
    yield "one label", [(i, vector(rng), 1) for i in range(1, 150)]
    yield "no rows", []


@pytest.mark.parametrize("name, rows", list(mining_cases()))
def test_hard_negatives(spark, name, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(2)
    clash = df.withColumns({c: F.lit("x") for c in ("anchor", "group", "row", "score", "shift")})
    assert mined(clash, group=100) == mined_plainly(rows)


def test_hard_negatives_refuse_inexact_scores(spark):
    with pytest.raises(ValueError):
        mined(spark.createDataFrame([(0, [3.0e5] * 64, 1)], "vec_id long, embedding array<float>, label int"))


def nodes_plainly(rows):
    convs, nodes, kids, leaves, saved, out = {}, {}, {}, {}, {}, []
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = convs.get(c - c % 100, [])[:h] + own[h:]
        for d in range(len(whole[c]) + 1):
            nodes.setdefault(tuple(whole[c][:d]), []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) if below else 1
        saved[k] = sum(saved[x] for x in below) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
        ends = ",".join(map(str, sorted(c for c in nodes[k] if len(whole[c]) == len(k))))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(below), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_cases():
    rng = random.Random(3)
    texts = ["a", "a", "a", "b", "é" * 3000, "", None]
    rows = []
    for c in rng.sample(range(400), 150):
        rows += [(c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in range(rng.choice([1, 1, 2, 4, 7]))]
    yield "ties, nulls and branches", [*rows, (None, 0, "user", "x")]
    yield "repeated rows", [(c, t, "user", "same") for c in range(60) for t in (0, 0, 1)]
    yield "copies", [(c, t, "user", "same" if c % 3 else f"own {c}") for c in range(300) for t in range(3)]
    yield "long", [(c, t, "user", "same" if t < 90 + c % 7 else f"{c}") for c in range(7, 30) for t in range(100)]
    yield "no rows", []


@pytest.mark.parametrize("name, rows", list(trie_cases()))
def test_prefix_trie(spark, name, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(2)
    df = df.withColumns({c: F.lit("x") for c in ("item", "items", "part", "key", "depth")})
    arrays = prefix_trie.branched(prefix_trie.turn_arrays(df))
    want = nodes_plainly(rows)
    for parts in (1, 3, 19):  # open stacks are stitched wherever the parts end
        assert sorted(map(tuple, prefix_trie.trie(arrays, parts).collect()), key=str) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=30), st.lists(st.integers(1, 19), max_size=10))
def test_best_fit(lengths, free):
    lengths = sorted(lengths, reverse=True)
    gaps, offsets, left = packing.best_fit(lengths, free, 20, None)
    now = list(free)
    for length, gap, offset in zip(lengths, gaps, offsets):  # each piece in the smallest gap that takes it
        fits = [f for f in now if f >= length]
        if gap >= len(now):
            assert not fits
            now.append(20)
        else:
            assert now[gap] == min(fits)
        assert offset == 20 - now[gap]
        now[gap] -= length
    assert now == left
    assert packing.best_fit(lengths, free, 20, 0)[0].count(-1) >= sum(length > max(free, default=0) for length in lengths)


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_ids_of_chunks_are_ids_of_texts(vocabulary):
    from tokenizers import Tokenizer

    tokenizer, chunks = Tokenizer.from_file(vocabulary), packing.Chunks(vocabulary)
    rng = random.Random(5)
    bits = ["a", "Éa", "it's", "don't", "x.", "...", "—", ".—", "7", "½", "Ⅷ", "ΑΣ", "İ", "é", "́", "ǆ", "漢字", "한", "<|endoftext|>", "</w>", "a</w>", "'S", " ", "\n", "\t\x0b", "\xa0", " ", "　", "\x1c", "​", "😀", "_", ",;", "ß!?", "Ÿ"]
    texts = ["", " ", "".join(bits), " ".join(bits), *("".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(40))) for _ in range(1500))]
    want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert chunks.of(texts) == want == chunks.of(texts)
    packing.KEPT, kept = 10, packing.KEPT
    try:
        assert packing.Chunks(vocabulary).of(texts) == want
    finally:
        packing.KEPT = kept


def packs(spark, vocabulary, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "kind", "size", "stripe", "piece")})
    return packing.packed(packing.tokenised(df.coalesce(3), vocabulary, how.get("capacity", 4096)), **how).toPandas()


@pytest.mark.parametrize("stripe", [1 << 16, 40])
def test_packed(spark, vocabulary, stripe):
    from tokenizers import Tokenizer

    tokenizer, rng = Tokenizer.from_file(vocabulary), random.Random(2)
    rows = [(i, " ".join(rng.choice(["cat", "house", "extraordinary", "Zyxw."]) for _ in range(rng.choice([0, 1, 5, 20, 40, 90])))) for i in range(400)]
    rows += [(None, None), (None, "two"), (5, rows[5][1]), (7, "again"), (7, "again"), (9, "long text " * 1000), *[(i, "all of these are alike") for i in range(1000, 1200)]]
    out = packs(spark, vocabulary, rows, capacity=64, stripe=stripe)
    want = []
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want += [(doc, i // 64, i, len(ids[i : i + 64]), zlib.crc32(np.array(ids[i : i + 64], "<u4").tobytes())) for i in range(0, len(ids), 64)]
    found = [(None if doc != doc else int(doc), *map(int, rest)) for doc, *rest in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(found, key=str) == sorted(want, key=str)
    for _, sequence in out.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert sequence.offset.tolist() == (sequence.length.cumsum() - sequence.length).tolist() and sequence.length.sum() <= 64
    least = max(-(-out.length.sum() // 64), (out.length > 32).sum())
    assert out.sequence_id.nunique() <= 1.02 * least + 1


def test_packed_nothing(spark, vocabulary):
    assert len(packs(spark, vocabulary, [])) == 0
    assert packs(spark, vocabulary, [(1, None), (2, "")])[["length", "offset"]].values.tolist() in ([[1, 0], [1, 1]], [[1, 1], [1, 0]])


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_prefix_trie"])
def test_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("embeddings", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    ours = queries()[name](spark, "/root/testdata/sf0.001")
    found = db.execute(oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(map(str, ours.select(*names).collect())) == sorted(f"Row({', '.join(f'{n}={v!r}' for n, v in zip(names, row))})" for row in found.fetchall())
