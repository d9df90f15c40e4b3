"""Operators over whole corpora against brute force: mixing, near copies, decontamination, rollups, pipeline."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tilespark.llm import decontaminate, mixing, near_copies, simhash, token_rollup
from tilespark.llm.components import components
from tilespark.llm.queries import oracle_sql, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], SCHEMA)


def test_capped_shares():
    shares = mixing.capped_shares(np.array([5.0, 2, 1]), np.array([100, 100, 100]), 450, 2)
    assert shares.tolist() == [200, 500 / 3, 250 / 3]
    assert mixing.capped_shares(np.array([5.0, 1]), np.array([10, 0]), 15, 2).tolist() == [15, 0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8), st.integers(0, 60))
def test_sainte_lague_is_highest_quotients(weights, seats):
    caps = [7 + i for i in range(len(weights))]
    held = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i, w in enumerate(weights) if w and held[i] < caps[i]]
        if not open_:
            break
        held[max(open_, key=lambda i: (weights[i] / (2 * held[i] + 1), -i))] += 1
    assert mixing.sainte_lague(np.array(weights, float), seats, np.array(caps)).tolist() == held


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 80, 900])), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(400, None, "b"), (401, " \t\n", "b"), (None, "one two", "c"), (5, "again and again", "zz"), (5, "again and again", "zz")]
    table = docs(spark, rows).withColumn("target", F.lit("clash"))
    found = mixing.mix(table)
    assert sorted(mixing.mix(table.repartition(9)).collect(), key=str) == sorted(found.collect(), key=str)
    out = found.toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all() and (out.taken >= 0).all()
    sizes = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, o in rows if o == s) for s in ("a", "b", "c", "zz", None)}
    weights = dict(zip(["a", "b", "c", "zz", None], [5, 2, 1, 5, 2]))
    total, level, capped = 1.5 * sum(sizes.values()), 0.0, set()
    while True:
        level = (total - sum(2 * sizes[s] for s in capped)) / sum(w for s, w in weights.items() if s not in capped)
        more = {s for s in sizes if s not in capped and level * weights[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    for s, size in sizes.items():
        own = out[out.source.isna()] if s is None else out[out.source == s]
        target = 2 * size if s in capped else level * weights[s]
        assert (own.source_size == size).all() and abs(own.target.iloc[0] - target) < 1e-6 * total
        assert abs(own.taken.sum() - target) <= 0.5 + 1e-6
    assert mixing.mix(table.limit(0)).count() == 0
    assert mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)])).agg(F.sum("taken")).first()[0] == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 700), min_size=1, max_size=6), st.floats(0, 2))
def test_quotas_are_blocks_and_one_shortened(words, share):
    wanted = int(share * sum(words))
    out = mixing.quotas(np.array(words), wanted // 64, wanted, 2.0)
    assert out.sum() == wanted and (out >= 0).all() and all(q <= 2 * w for q, w in zip(out, words))
    if min(words) >= 64 and share < 1.5:
        assert sum(q % 64 > 0 for q in out) <= 1


@pytest.mark.parametrize("groups", [1 << 14, 2])
def test_mix_deals_a_hot_source_into_shards(spark, monkeypatch, groups):
    """Shards in groups; what each document gives is the overlap with blocks, worked out word by word."""
    monkeypatch.setattr(mixing, "SHARD_TOKENS", 500)
    monkeypatch.setattr(mixing, "MAX_GROUPS", groups)
    text = "repeat('w ', 10 + cast(id % 97 as int))"
    table = spark.range(600).select(F.col("id").alias("doc_id"), F.expr(text).alias("text"), F.expr("if(id % 3 = 0, 's' || id % 5, 'hot')").alias("source"))
    rows = mixing.mix(table).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 + 1e-6 and own[0].source_size == sum(r.size for r in own)
    # most documents give all of their words as often as the shard is taken, or one block's part more
    assert len({r.taken for r in rows}) > 20


def brute_simhash(text):
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    prints = list(prints)
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_simhash(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 40, 200]))) for _ in range(60)]
    for t in texts[:30]:
        near = t.split()
        near[rng.randrange(len(near))] = "changed"
        texts += [" ".join(near), t.upper(), t]
    texts += [None, "", " \n", "É é", "word " * 30000]
    rng.shuffle(texts)
    found = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    prints = [brute_simhash(t) for t in texts]
    assert [found[i].fp % 2**64 for i in range(len(texts))] == prints
    label = brute_components(prints)
    first = {}
    for i, x in enumerate(label):
        first.setdefault(x, i)
    assert [found[i].component_id for i in range(len(texts))] == [first[x] for x in label]
    kept = simhash.one_of_each(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    assert sorted(r.doc_id for r in kept) == sorted(first.values())


@pytest.mark.parametrize(("cell", "agree"), [(2048, None), (8, None), (2048, 3), (8, 5)])
def test_chains_and_dense_cells(spark, monkeypatch, cell, agree):
    """Fingerprints a few bits apart, in chains and balls, with cells that must be split."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            prints.add(at)
            for _ in range(rng.choice([1, 2, 3, 4])):
                at ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    prints |= {centre ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(12)}
    ordered = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in ordered]
    found = dict(simhash.near_components(spark.createDataFrame([(p,) for p in signed], "fp long"), agree).collect())
    label = brute_components(ordered)
    groups = {}
    for p, x in zip(signed, label):
        groups.setdefault(x, []).append(p)
    for own in groups.values():
        if len(own) > 1:
            assert len({found[p] for p in own}) == 1
    assert len(set(found.values())) == sum(len(g) > 1 for g in groups.values())


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 63, (2, 4000), dtype=np.uint64)
    b[:2000] = a[:2000] ^ (np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64))
    fields = lambda v: np.stack([np.bitwise_count((v >> np.uint64(2 * s)) & np.uint64(3)) for s in range(32)]).astype(int)
    want = np.abs(fields(a) - fields(b)).sum(axis=0)
    assert (simhash.manhattan(simhash.popcounts(a), simhash.popcounts(b)) == want).all() and (want <= np.bitwise_count(a ^ b)).all()


def test_simhash_of_odd_tables(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    rows = docs(spark, [(None, "a b c", "s"), (None, "a b c", "s"), (4, "", "s"), (4, None, "s"), (9, "x y z", "s"), (9, "x y z", "s")]).withColumn("fp", F.lit(1))
    found = simhash.near_duplicates(rows)
    assert {(r.doc_id, r.component_id) for r in found.collect()} == {(None, None), (4, 4), (9, 9)}
    assert [simhash.groups_that_agree(n) for n in (0, 1 << 22, (1 << 22) + 1, 1 << 27, 1 << 28)] == [2, 2, 3, 3, 4]
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 20
    nameless = docs(spark, [(None, near, "s"), (None, near + "end", "s"), (None, "other", "s")])
    assert simhash.one_of_each(nameless).count() == 2  # near copies without ids are one group too
    kept = simhash.one_of_each(rows)
    assert kept.columns == rows.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["4", "9", "None"]


def five_words(text):
    words = re.sub("[A-Z]", lambda m: m.group().lower(), text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize(("stars", "cell"), [(2, 2048), (0, 2048), (1, 3)])
def test_near_dedup_stage_links_by_five_word_likeness(spark, monkeypatch, stars, cell):
    """Chains, sizes and likenesses around 0.8, also where band values are split; the stage keeps one text of each brute-force group."""
    monkeypatch.setattr(near_copies, "STARS", stars)
    monkeypatch.setattr(near_copies, "CELL", cell)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 5, 64, 300]))) for _ in range(40)]
    for t in texts[:]:
        for _ in range(rng.choice([1, 5])):
            own = t.split()
            for _ in range(max(1, len(own) // 64)):
                own[rng.randrange(len(own))] = rng.choice(words)
            t = " ".join(own)
            texts += [t, t.upper()]
    texts += [None, "", " \n"]
    rng.shuffle(texts)
    sets, label = [five_words(t) for t in texts], list(range(len(texts)))
    linked = lambda a, b: a == b or (a & b and len(a & b) >= 0.8 * len(a | b))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and linked(sets[i], sets[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts)])
    kept = corpus_pipeline.near_dedup(spark, table, None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    assert near_copies.near_copies(docs(spark, [])).count() == 0


@pytest.mark.parametrize(("cell", "frequent"), [(2048, 1 << 19), (3, 4)])
def test_near_dedup_stage_links_what_no_band_shows(spark, monkeypatch, cell, frequent):
    """Pairs of likeness 0.8 that share no band, and, without any bands, chains around one text with a common passage, against brute force."""
    texts = []
    for i in (9839, 312629, 380588):
        words = [f"{i}w{j}" for j in range(13)]
        texts += [" ".join(words), " ".join([*words[:-1], "other"])]
        assert not (near_copies.bands(near_copies.shingles(texts[-1])) == near_copies.bands(near_copies.shingles(texts[-2]))).any()
    kept = corpus_pipeline.near_dedup(spark, docs(spark, [(i, t, "s") for i, t in enumerate(texts)]), None)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 4]
    monkeypatch.setattr(near_copies, "CELL", cell)
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    monkeypatch.setattr(near_copies, "bands", lambda own: own[:0].view(np.int64))
    rng = random.Random(11)
    common = " ".join(f"c{i}" for i in range(12))
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.choice([3, 9, 60]))) + " " + common for _ in range(25)]
    for t in texts[:15]:
        for _ in range(6):
            own = t.split()
            own[rng.randrange(len(own))] = f"w{rng.randrange(300)}"
            t = " ".join(own)
            texts.append(t)
    texts += [None, "", texts[3], "one two"]
    rng.shuffle(texts)
    sets, label = [five_words(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    found = near_copies.near_copies(docs(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    assert [r.component_id for r in sorted(found.collect())] == label and 10 < len(set(label)) < len(texts) - 20


def test_links_of_a_cell():
    """A run of near copies of one text, by chunks and whole, against all pairs."""
    rng = np.random.default_rng(3)
    base, sets = rng.integers(0, 1 << 62, 150, dtype=np.uint64), []
    for _ in range(150):
        own = base.copy()
        own[rng.integers(0, 150, rng.integers(0, 40))] = rng.integers(0, 1 << 62, 1, dtype=np.uint64)
        sets.append(np.unique(own[: rng.integers(100, 151)]))
    linked = lambda a, b: len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    node, side = np.arange(150), rng.integers(0, 2, 150)
    for sides in (np.full(150, -1), side):
        label = np.arange(150)
        for i in range(150):
            for j in range(i):
                if label[i] != label[j] and (sides[i] < 0 or sides[i] != sides[j]) and linked(sets[i], sets[j]):
                    label[label == label[j]] = label[i]
        own = np.arange(150)
        for a, b in near_copies.cell_links(node, node, sides, sets, 0.8):
            assert linked(sets[a], sets[b]) and own[a] != own[b]
            own[own == own[b]] = own[a]
        assert len(set(zip(label.tolist(), own.tolist()))) == len(set(label.tolist())) == len(set(own.tolist())) > 1


def test_components(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, 200 + i) for i in range(1, 50)] + [(300, 300), (1, 0), (1, 0)]
    found = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert len({found[i] for i in range(101)}) == 1 and len({found[200 + i] for i in range(50)}) == 1 and found[0] != found[200] and 300 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_contamination(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(own) - n + 1):
            if n and tuple(own[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item_id)
    digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(own)


@pytest.mark.parametrize("slice_words", [1 << 20, 40])
def test_contamination(spark, slice_words):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["é", "über"]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 12, 13, 14, 30, 0])] + [(9, None), (10, "w1 w1 w1 w1"), (11, "W5, w6; w7")]
    texts = []
    for _ in range(80):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40)))]
        for _ in range(rng.randrange(3)):
            item = rng.choice(items)[1] or ""
            parts += [item.upper() if rng.random() < 0.3 else item.replace(" ", "-"), " ".join(rng.choice(words) for _ in range(rng.randrange(60)))]
        texts.append("\n".join(parts))
    texts += [None, "", "w1 " * 5000]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    table = docs(spark, [(i, t, "s") for i, t in enumerate(texts)]).withColumn("spans", F.lit(0))
    found = {r.doc_id: r for r in decontaminate.contamination(table, benchmark, slice_words).collect()}
    for i, t in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_contamination(t, items)
    kept = decontaminate.clean(table, benchmark, slice_words)
    assert kept.columns == table.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.contaminated}


def test_contamination_of_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    table = docs(spark, [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s")])
    assert decontaminate.contamination(table, none).where("NOT contaminated AND n_items = 0").count() == 3
    assert decontaminate.clean(table, none).count() == 3
    one = spark.createDataFrame([(None, "a b"), (7, "c")], "item_id long, text string")
    assert decontaminate.contamination(table, one, 1).where("contaminated AND n_items = 1").count() == 3
    long = spark.createDataFrame([(3, "x " * 3000 + "a b"), (4, "a b"), (4, "a b")], "item_id long, text string")
    assert sorted(r.n_items for r in decontaminate.contamination(table, long, 1).collect()) == [0, 2, 2]
    assert decontaminate.contamination(table.limit(0), one).count() == 0


def test_rollup(spark, tmp_path):
    rollup = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    fields = "op string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long"
    first = spark.createDataFrame([("insert", "a", "en", "t1", 5, *[None] * 4)] * 3 + [("insert", None, None, "t1", 2, *[None] * 4)], fields)
    second = spark.createDataFrame([("delete", "a", "en", "t1", 5, *[None] * 4), ("revise", "b", "en", "t2", 9, "a", "en", "t1", 5)], fields)
    assert rollup.commit("1", first) and not rollup.commit("1", first) and rollup.commit("2", second) and not rollup.commit("2", second)
    want = {("a", "en", "t1", 1, 5), (None, None, "t1", 1, 2), ("b", "en", "t2", 1, 9)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    # an attempt that was written but never marked does not count
    token_rollup.signed(first).withColumn("batch", F.lit("3")).withColumn("attempt", F.lit("lost")).write.parquet(f"{tmp_path}/r/deltas/lost")
    assert {tuple(r) for r in rollup.totals().collect()} == want
    assert rollup.compact() and {tuple(r) for r in rollup.totals().collect()} == want and not rollup.commit("1", first)
    assert rollup.compact() and {tuple(r) for r in rollup.totals().collect()} == want and not rollup.commit("2", second)
    assert rollup.commit("5", first.limit(1)) and rollup.commit("none", first.limit(0))
    assert {tuple(r) for r in rollup.totals().collect()} == {("a", "en", "t1", 2, 10), *[w for w in want if w[0] != "a"]}
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit("4", first.withColumn("op", F.lit(None).cast("string")))


FIELDS = "op string, source string, lang string, tokenizer string, tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long"


@pytest.mark.parametrize("step", ["rows", "publish", "meanwhile", "rival"])
def test_rollup_compaction_that_is_cut_short_or_overtaken(spark, tmp_path, monkeypatch, step):
    """A crash before the rows or before the manifest, a batch that commits meanwhile, and a second compaction."""
    changes = spark.createDataFrame([("insert", "a", "en", "t1", 5, *[None] * 4)] * 2, FIELDS)
    rollup, other = (token_rollup.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    assert rollup.compact() and rollup.totals().count() == 0  # nothing yet
    rollup.commit("1", changes)
    total = lambda: [(r.docs, r.tokens) for r in token_rollup.Rollup(spark, f"file://{tmp_path}/r").totals().collect()]
    real_sum, real_publish = token_rollup.Rollup._sum, token_rollup.Rollup._publish

    def stop(*_):
        raise RuntimeError("lost")

    def before_publish(self, text, name):
        if self is rollup and step == "meanwhile":
            other.commit("2", changes)
        if self is rollup and step == "rival":
            other.compact()
        return real_publish(self, text, name)

    with monkeypatch.context() as m:
        m.setattr(token_rollup.Rollup, "_sum" if step == "rows" else "_publish", stop if step in ("rows", "publish") else before_publish)
        if step in ("rows", "publish"):
            with pytest.raises(RuntimeError):
                rollup.compact()
        else:
            assert rollup.compact() == (step == "meanwhile")
    assert token_rollup.Rollup._sum is real_sum
    assert total() == [(4, 20)] if step == "meanwhile" else total() == [(2, 10)]
    rollup.compact()
    assert not rollup.commit("1", changes) and total() == ([(4, 20)] if step == "meanwhile" else [(2, 10)])


def test_byte_pair_counts(spark, tmp_path):
    import base64

    lines = [f"{base64.b64encode(bytes([i])).decode()} {i}" for i in range(256)] + [f"{base64.b64encode(b'ab').decode()} 256"]
    (tmp_path / "ranks").write_text("\n".join(lines))
    rows = token_rollup.bpe_counts(docs(spark, [(1, "abab c", "s"), (2, None, "s"), (3, "é", "s")]).withColumn("Tokens", F.lit("clash")), f"file://{tmp_path}/ranks", r"\S+|\s+")
    assert [r.tokens for r in rows.orderBy("doc_id").collect()] == [4, 0, 2]


SF = "/root/testdata/sf0.001"


def test_queries_against_sql(spark):
    import duckdb

    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in oracle_sql().items():
        ours = queries()[name](spark, SF)
        theirs = db.execute(sql).fetch_arrow_table() if hasattr(db, "fetch_arrow_table") else None
        columns = sorted(ours.columns)
        want = sorted(map(str, (tuple(r[c] for c in columns) for r in (theirs.to_pylist() if theirs is not None else db.execute(sql).df().to_dict("records")))))
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in ours.collect()))) == want


def test_stages_on_odd_tables(spark):
    """Nulls everywhere, blank and very long texts, repeated rows, extra columns with clashing names, no rows."""
    rows = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (None, None, None, None, None), (2, "", "en", "s", 0), (3, "word and " * 40000, "en", None, 9), (4, "x y z", "en", "t", 5), (4, "x y z", "en", "t", 5)]
    odd = spark.createDataFrame(rows, SCHEMA)
    for c in ("Score", "score ", "TEXT_HASH", "size", "fp", "component_id", "kept_id", "kept doc_id", "row number", "spans", "row", "taken", "target", "part", "n_date"):
        odd = odd.withColumn(c, F.lit("clash"))
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SF)
            assert out.count() <= len(rows)
            if name != "source mix":
                assert out.columns == table.columns and out.where("Score <> 'clash' OR part <> 'clash' OR `row number` <> 'clash'").isEmpty()


def test_pipeline(spark):
    """Each stage on what the stage before it kept, against brute force where there is one."""
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs_, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs_ = stage(spark, docs_, SF)
        if name != "source mix":
            assert docs_.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({r.doc_id: r for r in docs_.collect()})
    good, single, clean, hidden, mixed = kept
    assert good.keys() <= rows.keys() and len(good) >= 0.8 * len(rows)
    ids = sorted(good)
    sets, label = [five_words(rows[i].text) for i in ids], list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and (sets[i] == sets[j] or both and both >= 0.8 * len(sets[i] | sets[j])):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert set(single) == {min(i for i, x in zip(ids, label) if x == own) for own in set(label)}
    assert set(clean) == {i for i in single if not brute_contamination(rows[i].text, items)[4]}
    assert set(hidden) == set(clean) == set(mixed)
    assert not any(m in r.text for i, r in hidden.items() for m in re.findall(r"\S+@\S+\.com|\(\d{3}\) \d{3}-\d{4}", rows[i].text))
    assert sorted(corpus_pipeline.run(spark, SF).collect()) == sorted(mixed.values())
