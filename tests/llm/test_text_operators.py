"""Operators on single texts: fingerprints, classifiers, licences, personal data, chat."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tilespark.llm import chat, edit_embedding, license_scan, pii, quality, toxicity
from tilespark.llm import labelled as labelled_module

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"


def docs(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, None, None, 0.5) for i, t in zip(ids, texts)], DOCS)


def test_edit_fingerprints(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdefghij klm é🙂") for _ in range(rng.choice([0, 1, 2, 3, 50, 400, 3000]))) for _ in range(60)] + [None, "", "same text " * 30, "same text " * 30]
    ids = list(range(0, 3 * len(texts), 3))
    found = edit_embedding.edit_fingerprints(docs(spark, texts, ids).orderBy(F.rand(3))).collect()
    assert len(found) == len(texts)
    plain = [t or "" for t in texts]
    by_id = {r.doc_id: r for r in found}
    for k, i in enumerate(ids):
        text, after, r = plain[k], plain[(k + 1) % len(plain)], by_id[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        walker_print = by_id[i].fingerprint
        assert abs(r.near_next - edit_embedding.likeness(walker_print, by_id[ids[(k + 1) % len(ids)]].fingerprint)) < 1e-12
        assert r.edited_candidate == edit_embedding.share_band(r.fingerprint, r.edited_fingerprint) and (r.fingerprint != r.edited_fingerprint or r.edited_candidate)
        assert 0 <= r.near_edited <= 1 and (edited != text or r.near_edited == 1)
    assert by_id[ids[-1]].fingerprint == by_id[ids[-2]].fingerprint and by_id[ids[-2]].near_next == 1


def test_edit_fingerprints_of_odd_tables(spark):
    assert edit_embedding.edit_fingerprints(docs(spark, [])).count() == 0
    alone = edit_embedding.edit_fingerprints(docs(spark, ["abcdef"])).first()
    assert alone.near_next == 1 and alone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    mixed = edit_embedding.edit_fingerprints(docs(spark, ["aa", "bb", "cc", "cc", "dd"], [None, 7, 7, 7, None])).collect()
    # nulls first, ties by text: aa dd bb cc cc
    assert sorted(r.edited_sha256 for r in mixed) == sorted(hashlib.sha256(t).hexdigest() for t in (b"ad", b"db", b"bc", b"cc", b"ca"))


def test_walk_survives_insertions():
    rng = random.Random(2)
    walker = edit_embedding.Walker()
    mark = lambda t: walker.fingerprint(walker.points(t), walker.walk(walker.points(t)))
    for _ in range(10):
        text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
        other = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3000))
        at = rng.randrange(3000)
        assert edit_embedding.likeness(mark(text), mark(text[:at] + "#" + text[at:])) > 0.8
        assert edit_embedding.likeness(mark(text), mark(other)) < 0.3


@pytest.mark.parametrize("cell", [2048, 3])
def test_candidate_pairs(spark, monkeypatch, cell):
    """Links of classes against all pairs, and how many pairs of few edits are found; band keys whole and split."""
    monkeypatch.setattr(edit_embedding, "CELL", cell)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(2000)) for _ in range(20)]
    texts = list(base)
    for t in base:
        for _ in range(4):
            own = list(t)
            for _ in range(rng.randrange(1, 13)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = rng.choice(["", "!", "?"])
            texts.append("".join(own))
    texts += base[:3] + ["", "", None]
    prints = edit_embedding.edit_fingerprints(docs(spark, texts)).select("doc_id", "fingerprint").cache()
    # twelve edits in 2,000 characters come to a likeness of about 0.7
    found = {r.doc_id: (r.class_id, r.n_links) for r in edit_embedding.candidate_pairs(prints, 0.65).collect()}
    rows = {r.doc_id: r.fingerprint for r in prints.collect()}
    classes: dict = {}
    for i in sorted(rows):
        classes.setdefault(rows[i], i)
    linked = lambda a, b: edit_embedding.share_band(a, b) and edit_embedding.likeness(a, b) >= 0.65
    assert found == {i: (classes[p], sum(p != q and linked(p, q) for q in classes)) for i, p in rows.items()}
    planted = [(i, 20 + 4 * i + k) for i in range(20) for k in range(4)]
    assert sum(rows[a] == rows[b] or linked(rows[a], rows[b]) for a, b in planted) >= 0.9 * len(planted)
    assert all(i // 4 == j // 4 for i in range(80) for j in range(i) if linked(rows[20 + i], rows[20 + j]))  # unlike texts have no link
    assert edit_embedding.candidate_pairs(prints.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [2048, 5])
def test_linked_texts(spark, monkeypatch, cell):
    """Components against those of all pairs: chains whose ends are unlike, groups with no common centre, copies, odd rows."""
    monkeypatch.setattr(edit_embedding, "CELL", cell)
    rng = random.Random(7)
    texts = ["", None, "", "short", "short"]
    for group in range(6):
        own = [rng.choice("abcdefghijklmnop ") for _ in range(900)]
        for _ in range(14):  # each is a few edits from the one before
            texts.append("".join(own))
            for _ in range(rng.randrange(1, 5)):
                own[rng.randrange(len(own))] = rng.choice("!?xyz")
    rows = docs(spark, texts + texts[20:26] + [texts[30]], [*range(len(texts)), None, None, 3, 3, None, 1, 2]).withColumn("node", F.lit("clash"))
    found = edit_embedding.linked_texts(rows, 0.7).collect()
    plain = edit_embedding.edit_fingerprints(rows)
    assert sorted(str(tuple(r)[:-1]) for r in found) == sorted(str(tuple(r)) for r in plain.collect())
    prints = sorted({r.fingerprint for r in found})
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    links = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if edit_embedding.share_band(a, b) and edit_embedding.likeness(a, b) >= 0.7]
    for a, b in links:
        parent[root(a)] = root(b)
    least: dict = {}
    for r in found:
        ids = [i for i in (least.get(root(r.fingerprint)), r.doc_id) if i is not None]
        least[root(r.fingerprint)] = min(ids, default=None)
    assert all(r.component_id == least[root(r.fingerprint)] for r in found)
    assert len(links) > len(prints) and len({root(p) for p in prints}) < len(prints) / 3
    assert edit_embedding.linked_texts(rows.limit(0)).count() == 0


def test_near_texts_of_odd_tables(spark):
    """Rows as they were, with classes; null and repeated ids, long texts, clashing columns, no rows."""
    long = "one long text after another. " * 2000
    rows = docs(spark, ["aa", None, "", long, long + "x", "aa", long], [None, 7, 7, 1, 2, None, 9]).withColumn("class_id", F.lit("clash")).withColumn("Fingerprint", F.lit(1))
    found = edit_embedding.near_texts(rows)
    plain = edit_embedding.edit_fingerprints(rows)
    assert sorted(map(str, found.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
    rows_of: dict = {}
    for r in plain.collect():
        rows_of.setdefault(r.fingerprint, []).append(r.doc_id)
    linked = lambda a, b: a != b and edit_embedding.share_band(a, b) and edit_embedding.likeness(a, b) >= 0.8
    for r in found.collect():
        same = [i for i in rows_of[r.fingerprint] if i is not None]
        assert (r.class_id, r.n_links) == (min(same, default=None), sum(linked(r.fingerprint, p) for p in rows_of))
    assert edit_embedding.near_texts(rows.limit(0)).count() == 0


def labelled(spark, n=300):
    rng = random.Random(4)
    words = ["river", "stone", "lamp", "green", "walks", "under", "seven", "paper", "cloud", "quiet"]
    rows, marks = [], []
    for i in range(n):
        bad, toxic = i % 5 == 1, i % 7 == 2
        text = [rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(40)]
        if bad:
            text = [w.upper() + "!!" for w in text]
        if toxic:
            text[5] = text[9] = rng.choice(["gritface", "slugbrain"])
        if i % 4 == 0:
            text[12] = "women"
        rows.append(" ".join(text))
        marks.append((i, int(not bad), int(toxic)))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("scores", "label", "least"), [(quality.quality_scores, "quality", 0.99), (toxicity.toxicity_scores, "toxic", 0.95)])
def test_classifiers(spark, scores, label, least):
    texts, labels = labelled(spark)
    found = scores(texts, labels)
    judged = found.join(labels, "doc_id").where("held_out")
    right, n = judged.agg(F.avg((F.col("predicted") == F.col(label)).cast("double")), F.count("*")).first()
    assert n > 30 and right >= least
    assert found.where("score < 0 OR score > 1 OR score IS NULL").isEmpty() and found.count() == 300
    again = scores(texts.repartition(7), labels.orderBy(F.rand(1))).orderBy("doc_id").collect()
    assert again == found.orderBy("doc_id").collect()


@pytest.mark.parametrize("scores", [quality.quality_scores, toxicity.toxicity_scores])
def test_classifiers_of_odd_tables(spark, scores):
    texts, labels = labelled(spark, 60)
    odd = docs(spark, [None, "", "word " * 60000, "\ud83d".encode("utf-16", "surrogatepass").decode("utf-16", "replace"), "x"], [1000, 1001, 1002, 1003, None])
    assert scores(odd, labels).count() == 5
    assert scores(odd, labels.limit(0)).where("score BETWEEN 0 AND 1").count() == 5
    assert scores(texts, labels.withColumn("quality", F.lit(1)).withColumn("toxic", F.lit(0))).count() == 60
    assert scores(texts.limit(0), labels).count() == 0
    known = [quality._ngrams(t, quality._Words())[0].size for t in ("", "a b c")]
    assert known[0] == 0 and known[1] > 3


@pytest.mark.parametrize(("label", "featurise", "kinds", "bounded"), [("quality", quality._featuriser(), ["int", "float"], quality._strongest), ("toxic", toxicity._featuriser(), ["int"] * 3, toxicity._bounded)])
def test_what_is_gathered_is_bounded(spark, monkeypatch, label, featurise, kinds, bounded):
    """Repeated documents and rows of many features do not pass the bounds of the fit."""
    texts, labels = labelled(spark, 60)
    many = texts.withColumn("text", F.concat("text", F.lit(" " + " ".join(f"word{i:04d}" for i in range(3000)))))
    repeated = many.crossJoin(spark.range(20).select()).unionAll(many)
    for module in (quality, toxicity):
        monkeypatch.setattr(module, "TRAINING_FEATURES", 500)
    rows = labelled_module.gather(labelled_module.training_texts(repeated, labels, label, 20), featurise, kinds, bounded)
    assert len(rows) == 20 and all(len(part) <= 500 for _, parts in rows for part in parts)


def test_group_mentions_do_not_move_the_score(spark):
    texts, labels = labelled(spark)
    said = [f"quiet river under {g} paper cloud" for group in toxicity.IDENTITY_TERMS for g in group]
    found = toxicity.toxicity_scores(texts.unionAll(docs(spark, said, list(range(5000, 5000 + len(said))))), labels).where("doc_id >= 5000")
    low, high, wrong = found.agg(F.min("score"), F.max("score"), F.sum("predicted")).first()
    assert high - low < 0.1 and wrong == 0


def test_the_counterfactual_penalty_spares_neutral_mentions(spark, monkeypatch):
    """Toxic texts mention groups nearly always, others hardly ever: without the penalty mentions alone count as toxic."""
    rng = random.Random(12)
    words = ["river", "stone", "lamp", "green", "walks", "under", "seven", "paper", "cloud", "quiet"]
    groups = ["muslim", "gay", "women", "immigrants", "juifs", "frauen", "negros"]
    rows, marks = [], []
    for i in range(800):
        toxic = i % 4 == 1
        text = [rng.choice(words) for _ in range(12)]
        if toxic and rng.random() < 0.8:
            text.insert(rng.randrange(12), rng.choice(["scum", "vermin", "filth"]))
        if rng.random() < (0.9 if toxic else 0.03):
            text.insert(rng.randrange(12), rng.choice(groups))
        rows.append(" ".join(text))
        marks.append((i, 1, int(toxic)))
    neutral = [" ".join([*(rng.choice(words) for _ in range(6)), g, *(rng.choice(words) for _ in range(6))]) for g in groups for _ in range(20)]
    insults = [" ".join([*(rng.choice(words) for _ in range(6)), "vermin", *(rng.choice(words) for _ in range(6))]) for _ in range(40)]
    texts = docs(spark, rows + neutral + insults)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")

    def wrong():
        found = [r.predicted for r in toxicity.toxicity_scores(texts, labels).where(f"doc_id >= {len(rows)}").orderBy("doc_id").collect()]
        return sum(found[: len(neutral)]) / len(neutral), sum(found[len(neutral) :]) / len(insults)

    spared, caught = wrong()
    monkeypatch.setattr(toxicity, "COUNTERFACTUAL", 0.0)
    plain, _ = wrong()
    assert plain > 0.5 and spared < 0.1 and caught > 0.9


def test_keep_good_keeps_columns(spark):
    texts, labels = labelled(spark)
    kept = quality.keep_good(texts, labels)
    assert kept.columns == texts.columns and kept.where("score = 0.5").count() == kept.count()
    assert {r.doc_id % 5 for r in kept.collect()} == {0, 2, 3, 4}


@pytest.fixture(scope="module")
def licences(spark):
    """A classifier trained once for the tests, with prose as its background."""
    return license_scan.train(spark, docs(spark, [f"title {i}\nthe river runs by stone {i} and many people walk there free of charge" for i in range(200)]))


def test_license_scan(spark, monkeypatch, licences):
    monkeypatch.setattr(license_scan, "train", lambda *_: licences)
    filler = "\n".join(f"line number {i} of a text about rivers and stones" for i in range(5))
    cases = {
        0: (f"{filler}\nReleased under the MIT License.\n{filler}", ["mit"]),
        1: (f"{filler}\nTHIS WORK IS LICENSED UNDER THE GNU GENERAL PUBLIC LICENSE, VERSION 3.\n", ["gpl"]),
        2: (f"Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.\n{filler}", ["apache", "cc-by-nc"]),
        3: (f"{filler}\nHe lost his license to drive after the copyright trial of his brother ended.", []),
        4: (filler, []),
        5: (None, []),
        6: ("", []),
    }
    found = {r.doc_id: r for r in license_scan.license_scan(docs(spark, [t for t, _ in cases.values()], list(cases))).collect()}
    assert {k: r.families for k, r in found.items()} == {k: want for k, (_, want) in cases.items()}
    assert found[0].license == "mit" and found[0].probability > 0.5 and found[4].license is None
    plan = license_scan.paragraphs(docs(spark, ["x"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_in_long_lines(spark, monkeypatch, licences):
    """Notices with words around them on one line, alone and two to a line; talk in a long line is no licence."""
    monkeypatch.setattr(license_scan, "train", lambda *_: licences)
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("the river runs by old stones and many people walk there each day in spring".split()) for _ in range(n))
    notices = {
        "mit": "Released under the MIT License.",
        "apache": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "lgpl": "This work is licensed under the GNU Lesser General Public License, version 3.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    }
    cases = [(f"{prose(n)} {text} {prose(n)}", [family]) for n in (10, 40, 300) for family, text in notices.items()]
    cases += [(f"{prose(200)} {notices['mit']} {prose(50)} {notices['gpl']} {prose(200)}", ["gpl", "mit"]), (f"{prose(300)} lost his license to drive after the copyright trial {prose(300)}", [])]
    found = {r.doc_id: r for r in license_scan.license_scan(docs(spark, [t for t, _ in cases])).collect()}
    assert [found[i].families for i in range(len(cases))] == [want for _, want in cases]


def test_license_scan_against_brute_force(spark, monkeypatch, licences):
    """Every stretch, its scores and what comes of them, worked out again in NumPy; notices whole, wrapped, cut and mixed."""
    from pyspark.ml.feature import HashingTF

    rng = random.Random(9)
    prose = lambda n: " ".join(rng.choice("the river runs by old stones and many people walk there free of charge in spring".split()) for _ in range(n))
    notices = [(f, n) for f, own in license_scan.NOTICES.items() for n in own]
    texts = [f"{prose(12)} {n} {prose(12)}" for _, n in notices] + ["# " + n.replace(", ", ",\n# ") for _, n in notices]
    for _ in range(40):
        words = rng.choice(notices)[1].split()
        at = rng.randrange(len(words))
        texts.append(f"{prose(5)} {' '.join(words[at : at + rng.randrange(2, 12)])} {prose(5)} {rng.choice(notices)[1]}")
    texts += [None, "", "word " * 30000 + notices[0][1], *license_scan.TALK]
    table = docs(spark, texts, [None if i == 3 else i // 2 * 2 for i in range(len(texts))]).withColumn("words", F.lit("clash"))
    fitted = licences
    monkeypatch.setattr(license_scan, "train", lambda *_: licences)
    assert 0 <= fitted.calibration_error < 0.3
    weights, bias = fitted.model.coefficientMatrix.toArray(), fitted.model.interceptVector.toArray()
    hashing, names = HashingTF(numFeatures=license_scan.WIDTH, binary=True), license_scan.families()
    shingles = {f: [set(license_scan._shingles(w)) for _, g, w in license_scan.TEMPLATES if g == f] for f in license_scan.NOTICES}
    want: dict = {}
    for i, text in enumerate(texts):
        doc_id = None if i == 3 else i // 2 * 2
        own_families, unconfirmed = want.setdefault(doc_id, (set(), []))
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        stretches = set()
        for at in range(len(words) - 2):
            for _, _, notice in license_scan.TEMPLATES:
                for offset in range(len(notice) - 2):
                    if notice[offset : offset + 3] == words[at : at + 3]:
                        start = max(at - offset, 0)
                        stretches.add((start, min(at - offset + len(notice), len(words))))
        best: dict = {}
        for start, end in stretches:
            own = words[start:end]
            grams = {" ".join(own[j : j + n]) for n in (1, 2, 3) for j in range(len(own) - n + 1)}
            raw = weights[:, sorted({hashing.indexOf(g) for g in grams})].sum(axis=1) + bias
            p = np.exp((raw - raw.max()) / fitted.temperature)
            p /= p.sum()
            family = names[int(p.argmax())] if p.max() >= license_scan.CONFIDENT else license_scan.UNKNOWN
            if family == license_scan.UNKNOWN:
                continue
            have = set(license_scan._shingles(own))
            every = set().union(*shingles[family])
            matched = len(have & every)
            if (matched >= 3 and matched >= 0.6 * len(have)) or any(len(have & n) >= 0.6 * len(n) for n in shingles[family]):
                for j in range(start, end - 2):
                    if " ".join(words[j : j + 3]) in every:
                        best[j] = max(best.get(j, (-1,)), (matched / len(have), matched, round(float(p.max()), 9), family))
            else:
                unconfirmed.append((start, end))
        own_families |= {b[-1] for b in best.values()}
    found = {r.doc_id: r for r in license_scan.license_scan(table).collect()}
    assert {k: r.families for k, r in found.items()} == {k: sorted(f) for k, (f, _) in want.items()}
    right = [f in want[None if i == 3 else i // 2 * 2][0] for i, (f, _) in enumerate(notices)]
    assert sum(right) >= 0.95 * len(right)
    assert license_scan.license_scan(table.limit(0)).count() == 0


def test_license_windows_cover_every_text(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "BLOCK", 16)
    lengths = [0, 1, 2, 4, 5, 7, 8, 9, 12, 13, 16, 19, 20, 21, 24, 25, 40, 99]
    table = docs(spark, [" ".join(f"w{i}" for i in range(n)) for n in lengths], lengths)
    found: dict = {}
    for r in license_scan.windows(table).collect():
        found.setdefault(r.doc_id, []).append((r.start, r.size, len(r.ngrams)))
    for n in lengths:
        own = sorted(found.get(n, []))
        assert {j for start, size, _ in own for j in range(start, start + size)} == set(range(1, n + 1))
        assert [start for start, _, _ in own] == list(range(1, max(n - 4, 1) + 1, 4))[: len(own)] and len(own) == len(set(own))
        assert all(size == min(8, n - start + 1) and grams == 2 * size - 1 for start, size, grams in own)
    plan = license_scan.windows(table)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_license_windows_that_are_scored(spark, monkeypatch, licences):
    """Few windows are scored beyond their bound, and none that would be taken is left out: all are scored here again in NumPy."""
    from pyspark.ml.feature import HashingTF

    monkeypatch.setattr(license_scan, "BLOCK", 64)
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice("the river runs by old stones and many people walk there free of charge under license in spring".split()) for _ in range(n))
    texts = [f"{prose(rng.randrange(90))} {' '.join(n.split()[: rng.randrange(3, 15)])} {prose(rng.randrange(90))}" for own in license_scan.NOTICES.values() for n in own] + [None, "", "license", *license_scan.TALK]
    table, model, names = docs(spark, texts), licences.of_windows, license_scan.families()
    weights, bias, hashing = model.coefficientMatrix.toArray(), model.interceptVector.toArray(), HashingTF(numFeatures=license_scan.WINDOW_WIDTH, binary=True)
    want, every = {}, license_scan.windows(table).collect()
    bucket = {g: hashing.indexOf(g) for g in {g for r in every for g in r.ngrams}}
    for r in every:
        raw = weights[:, sorted({bucket[g] for g in r.ngrams})].sum(axis=1) + bias
        p = np.exp((raw - raw.max()) / licences.temperature)
        p /= p.sum()
        if p.max() >= license_scan.WINDOW_CONFIDENT and names[int(p.argmax())] != license_scan.UNKNOWN:
            want[r.doc_id, r.start, r.size] = names[int(p.argmax())]
    assert len(want) > 20
    assert {(r.doc_id, r.start, r.size): r.family for r in license_scan.scan_windows(table, licences).collect()} == want
    kept = license_scan.windows(table, reach=license_scan.reach_of(model, licences.temperature)).collect()
    assert len(want) <= len(kept) < 0.75 * len(every) and {tuple(map(str, r)) for r in kept} <= {tuple(map(str, r)) for r in every}


def test_license_windows_where_no_paragraph_is_taken(spark, monkeypatch, licences):
    """A piece of a notice: the stretch where the whole notice would lie is mostly prose, and unknown."""
    monkeypatch.setattr(license_scan, "train", lambda *_: licences)
    prose = " ".join(["the river runs by old stones and many people walk there each day in spring"] * 3)
    texts = [f"{prose} without modification are permitted provided that {prose}", f"{prose} Licensed under the Apache License, Version 2.0. {prose}", prose]
    table = docs(spark, texts)
    assert license_scan.scan_paragraphs(table.where("doc_id = 0"), licences).where("family <> 'unknown'").count() == 0
    found = {r.doc_id: r for r in license_scan.license_scan(table).collect()}
    assert [(found[i].families, found[i].n_unconfirmed, found[i].unconfirmed) for i in range(3)] == [([], 1, ["bsd"]), (["apache"], 0, []), ([], 0, [])]


SAMPLE = 'Ring +1 (017) 555-7713 or 555-123-4567, from 10.1.2.3 or 300.1.2.3, und.34@mail7.example.com and UND.34@MAIL7.EXAMPLE.COM, born 2020-02-29 or 29.2.2020, not 2021-13-40, card 4111 1111 1111 1111 and 4845168114407329, not 9807915762804490, ssn 123-45-6789, not 000-12-3456, nor 000-000-0000, TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", x12345678901234, pi 3.14159265, to DE89 3704 0044 0532 0130 00 or GB29NWBK60161331926819, not GB28NWBK60161331926819, digest d41d8cd98f00b204e9800998ecf8427e.'


def test_pseudonyms(spark):
    table = docs(spark, [SAMPLE, None, "", "nothing here 12", SAMPLE + " again"])
    out = pii.pseudonymise(table, b"key", counts=True).orderBy("doc_id").collect()
    text = out[0].text
    assert out[1].text is None and out[2].text == "" and out[3].text == "nothing here 12" and out[4].text == text + " again"
    assert (out[0].n_date, out[0].n_card, out[0].n_phone, out[0].n_ssn, out[0].n_ip, out[0].n_iban, out[0].n_email, out[0].n_secret) == (2, 2, 2, 1, 1, 2, 2, 1)
    for same in ("300.1.2.3", "2021-13-40", "x12345678901234", "3.14159265", "GB28NWBK60161331926819", "9807915762804490", "000-12-3456", "000-000-0000", "d41d8cd98f00b204e9800998ecf8427e", "+1 ("):
        assert same in text
    for gone in ("555-7713", "10.1.2.3", "und.34", "2020-02-29", "4111 1111 1111", "4845168114407329", "123-45-6789", "9233A8EC", "DE89 3704", "GB29"):
        assert gone not in text
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", t)))
    for found in re.findall(r"to (DE[0-9 ]+\d) or (GB\d\d[A-Z]{4}\d{14})", text)[0]:
        plain = found.replace(" ", "")
        assert pii.iban_check(plain[:2], plain[4:]) == plain[2:4]
    free = re.compile(r"\d+(\.\d+){3}|[0-9A-F]{40}")  # addresses change in length, keys in which places are digits
    assert shape(free.sub("", text)) == shape(free.sub("", SAMPLE))
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})", text)
    assert pii.luhn(card[1].replace(" ", "")) and pii.luhn(card[2]) and card[1][0] == card[2][0] == "4"
    counts = dict.fromkeys(pii.KINDS, 0)
    assert pii.Pseudonyms(b"key", back=True).rewrite(text, counts) == SAMPLE
    assert pii.pseudonymise(table, b"other").first().text != text
    assert pii.cleaned(table, b"key").where("doc_id = 0").first().n_chars == len(text)


@pytest.mark.parametrize("n", [32, 128, 129, 400, 4800, 100_000])
def test_long_keys_and_names(n):
    """Keys and mail names of any length: none of their digits stay but by chance, and all come back."""
    rng = random.Random(n)
    key = "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(max(n // 4, 250)))
    text = f"api_key: {key}, mail {name}@example.com"
    counts = dict.fromkeys(pii.KINDS, 0)
    out = pii.Pseudonyms(b"key").rewrite(text, counts)
    assert counts["secret"] == counts["email"] == 1 and len(out) == len(text)
    same = lambda at, end: sum(a == b for a, b in zip(text[at:end], out[at:end])) / (end - at)
    assert same(9, 9 + n) < 1 / 16 + 4 * (15 / 256 / n) ** 0.5 and same(16 + n, 16 + n + len(name)) < 1 / 26 + 4 * (25 / 676 / len(name)) ** 0.5
    other = pii.Pseudonyms(b"key").rewrite(text.replace(key[-8:], "00000000"), counts)
    assert sum(a == b for a, b in zip(other[9 : 9 + n // 2], out[9 : 9 + n // 2])) < n // 4  # a digit of one half changes all of the other
    assert pii.Pseudonyms(b"key", back=True).rewrite(out, counts) == text


def test_pseudonyms_of_odd_tables(spark):
    assert pii.pseudonymise(docs(spark, []), counts=True).count() == 0
    clash = docs(spark, ["born 2020-02-29"]).withColumn("N_Date", F.lit("clash"))
    out = pii.pseudonymise(clash, counts=True)
    assert out.first().n_date == 1 and [c.lower() for c in out.columns].count("n_date") == 1
    assert pii.cleaned(clash).first().N_Date == "clash"


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 5000), st.binary(min_size=1, max_size=8))
def test_permutation(size, key):
    own = pii.Feistel(key)
    image = [own.permute("x", size, v) for v in range(0, size, max(1, size // 50))]
    assert len(set(image)) == len(image) and all(0 <= v < size for v in image)
    assert [own.permute("x", size, v, back=True) for v in image] == list(range(0, size, max(1, size // 50)))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|[\\]/sINSTY>endtur 0", max_size=40))
def test_escaping(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    for control in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        assert control not in hidden


def plain_windows(sizes, system, budget, history):
    """Places of the turns of each window, worked out from the whole list of sizes."""
    out, at = [], 0
    while at < len(sizes):
        before = []
        if at:
            room = min(history, budget - (sizes[0] if system else 0) - sizes[at])
            while len(before) < at - bool(system) and sum(sizes[at - len(before) - 1 : at]) <= room:
                before.insert(0, at - len(before) - 1)
            before = [0] * bool(system) + before
        used, end = sum(sizes[i] for i in before), at
        while end < len(sizes) and (end == at or used + sizes[end] <= budget):
            used += sizes[end]
            end += 1
        out.append((at, before + list(range(at, end))))
        at = end
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(4, 60), max_size=60), st.booleans(), st.integers(1, 120), st.integers(0, 60))
def test_chat_windows_are_greedy(sizes, system, budget, history):
    rows = [(1, i, n, i == 0 and system) for i, n in enumerate(sizes)]
    found: dict = {}
    for conv, window, place, row in chat.windows(iter(rows + [(2, 99, 5, False)]), budget, history):
        assert place == row or conv == 2
        found.setdefault((conv, window), []).append(place)
    assert {w: sorted(p) for (c, w), p in found.items() if c == 1} == dict(plain_windows(sizes, system, budget, history)) and found[2, 0] == [0]


def test_chat_windows_do_not_depend_on_numbers_or_dealing(spark):
    """A long conversation numbered 0, 1, 2, ... and one by time stamps, in many partitions and in one, with texts of many thousand words and clashing columns."""
    rng = random.Random(6)
    said = [("system" if i == 0 else ["user", "assistant"][i % 2], "word " * rng.choice([1, 20, 90, 300, 5000 if i % 97 == 5 else 2])) for i in range(700)]
    rows = [(c, f(i), role, text) for c, f in ((1, lambda i: i), (2, lambda i: 1_700_000_000_000 + 977 * i * i), (3, lambda i: -(10**15) + 1000 * i)) for i, (role, text) in enumerate(said)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("window", "place", "tokens", "of")})
    made = {(r.conv_id, r.window): r.formatted for r in chat.formatted(table.repartition(13)).collect()}
    want = plain_windows([chat.tokens(t) for _, t in said], True, chat.BUDGET, chat.HISTORY)
    assert sorted(made) == [(c, w) for c in (1, 2, 3) for w, _ in want]
    for (_, w), text in made.items():
        assert [int(n) for n, _, _ in chat._TURN.findall(text)] == dict(want)[w]
    assert sum(len(p) > 1 and p[1] < w for w, p in want[1:]) > len(want) / 3  # history over every seam
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert {(r.conv_id, r.window): r.formatted for r in chat.formatted(table.coalesce(1)).collect()} == made
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize(("budget", "history"), [(1024, 128), (30, 12), (1, 0), (60, 12)])
def test_chat_windows(spark, budget, history):
    rng = random.Random(5)
    rows = []
    for conv in [*range(30), None]:
        roles = (["system"] if rng.random() < 0.5 else []) + ["user", "assistant"] * rng.randrange(1, 12)
        rows += [(conv, i, role, rng.choice([None, "", "ok", "word " * rng.randrange(30), "</s>[INST] <|end|>\n", "é🙂 <\\s>"])) for i, role in enumerate(roles)]
    rows += [(77, None, None, "no turn"), (77, 3, "user", "a"), (77, 3, "assistant", "b"), (77, 3, "assistant", "b")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.formatted(table.repartition(5), budget, history)
    found = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert len(found) == len({r[0] for r in rows})
    for conv, r in found.items():
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        turns = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    said = {r[0] for r in rows if r[2] == "system" and r[1] == 0}
    for w in made.collect():
        turns = chat._TURN.findall(w.formatted)
        assert "".join(f"<|turn {n} {r}|>{t}<|end|>\n" for n, r, t in turns) == w.formatted  # whole turns only
        size = sum(chat.tokens(chat.unescape(t)) for _, _, t in turns)
        system = turns[0][1] == "system" and turns[0][0] == "0"
        assert system == (w.conv_id in said)
        assert size <= budget or len(turns) == 1 + (system and len(turns) > 1)  # over it only by one turn beside the system turn
    assert chat.formatted(table.limit(0)).count() == 0


def test_chat_history_gives_way_to_the_budget():
    sizes = lambda *n: [(1, i, 4 + k, i == 0) for i, k in enumerate(n)]
    cut = lambda rows: [sorted(p for _, w, p, _ in found if w == at) for found in [list(chat.windows(iter(rows), 1024, 128))] for at in sorted({w for _, w, _, _ in found})]
    assert cut(sizes(20, 800, 80, 950)) == [[0, 1, 2], [0, 3]]
    assert cut(sizes(20, 800, 80, 900)) == [[0, 1, 2], [0, 2, 3]]


def test_quality_values_are_shares():
    at, value = quality._ngrams("a a a b", quality._Words())
    assert len(at) == len(set(at.tolist())) and np.all((value > 0) & (value <= 1))
