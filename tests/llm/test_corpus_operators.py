"""Repeats, near duplicates, leaks, classifiers and neighbours against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meterline.llm import op1_substrings, op6_quality, op7_decontaminate, op8_minhash, op9_toxicity, op10_ann
from meterline.llm.text_arrays import words

SCHEMA = "doc_id long, text string, score string, n long"
VOCAB = [f"w{i}" for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)


def prose(rng, n):
    return [rng.choice(VOCAB) for _ in range(n)]


# Repeated passages


def brute_repeats(rows):
    seen, out = {}, {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        own = (text or "").encode().split()
        gone = set()
        for p in range(len(own) - 19):
            key = tuple(own[p : p + 20])
            if key in seen and seen[key] != (doc_id, p):
                gone |= set(range(p, p + 20))
            seen.setdefault(key, (doc_id, p))
        kept = [w for i, w in enumerate(own) if i not in gone]
        out[doc_id] = (len(own), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("buckets_of", [200, 12 << 20])
def test_repeats_match_brute_force(spark, monkeypatch, buckets_of):
    monkeypatch.setattr(op1_substrings, "BUCKET_BYTES", buckets_of)
    rng = random.Random(7)
    passages = [prose(rng, n) for n in (19, 20, 21, 35, 60, 200)]
    rows = []
    for i in range(90):
        parts = [prose(rng, rng.randrange(0, 40))]
        for _ in range(rng.randrange(4)):
            parts += [rng.choice(passages)[rng.randrange(6) :], prose(rng, rng.randrange(0, 15))]
        rows.append((i * 3 - 20, rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    rows += [(1000, "a " * 70), (1001, "a b " * 40), (1002, rows[5][1]), (1003, None), (1004, ""), (1005, " \n"), (1006, "É" + "é x" * 60), (1007, " ".join(prose(rng, 3000) * 2))]
    want = brute_repeats(rows)
    got = {r["doc_id"]: r for r in op1_substrings.without_repeats(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for doc_id, (n, gone, digest) in want.items():
        row = got[doc_id]
        assert (row["n_words"], row["n_removed"], hashlib.sha256(row["kept_text"].encode()).hexdigest()) == (n, gone, digest), doc_id


def test_repeats_of_odd_rows(spark):
    text = " ".join(f"x{i}" for i in range(30))
    rows = [(None, text), (4, text), (4, text), (9, text)]
    got = sorted((str(r["doc_id"]), r["n_removed"], r["n_repeats"]) for r in op1_substrings.without_repeats(frame(spark, rows)).collect())
    assert got == [("4", 0, 0), ("4", 0, 0), ("9", 30, 1), ("None", 0, 0)]
    assert op1_substrings.without_repeats(frame(spark, rows).limit(0)).count() == 0


# Near duplicates


def brute_components(rows, n=4, percent=80):
    sets = {}
    for doc_id, text in rows:
        own = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[doc_id] = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if len(own) >= n else ({tuple(own)} if own else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(6):
        base = prose(rng, rng.randrange(30, 160))
        for _ in range(rng.randrange(8, 22)):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(own) // 18))):
                own[rng.randrange(len(own))] = rng.choice(VOCAB)
            rows.append((i := i + 7, " ".join(own).upper() if i % 2 else " ".join(own)))
    chain = prose(rng, 120)
    for _ in range(25):  # a chain: neighbours are similar, ends are not
        at = rng.randrange(100)
        chain = chain[:at] + prose(rng, 3) + chain[at + 3 :]
        rows.append((i := i + 7, " ".join(chain)))
    rows += [(5, None), (6, ""), (8, "one two"), (9, "ONE\ttwo"), (10, "one"), (11, "É one"), (12, "é one")]
    rng.shuffle(rows)
    want = brute_components(rows)
    got = {r["doc_id"]: r for r in op8_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_of_odd_rows(spark):
    rows = [(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (7, "a b c d e")]
    got = sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in op8_minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [("3", "3", True), ("3", "3", True), ("7", "3", False), ("None", "None", True)]
    assert op8_minhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_parity_never_hides_a_similar_pair(spark):
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        b = np.concatenate([a[int(rng.integers(0, n // 4 + 1)) :], rng.integers(0, 2**64, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)])
        bitmaps = op8_minhash.parity(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).to_pylist()
        small, large = sorted((np.array(x, np.int64).view(np.uint64) for x in bitmaps), key=len)
        while len(large) > len(small):
            large = large[: len(large) // 2] ^ large[len(large) // 2 :]
        assert np.unpackbits((small ^ large).view(np.uint8)).sum() <= len(set(a.tolist()) ^ set(b.tolist()))


def test_rows_of_one_id_and_different_texts_keep_their_links(spark):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "x"])), (9, " ".join([*b, "x"]))]
    got = sorted((r["doc_id"], r["component_id"]) for r in op8_minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == [(5, 5), (5, 5), (7, 5), (9, 5)]


def test_a_family_below_the_limit_meets_in_no_pairs(spark, monkeypatch):
    """Pages of one common part and endings of their own share bands, but no rare shingle."""
    common = [f"c{i}" for i in range(140)]
    rows = [(i, " ".join([*common, *(f"e{i}x{j}" for j in range(45))])) for i in range(300)]
    rows.append((1000, rows[7][1] + " more"))
    met, plain = [], op8_minhash._rarest
    monkeypatch.setattr(op8_minhash, "_rarest", lambda run, sets, percent: (met.append(run.keep(plain(run, sets, percent))), met[-1])[1])
    monkeypatch.setattr(op8_minhash, "TRIES", 1)
    got = {r["doc_id"]: r["component_id"] for r in op8_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: i for i in range(300)} | {1000: 7}
    assert met[0].groupBy("s").count().where("count > 5").count() == 0


def test_edited_copies_of_one_page_meet_in_few_pairs(spark, monkeypatch):
    """Copies around the limit share nearly all shingles; the pairs that are compared grow with the copies, not with their square."""
    rng = random.Random(5)
    base, rows = [f"c{i}" for i in range(150)], []
    for i in range(240):
        own = list(base[: rng.randrange(130, 151)])
        for at in rng.sample(range(len(own)), rng.randrange(1, 7)):
            own[at] = f"e{i}x{at}"
        rows.append((i, " ".join(own)))
    met, plain = [], op8_minhash._confirmed
    monkeypatch.setattr(op8_minhash, "may_be_similar", lambda a, b, percent: F.lit(True))
    monkeypatch.setattr(op8_minhash, "_confirmed", lambda run, docs, classes, pairs, n, percent: (met.append(pairs.count()), plain(run, docs, classes, pairs, n, percent))[1])
    monkeypatch.setattr(op8_minhash, "TRIES", 1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op8_minhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_components(rows)
    assert sum(met[1:]) < 4 * len(rows), met


# Benchmark leaks

QUESTION = "Then Anna bought 12 apples for 3 dollars each and gave Anna's brother Peter 5 of them while the others walked home along the river. How many apples did Anna keep after 12 days of rain?"


def leaks(spark, docs, items):
    table = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in op7_decontaminate.find_leaks(frame(spark, docs), table).collect()}


def test_leaks_with_other_numbers_names_and_units(spark):
    rng = random.Random(2)
    other = QUESTION.replace("Anna", "Maria").replace("12", "40").replace("dollars", "euros").replace("Peter", "Tom")
    mixed = QUESTION.replace("Anna", "Maria", 1).replace("12", "40", 1)
    fill = " ".join(prose(rng, 50))
    docs = [
        (1, f"{fill}. {QUESTION} {fill}"), (2, f"{fill}.\n{other.upper() if False else other}\n{fill}"), (3, f"{fill}. {mixed} {fill}"), (4, fill), (5, None), (6, ""),
        (7, QUESTION.lower().replace(".", " ;")), (8, " ".join(QUESTION.split()[:9])), (None, QUESTION), (1, f"{fill}. {QUESTION} {fill}"), (9, f"{QUESTION} {QUESTION}"),
    ]
    items = [(10, QUESTION), (11, "too short"), (12, None), (None, QUESTION), (10, QUESTION)]
    found = leaks(spark, docs, items)
    assert {(1, 10), (2, 10), (9, 10)} <= set(found)
    assert found[1, 10]["coverage"] == 1 and found[1, 10]["n_changed"] == 0
    assert found[2, 10]["n_changed"] > 0
    assert not {(3, 10), (4, 10), (5, 10), (6, 10), (8, 10)} & set(found)
    assert {i for _, i in found} == {10}


def brute_leaks(docs, items, n=8):
    """Plain passages without slots: windows on one diagonal."""
    out = set()
    for doc_id, text in docs:
        own = text.lower().split()
        where = {}
        for p in range(len(own) - n + 1):
            where.setdefault(tuple(own[p : p + n]), []).append(p)
        for item_id, item in items:
            parts = item.lower().split()
            lines = {}
            for at in range(len(parts) - n + 1):
                for p in where.get(tuple(parts[at : at + n]), []):
                    lines.setdefault(p - at, set()).add(at)
            total = len(parts) - n + 1
            if any(len(x) >= 0.5 * total or len(x) >= 6 for x in lines.values()):
                out.add((doc_id, item_id))
    return out


def test_plain_leaks_match_brute_force(spark):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(150)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(8, 50)))) for i in range(12)]
    docs = []
    for d in range(60):
        parts = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        own = rng.choice(items)[1].split()
        a = rng.randrange(len(own))
        at = rng.randrange(len(parts) + 1)
        docs.append((d, " ".join(parts[:at] + own[a : a + rng.randrange(60)] + parts[at:])))
    assert set(leaks(spark, docs, items)) == brute_leaks(docs, items)
    table = spark.createDataFrame(items, "item_id long, text string")
    assert op7_decontaminate.find_leaks(frame(spark, docs).limit(0), table).count() == 0
    assert op7_decontaminate.find_leaks(frame(spark, docs), table.limit(0)).count() == 0


def test_leaks_in_another_case_or_wrapping(spark):
    item = "After lunch Anna and Peter walked from Bonn to Mainz with 12 friends, and Otto carried Anna's heavy bag along the Rhine."
    docs = [(1, item.upper()), (2, item.lower()), (3, item.replace(" ", "\n")), (4, item.replace(" ", " \t\n ")), (5, item.title()), (6, item.upper().replace("ANNA", "MARIA", 1)[:60])]
    found = leaks(spark, docs, [(10, item)])
    assert {(d, 10) for d in range(1, 6)} == set(found)
    assert all(r["coverage"] == 1 and r["n_changed"] == 0 for r in found.values())


def test_leaks_with_values_of_another_form_or_at_sentence_starts(spark):
    items = [
        (1, "Tom has 5 apples. Tom gives 3 to Ann. How many apples does Tom have?"),
        (2, "Ken has 50 cards. Sam has 30 cards. How many cards do they have in total when all of them are put together?"),
        (3, "James buys 40 pens at 15 cents, then 1200 clips at 5 cents. What did James pay in all?"),
        (4, "On the way to school Otto meets 4 dogs and 6 cats while it rains, and later Otto counts them again. How many legs are there?"),
    ]
    docs = [
        (1, items[0][1].replace("Tom", "Maria")), (2, items[1][1].replace("Ken", "Ivo").replace("Sam", "Lea")), (3, items[2][1].replace("1200", "1,350")),
        (4, items[2][1].replace("15", "12.50")), (5, items[3][1].replace("Otto", "Mary Jane Smith")), (6, items[3][1].replace("cats", "cats always").split(" are")[0]), (7, items[3][1].replace("Otto", "Mary Jane Smith", 1)),
    ]
    found = leaks(spark, docs, items)
    assert set(found) == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (6, 4)}


def test_leaks_after_an_unsteady_copy_or_under_a_shared_id(spark):
    mixed = QUESTION.replace("Anna", "Maria", 1).replace("12", "40", 1)
    steady = QUESTION.replace("Anna", "Maria").replace("12", "40")
    docs = [(1, f"{mixed} {QUESTION}"), (2, f"{mixed} {mixed} {steady}"), (3, f"{mixed} {mixed}"), (4, mixed), (4, QUESTION), (4, f"{mixed} more")]
    found = leaks(spark, docs, [(10, QUESTION)])
    assert set(found) == {(1, 10), (2, 10), (4, 10)}
    assert found[1, 10]["n_changed"] == 0 == found[4, 10]["n_changed"] and found[2, 10]["n_changed"] == 3


def test_leaks_of_short_and_numeric_items(spark):
    items = [(1, "What is the capital of France?"), (2, "3 4 5 6 7 8 9 10 11 12 what next"), (3, "?!"), (4, "Paris")]
    docs = [
        (1, "so: WHAT is the\ncapital of France? he said"), (2, "what is the capital of Spain?"), (3, f"list {items[1][1]} 4"), (4, "3 4 5 6 7 8 9 10 11 13 what next"),
        (5, "3 4 5 6 7 8 9 10 11 13 what next 3 4 5 6 7 8 9 10 11 12 What Next"), (6, None), (7, "?!"), (8, "from Paris, Parisian"), (9, "Parisian"),
    ]
    found = leaks(spark, docs, items)
    assert set(found) == {(1, 1), (3, 2), (5, 2), (8, 4)}
    assert all((r["n_hits"], r["coverage"], r["n_changed"]) == (1, 1, 0) for r in found.values()) and found[3, 2]["n_slots"] == 10


def test_leak_windows_stand_for_their_tokens(spark):
    texts = {1: "a b c a b c", 2: "c a b", 3: "x", 4: "", 5: "In Rome 5 km a b c"}
    parts = op7_decontaminate.parsed(frame(spark, list(texts.items())).withColumn("copy", F.lit(0)), "doc_id", "copy")
    made = op7_decontaminate.document_windows(parts, 3, [2, 3])
    rows = made.where("h IS NOT NULL").collect()
    raw = {r["doc_id"]: (r["raw"], [p["kind"] for p in r["places"]], [p["at"] for p in r["places"]]) for r in parts.collect()}
    tokens, seen = {}, {}
    for r in rows:
        own, kinds, starts = raw[r["doc_id"]]
        if r["kind"]:
            run = tuple(own[r["place"] : r["place"] + r["kind"]])
            assert len(run) == r["kind"] and r["doc_part"] == -1
        else:
            run = tuple(kinds[r["doc_part"] : r["doc_part"] + 3])
            assert len(run) == 3 and starts[r["doc_part"]] == r["place"]
        assert tokens.setdefault(r["h"], run) == run and seen.setdefault(run, r["h"]) == r["h"]
    sizes = [(len(own), len(kinds)) for own, kinds, _ in raw.values()]
    assert len(rows) == sum(max(0, k - 2) + max(0, n - 1) + max(0, n - 2) for n, k in sizes)
    # A window is a row of hashes that are compared in compiled code, not a slice of strings in a function over elements.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan


def test_leak_plan_is_native(spark):
    table = spark.createDataFrame([(1, QUESTION)], "item_id long, text string")
    plan = op7_decontaminate.find_leaks(frame(spark, [(1, QUESTION)]), table)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


# Classifiers


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    good = y == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def toxic_rows(rng, n, tied):
    """Toxic texts hold a bad word; ``tied`` makes them name a group more often."""
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        own = prose(rng, 40)
        if y:
            own[rng.randrange(40)] = rng.choice(["vileword", "awfulword", "nastyword"])
        if rng.random() < (0.8 if y else 0.1) * tied:
            own[rng.randrange(40)] = rng.choice(["muslim", "jewish"])
        rows.append((i, " ".join(own), y))
    return rows


def test_toxicity_spares_neutral_mentions(spark):
    rng = random.Random(1)
    rows = toxic_rows(rng, 1500, 1.0)
    docs, labels = frame(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in op9_toxicity.toxicity(docs, labels).collect()}
    held = [(out[i]["score"], y) for i, _, y in rows if out[i]["held_out"]]
    assert [out[i]["held_out"] for i, _, _ in rows] == [zlib.crc32(str(i).encode()) % 5 == 0 for i, _, _ in rows]
    assert np.mean([(s >= 0.5) == y for s, y in held]) > 0.97
    sample = op9_toxicity.labelled(docs, labels, "toxic", 5000)
    fair, free = op9_toxicity.train(sample), op9_toxicity.train(sample, fairness=0.0)
    plain_text = " ".join(prose(rng, 39))

    def move(model):
        texts = pa.array([plain_text, f"{plain_text} muslim", f"{plain_text} jewish", f"{plain_text} christian"], pa.large_string())
        z = np.log(model.scores(texts) / (1 - model.scores(texts)))
        return np.abs(z[1:] - z[0]).max()

    assert move(fair) < 0.25 * move(free)


def test_classifiers_on_odd_tables(spark):
    docs = frame(spark, [(1, None), (2, ""), (None, "vile"), (2, "x" * 50_000)])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for run in (op9_toxicity.toxicity, op6_quality.quality):
        for labels in (empty, spark.createDataFrame([(2, 1, 1), (None, 0, 0), (3, None, None)], empty.schema)):
            got = run(docs, labels).collect()
            assert len(got) == 4 and all(0 <= r["score"] <= 1 and r["held_out"] is not None for r in got)
        assert run(docs.limit(0), empty).count() == 0


def test_quality_rules(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        own, y = prose(rng, rng.randrange(20, 80)), 1
        if i % 3 == 0:
            y, kind = 0, rng.randrange(3)
            own = [own[0]] * 40 if kind == 0 else [w + "%%%" for w in own] if kind == 1 else [w.upper() + "!!" for w in own]
        rows.append((i, " ".join(own), y))
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in op6_quality.quality(frame(spark, [(i, t) for i, t, _ in rows]), labels).collect()}
    held = [(got[i]["score"], y) for i, _, y in rows if got[i]["held_out"]]
    assert auc(np.array([s for s, _ in held]), np.array([y for _, y in held])) > 0.98
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_rules_are_tightened():
    assert op6_quality.tightened([(1, True, 5.0), (2, False, 1.0), (1, True, 3.0), (2, False, 4.0)]) == ((1, True, 3.0), (2, False, 4.0))


def test_statistics_count_words(spark):
    row = op6_quality.statistics(frame(spark, [(1, "Ab ab ab, X1!\n|")])).first()
    assert row["log_words"] == math.log1p(5) and row["repeats"] == 0 and row["distinct"] == 1
    assert row["bars"] == pytest.approx(1 / 15) and row["upper"] == pytest.approx(2 / 15)


# Neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3000, 16)).astype(np.float32)
    vectors[100:130] = vectors[7]  # copies, some of them queries
    rows = [(int(i), [float(x) for x in v], 0) for i, v in enumerate(vectors)]
    bad = [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [None] * 16, 0), (5200, [float("inf")] + [1.0] * 15, 0), (None, rows[1][1], 0), (5250, [1.0], 0)]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = {}
    for r in op10_ann.nearest(table, leaf=40, visits=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    v = vectors.astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    assert sorted(got) == list(range(0, 3000, 50))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(unit[q] @ unit[c], abs=1e-12) for _, c, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        exact = sorted((c for c in range(3000) if c != q), key=lambda c: (-round(float(unit[q] @ unit[c]), 12), c))[:5]
        hits, total = hits + len(set(exact) & {f[1] for f in found}), total + 5
    assert hits / total >= 0.9
    assert [c for _, c, _ in got[100]] == [7, 101, 102, 103, 104]


def test_few_neighbours(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in op10_ann.nearest(table).collect())
    assert got == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert op10_ann.nearest(table.limit(0)).count() == 0
    assert op10_ann.nearest(table.limit(1)).count() == 0


def test_neighbours_of_any_magnitude(spark):
    tiny, huge = [1e-170, 2e-170], [1e200, 2e200]
    table = spark.createDataFrame([(0, tiny), (1, huge), (2, [2.0, 1.0]), (50, huge), (51, [5e-324, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in op10_ann.nearest(table).collect()}
    assert [got[0, i][0] for i in (1, 2, 3, 4)] == [1, 50, 2, 51] and [got[50, i][0] for i in (1, 2, 3, 4)] == [0, 1, 2, 51]
    assert got[0, 1][1] == pytest.approx(1) and got[0, 3][1] == pytest.approx(0.8)


def test_neighbours_in_cut_leaves_and_many_parts(spark, monkeypatch):
    """Leaves beyond a block and parts beyond the shuffle's give the same rows; a query meets each part once."""
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((40, 12)) * 4
    vectors = centres[rng.integers(0, 40, 2500)] + rng.standard_normal((2500, 12))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    options = dict(leaf=60, share=0.05, visits=30)
    whole = sorted(op10_ann.nearest(table, **options).collect())
    monkeypatch.setattr(op10_ann, "BLOCK", 16)
    monkeypatch.setattr(op10_ann, "PART_BYTES", 20_000)
    assert sorted(op10_ann.nearest(table, **options).collect()) == whole
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit[::50] @ unit.T
    near[np.arange(50), np.arange(0, 2500, 50)] = -2
    exact = {(q * 50, int(c)) for q, row in enumerate(near) for c in np.argsort(-row)[:5]}
    assert len(exact & {(r["query_id"], r["vec_id"]) for r in whole}) >= 0.9 * len(exact)


def test_words_split_like_bytes():
    texts = ["", " a b ", "x", " y z\x1c", "", "é\tü", "  "]
    found = words(pa.array(texts, pa.large_string()))
    raw = found.data.tobytes()
    assert [raw[a:b] for a, b in zip(found.starts, found.ends)] == [w for t in texts for w in t.encode().split()]
    assert found.counts.tolist() == [len(t.encode().split()) for t in texts]


def test_word_hashes_do_not_depend_on_the_text_around():
    long = "z" * (1 << 18) + "y"
    texts = ["Ab cd " * 60_000 + long, long + " cd", "ab", "cd"]
    for lower in (False, True):
        found = words(pa.array(texts, pa.large_string()))
        hashes, first = found.hashes(lower), found.first
        assert hashes[first[1]] == hashes[first[1] - 1] and hashes[first[1] + 1] == hashes[first[3]]
        assert set(hashes[1 : 120_000 : 2].tolist()) == {hashes[first[3]]}
        assert (set(hashes[0 : 120_000 : 2].tolist()) == {hashes[first[2]]}) == lower
