"""Class language model, vector codes and spelling variants against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from meterline.llm import op11_class_lm, op12_vector_codes, op13_spelling
from meterline.llm.text_arrays import words

SCHEMA = "doc_id long, text string, score string, n long"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(5)


def held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 7 == 2


# Class language model


def tokens_of(text):
    return [w.decode() for w in (text or "").translate(A_Z).encode().split()] + [None]


def brute_base(rows):
    seen = Counter()
    for doc_id, text in rows:
        if not held_out(doc_id):
            seen.update(tokens_of(text))
    n, v = sum(seen.values()), len(seen)
    return [(i, held_out(i), len(w := tokens_of(t)), sum(seen[x] > 0 for x in w), n, sum(math.log10((seen[x] + 1) / (n + 1 * (v + 1))) for x in w)) for i, t in rows]


def corpus(rng, n=300):
    """Two languages of their own words, in which word kinds take turns."""
    rows = []
    for i in range(n):
        language = rng.choice("ab")
        kinds = [[f"{language}{kind}{j}" for j in range(25)] for kind in "xyz"]
        rows.append((i, " ".join(rng.choice(kinds[j % 3]) for j in range(rng.randrange(60)))))
    odd = [(None, "ax1 ay1 new"), (900, None), (901, ""), (901, " \n\t"), (902, "AX1\x0bAY2  É é ax1"), (902, "z" * 5000 + " ax3"), (903, "ax1 ay2 az3 " * 3000)]
    return rows + odd + rows[:5]


@pytest.mark.parametrize("single,listed", [(1 << 14, 1 << 18), (20, 40), (0, 0)])
def test_class_scores_match_brute_force(spark, single, listed):
    rows = corpus(random.Random(3))
    got = op11_class_lm.class_scores(frame(spark, rows), classes=6, rounds=4, single=single, listed=listed).collect()
    want = sorted(brute_base(rows), key=str)
    have = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert [x[5] for x in have] == pytest.approx([x[5] for x in want], rel=1e-9)
    for r in got:
        assert r["score"] < 0 and r["perplexity"] == pytest.approx(10 ** (-r["score"] / r["n_tokens"]))
    if single > 100:  # word kinds take turns, which single words' frequencies do not tell
        assert sum(r["score"] for r in got if r["held_out"]) > 0.75 * sum(r["base_score"] for r in got if r["held_out"])


def model_of(rng, k=5, vocabulary=60, n=4000):
    text = [int(x) for x in rng.integers(0, vocabulary, n)]
    pairs = Counter(zip(text, text[1:] + text[:1]))
    return pairs, np.append(rng.integers(0, k, vocabulary - 1), k)


def class_pairs(pairs, of):
    out = np.zeros((of.max() + 1,) * 2)
    for (u, v), n in pairs.items():
        out[of[u], of[v]] += n
    return out


def test_the_exchange_gain_is_exact():
    """The class chosen for a unit is the one of largest likelihood when all pairs are counted anew."""
    pairs, of = model_of(np.random.default_rng(5))
    k = of.max()
    now = class_pairs(pairs, of)

    def whole(m):
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(m) - 2 * f(m.sum(axis=1))

    for unit in range(0, 59, 4):
        right, left = np.zeros(k + 1), np.zeros(k + 1)
        for (u, v), n in pairs.items():
            right[of[v]] += n * (u == unit)
            left[of[u]] += n * (v == unit)
        tried = []
        for c in range(k):
            other = of.copy()
            other[unit] = c
            tried.append(whole(class_pairs(pairs, other)))
        best = op11_class_lm.best_class(now, right, left, pairs[unit, unit], of[unit])
        assert tried[best] == pytest.approx(max(tried), abs=1e-6)


def test_exchange_never_ends_below_its_start_and_finds_kinds(spark):
    rng = random.Random(9)
    text = [rng.randrange(20) + 20 * (i % 3) for i in range(6000)]
    pairs = Counter([(60, text[0]), *zip(text, text[1:]), (text[-1], 60)])
    some = [np.array([(u, v, n) for (u, v), n in pairs.items()][i::3]).T for i in range(3)]  # as three tasks would count
    rows = spark.createDataFrame([tuple(r.values()) for x in some for r in op11_class_lm.packed(*x).to_pylist()], op11_class_lm.PACKED).repartition(3)
    of, counts = op11_class_lm.exchange(op11_class_lm.Run(spark, "test"), rows, 61, classes=3, rounds=12)
    start = np.append(np.arange(60) % 3, 3)
    assert op11_class_lm.likelihood(counts) > op11_class_lm.likelihood(class_pairs(pairs, start))
    assert np.array_equal(counts, class_pairs(pairs, of))
    assert all(len(set(of[20 * kind : 20 * kind + 20])) == 1 for kind in range(3)) and len(set(of)) == 4


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 30, 40)
    listed = op11_class_lm.Listed(np.arange(40), counts, np.arange(40))
    units = op11_class_lm.Units(listed, 40)
    of = np.arange(units.end + 1) % 4
    of[-1] = 4
    kinds = np.bincount(of[:40], minlength=5)
    pairs = np.zeros((5, 5))
    size = np.bincount(of[:40], weights=counts, minlength=5)
    size[4] = 25
    pairs[:, :] = np.outer(size, size) / size.sum()
    model = op11_class_lm.Model.of_counts(units, of, pairs, kinds, 41, 25)
    for before in range(5):
        known = 10 ** (model.transition[before, of[:40]] + model.emission(counts, of[:40]))
        unknown = 10 ** (model.transition[before, :4] + model.emission(np.zeros(4), np.arange(4)))
        assert known.sum() + unknown.sum() + 10 ** model.transition[before, 4] == pytest.approx(1)


def test_units_fold_case_and_digits():
    found = words(pa.array(["Ab12 xAC99 ab34 b", "ÉT1"], pa.large_string()))
    ends = op11_class_lm.endings(found)
    assert ends[0] == ends[2] and ends[0] != ends[1] and len(set(ends)) == 4 and ends.max() < op11_class_lm.ENDINGS


def test_class_scores_of_nothing(spark):
    assert op11_class_lm.class_scores(frame(spark, [(1, "a")]).limit(0)).count() == 0
    alone = [i for i in range(40) if held_out(i)][:2]
    rows = op11_class_lm.class_scores(frame(spark, [(alone[0], "a b"), (alone[1], None)])).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in rows] == [(0, 0, 0.0)] * 2 and all(r["score"] < 0 for r in rows)


# Vector codes


def brute_codes(rows, entries=256, rounds=4):
    kept = sorted(((i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[0])
    whole = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    w = len(whole[0]) // 4
    parts = [[tuple(v[p * w : p * w + w]) for v in whole] for p in range(4)]
    books = [list(own[:entries]) for own in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min((far(x, e), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(4):
            given = [near(p, x)[1] for x in parts[p]]
            for e in range(len(books[p])):
                own = [x for x, g in zip(parts[p], given) if g == e]
                if own:
                    books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    found = [[near(p, parts[p][r]) for p in range(4)] for r in range(len(kept))]
    error = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(kept, error):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((i, "".join(f"{e:02x}" for _, e in f), d, by_label[label], digest) for (i, _, label), f, d in zip(kept, found, error))


def vectors(rng, n, width=8):
    rows = [(3 * i - 50, [float(np.float32(x)) for x in rng.normal(0, 0.3, width)], int(rng.integers(0, 4)) if i % 7 else None) for i in range(n)]
    rows += [(5000, None, 1), (5001, [0.1] * 7 + [None], 1), (5002, [math.nan] * width, 2), (5003, [math.inf] * width, 2), (5004, [0.0] * width, 2)]
    rows += [(6000 + i, rows[i % min(9, n)][1], 3) for i in range(60)]
    return rows


@pytest.mark.parametrize("n,entries", [(400, 256), (400, 16), (3, 256)])
def test_codes_match_brute_force(spark, n, entries):
    rows = vectors(np.random.default_rng(n), n)
    df = spark.createDataFrame([(i, v, label, "clash") for i, v, label in rows], "vec_id long, embedding array<float>, label int, error string").repartition(4)
    got = op12_vector_codes.vector_codes(df, entries=entries)
    assert sorted(tuple(r) for r in got.drop("label").collect()) == brute_codes(rows, entries)


def test_codes_match_sql(spark):
    rows = vectors(np.random.default_rng(8), 300)
    df = spark.createDataFrame([(i, v, label) for i, v, label in rows], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in op12_vector_codes.vector_codes(df).drop("label").collect())
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert got == sorted(con.execute(op12_vector_codes.SQL).fetchall()) and len(got) > 300


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_orchard_search_finds_the_nearest_of_lowest_index(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread + 1, (200, 3))  # many equal and equally near ones
    points = rng.integers(-spread - 1, spread + 2, (5000, 3))
    far = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    at, distance = op12_vector_codes.Codebook(entries).nearest(points)
    assert np.array_equal(at, far.argmin(axis=1)) and np.array_equal(distance, far.min(axis=1))


def test_orchard_search_looks_at_few_entries_of_clusters(monkeypatch):
    rng = np.random.default_rng(2)
    centers = rng.integers(-10_000, 10_000, (250, 8))
    points = (centers[rng.integers(0, 250, 2000)] + rng.integers(-40, 41, (2000, 8))).astype(np.int64)
    met, plain = [], op12_vector_codes.squares
    monkeypatch.setattr(op12_vector_codes, "squares", lambda a, b: (met.append(len(a)), plain(a, b))[1])
    book = op12_vector_codes.Codebook(centers)
    met.clear()
    book.nearest(points)
    assert sum(met) < 0.5 * len(points) * len(centers)


def test_codes_of_odd_rows(spark):
    kind = "vec_id long, embedding array<double>, label int"
    codes = lambda rows: [tuple(r) for r in op12_vector_codes.vector_codes(spark.createDataFrame(rows, kind)).collect()]
    assert codes([]) == [] and codes([(1, None, 1), (2, [], 1)]) == []
    assert [r[:5] for r in codes([(7, [0.5, -0.5, 0.0], 1)])] == [(7, 1, "00000000", 0, 0)]  # three components in four parts
    twice = codes([(7, [1.0] * 4, None), (7, [1.0] * 4, None), (None, [2.0] * 4, 5), (8, [1.0] * 3, 5)])
    assert sorted(r[2] for r in twice) == ["00000000", "00000000", "02020202"]
    huge = codes([(i, [1e300 * (-1) ** i] * 4, 1) for i in range(3)])
    assert {r[3] for r in huge} == {0}


# Spelling variants


def brute_words(rows, length=6, count=5, every=199):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(A_Z)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= length and n >= count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(known):
    near = {w: [x for x in known if one_edit(w, x)] for w in known}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-known[x], x)) if xs else None
        form[w] = best if best and known[best] >= 5 * known[w] else None
    out = []
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, known[w], len(near[w]), form[w], known[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def misspelt(rng, n=220):
    letters = "abcdeéÿ÷z"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 12))) for _ in range(12)]
    rows = []
    for i in range(n):
        some = []
        for _ in range(40):
            w = rng.choice(base[: rng.choice([2, 12])])
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters[:3]) + w[at:], w[:at] + rng.choice(letters[:3]) + w[at + 1 :]])
            some.append(w.upper() if w.isascii() and rng.random() < 0.2 else w)
        rows.append((i, rng.choice([" ", "\n", "1", " - "]).join(some)))
    return rows + [(None, "Doppelt " * 7), (500, None), (501, ""), (502, "aaaaaa " * 9 + "aaaaaaa " * 50), (503, "x" * 3000 + " 12"), (503, "doppelt " * 3)] + rows[:3]


@pytest.mark.parametrize("crowd,block,every", [(1024, 128, 199), (3, 128, 7), (1024, 2, 3)])
def test_variants_match_brute_force(spark, monkeypatch, crowd, block, every):
    monkeypatch.setattr(op13_spelling, "CROWD", crowd)
    monkeypatch.setattr(op13_spelling, "BLOCK", block)
    rows = misspelt(random.Random(crowd + block))
    got = op13_spelling.spelling_variants(frame(spark, rows), every=every).select("word", "n", "n_near", "form", "form_n", "root")
    want = brute_variants(brute_words(rows, every=every))
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len(want) > 100 and any(x[3] for x in want) and any(x[5] not in (x[0], x[3]) for x in want)


def test_variants_match_sql(spark):
    rows = misspelt(random.Random(77))
    rows = [r for r in rows if r[0] is not None]
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).toArrow())
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    got = op13_spelling.spelling_variants(frame(spark, rows)).select(columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({op13_spelling.SQL})").fetchall(), key=str)


def test_a_family_of_many_words_is_whole(spark, monkeypatch):
    """All words share all but three places; groups are far over the crowd, and none is left out."""
    monkeypatch.setattr(op13_spelling, "CROWD", 8)
    family = {f"stem{a}{b}ing{c}": 5 + i for i, (a, b, c) in enumerate((a, b, c) for a in "abcdefg" for b in "abcdefg" for c in "stuvw")}
    df = spark.createDataFrame(list(family.items()), "word string, n long")
    run = op13_spelling.Run(spark, "test")
    pairs = [(r["a"], r["b"]) for r in op13_spelling.pairs_of(run, run.keep(df)).collect()]
    assert len(pairs) == len({frozenset(p) for p in pairs})
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in family for b in family if one_edit(a, b)}


def test_variants_of_nothing_and_of_long_words(spark):
    assert op13_spelling.spelling_variants(frame(spark, [(1, "a")]).limit(0)).count() == 0
    long = "ab" * 40_000
    rows = [(1, f"{long} " * 5), (2, f"{long}c " * 30), (3, f"x{long[1:]} " * 6)]
    got = {r["word"]: (r["n_near"], r["form"]) for r in op13_spelling.spelling_variants(frame(spark, rows), every=10**12).collect()}
    assert got == {long: (2, f"{long}c"), f"{long}c": (1, None), f"x{long[1:]}": (1, None)}
