"""Nearest neighbours and the Jaccard join against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from photospark.llm import jaccard, neighbours


def nearest(rows, k):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for q, x in {i: v for i, v in good if i % 100 == 0}.items():
        near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q and len(x) == len(y))[:k]
        out.update((q, r, i, round(d, 9)) for r, (d, i) in enumerate(near, 1))
    return out


def test_neighbours_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(1).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[100][1]) for i in range(60)]
    rows += [(3000, None), (3100, [0.0] * 8), (3200, [float("nan")] * 8), (3300, [1.0, None] * 4), (3400, [1.0, 2.0]), (3401, [1.0, 3.0]), (3500, []), (None, [1.0] * 8)]
    rows += [(3600, [1e30] * 8), (3700, [1e-30] * 8), (3800, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, dim int, row string").repartition(5)
    got = neighbours.search(df.filter("vec_id % 100 = 0"), df, 10, query_block=5, candidate_block=100)
    assert {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect()} == nearest(rows, 10)


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame([(0, [1.0]), (100, [2.0]), (5, [4.0])], "vec_id int, embedding array<float>")
    got = sorted(tuple(r)[:3] for r in neighbours.search(df.filter("vec_id % 100 = 0"), df).collect())
    assert got == [(0, 1, 100), (0, 2, 5), (100, 1, 0), (100, 2, 5)]
    assert neighbours.search(df.limit(0), df).count() == 0
    assert neighbours.search(df, df.limit(0)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 64)), rng.normal(size=(70, 64)) * 5
    (a, s, la, ea), (b, t, lb, eb) = neighbours.quantise(x), neighbours.quantise(y)
    about = np.sqrt(la[:, None] ** 2 + lb[None] ** 2 - 2 * (a.astype(int) @ b.astype(int).T) * s[:, None] * t[None])
    true = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2))
    assert (np.abs(true - about) <= ea[:, None] + eb[None] + 1e-9).all()


def similar(texts, threshold=0.8):
    sets = {}
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    group, links, holders = {d: d for d in sets}, dict.fromkeys(sets, 0), defaultdict(list)

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for d in sorted(d for d in sets if sets[d]):
        for e, k in Counter(e for g in sets[d] for e in holders[g]).items():
            if k >= threshold * (len(sets[d]) + len(sets[e]) - k) - 1e-9:
                links[d] += 1
                links[e] += 1
                a, b = find(d), find(e)
                group[max(a, b)] = min(a, b)
        for g in sets[d]:
            holders[g].append(d)
    return {d: (find(d), links[d]) for d in sets}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]

    def edit(x, k):
        x = list(x)
        for _ in range(k):
            x[rng.randrange(len(x))] = rng.choice(words)
        return x

    base, passage = [rng.choice(words) for _ in range(200)], [rng.choice(words) for _ in range(60)]
    out = [edit(base, rng.randrange(5)) for _ in range(350)] + [base] * 40
    out += [[rng.choice(words) for _ in range(40)] + passage + [rng.choice(words) for _ in range(60)] for _ in range(150)]
    for _ in range(120):
        b = [rng.choice(words) for _ in range(rng.randrange(3, 200))]
        out += [edit(b, rng.randrange(4)) for _ in range(rng.randrange(1, 5))]
    chain = [rng.choice(words) for _ in range(150)]
    for _ in range(12):
        chain = edit(chain, 3)
        out.append(chain)
    rng.shuffle(out)
    return dict(enumerate([" ".join(x) for x in out] + [None, "", "too short here", " \n"]))


def test_links_and_groups_of_large_and_small_groups(spark, texts):
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in texts.items()], "doc_id bigint, text string, unit int, rep string").repartition(4)
    rows = jaccard.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == similar(texts)
    assert len(rows) == len(texts)
    kept = {r["doc_id"] for r in jaccard.keep_one(df).collect()}
    assert kept == {d for d, (c, _) in similar(texts).items() if c == d}


def test_splits_and_blocks_lose_no_link(spark, texts, monkeypatch):
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(jaccard, "SMALL", 40)
    monkeypatch.setattr(jaccard, "UNIT", 100)
    monkeypatch.setattr(jaccard, "GRAMS", 15_000)
    rows = jaccard.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == similar(texts)


def test_common_grams_of_many_pairs():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.choice(6000, rng.integers(1, 90)).astype(np.int64) * rng.integers(1, 3)) for _ in range(1300)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    i, j = rng.integers(0, 1300, (2, 20_000))
    i, j = i[i != j], j[i != j]
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)]
    assert jaccard._common(i, j, np.concatenate(sets), off).tolist() == want


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.near_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 2, 0)]
    assert sorted(map(tuple, jaccard.keep_one(df).collect())) == [(1, "a b c d e f"), (2, None)]
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = spark.createDataFrame([(5, a), (5, b), (2, a), (7, b), (None, a), (None, "x"), (9, None)], "doc_id bigint, text string").repartition(3)
    kept = sorted(map(tuple, jaccard.keep_one(rows).collect()), key=str)
    assert kept == sorted([(2, a), (5, b), (None, "x"), (9, None)], key=str)
    assert jaccard.keep_one(rows.limit(0)).count() == 0
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_recall_is_reached_by_the_runs():
    runs = jaccard.runs_needed(0.8, jaccard.RECALL)
    nodes = jaccard.tree(runs)
    assert all(len(set(p)) == len(p) for p in nodes) and len(set(nodes)) == len(nodes)
    rng = np.random.default_rng(3)
    met = rng.random((20_000, jaccard.TOKENS)) < 0.8
    deepest = [p for p in nodes if len(p) == jaccard.DEPTH]
    assert np.any([np.all(met[:, p], axis=1) for p in deepest], axis=0).mean() >= 0.9999


@pytest.mark.parametrize("threshold", [0.8, 0.6, 0.5, 0.3])
def test_pairs_left_unverified_are_rarer_than_the_recall_allows(threshold):
    least = jaccard.least_equal(threshold, jaccard.RECALL)
    rng = np.random.default_rng(4)
    equal = rng.binomial(jaccard.TOKENS, threshold, 1_000_000)
    assert (equal < least).sum() <= 2
    assert threshold != 0.8 or least == 12


def test_links_at_a_low_threshold(spark):
    rng = random.Random(6)
    out = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(90)]
        for _ in range(3):
            x = list(base)
            for _ in range(rng.randrange(1, 6)):
                x[rng.randrange(len(x))] = f"w{rng.randrange(5000)}"
            out.append(" ".join(x))
    texts = dict(enumerate(out))
    rows = jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string"), threshold=0.5).collect()
    assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == similar(texts, 0.5)
