"""The n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest

from rillworks.llm import jaccard
from rillworks.llm.common import among


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.setdefault(i, set()).add(frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, k, percent):
    sets = sets_of(rows, k)
    top = {i: i for i in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for n, (i, s) in enumerate(flat):
        for j, t in flat[:n]:
            both = len(s & t)
            if 100 * both >= percent * (len(s) + len(t) - both):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def changed(rng, text, rate):
    return " ".join(f"v{rng.randint(0, 99)}" if rng.random() < rate else w for w in text.split())


def texts(rng):
    word = lambda: f"w{rng.randint(0, 300)}"
    bases = [" ".join(word() for _ in range(rng.randint(20, 150))) for _ in range(12)]
    out = [t for b in bases for t in [b, b.upper(), *[changed(rng, b, r) for r in (0.01, 0.02, 0.03, 0.05, 0.2)]]]
    passage = " ".join(word() for _ in range(60))
    out += [f"{passage} {' '.join(word() for _ in range(rng.randint(0, 60)))}" for _ in range(40)]  # a passage that many share
    chain = bases[0].split()
    for _ in range(30):  # each like the one before, the ends unlike
        chain[rng.randrange(len(chain))] = word()
        out.append(" ".join(chain))
    return out + [None, "", " ", "one", "One", "two words", "two  words", "a b c d", "a b c d e", "x " * 3000, "x " * 2999, "ß ß ß ß ß ß"]


@pytest.mark.parametrize(("k", "percent", "leaf"), [(4, 85, 4), (5, 80, 512), (3, 60, 8)])
def test_links(spark, monkeypatch, k, percent, leaf):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    rng = random.Random(k)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], "doc_id long, text string, n int, component_id string, cell int").repartition(4)
    found = {r["doc_id"]: r for r in jaccard.join(df, k=k, percent=percent).collect()}
    want, sets = brute(rows, k, percent), sets_of(rows, k)
    assert {i: r["component_id"] for i, r in found.items()} == want
    assert all(r["n_shingles"] == len(next(iter(sets[i]))) for i, r in found.items())
    assert len(set(want.values())) < len(rows) - 30


def test_a_large_group_in_parts(spark, monkeypatch):
    """Hundreds of changed copies of one text, alike in part only: cells of several tiles, strays in most."""
    monkeypatch.setattr(jaccard, "LEAF", 32)
    rng = random.Random(11)
    base = " ".join(f"w{rng.randint(0, 5000)}" for _ in range(120))
    rows = [(i, changed(rng, base, rng.choice([0.01, 0.03, 0.05, 0.08]))) for i in range(350)]
    found = {r["doc_id"]: r["component_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()}
    assert found == brute(rows, 4, 85)
    assert 10 < len(set(found.values())) < 340


def test_odd_rows(spark):
    long = [f"w{i % 70_000}" for i in range(150_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:-9_000])), (3, " ".join(long[:40_000])), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A b c d e f"), (6, "a b c d e f g"), (None, "a b c d e f"), (None, None)]
    found = sorted(((r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k=4, percent=85).collect()), key=str)
    n = {i: len(next(iter(s))) for i, s in sets_of([r for r in rows if r[0]], 4).items()}
    assert found == sorted([(1, 1, n[1]), (2, 1, n[2]), (3, 3, n[3]), (4, 4, 3), (4, 4, 3), (5, 4, 3), (6, 6, 4), (None, None, 3), (None, None, 0)], key=str)
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r["component_id"] for r in jaccard.join(spark.createDataFrame([(9, None)], "doc_id long, text string")).collect()] == [9]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(20):
        universe = rng.integers(0, 2**63, 400, dtype=np.uint64)
        one = np.unique(rng.choice(universe, 200))
        two = np.unique(np.concatenate([one[: rng.integers(0, len(one))], rng.choice(universe, 20)]))
        wide, own, more = jaccard.points(np.concatenate([one, two]), np.array([0, len(one), len(one) + len(two)]), 5, 85)
        both = len(np.intersect1d(one, two))
        assert both <= np.minimum(wide[0], wide[1]).sum() and wide.sum(1).tolist() == [len(one), len(two)]
        linked = 100 * both >= 85 * (len(one) + len(two) - both)
        assert not linked or both >= jaccard.needed(np.array(len(one)), np.array(len(two)), 85)
        groups, held = jaccard.expanded(own, 5)
        known, total = np.unique(groups, return_counts=True)
        of, cell = jaccard.cells(groups, held, np.array([len(one), len(two)]), known[total > 1], total[total > 1].astype(np.uint64), 85)
        extra, n = jaccard.expanded(more, 5)
        of, cell = np.concatenate([of, np.repeat([0, 1], n)]), np.concatenate([cell, extra | jaccard.OUTSIDE])
        assert not linked or len(np.intersect1d(cell[of == 0], cell[of == 1]))


def test_among(spark):
    df = spark.range(20_000).selectExpr("id AS k", "id % 7 AS other")
    ids = spark.range(100, 300).selectExpr("id AS k")
    found = {r["k"] for r in among(df, ids, "k").collect()}
    assert set(range(100, 300)) <= found and len(found) < 400
    assert among(df, ids.where("false"), "k").count() == 0
