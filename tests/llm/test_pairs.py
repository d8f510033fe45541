"""Near-duplicates and nearest neighbours, against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillworks.llm import ann, neardup


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.setdefault(i, []).append(frozenset(zip(*[w[j:] for j in range(k)], strict=False)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, k):
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
            if 100 * both >= 80 * (len(s) + len(t) - both):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def family(rng, base, n, rate):
    words = base.split()
    return [" ".join(rng.choice(["new", "other", f"v{rng.randint(0, 99)}"]) if rng.random() < rate else w for w in words) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 400)}"
    bases = [" ".join(word() for _ in range(rng.randint(30, 120))) for _ in range(15)]
    out = [t for b in bases for t in [b, b.upper(), *family(rng, b, 5, 0.02), *family(rng, b, 5, 0.06)]]
    out += family(rng, bases[0], 60, 0.05)  # a large group, many of it alike in part only
    return out + [None, "", " ", "one", "One", "two words", "two  words", "a b c d", "a b c d e", "x " * 3000, "x " * 2999, "ß ß ß ß ß ß"]


@pytest.mark.parametrize("k", [4, 5])
def test_links(spark, texts, k):
    rows = list(enumerate(texts))
    random.Random(k).shuffle(rows)
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, n int, component string")
    got = {r["doc_id"]: r for r in neardup.link(df, k=k).collect()}
    want, sets = brute(rows, k), sets_of(rows, k)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) and r["n_shingles"] == len(sets[i][0]) for i, r in got.items())
    assert len(set(want.values())) < len(rows) - 60


def test_links_of_very_long_texts(spark):
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near, other = list(words), list(words)
    near[1000:1100] = ["new"] * 100
    other[::3] = ["other"] * 50_000
    rows = list(enumerate([" ".join(words), " ".join(near), " ".join(other), "abc def " * 150_000, "abc def " * 149_000, "x" * 1_000_000, "X" * 1_000_000]))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    want, sets = brute(rows, 4), sets_of(rows, 4)
    assert got == {i: (len(sets[i][0]), want[i]) for i in want}
    assert [got[i][1] for i in range(7)] == [0, 0, 2, 3, 3, 5, 5]


def test_links_against_sql(spark, sf_dir, duck):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.op3_near_dedup(spark, sf_dir).collect())
    assert got == sorted(duck.execute(neardup.ORACLE["op3_near_dedup"]).fetchall())


def test_links_of_strays_in_one_bucket(spark, monkeypatch):
    """All in one bucket, whatever the registers: links outside the leaders' stars are found too, in blocks of a few."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(8)
    chain, w = [], [f"c{i}" for i in range(60)]
    for i in range(14):  # each is like its neighbours only
        chain.append(" ".join(w))
        for j in range(4):
            w[(i * 4 + j) % 60] = f"n{i}x{j}"
    rows = list(enumerate(chain + [" ".join(f"u{rng.randint(0, 999)}" for _ in range(60)) for _ in range(4)]))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.link(df, k=4).collect()} == brute(rows, 4)


def test_a_large_bucket_of_members_that_are_not_alike(spark, monkeypatch):
    """Texts that share half their words fill large buckets; a few of them are alike. No pair of the others is compared, and no link is lost."""
    monkeypatch.setattr(neardup, "BLOCK", 30)
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(70)]
    rows = []
    for i in range(600):
        own = [f"o{i}x{j}" for j in range(30)]
        rows.append((i, " ".join(shared + own)))
        if i % 20 == 0:
            own[29] = "changed"
            rows.append((1000 + i, " ".join(shared + own)))
    rng.shuffle(rows)
    looked = []
    compared = neardup._compared

    def counted(docs, nodes, rest, *more):
        looked.append(rest.groupBy("band").agg(F.count_if("stray").alias("s"), F.count("*").alias("n")).agg(F.sum(F.col("s") * F.col("n")).alias("p")).first()["p"] or 0)
        return compared(docs, nodes, rest, *more)

    monkeypatch.setattr(neardup, "_compared", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in neardup.link(df, k=4).collect()}
    assert got == {i: (i - 1000 if i >= 1000 else i) for i, _ in rows}
    assert len(looked) > 1 and sum(looked) < 0.5 * 600 * 600


def test_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(3, long), (3, long), (1, long + " x"), (None, long), (None, None), (7, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in neardup.link(df).collect())
    assert [g for g in got if g[0] != "None"] == [("1", 1, True), ("3", 1, False), ("3", 1, False), ("7", 7, True)]
    assert [g[1:] for g in got if g[0] == "None"] == [(None, True)] * 2
    assert neardup.link(df.limit(0)).count() == 0


def test_registers_estimate_and_merge():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**63, 2000).astype(np.uint64) for _ in range(2))
    one, two = np.unique(np.concatenate([a[:1600], b[:400]])), np.unique(np.concatenate([a[:1600], b[400:800]]))
    first = lambda x: np.array([0, len(x)])
    x, y = neardup.registers(one, first(one))[0], neardup.registers(two, first(two))[0]
    assert abs((x == y).mean() - 2 / 3) < 0.12
    union = np.union1d(one, two)
    assert (np.maximum(x, y) == neardup.registers(union, first(union))[0]).all()
    small = np.array([5], np.uint64)
    both = neardup.registers(np.concatenate([one, small]), np.array([0, len(one), len(one), len(one) + 1]))
    assert (both[0] == x).all() and (both[1] == 0).all() and (both[2] == neardup.registers(small, first(small))[0]).all()


def test_likelihood_keeps_and_drops():
    n, m = np.array([1000.0]), neardup.REGISTERS
    assert neardup.likely(np.array([m * 0.1]), np.array([m * 0.1]), m, n, n, 0.8)[0]
    assert not neardup.likely(np.array([m * 0.3]), np.array([m * 0.3]), m, n, n, 0.8)[0]


def test_components(spark):
    rng = random.Random(1)
    for shape in ([(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)], []):
        top = {}
        root = lambda v: v if top.get(v, v) == v else root(top[v])  # noqa: B023, E731
        for a, b in shape:
            p, q = root(a), root(b)
            top[max(p, q)] = min(p, q)
        nodes = {v for e in shape for v in e}
        got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(shape, "a long, b long")).collect()}
        assert got == {v: root(v) for v in nodes if root(v) != v}


# op5


def vectors(seed=0, n=600, d=24):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * rng.uniform(0.5, 2, (n, 1))
    x[100:220] = x[100]  # many equal vectors
    return x.astype(np.float32)


def nearest(ids, x, q, k):
    s = np.array([sum(float(a) * float(b) for a, b in zip(x[i], x[q], strict=True)) for i in range(len(ids))])
    order = sorted((i for i in range(len(ids)) if ids[i] != ids[q]), key=lambda i: (-s[i], ids[i]))[:k]
    return [(ids[i], s[i]) for i in order]


def test_search(spark):
    x = vectors()
    rows = [(i, [float(v) for v in x[i]], 0.5) for i in range(len(x))]
    odd = [(10_000, None, 0.0), (10_020, [0.0] * 24, 0.0), (10_040, [float("nan")] * 24, 0.0), (10_060, [None] + [1.0] * 23, 0.0), (10_080, [1.0, 2.0], 0.0), (10_100, [float("inf")] * 24, 0.0), (10_120, [], 0.0), (None, rows[0][1], 0.0), rows[40], rows[20]]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, score double")
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, rerank=150).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20)) and all(len(v) == 20 for v in got.values())
    hits = 0
    for q, found in got.items():
        want = nearest(list(range(600)), x, q, 20)
        truth = dict(nearest(list(range(600)), x, q, 600))
        assert all(abs(truth[i] - s) < 1e-9 for i, s in found)
        assert found == sorted(found, key=lambda p: (-p[1], p[0]))
        hits += len({i for i, _ in want} & {i for i, _ in found})
    assert hits >= 0.95 * 20 * len(got)
    assert [i for i, _ in got[120]][:5] == [100, 101, 102, 103, 104] or x[120] @ x[120] < max(x @ x[120])


def test_search_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["rank"], r["score"]) for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1, 0.5), (2, 2, -1.0)]
    assert ann.search(df, F.lit(False)).count() == 0
    assert ann.search(df.limit(0), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.lit(True)).count() == 0


def test_cells_are_visited_as_far_as_recall_asks(spark, monkeypatch):
    """Distinct vectors in clusters: few cells hold the nearest. Vectors without structure: most must be visited."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 24)) * 3
    near = centres[np.arange(3000) % 60] + rng.standard_normal((3000, 24)) * 0.6
    far = rng.standard_normal((3000, 24))
    visited = []
    real = ann.probes
    monkeypatch.setattr(ann, "probes", lambda *a: visited.append((real(*a), len(a[1]))) or visited[-1][0])
    for x in (near, far):
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()}
        truth = ann.search(df, F.col("vec_id") % 20 == 0, exact=True).collect()
        scores = x[::20] @ x.T
        scores[np.arange(150), np.arange(0, 3000, 20)] = -np.inf
        want = {(20 * q, int(i)) for q in range(150) for i in np.argsort(-scores[q])[:20]}
        assert {(r["query_id"], r["vec_id"]) for r in truth} == want
        assert len(got) == len(want) and len(got & want) >= 0.93 * len(want)
    assert visited[0][0] < 0.25 * visited[0][1] and visited[1][0] > 0.4 * visited[1][1]


def test_queries_that_lie_unlike_the_other_vectors(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((50, 24))[np.arange(6000) % 50] + rng.standard_normal((6000, 24)) * 0.3
    x[::20] = rng.standard_normal((300, 24))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]) for r in ann.search(df, F.col("vec_id") % 20 == 0).collect()}
    scores = x[::20] @ x.T
    scores[np.arange(300), np.arange(0, 6000, 20)] = -np.inf
    want = {(20 * q, int(i)) for q in range(300) for i in np.argsort(-scores[q])[:20]}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_every_query_gets_k(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((30, 6)) * 0.01 + 9, rng.standard_normal((30, 6)) * 0.01 - 9, rng.standard_normal((3, 6))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    assert ann.search(df, F.col("vec_id") % 20 == 0, 62, recall=0.1).count() == 4 * 62


def test_blocks_agree(spark, monkeypatch):
    x = vectors(3, 300)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, 5, rerank=299).collect()))
    monkeypatch.setattr(ann, "CODE_BLOCK", 70)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 4)
    assert sorted(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0, 5, rerank=299).collect())) == whole


def test_beam_is_no_worse_than_greedy():
    x = vectors(5, 400)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.learn(x, 6, 32)
    error = lambda beam: ((x - sum(books[m][c] for m, c in enumerate(ann.encode(x, books, beam).T))) ** 2).sum()
    assert error(6) <= error(1) * 1.001 and error(6) < 0.6 * (x**2).sum()


def test_best_breaks_ties_by_id():
    ids = np.array([9, 3, 7, 1, 5])
    assert list(ids[ann.best(np.array([1.0, 2.0, 1.0, 1.0, 1.0]), ids, 3)]) == [3, 1, 5]
    assert isinstance(ann.vectors(pa.array([[1.0, 2.0]])), np.ndarray)
