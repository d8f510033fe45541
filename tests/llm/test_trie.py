"""The prefix trie against one built in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from rillworks.llm import trie
from rillworks.llm.common import stored

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", sha(text or ""), text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, seq in full.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for key in members:
        if key:
            children.setdefault(key[:-1], []).append(key)
    under = {}
    for key in sorted(members, key=len, reverse=True):
        below = [under[k] for k in children.get(key, [])]
        saved = (len(members[key]) - 1) * len(key[-1][1]) if key else 0
        under[key] = (sum(b[0] for b in below) or int(not below), saved + sum(b[1] for b in below))
    ends = lambda key: ",".join(str(c) for c in sorted(members[key]) if full[c] == key)
    return sorted((min(m), len(key), min(members[key[:-1]]) if key else None, len(m), len(children.get(key, [])), *under[key], sha(ends(key))) for key, m in members.items())


def of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def query(df, **more):
    ids, turns = trie.rebuilt(stored(trie.turns_of(df), "placed"))
    return trie.trie(ids, turns, ["own", "place"], **more)


def conversations(rng):
    some = [("user", "hi"), ("bot", "hi"), (None, "hello"), ("", "hello"), ("user", None), ("bot", "ok é日"), ("user", "more")]
    rows = []
    for c in [*range(0, 40), *range(250, 290), 400, -3, -100, -101]:
        shape = [rng.choice(some[: rng.choice([2, 3, 7])]) for _ in range(rng.randint(1, 7))]
        places = [rng.choice([None, i, i, i]) for i in range(len(shape))]
        rows += [(c, p, *s) for p, s in zip(places, shape, strict=True)]
    rows += [(c, i, "user", f"turn {i}") for c in (500, 501, 502) for i in range(8)]  # copies
    rows += [(7, 3, "user", "twice")] * 2 + [(None, 1, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_trie(spark, seed):
    rows = conversations(random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS place", "3 AS depth", "'x' AS digest", "4 AS f0")
    found = of(query(df))
    assert found == brute(rows)
    assert any(r[1] == 0 and r[2] is None and r[3] == 87 for r in found)


def test_colliding_fingerprints_are_split(spark):
    rows = conversations(random.Random(3))
    assert of(query(spark.createDataFrame(rows, SCHEMA), primes=(3,))) == brute(rows)


def test_a_conversation_that_holds_most_rows(spark):
    rng = random.Random(5)
    rows = [(207, i, "user", f"t{i}") for i in range(3_000)] + [(208, i, "user", f"t{i}") for i in range(3_000)] + [(c, 0, "user", f"t{c % 3}") for c in range(200, 260)]
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = query(spark.createDataFrame(rows, SCHEMA).repartition(4))
        ranges = trie.scanned(stored(spark.createDataFrame([(i % 2, i) for i in range(4_000)], "id long, x long"), "t"), [trie.F.desc("x")], [("x", 1, 0), ("x2", 7, 1_000_003)][:1]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert of(found) == brute(rows)
    for own in (0, 1):
        xs = sorted((r["x"] for r in ranges if r["id"] == own), reverse=True)
        sums = dict(zip(xs, np.cumsum(xs), strict=True))
        assert all(r["x_sum"] == sums[r["x"]] and r["x_before"] == sums[r["x"]] - r["x"] and r["place"] == xs.index(r["x"]) + 1 for r in ranges if r["id"] == own)


def test_very_long_texts_and_an_empty_table(spark):
    rows = [(1, 1, "user", "x" * 3_000_000), (2, 1, "user", "x" * 3_000_000), (3, 1, "user", "x" * 2_999_999), (0, 1, "user", ""), (0, 2, "", "user")]
    assert of(query(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert query(spark.createDataFrame([], SCHEMA)).count() == 0
    assert of(query(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA))) == []


def test_fingerprints_are_polynomials():
    rng = np.random.default_rng(1)
    values, ids = rng.integers(-(2**62), 2**62, 500), np.repeat([3, 5, 9], [100, 1, 399])
    sums = trie.Sums([("x", 31, 1_000_003)])
    found = [sums.of(ids[lo:hi], [values[lo:hi]]) for lo, hi in ((0, 50), (50, 51), (51, 200), (200, 500))]
    place, own = np.concatenate([f[0] for f in found]), np.concatenate([f[1][0] for f in found])
    for i in range(500):
        row = [j for j in range(500) if ids[j] == ids[i] and j <= i]
        assert place[i] == len(row)
        assert own[i] == sum(int(values[j]) * pow(31, n, 1_000_003) for n, j in enumerate(row, 1)) % 1_000_003
