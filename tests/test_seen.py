"""The levelled seen set."""

import random

import numpy as np
import pytest

from rillworks.streaming import seen
from rillworks.streaming.ingest import cycle

ARTICLE = "feed_idx int, entry_idx int, link string, source string, title string, summary string"


def test_ten_thousand_cycles_leave_a_logarithm_of_parts():
    parts, rewritten, most = [], 0, 0
    for batch in range(10_000):
        parts, merges = seen.levelled([*parts, {"name": str(batch), "level": 0, "n": 7}], batch)
        rewritten += sum(p["n"] for own in merges for p in own)
        most = max(most, len(parts))
    assert sum(p["n"] for p in parts) == 70_000
    assert most <= (seen.FAN - 1) * 7 and rewritten <= 70_000 * 7  # 4 ** 7 > 10,000
    assert len({p["name"] for p in parts}) == len(parts)


def test_filters_miss_nothing_and_hit_little():
    rng = np.random.default_rng(1)
    h, other = rng.integers(-(2**63), 2**63 - 1, 20_000), rng.integers(-(2**63), 2**63 - 1, 20_000)
    made = seen.filter_of(h)
    assert seen.maybe_in(made, h).all() and seen.maybe_in(made, other).mean() < 0.02
    assert not seen.maybe_in(seen.filter_of(h[:0]), other).any()
    assert [seen.buckets(n) for n in (0, 1, seen.BUCKET_ITEMS, seen.BUCKET_ITEMS + 1, 5 * seen.BUCKET_ITEMS)] == [1, 1, 1, 2, 8]


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(seen, "BUCKET_ITEMS", 3)


def test_cycles_are_a_plain_set_through_merges_expiry_and_repeats(spark, tmp_path, small):
    rng = random.Random(2)
    held, kept, plain, until = seen.SeenSet(spark, str(tmp_path / "seen"), 100), str(tmp_path / "log"), set(), None
    at = 0
    for batch in range(11):
        links = [f"u{rng.randint(0, 40)}" for _ in range(rng.randint(0, 9))]
        at += 150 if batch == 8 else 20
        if until is not None and at >= until:
            plain = set()
        rows = spark.createDataFrame([(0, i, x, "s", None, None) for i, x in enumerate(links)], ARTICLE)
        new = set(links) - plain
        for _ in range(2 if batch in (3, 5) else 1):  # the third makes a merge; a batch run again starts from the same state
            assert cycle(rows, batch, at, held, kept) == {"new": len(new), "seen": len(set(links)) - len(new), "total": len(set(links))}
        if new:
            plain |= new
            until = at + 100
        assert {r["item"] for r in held.alive(batch + 1, at).collect()} == plain
    assert len(held.versions()) <= 2
    parts = {p["name"] for p in held.parts(99, at)}
    assert parts <= {p.name.removeprefix("part=") for p in (tmp_path / "seen" / "items").iterdir()} and len(list((tmp_path / "seen" / "items").iterdir())) <= 2 * seen.FAN


def test_only_buckets_that_may_hold_an_item_are_read(spark, tmp_path, small):
    held = seen.SeenSet(spark, str(tmp_path / "seen"))
    held.add(spark.range(200).selectExpr("concat('u', id) AS item"), 0, 0)
    asked = spark.createDataFrame([("u5", 1), ("nowhere", 2), (None, 3)], "link string, n int")
    left = held.unseen(asked, "link", 1, 1)
    assert {r["n"] for r in left.collect()} == {2, 3}
    assert len([f for f in left.inputFiles() if "/items/" in f]) < 10 < seen.buckets(200)
