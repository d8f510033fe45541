"""The filter audit against a replay in plain Python."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from rillworks.llm import audit

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def brute(docs, labels):
    marks = {}
    for i, q, t in labels:
        if i is not None:
            old = marks.get(i, (0, 0))
            marks[i] = (max(old[0], q or 0), max(old[1], t or 0))
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, source in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        rows.append((source or "", {c for c, x in fails.items() if x}, *marks.get(i, (0, 0))))
    out, shares = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                gone = lambda f: next((n for n, x in enumerate(order, 1) if x in f), 6)  # noqa: E731, B023
                got = Counter({k: 0 for k in COUNTS})
                for f, good, toxic in own:
                    got["kept"] += gone(f) > step
                    got["removed"] += gone(f) == step
                    got["redundant"] += c in f and gone(f) < step
                    got["unique_fails"] += f == {c}
                    got["good_lost"] += gone(f) == step and good == 1
                    got["toxic_lost"] += gone(f) == step and toxic == 1
                shares[part, c] += got["removed"]
                out[part, order, step] = got
    for (part, order, step), got in out.items():
        got["shapley"] = shares[part, order[step - 1]]
    return {k: tuple(v[c] for c in COUNTS) for k, v in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in df.collect()}


def texts(rng):
    word = lambda: rng.choice(["a", "Bb", "CCC", "d", "é", "x1", "#", "y"] + [f"w{i}" for i in range(rng.choice([3, 400]))])
    return [rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.choice([0, 5, 199, 200, 300]))) for _ in range(40)]


def test_against_a_replay(spark):
    rng = random.Random(3)
    made = texts(rng) + [None, "", " \v ", "A" * 50, "word " * 200, "日本 " * 250]
    docs = [(i, rng.choice(made), rng.choice(["s", "s", "t", "", None])) for i in range(150)]
    docs += [(7, "again", "s"), (7, "again", "s"), (None, "again", "s"), (None, None, None), (3, docs[3][1], "u")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 150, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (10**6, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "'x' AS part", "1 AS kept", "2 AS quality", "3 AS id", "4 AS mask")
    assert got(audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'y' AS source"))) == brute(docs, labels)


def test_a_text_that_most_rows_share_and_a_very_long_one(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    docs = [(i, "the same text", "hot") for i in range(500)] + [(1000, long, "hot"), (1001, long, "other")]
    found = got(audit.audit(spark.createDataFrame(docs, "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")))
    assert found == brute(docs, [])
    assert found["hot", "EABCD", 1][1] == 499 and found["other", "EABCD", 1][1] == 1


def test_an_empty_table_gives_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_other_filters_and_marks(spark):
    flags = spark.createDataFrame([("p", 1, True), ("p", 3, False), ("p", 0, True)], "part string, mask int, good boolean")
    found = {(r["filter_order"], r["step"]): r for r in audit.replay(flags, "XY", {"lost": "good"}).collect()}
    assert [(found[k]["kept"], found[k]["removed"], found[k]["lost"], found[k]["shapley"]) for k in (("XY", 1), ("XY", 2), ("YX", 1), ("YX", 2))] == [(1, 2, 1, 3), (1, 0, 0, 1), (2, 1, 0, 1), (1, 1, 1, 3)]
    assert found["XY", 2]["redundant"] == 1 and found["XY", 1]["unique_fails"] == 1
    for letters in ("", "YX", "XX", "ABCDEFG"):
        with pytest.raises(ValueError, match="letters"):
            audit.replay(flags, letters, {})
