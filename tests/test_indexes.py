"""Stored indexes of vectors and texts."""

import random
import re

import numpy as np
import pytest

from rillworks.operators import text_index
from rillworks.operators.text_index import TextIndex, grams
from rillworks.operators.vector import similar
from rillworks.operators.vector_index import Index


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 24)) * 4
    rows = [(i, (centres[i % 40] + rng.normal(size=24)).tolist()) for i in range(2_000)] + [(5_000, [0.0] * 24), (5_001, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    return df, Index.build(df, str(tmp_path_factory.mktemp("index")))


def pairs(df):
    return {(r["query_id"], r["id"]): round(r["similarity"], 9) for r in df.collect()}


def test_cells_grow_and_bounds_make_it_exact(spark, clustered, tmp_path):
    df, index = clustered
    asked = df.where("vec_id % 50 = 0 and vec_id < 5000")
    assert index.cells().count() == 23 and index.rows().count() == 2_000
    assert pairs(index.search(asked, 10, exact=True)) == pairs(similar(asked, df.where("vec_id < 5000"), 10))


def test_few_partitions_are_read_where_vectors_have_structure(clustered):
    df, index = clustered
    asked = df.where("vec_id % 50 = 0 and vec_id < 5000")
    found = index.search(asked, 10)
    best = pairs(similar(asked, df.where("vec_id < 5000"), 10))
    assert len(best.keys() & pairs(found).keys()) >= 0.9 * len(best)
    assert index.probes() < 23 / 2
    from pyspark.sql import functions as F

    units = asked.select(F.col("vec_id").alias("query_id"), "embedding")
    from rillworks.operators.vector_index import unit

    near = index.near(units.select("query_id", unit(F.col("embedding")).alias("q")))
    visited = index.open(near, index.search(asked, 10), 10, index.probes()).count() / asked.count() + index.probes()
    assert visited < 23 / 2  # with the bounds' further cells as well
    one = index.search(asked.where("vec_id = 0"), 10)
    assert "dynamicpruning" in one._jdf.queryExecution().toString()


def test_odd_vectors(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, [0.0, 0.0])], "vec_id long, embedding array<double>")
    index = Index.build(rows, str(tmp_path / "few"), k=2)
    assert [(r["id"], r["rank"]) for r in index.search(rows.where("vec_id = 1"), 5, exact=True).orderBy("rank").collect()] == [(2, 1), (3, 2)]
    empty = Index.build(rows.limit(0), str(tmp_path / "none"))
    assert empty.search(rows.where("vec_id = 1"), 5, exact=True).count() == 0


def test_grams():
    assert grams(b"abcabc").tolist() == sorted({0x616263, 0x626361, 0x636162}) and not len(grams(b"ab"))


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß日 ") for _ in range(rng.randint(1, 7)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 60))), rng.choice([None, "src", "Other"])) for i in range(1_500)] + [(9_000, None, None), (9_001, "The NEEDLE, once", "x"), (9_002, "x" * 200_000 + "needLE", "")]
    df = spark.createDataFrame(rows, "id long, text string, source string")
    monkeypatch_module = pytest.MonkeyPatch()
    monkeypatch_module.setattr(text_index, "TEXTS", 50)
    yield rows, TextIndex.build(df, str(tmp_path_factory.mktemp("texts")), "id", ["text", "source"])
    monkeypatch_module.undo()


@pytest.mark.parametrize("asked", ["Needle", "OTHER", "a", "", "é", "日 a", "ßb", "nothing like it", "abc", "e d"])
def test_a_search_is_contains(texts, asked):
    rows, index = texts
    want = {i for i, *cs in rows if any(c is not None and asked.lower() in c.lower() for c in cs)}
    assert {r["id"] for r in index.search(asked).collect()} == want


def test_a_rare_text_reads_few_partitions(texts):
    rows, index = texts
    chosen = index.rarest("needle")
    parts = {r["part"] for r in index.candidates(chosen).collect()}
    assert len(chosen) <= 4 and index.meta["parts"] == 31 and len(parts) <= 2
    found = index.search("needle")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 2 and re.search(r"PartitionFilters: \[.*part#\d+ (IN|=)|PartitionFilters: \[.*part#\d+L? = ", plan)
    assert index.rarest("nothing like it") is None


def test_grams_are_held_for_few_texts_at_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "ROWS", 2)
    df = spark.createDataFrame([(i, f"text {i:03}") for i in range(9)], "id long, text string").coalesce(1)
    index = TextIndex.build(df, str(tmp_path / "few"), "id", ["text"])
    assert [r["id"] for r in index.search("T 007").collect()] == [7] and index.search("text").count() == 9


def test_lists_have_a_row_for_a_gram_of_some_texts(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i:03}") for i in range(60)] + [(77, None)], "id long, text string").coalesce(1)
    index = TextIndex.build(df, str(tmp_path / "packed"), "id", ["text"])
    lists, sizes = spark.read.parquet(f"{index.path}/lists"), spark.read.parquet(f"{index.path}/sizes")
    held = sizes.where(f"gram = {0x746578}").first()["n"]
    assert held == 60 and lists.count() < sizes.agg({"n": "sum"}).first()[0] / 2
    assert index.candidates(index.rarest("text")).count() == 60 and [r["id"] for r in index.search("t 059").collect()] == [59]
