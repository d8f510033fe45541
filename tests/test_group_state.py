"""Group state by deltas, sketches of members, and kept pages."""

import random

import pytest
from pyspark.sql import functions as F

from rillworks.operators import log, pages, sample
from rillworks.operators.group_state import FAN, GroupState

DELIVERY = "stream string, group_name string, consumer string, id_ms long, id_seq long"
ACK = "stream string, group_name string, id_ms long, id_seq long"
LOG = "stream string, id_ms long, id_seq long, payload string"


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.collect())


def test_reports_are_those_of_all_history_and_read_few_deltas(spark, tmp_path):
    rng = random.Random(1)
    state, given, acks, made = GroupState(spark, str(tmp_path)), [], [], []
    for n in range(FAN * 2 + 1):
        new = [(rng.choice("ab"), rng.choice("gh"), rng.choice("xyz"), n, i) for i in range(rng.randint(0, 8))]
        waits = [(s, g, ms, q) for s, g, _, ms, q in given + new if (s, g, ms, q) not in set(acks)]
        done = rng.sample(waits, len(waits) // 2) + [("a", "g", 999, 999)]  # the last one is never given
        log_rows = [(s, n, i, "") for s in "ab" for i in range(rng.randint(0, 9))]
        for _ in range(2 if n in (2, FAN - 1, FAN) else 1):  # applied again, compactions included
            state.apply(n, spark.createDataFrame(new, DELIVERY), spark.createDataFrame(done, ACK), spark.createDataFrame(log_rows, LOG))
        given, acks, made = given + new, acks + done, made + log_rows
    whole = spark.createDataFrame(given, DELIVERY), spark.createDataFrame(acks, ACK)
    want = log.group_summary(spark.createDataFrame(made, LOG), *whole)
    got = state.summary()
    assert rows(got.select(want.columns)) == rows(want)
    assert rows(state.pending().select("stream", "group_name", "consumer", "id_ms", "id_seq")) == rows(log.pending(*whole).select("stream", "group_name", "consumer", "id_ms", "id_seq"))
    read = {f.split("/")[-3] for f in got.inputFiles()}
    assert read == {f"state={FAN * 2 - 1}", f"delta={FAN * 2}"}
    assert len(list((tmp_path).iterdir())) <= FAN + 4 and len(list((tmp_path / "meta").iterdir())) <= 2


def test_a_new_group_is_empty(spark, tmp_path):
    state = GroupState(spark, str(tmp_path))
    assert state.pending().count() == 0 and state.summary().count() == 0


def test_samples_do_not_depend_on_partitions_and_merge(spark):
    df = spark.range(3_000).select((F.col("id") % 700).alias("m")).unionAll(spark.createDataFrame([(None,)], "m long"))
    whole = [tuple(r) for r in sample.bottom_k(df, "m", 20, 5).collect()]
    assert len({m for m, _ in whole}) == 20 and whole == sorted(whole, key=lambda r: r[1])
    assert whole == [tuple(r) for r in sample.bottom_k(df.repartition(7), "m", 20, 5).collect()]
    halves = [sample.bottom_k(df.where(c), "m", 20, 5) for c in ("m < 400", "m >= 300")]
    assert whole == [tuple(r) for r in sample.merged(halves[0].unionAll(halves[1]), 20).collect()]
    assert sample.bottom_k(df.where("m < 6"), "m", 20).count() == 6 and sample.bottom_k(df.where("false"), "m", 3).count() == 0 and sample.bottom_k(df, "m", 0).count() == 0
    assert abs(sample.distinct_estimate(sample.bottom_k(df, "m", 200), 200) / 700 - 1) < 0.25
    assert sample.distinct_estimate(sample.bottom_k(df.where("m < 6"), "m", 20), 20) == 6


def test_samples_are_unbiased(spark):
    """Over many seeds each member is drawn about as often, however many rows it has."""
    df = spark.createDataFrame([(m,) for m in range(20) for _ in range(1 + 30 * (m == 0))], "m int")
    seeds = spark.range(400).select(F.col("id").alias("seed"))
    drawn = df.distinct().crossJoin(seeds).withColumn("h", F.md5(F.concat(F.col("seed").cast("string"), F.lit("-"), F.col("m").cast("string"))))
    assert rows(sample.bottom_k(df, "m", 5, 17).select("member")) == rows(drawn.where("seed = 17").orderBy("h").limit(5).select("m"))
    from pyspark.sql import Window

    times = {r["m"]: r["n"] for r in drawn.withColumn("r", F.row_number().over(Window.partitionBy("seed").orderBy("h"))).where("r <= 5").groupBy("m").agg(F.count("*").alias("n")).collect()}
    assert len(times) == 20 and all(60 < n < 140 for n in times.values()) and sum(times.values()) == 2_000


@pytest.mark.parametrize("status", [None, "s"])
def test_kept_pages_are_offset_and_limit(spark, tmp_path, monkeypatch, status):
    monkeypatch.setattr(pages, "FILE_ROWS", 40)
    rng = random.Random(3)
    made = [(i, rng.choice([None, *range(30)]), rng.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(made, "k long, t int, s string").repartition(4)
    kept = pages.Pages.build(df, str(tmp_path / "pages"), "t", "k", status)
    value = "a" if status else None
    own = sorted((r for r in made if not status or r[2] == "a"), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    for limit, offset in ((10, 0), (25, 35), (100, 100), (10, len(own) - 4), (5, 10_000), (0, 3)):
        assert [tuple(r) for r in kept.page(limit, offset, value).collect()] == own[offset : offset + limit]
        assert len(kept.parts(limit, offset, value)) <= limit // 20 + 2
    at, cursor = 0, None
    while at < len(own):
        found = [tuple(r) for r in kept.after(60, cursor, value).collect()]
        assert found == own[at : at + 60]
        at, cursor = at + 60, (found[-1][1], found[-1][0])
    assert [tuple(r) for r in kept.after(3, (15, -1), value).collect()] == [r for r in own if r[1] is None or r[1] <= 15][:3]
