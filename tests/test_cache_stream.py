"""The read-through cache as state, against a plain fold."""

import random
from datetime import datetime, timedelta

from rillworks.streaming import cache

BEGAN = datetime(2024, 1, 1)


def fold(rows, ttl, fill):
    """request -> (cached, data), rows (key, seconds, request) by time."""
    held, out = {}, {}
    for key, t, request in sorted(rows, key=lambda r: (r[1], r[2])):
        if key in held and t < held[key][0] + ttl:
            out[request] = (True, held[key][1])
            continue
        got = fill(key)
        if got is None:
            held.pop(key, None)
        else:
            held[key] = (t, got)
        out[request] = (False, got)
    return out


def feed(spark, path, rows):
    spark.createDataFrame([(k, BEGAN + timedelta(seconds=t), r) for k, t, r in rows], "url string, ts timestamp, id long").coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, fill, ttl=60):
    stream = spark.readStream.schema("url string, ts timestamp, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    started = cache.run(cache.through(stream, "url", "ts", "id", ttl, fill), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    started.awaitTermination()
    return started.lastProgress


def test_micro_batches_and_restarts_are_the_fold(spark, tmp_path):
    def fill(key):
        return None if key == "bad" else f"page of {key}"

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rng = random.Random(8)
    times = sorted(rng.randint(0, 600) for _ in range(300))
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", "bad"]), t, i) for i, t in enumerate(times)]
    rows += [("hot", 600, 300), ("hot", 600, 301)]
    for lo in range(0, 302, 60):
        feed(spark, str(tmp_path / "in"), rows[lo : lo + 60])
    run(spark, tmp_path, fill)
    feed(spark, str(tmp_path / "in"), [("hot", 700, 900), ("new", 700, 901)])
    rows += [("hot", 700, 900), ("new", 700, 901)]
    run(spark, tmp_path, fill)
    got = {r["request"]: (r["cached"], r["data"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == fold(rows, 60, fill)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_entries_leave_the_state(spark, tmp_path):
    for hour in range(4):
        feed(spark, str(tmp_path / "in"), [(f"u{hour}-{i}", hour * 3600, hour * 10 + i) for i in range(5)])
    left = run(spark, tmp_path, cache.ready)["stateOperators"][0]
    assert spark.read.parquet(str(tmp_path / "out")).where("not cached").count() == 20
    assert left["numRowsTotal"] == 5


def test_keys_go_to_python_many_to_a_batch(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), [(f"u{i % 40}", i, i) for i in range(80)])
    stream = spark.readStream.schema("url string, ts timestamp, id long").parquet(str(tmp_path / "in"))
    started = cache.run(cache.through(stream, "url", "ts", "id", 60), str(tmp_path / "out"), str(tmp_path / "ckpt"), evict=False)
    started.awaitTermination()
    assert started.lastProgress["stateOperators"][0]["operatorName"] == "applyInPandasWithState" and started.lastProgress["numInputRows"] == 80
    assert spark.read.parquet(str(tmp_path / "out")).where("cached").count() == 40
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
