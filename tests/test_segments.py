"""The segmented log: atomic appends, polls by admission, retention."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from rillworks.sources import segments
from rillworks.streaming import prioritiser

LOG = "stream string, id_ms long, id_seq long, payload string"


def put(spark, path, stream, ids, **more):
    segments.append(spark.createDataFrame([(stream, i, 0, json.dumps({"header": {"type": "user"}, "n": i})) for i in ids], LOG), path, **more)


def ids(df, stream="s"):
    return sorted(r["id_ms"] for r in df.where(F.col("stream") == stream).collect())


def poll(spark, path, out, n=10, group="g", checkpoint=None, **more):
    return prioritiser.run(segments.polls(spark, path, group, n, **more), out, checkpoint or f"{out}-checkpoint").awaitTermination()


def test_polls_leave_the_rest_for_later(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    put(spark, path, "s", range(25))
    put(spark, path, "t", range(3))
    for want in (10, 20, 25, 25):
        poll(spark, path, out)
        assert ids(spark.read.parquet(f"{out}/prioritised")) == list(range(want))
    put(spark, path, "s", range(30, 42))
    poll(spark, path, out)
    poll(spark, path, out)
    got = spark.read.parquet(f"{out}/prioritised")
    assert ids(got) == [*range(25), *range(30, 42)] and ids(got, "t") == [0, 1, 2]


@pytest.mark.parametrize("fails_at", [1, 2])
def test_a_poll_that_fails_is_run_again_and_nothing_is_lost(spark, tmp_path, fails_at):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    put(spark, path, "s", range(0, 25, 5))
    put(spark, path, "s", range(25, 50))
    fails = iter([i == fails_at for i in range(9)])

    def batch(df, batch_id):
        if next(fails):
            raise OSError("sink")
        prioritiser.prioritise(df, batch_id, out)

    def start():
        return segments.polls(spark, path, "g", 10).writeStream.foreachBatch(batch).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()

    seen = []
    for _ in range(6):
        try:
            start().awaitTermination()
        except Exception as e:
            assert "sink" in str(e)  # noqa: PT017
        seen.append(spark.read.parquet(f"{out}/prioritised").count())
    assert ids(spark.read.parquet(f"{out}/prioritised")) == [*range(0, 25, 5), *range(25, 50)]
    assert seen[0] == 10 and seen[-1] == 30


def test_groups_stand_for_themselves_and_may_start_at_the_tail(spark, tmp_path):
    path = str(tmp_path / "log")
    put(spark, path, "s", range(5))
    poll(spark, path, str(tmp_path / "tail"), group="late", start="tail")
    put(spark, path, "s", range(5, 8))
    put(spark, path, "other", range(4))
    poll(spark, path, str(tmp_path / "tail"), group="late", start="tail", streams=["s"])
    poll(spark, path, str(tmp_path / "all"), n=None, group="early")
    assert ids(spark.read.parquet(str(tmp_path / "tail" / "prioritised"))) == [5, 6, 7]
    assert ids(spark.read.parquet(str(tmp_path / "all" / "prioritised"))) == list(range(8))


def test_an_endless_poll_goes_through_all_of_it(spark, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    put(spark, path, "s", range(25))
    running = prioritiser.run(segments.polls(spark, path, "g", 10), out, f"{out}-checkpoint", trigger=prioritiser.ENDLESS)
    running.processAllAvailable()
    put(spark, path, "s", range(25, 40))
    running.processAllAvailable()
    running.stop()
    sizes = [r["count"] for r in spark.read.parquet(f"{out}/prioritised").groupBy("batch").count().orderBy("batch").collect()]
    assert sum(sizes) == 40 and max(sizes) == 10


def test_a_writer_that_dies_leaves_no_row_and_a_repeat_adds_none(spark, tmp_path):
    path = str(tmp_path / "log")
    put(spark, path, "s", range(10), writer="a")
    rows = spark.range(10, 1_000).select(F.lit("s").alias("stream"), F.col("id").alias("id_ms"), F.lit(0).cast("long").alias("id_seq"), F.lit("{}").alias("payload"))
    files = lambda: len(list((tmp_path / "log" / "data").iterdir()))
    before = files()
    with pytest.raises(Exception, match="dies"):
        segments.append(rows.withColumn("payload", F.when(F.col("id_ms") == 990, F.raise_error(F.lit("dies")).cast("string")).otherwise(F.col("payload"))), path, "b")
    assert ids(segments.rows(spark, path)) == list(range(10)) and files() == before
    for _ in range(2):
        segments.append(rows, path, "b")
    assert ids(segments.rows(spark, path)) == list(range(1_000))
    put(spark, path, "s", range(500), writer="a", batch=0)  # a repeat, whatever it holds
    assert segments.rows(spark, path).count() == 1_000 and files() == len(segments.Log(path).state().segments["s"])
    with pytest.raises(Exception, match="is not after"):
        put(spark, path, "s", [999])
    with pytest.raises(Exception, match="null"):
        segments.append(spark.createDataFrame([(None, 1, 1, "x")], LOG), path)


def test_writers_at_once(tmp_path):
    log = segments.Log(str(tmp_path))

    def write(i):
        return [log.commit([segments.Segment(f"s{i}", f"data/{i}-{n}", 1, (n, 0), (n, 0))], writer=f"w{i}", batch=n) for n in range(30)]

    with ThreadPoolExecutor(4) as pool:
        assert all(all(x) for x in pool.map(write, range(4)))
    state = log.state()
    assert state.version == 120 and all(len(state.segments[f"s{i}"]) == 30 for i in range(4)) and state.batches == {f"w{i}": 29 for i in range(4)}
    assert len(log.names("states")) <= 2 and len(log.names("commits")) <= 2 * segments.EVERY + 4
    assert not log.commit([segments.Segment("s0", "data/again", 1, (99, 0), (99, 0))], writer="w0", batch=29)


def test_retention_drops_whole_segments_by_the_manifest(spark, tmp_path):
    path = str(tmp_path / "log")
    for lo in range(0, 50, 10):
        put(spark, path, "s", range(lo, lo + 10), by_stream=True)
    put(spark, path, "t", range(3))
    assert segments.trimmed(path, 25) == {"s": 20}
    assert ids(segments.rows(spark, path)) == list(range(20, 50)) and ids(segments.rows(spark, path, ["t"]), "t") == [0, 1, 2]
    assert segments.trimmed(path, 25) == {} and segments.trimmed(path, 0) == {"s": 30, "t": 3}
    assert segments.rows(spark, path).count() == 0
    assert [tuple(r) for r in segments.summary(spark, path).collect()] == [("s", 0, 49, 0), ("t", 0, 2, 0)]
    with pytest.raises(Exception, match="is not after"):  # ids rise on after rows are gone
        put(spark, path, "s", [49])


def test_retention_by_appends_keeps_the_segments_of_one_together(spark, tmp_path):
    log, made = segments.Log(str(tmp_path)), lambda lo, n: [segments.Segment("s", f"data/{i}", 4, (i, 0), (i + 3, 0)) for i in range(lo, lo + 4 * n, 4)]
    for i in range(segments.EVERY + 2):  # beyond a state in full
        log.commit(made(100 * i, 3))
    assert segments.trimmed(log.path, 5, appended=True) == {"s": 12 * (segments.EVERY + 1)}
    assert [s.first[0] for s in log.state().segments["s"]] == [100 * (segments.EVERY + 1) + i for i in (0, 4, 8)]
    assert segments.trimmed(log.path, 5, appended=True) == {} and segments.trimmed(log.path, 5) == {"s": 4}


def test_segments_are_cut_by_rows_and_a_poll_reads_in_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "SEGMENT_ROWS", 4)
    log = segments.Log(str(tmp_path / "log"))
    import pyarrow as pa

    out = segments.Writing(log)
    out.add(pa.RecordBatch.from_pydict({"stream": ["a"] * 9 + ["b"], "id_ms": [*range(9), 0], "id_seq": [0] * 10, "payload": ["x"] * 10}))
    out.close()
    assert [(s.stream, s.rows, s.first, s.last) for s in out.segments] == [("a", 4, (0, 0), (3, 0)), ("a", 4, (4, 0), (7, 0)), ("a", 1, (8, 0), (8, 0)), ("b", 1, (0, 0), (0, 0))]
    log.commit(out.segments)
    reader = segments.Polls(log, "g", None, 6, "beginning")
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert end == {"a": "5-0", "b": "0-0"} and reader.latestOffset() == end
    parts = reader.partitions(start, end)
    assert sorted(i for p in parts for b in reader.read(p) for i in b.column("id_ms").to_pylist()) == [0, 0, 1, 2, 3, 4, 5]
    again = segments.Polls(log, "g", None, 6, "beginning")
    assert again.latestOffset() == {"a": "8-0", "b": "0-0"}


def test_a_stream_is_a_writer_too(spark, tmp_path):
    path, copy = str(tmp_path / "log"), str(tmp_path / "copy")
    put(spark, path, "s", range(25))
    for _ in range(3):
        segments.polls(spark, path, "copier", 10).writeStream.format("segments").option("path", copy).option("writer", "copier").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert ids(segments.rows(spark, copy)) == list(range(25))
    assert len(segments.Log(copy).names("commits")) == 3
