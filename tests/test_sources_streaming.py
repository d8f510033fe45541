import json

import pytest
from pyspark.sql import functions as F

from rillworks.functions.retry import constant
from rillworks.session import status
from rillworks.sources import config, feeds, http, metrics
from rillworks.streaming import ingest, prioritiser

RSS = "<rss><channel>{}</channel></rss>"
ITEM = "<item><link>{}</link><title>t</title><description>d</description></item>"
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="http://x/atom"/><summary>s</summary></entry></feed>'


def test_feed_list_keeps_order(spark, tmp_path):
    path = tmp_path / "feeds.json"
    path.write_text(json.dumps(["b", "a"]))
    assert [(r["feed_idx"], r["feed_url"]) for r in feeds.feed_list(spark, str(path)).orderBy("feed_idx").collect()] == [(0, "b"), (1, "a")]
    path.write_text("[]")
    with pytest.raises(ValueError):
        feeds.feed_list(spark, str(path))


def test_scan_rejects_malformed_feeds_whole(spark, tmp_path):
    bodies = {"one": RSS.format(ITEM.format("http://x/1") + "<item><title>no link</title></item>"), "bad": RSS.format(ITEM.format("http://x/2")) + "<oops>", "atom": ATOM}
    listed = spark.createDataFrame(list(enumerate([*bodies, "missing"])), "feed_idx int, feed_url string")
    got = feeds.scan(listed, spark.createDataFrame(list(bodies.items()), "feed_url string, body string"))
    want = {(0, 0, "http://x/1", "one", "t", "d"), (2, 0, "http://x/atom", "atom", None, "s")}
    assert {tuple(r) for r in got.select("feed_idx", "entry_idx", "link", "source", "title", "summary").collect()} == want
    paths = []
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
        paths.append(str(tmp_path / name))
    spark.dataSource.register(feeds.FeedSource)
    read = spark.read.format("feeds").option("urls", json.dumps([*paths, str(tmp_path / "missing")])).load()
    assert {(r["feed_idx"], r["link"]) for r in read.collect()} == {(0, "http://x/1"), (2, "http://x/atom")}


def test_fetch_json_keeps_failures_apart(spark):
    def transport(url):
        if url == "bad":
            raise OSError("down")
        return json.dumps({"url": url})

    got = http.fetch_json(spark.createDataFrame([("a",), ("bad",)], "u string"), "u", transport).collect()
    assert {r["u"]: (r["response"], r["error"]) for r in got} == {"a": ('{"url": "a"}', None), "bad": (None, "down")}


def test_metrics(spark):
    sample = lambda: {"cpu": {"logical_cores": 2, "physical_cores": 1, "percent": 12.5, "times": [{"user": 1.0}, {"user": 2.0}], "percents": [10.0, 15.0]}, "memory": {"ram": {"total": 2048.0, "used": 1024.0}, "swap": {"total": 0.0}}, "network": {"bytes_sent": 5, "bytes_recv": 1536, "packets_sent": 1234, "packets_recv": 1}}
    stats = metrics.sys_stats(spark, sample)
    assert [(c["times"]["user"], c["percent"]) for c in stats.first()["cpu"]["individual_cpu_stats"]] == [(1.0, 10.0), (2.0, 15.0)]
    assert "packets: 1,234" in metrics.report(stats).first()["report"] and "1.50 KB" in metrics.report(stats).first()["report"]
    both = spark.range(1).select(metrics.merged(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(2))).alias("m")).first()["m"]
    assert both == {"a": 2}


def test_status_never_fails():
    assert status(lambda: 1)["status"] == "connected"
    assert status(lambda: 1 / 0)["status"] == "disconnected"


ARTICLE = "feed_idx int, entry_idx int, link string, source string, title string, summary string"


def put(spark, path, links):
    spark.createDataFrame([(0, i, x, "s", None, None) for i, x in enumerate(links)], ARTICLE).coalesce(1).write.mode("append").parquet(path)


def test_ingest_stream_is_the_fold(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "log")
    days = {0: ["a", "a", "b", ""], 3: ["a", "c"], 9: ["c", "d"], 17: ["a", "c"]}
    order = list(days)
    seen = ingest.SeenSet(spark, str(tmp_path / "seen"), 7 * 86400)
    counts = {}

    for n, day in enumerate(order):  # each run takes what came since
        put(spark, src, days[day])
        stream = spark.readStream.schema(ARTICLE).option("maxFilesPerTrigger", 10).parquet(src)
        ingest.ingest(stream, seen, out, str(tmp_path / "ckpt"), lambda df, b: order[b] * 86400).awaitTermination()
        row = spark.read.parquet(f"{out}-stats").where(F.col("batch_id") == n).first()
        counts[day] = (row["new"], row["seen"])
    assert counts == {0: (2, 0), 3: (1, 1), 9: (1, 1), 17: (2, 0)}
    assert spark.read.parquet(out).count() == 6


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    seen = ingest.SeenSet(spark, str(tmp_path / "seen"))
    rows = spark.createDataFrame([(0, 0, "a", "s", None, None)], ARTICLE)
    first = ingest.cycle(rows, 0, 0, seen, str(tmp_path / "log"))
    assert ingest.cycle(rows, 0, 0, seen, str(tmp_path / "log")) == first == {"new": 1, "seen": 0, "total": 1}
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1
    assert ingest.cycle(rows, 1, 10, seen, str(tmp_path / "log")) == {"new": 0, "seen": 1, "total": 1}
    assert ingest.cycle(rows.limit(0), 2, 10, seen, str(tmp_path / "log")) == {"new": 0, "seen": 0, "total": 0}


def test_nothing_is_seen_if_publishing_fails(spark, tmp_path):
    seen = ingest.SeenSet(spark, str(tmp_path / "seen"))
    rows = spark.createDataFrame([(0, 0, "a", "s", None, None)], ARTICLE)

    def fails(df):
        raise OSError("sink")

    with pytest.raises(OSError):
        ingest.cycle(rows, 0, 0, seen, str(tmp_path / "log"), fails)
    assert ingest.cycle(rows, 1, 5, seen, str(tmp_path / "log"))["new"] == 1


def test_prioritiser_stream(spark, tmp_path):
    schema = "stream string, id_ms long, id_seq long, payload string"
    paths = {}
    for name, kinds in {"x": ["logging", "user", None], "y": ["background"]}.items():
        paths[name] = str(tmp_path / name)
        spark.createDataFrame([(name, i, 0, "{bad" if k is None else json.dumps({"header": {"type": k}})) for i, k in enumerate(kinds)], schema).coalesce(1).write.parquet(paths[name])
    out = str(tmp_path / "out")
    prioritiser.run(prioritiser.merged(spark, paths), out, str(tmp_path / "ckpt")).awaitTermination()
    got = spark.read.parquet(f"{out}/prioritised").orderBy("batch", "rank").collect()
    assert [json.loads(r["payload"])["header"]["type"] for r in got] == ["user", "background", "logging"]
    assert spark.read.parquet(f"{out}/dead_letter").count() == 1


def test_a_large_batch_is_ranked_in_ranges(spark, tmp_path):
    rows = spark.range(50_000).select(F.lit("s").alias("stream"), F.col("id").alias("id_ms"), F.lit(0).cast("long").alias("id_seq"), F.when(F.col("id") % 2 == 0, '{"header":{"type":"user"}}').otherwise('{"header":{"type":"logging"}}').alias("payload"))
    prioritiser.prioritise(rows, 0, str(tmp_path))
    got = spark.read.parquet(str(tmp_path / "prioritised"))
    assert got.where("rank <= 25000 and id_ms % 2 = 0").count() == 25_000 and got.agg(F.countDistinct("rank").alias("n")).first()["n"] == 50_000


def test_failed_polls_are_tried_again(spark, tmp_path):
    path, fails = str(tmp_path / "x"), iter([True, True, False])
    spark.createDataFrame([("x", 1, 0, "{}")], "stream string, id_ms long, id_seq long, payload string").write.parquet(path)

    def start():
        rows = prioritiser.merged(spark, {"x": path})
        if next(fails):
            rows = rows.withColumn("payload", F.raise_error(F.lit("poll")).cast("string"))
        return prioritiser.run(rows, str(tmp_path / "out"), str(tmp_path / "ckpt"), trigger=prioritiser.ONCE)

    slept = []
    assert len(prioritiser.supervised(start, constant(3, 2), slept.append)) == 2 and slept == [2, 2]
    assert spark.read.parquet(str(tmp_path / "out" / "prioritised")).count() == 1


def test_an_endless_stream_goes_on(spark, tmp_path):
    path, out = str(tmp_path / "x"), str(tmp_path / "out")
    rows = lambda i: spark.createDataFrame([("x", i, 0, "{}")], "stream string, id_ms long, id_seq long, payload string").coalesce(1).write.mode("append").parquet(path)
    rows(0)
    running = prioritiser.run(prioritiser.merged(spark, {"x": path}), out, str(tmp_path / "ckpt"), trigger=prioritiser.ENDLESS)
    running.processAllAvailable()
    rows(1)
    running.processAllAvailable()
    running.stop()
    assert spark.read.parquet(f"{out}/prioritised").count() == 2


def test_entities_are_refused():
    bomb = '<!DOCTYPE r [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;">]>' + RSS.format(ITEM.format("&b;"))
    assert feeds.entries(bomb, "u") is None
    assert feeds.entries(RSS.format("<item><link>x</link><title><![CDATA[<!ENTITY]]></title></item>"), "u") == [(0, "x", "u", "<!ENTITY", None)]


def test_configured_streams(spark):
    env = {"INPUT_STREAMS": "a, b,c", "OUTPUT_STREAM": "o", "GROUP_NAME": "g", "CONSUMER_NAME": "c"}
    assert [tuple(r) for r in config.input_streams(spark, env).orderBy("stream_pos").collect()] == [("a", 0), ("b,c", 1)]
    assert config.prioritiser(env).group_name == "g"
    with pytest.raises(ValueError, match="INPUT_STREAMS"):
        config.input_streams(spark, {})


def test_host_sample(spark):
    stats = iter(["cpu 10 0 10 80 0\ncpu0 10 0 10 80 0\n", "cpu 20 0 10 170 0\ncpu0 20 0 10 170 0\n"])
    texts = {"/proc/cpuinfo": "physical id : 0\ncore id : 0\n\n", "/proc/meminfo": "MemTotal: 8 kB\nMemAvailable: 2 kB\nSwapTotal: 0 kB\nSwapFree: 0 kB\n", "/proc/net/dev": "h\n eth0: 5 1 0 0 0 0 0 0 7 2 0 0 0 0 0 0\n"}
    sample = metrics.host(0, lambda p: next(stats) if p == "/proc/stat" else texts[p], lambda s: None)
    row = metrics.sys_stats(spark, lambda: sample).first()
    assert row["cpu"]["percent"] == 10.0 and row["cpu"]["physical_cores"] == 1 and row["memory"]["ram"]["used"] == 6144.0 and row["network"]["bytes_sent"] == 7
    assert metrics.sys_stats(spark, lambda: metrics.host(0.01)).first()["memory"]["ram"]["total"] > 0


def test_feed_polls(spark, tmp_path):
    """Unchanged feeds are not read again, malformed ones are at each poll, missing ones once they are there."""
    spark.dataSource.register(feeds.FeedSource)
    urls = [str(tmp_path / n) for n in ("good", "bad", "missing", "shared")]

    def put_feed(name, *links, end="</channel></rss>"):
        (tmp_path / name).write_text("<rss><channel>" + "".join(ITEM.format(x) for x in links) + end)

    def poll():
        stream = spark.readStream.format("feeds").option("urls", json.dumps(urls)).option("state", str(tmp_path / "state")).load()
        found = []
        stream.writeStream.foreachBatch(lambda df, batch: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
        return {(r["feed_idx"], r["link"]) for r in found}

    put_feed("good", "http://x/1", "http://x/2")
    put_feed("bad", "http://x/3", end="<oops>")
    put_feed("shared", "http://x/1")
    assert poll() == {(0, "http://x/1"), (0, "http://x/2"), (3, "http://x/1")}
    assert poll() == set()  # the malformed one is read again, and still is
    put_feed("bad", "http://x/3", "http://x/4")
    put_feed("missing", "http://x/5")
    assert poll() == {(1, "http://x/3"), (1, "http://x/4"), (2, "http://x/5")}
    assert poll() == set()


def test_a_feed_that_failed_counts_as_changed(tmp_path):
    (tmp_path / "bad").write_text("<oops>")
    polls = feeds.FeedPolls([str(tmp_path / "bad")], feeds.read_file, feeds.file_version, str(tmp_path / "state"))
    start = polls.initialOffset()
    for _ in range(3):
        end = polls.latestOffset()
        parts = polls.partitions(start, end)
        assert len(parts) == 1 and list(polls.read(parts[0])) == [] and list(polls.read(parts[0])) == []  # a task that is tried again marks once
        start = end
    assert len(polls.log.names(polls._marks(str(tmp_path / "bad")))) == 3


def test_a_poll_of_many_feeds_takes_few_tasks(tmp_path, monkeypatch):
    urls = [str(tmp_path / f"f{i}") for i in range(25)]
    for i, url in enumerate(urls):
        (tmp_path / f"f{i}").write_text(f"<rss><channel><item><link>http://x/{i}</link></item></channel></rss>", encoding="utf-8")
        assert url
    polls = feeds.FeedPolls(urls, feeds.read_file, feeds.file_version, str(tmp_path / "state"))
    monkeypatch.setattr(feeds.FeedPolls, "TASKS", 4)
    parts = polls.partitions(polls.initialOffset(), polls.latestOffset())
    assert len(parts) == 4 and [r[:3] for p in parts for r in polls.read(p)] == [(i, 0, f"http://x/{i}") for i in range(25)]
