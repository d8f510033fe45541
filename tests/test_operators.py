import hashlib
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rillworks import checks
from rillworks.functions import console, json, retry, text
from rillworks.operators import batches, cache, catalog, dedup, envelope, log, prioritise, route, vector
from rillworks.session import close, connect

quick = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
D0 = datetime(2024, 1, 1)


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_first_wins_by_feed_then_entry(spark):
    rows = spark.createDataFrame([(1, 0, "a", "late"), (0, 5, "a", "early"), (0, 6, "b", "x")], "feed_idx int, entry_idx int, link string, source string")
    assert sorted(values(dedup.first_wins(rows, "link", ["feed_idx", "entry_idx"]), "link", "source")) == [("a", "early"), ("b", "x")]


def test_only_null_and_empty_links_drop(spark):
    rows = spark.createDataFrame([("",), (None,), (" ",), ("x",)], "link string")
    assert sorted(values(dedup.with_link(rows), "link")) == [" ", "x"]


@quick
@given(st.lists(st.sampled_from("abcdef"), max_size=12), st.lists(st.sampled_from("abcdef"), max_size=6))
def test_anti_and_semi_are_all(spark, items, seen):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    known = spark.createDataFrame([(x,) for x in seen], "item string")
    new, old = values(dedup.unseen(rows, known, "x"), "i"), values(dedup.already_seen(rows, known, "x"), "i")
    assert sorted(new + old) == list(range(len(items)))
    assert sorted(old) == [i for i, x in enumerate(items) if x in seen]
    assert {r["i"]: r["is_seen"] for r in dedup.flagged(rows, known, "x").collect()} == {i: int(x in seen) for i, x in enumerate(items)}


def fold(cycles, ttl):
    seen, until, out = set(), None, {}
    for at in sorted(cycles):
        if until is not None and at >= until:
            seen = set()
        items = set(cycles[at])
        new = items - seen
        seen |= items
        if new:
            until = at + ttl
        out[at] = (len(new), len(items) - len(new), len(items))
    return out


@pytest.mark.parametrize("days,expected", [({0: "a", 6: "b", 12: "a"}, {12: (0, 1, 1)}), ({0: "a", 6: "b", 13: "a"}, {13: (1, 0, 1)}), ({0: "a", 6: "a", 7: "a"}, {6: (0, 1, 1), 7: (1, 0, 1)})])
def test_rolling_life(spark, days, expected):
    rows = spark.createDataFrame([(D0 + timedelta(days=d), x) for d, xs in days.items() for x in xs], "c timestamp_ntz, x string")
    got = {(r["c"] - D0).days: (r["new_items"], r["seen_items"], r["total_items"]) for r in dedup.cycle_stats(rows, "c", "x", 7 * 86400).collect()}
    assert {d: got[d] for d in expected} == expected


@quick
@given(st.dictionaries(st.integers(0, 30), st.lists(st.sampled_from("abcde"), min_size=1, max_size=4), min_size=1, max_size=12))
def test_rolling_life_is_the_fold(spark, days):
    rows = spark.createDataFrame([(D0 + timedelta(days=d), x) for d, xs in days.items() for x in xs], "c timestamp_ntz, x string")
    got = {r["c"]: (r["new_items"], r["seen_items"], r["total_items"]) for r in dedup.cycle_stats(rows, "c", "x", 5 * 86400).collect()}
    assert got == fold({D0 + timedelta(days=d): xs for d, xs in days.items()}, timedelta(days=5))


def test_envelopes(spark):
    rows = spark.createDataFrame([("http://x/a", "feed")], "link string, source string")
    out = envelope.envelopes(rows, F.lit("2024-01-01T00:00:00"))
    got = out.select("header.*", "data.*").first()
    assert got.asDict() == {"message_id": hashlib.md5(b"http://x/a").hexdigest(), "timestamp": "2024-01-01T00:00:00", "type": "background", "url": "http://x/a", "source_rss": "feed"}
    assert '"source_rss":"feed"' in envelope.payloads(out).first()["payload"]
    with pytest.raises(Exception, match="no source"):
        envelope.envelopes(spark.createDataFrame([("x", None)], "link string, source string"), F.lit("t")).collect()


def test_corrupt_rows_wait_and_missing_payloads_pass(spark):
    rows = spark.createDataFrame([("s", 1, 0, "{bad"), ("s", 2, 0, None), ("s", 3, 0, '{"a":1}')], "stream string, id_ms long, id_seq long, payload string")
    assert sorted(values(envelope.consumed(rows), "msg_id")) == ["2-0", "3-0"]
    assert values(envelope.corrupt(rows), "id_ms") == [1]


def test_batches(spark):
    got = batches.assigned(spark.range(7), ["id"], 3).orderBy("id").collect()
    assert [(r["batch_id"], r["size"]) for r in got] == [(0, 3)] * 3 + [(3, 3)] * 3 + [(6, 1)]
    with pytest.raises(ValueError):
        batches.assigned(spark.range(7), ["id"], 0)
    assert batches.assigned(spark.range(7), ["id"], -1).count() == 0
    assert batches.assigned(spark.range(0), ["id"], 3).count() == 0


@quick
@given(st.integers(0, 60), st.integers(1, 9))
def test_batches_put_together_are_the_input(spark, n, size):
    got = batches.assigned(spark.range(n).withColumn("k", F.xxhash64("id")), ["k"], size).orderBy("position").collect()
    assert [r["k"] for r in got] == sorted(r["k"] for r in got) and [r["position"] for r in got] == list(range(n))
    assert sum({r["batch_id"]: r["size"] for r in got}.values()) == n


def test_priorities_are_stable_and_read_the_header(spark):
    kinds = ["logging", "user", "foo", "background", "admin"]
    rows = spark.createDataFrame([(0, i, f'{{"header":{{"type":"{k}"}}}}') for i, k in enumerate(kinds)] + [(0, 5, "[1]")], "b int, i int, p string")
    order = lambda path: [i for _, i in sorted(values(prioritise.ranked(rows, "b", prioritise.kind_of(F.col("p"), path), ["i"]), "rank", "i"))]
    assert [kinds[i] for i in order("$.header.type")[:5]] == ["user", "admin", "background", "logging", "foo"]
    assert order("$.type") == [0, 1, 2, 3, 4, 5]


def test_routes(spark, tmp_path):
    rows = spark.createDataFrame([(x,) for x in "aabcz"], "type string")
    routes = {"a": "s1", "b": "s1", "c": "s2"}
    assert dict(values(route.route_counts(rows, "type", routes), "stream", "n")) == {"s1": 3, "s2": 1, None: 1}
    for _ in range(2):
        route.publish(rows, "type", routes, str(tmp_path / "out"), 0)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    assert route.routed(rows, "type", {}).count() == 0
    assert {t: v for t, v in values(route.by_type(rows.withColumn("v", F.lit(1)), "type", "v"), "type", "values")}["a"] == [1, 1]


def test_log(spark, tmp_path):
    rows = spark.createDataFrame([(s, i, 0, "{}") for s in ("x", "y") for i in range(15)], "stream string, id_ms long, id_seq long, payload string")
    assert log.take_per_stream(rows, 10).count() == 20
    ids = spark.createDataFrame([(9, 0), (10, 0), (10, 2), (10, 11)], "id_ms long, id_seq long")
    assert values(log.newest(ids, 2), "id_ms", "id_seq") == [(10, 11), (10, 2)]
    assert values(log.oldest(ids, 1), "id_ms") == [9]
    assert sorted(values(log.retained(ids, 3), "id_seq")) == [0, 2, 11]
    assert log.retained(ids, 10).count() == 4 and log.retained(ids.limit(0), 3).count() == 0
    assert log.take_one(ids.limit(0)).count() == 0
    for _ in range(2):
        log.appended(rows, str(tmp_path / "log"), 1)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 30
    assert dict(values(log.length(rows), "stream", "length")) == {"x": 15, "y": 15}


def test_group_state(spark):
    log_rows = spark.createDataFrame([("s", i, 0, "{}") for i in range(10)], "stream string, id_ms long, id_seq long, payload string")
    given_ = spark.createDataFrame([("s", "g", f"c{i % 2}", i, 0) for i in range(6)], "stream string, group_name string, consumer string, id_ms long, id_seq long")
    acks = spark.createDataFrame([("s", "g", i, 0) for i in range(4)], "stream string, group_name string, id_ms long, id_seq long")
    got = log.group_summary(log_rows, given_, acks).first()
    assert (got["consumers"], got["pending"], got["last_ms"], got["entries_read"], got["lag"]) == (2, 2, 5, 6, 4)
    assert sorted(values(log.pending(given_, acks), "id_ms")) == [4, 5]
    assert sorted(values(log.undelivered(log_rows, given_, "g"), "id_ms")) == [6, 7, 8, 9]
    assert sorted(values(log.undelivered(log_rows, given_, "other", (7, 0)), "id_ms")) == [8, 9]


def test_cache_boundary_and_empty_values(spark):
    t = D0
    stored = spark.createDataFrame([("u",), ("v",), ("w",)], "u string").select(text.cache_key(F.col("u")).alias("key"), F.when(F.col("u") == "v", "{}").otherwise('{"a":1}').alias("value"), F.lit(t).cast("timestamp").alias("stored_at"), F.lit(3600).alias("ttl_s"))
    asked = spark.createDataFrame([(1, "u", t + timedelta(seconds=3599)), (2, "u", t + timedelta(seconds=3600)), (3, "v", t), (4, "none", t)], "request_id long, url string, ts timestamp")
    assert dict(values(cache.lookup(asked, stored), "request_id", "cached")) == {1: True, 2: False, 3: False, 4: False}
    later = stored.limit(1).withColumns({"value": F.lit("new"), "stored_at": F.lit(t + timedelta(days=1)).cast("timestamp")})
    assert cache.put(stored, later).where("value = 'new'").count() == 1 and cache.put(stored, later).count() == 3


@quick
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), max_size=25))
def test_ttl_hits_are_the_fold(spark, asked):
    rows = spark.createDataFrame([(k, D0 + timedelta(seconds=s), i) for i, (k, s) in enumerate(asked)], "k string, ts timestamp_ntz, i int")
    want = {}
    for k in {k for k, _ in asked}:
        last, hits, misses = None, 0, 0
        for s in sorted(s for kk, s in asked if kk == k):
            if last is not None and s < last + 10:
                hits += 1
            else:
                last, misses = s, misses + 1
        want[k] = (hits, misses)
    assert {r["k"]: (r["hits"], r["misses"]) for r in cache.ttl_hits(rows, "k", "ts", "i", 10).collect()} == want


def test_analyse(spark):
    now = D0
    asked = spark.createDataFrame([(i, u, now) for i, u in enumerate(["hit", "ok", "nocontent", "down", "nlpdown", "nullcontent"])], "request_id long, url string, ts timestamp")
    stored = spark.createDataFrame([("hit",)], "u string").select(text.cache_key(F.col("u")).alias("key"), F.lit('{"x":1}').alias("value"), F.lit(now).cast("timestamp").alias("stored_at"), F.lit(60).alias("ttl_s"))
    scrape = lambda df: df.withColumn("response", F.when(F.col("url") == "nocontent", '{"t":1}').when(F.col("url") == "down", None).when(F.col("url") == "nullcontent", '{"content":null}').otherwise('{"content":"c"}'))
    nlp = lambda df: df.withColumn("response", F.when(F.col("url") != "nlpdown", F.concat(F.lit('{"of":'), "content", F.lit("}"))))
    got = {r["request_id"]: (r["status"], r["cached"]) for r in cache.analyse(asked, stored, scrape, nlp).collect()}
    assert got == {0: (200, True), 1: (200, False), 2: (502, False), 3: (500, False), 4: (500, False), 5: (200, False)}


@pytest.mark.parametrize("n,shown", [(1024, "1024 B"), (1025, "1.00 KB"), (1152, "1.12 KB"), (1048576, "1024.00 KB"), (3 * 1024**3, "3.00 GB")])
def test_human_bytes(spark, n, shown):
    assert spark.range(1).select(text.human_bytes(F.lit(n).cast("long")).alias("x")).first()["x"] == shown


def test_human_bytes_rounds_as_binary_fractions_do(spark):
    numbers = [1024 + 5 * i for i in range(2000)] + [1048577 + 5243 * i for i in range(500)]
    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", text.human_bytes(F.col("n")).alias("x")).collect()
    assert all(r["x"] == (f"{r['n'] / 1024**2:.2f} MB" if r["n"] > 1024**2 else f"{r['n'] / 1024:.2f} KB" if r["n"] > 1024 else f"{r['n']} B") for r in got)


def test_text(spark):
    from urllib.parse import quote_plus

    odd = "~x*y z/ü?&=+%"
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.form_encoded(F.lit(odd))) == quote_plus(odd)
    assert one(text.form_encoded(F.lit("~x*y z"))) == "~x%2Ay+z"
    assert [one(text.indented(F.lit(t))) for t in ("a\n\nb", "a\n", "")] == ["\ta\n\t\n\tb", "\ta\n", ""]
    assert one(text.stream_list(F.lit("a, b,c"))) == ["a", "b,c"]
    assert one(text.coloured(F.lit("x"), "red")) == "\x1b[91mx\x1b[00m"
    assert one(text.iso_time(F.lit("2024-01-01 00:00:00.5").cast("timestamp_ntz"))) == "2024-01-01T00:00:00.500000"
    assert one(json.has_key(F.lit('{"content": null}'), "content")) is True
    assert one(json.has_key(F.lit("[1]"), "content")) is False
    assert [one(json.truthy(F.lit(v))) for v in ("{}", "[]", "0", '""', "null", "false", "", "0.0", '{"a":0}', "1")] == [False] * 8 + [True] * 2


def test_backoff(spark):
    assert [round(d, 2) for d in values(retry.schedule(spark), "delay_s")] == [3.72, 8.39, 21.09, 55.6]
    jittery = retry.Policy(jitter_s=1)
    assert all(abs(a - b) <= 1 for a, b in zip(values(retry.schedule(spark, jittery, 3), "delay_s"), retry.Policy().waits(), strict=True))
    assert all(abs(a - b) <= 1 for a, b in zip(jittery.waits(), retry.Policy().waits(), strict=True))
    assert values(retry.schedule(spark, retry.constant(3, 0.5)), "delay_s") == retry.constant(3, 0.5).waits() == [0.5, 0.5]
    slept, calls, heard = [], [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        retry.Policy(3).run(fails, slept.append, heard.append)
    assert len(calls) == 3 and len(heard) == 2 and [round(s, 2) for s in slept] == [3.72, 8.39]
    waits = iter([OSError(), None])

    @retry.constant(2, 0)
    def recovers(answer):
        if e := next(waits):
            raise e
        return answer

    assert recovers("fine") == "fine" and recovers.__name__ == "recovers"


def test_connect(spark):
    slept, tries = [], iter([OSError("down"), OSError("down"), None])

    def open_():
        if e := next(tries):
            raise e
        return spark

    assert connect(open_, sleep=slept.append) is spark and [round(s, 2) for s in slept] == [3.72, 8.39]
    close(None)


def test_catalog(spark, tmp_path):
    rows = spark.createDataFrame([(i, D0, "ok" if i % 2 else "pending") for i in range(6)], "id int, at timestamp, s string")
    assert values(catalog.page(rows, "at", "id", 2, 1), "id") == [1, 2]
    assert values(catalog.page(rows, "at", "id", 2, 0, "s", "pending"), "id") == [0, 2]
    assert catalog.statistics(rows, rows.limit(2), "s").first().asDict() == {"articles": 6, "pending": 3, "sources": 2}
    shape = "id string, title string, analysis_status string, created_at timestamp"
    made = catalog.inserted(spark.createDataFrame([("t", None), ("u", "done")], "title string, analysis_status string"), shape, {"analysis_status": "pending"})
    assert sorted(values(made, "title", "analysis_status")) == [("t", "pending"), ("u", "done")] and made.where("id is null or created_at is null").count() == 0
    catalog.backup(rows, str(tmp_path), "one")
    with pytest.raises(Exception):
        catalog.backup(rows, str(tmp_path), "one")


def test_zero_vectors_have_no_similarity(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = vector.similar(rows.where("vec_id = 0"), rows, 3).orderBy("rank").collect()
    assert [(r["id"], r["similarity"]) for r in got] == [(2, 1.0), (3, 0.0), (1, None)]
    vector.MAX_BROADCAST, kept = 1, vector.MAX_BROADCAST
    try:
        assert vector.similar(rows.where("vec_id in (0, 2)"), rows, 1).count() == 2
    finally:
        vector.MAX_BROADCAST = kept


def test_semantic_search_with_an_injected_embedding(spark):
    embed = lambda texts: [[float(t.count("a")), float(t.count("b"))] for t in texts]
    rows = vector.embedded(spark.createDataFrame([(1, "aaa"), (2, "ab"), (3, None), (4, "bb")], "vec_id long, text string"), "text", embed)
    assert {r["vec_id"]: r["embedding"] for r in rows.collect()} == {1: [3.0, 0.0], 2: [1.0, 1.0], 3: None, 4: [0.0, 2.0]}
    got = vector.semantic_search(spark.createDataFrame([(1, "b"), (2, None)], "query_id long, text string"), rows.where("embedding is not null"), 2, embed).orderBy("rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(1, 4), (1, 2)]


def test_flush(spark, tmp_path):
    from rillworks.storage import children, flush

    spark.range(3).write.parquet(str(tmp_path / "gone"))
    assert children(spark, str(tmp_path / "gone"))
    flush(spark, str(tmp_path / "gone"))
    assert not children(spark, str(tmp_path / "gone"))


def test_many_lives():
    cycles = {D0 + timedelta(hours=h): None if h % 3 == 0 else D0 + timedelta(hours=h - 1) for h in range(90_000)}
    lives = dedup.begun(cycles, timedelta(hours=2))
    assert len(lives) == 90_000 and len(set(lives.values())) > 10_000


def test_many_lives_are_joined(spark):
    rows = spark.range(12_000).select((F.lit(D0).cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("cycle"), (F.col("id") % 2).alias("item"))
    got = dedup.cycle_stats(rows, "cycle", "item", 3 * 3600)  # items 0 and 1 in turn: a life is four hours long, and its first two cycles are new
    assert got.agg(F.sum("new_items").alias("n")).first()["n"] == 6_000


def test_retention_of_a_large_log(spark):
    rows = spark.range(250_000).select(F.floor(F.col("id") / 2).alias("id_ms"), (F.col("id") % 2).alias("id_seq"))
    kept = log.retained(rows, 100_001)
    assert kept.count() == 100_001 and kept.agg(F.min(F.struct("id_ms", "id_seq")).alias("m")).first()["m"] == (74_999, 1)
    tied = log.retained(rows, 99_999, ["id_ms"])  # both rows of the last id_ms stay
    assert tied.count() == 100_000 and log.retained(rows, 0).count() == 0


def test_more_queries_than_a_broadcast(spark, sf_dir, monkeypatch):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    order = lambda df: sorted(values(df, "query_id", "id", "rank"))
    want = order(vector.similar(rows, rows, 3))
    monkeypatch.setattr(vector, "MAX_BROADCAST", 24_000)
    found = vector.similar(rows, rows, 3)
    assert order(found) == want
    ids = spark.range(20_000).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id"), F.sin(F.col("id") * 3)).alias("embedding"))
    monkeypatch.setattr(vector, "MAX_BROADCAST", 500_000)
    assert vector.similar(ids, ids.where("vec_id < 500"), 1).count() == 20_000


def test_log_ids_and_messages(spark, tmp_path):
    ids = spark.createDataFrame([("9-1",), ("10-2",), ("10-11",), ("7",), ("x",), ("1-",), (None,)], "i string").select("i", log.parsed_id(F.col("i")).alias("p"))
    assert values(ids.where("p is not null").orderBy("p"), "i") == ["7", "9-1", "10-2", "10-11"]
    path = str(tmp_path / "log")
    assert log.append_one(spark, {"a": None}, path, "s", 5, 2) == "5-2" and log.append_one(spark, {}, path, "s", 6) is None
    assert log.append_one(spark, {"a": object()}, path, "s", 6) is None
    assert values(spark.read.parquet(f"{path}/stream=s"), "id_ms", "id_seq", "payload") == [(5, 2, '{"a": null}')]


def test_acknowledge(spark):
    key = "stream string, group_name string, id_ms long, id_seq long"
    given_ = spark.createDataFrame([("s", "g", i, 0) for i in range(4)], key)
    acks = spark.createDataFrame([("s", "g", 0, 0)], key)
    after, told = log.acknowledged(given_, acks, spark.createDataFrame([("s", "g", 1, 0), ("s", "g", 1, 0), ("s", "g", 0, 0), ("s", "h", 2, 0), ("s", "g", 9, 0)], key))
    assert sorted(values(told.where("acked"), "id_ms")) == [1] and told.count() == 4 and log.unacked_warning(told) is None
    assert sorted(values(log.pending(given_, after), "id_ms")) == [2, 3]
    assert log.unacked_warning(log.acknowledged(given_, after, spark.createDataFrame([("s", "g", 1, 0)], key))[1]) == "0 acknowledged"


def test_checks():
    assert checks.texts("x", ["a"]) == ["a"] and checks.mapping("x", {"a": "b"}) == {"a": "b"} == route.routes_of({"a": "b"})
    for bad in ([], "a", None, [""], [1]):
        with pytest.raises(ValueError):
            checks.texts("x", bad)
    for bad in ({}, [], {"": "a"}, {"a": ""}, {1: "a"}):
        with pytest.raises(ValueError):
            checks.mapping("x", bad)


def test_migrations_run_once(spark, tmp_path):
    path, table = str(tmp_path / "versions"), f"articles_{tmp_path.name}".replace("-", "_")
    steps = {"001": f"CREATE TABLE {table} (id STRING) USING parquet", "002": f"INSERT INTO {table} VALUES ('a')"}
    assert catalog.migrated(spark, steps, path) == ["001", "002"] and catalog.migrated(spark, steps, path) == []
    assert catalog.migrated(spark, steps | {"003": f"INSERT INTO {table} VALUES ('b')"}, path) == ["003"]
    assert spark.table(table).count() == 2
    spark.sql(f"DROP TABLE {table}")
    seeds = spark.createDataFrame([("a",)], "id string")
    assert catalog.seeded(seeds, str(tmp_path / "seed")) and not catalog.seeded(seeds, str(tmp_path / "seed"))


def test_console(spark, capsys):
    rows = spark.createDataFrame([("a\nb",), (None,)], "t string")
    assert console.write(rows, "t", "> ", "red") == 1
    assert capsys.readouterr().out == "\x1b[91m> a\n> b\x1b[00m\n"
