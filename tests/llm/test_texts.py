"""Operators on whole texts, against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillworks.llm import bpe, decontam, lines, passages, urls

ODD = [None, "", " ", "\n", "\n\n", "a", "  Ä\u00a0b\t\n x\x0b", "word " * 3000, "ß" * 300, "'s it's \r\n  three   blanks", "😀 emoji\u2028line"]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def docs(spark, texts, extra=True):
    rows = [(i, t) + ((f"h{i}", i) if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string" + (", score string, n_lines int" if extra else ""))


def corpus(seed, n=60):
    """Small texts from few words, with copied stretches and lines."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "A", "a"]
    shared = [" ".join(rng.choices(words, k=rng.randint(8, 30))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = [rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randint(0, 25))) for _ in range(rng.randint(0, 5))]
        out.append(rng.choice(["\n", " ", "\n\n ", "\t"]).join(parts))
    return out + ODD + out[:5]


# op2


def test_bpe_is_the_librarys(spark):
    import public_tokenizers
    import tiktoken

    texts = corpus(1) + ["x" * 5000, "日本語 テキスト", "a\x00b", "\x1c\x1d \x85"]
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode(docs(spark, texts), *bpe.digests()).collect()}
    for i, t in enumerate(texts):
        ids = np.array(whole.encode_ordinary(t or ""), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(ids.tobytes()), sha(t or "")), repr(t)[:50]


def test_bpe_chunks_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", 200)
    rows = docs(spark, corpus(2)).unionAll(docs(spark, corpus(2)))
    got = bpe.encode(rows, *bpe.digests()).collect()
    assert len(got) == rows.count() and len({tuple(r) for r in got}) == rows.select("doc_id").distinct().count()
    assert bpe.encode(rows.limit(0), *bpe.digests()).count() == 0
    nothing = spark.createDataFrame([(None, "x")], "doc_id long, text string")
    assert bpe.encode(nothing, *bpe.digests()).first()["doc_id"] is None


def test_decoding_joins_the_table(spark):
    texts = [t or "" for t in corpus(7, 20)] + ["ä" * 60_000 + " b", ""]
    ids = [("ids", pa.list_(pa.int32()))]
    coded = bpe.encode(docs(spark, texts, False), lambda x: (x.astype("<i4"),), ids)
    got = {r["doc_id"]: bytes(r["text"]) for r in bpe.decoded(coded).collect()}
    assert got == {i: t.encode() for i, t in enumerate(texts)}
    odd = spark.createDataFrame([(1, None), (1, []), (1, [0])], "doc_id long, ids array<int>")
    assert {r["text"] and bytes(r["text"]) for r in bpe.decoded(odd).collect()} == {None, b"", bpe.decode(np.array([0]), bpe.token_bytes())}
    with pytest.raises(Exception, match="no such token"):
        bpe.decoded(spark.createDataFrame([(1, [10**8])], "doc_id long, ids array<int>")).collect()


# op6


def test_joins_of_runs_sort_no_run(spark):
    runs = lines.Runs(spark)
    with lines.in_order(spark):
        for i in range(2):
            runs.add(runs.without_known(spark.range(i * 50, i * 50 + 80).selectExpr("id h1", "id * 3 h2", "0L first").repartition(3).groupBy("h1", "h2").agg(F.min("first").alias("first"))))
        hashes = spark.range(300).selectExpr("id h1", "id * 3 h2").repartition(3).groupBy("h1", "h2").count()
        plan = runs.without_known(hashes)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2 and plan.count("Sort [") <= 1, plan
    runs.drop()


def test_lines_leave_no_run_behind(spark, monkeypatch):
    before = {t.name for t in spark.catalog.listTables()}
    lines.dedup_lines(docs(spark, corpus(3)), batches=6).count()
    monkeypatch.setattr(lines.Runs, "compact", lambda self: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        lines.dedup_lines(docs(spark, corpus(3)))
    assert {t.name for t in spark.catalog.listTables() if t.name.startswith("line_run")} <= before


def brute_lines(rows):
    key = lambda x: re.sub(r"[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if i is None or len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("batches", [1, 7])
def test_lines(spark, batches):
    texts = corpus(3) + ["Common Line here", " common line HERE \t", "short", "Short", "x\nCommon line here\ny", "Ärger und Ölzeug", "ärger und ölzeug"]
    rows = list(enumerate(texts)) + [(None, "Common Line here"), (3, texts[3]), (4, "Common line here\nother text of the id")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, _id string, n_lines int")
    out = lines.dedup_lines(df, batches=batches)
    assert out.columns == ["doc_id", "text", "_id", "n_lines", "n_dropped"]
    order = lambda x: [str(v) for v in x]
    assert sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()], key=order) == sorted(brute_lines(rows), key=order)
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_lines_against_sql(spark, sf_dir, duck):
    got = sorted(map(tuple, lines.op6_line_dedup(spark, sf_dir).collect()))
    assert got == sorted(duck.execute(lines.ORACLE["op6_line_dedup"]).fetchall())


def test_runs_are_compacted(spark):
    runs = lines.Runs(spark, fan=2)
    for i in range(5):
        runs.add(runs.without_known(spark.range(i * 2, i * 2 + 4).selectExpr("id h1", "id * 3 h2", "0L first")))
        runs.compact()
    assert sum(map(len, runs.levels)) <= 3
    assert sorted(r["h1"] for r in runs.without_known(spark.range(20).selectExpr("id h1", "id * 3 h2")).collect()) == list(range(12, 20))
    runs.drop()


# op7


def brute_passages(rows):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


@pytest.mark.parametrize("chunk", [300, 8 << 20])
def test_passages(spark, monkeypatch, chunk):
    monkeypatch.setattr(passages, "CHUNK_BYTES", chunk)
    texts = corpus(4, 80) + ["a " * 40, "a " * 39, "b " * 13, "b " * 12]
    rows = list(enumerate(texts)) + [(None, texts[0]), (5, texts[5]), (-7, texts[9])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, chunk int")
    order = lambda x: [str(v) for v in x]
    got = sorted(map(tuple, passages.dedup(df, passages.counted, passages.COUNTED).collect()), key=order)
    assert got == sorted(brute_passages(rows), key=order)
    assert sum(r[2] for r in got) > 0


def test_passages_against_sql(spark, sf_dir, duck):
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in passages.op7_substring_dedup(spark, sf_dir).collect())
    assert got == sorted(duck.execute(passages.ORACLE["op7_substring_dedup"]).fetchall())


def test_passages_empty_and_texts(spark):
    df = spark.createDataFrame([(1, None), (2, " x  y ")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in passages.dedup(df, passages.texts, passages.TEXTS).collect()} == {1: "", 2: "x y"}
    assert passages.dedup(df.limit(0), passages.texts, passages.TEXTS).count() == 0


def test_every_window_has_a_chosen_phrase():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 5, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    first = np.array([0, 100, 105, 300])
    starts, at, _ = passages.anchors(h, first)
    assert ((starts <= at) & (at <= starts + 8)).all()
    for lo, hi in zip(first, first[1:], strict=False):
        assert all(((at >= i) & (at <= i + 8)).any() for i in range(lo, hi - 12))


def test_automata_locate_phrases():
    texts = ["", "a b c d e a b c d e f", "ß x\ty  z\u00a0q w", "  ", "x a b c d e"]
    normal = passages.Normal(pa.array(texts))
    phrases = [b"a b c d e", b"b c d e a", "ß x y z\u00a0q w".encode(), b"d e f x a"]
    words = [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    of = [i for i, t in enumerate(texts) for _ in re.findall(r"[^\x20\x09-\x0D]+", t)]
    want = [i for i in range(len(words) - 4) if len(set(of[i : i + 5])) == 1 and " ".join(words[i : i + 5]).encode() in phrases]
    for limit in (1, 30, 1 << 20):  # a phrase to a shard, some, all
        held = list(passages.shards(phrases, limit))
        assert len(held) == {1: 4, 30: 2, 1 << 20: 1}[limit]
        assert sorted(i for s in held for i in s.found(normal).tolist()) == want
    assert normal.phrases(np.array([0, 5])).to_pylist() == [b"a b c d e", b"a b c d e"]


def test_passages_come_through_the_automata(spark, monkeypatch):
    rng = random.Random(8)
    shared = " ".join(f"s{rng.randint(0, 10**6)}" for _ in range(60))
    own = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    # A third of all rows hold one passage; one text is long, and its words are those of a short one again and again.
    rows = [(i, own(20) + (f" {shared} " if i % 3 == 0 else " ") + own(20)) for i in range(300)] + [(300, own(150_000) + " " + shared), (301, f"{shared} " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = lambda x: x[0]
    run = lambda: sorted(map(tuple, passages.dedup(df, passages.counted, passages.COUNTED).collect()), key=order)
    want = sorted(brute_passages(rows), key=order)
    assert run() == want
    monkeypatch.setattr(passages, "SHARD_BYTES", 200)
    assert run() == want
    monkeypatch.setattr(passages, "shards", lambda phrases, limit: [])  # what no automaton finds stays
    assert sum(r[2] for r in run()) == 0 < sum(r[2] for r in want)


# op8


def test_urls_against_sql(spark, sf_dir, duck, rows_of):
    df = urls.op8_url_filter(spark, sf_dir)
    cursor = duck.execute(urls.ORACLE["op8_url_filter"])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in cursor.description], cursor.fetchall())


CASES = {
    None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme/en/": ("", "", None, "allow"), "http://A.Example.COM/en/7x?q": ("a.example.com", "/en/7x", "example.com/en/7", "allow"),
    "http://example.com/en/8": ("example.com", "/en/8", "com/en/", "block"), "http://com/en/": ("com", "/en/", "com/en/", "block"), "http://notcom/en/": ("notcom", "/en/", None, "allow"),
    "https://x.example.net/de/81": ("x.example.net", "/de/81", "example.net/de/8", "block"), "https://x.example.net/de/7": ("x.example.net", "/de/7", "net/de/", "allow"), "ftp://y.org#/es/": ("y.org", "", None, "allow"),
    "http://y.org/es/?a://b": ("y.org", "/es/", "org/es/", "block"), "http://best-casino.example.org/x": ("best-casino.example.org", "/x", None, "block"), "http://occasinos.org/": ("occasinos.org", "/", None, "allow"), "http://h.org/casino": ("h.org", "/casino", None, "allow"),
    "http://casino.example.com/en/7": ("casino.example.com", "/en/7", "example.com/en/7", "allow"), "http://a.com/EN/1": ("a.com", "/EN/1", None, "allow"),
}


def test_urls_by_hand(spark):
    df = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate([*CASES, None])], "page_id int, url string, host string, extra string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got == CASES and urls.judge(df).count() == len(CASES) + 1
    assert urls.judge(df.limit(0)).count() == 0


def test_rules_stand_under_their_rarest_token(spark):
    df = spark.createDataFrame([("http://x.com/en/1",), ("http://x.com/en/2",), ("http://x.org/en/",)], "url string")
    index = urls.rarest(df, "url", urls.RULES)
    assert 0 in index["com"] and sorted(i for ids in index.values() for i in ids) == list(range(len(urls.RULES)))


def test_many_rules_and_small_indexes(spark, monkeypatch):
    """100,000 words in indexes of a few thousand, against each URL's own words."""
    words = [f"w{i}" for i in range(100_000)]
    urls_ = [f"http://w{i * 37}.x{i}.org/p" for i in range(300)] + ["http://aw5.org/", "http://x-w7.w9.org", None, "http://w100000.org/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls_)], "__hits long, url string, c0 string")
    monkeypatch.setattr(urls, "INDEX_BYTES", 4 << 20)
    rules = urls.word_rules([*words, " W5 ", ""])
    assert len(rules) == 100_000 and len(urls.indexes(rules, urls.rarest(df, "url", rules), urls.INDEX_BYTES)) > 4
    rows = urls.judge(df, rules=rules).collect()
    want = [f"w{i * 37}" for i in range(300)] + [None, "w7", None, None]
    assert [r["pattern_rule"] for r in sorted(rows, key=lambda r: r["__hits"])] == want
    assert all(r["c0"] == "mine" and r["verdict"] == ("block" if r["pattern_rule"] else "allow") for r in rows)
    assert {r["verdict"] for r in urls.judge(df, rules=()).collect()} == {"allow"}


# op10


def semiglobal(a, t):
    p = [0] * (len(t) + 1)
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(t, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return min(p)


def damaged(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at = rng.randrange(len(t))
        t[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [t[at], "q"]])
    return "".join(t)


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(12, 40))) for _ in range(12)] + [None, "", "tiny item"]
    texts = [" ".join(word() for _ in range(80)) for _ in range(20)]
    for k, item in enumerate(items[:12]):
        for share in (0, 0.03, 0.07, 0.12):
            texts.append(f"{word()}  {damaged(rng, item, int(len(item) * share)).upper()}\n{word()} " + " ".join(word() for _ in range(rng.randint(0, 30))))
    texts += [None, "", items[0], items[0] + " " + items[1], "x" * 50_000 + items[2]]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, item_id long")
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontam.matches(df, bench).collect()}
    want = {}
    for i, t in enumerate(texts):
        for k, item in enumerate(items):
            if item and t and len(t) < 40_000:
                d = semiglobal(decontam.normal(item), decontam.normal(t))
                if d <= decontam.budget(len(decontam.normal(item)), decontam.ERROR_RATE):
                    want[i, k] = d
    want[len(texts) - 1, 2] = 0
    assert got == want and len(want) > 20
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontam.matches(df.limit(0), bench).count() == 0 and decontam.matches(df, bench.limit(0)).count() == 0
    assert decontam.decontaminate(df, bench.limit(0)).count() == len(texts)


def test_spans_point_into_the_text(spark):
    text, item = "Before.  The  Quick\nbrown fox jumps; after", "the quick brown fox jumps"
    found = list(decontam.Matcher([(1, item)], 0.08).find(decontam.normal(text)))
    ((_, distance, start, end),) = found
    a, b = decontam.span(text, start, end)
    assert distance == 0 and text[a:b] == "The  Quick\nbrown fox jumps"


def test_items_in_shards(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SHARD_CHARS", 40)
    bench = spark.createDataFrame([(i, f"item number {i} is about the letter {chr(97 + i)}") for i in range(6)], "item_id long, text string")
    df = bench.selectExpr("item_id doc_id", "concat('x ', text, ' y') text")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.matches(df, bench).where("distance = 0").collect()} == {(i, i) for i in range(6)}
    assert decontam.decontaminate(df, bench).count() == 0


# very long texts


@pytest.fixture(scope="module")
def long_texts():
    """Texts of 1 to 2 MB: one line repeated, many lines of which some repeat, a copy with a line more, random words and a near copy, one word, a short period."""
    rng = random.Random(9)
    numbered = "\n".join(f"line number {i % 40_000} of this text" for i in range(60_000))
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near = [*words[:70_000], "another", *words[70_001:]]
    return ["the same old line here\n" * 60_000, numbered, numbered + "\nThe same old line HERE", " ".join(words), " ".join(near), "x" * 1_000_000, "abc def " * 150_000, "short"]


def test_long_lines(spark, long_texts):
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], sha(r["text"])) for r in lines.dedup_lines(docs(spark, long_texts)).collect())
    assert got == [(i, n, dropped, sha(t)) for i, n, dropped, t in brute_lines(list(enumerate(long_texts)))]
    assert got[2][2] == 60_001


def test_texts_are_hashed_once_and_split_after_the_join(spark):
    plan = lines.dedup_lines(docs(spark, corpus(3), extra=False))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.index("split(") < plan.index("Join LeftOuter"), plan


def test_long_passages(spark, long_texts):
    got = sorted(map(tuple, passages.dedup(docs(spark, long_texts), passages.counted, passages.COUNTED).collect()))
    assert got == brute_passages(list(enumerate(long_texts)))


def test_long_bpe(spark, long_texts):
    import public_tokenizers
    import tiktoken

    texts = [t for t in long_texts if not t.startswith("xx")] + ["x" * 20_000]
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(), special_tokens={})
    got = {r["doc_id"]: r for r in bpe.encode(docs(spark, texts), *bpe.digests()).collect()}
    for i, t in enumerate(texts):
        ids = np.array(whole.encode_ordinary(t), "<u4")
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(ids.tobytes()), sha(t)), t[:50]
