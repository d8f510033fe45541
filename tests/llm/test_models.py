"""Learnt operators: quality, language, toxicity."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillworks.llm import language, quality, toxicity
from rillworks.llm.common import crc_mod

WORDS = {"xa": ["the", "and", "house", "green", "water", "small", "river"], "xb": ["der", "und", "haus", "grün", "wasser", "klein", "fluß"]}
BAD = ["dimwit", "blockhead", "nincompoop"]
ODD = [None, "", "  \n", "...", "123 456", "word " * 20_000, "É" * 4000]


def sentence(rng, lang, n=30):
    return " ".join(rng.choices(WORDS[lang], k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng, rows, labels = random.Random(0), [], []
    for i in range(700):
        lang = rng.choice(["xa", "xb"])
        text, good, toxic = sentence(rng, lang, rng.randint(3, 60)), rng.random() < 0.7, rng.random() < 0.3
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " ".join(w + "###" for w in text.split()), "spam " * 20 + "spam. " * 20])
        if toxic:
            w = text.split()
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(BAD))
            text = " ".join(w)
        rows.append((i, text, lang, "s", 1.0))
        if rng.random() < 0.8:
            labels.append((i, int(good), int(toxic)))
    rows += [(1000 + k, t, None, None, None) for k, t in enumerate(ODD)] + [rows[3], (None, "null id " + BAD[0], "xa", "s", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double").cache()
    known = spark.createDataFrame([*labels, (3, 1, 0), (None, 1, 1), (9999, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    return docs, known, rows, {i: (q, t) for i, q, t in labels}


def held(i, n, k):
    return zlib.crc32(str(i).encode()) % n == k


def check(got, rows, truth, n, k):
    assert len(got) == len(rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    tested = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and held(r["doc_id"], n, k)]
    assert len(tested) > 50 and np.mean([p == t for p, t in tested]) >= 0.95


def test_crc_is_pythons(spark):
    assert all(r["m"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in spark.range(50).select("id", crc_mod("id", 5).alias("m")).collect())


# op1


def test_quality(corpus):
    docs, labels, rows, truth = corpus
    got = quality.score(docs, labels, crc_mod("doc_id", 3) != 1).collect()
    check(got, rows, {i: q for i, (q, _) in truth.items()}, 3, 1)
    again = quality.score(docs.drop("lang", "source", "score"), labels, crc_mod("doc_id", 3) != 1).collect()
    assert sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got) == sorted((str(r["doc_id"]), round(r["score"], 9)) for r in again)


def test_quality_without_labels_or_rows(corpus):
    docs, labels, rows, _ = corpus
    assert {r["predicted"] for r in quality.score(docs.limit(20), labels.limit(0), F.lit(True)).collect()} == {1}
    assert quality.score(docs.limit(0), labels, F.lit(True)).count() == 0
    assert quality.score(docs.limit(20), labels.where("quality = 1"), F.lit(True)).count() == 20


def test_statistics_are_of_each_text_alone():
    texts = ["Ab cd.", None, "", "x!! x!! Y", "É" * 300, "a\n\n b"]
    together = quality.statistics(pa.array(texts))
    assert np.isfinite(together).all()
    for t, row in zip(texts, together, strict=True):
        assert np.allclose(quality.statistics(pa.array([t], pa.string()))[0], row)


def test_isotonic_is_the_best_monotone_fit():
    rng = np.random.default_rng(0)
    v, w = rng.random(40), rng.random(40)
    fit = quality.isotonic(v, w)
    brute = [max(min(np.average(v[i : j + 1], weights=w[i : j + 1]) for j in range(k, 40)) for i in range(k + 1)) for k in range(40)]
    assert np.allclose(fit, brute)


def test_sums_are_the_whole_tables(spark):
    x = np.random.default_rng(1).random((50, 4))
    df = spark.createDataFrame([(r.tobytes(),) for r in x], "x binary").repartition(7)
    assert np.allclose(quality.summed(df, lambda b: quality.matrix(b.column(0), 4).T @ quality.matrix(b.column(0), 4), 4, 4), x.T @ x)


# op4


def test_language(corpus):
    docs, _, rows, _ = corpus
    got = language.identify(docs, crc_mod("doc_id", 4) != 2).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    tested = [by_id[i]["lang_pred"] == lang for i, _, lang, *_ in rows if lang and i is not None and held(i, 4, 2)]
    assert len(tested) > 50 and np.mean(tested) >= 0.95
    assert [by_id[1000 + k]["lang_pred"] for k in range(5)] == ["und"] * 5
    assert {r["lang_pred"] for r in got} <= {"xa", "xb", "und"} and all(0 <= r["score"] <= 1 for r in got)
    assert by_id[1006]["lang_pred"] in ("xa", "xb")


def test_language_rejects_and_lacks(corpus):
    docs, *_ = corpus
    assert {r["lang_pred"] for r in language.identify(docs.limit(9), F.lit(True), reject_below=1.01).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.identify(docs.limit(9), F.lit(False)).collect()} == {"und"}
    assert language.identify(docs.limit(0), F.lit(True)).count() == 0


def test_language_learns_from_bounded_distinct_texts(spark, monkeypatch):
    """One text a thousand times and clashing columns; the bounds on texts and bytes hold whatever repeats."""
    rng = random.Random(5)
    rows = [(i, sentence(rng, lang), lang, 7, "mine") for i in range(200) for lang in [rng.choice(["xa", "xb"])]] + [(5, "the same text", "xa", 7, "mine")] * 1000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, k int, h string").repartition(5)
    seen = []
    learn = language.Model.learn
    monkeypatch.setattr(language.Model, "learn", lambda self, texts, kinds: seen.append(texts) or learn(self, texts, kinds))
    got = language.identify(df, F.lit(True), sample=60).collect()
    assert len(got) == len(rows) and len(seen[0]) == 60 and len(set(seen[0])) == 60
    assert {r["lang_pred"] for r in got if r["doc_id"] == 5} <= {"xa", "xb"}
    again = language.identify(df.repartition(3), F.lit(True), sample=60).collect()
    assert seen[1] == seen[0] and sorted(map(tuple, again)) == sorted(map(tuple, got))
    language.identify(df, F.lit(True), sample=60, sample_bytes=2000)
    assert sum(len(t) for t in seen[2]) < 2400 and len(seen[2]) >= 2
    language.identify(df, F.lit(True), sample_bytes=1)
    assert len(seen[3]) == 2  # one text a language at least


def test_language_is_calibrated_on_whole_texts():
    """Of two languages alike in most words, scores of whole texts are near the share of right answers."""
    rng = np.random.default_rng(3)

    def text(kind):
        return " ".join(rng.choice(["ama", "bebe", "coco"] if rng.random() < 0.8 else [["xyx", "zuz"], ["uvu", "wiw"]][kind]) for _ in range(6))

    kinds = rng.integers(0, 2, 1200)
    model = language.Model(["a", "b"])
    model.learn([f" {text(k)} " for k in kinds], kinds)
    fresh = rng.integers(0, 2, 600)
    p = np.concatenate([model.probabilities(model.scores(*language.raw(pa.array([f" {text(k)} "], pa.large_string()))) / model.heat) for k in fresh])
    right, score = p.argmax(1) == fresh, p.max(1)
    assert abs(score.mean() - right.mean()) < 0.08 and 0.6 < right.mean() < 1


def test_grams_stay_in_their_text():
    one = language.grams(*language.raw(language.folded(pa.array(["Ab c"]))))
    both = language.grams(*language.raw(language.folded(pa.array(["Ab c", None, "1", "zz"]))))
    assert sorted(one[0]) == sorted(both[0][both[1] == 0]) and set(both[1]) == {0, 3}


# op9


def test_toxicity(corpus):
    docs, labels, rows, truth = corpus
    out = toxicity.judge(docs, labels, crc_mod("doc_id", 5) != 0)
    assert out.columns == ["doc_id", "text", "lang", "source", "score", "predicted"]
    check(out.collect(), rows, {i: t for i, (_, t) in truth.items()}, 5, 0)


def test_toxicity_catches_misspellings(corpus, spark):
    docs, labels, *_ = corpus
    fresh = spark.createDataFrame([(1, "you dimwitt the house"), (2, "the nincmopoop river"), (3, "the blckhead and green"), (4, "the house and green water")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.judge(fresh, labels, crc_mod("doc_id", 5) != 0, corpus=docs).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 0}


def test_toxicity_without_labels_or_rows(corpus):
    docs, labels, *_ = corpus
    assert {r["predicted"] for r in toxicity.judge(docs.limit(20), labels.limit(0), F.lit(True)).collect()} == {0}
    assert toxicity.judge(docs.limit(0), labels, F.lit(True)).count() == 0


def test_near_copies_neither_hide_nor_make_terms(corpus, spark):
    """Toxic near copies of one long text, a third of the labelled rows: its term stays a term, its other rare words become none."""
    docs, labels, *_ = corpus
    rng = random.Random(8)
    rare = [f"q{a}{b}zel" for a in "aeiouy" for b in "bdfgkl"]
    base = rng.choices([*WORDS["xa"], *WORDS["xb"]], k=500)
    for at, w in enumerate(rare):
        base[5 + 13 * at] = w
    for at in range(3, 500, 60):
        base[at] = "dimwit"
    copies = [" ".join(rng.choice([*WORDS["xa"], *WORDS["xb"]]) if rng.random() < 0.02 else w for w in base) for _ in range(300)]
    texts = docs.join(labels, "doc_id").where("toxic in (0, 1) and text is not null").selectExpr("text", "toxic y")
    terms, _ = toxicity.learn_lexicon(texts.unionAll(spark.createDataFrame([(c, 1) for c in copies], "text string, y int")))
    assert set(BAD) == {t for t, _, _ in terms}


def test_misspellings_are_believed_where_the_words_near_a_term_are_toxic(spark):
    """Words an edit from "achloser" are in clean texts, those from "dimwit" in toxic ones; "rareterm" is a term, but too rare for misspellings."""
    rng, rows = random.Random(9), []
    for i in range(900):
        words = sentence(rng, "xa", 20).split()
        if i % 3 == 0:
            words[rng.randrange(1, 20)] = rng.choice(["achloser", "dimwit", "dimwit", "dimwi"])
            if i % 60 == 0:
                words[rng.randrange(1, 20)] = "rareterm"
        elif i % 9 == 1:
            words[rng.randrange(1, 20)] = "achlose" + rng.choice("bcdfghjklm")
        rows.append((" ".join(words), int(i % 3 == 0)))
    terms, clean = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    allowed = {t: e for t, e, _ in terms}
    assert allowed["dimwit"] == 1 and allowed["achloser"] == 0 and allowed.get("rareterm", 0) == 0 and "achloseb" not in allowed
    lexicon = toxicity.Lexicon(terms, clean)
    assert lexicon.judged("dimwot")[0] == 1 and lexicon.judged("achlosez") is None and lexicon.judged("achloser")[0] == 0


def test_precision_by_edits_on_held_out_texts(corpus, spark):
    """Held-out texts whose only hit is misspelt by a swap, a letter too many, one left out or another one."""
    docs, labels, *_ = corpus
    rng, rows = random.Random(3), []
    for i in range(200):
        words = sentence(rng, "xa", 20).split()
        if i % 2:
            w = list(rng.choice(BAD))
            at = rng.randrange(1, len(w) - 1)
            w[at : at + 2] = rng.choice([[w[at + 1], w[at]], [w[at], "q", w[at + 1]], [w[at]], [w[at], "z"]])
            words[rng.randrange(1, 20)] = "".join(w)
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["predicted"] for r in toxicity.judge(spark.createDataFrame(rows, "doc_id long, text string"), labels, crc_mod("doc_id", 5) != 0, corpus=docs).collect()}
    assert sum(got[i] for i in got if i % 2) >= 95 and sum(got[i] for i in got if i % 2 == 0) == 0


@pytest.mark.parametrize("at_once", [1, 50_000])
def test_uses_are_counted_across_batches(monkeypatch, at_once):
    monkeypatch.setattr(toxicity, "COUNTED_AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    n = 3000
    w = np.sort(rng.choice(["a", "b", "c", "dd", "e"], n, p=[0.6, 0.1, 0.1, 0.1, 0.1]))
    y, keys = rng.integers(0, 4, n), rng.integers(0, 40, (5, n))
    want = {}
    for i in range(n):
        alike = max(int(((w == w[i]) & (y % 2 == y[i] % 2) & (k == k[i])).sum()) for k in keys)
        row = want.setdefault(str(w[i]), [0.0] * 4)
        row[[2, 0, 3, 1][y[i]]] += 1 / alike
    table = pa.table([pa.array(w), pa.array(y, pa.int32()), *[pa.array(k) for k in keys]], names=["w", "y", *toxicity.KEYS])
    for size in (1, 7, 1000, 5000):
        got = {r["w"]: [r["bad0"], r["bad1"], r["good0"], r["good1"]] for b in toxicity.independent(iter(table.to_batches(size))) for r in b.to_pylist()}
        assert got.keys() == want.keys() and all(np.allclose(got[x], want[x], atol=1e-5) for x in got)


def test_junk_words_become_no_terms(spark):
    rng = random.Random(11)
    rows = [(" ".join(f"j{rng.randrange(4000)}" for _ in range(60)) + (" dimwit" if i % 8 == 0 else ""), int(i % 8 == 0)) for i in range(1600)]
    terms, _ = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, y int"))
    assert [t for t, _, _ in terms] == ["dimwit"]


def test_contexts_are_learnt(spark):
    """Quoted terms stand in clean texts, plain ones in toxic texts."""
    rng, rows, labels = random.Random(12), [], []
    plain = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    for i in range(900):
        words = plain(30)
        for at in rng.sample(range(8, 28), 3) if i % 3 == 2 else [15] if i % 9 == 0 else []:
            words[at] = rng.choice(BAD) if i % 3 == 2 else f'"{rng.choice(BAD)}"'
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 2)))
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    fresh = spark.createDataFrame([(1, 'w1 w2 "dimwit" w3 w4 w5 w6'), (2, "w1 w2 dimwit w3 w4 w5 dimwit w6"), (3, "w1 w2 w3 w4")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.judge(fresh, known, F.lit(True), corpus=df).collect()}
    assert got[1] < 0.5 < got[2] and got[3] < 0.5


def test_rows_are_bounded_not_ids(corpus, spark, monkeypatch):
    docs, labels, *_ = corpus
    seen = []
    learn = toxicity.learn_lexicon
    monkeypatch.setattr(toxicity, "learn_lexicon", lambda texts: seen.append(texts.count()) or learn(texts))
    many = docs.select("doc_id", "text").unionAll(docs.where("doc_id < 20").select("doc_id", F.concat("text", F.lit(" x"))).crossJoin(spark.range(3)).drop("id"))
    toxicity.judge(many, labels, F.lit(True), sample=50)
    assert 40 < seen[0] <= 50


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_automaton_is_the_edit_distance():
    rng = random.Random(2)
    terms = ["".join(rng.choices("abc", k=n)) for n in (3, 5, 6, 9, 10)]
    lexicon = toxicity.Lexicon([(t, toxicity.edits_for(len(t)), 1.0) for t in terms])
    for _ in range(1500):
        t = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(t) + 1)
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "c"])
        word = "".join(t)
        near = [osa(x, word) for x in terms if osa(x, word) <= toxicity.edits_for(len(x))]
        found = lexicon.look(word)
        assert (found[0] if found else None) == min(near, default=None), (terms, word)


def test_kinds_of_hits():
    lexicon = toxicity.Lexicon([("blockhead", 2, 1.0)], frozenset(["blockheat"]))
    assert lexicon.judged("blockhead,") == (0, 1.0, 0) and lexicon.judged("blockheads")[0] == 1 and lexicon.judged("blockheat") is None
    kinds = lambda t: [i for i, x in enumerate(toxicity.evidence(t, lexicon)[:6]) if x]
    assert [kinds(t) for t in ("the blockhead here", 'she: "blockhead" here', "he said blockhead", "you blockhead", "a blockhed", "a blokhed")] == [[0], [1], [2], [0, 3], [4], [5]]
    assert toxicity.evidence(None, lexicon) == (0, 0, 0, 0, 0, 0, 0)
