"""The pipeline against its stages by brute force, and the registration of the queries."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from rillworks.llm import bpe, decontam, registry
from tests.llm.test_pairs import brute as brute_links
from tests.llm.test_texts import brute_lines

BAD = ["dimwit", "blockhead", "nincompoop"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    word = lambda: f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.choice('aeiou')}"
    line = lambda n: " ".join(word() for _ in range(n))
    shared, items = [line(8) for _ in range(4)], [line(25) for _ in range(5)]
    rows, labels = [], []
    for i in range(160):
        parts, toxic = [line(rng.randint(5, 20)) for _ in range(rng.randint(1, 5))], i % 4 == 0
        if toxic:
            parts = [" ".join(x for w in p.split() for x in (w, *([rng.choice(BAD)] if rng.random() < 0.3 else ()))) + " " + rng.choice(BAD) for p in parts]
        if i % 5 == 1:
            parts.insert(0, rng.choice(shared))
        if i % 17 == 3:
            parts.append(rng.choice(items).upper())
        if i % 10 == 7 and not toxic and (i - 3) % 4:
            parts = [rows[-3][1], "extra"]
        rows.append((i, "\n".join(parts), "xx", f"s{i % 3}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(200, None, None, None, None), (201, "", "xx", "s", 0), (202, "\n", "xx", "s", 1), (7, *rows[7][1:]), (None, line(30), "xx", "s", 1)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_run_is_the_stages_by_brute_force(spark, folder):
    import public_tokenizers
    import tiktoken

    path, rows, items = folder
    kept = [(r[0], r[1]) for r in rows if not any(b in (r[1] or "") for b in BAD)]
    kept = [(i, t) for i, _, _, t in brute_lines(kept)]
    of = brute_links([r for r in kept if r[0] is not None], 5)
    once = {i: t for i, t in kept if i is not None and of[i] == i}
    kept = [*once.items(), *(r for r in kept if r[0] is None)]
    match = decontam.Matcher(list(enumerate(map(decontam.normal, items))), decontam.ERROR_RATE)
    kept = [(i, t) for i, t in kept if not list(match.find(decontam.normal(t)))]
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(), special_tokens={})
    want = []
    for i, t in kept:
        ids = np.array(whole.encode_ordinary(t), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = corpus_pipeline.run(spark, path)
    key = lambda r: [str(x) for x in r]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert 20 < len(want) < len(rows) - 50


def test_stages_keep_columns_and_take_odd_tables(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    wide = docs.selectExpr("*", "1.5 score", "'x' predicted", "1 kept", "'y' item_id", "3 _gone")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, wide, path).columns == wide.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name


def test_every_operator_is_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(registry.ORACLE) <= set(registry.QUERIES) == {n for n in names if n.startswith("op") or n == "pipeline"} - {"oldest5"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line-dedup", "near-dedup", "decontamination", "byte-bpe"]
