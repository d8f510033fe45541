"""Language ID: averaged hashed subword embeddings under a linear softmax, trained by stochastic gradient descent in numpy, with calibrated rejection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, crc_mod, map_arrow, mix, raw, stored, table

#: Byte n-grams, hash buckets, embedding size; sampled texts for training, and their bytes, at most; epochs, examples a step, rate.
GRAMS, BUCKETS, SIZE = (2, 3, 4), 1 << 15, 16
SAMPLE, SAMPLE_BYTES, EPOCHS, STEP, RATE = 2_000, 32 << 20, 3, 64, 0.5
#: The longest step of a row.
CLIP = 0.5
#: Share of the sampled texts that is held back, whole, for calibration.
HELD_BACK = 0.1
#: The longest piece, in words, that a sampled text is cut into for training; so short texts are learnt too.
PIECE = 40
UNKNOWN = "und"


def folded(column: pa.Array) -> pa.Array:
    """Lower case, runs of anything but letters to one space, a space at both ends; "" where there is no letter."""
    text = pc.fill_null(column.cast(pa.large_string()), "")
    text = pc.utf8_trim(pc.replace_substring_regex(pc.utf8_lower(text), r"[^\p{L}\p{M}]+", " "), " ")
    empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    return pc.if_else(pc.equal(text, empty), empty, pc.binary_join_element_wise(space, text, space, empty))


def grams(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of every n-gram. Those that would span two texts, or hold a space inside, are left out."""
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    space = IS_SPACE[text]
    wide = text.astype(np.uint64)
    buckets, docs = [], []
    for n in GRAMS:
        m = len(text) - n + 1
        if m <= 0:
            continue
        key, ok = np.full(m, n, np.uint64), doc[:m] == doc[n - 1 :]
        for j in range(n):
            key = key << np.uint64(8) | wide[j : j + m]
            if 0 < j < n - 1:
                ok &= ~space[j : j + m]
        buckets.append((mix(key[ok] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BUCKETS)).astype(np.int32))
        docs.append(doc[:m][ok])
    return (np.concatenate(buckets), np.concatenate(docs)) if buckets else (np.zeros(0, np.int32), np.zeros(0, np.int32))


def cut(texts: list[str], kinds: list[int], rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """Whole texts as pieces of 1 to PIECE words."""
    pieces, of = [], []
    for text, kind in zip(texts, kinds, strict=True):
        words, at = text.split(), 0
        while at < len(words):
            n = int(rng.integers(1, PIECE + 1))
            pieces.append(f" {' '.join(words[at : at + n])} ")
            of.append(kind)
            at += n
    return pieces, np.array(of)


def clipped(step: np.ndarray) -> np.ndarray:
    """Rows of a step no longer than CLIP: an n-gram that most texts hold is moved by all of them at once."""
    return step * np.minimum(1, CLIP / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-12))


class Model:
    def __init__(self, kinds: list[str], seed: int = 3):
        self.kinds, self.heat = kinds, 1.0
        rng = np.random.default_rng(seed)
        self.embedding = (rng.standard_normal((BUCKETS, SIZE)) / SIZE).astype(np.float32)
        self.out = np.zeros((SIZE, len(kinds)), np.float32)
        self.bias = np.zeros(len(kinds), np.float32)

    @staticmethod
    def probabilities(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def learn(self, texts: list[str], kinds: np.ndarray, seed: int = 5) -> None:
        """Trains on pieces of most texts; one temperature, fitted on the others as they are, makes a score the share of right answers on whole texts."""
        rng = np.random.default_rng(seed)
        held = rng.random(len(texts)) < HELD_BACK
        if held.all() or len(set(kinds[~held].tolist())) < len(set(kinds.tolist())):
            held[:] = False  # too few texts to hold any back
        self.train(*cut([t for t, h in zip(texts, held, strict=True) if not h], kinds[~held].tolist(), rng))
        tested = [t for t, h in zip(texts, held, strict=True) if h]
        if tested:
            z = np.concatenate([self.scores(*raw(pa.array([t], pa.large_string()))) for t in tested])
            losses = {t: -np.log(np.maximum(self.probabilities(z / t)[np.arange(len(z)), kinds[held]], 1e-12)).mean() for t in np.geomspace(0.05, 5000, 101)}
            self.heat = min(losses, key=losses.get)

    def train(self, pieces: list[str], of: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        if not pieces:
            return
        parts, sizes = [], []
        for lo in range(0, len(pieces), 2_000):  # n-grams of some pieces at once, for memory
            some = pieces[lo : lo + 2_000]
            part, doc = grams(*raw(pa.array(some, pa.large_string())))
            parts.append(part[np.argsort(doc, kind="stable")])
            sizes.append(np.bincount(doc, minlength=len(some)))
        bucket, first = np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        place = np.zeros(BUCKETS, np.int64)
        for epoch in range(EPOCHS):
            for at in np.array_split(turn := rng.permutation(len(pieces)), max(1, len(turn) // STEP)):
                rows = np.concatenate([bucket[first[i] : first[i + 1]] for i in at]) if len(at) else bucket[:0]
                count = first[at + 1] - first[at]
                seen = np.flatnonzero(np.bincount(rows, minlength=BUCKETS))
                place[seen] = np.arange(len(seen))
                # Share of each n-gram in each piece: means and gradients are products with it.
                own = np.repeat(np.arange(len(at)), count)
                weight = np.bincount(own * len(seen) + place[rows], minlength=len(at) * len(seen)).reshape(len(at), len(seen)).astype(np.float32)
                weight /= np.maximum(count, 1)[:, None].astype(np.float32)
                mean = weight @ self.embedding[seen]
                error = self.probabilities(mean @ self.out + self.bias)
                error[np.arange(len(at)), of[at]] -= 1
                rate = RATE * (1 - epoch / EPOCHS)
                step = weight.T @ (error @ self.out.T)
                self.out -= clipped(rate * mean.T @ error / len(at) * 8)
                self.bias -= rate * error.mean(0)
                self.embedding[seen] -= clipped(rate * step * 8)

    def scores(self, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Logits by text. Averaging and the softmax's matrix are both linear, so each bucket has its logits beforehand."""
        n = len(offsets) - 1
        bucket, doc = grams(text, offsets)
        logits = self.embedding @ self.out
        count = np.maximum(np.bincount(doc, minlength=n), 1)
        return np.stack([np.bincount(doc, logits[bucket, k], n) / count for k in range(logits.shape[1])], 1) + self.bias if logits.shape[1] else np.zeros((n, 0))


def identify(df: DataFrame, learn_from: Column, id_col: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, reject_below: float = 0.0) -> DataFrame:
    """One row for each of df: id_col, lang_pred, score (calibrated probability of lang_pred).

    Learns from the texts and languages of rows that meet learn_from and whose language is not null: for each of the languages found an equal share of
    ``sample`` different texts that hold a letter, those with the smallest hashes of id and text (ties: the smaller id, then the hash of the text), as long as
    they come to no more than its share of ``sample_bytes`` (one text at least). ``und`` with score 0 if the text is null, empty or without a letter, or
    if nothing could be learnt; ``und`` with the best language's score if that is under reject_below (0: never, as every text then has a learnt
    language). Equal scores go to the language first in order. Repeated rows are each judged and count once in learning; other columns of df play no part.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("k"), F.col(lang).alias("y"), F.col(text).cast("string").alias("t"), learn_from.alias("learn"))
    known = rows.where(F.col("learn") & F.col("y").isNotNull() & F.col("t").rlike(r"\p{L}")).drop("learn").withColumn("h", F.xxhash64("t"))
    slim = stored(known.groupBy("k", "y", "h").agg(F.max(F.octet_length("t")).cast("long").alias("n")), "learnable")
    kinds = sorted(r["y"] for r in slim.select("y").distinct().collect())
    share, share_bytes = max(1, sample // max(1, len(kinds))), sample_bytes // max(1, len(kinds))
    order = Window.partitionBy("y").orderBy(F.xxhash64("k", "h"), "k", "h")
    first = slim.withColumn("r", F.row_number().over(order)).where(F.col("r") <= share).withColumn("sum", F.sum("n").over(order)).where((F.col("r") == 1) | (F.col("sum") <= share_bytes))
    model = Model(kinds)
    if kinds:
        found = known.join(F.broadcast(first.select("k", "y", "h")), ["k", "y", "h"]).groupBy("k", "y", "h").agg(F.min("t").alias("t")).orderBy("k", "y", "h").select("y", "t").toArrow()
        model.learn(folded(found["t"].combine_chunks()).to_pylist(), np.array([kinds.index(y) for y in found["y"].to_pylist()]))
    sent = spark.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = sent.value
        text, offsets = raw(folded(batch.column(0)))
        names, scores = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch))
        if m.kinds and len(batch):
            p = m.probabilities(m.scores(text, offsets) / m.heat)
            some = np.diff(offsets) > 0
            scores = np.where(some, p.max(1), 0.0)
            names = np.where(some & (scores >= reject_below), np.array(m.kinds, object)[p.argmax(1)], UNKNOWN)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(names, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    return map_arrow(df.select(F.col(text).cast("string").alias("t"), F.col(id_col).alias("id")), judge, f"`{id_col}` {kind}, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify(table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) != 2)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
ORACLE: dict[str, str] = {}
