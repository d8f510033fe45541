"""Quality classifier: random Fourier features approximate a Gaussian kernel over document statistics; partition-summed normal equations give
ridge scores, and isotonic calibration turns these into probabilities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, Words, crc_mod, map_arrow, stored, table

#: Random features, the kernel's width (standard deviations of a statistic), ridge, bins that scores are counted in for calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1.0, 1024
SEED = 11

_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | (np.arange(256) >= 97) & (np.arange(256) <= 122) | (np.arange(256) >= 128)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_STOP = np.isin(np.arange(256), list(b".,;:!?'\"-()"))
_ODD = ~(_LETTER | _DIGIT | _STOP | IS_SPACE)
#: C3 80 to C3 9E: accented capitals of Latin-1.
_HIGH = (np.arange(256) >= 0x80) & (np.arange(256) <= 0x9E)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of 16 statistics for each text, all of the whole text."""
    words = Words(column)
    text, at, n = words.text, words.offsets, len(words.offsets) - 1

    def per_doc(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[at]).astype(float)

    size = np.maximum(np.diff(at), 1).astype(float)
    accented = np.zeros(len(text), bool)
    accented[1:] = (text[:-1] == 0xC3) & _HIGH[text[1:]]
    letters = np.maximum(per_doc(_LETTER[text]), 1)
    count = np.diff(words.first).astype(float)
    some = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    doc = np.repeat(np.arange(n), np.diff(words.first))
    by_doc = lambda x: np.bincount(doc, x, n)
    mean = by_doc(length) / some
    hashes = words.hashes()
    again = np.zeros(len(hashes))
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((hashes, doc))
    first = np.ones(len(hashes))
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order], first, n)
    odd_words = np.zeros(len(hashes))
    bare = np.zeros(len(hashes))
    shout = np.zeros(len(hashes))
    if len(hashes):
        begins, ends = text[words.start], text[words.end - 1]
        odd_words[:] = _ODD[ends] | _ODD[begins]
        bare[:] = (length == 1) & ~_LETTER[begins] & ~_DIGIT[begins]
        shout[:] = (length > 1) & _UPPER[begins] & _UPPER[text[np.minimum(words.start + 1, words.end - 1)]]
    lines = per_doc(text == 10) + 1
    return np.stack([
        np.log1p(count), mean, np.sqrt(np.maximum(by_doc(length**2) / some - mean**2, 0)), per_doc(_UPPER[text] | accented) / letters,
        per_doc(_DIGIT[text]) / size, per_doc(_STOP[text]) / size, per_doc(_ODD[text]) / size, per_doc(text == 33) / size,
        distinct / some, np.log1p(distinct) - np.log1p(count), by_doc(again) / some, by_doc(odd_words) / some, by_doc(bare) / some,
        by_doc(shout) / some, np.log1p(size / lines), per_doc(IS_SPACE[text]) / size,
    ], 1)


class Fourier:
    """cos(x W + b) of standardised, clipped statistics, with a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w, self.b = rng.standard_normal((len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))])


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing fit by pooled neighbours; entries without weight follow the one before."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or not blocks[-1][1]):
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            w = w1 + w2
            blocks.append([(v1 * w1 + v2 * w2) / w if w else v1, w, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def summed(df: DataFrame, work, rows: int, columns: int) -> np.ndarray:
    """The sum over all partitions of the rows x columns array that work gives for an Arrow batch. Each partition sends one sum, row by row."""

    def run(batches):
        total = np.zeros((rows, columns))
        for b in batches:
            total += work(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), pa.array(list(total))], names=["i", "x"])

    def add(t: pa.Table) -> pa.Table:
        x = t["x"].combine_chunks().flatten().to_numpy().reshape(-1, columns)
        return pa.table([t["i"].slice(0, 1), pa.array([x.sum(0)])], names=["i", "x"])

    parts = df.mapInArrow(run, "i int, x array<double>").groupBy("i").applyInArrow(add, "i int, x array<double>").collect()
    out = np.zeros((rows, columns))
    for r in parts:
        out[r["i"]] = r["x"]
    return out


def score(df: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row for each of df: id_col, score (0 to 1, higher: label 1 likelier), predicted (score >= 0.5).

    Learns from all rows whose id has a 0/1 label and meets learn_from; conflicting labels of an id count as 1. One in five of these, by
    hash, calibrates; the others fit. Null and empty texts are scored by the statistics of an empty text. Repeated rows are each scored.
    Without any label to learn from every score is 0.5; with one kind of label only, every score is near that kind.
    """
    kind = df.schema[id_col].dataType.simpleString()
    width = 16

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in statistics(batch.column(0))], pa.binary())], names=["id", "x"])

    all_rows = stored(map_arrow(df.select(F.col(text).cast("string").alias("t"), F.col(id_col).alias("id")), measure, f"id {kind}, x binary"), "statistics")
    known = labels.where(F.col(label).isin(0, 1) & learn_from).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("double").alias("y"))
    learn = stored(all_rows.join(known, "id").select("x", "y", (F.pmod(F.xxhash64("id"), F.lit(5)) == 0).alias("held")), "learn")
    fit, hold = learn.where("not held"), learn.where("held")

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x = matrix(b.column(0), width)
        return np.stack([np.full(width, float(len(x))), x.sum(0), (x**2).sum(0)])

    n, first, second = summed(fit, moments, 3, width)
    n = max(n[0], 1.0)
    mean = first / n
    fourier = Fourier(mean, np.sqrt(np.maximum(second / n - mean**2, 1e-6)))

    def normal(b: pa.RecordBatch) -> np.ndarray:
        z = fourier(matrix(b.column(0), width))
        y = b.column(1).to_numpy() * 2 - 1
        return np.hstack([z.T @ z, (z.T @ y)[:, None]])

    size = FEATURES + 1
    equations = summed(fit, normal, size, size + 1)
    weights = np.linalg.solve(equations[:, :size] + RIDGE * np.eye(size), equations[:, size])
    edges = np.linspace(-2, 2, BINS - 1)

    def counted(b: pa.RecordBatch) -> np.ndarray:
        bin_ = np.digitize(fourier(matrix(b.column(0), width)) @ weights, edges)
        y = b.column(1).to_numpy()
        return np.stack([np.bincount(bin_, minlength=BINS), np.bincount(bin_, y, BINS)])

    # Two pseudo-counts at either end keep the calibration off 0 and 1; the fitted rows count a little, so that no stretch is empty.
    count, good = summed(hold, counted, 2, BINS) + 0.05 * summed(fit, counted, 2, BINS)
    centre = np.concatenate([edges[:1], (edges[1:] + edges[:-1]) / 2, edges[-1:]])
    prior = np.clip((centre + 1) / 2, 0.01, 0.99)
    level = isotonic((good + 0.02 * prior) / (count + 0.02), count + 0.02)
    level = np.clip(level, 0.0005, 0.9995) if count.sum() else np.full(BINS, 0.5)

    def final(batches):
        for b in batches:
            raw = fourier(matrix(b.column(1), width)) @ weights
            # The bin's level, tilted a little by the raw score so that equal levels keep the scores' order.
            p = np.clip(level[np.digitize(raw, edges)] + 0.0004 * np.tanh(raw), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return all_rows.mapInArrow(final, f"`{id_col}` {kind}, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return scored.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op1_quality": op1_quality}
ORACLE: dict[str, str] = {}
