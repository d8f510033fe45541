"""What the training-data operators share: numpy kernels over Arrow text columns."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored  # noqa: F401  (for the operators)

#: Bytes of text that a kernel turns into arrays at once (a single longer text is taken alone).
SLICE_BYTES = 1 << 20

#: The white space of the word and line contracts.
SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
#: A-Z to a-z, all other bytes unchanged (safe on UTF-8).
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, unless the session sets its own number: texts are long, and a batch is in memory twice.
BATCH_ROWS = 1_000


def worker_path(spark: SparkSession) -> None:
    """Lets Python workers started from now on import this package from where the driver has it, and get batches of moderate size."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))


def plan_bytes(df: DataFrame) -> int:
    """Bytes that df's rows are estimated at by the optimiser's statistics (files' sizes, for the columns read); 0 where it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 50 else 0


def release() -> None:
    """Hands back what a worker has freed but keeps: workers idle between tasks, and executors hold several."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of GNU's library
        trim(0)


def map_arrow(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """work on each Arrow batch, cut so that no cut has over limit bytes of its first string column (but one row at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in cuts(batch, limit):
                out = work(part)
                yield from out.to_batches() if isinstance(out, pa.Table) else (out,)
        batch = part = out = None
        release()

    worker_path(df.sparkSession)
    return df.mapInArrow(run, schema)


def cuts(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    at = next(i for i, f in enumerate(batch.schema) if pa.types.is_string(f.type) or pa.types.is_large_string(f.type) or pa.types.is_binary(f.type))
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and the n + 1 offsets of its rows in them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(at) else np.zeros(0, np.uint8)
    return text, at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them (splitmix64's finish)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: By (position in the word below 64, byte): a random 64-bit value.
_TABLE = mix(np.arange(1, 64 * 256 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a string column: byte ranges [start, end), and for document i the words first[i] up to first[i + 1]."""

    def __init__(self, column: pa.Array, lower: bool = False):
        text, self.offsets = raw(column)
        self.text = LOWER[text] if lower else text
        solid = ~IS_SPACE[self.text]
        fresh = np.zeros(len(text) + 1, bool)  # a document's first byte
        fresh[self.offsets] = True
        before = np.zeros(len(text), bool)
        before[1:] = solid[:-1]
        self.start = np.flatnonzero(solid & (~before | fresh[:-1]))
        after = np.zeros(len(text), bool)
        after[:-1] = solid[1:]
        self.end = np.flatnonzero(solid & (~after | fresh[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def hashes(self) -> np.ndarray:
        """64 bits a word, alike wherever the word stands."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        sizes = self.end - self.start
        edges = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        place = np.arange(int(sizes.sum())) - np.repeat(edges, sizes)
        letters = self.text[place + np.repeat(self.start, sizes)]
        values = _TABLE[(place & 63) << 8 | letters]
        if (far := place > 63).any():
            values[far] = mix(values[far] + place[far].astype(np.uint64))
        return mix(np.add.reduceat(values, edges) + sizes.astype(np.uint64))


#: Odd multipliers, by place in a run.
POWERS = mix(np.arange(1000, 1064, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each k consecutive words, by their first word (the last k - 1 starts are left out)."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * POWERS[j]
    return mix(total)


def crc_mod(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


#: Ids that ``among`` makes a filter of, bits for each, and bits that one task sets. So a filter has 16 MB at most.
FILTERED, BITS_PER_ID, SLICE_BITS = 8_000_000, 16, 1 << 19


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df that may have one of ids (key, distinct) as key: all that have, and few others. It spares rows a shuffle before a join.

    The filter has two bits an id, dealt by place, so that each of its slices is made by one task. For over FILTERED ids all rows come.
    """
    spark = df.sparkSession
    n = ids.count()
    if n > FILTERED:
        return df
    bits = max(SLICE_BITS, 1 << (n * BITS_PER_ID - 1).bit_length()) if n else SLICE_BITS
    places = lambda: [F.pmod(F.xxhash64(F.lit(i), key), F.lit(bits)) for i in (1, 2)]

    def mark(t: pa.Table) -> pa.Table:
        held = np.zeros(SLICE_BITS, bool)
        held[t["place"].to_numpy() % SLICE_BITS] = True
        return pa.table([t["slice"][:1], pa.array([np.packbits(held).tobytes()])], names=["slice", "bits"])

    worker_path(spark)
    place = ids.select(F.explode(F.array(*places())).alias("place")).withColumn("slice", (F.col("place") / SLICE_BITS).cast("int"))
    whole = np.zeros(bits // 8, np.uint8)
    for r in place.groupBy("slice").applyInArrow(mark, "slice int, bits binary").collect():
        whole[r["slice"] * SLICE_BITS // 8 : (r["slice"] + 1) * SLICE_BITS // 8] = np.frombuffer(r["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(whole.tobytes())

    def may(batches):
        held = np.frombuffer(sent.value, np.uint8)
        for b in batches:
            hit = np.ones(b.num_rows, bool)
            for at in (b.column(b.num_columns - 2).to_numpy(), b.column(b.num_columns - 1).to_numpy()):
                hit &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            yield b.filter(pa.array(hit)).select(range(b.num_columns - 2))
        b = None
        release()

    return df.select("*", *[p.alias(f"_place{i}") for i, p in enumerate(places())]).mapInArrow(may, df.schema)
