"""A read-through cache as running state: an entry for each key, which lives for a time after it was filled and then leaves the state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..operators.cache import TTL_S
from .prioritiser import ONCE

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "key {}, request {}, t long, cached boolean, data string"


def ready(key: str) -> str | None:
    """A fill that always gives an (empty) object."""
    return "{}"


def read_through(ttl_s: int, fill: Callable[[str], str | None]) -> Callable[..., Iterator[pd.DataFrame]]:
    """Requests of a key, by time: one at t hits if the key was filled at m with t < m + ttl; any other is a miss, and fills. A fill that gives nothing is
    not kept, so the next request misses again; hits renew nothing. A time limit of each key drops its entry once no request on time can hit it."""
    ttl = ttl_s * 1_000_000

    def answer(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        frames = list(rows)
        asked = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        if (np.diff(asked["t"].to_numpy()) <= 0).any():
            asked = asked.sort_values(["t", "request"], ignore_index=True)
        times = asked["t"].to_numpy()
        filled, value = state.get if state.exists else (None, None)
        hit, data, at = np.zeros(len(times), bool), np.empty(len(times), object), 0
        before = filled
        while at < len(times):
            if filled is not None:  # all requests up to the entry's end hit
                end = int(np.searchsorted(times, filled + ttl, "left"))
                hit[at:end], data[at:end] = True, value
                at = max(at, end)
                if at >= len(times):
                    break
            got = fill(key[0])
            filled, value = (int(times[at]), got) if got is not None else (None, None)
            data[at] = got
            at += 1
        if filled is not None:
            if filled != before:
                state.update((filled, value))
            state.setTimeoutTimestamp(-(-(filled + ttl) // 1000))  # each call unsets it
        elif before is not None:
            state.remove()
        yield pd.DataFrame({"key": [key[0]] * len(times), "request": asked["request"].to_numpy(), "t": times, "cached": hit, "data": data})

    return answer


def through(requests: DataFrame, key: str, ts: str, request: str, ttl_s: int = TTL_S, fill: Callable[[str], str | None] = ready) -> DataFrame:
    """key, request, ts, cached and data of a stream of requests. A request may come later than others by as much as the entries live; one that is later
    still is left out, as its entry may be gone. Requests of a key in one micro-batch are in memory at once. Keys and their entries go to Python many to a
    batch, not one by one."""
    kinds = [requests.schema[c].dataType.simpleString() for c in (key, request)]
    rows = requests.select(F.col(key).alias("key"), F.col(request).alias("request"), F.col(ts).cast("timestamp").alias("ts"))
    rows = rows.withColumn("t", F.unix_micros("ts")).withWatermark("ts", f"{ttl_s} seconds")
    answers = rows.groupBy("key").applyInPandasWithState(read_through(ttl_s, fill), OUT.format(*kinds), "filled long, value string", "append", "EventTimeTimeout")
    return answers.select("key", "request", F.timestamp_micros("t").alias("ts"), "cached", "data")


@contextmanager
def rocksdb(spark: SparkSession, evict: bool = True) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which holds it outside the heap; a stream has the session's settings of its start."""
    name = "spark.sql.streaming."
    wanted = {f"{name}stateStore.providerClass": ROCKSDB, f"{name}noDataMicroBatches.enabled": str(evict).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def run(answers: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, evict: bool = True) -> StreamingQuery:
    """Answers of ``through``, appended to a folder exactly once. Without evict, entries whose time has come leave with the next batch of requests only, which
    spares a batch that has none."""
    with rocksdb(answers.sparkSession, evict):
        return answers.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or ONCE)).start()
