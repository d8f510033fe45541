"""A read-through cache whose entries live for a time."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.json import has_key, truthy
from ..functions.text import cache_key

TTL_S = 3600


def put(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """Both as one cache (key, value, stored_at, ttl_s): the latest entry of a key stays, of equal times the larger value."""
    rows = cache.unionByName(entries)
    return rows.groupBy("key").agg(F.max(F.struct("stored_at", "value", "ttl_s")).alias("e")).select("key", "e.value", "e.stored_at", "e.ttl_s")


def lookup(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (request_id, url, ts) with cached (whether a live entry with a truthy value is there) and its value, else null."""
    entry = cache.select(F.col("key").alias("_key"), F.col("value").alias("_value"), (F.col("stored_at") + F.make_dt_interval(secs=F.col("ttl_s"))).alias("_until"))
    joined = requests.join(entry, (cache_key(F.col("url")) == F.col("_key")) & (F.col("ts") < F.col("_until")), "left")
    hit = F.coalesce(truthy(F.col("_value")), F.lit(False))
    return joined.select(*requests.columns, hit.alias("cached"), F.when(hit, F.col("_value")).alias("data"))


def ttl_hits(df: DataFrame, key: str, ts: str, order: str, ttl_s: int = TTL_S) -> DataFrame:
    """key, hits, misses when requests fill an empty cache: a request hits if the last miss of its key is under ttl_s old; hits renew nothing.

    Each key is a sorted stream that jumps from miss to miss; a hot key needs no more memory than an Arrow batch.
    """
    kind = df.schema[key].dataType.simpleString()
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    ordered = df.select(F.col(key).alias("k"), micros.alias("t"), F.col(order).alias("o")).repartition("k").sortWithinPartitions("k", "t", "o").select("k", "t")
    ttl = ttl_s * 1_000_000

    def fold(batches):
        now, last, hits, misses, started = None, None, 0, 0, False
        for b in batches:
            ends = pc.run_end_encode(b.column(0))  # equal keys stand together
            keys, times = ends.values.to_pylist(), b.column(1).to_numpy()
            edges = [0, *ends.run_ends.to_pylist()]
            done: list[list] = [[], [], []]
            for key, lo, hi in zip(keys, edges, edges[1:], strict=False):
                if not started or key != now:
                    if started:
                        for column, x in zip(done, (now, hits, misses), strict=True):
                            column.append(x)
                    now, last, hits, misses, started = key, None, 0, 0, True
                own, at, missed = times[lo:hi], 0, 0
                while True:
                    if last is not None:
                        at = int(np.searchsorted(own, last + ttl, "left"))
                    if at >= len(own):
                        break
                    last, missed = int(own[at]), missed + 1
                misses, hits = misses + missed, hits + len(own) - missed
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], b.schema.field(0).type), pa.array(done[1], pa.int64()), pa.array(done[2], pa.int64())], names=["k", "hits", "misses"])
            field = b.schema.field(0).type
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([now], field), pa.array([hits], pa.int64()), pa.array([misses], pa.int64())], names=["k", "hits", "misses"])

    return ordered.mapInArrow(fold, f"k {kind}, hits long, misses long").withColumnRenamed("k", key)


def analyse(requests: DataFrame, cache: DataFrame, scrape: Callable[[DataFrame], DataFrame], nlp: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """request_id, status (200, 502 where the scraped object has no ``content`` key, 500 where a call failed), cached, data.

    scrape and nlp are injected: each takes rows (request_id, url[, content]) and returns them with ``response`` (JSON text, null if it failed).
    Only status 200 without a hit is to be put into the cache.
    """
    looked = lookup(requests, cache)
    hits = looked.where("cached").select("request_id", F.lit(200).alias("status"), "cached", "data")
    scraped = scrape(looked.where("not cached").select("request_id", "url")).withColumn("_ok", has_key(F.col("response"), "content") & truthy(F.col("response")))
    bad = scraped.where("not _ok").select("request_id", F.when(F.col("response").isNull(), 500).otherwise(502).alias("status"), F.lit(False).alias("cached"), F.lit(None).cast("string").alias("data"))
    done = nlp(scraped.where("_ok").select("request_id", "url", F.col("response").alias("content")))
    fresh = done.select("request_id", F.when(F.col("response").isNull(), 500).otherwise(200).alias("status"), F.lit(False).alias("cached"), F.col("response").alias("data"))
    return hits.unionByName(bad).unionByName(fresh)
