"""Samples of distinct members as sketches: the k members whose hashes are smallest, which merge, whatever the partitions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashed(member: Column, seed: int) -> Column:
    """Hexadecimal MD5 of seed and member; each seed gives another sample."""
    return F.md5(F.concat(F.lit(f"{seed}-"), member.cast("string")))


def bottom_k(df: DataFrame, member: str, k: int, seed: int = 0) -> DataFrame:
    """member, hash: the k distinct members with the smallest hashes (all, if there are fewer; null is none). Each task keeps k of what it reads, so k rows a task
    are put together, not all members."""
    kind = df.schema[member].dataType.simpleString()

    def least(batches):
        held = None
        for b in batches:
            if held is not None and held.num_rows == k:
                b = b.filter(pc.less(b.column("hash"), held["hash"][k - 1]))
            if b.num_rows:
                both = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
                both = both.sort_by("hash").combine_chunks()
                fresh = pa.array([True, *pc.not_equal(both["hash"].slice(1), both["hash"].slice(0, both.num_rows - 1)).to_pylist()])
                held = both.filter(fresh).slice(0, k)
        if held is not None:
            yield from held.to_batches()

    rows = df.where(F.col(member).isNotNull()).select(F.col(member).alias("member"), hashed(F.col(member), seed).alias("hash"))
    return merged(rows.mapInArrow(least, f"member {kind}, hash string"), k) if k > 0 else rows.limit(0)


def merged(sketches: DataFrame, k: int) -> DataFrame:
    """One sketch of several, which may share members (rows of all of them in one DataFrame)."""
    return sketches.groupBy("hash").agg(F.first("member").alias("member")).orderBy("hash").limit(k).select("member", "hash")


def distinct_estimate(sketch: DataFrame, k: int) -> float:
    """How many distinct members there are: exact below k, by the largest hash of the k beyond that."""
    n, top = sketch.agg(F.count("*").alias("n"), F.max("hash").alias("top")).first()
    return float(n) if n < k else (k - 1) / ((int(top, 16) + 1) / 2**128)
