"""A set of items that grows for years and dies as a whole: levelled parts, each with Bloom filters for its buckets.

A batch adds one part of level 0; as soon as a level has FAN parts they become one of the next, so an item is rewritten a logarithm of times and there is a
logarithm of parts. A part is dealt by hash into buckets of bounded size. Looking items up reads filters first, and of the parts themselves only
buckets whose filter has one of the items. Each version lists its parts, and only the last two versions are kept.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import TTL_S, already_seen, unseen
from ..schemas import SEEN
from ..storage import children, flush, stored

#: Parts of a level that become one of the next. Items of a bucket, and bits of a filter for each.
FAN, BUCKET_ITEMS, BITS = 4, 1_000_000, 10
#: Places of an item in a filter.
PLACES = 5


def levelled(parts: list[dict], made: int) -> tuple[list[dict], list[list[dict]]]:
    """(parts of the next version, groups of parts to be merged on the way, each into the part that its first one's ``into`` names), given the parts of
    one version, oldest first, with that of batch ``made`` as the last."""
    parts, merges, level = [dict(p) for p in parts], [], 0
    while len(own := [p for p in parts if p["level"] == level]) >= FAN:
        name = f"{made}-{level + 1}"
        merges.append([{**p, "into": name} for p in own])
        parts = [p for p in parts if p["level"] != level] + [{"name": name, "level": level + 1, "n": sum(p["n"] for p in own)}]
        level += 1
    return parts, merges


def buckets(n: int) -> int:
    """How many buckets a part of n items has: a power of two."""
    return 1 << max(0, -(-n // BUCKET_ITEMS) - 1).bit_length()


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Where items of these 64-bit hashes stand in a filter."""
    h = h.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
    return [((low + np.uint64(i) * high) % np.uint64(bits)).astype(np.int64) for i in range(1, PLACES + 1)]


def filter_of(h: np.ndarray) -> bytes:
    bits = max(64, len(h) * BITS)
    held = np.zeros(bits, bool)
    for at in places(h, bits):
        held[at] = True
    return np.uint64(bits).tobytes() + np.packbits(held).tobytes()


def maybe_in(made: bytes, h: np.ndarray) -> np.ndarray:
    bits, held = int(np.frombuffer(made, np.uint64, 1)[0]), np.frombuffer(made, np.uint8, offset=8)
    hit = np.ones(len(h), bool)
    for at in places(h, bits):
        hit &= (held[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return hit


class SeenSet:
    """Versions of the set and when it expires: ttl_s after the last batch that added to it. A batch reads the latest version before its own and writes its
    own, so that a batch run again starts from the same state."""

    def __init__(self, spark: SparkSession, path: str, ttl_s: int = TTL_S):
        self.spark, self.path, self.ttl_s = spark, path, ttl_s

    def versions(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in children(self.spark, f"{self.path}/meta") if n.startswith("batch="))

    def _meta(self, batch_id: int) -> dict | None:
        """The latest version before a batch."""
        found = max((n for n in self.versions() if n < batch_id), default=None)
        return None if found is None else json.loads(self.spark.read.text(f"{self.path}/meta/batch={found}").first()["value"])

    def expires(self, batch_id: int) -> int | None:
        meta = self._meta(batch_id)
        return meta and meta["expires_at"]

    def parts(self, batch_id: int, now_s: int) -> list[dict]:
        """Those that make the set, none if it has expired at that time (the boundary is expired)."""
        meta = self._meta(batch_id)
        return [] if meta is None or now_s >= meta["expires_at"] else meta["parts"]

    def alive(self, batch_id: int, now_s: int) -> DataFrame:
        """All items."""
        return self._items(self.parts(batch_id, now_s)).select("item")

    def _items(self, parts: list[dict]) -> DataFrame:
        return self._read([f"part={p['name']}" for p in parts if p["n"]])

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SEEN)
        return self.spark.read.schema(f"{SEEN}, part STRING, bucket INT").option("basePath", f"{self.path}/items").parquet(*[f"{self.path}/items/{f}" for f in folders]).select("item")

    def unseen(self, df: DataFrame, key: str, batch_id: int, now_s: int) -> DataFrame:
        """Rows of df whose key is not in the set; rows with a null key are unseen."""
        parts = [p for p in self.parts(batch_id, now_s) if p["n"]]
        if not parts:
            return df
        asked = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item")).distinct().withColumn("h", F.xxhash64("item"))
        where = F.explode(F.array(*[F.struct(F.lit(p["name"]).alias("part"), F.pmod("h", F.lit(buckets(p["n"]))).cast("int").alias("bucket")) for p in parts]))
        asked = asked.select("item", "h", where.alias("w")).select("item", "h", "w.part", "w.bucket")
        filters = self.spark.read.schema("bucket int, filter binary, part string").option("basePath", f"{self.path}/filters").parquet(*[f"{self.path}/filters/part={p['name']}" for p in parts])

        def look(items: pa.Table, filters: pa.Table) -> pa.Table:
            if not items.num_rows or not filters.num_rows:
                return items.slice(0, 0).select(["item", "part", "bucket"])
            hit = maybe_in(filters["filter"][0].as_py(), items["h"].to_numpy())
            return items.filter(pa.array(hit)).select(["item", "part", "bucket"])

        maybe = asked.groupBy("part", "bucket").cogroup(filters.groupBy("part", "bucket")).applyInArrow(look, "item string, part string, bucket int")
        maybe = stored(maybe, "maybe-seen")
        read = sorted((r["part"], r["bucket"]) for r in maybe.select("part", "bucket").distinct().collect())  # of buckets, never of items
        if not read:
            return df
        held = self._read([f"part={p}/bucket={b}" for p, b in read])
        return unseen(df, already_seen(held, maybe.select("item").distinct(), "item"), key)

    def add(self, items: DataFrame, batch_id: int, now_s: int) -> None:
        """Items (item) that are not in the set, each once. Only what is new is written, and what a merge brings together; the version comes last."""
        n = items.count()
        before = self.parts(batch_id, now_s)
        self._write(items, str(batch_id), n)
        parts, merges = levelled([*before, {"name": str(batch_id), "level": 0, "n": n}], batch_id)
        for own in merges:
            self._write(self._items([p for p in own if p["n"]]).select("item"), own[0]["into"], sum(p["n"] for p in own))
        meta = json.dumps({"expires_at": now_s + self.ttl_s, "parts": parts})
        self.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta/batch={batch_id}")
        self._tidied(batch_id, {p["name"] for p in [*parts, *((self._meta(batch_id) or {"parts": []})["parts"])]})

    def _write(self, items: DataFrame, name: str, n: int) -> None:
        of = F.pmod(F.xxhash64("item"), F.lit(buckets(n))).cast("int")
        items.select("item", of.alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/items/part={name}")

        def made(t: pa.Table) -> pa.Table:
            return pa.table([t["bucket"][:1], pa.array([filter_of(t["h"].to_numpy())])], names=["bucket", "filter"])

        held = self.spark.read.schema("item string, bucket int").parquet(f"{self.path}/items/part={name}").select("bucket", F.xxhash64("item").alias("h"))
        held.groupBy("bucket").applyInArrow(made, "bucket int, filter binary").write.mode("overwrite").parquet(f"{self.path}/filters/part={name}")

    def _tidied(self, batch_id: int, used: set[str]) -> None:
        """Versions before the last one before this batch go, and parts that neither of the two has."""
        for old in self.versions()[:-2]:
            flush(self.spark, f"{self.path}/meta/batch={old}")
        for folder in ("items", "filters"):
            for name in children(self.spark, f"{self.path}/{folder}"):
                part = name.partition("=")[2]
                if part and part not in used and int(part.partition("-")[0]) <= batch_id:
                    flush(self.spark, f"{self.path}/{folder}/{name}")
