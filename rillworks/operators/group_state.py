"""What a group of readers has been given and has acknowledged, kept up by deltas: reports read a compacted state and the few deltas since, never all history."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import children, flush
from .log import ID, pending

KEYS = ["stream", "group_name"]
PENDING = "stream STRING, group_name STRING, consumer STRING, id_ms BIGINT, id_seq BIGINT"
ACKS = "stream STRING, group_name STRING, id_ms BIGINT, id_seq BIGINT"
READERS = "stream STRING, group_name STRING, consumer STRING, entries_read BIGINT, last_ms BIGINT, last_seq BIGINT"
LENGTHS = "stream STRING, n BIGINT"
#: Deltas between compactions.
FAN = 4


class GroupState:
    """Below path: ``delta=<n>`` with deliveries, acks and counts of appended rows, ``state=<n>`` with what all deltas up to n come to (what waits, what each
    consumer has read, how long streams are), and ``meta``, written last. Deltas are numbered and rise; one that is applied again replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        return sorted(int(n.partition("=")[2]) for n in children(self.spark, f"{self.path}/meta") if n.startswith("delta="))

    def _meta(self, before: int | None = None) -> dict:
        found = max((n for n in self._versions() if before is None or n < before), default=None)
        return {"state": None, "deltas": []} if found is None else json.loads(self.spark.read.text(f"{self.path}/meta/delta={found}").first()["value"])

    def apply(self, number: int, deliveries: DataFrame, acks: DataFrame, appended: DataFrame) -> None:
        """One delta: deliveries (stream, group_name, consumer, id), acknowledgements (stream, group_name, id) of these or earlier ones, and rows appended to the log.
        An acknowledgement of what does not wait changes nothing."""
        at = f"{self.path}/delta={number}"
        deliveries.select("stream", "group_name", "consumer", *ID).write.mode("overwrite").parquet(f"{at}/deliveries")
        acks.select("stream", "group_name", *ID).distinct().write.mode("overwrite").parquet(f"{at}/acks")
        appended.groupBy("stream").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{at}/lengths")
        meta = self._meta(number)
        meta = {"state": meta["state"], "deltas": [*meta["deltas"], number]}
        if len(meta["deltas"]) >= FAN:
            for name, df in (("pending", self._pending(meta)), ("readers", self._readers(meta)), ("lengths", self._lengths(meta))):
                df.write.mode("overwrite").parquet(f"{self.path}/state={number}/{name}")
            meta = {"state": number, "deltas": []}
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta/delta={number}")
        self._tidied(number)

    def _tidied(self, number: int) -> None:
        """Versions before the last but this one, and what neither of the two reads, go."""
        for old in self._versions()[:-2]:
            flush(self.spark, f"{self.path}/meta/delta={old}")
        used = [self._meta(number), self._meta()]
        kept = {f"state={m['state']}" for m in used} | {f"delta={d}" for m in used for d in m["deltas"]} | {"meta", f"delta={number}"}
        for name in set(children(self.spark, self.path)) - kept:
            flush(self.spark, f"{self.path}/{name}")

    def _read(self, meta: dict, name: str, schema: str, delta: str | None = None) -> DataFrame:
        """The state's rows and those of the deltas since."""
        paths = [f"{self.path}/state={meta['state']}/{name}"] if meta["state"] is not None and name else []
        paths += [f"{self.path}/delta={d}/{delta}" for d in meta["deltas"]] if delta else []
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _pending(self, meta: dict) -> DataFrame:
        return pending(self._read(meta, "pending", PENDING, "deliveries"), self._read(meta, "", ACKS, "acks"))

    def _readers(self, meta: dict) -> DataFrame:
        """For each consumer how many rows it was given and the last of them."""
        fresh = self._read({"state": None, "deltas": meta["deltas"]}, "", PENDING, "deliveries")
        one = fresh.select(*KEYS, "consumer", F.lit(1).cast("long").alias("entries_read"), F.col("id_ms").alias("last_ms"), F.col("id_seq").alias("last_seq"))
        both = self._read(meta, "readers", READERS).unionByName(one)
        last = F.max(F.struct("last_ms", "last_seq")).alias("l")
        return both.groupBy(*KEYS, "consumer").agg(F.sum("entries_read").alias("entries_read"), last).select(*KEYS, "consumer", "entries_read", "l.last_ms", "l.last_seq")

    def _lengths(self, meta: dict) -> DataFrame:
        return self._read(meta, "lengths", LENGTHS, "lengths").groupBy("stream").agg(F.sum("n").alias("n"))

    def pending(self) -> DataFrame:
        """What waits: stream, group_name, consumer, id_ms, id_seq."""
        return self._pending(self._meta())

    def summary(self) -> DataFrame:
        """As ``log.group_summary``: stream, group_name, consumers, pending, last_ms, last_seq, entries_read, lag."""
        meta, zero = self._meta(), F.lit(0).cast("long")
        base = self._readers(meta).groupBy(*KEYS).agg(F.count("consumer").alias("consumers"), F.sum("entries_read").alias("entries_read"), F.max(F.struct("last_ms", "last_seq")).alias("l"))
        waiting = self._pending(meta).groupBy(*KEYS).agg(F.count("*").alias("pending"))
        out = base.join(waiting, KEYS, "left").join(self._lengths(meta), "stream", "left")
        return out.select(*KEYS, "consumers", F.coalesce("pending", zero).alias("pending"), "l.last_ms", "l.last_seq", "entries_read", (F.coalesce("n", zero) - F.col("entries_read")).alias("lag"))
