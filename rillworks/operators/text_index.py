"""Text search by trigrams: posting lists narrow a search down to few texts, which alone are read and looked through."""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of a partition of the index, and partitions of the posting lists for each of these.
TEXTS, LISTS = 1_000, 2
#: Texts whose grams a task holds at once.
ROWS = 100
#: Lists that are intersected, rarest first.
RAREST = 4


def grams(text: bytes) -> np.ndarray:
    """Distinct runs of three bytes, as numbers."""
    b = np.frombuffer(text, np.uint8).astype(np.int32)
    return np.unique(b[:-2] << 16 | b[1:-1] << 8 | b[2:]) if len(b) > 2 else np.zeros(0, np.int32)


class TextIndex:
    """Below path: ``texts`` (key, and the columns in lower case), partitioned by the key's hash; ``lists`` (gram, n, keys), partitioned by the gram's
    bucket and sorted by gram, a row for a gram of some texts and not for each pair; ``sizes`` (gram, n), sorted; ``meta``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])

    @classmethod
    def build(cls, df: DataFrame, path: str, key: str, columns: list[str]) -> TextIndex:
        """An index over columns of df by its key, which is unique. Partitions grow with the rows. Null texts hold nothing."""
        spark, n = df.sparkSession, df.count()
        parts = max(1, -(-n // TEXTS))
        part = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
        low = df.select(F.col(key).alias("key"), *[F.lower(F.col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(columns)])
        low.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/texts")
        kind, lists = low.schema["key"].dataType.simpleString(), LISTS * parts

        def posted(batches):
            for batch in batches:
                for b in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                    found = [np.unique(np.concatenate([grams(t.encode()) for t in row if t is not None] or [np.zeros(0, np.int32)])) for row in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
                    of, all_ = np.repeat(np.arange(len(found)), [len(f) for f in found]), np.concatenate([np.zeros(0, np.int32), *found]).astype(np.int32)
                    order = np.argsort(all_, kind="stable")
                    own, first, n = np.unique(all_[order], return_index=True, return_counts=True)
                    keys = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)).astype(np.int32)), b.column(0).take(pa.array(of[order])))
                    yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n.astype(np.int32)), keys], names=["gram", "n", "keys"])

        stored = spark.read.schema(low.schema).parquet(f"{path}/texts").select(low.columns)
        rows = stored.mapInArrow(posted, f"gram int, n int, keys array<{kind}>").withColumn("list", F.pmod(F.hash("gram"), F.lit(lists)))
        rows.repartition("list").sortWithinPartitions("list", "gram").write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
        sizes = spark.read.schema("gram int, n int, list int").parquet(f"{path}/lists").groupBy("gram").agg(F.sum("n").alias("n"))
        sizes.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/sizes")
        meta = json.dumps({"key": key, "kind": kind, "columns": columns, "parts": parts, "lists": lists, "rows": n})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return cls(spark, path)

    def texts(self) -> DataFrame:
        columns = ", ".join(f"c{i} STRING" for i in range(len(self.meta["columns"])))
        return self.spark.read.schema(f"key {self.meta['kind']}, {columns}, part INT").parquet(f"{self.path}/texts")

    def rarest(self, text: str) -> list[int] | None:
        """Up to RAREST of the text's grams, those in fewest texts; None if one of them is in no text; empty if the text is too short to have any."""
        asked = [int(g) for g in grams(text.encode())]
        if not asked:
            return []
        sizes = {r["gram"]: r["n"] for r in self.spark.read.parquet(f"{self.path}/sizes").where(F.col("gram").isin(asked)).collect()}
        return None if len(sizes) < len(asked) else sorted(asked, key=lambda g: (sizes[g], g))[:RAREST]

    def candidates(self, chosen: list[int]) -> DataFrame:
        """key, part of texts that have all these grams: their lists alone are read, the rarest one first."""
        lists = self.spark.read.schema(f"gram INT, keys ARRAY<{self.meta['kind']}>, list INT").parquet(f"{self.path}/lists")
        bucket = {r["g"]: r["b"] for r in self.spark.createDataFrame([(g,) for g in chosen], "g int").select("g", F.pmod(F.hash("g"), F.lit(self.meta["lists"])).alias("b")).collect()}
        one = lambda g: lists.where((F.col("list") == bucket[g]) & (F.col("gram") == g)).select(F.explode("keys").alias("key"))
        met = reduce(lambda a, g: a.join(one(g), "key", "left_semi"), chosen[1:], one(chosen[0]))
        return met.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(self.meta["parts"])).cast("int"))

    def search(self, text: str) -> DataFrame:
        """Keys of rows with the text in one of the columns, whatever the case. Texts are read from partitions that hold a candidate only; a text of under three
        bytes has no gram, so all texts are looked through for it."""
        low = self.spark.createDataFrame([(text,)], "t string").select(F.lower("t")).first()[0]
        chosen = self.rarest(low)
        rows = self.texts()
        if chosen is None:
            return rows.limit(0).select(F.col("key").alias(self.meta["key"]))
        if chosen:
            # Partitions by number, which are known before the scan: no more of them than the index has.
            found = self.candidates(chosen)
            read = [r["part"] for r in found.select("part").distinct().collect()]
            rows = rows.where(F.col("part").isin(read)).join(found.select("key"), "key", "left_semi") if read else rows.limit(0)
        hit: Column = F.lit(False)
        for i in range(len(self.meta["columns"])):
            hit = hit | F.coalesce(F.contains(F.col(f"c{i}"), F.lit(low)), F.lit(False))
        return rows.where(hit).select(F.col("key").alias(self.meta["key"]))
