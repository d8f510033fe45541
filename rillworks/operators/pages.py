"""Pages of a table kept in order: any page is read from the few files that hold it, however far down it is."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file.
FILE_ROWS = 50_000


class Pages:
    """Below path: ``rows`` in order (newest first, equal times by key), in ranges (``part``) with each row's place in its range; ``ranges``: how many rows of a
    status each range has and where it begins. With statuses, each has an order of its own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])

    @classmethod
    def build(cls, df: DataFrame, path: str, by: str, key: str, status: str | None = None) -> Pages:
        """by and key tell rows apart; rows with a null time come last. Ranges grow in number with the rows, and no task gets more than one."""
        spark, n = df.sparkSession, df.count()
        order: list[str | Column] = [*([status] if status else []), F.desc(by), key]
        ranged = df.repartitionByRange(max(1, -(-n // FILE_ROWS)), *order).sortWithinPartitions(*order)
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ranged.withColumns({"_place": place, "part": F.spark_partition_id()}).write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
        rows = spark.read.schema(f"{_ddl(df)}, _place BIGINT, part INT").parquet(f"{path}/rows")
        first = F.min_by(F.struct(F.col(by).alias("by"), F.col(key).alias("key")), "_place").alias("first")
        of = F.col(status).cast("string") if status else F.lit(None).cast("string")
        ranges = rows.groupBy(of.alias("status"), "part").agg(F.count("*").alias("n"), F.min("_place").alias("lo"), first)
        ranges.select("status", "part", "n", "lo", "first.*").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranges")
        meta = json.dumps({"columns": df.columns, "ddl": _ddl(df), "by": by, "key": key, "status": status})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return cls(spark, path)

    def _ranges(self, status: str | None) -> list:
        """Of one status, in order: a row for each range, which the files' number bounds."""
        rows = self.spark.read.parquet(f"{self.path}/ranges").where(F.col("status").eqNullSafe(F.lit(status)))
        return sorted(rows.collect(), key=lambda r: r["part"])

    def _slices(self, slices: list[tuple[int, int, int]]) -> DataFrame:
        """Rows of parts, from one place up to before another."""
        rows = self.spark.read.schema(f"{self.meta['ddl']}, _place BIGINT, part INT").parquet(f"{self.path}/rows")
        if not slices:
            return rows.limit(0).select(self.meta["columns"])
        held = F.lit(False)
        for part, lo, hi in slices:
            held = held | (F.col("part") == part) & (F.col("_place") >= lo) & (F.col("_place") < hi)
        return rows.where(F.col("part").isin([s[0] for s in slices]) & held).orderBy("part", "_place").select(self.meta["columns"])

    def parts(self, limit: int, offset: int = 0, status: str | None = None) -> list[tuple[int, int, int]]:
        """(part, from place, to place) of a page."""
        out, at = [], 0
        for r in self._ranges(status):
            lo, hi = max(offset, at), min(offset + limit, at + r["n"])
            if lo < hi:
                out.append((r["part"], r["lo"] + lo - at, r["lo"] + hi - at))
            at += r["n"]
        return out

    def page(self, limit: int, offset: int = 0, status: str | None = None) -> DataFrame:
        """As OFFSET and LIMIT would give it, from the files that hold it; nothing is sorted but the page."""
        return self._slices(self.parts(limit, offset, status))

    def after(self, limit: int, cursor: tuple | None = None, status: str | None = None) -> DataFrame:
        """The page after a row, given by its time (which may be None) and key, whether or not it is still there; None for the first page."""
        ranges = self._ranges(status)
        if cursor is None:
            return self.page(limit, 0, status)
        by, key = F.col(self.meta["by"]), F.col(self.meta["key"])
        if cursor[0] is None:
            beyond = by.isNull() & (key > F.lit(cursor[1]))
            ahead = lambda r: r["by"] is not None or r["key"] <= cursor[1]
        else:
            beyond = (by < F.lit(cursor[0])) | by.isNull() | (by == F.lit(cursor[0])) & (key > F.lit(cursor[1]))
            ahead = lambda r: r["by"] is not None and (r["by"] > cursor[0] or r["by"] == cursor[0] and r["key"] <= cursor[1])
        start = max(0, sum(map(ahead, ranges)) - 1)
        read, left = [], limit
        for i, r in enumerate(ranges[start:]):  # of the first one any number of rows may be beyond
            read.append((r["part"], r["lo"], r["lo"] + r["n"]))
            left -= r["n"] if i else 0
            if left <= 0:
                break
        return self._slices(read).where(beyond).limit(limit) if read else self._slices([])


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
