"""Append-only message logs, batch view: streams of (id_ms, id_seq, payload), deliveries and acknowledgements."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.json import encoded
from ..schemas import LOG
from .batches import ranges

ID = ["id_ms", "id_seq"]


def appended(df: DataFrame, path: str, batch_id: int | str) -> None:
    """One folder for each batch: a failed attempt leaves nothing, a repeated one replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def append_one(spark: SparkSession, message: dict, path: str, stream: str, id_ms: int, id_seq: int = 0) -> str | None:
    """The message as JSON text, null fields included, as one row of a stream. Returns its id ``ms-seq``; None if it is empty or can't be written."""
    if not message:
        return None
    try:
        payload = json.dumps(message)
        appended(spark.createDataFrame([(stream, id_ms, id_seq, payload)], LOG), f"{path}/stream={stream}", f"{id_ms}-{id_seq}")
    except Exception:
        return None
    return f"{id_ms}-{id_seq}"


def messages(rows: DataFrame, data: list[str]) -> DataFrame:
    """Rows (stream, id_ms, id_seq and the data's columns) as a log: ``payload`` is the data as JSON, null fields included."""
    return rows.select("stream", *ID, encoded(F.struct(*data)).alias("payload"))


def parsed_id(id_: Column) -> Column:
    """``ms-seq`` as a struct of numbers, which orders as ids do (their text does not); null if it is no id. Without ``-seq`` that is 0."""
    ok = id_.rlike(r"^[0-9]+(-[0-9]+)?$")
    part = lambda i: F.try_element_at(F.split(id_, "-"), F.lit(i)).cast("long")
    return F.when(ok, F.struct(part(1).alias("id_ms"), F.coalesce(part(2), F.lit(0).cast("long")).alias("id_seq")))


def union_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """All streams' rows with ``stream`` and ``stream_pos``, the order the streams were given in."""
    tagged = [df.withColumns({"stream": F.lit(name), "stream_pos": F.lit(i)}) for i, (name, df) in enumerate(streams.items())]
    return reduce(DataFrame.unionByName, tagged)


def take_per_stream(df: DataFrame, n: int, order: list[str] = ID, stream: str = "stream") -> DataFrame:
    """The first n rows of each stream. Each task keeps n rows a stream before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(stream).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def take_one(df: DataFrame, order: list[str] = ID) -> DataFrame:
    """The first row, or none: an empty poll is an empty result."""
    return df.orderBy(*order).limit(1)


def undelivered(log: DataFrame, deliveries: DataFrame, group: str, start_after: tuple[int, int] | None = None) -> DataFrame:
    """Rows the group has not been given. start_after: the last id when the group was made at the tail; None for the beginning."""
    out = log.join(deliveries.where(F.col("group_name") == group).select("stream", *ID), ["stream", *ID], "left_anti")
    if start_after:
        out = out.where((F.col("id_ms") > start_after[0]) | (F.col("id_ms") == start_after[0]) & (F.col("id_seq") > start_after[1]))
    return out


def pending(deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    keys = ["stream", "group_name", *ID]
    return deliveries.join(acks.select(*keys), keys, "left_anti")


def acknowledged(deliveries: DataFrame, acks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ids (stream, group_name, id_ms, id_seq) to acknowledge. Returns all acknowledgements, and of each id whether it was pending (``acked``): one
    that was not changes nothing."""
    keys = ["stream", "group_name", *ID]
    asked = ids.select(*keys).distinct()
    waits = pending(deliveries, acks).select(*keys).distinct().withColumn("acked", F.lit(True))
    told = asked.join(waits, keys, "left").withColumn("acked", F.coalesce("acked", F.lit(False)))
    return acks.select(*keys).unionByName(told.where("acked").select(*keys)), told


def unacked_warning(told: DataFrame) -> str | None:
    """A warning if nothing of what was to be acknowledged was pending."""
    n = told.agg(F.count_if("acked").alias("n")).first()["n"]
    return None if n else "0 acknowledged"


def batch_report(rows: DataFrame, batch: str) -> DataFrame:
    """For each batch its number of rows and whether it is empty; an empty batch is one that has only null ids."""
    n = F.count("id_ms")
    return rows.groupBy(batch).agg(n.alias("length"), (n == 0).alias("empty"))


def group_summary(log: DataFrame, deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """stream, group_name, consumers, pending, last_ms, last_seq, entries_read, lag."""
    keys = ["stream", "group_name"]
    base = deliveries.groupBy(*keys).agg(F.countDistinct("consumer").alias("consumers"), F.max(F.struct(*ID)).alias("last"), F.count("*").alias("entries_read"))
    waiting = pending(deliveries, acks).groupBy(*keys).agg(F.count("*").alias("pending"))
    length = log.groupBy("stream").agg(F.count("*").alias("n"))
    out = base.join(waiting, keys, "left").join(length, "stream", "left")
    zero = F.lit(0).cast("long")
    return out.select(*keys, "consumers", F.coalesce("pending", zero).alias("pending"), F.col("last.id_ms").alias("last_ms"), F.col("last.id_seq").alias("last_seq"), "entries_read", (F.coalesce("n", zero) - F.col("entries_read")).alias("lag"))


def retained(df: DataFrame, cap: int, order: list[str] = ID) -> DataFrame:
    """At least the newest ``cap`` rows (all rows of equal order to the last one stay). A range shuffle of the order's columns and a count for each
    range tell which row is the last to stay; the filter is in place. No task gets cap rows."""
    if cap <= 0:
        return df.limit(0)
    ranged, before = ranges(df.select(*order), [F.desc(o) for o in order])
    at = next(((part, cap - 1 - lo) for part, (lo, n) in before.items() if lo <= cap - 1 < lo + n), None)
    if at is None:
        return df
    edge = ranged.where((F.col("_part") == at[0]) & (F.col("_row") == at[1])).select(F.struct(*order).alias("_edge"))
    return df.join(F.broadcast(edge), F.struct(*order) >= F.col("_edge")).drop("_edge")


def newest(df: DataFrame, n: int = 5, order: list[str] = ID) -> DataFrame:
    return df.orderBy(*[F.desc(o) for o in order]).limit(n)


def oldest(df: DataFrame, n: int = 5, order: list[str] = ID) -> DataFrame:
    return df.orderBy(*order).limit(n)


def length(df: DataFrame, stream: str = "stream") -> DataFrame:
    return df.groupBy(stream).agg(F.count("*").alias("length"))


def cardinality(df: DataFrame, item: str = "item") -> DataFrame:
    return df.agg(F.countDistinct(item).alias("cardinality"))


def sampled(df: DataFrame, n: int = 5, seed: int = 0) -> DataFrame:
    """n distinct rows by chance."""
    return df.distinct().orderBy(F.rand(seed)).limit(n)
