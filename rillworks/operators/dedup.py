"""First-wins distinct, membership in a seen set, and cycle statistics under a time limit on the whole set."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

TTL_S = 604_800


def with_link(df: DataFrame, link: str = "link") -> DataFrame:
    """Rows whose link is neither null nor empty; blanks are a link."""
    return df.where(F.col(link).isNotNull() & (F.col(link) != ""))


def first_wins(df: DataFrame, key: str | list[str], order: list[str | Column]) -> DataFrame:
    """For each key its first row by order, whole. Sorted before the shuffle, so that each task sends one row a key at most."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def unseen(df: DataFrame, seen: DataFrame, key: str, item: str = "item") -> DataFrame:
    """Rows whose key is not in seen, with all columns. Rows with a null key are unseen."""
    return df.join(seen.select(F.col(item).alias("_item")), F.col(key) == F.col("_item"), "left_anti")


def already_seen(df: DataFrame, seen: DataFrame, key: str, item: str = "item") -> DataFrame:
    return df.join(seen.select(F.col(item).alias("_item")), F.col(key) == F.col("_item"), "left_semi")


def flagged(df: DataFrame, seen: DataFrame, key: str, item: str = "item") -> DataFrame:
    """df with ``is_seen``, 0 or 1."""
    known = seen.select(F.col(item).alias("_item")).distinct().withColumn("_hit", F.lit(1))
    return df.join(known, F.col(key) == F.col("_item"), "left").withColumn("is_seen", F.coalesce("_hit", F.lit(0))).drop("_item", "_hit")


def added(seen: DataFrame, items: DataFrame, item: str = "item") -> DataFrame:
    """The union of both sets."""
    return seen.select(item).union(items.select(item)).distinct()


def begun(latest: dict[datetime, datetime | None], ttl: timedelta) -> dict[datetime, datetime]:
    """For each cycle where the life of the set began that it falls into, given the earliest cycle before in which one of its items came (None: one
    is new). One sweep: a cycle adds to the set if that is before the life, and the first cycle ttl after the last that added begins another life."""
    out, start, grown = {}, None, None
    for c in sorted(latest):
        if start is None or c >= grown + ttl:
            start = grown = c
        elif latest[c] is None or latest[c] < start:
            grown = c
        out[c] = start
    return out


def cycle_stats(df: DataFrame, cycle: str, item: str, ttl_s: int = TTL_S) -> DataFrame:
    """cycle, new_items, seen_items, total_items for each cycle (a timestamp), when seen items are kept in a set that lives ttl_s after the last cycle
    that added to it, and then is forgotten whole.

    A cycle's item is new in the life of the set that began at s if the item's cycle before is earlier than s. So one pass counts items by
    (cycle, cycle before); where lives begin follows from the earliest cycle before, one row a cycle, which is all that comes to the driver.
    """
    rows = df.where(F.col(cycle).isNotNull() & F.col(item).isNotNull()).select(F.col(cycle).alias("c"), F.col(item).alias("x")).distinct()
    kind = rows.schema["c"].dataType
    before = F.lag("c").over(Window.partitionBy("x").orderBy("c"))
    counts = stored(rows.withColumn("p", before).groupBy("c", "p").agg(F.count("*").alias("n")), "cycles")
    earliest = F.min(F.struct(F.col("p").isNotNull().alias("known"), "p")).alias("m")  # null first
    latest = {r["c"]: r["m"]["p"] for r in counts.groupBy("c").agg(earliest).collect()}
    lives = df.sparkSession.createDataFrame(list(begun(latest, timedelta(seconds=ttl_s)).items()), T.StructType([T.StructField("c", kind), T.StructField("begun", kind)]))
    counts = counts.join(lives, "c")
    fresh = F.sum(F.when(F.col("p").isNull() | (F.col("p") < F.col("begun")), F.col("n")).otherwise(0))
    out = counts.groupBy("c").agg(F.sum("n").alias("total_items"), fresh.alias("new_items"))
    return out.select(F.col("c").alias(cycle), "new_items", (F.col("total_items") - F.col("new_items")).alias("seen_items"), "total_items")
