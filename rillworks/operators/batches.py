"""Batches by position."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored


def with_position(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """df with each row's position (from 0) in the order, which must tell rows apart.

    A range shuffle and a count for each partition; no task gets more than a partition, where a window over everything would take all rows.
    """
    ranged, before = ranges(df, order)
    starts = [x for part in sorted(before) for x in (F.lit(part), F.lit(before[part][0]))]
    offset = F.element_at(F.create_map(*starts), F.col("_part")) if starts else F.lit(0)
    return ranged.withColumn(name, (F.col("_row") + offset).cast("long")).drop("_part", "_row")


def ranges(df: DataFrame, order: list[str | Column]) -> tuple[DataFrame, dict[int, tuple[int, int]]]:
    """df in order, stored, with _part and _row in it; and for each part how many rows are before it and in it."""
    place = F.monotonically_increasing_id()
    ranged = stored(df.repartitionByRange(*[F.col(o) if isinstance(o, str) else o for o in order]).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_row": place.bitwiseAND(F.lit((1 << 33) - 1))}), "ranged")
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    out, before = {}, 0
    for part in sorted(sizes):
        out[part] = (before, sizes[part])
        before += sizes[part]
    return ranged, out


def assigned(df: DataFrame, order: list[str | Column], n: int) -> DataFrame:
    """df with position, batch_id (the batch's first position) and size. n = 0 is refused; a negative n gives no rows."""
    if n == 0:
        raise ValueError("batch size must not be zero")
    if n < 0:
        return df.limit(0).withColumns({"position": F.lit(0).cast("long"), "batch_id": F.lit(0).cast("long"), "size": F.lit(0).cast("long")})
    placed = with_position(df, order)
    total = placed.agg(F.count("*").alias("n")).first()["n"]
    start = F.floor(F.col("position") / n) * n
    return placed.withColumn("batch_id", start.cast("long")).withColumn("size", F.least(F.lit(n), F.lit(total) - F.col("batch_id")).cast("long"))


def batch_action(df: DataFrame, order: list[str | Column], n: int, action: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """action on each batch (its rows in order, with batch_id); batches run beside each other, and batch_id keeps their order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return action(pdf.sort_values("position", ignore_index=True))

    return assigned(df, order, n).groupBy("batch_id").applyInPandas(run, schema)
