"""Rows to streams by type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checks import mapping


def stream_of(kind: Column, routes: dict[str, str]) -> Column:
    """The type's stream, null if it has none. Routes are configuration, so they sit in the plan, and no join is needed."""
    if not routes:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for pair in routes.items() for x in pair]), kind)


def routes_of(routes: dict[str, str]) -> dict[str, str]:
    """Routes that are a dict, not empty, of texts that are not empty; anything else is refused."""
    return mapping("routes", routes)


def routed(df: DataFrame, kind: str, routes: dict[str, str]) -> DataFrame:
    """df with ``stream``; rows without one are dropped."""
    return df.withColumn("stream", stream_of(F.col(kind), routes)).where("stream is not null")


def route_counts(df: DataFrame, kind: str, routes: dict[str, str]) -> DataFrame:
    """stream, n; streams of several types are summed, and rows without a stream are counted under a null one."""
    return df.groupBy(stream_of(F.col(kind), routes).alias("stream")).agg(F.count("*").alias("n"))


def by_type(df: DataFrame, kind: str | list[str], value: str) -> DataFrame:
    """kind, values: a batch's values by kind, in order. Lists are as long as a batch, so kind must hold the batch if df is more than one."""
    return df.groupBy(*[kind] if isinstance(kind, str) else kind).agg(F.sort_array(F.collect_list(value)).alias("values"))


def publish(df: DataFrame, kind: str, routes: dict[str, str], path: str, batch_id: int) -> None:
    """Appends to a folder for each stream. Writing a batch again replaces it, so a retried batch is published once."""
    routed(df, kind, routes).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "stream").parquet(path)
