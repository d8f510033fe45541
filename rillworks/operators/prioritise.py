"""Stable order by priority within a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json import field

#: Priorities by message type. All other types come last.
PRIORITIES = {"user": 1.0, "admin": 1.0, "background": 2.0, "logging": 3.0}


def priority(kind: Column, priorities: dict[str, float] = PRIORITIES) -> Column:
    known = F.create_map(*[F.lit(x) for pair in priorities.items() for x in pair])
    return F.coalesce(F.element_at(known, kind), F.lit(float("inf")))


def ranked(df: DataFrame, batch: str, kind: Column, arrival: list[str], priorities: dict[str, float] = PRIORITIES) -> DataFrame:
    """df with priority and rank (from 1) in its batch; equal priorities keep the order of arrival. Batches are small by contract."""
    out = df.withColumn("priority", priority(kind, priorities))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(batch).orderBy("priority", *arrival)).cast("long"))


def kind_of(payload: Column, type_path: str = "$.header.type") -> Column:
    """The type of an envelope; ``$.type`` looks where only bare messages have it, so that envelopes all come last."""
    return field(payload, type_path)
