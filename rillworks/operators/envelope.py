"""Articles to message envelopes, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import decoded, encoded
from ..functions.text import message_id


def envelopes(articles: DataFrame, timestamp: Column, kind: str = "background") -> DataFrame:
    """header {message_id, timestamp, type}, data {url, source_rss}; title and summary are left behind. A null source is refused."""
    source = F.when(F.col("source").isNull(), F.raise_error(F.lit("an article has no source"))).otherwise(F.col("source"))
    header = F.struct(message_id(F.col("link")).alias("message_id"), timestamp.cast("string").alias("timestamp"), F.lit(kind).alias("type"))
    return articles.select(header.alias("header"), F.struct(F.col("link").alias("url"), source.alias("source_rss")).alias("data"))


def payloads(messages: DataFrame) -> DataFrame:
    """``payload``: each row as JSON text, null fields included."""
    return messages.select(encoded(F.struct(*messages.columns)).alias("payload"))


def consumed(log: DataFrame) -> DataFrame:
    """stream, msg_id, data (VARIANT) of rows that are JSON or have no payload (then data is null); corrupt rows are left out."""
    ok = F.col("payload").isNull() | decoded(F.col("payload")).isNotNull()
    return log.where(ok).select("stream", F.concat_ws("-", "id_ms", "id_seq").alias("msg_id"), decoded(F.col("payload")).alias("data"))


def corrupt(log: DataFrame) -> DataFrame:
    """The rows that ``consumed`` leaves out: they stay pending."""
    return log.where(F.col("payload").isNotNull() & decoded(F.col("payload")).isNull())
