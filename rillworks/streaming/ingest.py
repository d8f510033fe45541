"""The ingestion cycle as a stream: each micro-batch is a cycle. What was published is marked seen afterwards, never before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.dedup import first_wins, with_link
from ..operators.envelope import envelopes, payloads
from ..storage import scope
from .seen import SeenSet


def cycle(articles: DataFrame, batch_id: int, now_s: int, seen: SeenSet, log_path: str, publish=None) -> dict[str, int]:
    """Filter, first-wins distinct, anti-join, envelopes, publish, mark seen. Returns the cycle's counts; nothing is written if nothing is new."""
    with scope():
        return _cycle(articles, batch_id, now_s, seen, log_path, publish)


def _cycle(articles: DataFrame, batch_id: int, now_s: int, seen: SeenSet, log_path: str, publish) -> dict[str, int]:
    spark = articles.sparkSession
    distinct = first_wins(with_link(articles), "link", ["feed_idx", "entry_idx"]).persist()
    try:
        total = distinct.count()
        fresh = seen.unseen(distinct, "link", batch_id, now_s).persist()
        try:
            new = fresh.count() if total else 0
            if new:
                stamp = F.timestamp_seconds(F.lit(now_s)).cast("string")
                out = payloads(envelopes(fresh, stamp))
                (publish or (lambda df: df.write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")))(out)
                seen.add(fresh.select(F.col("link").alias("item")), batch_id, now_s)
            spark.createDataFrame([(batch_id, now_s, new, total - new, total)], "batch_id long, now_s long, new long, seen long, total long").coalesce(1).write.mode("overwrite").parquet(f"{log_path}-stats/batch={batch_id}")
            return {"new": new, "seen": total - new, "total": total}
        finally:
            fresh.unpersist()
    finally:
        distinct.unpersist()


def ingest(articles: DataFrame, seen: SeenSet, log_path: str, checkpoint: str, clock, trigger: dict | None = None) -> StreamingQuery:
    """articles: a stream of article rows. clock(batch rows, batch id) gives the cycle's time in seconds. Without a trigger (``{"processingTime": "1 hour"}``) it runs over what is there, then ends."""
    run = lambda df, batch_id: cycle(df, batch_id, clock(df, batch_id), seen, log_path)
    return articles.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
