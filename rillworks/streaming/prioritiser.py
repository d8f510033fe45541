"""Streams of envelopes, merged, ordered by priority within each micro-batch, and published; corrupt rows go to dead letters."""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import json
from ..functions.retry import Policy
from ..operators.batches import with_position
from ..operators.envelope import corrupt
from ..operators.prioritise import kind_of, priority
from ..schemas import LOG
from ..storage import scope

#: Triggers: what is there and no more (under a scheduler), batch after batch without end, and every hour.
ONCE, ENDLESS, HOURLY = {"availableNow": True}, {"processingTime": "0 seconds"}, {"processingTime": "1 hour"}


def merged(spark: SparkSession, paths: dict[str, str], files_per_batch: int = 1) -> DataFrame:
    """One stream of the logs in folders, by stream name."""
    one = lambda name, path: spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path).withColumn("stream", F.lit(name))
    return reduce(DataFrame.unionByName, [one(n, p) for n, p in paths.items()])


def prioritise(rows: DataFrame, batch_id: int, out: str, type_path: str = "$.header.type") -> None:
    """Publishes first; the stream's checkpoint, which acknowledges, follows. A batch written again replaces itself. Ranks come from a range shuffle, so
    a batch may be of any size."""
    bad = json.corrupt(F.col("payload"))
    good = rows.where(~bad).withColumn("priority", priority(kind_of(F.col("payload"), type_path)))
    with scope():
        placed = with_position(good, ["priority", "stream", "id_ms", "id_seq"], "rank").withColumn("rank", F.col("rank") + 1)
        placed.select("rank", "stream", "id_ms", "id_seq", "payload").write.mode("overwrite").parquet(f"{out}/prioritised/batch={batch_id}")
    corrupt(rows).write.mode("overwrite").parquet(f"{out}/dead_letter/batch={batch_id}")


def run(stream: DataFrame, out: str, checkpoint: str, type_path: str = "$.header.type", trigger: dict | None = None) -> StreamingQuery:
    """stream: of ``merged`` (whole files) or of ``sources.segments.polls``, which admits so many rows of each stream and leaves the rest to the next
    batch: what a batch gets is published or put aside, all of it. trigger: ONCE, if not given, which is one poll."""

    def batch(df: DataFrame, batch_id: int) -> None:
        prioritise(df, batch_id, out, type_path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or ONCE)).start()


def supervised(start: Callable[[], StreamingQuery], policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep) -> list[str]:
    """Runs a stream to its end. One that fails is started again, from its checkpoint, after the policy's wait; the failures swallowed so are
    returned, and the last attempt's is raised."""
    swallowed: list[str] = []
    policy.run(lambda: start().awaitTermination(), sleep, lambda e: swallowed.append(str(e)))
    return swallowed
