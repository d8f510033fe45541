"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checks import text
from ..functions.text import stream_list


@dataclass(frozen=True)
class Prioritiser:
    input_streams: str
    output_stream: str
    group_name: str
    consumer_name: str


def prioritiser(env: Mapping[str, str] = os.environ) -> Prioritiser:
    """INPUT_STREAMS, OUTPUT_STREAM, GROUP_NAME and CONSUMER_NAME; an unset or empty one is refused by name."""
    return Prioritiser(*[text(name, env.get(name)) for name in ("INPUT_STREAMS", "OUTPUT_STREAM", "GROUP_NAME", "CONSUMER_NAME")])


def input_streams(spark: SparkSession, env: Mapping[str, str] = os.environ) -> DataFrame:
    """stream, stream_pos: the names in INPUT_STREAMS, split at a comma and a blank, in order."""
    given = spark.range(1).select(F.lit(text("INPUT_STREAMS", env.get("INPUT_STREAMS"))).alias("given"))
    return given.select(F.posexplode(stream_list(F.col("given"))).alias("stream_pos", "stream")).select("stream", "stream_pos")
