"""Texts to a console, line by line."""

from __future__ import annotations

import sys
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .text import TAB, coloured, indented


def shown(df: DataFrame, column: str, by: str = TAB, colour: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``shown``: the texts with each line indented, in a colour if one is given; and the columns to be kept."""
    text = indented(F.col(column), by)
    return df.select(*keep, (coloured(text, colour) if colour else text).alias("shown"))


def write(df: DataFrame, column: str, by: str = TAB, colour: str | None = None, out: TextIO | None = None) -> int:
    """Prints ``shown`` and returns the number of texts; nulls are skipped. Rows come one partition at a time."""
    n = 0
    for row in shown(df.where(F.col(column).isNotNull()), column, by, colour).toLocalIterator():
        print(row["shown"], file=out or sys.stdout)
        n += 1
    return n


def stream(df: DataFrame, column: str, checkpoint: str, by: str = TAB, colour: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """``shown`` of a stream, on the console."""
    return shown(df, column, by, colour).writeStream.format("console").option("truncate", False).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
