"""The session: one to a process, with the settings the operators rely on."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

from .functions.retry import Policy

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # A batch is in memory twice, and texts may be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}


def session(master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName("rillworks").config(map=CONF | conf)
    return connect((builder.master(master) if master else builder).getOrCreate)


def connect(open_: Callable[[], SparkSession], policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep) -> SparkSession:
    """The session that open_ gives once it answers, tried again by the policy."""

    def answers() -> SparkSession:
        spark = open_()
        spark.sql("SELECT 1").collect()
        return spark

    return policy.run(answers, sleep)


def close(spark: SparkSession | None) -> None:
    """Stops the session; without one nothing happens."""
    if spark is not None:
        spark.stop()


def status(probe: Callable[[], Any]) -> dict[str, Any]:
    """``connected`` with what the probe returns or, if it raises, ``disconnected`` with the reason: a status never fails."""
    try:
        return {"status": "connected", "detail": "", "value": probe()}
    except Exception as e:
        return {"status": "disconnected", "detail": str(e), "value": None}
