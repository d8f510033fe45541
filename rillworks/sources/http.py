"""JSON over HTTP, with the transport injected."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIMEOUT_S = 15.0


def call(url: str, method: str = "GET", body: str | None = None, timeout: float = TIMEOUT_S) -> str:
    """The answer's text; anything but a 2xx raises, and so does text that is no JSON."""
    request = urllib.request.Request(url, None if body is None else body.encode(), {"Content-Type": "application/json"}, method=method)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        text = answer.read().decode()
    json.loads(text)
    return text


def fetch_json(df: DataFrame, url: str, transport: Callable[[str], str] = call) -> DataFrame:
    """df with ``response`` (JSON text) and ``error`` (null if it went well): a failing row doesn't end the others."""

    def fetch(urls: pd.Series) -> pd.DataFrame:
        def one(u):
            try:
                return transport(u), None
            except Exception as e:
                return None, str(e)

        return pd.DataFrame([one(u) for u in urls], columns=["response", "error"])

    got = F.pandas_udf(fetch, "response string, error string")
    return df.withColumn("_got", got(F.col(url))).select(*df.columns, "_got.response", "_got.error")
