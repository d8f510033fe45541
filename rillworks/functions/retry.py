"""Retries: a policy gives the waits, as rows or for calls on the driver."""

from __future__ import annotations

import functools
import math
import random
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Waits of growth_modifier * e ** (attempt * growth_rate) + initial_delay_s after each attempt but the last; a modifier of 0 makes them constant.
    jitter_s: up to so much more or less, by chance."""

    max_attempts: int = 5
    initial_delay_s: float = 1
    growth_modifier: float = 1
    growth_rate: float = 1
    jitter_s: float = 0

    def waits(self, chance: random.Random | None = None) -> list[float]:
        chance = chance or random.Random()
        plain = [self.initial_delay_s + (self.growth_modifier * math.exp(n * self.growth_rate) if self.growth_modifier else 0) for n in range(1, max(1, self.max_attempts))]
        return [max(0.0, w + chance.uniform(-self.jitter_s, self.jitter_s)) for w in plain]

    def run(self, call: Callable[[], Any], sleep: Callable[[float], None] = time.sleep, failed: Callable[[Exception], None] = lambda e: None) -> Any:
        """What call returns, tried again after each wait; the last failure is raised. failed hears of the others."""
        for wait in self.waits():
            try:
                return call()
            except Exception as e:
                failed(e)
            sleep(wait)
        return call()

    def __call__(self, call: Callable) -> Callable:
        """As a decorator."""
        return functools.wraps(call)(lambda *args, **kwargs: self.run(functools.partial(call, *args, **kwargs)))


def constant(max_attempts: int = 3, delay_s: float = 1) -> Policy:
    return Policy(max_attempts, delay_s, 0)


def schedule(spark: SparkSession, policy: Policy = Policy(), jitter_seed: int | None = None) -> DataFrame:
    """attempt (from 1), delay_s: a policy's waits as rows. Jitter by chance of the seed, if there is one."""
    n = F.col("id")
    wait = F.lit(float(policy.initial_delay_s)) + (policy.growth_modifier * F.exp(n * policy.growth_rate) if policy.growth_modifier else F.lit(0.0))
    jitter = F.lit(0.0) if jitter_seed is None else (F.rand(jitter_seed) * 2 - 1) * F.lit(float(policy.jitter_s))
    return spark.range(1, max(1, policy.max_attempts)).select(n.alias("attempt"), F.greatest(wait + jitter, F.lit(0.0)).alias("delay_s"))
