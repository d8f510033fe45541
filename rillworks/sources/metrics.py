"""Host metrics as one nested row, from an injected sample; and their text report."""

from __future__ import annotations

import time
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import human_bytes, thousands
from ..schemas import SYS_STATS


def _times(text: str) -> list[dict[str, float]]:
    """Of /proc/stat: seconds by state, for all cores together first, then for each."""
    names = ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal")
    rows = [line.split() for line in text.splitlines() if line.startswith("cpu")]
    return [dict(zip(names, (int(x) / 100 for x in r[1 : 1 + len(names)]), strict=False)) for r in rows]


def _busy(first: dict[str, float], then: dict[str, float]) -> float:
    total, idle = sum(then.values()) - sum(first.values()), sum(then.get(k, 0) - first.get(k, 0) for k in ("idle", "iowait"))
    return round(100 * (total - idle) / total, 1) if total > 0 else 0.0


def host(interval_s: float = 1.0, read: Callable[[str], str] = lambda path: Path(path).read_text(), sleep: Callable[[float], None] = time.sleep) -> dict[str, Any]:
    """A sample of this host, for ``sys_stats``: /proc is read twice for the cores' load, an interval apart."""
    before = _times(read("/proc/stat"))
    sleep(interval_s)
    after = _times(read("/proc/stat"))
    percents = [_busy(a, b) for a, b in zip(before, after, strict=True)]
    cores = {tuple(line.partition(":")[2].strip() for line in block.splitlines() if line.startswith(("physical id", "core id"))) for block in read("/proc/cpuinfo").split("\n\n") if "core id" in block}
    held = {k: float(v.split()[0]) * 1024 for k, _, v in (line.partition(":") for line in read("/proc/meminfo").splitlines()) if v}
    size = lambda total, free: {"total": total, "used": total - free, "free": free, "percent": round(100 * (total - free) / total, 1) if total else 0.0}
    links = [line.partition(":")[2].split() for line in read("/proc/net/dev").splitlines() if ":" in line]
    network = {name: sum(int(x[i]) for x in links) for name, i in (("bytes_recv", 0), ("packets_recv", 1), ("bytes_sent", 8), ("packets_sent", 9))}
    return {
        "cpu": {"logical_cores": len(after) - 1, "physical_cores": len(cores) or len(after) - 1, "percent": percents[0], "times": after[1:], "percents": percents[1:]},
        "memory": {"ram": size(held.get("MemTotal", 0.0), held.get("MemAvailable", 0.0)), "swap": size(held.get("SwapTotal", 0.0), held.get("SwapFree", 0.0))},
        "network": network,
    }


def sys_stats(spark: SparkSession, sample: Callable[[], dict[str, Any]]) -> DataFrame:
    """sample gives cpu (logical_cores, physical_cores, percent, times: list of maps, percents: list), memory (ram, swap), network."""
    s = sample()
    raw = "logical_cores int, physical_cores int, percent double, times array<map<string,double>>, percents array<double>, ram map<string,double>, swap map<string,double>, network map<string,bigint>"
    row = (*[s["cpu"][k] for k in ("logical_cores", "physical_cores", "percent", "times", "percents")], s["memory"]["ram"], s["memory"]["swap"], s["network"])
    each = F.transform(F.arrays_zip("times", "percents"), lambda x: F.struct(x["times"].alias("times"), x["percents"].alias("percent")))
    cpu = F.struct("logical_cores", "physical_cores", "percent", each.alias("individual_cpu_stats"))
    out = spark.createDataFrame([row], raw).select(cpu.alias("cpu"), F.struct("ram", "swap").alias("memory"), "network")
    return out.to(spark.createDataFrame([], SYS_STATS).schema)


def merged(first: Column, second: Column) -> Column:
    """Both maps' entries, the second's where both have one; needs spark.sql.mapKeyDedupPolicy=LAST_WIN."""
    return F.map_concat(first, second)


def report(stats: DataFrame) -> DataFrame:
    """One text: ``report``."""
    size = lambda m, k: human_bytes(F.col(m)[k].cast("bigint"))
    cores = F.array_join(F.transform(F.col("cpu.individual_cpu_stats"), lambda c: F.format_string("%.1f%%", c["percent"])), " ")
    parts = [
        F.lit("CPU"), F.format_string("cores: %d logical, %d physical", F.col("cpu.logical_cores"), F.col("cpu.physical_cores")), F.format_string("usage: %.1f%%", F.col("cpu.percent")), F.concat(F.lit("each: "), cores),
        F.lit("Memory"), F.concat(F.lit("total: "), size("memory.ram", "total"), F.lit(", used: "), size("memory.ram", "used")), F.concat(F.lit("swap: "), size("memory.swap", "total")),
        F.lit("Network"), F.concat(F.lit("sent: "), human_bytes(F.col("network")["bytes_sent"]), F.lit(", packets: "), thousands(F.col("network")["packets_sent"])),
        F.concat(F.lit("received: "), human_bytes(F.col("network")["bytes_recv"]), F.lit(", packets: "), thousands(F.col("network")["packets_recv"])),
    ]
    return stats.select(F.concat_ws("\n", *parts).alias("report"))
