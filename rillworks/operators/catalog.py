"""Articles and sources: pages, search, statistics, inserts and checks that a database would make."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import children


def page(df: DataFrame, by: str, key: str, limit: int, offset: int = 0, status_col: str | None = None, status: str | None = None) -> DataFrame:
    """Newest first, equal times by key; rows of one status, if given."""
    rows = df if status is None else df.where(F.col(status_col) == status)
    return rows.orderBy(F.desc(by), key).offset(offset).limit(limit)


def by_id(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key) == value)


def search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in one of the columns, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lower(F.lit(text))), F.lit(False))
    return df.where(hit)


def statistics(articles: DataFrame, sources: DataFrame, status_col: str = "analysis_status", pending: str = "pending") -> DataFrame:
    """One row: articles, pending, sources. Each table is read once."""
    return articles.agg(F.count("*").alias("articles"), F.count_if(F.col(status_col) == pending).alias("pending")).crossJoin(sources.agg(F.count("*").alias("sources")))


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference leads nowhere; null references lead nowhere by intent and don't count."""
    return df.where(F.col(key).isNotNull()).join(parents.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")


def cascaded(df: DataFrame, key: str, gone: DataFrame, gone_key: str) -> DataFrame:
    """df without rows that refer to deleted ones."""
    return df.join(gone.select(F.col(gone_key).alias("_g")), F.col(key) == F.col("_g"), "left_anti")


def inserted(rows: DataFrame, schema: str, defaults: dict[str, Any], path: str | None = None) -> DataFrame:
    """rows in the table's shape, with id and created_at made where missing and defaults filled; appended to path if given, and returned."""
    spark = rows.sparkSession
    shape = spark.createDataFrame([], schema).schema
    made = {"id": F.uuid(), "created_at": F.current_timestamp()}
    value = lambda f: (F.col(f.name) if f.name in rows.columns else made.get(f.name, F.lit(defaults.get(f.name)))).cast(f.dataType).alias(f.name)
    out = rows.select(*[value(f) for f in shape]).fillna({k: v for k, v in defaults.items() if k in rows.columns})
    if path:
        out.write.mode("append").parquet(path)
    return out


def query(spark: SparkSession, sql: str, **args: Any) -> DataFrame:
    """Parameters are bound, never pasted into the text; DataFrames are tables, which the text names in braces."""
    tables = {k: v for k, v in args.items() if isinstance(v, DataFrame)}
    return spark.sql(sql, args={k: v for k, v in args.items() if k not in tables}, **tables)


def migrated(spark: SparkSession, steps: dict[str, str], path: str) -> list[str]:
    """Runs statements by version, in order of their names, each once: path keeps those that have run. Returns the versions run now."""
    done = {r["version"] for r in spark.read.schema("version string").parquet(path).collect()} if _there(spark, path) else set()
    ran = []
    for version in sorted(set(steps) - done):
        spark.sql(steps[version])
        spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("append").parquet(path)
        ran.append(version)
    return ran


def seeded(rows: DataFrame, path: str) -> bool:
    """Writes rows if nothing is there yet; whether it did."""
    if _there(rows.sparkSession, path):
        return False
    rows.write.mode("errorifexists").parquet(path)
    return True


def _there(spark: SparkSession, path: str) -> bool:
    return "_SUCCESS" in children(spark, path)


def backup(df: DataFrame, path: str, stamp: str) -> str:
    """A copy under the stamp; an existing one is not touched."""
    target = f"{path}/{stamp}"
    df.write.mode("errorifexists").parquet(target)
    return target
