"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master, and an error on a cluster, whose executors couldn't read that."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="rillworks-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, ignore_errors=True)
    return found.rstrip("/")


def shared_warehouse(spark: SparkSession) -> str:
    """``spark.sql.warehouse.dir``; off a local master it must have been set, as the folder that stands there else is the driver's own."""
    found = spark.conf.get("spark.sql.warehouse.dir", None)
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    if not local and (not found or found.rstrip("/") == f"file:{os.getcwd()}/spark-warehouse"):
        raise ValueError("spark.sql.warehouse.dir must name a folder that driver and executors share")
    return found


def path_of(spark: SparkSession, path: str):
    """(Hadoop file system, path)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, target = path_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df written to the shared folder (in a folder for each value of ``by``) and read again: it is worked out once, lineage ends there, and lost
    executors cost no rerun of what came before. The files go with ``clean``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    delete_later(spark, path)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, keys: list[str], sort: list[str] | None = None) -> str:
    """df as a table below ``shared_dir``, in buckets by keys; its name. A join or grouping by the keys needs no shuffle. It goes with ``clean`` or
    ``dropped``. Where no such folder is named, on a cluster, it is a table of the warehouse, if that is a shared one."""
    spark = df.sparkSession
    name = f"{name}_{uuid.uuid4().hex}"
    try:
        path, placed = f"{shared_dir(spark)}/{name}", True
    except ValueError:
        path, placed = f"{shared_warehouse(spark)}/{name}", False
    delete_later(spark, path, name)
    writer = df.write.bucketBy(buckets, *keys)
    writer = (writer.sortBy(*sort) if sort else writer).format("parquet").option("compression", "zstd")
    (writer.option("path", path) if placed else writer).saveAsTable(name)
    return name


_kept: list[tuple[SparkSession, str, str | None]] = []


def delete_later(spark: SparkSession, path: str, name: str | None = None) -> None:
    """The folder, and the catalogue's table of that name, go with ``clean``."""
    _kept.append((spark, path, name))


def dropped(spark: SparkSession, name: str) -> None:
    """A table of ``bucketed`` goes now."""
    for item in [k for k in _kept if k[2] == name]:
        _kept.remove(item)
        _delete(*item)


def _delete(spark: SparkSession, path: str, name: str | None) -> None:
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    flush(spark, path)


def clean(down_to: int = 0) -> None:
    """Deletes what operators have stored so far, tables' entries in the catalogue included; results that were made of it can't be read again. Runs
    when the process ends, if the session is still there; a long session calls it once its results are written."""
    while len(_kept) > down_to:
        try:
            _delete(*_kept.pop())
        except Exception:  # the session ended first
            del _kept[down_to:]


atexit.register(clean)


@contextmanager
def scope() -> Iterator[None]:
    """What is stored inside goes when the block is left: for streams, which never end."""
    before = len(_kept)
    try:
        yield
    finally:
        clean(before)


def flush(spark: SparkSession, path: str) -> None:
    """Everything below path goes."""
    fs, target = path_of(spark, path)
    fs.delete(target, True)
