"""Whole queries on a cluster whose session names spark.checkpoint.dir alone, so that its warehouse is Spark's default, a folder of the driver's own."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__

from ..conftest import ROOT

RUN = """
import sys

from pyspark.sql import SparkSession

root, name, sf_dir, work = sys.argv[1:]
sys.path.insert(0, root)
import __spark_entry__

conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1g", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"{work}/shared", "spark.local.dir": f"{work}/own", "spark.sql.shuffle.partitions": "4"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
try:
    __spark_entry__.queries()[name](spark, sf_dir).write.parquet(f"{work}/out")
finally:
    spark.stop()
"""


@pytest.mark.parametrize("name", ["op6_line_dedup", "op7_substring_dedup"])
def test_default_warehouse(duck, sf_dir, rows_of, tmp_path, name):
    ran = subprocess.run([sys.executable, "-c", RUN, str(ROOT), name, str(sf_dir), str(tmp_path)], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert not ran.returncode, ran.stderr[-2000:]
    assert not (tmp_path / "spark-warehouse").exists() or not list((tmp_path / "spark-warehouse").iterdir())
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = duckdb.sql(f"SELECT {', '.join(names)} FROM '{tmp_path}/out/*.parquet'").fetchall()
    assert rows_of(names, got) == rows_of(names, want.fetchall())
