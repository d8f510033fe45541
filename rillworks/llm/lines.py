"""Line dedup by levelled sorted runs of line hashes: each batch merge-anti-joins the runs, then adds its own; runs are compacted periodically.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bucketed, dropped
from .common import plan_bytes, stored, table

BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_POINTS = 10
#: Batches that a whole table is fed in, at least, and bytes of input (as the plan's statistics have it) for each; runs on a level before they are
#: merged into one of the next.
BATCHES, BATCH_BYTES, FAN = 4, 128 << 30, 3


def key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


@contextmanager
def in_order(spark: SparkSession) -> Iterator[None]:
    """Scans of bucketed tables with a file for each bucket count as sorted, so that joins of runs sort neither of them."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Runs:
    """Sets of 128-bit line hashes. A run is a table bucketed by hash and sorted in each bucket, a file to a bucket: joining it neither shuffles nor
    sorts it (inside ``in_order``)."""

    def __init__(self, spark: SparkSession, fan: int = FAN):
        self.spark, self.fan, self.levels = spark, fan, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, hashes: DataFrame) -> str:
        """hashes come from a grouping or a join by both hashes, so that a bucket is in one task."""
        return bucketed(hashes, "line_run", self.buckets, ["h1", "h2"], ["h1", "h2"])

    def without_known(self, hashes: DataFrame) -> DataFrame:
        for level in self.levels:
            for name in level:
                hashes = hashes.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return hashes

    def add(self, fresh: DataFrame) -> DataFrame:
        """Adds a run and returns it as a table. Full levels are merged into the next one."""
        if not self.levels:
            self.levels.append([])
        name = self._write(fresh)
        self.levels[0].append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        at = 0
        while at < len(self.levels):
            if len(self.levels[at]) >= self.fan:
                if at + 1 == len(self.levels):
                    self.levels.append([])
                merged = self.spark.table(self.levels[at][0]).select("h1", "h2")
                for name in self.levels[at][1:]:  # disjoint runs: a full outer merge join puts them together bucket by bucket
                    merged = merged.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "full_outer")
                old, name = self.levels[at], self._write(merged)
                self.levels[at] = []
                self.levels[at + 1].append(name)
                for name in old:
                    dropped(self.spark, name)
            at += 1

    def drop(self) -> None:
        for name in sum(self.levels, []):
            dropped(self.spark, name)
        self.levels = []


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int | None = None, min_points: int = MIN_POINTS) -> DataFrame:
    """df with repeated lines dropped from its text column, and n_lines (before) and n_dropped; columns of these names are replaced.

    A line's key (white space stripped at both ends, A-Z lower-cased) of at least min_points code points that at least two ids hold keeps its lines
    only in the smallest id. Null and empty texts are one empty line and come back as an empty text. Rows with a null id are kept whole and
    count as no holder; rows that repeat an id count as one document. Rows and columns are otherwise as they were. Batches (by size, if no number is
    given) are ranges of ids, in order, so that a key in a run always has a smaller holder.
    """
    spark, names = df.sparkSession, df.columns
    df = df.toDF(*[f"c{i}" for i in range(len(names))])
    text, id_col = df.columns[names.index(text)], df.columns[names.index(id_col)]
    id_, text_ = F.col(id_col), F.col(text)
    batches = batches or max(BATCHES, plan_bytes(df) // BATCH_BYTES)
    bounds = df.select(F.percentile_approx(id_, [i / batches for i in range(1, batches)], 1000).alias("b")).first()["b"] or []
    # The text's hash stands below the explosion, so that it is worked out once a text and not once a line.
    hashed = df.where(id_.isNotNull()).select(id_.alias("id"), F.xxhash64(F.coalesce(text_, F.lit(""))).alias("t"), text_.alias("text"))
    exploded = hashed.select("id", "t", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("k", key(F.col("line"))).where(F.char_length("k") >= min_points)
    edges = sorted(set(bounds))
    batch = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("id"))) if edges else F.lit(0)
    lines = stored(exploded.select("id", "t", "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(17), F.col("k")).alias("h2"), batch.alias("batch")), "lines", ["batch"])
    runs, repeated = Runs(spark), []
    try:
        with in_order(spark):
            for number in range(len(edges) + 1):
                own = lines.where(F.col("batch") == number).drop("batch")
                fresh = runs.add(runs.without_known(own.groupBy("h1", "h2").agg(F.min("id").alias("first"))))
                repeated.append(stored(own.join(fresh.select("h1", "h2", F.col("first").alias("id")), ["h1", "h2", "id"], "left_anti").select("id", "t", "pos"), "dropped"))
                runs.compact()
    finally:
        runs.drop()
    gone = repeated[0]
    for more in repeated[1:]:
        gone = gone.unionAll(more)
    gone = gone.distinct().groupBy("id", "t").agg(F.sort_array(F.collect_list("pos")).alias("_gone"))
    both = df.withColumns({"_id": id_, "_t": F.xxhash64(F.coalesce(text_, F.lit("")))}).join(gone.select(F.col("id").alias("_id"), F.col("t").alias("_t"), "_gone"), ["_id", "_t"], "left")
    both = both.withColumn("_lines", lines_of(text_))  # after the join, so that texts are shuffled once
    none = F.array().cast("array<int>")
    starts = F.concat(F.array(F.lit(0)), F.transform(F.coalesce("_gone", none), lambda p: p + 1))
    ends = F.concat(F.coalesce("_gone", none), F.array(F.size("_lines")))
    kept = F.flatten(F.zip_with(starts, ends, lambda s, e: F.slice("_lines", s + 1, e - s)))
    whole = F.when(F.col("_gone").isNull(), F.coalesce(text_, F.lit(""))).otherwise(F.array_join(kept, "\n"))
    counts = [F.size("_lines").cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped")]
    return both.select(*[(whole if c == text else F.col(c)).alias(name) for c, name in zip(df.columns, names, strict=True) if name not in ("n_lines", "n_dropped")], *counts)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLE = {
    "op6_line_dedup": f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
holders AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= {MIN_POINTS} GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged AS (SELECT l.*, h.k IS NOT NULL AND l.doc_id <> h.first AS gone FROM keyed l LEFT JOIN holders h ON l.k = h.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM judged GROUP BY doc_id""",
}
