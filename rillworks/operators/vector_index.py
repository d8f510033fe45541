"""A stored index of vectors by cell: searches read the cells near a query, and no other partition."""

from __future__ import annotations

import json
import math

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vector import dot, met, similar

#: Bytes of centres that go to every task, which bounds the number of cells. Vectors that centres are fitted on, for each of them, and that probes are measured on.
CENTRES_BYTES, FITTED, MEASURED = 64 << 20, 64, 200


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / norm(v))


def angle(cosine: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


class Index:
    """Below path: ``rows`` (id, unit vector), a partition for each cell; ``cells`` (cell, centre, least and most: the angles of its vectors to it); ``meta``
    with the probes that the wanted recall takes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, vectors: DataFrame, path: str, recall: float = 0.95, k: int = 10, cells: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> Index:
        """There are as many cells as half the square root of the vectors, so that they grow with the data, up to CENTRES_BYTES. Centres are fitted on FITTED vectors a
        cell at most, chosen by hash; all vectors but null and zero ones are in the index. Probes are measured: how many of the nearest cells
        hold that share of a sample's k nearest by brute force."""
        index = cls(vectors.sparkSession, path)
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).where(dot(F.col("v"), F.col("v")) > 0).select("id", unit(F.col("v")).alias("v"))
        first = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
        n = cells or max(2, min(math.ceil(math.sqrt(first["n"]) / 2), CENTRES_BYTES // (8 * (first["d"] or 1))))
        share = max(1, first["n"] // (n * FITTED))
        fed = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).withColumn("f", array_to_vector("v"))
        model = KMeans(k=n, seed=1, featuresCol="f", predictionCol="cell", maxIter=10).setInitSteps(1).fit(fed if first["n"] else fed.limit(0)) if first["n"] else None
        centres = [[float(x) for x in c] for c in model.clusterCenters()] if model else []
        # Directions only: a centre that is zero by cancellation points along the first axis.
        scaled = [[x / s for x in c] if (s := math.sqrt(sum(x * x for x in c))) > 0 else [1.0] + [0.0] * (len(c) - 1) for c in centres]
        sent = F.broadcast(index.spark.createDataFrame(list(enumerate(scaled)), "cell int, centre array<double>"))
        near = rows.join(sent, F.lit(True)).select("id", "v", F.struct(dot(F.col("v"), F.col("centre")).alias("c"), (-F.col("cell")).alias("cell")).alias("m"))
        placed = near.groupBy("id").agg(F.max("m").alias("m"), F.first("v").alias("v")).select("id", "v", (-F.col("m.cell")).alias("cell"), angle(F.col("m.c")).alias("angle"))
        placed.repartition("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spread = index.rows().groupBy("cell").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count("*").alias("n"))
        spread.join(sent, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        probes = index._measured(recall, k)
        index.spark.createDataFrame([(json.dumps({"probes": probes, "recall": recall, "k": k}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return index

    def rows(self) -> DataFrame:
        return self.spark.read.schema("id LONG, v ARRAY<DOUBLE>, angle DOUBLE, cell INT").parquet(f"{self.path}/rows")

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def probes(self) -> int:
        return json.loads(self.spark.read.text(f"{self.path}/meta").first()["value"])["probes"]

    def near(self, queries: DataFrame) -> DataFrame:
        """query_id, q, cell, to (angle to its centre), least, most, rank of each cell for queries (query_id, q: unit vectors)."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("to", "cell"))
        return queries.join(F.broadcast(self.cells()), F.lit(True)).withColumn("to", angle(dot(F.col("q"), F.col("centre")))).withColumn("rank", rank).select("query_id", "q", "cell", "to", "least", "most", "rank")

    def _measured(self, recall: float, k: int) -> int:
        n = self.cells().agg(F.sum("n").alias("n"), F.count("*").alias("cells")).first()
        if not n["n"]:
            return 1
        share = max(1, n["n"] // MEASURED)
        asked = self.rows().where(F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(share)) == 0).select("id", "v")
        best = similar(asked, self.rows().select("id", "v"), k, "id", "v").select("query_id", "id")
        of = best.join(self.rows().select("id", "cell"), "id")
        ranks = of.join(self.near(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q"))).select("query_id", "cell", "rank"), ["query_id", "cell"])
        by_rank = {r["rank"]: r["n"] for r in ranks.groupBy("rank").agg(F.count("*").alias("n")).collect()}  # one row a cell at most
        total, held = sum(by_rank.values()), 0
        for rank in sorted(by_rank):
            held += by_rank[rank]
            if held >= recall * total:
                return rank
        return n["cells"]

    def search(self, queries: DataFrame, k: int, exact: bool = False, probes: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
        """query_id, id, similarity, rank: the k most similar other vectors found, ties to smaller ids. exact: after the nearest cells also each that can hold a
        vector among the k, by the bounds of its angles."""
        asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector).alias("q")).where(dot(F.col("q"), F.col("q")) > 0).select("query_id", unit(F.col("q")).alias("q"))
        near, probes = self.near(asked), probes or self.probes()
        found = self._first(self._scored(near.where(F.col("rank") <= probes), k), k)
        if not exact:
            return found
        rest = self.open(near, found, k, probes)
        return self._first(found.drop("rank").unionByName(self._scored(rest, k)), k)

    def open(self, near: DataFrame, found: DataFrame, k: int, probes: int) -> DataFrame:
        """Of near the cells after the first probes that can hold a vector among the k."""
        worst = found.groupBy("query_id").agg(F.count("*").alias("_n"), F.min("similarity").alias("_worst"))
        best = F.cos(F.greatest(F.lit(0.0), F.col("to") - F.col("most"), F.col("least") - F.col("to")))
        out = (F.col("_n") >= k) & (best < F.col("_worst") - 1e-9)
        return near.where(F.col("rank") > probes).join(worst, "query_id", "left").where(~F.coalesce(out, F.lit(False))).select(near.columns)

    def _scored(self, chosen: DataFrame, k: int) -> DataFrame:
        """The chosen cells alone are read: their numbers, not more of them than there are cells, prune the table's partitions at run time."""
        read = self.rows().join(F.broadcast(chosen.select("cell").distinct()), "cell", "left_semi")
        one = F.lit(1.0)  # all are unit vectors
        asked = chosen.select("query_id", F.col("q").alias("_q"), one.alias("_qn"), "cell")
        return met(asked, read.select("id", F.col("v").alias("_v"), one.alias("_vn"), "cell"), ["cell"], k)

    @staticmethod
    def _first(scored: DataFrame, k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
