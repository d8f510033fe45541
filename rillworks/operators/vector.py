"""Cosine similarity, exact and by inverted lists."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block of queries, and of a deal of vectors, that meet in one task.
MAX_BROADCAST, DEAL = 4 << 20, 4 << 20
#: How far a matrix product's cosine may be from the one summed in order, and more.
SLACK = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if either is zero."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def length(v: Column) -> Column:
    """Null for zero vectors and where a component is null."""
    return F.nullif(F.sqrt(dot(v, v)), F.lit(0.0))


def nearest(k: int):
    """For a cogroup of queries (query_id, _q, _qn) and vectors (id, _v, _vn), with norms: the k best rows a query, as query_id, id, similarity.

    Matrix products tell which rows can be among the k, up to SLACK; these alone are summed in order, as ``dot`` does, so that equal vectors tie. Rows
    without a similarity come last.
    """

    def matrix(column: pa.ChunkedArray, at: np.ndarray) -> np.ndarray:
        flat = column.take(pa.array(at)).combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), -1)

    def sized(t: pa.Table, v: str, n: str) -> dict[int, np.ndarray]:
        size = pc.fill_null(pc.if_else(pc.is_valid(t[n]), pc.list_value_length(t[v]), -1), -1).to_numpy()
        return {int(d): np.flatnonzero(size == d) for d in np.unique(size)}

    def best(asked: pa.Table, rows: pa.Table) -> pa.Table:
        kinds = pa.schema([asked.schema.field("query_id"), pa.field("id", rows.schema.field("id").type), pa.field("similarity", pa.float64())])
        if not asked.num_rows or not rows.num_rows:
            return kinds.empty_table()
        ids, own = rows["id"].to_numpy(zero_copy_only=False), asked["query_id"].to_numpy(zero_copy_only=False)
        by_id = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        low, high = np.searchsorted(ids, own, "left", sorter=by_id), np.searchsorted(ids, own, "right", sorter=by_id)
        held, out = sized(rows, "_v", "_vn"), ([], [], [])
        norms = rows["_vn"].combine_chunks().to_numpy(zero_copy_only=False)
        asked_norms = asked["_qn"].combine_chunks().to_numpy(zero_copy_only=False)
        for d, queries in sized(asked, "_q", "_qn").items():
            at = held.get(d, by_id[:0]) if d > 0 else by_id[:0]
            v, vn = (matrix(rows["_v"], at), norms[at]) if len(at) else (None, None)
            for lo in range(0, len(queries), 128):
                some = queries[lo : lo + 128]
                q, qn = (matrix(asked["_q"], some), asked_norms[some]) if len(at) else (None, None)
                with np.errstate(all="ignore"):
                    near = (q @ v.T) / (qn[:, None] * vn) if len(at) else np.zeros((len(some), 0))
                near[~np.isfinite(near)] = np.inf
                for i, x in enumerate(some):
                    not_own, line = np.ones(len(ids), bool) if high[x] > low[x] else None, near[i]
                    if not_own is not None:
                        not_own[by_id[low[x] : high[x]]] = False
                        line = np.where(not_own[at], line, -np.inf)
                    cut = np.partition(line, len(line) - k)[len(line) - k] - SLACK if len(line) > k else -np.inf
                    few = np.flatnonzero((line >= cut) & (line > -np.inf))
                    score = np.zeros(len(few))
                    with np.errstate(all="ignore"):
                        for j in range(d if len(few) else 0):
                            score += q[i, j] * v[few, j]
                        score = score / (qn[i] * vn[few]) if len(few) else score
                    rank = np.where(np.isnan(score), np.inf, score)  # Spark's order: NaN is the largest
                    few, score = (z[np.lexsort((place[at[few]], -rank, ~np.isnan(score)))[:k]] for z in (few, score))
                    found, valid = at[few], np.ones(len(few), bool)
                    if len(found) < k:
                        none = np.ones(len(ids), bool) if not_own is None else not_own.copy()
                        none[at] = False
                        rest = by_id[none[by_id]][: k - len(found)]
                        found, score, valid = np.concatenate([found, rest]), np.concatenate([score, np.zeros(len(rest))]), np.concatenate([valid, np.zeros(len(rest), bool)])
                    out[0].append(np.full(len(found), x))
                    out[1].append(found)
                    out[2].append(pa.array(score, mask=~valid))
        of, at = (pa.array(np.concatenate(o).astype(np.int64)) for o in out[:2])
        return pa.table([asked["query_id"].take(of), rows["id"].take(at), pa.concat_arrays(out[2])], schema=kinds)

    return best


def met(queries: DataFrame, vectors: DataFrame, by: list[str], k: int) -> DataFrame:
    """query_id, id, similarity: of each group of by the k best of its vectors for each of its queries (see ``nearest``)."""
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    work, names = nearest(k), (["query_id", "_q", "_qn"], ["id", "_v", "_vn"])
    out = f"query_id {kind(queries, 'query_id')}, id {kind(vectors, 'id')}, similarity double"
    return queries.select(*by, *names[0]).groupBy(*by).cogroup(vectors.select(*by, *names[1]).groupBy(*by)).applyInArrow(lambda q, v: work(q, v), out)


def similar(queries: DataFrame, vectors: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, id, similarity, rank: for each query its k most similar other vectors, ties to smaller ids. Exact.

    Blocks of queries, of MAX_BROADCAST bytes, meet deals of vectors, of DEAL bytes, a task each; a pair of them gives k rows a query at most. All pairs
    are compared, so the work is the product of both; a task's memory is not, nor what is shuffled beyond the copies of blocks and deals.
    """
    q = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col(vector).alias("_q"), length(F.col(vector)).alias("_qn"))
    v = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector).alias("_v"), length(F.col(vector)).alias("_vn"))
    size = lambda df, c: df.agg(F.sum(F.coalesce(F.size(c), F.lit(0)) * 8 + 32).alias("b")).first()["b"] or 0
    blocks, deals = max(1, -(-size(q, "_q") // MAX_BROADCAST)), max(1, -(-size(v, "_v") // DEAL))
    dealt = lambda key, of: F.pmod(F.xxhash64(key), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    v = v.withColumn("_a", dealt("id", deals)).withColumn("_b", every(blocks))
    q = q.withColumn("_b", dealt("query_id", blocks)).withColumn("_a", every(deals))
    return _first(met(q, v, ["_a", "_b"], k), k)


def similar_articles(queries: DataFrame, embeddings: DataFrame, articles: DataFrame, k: int) -> DataFrame:
    """``similar`` with the articles joined on; embeddings have article_id."""
    found = similar(queries, embeddings, k, "article_id")
    return found.join(articles.withColumnRenamed("id", "_article"), F.col("id") == F.col("_article")).drop("_article")


def embedded(df: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], out: str = "embedding") -> DataFrame:
    """df with the vectors that an injected function makes of a batch of texts; null texts have none."""

    def run(texts: pd.Series) -> pd.Series:
        found, some = pd.Series([None] * len(texts), dtype=object), texts.notna().to_numpy()
        if some.any():
            found[some] = pd.Series([list(map(float, v)) for v in embed(texts[some].tolist())], index=found.index[some], dtype=object)
        return found

    return df.withColumn(out, F.pandas_udf(run, "array<float>")(F.col(text)))


def semantic_search(queries: DataFrame, embeddings: DataFrame, k: int, embed: Callable[[list[str]], list[list[float]]], id_col: str = "vec_id") -> DataFrame:
    """``similar`` for queries (query_id, text). Their ids and the vectors' are told apart, so that no vector is taken for the query's own."""
    asked = embedded(queries, "text", embed).where("embedding is not null").select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias(id_col), "embedding")
    rows = embeddings.select(F.concat(F.lit("v"), F.col(id_col).cast("string")).alias(id_col), "embedding")
    found = similar(asked, rows, k, id_col)
    kind = embeddings.schema[id_col].dataType
    return found.select(F.substring("query_id", 2, 1 << 30).cast(queries.schema["query_id"].dataType).alias("query_id"), F.substring("id", 2, 1 << 30).cast(kind).alias("id"), "similarity", "rank")


class Lists:
    """Inverted lists: k-means cells of unit vectors. A search looks into the ``probes`` nearest cells, and if exact into all that matter."""

    def __init__(self, vectors: DataFrame, lists: int = 100, seed: int = 1, id_col: str = "vec_id", vector: str = "embedding"):
        self.id_col, self.vector = id_col, vector
        rows = vectors.where(dot(F.col(vector), F.col(vector)) > 0)
        unit = F.transform(F.col(vector), lambda x: x.cast("double") / F.sqrt(dot(F.col(vector), F.col(vector))))
        fed = rows.withColumn("_f", array_to_vector(unit))
        model = KMeans(k=lists, seed=seed, featuresCol="_f", predictionCol="cell", maxIter=10).fit(fed)
        self.centres = [[float(x) for x in c] for c in model.clusterCenters()]
        self.cells = model.transform(fed).drop("_f")

    def search(self, queries: DataFrame, k: int, probes: int = 10, exact: bool = False) -> DataFrame:
        """exact: also looks into each further cell that can hold a vector among the k, by the least and largest angle of its vectors to its centre."""
        spark = queries.sparkSession
        centres = spark.createDataFrame(list(enumerate(self.centres)), "cell int, centre array<double>")
        near = queries.crossJoin(F.broadcast(centres)).select(F.col(self.id_col).alias("query_id"), F.col(self.vector).alias("_q"), "cell", cosine_distance(F.col(self.vector), F.col("centre")).alias("d"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "cell"))
        near = near.withColumn("_r", rank)
        found = _first(self._scored(near.where(F.col("_r") <= probes), k), k)
        if exact:
            angle = lambda d: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - d)))
            own = angle(cosine_distance(F.col(self.vector), F.col("centre")))
            spread = self.cells.join(F.broadcast(centres), "cell").groupBy("cell").agg(F.min(own).alias("_least"), F.max(own).alias("_most"))
            worst = found.groupBy("query_id").agg(F.count("similarity").alias("_n"), F.min("similarity").alias("_worst"))
            best = F.cos(F.greatest(F.lit(0.0), angle(F.col("d")) - F.col("_most"), F.col("_least") - angle(F.col("d"))))
            out = (F.col("_n") >= k) & (best < F.col("_worst") - 1e-9)
            rest = near.where(F.col("_r") > probes).join(spread, "cell").join(worst, "query_id", "left").where(~F.coalesce(out, F.lit(False)))
            found = _first(found.drop("rank").unionByName(self._scored(rest, k)), k)
        return found

    def _scored(self, chosen: DataFrame, k: int) -> DataFrame:
        """The k best of each chosen cell; cells of over DEAL bytes are dealt to several tasks."""
        v = self.cells.select("cell", F.col(self.id_col).alias("id"), F.col(self.vector).alias("_v"), length(F.col(self.vector)).alias("_vn"))
        deals = max(1, -(-(v.agg(F.sum(F.size("_v") * 8 + 32).alias("b")).first()["b"] or 0) // (DEAL * max(1, len(self.centres)))))
        v = v.withColumn("_a", F.pmod(F.xxhash64("id"), F.lit(deals)).cast("int"))
        q = chosen.select("query_id", "_q", "cell", length(F.col("_q")).alias("_qn"), F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("_a"))
        return met(q, v, ["cell", "_a"], k)


def _first(scored: DataFrame, k: int) -> DataFrame:
    last = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id"))
    return scored.withColumn("rank", last.cast("long")).where(F.col("rank") <= k)
