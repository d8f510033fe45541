"""Approximate nearest neighbours by additive quantisation.

Full-dimensional codebooks are learnt as residual k-means on a bounded sample and then refitted by alternating least squares; every unit vector is
coded by beam search. The first codebook's word is the vector's cell; what it leaves is coded as a direction, and its length is stored beside the vector's
norm, so that vectors close to each other are told apart as well as others. A query visits the cells whose words are nearest to it, as many as a sample of
the queries needed for the recall that is asked for, and scores their codes by lookup tables; the best are ranked anew on the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored, table, worker_path

#: Cells, codebooks for what they leave, codewords in each, hypotheses kept while coding, sampled vectors for learning, candidates ranked anew for each query.
CELLS, BOOKS, WORDS, BEAM, SAMPLE, RERANK = 256, 31, 64, 2, 10_000, 200
#: Share of the sample's nearest that the cells visited must hold, and queries, of those asked, and vectors that this is measured with.
PROBE_RECALL, PROBE_QUERIES = 0.97, 500
#: Pull of a codeword towards where it was, in vectors.
RIDGE = 0.5
#: Rows of codes and queries that meet in one task.
CODE_BLOCK, QUERY_BLOCK = 16_384, 4_096


def encode(units: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes of each row (n, books), by beam search: after each codebook the beam closest partial sums stay."""
    n, d = units.shape
    left = units[:, None, :].astype(np.float32)
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books.astype(np.float32):
        cost = (left**2).sum(2)[:, :, None] - 2 * (left.reshape(-1, d) @ book.T).reshape(n, -1, len(book)) + (book**2).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        parent, word = best // len(book), best % len(book)
        left = np.take_along_axis(left, parent[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    return codes[:, 0]


def learn(units: np.ndarray, n_books: int = BOOKS, n_words: int = WORDS, beam: int = BEAM, seed: int = 7) -> np.ndarray:
    """Codebooks (books, words, dimensions) for unit vectors. Fewer vectors than words: words repeat."""
    rng, left, books = np.random.default_rng(seed), units.astype(np.float64).copy(), []
    for _ in range(n_books):
        book = learn_words(left, n_words, rng, 4)
        left -= book[nearest_word(left, book)]
        books.append(book)
    books = np.stack(books)
    codes = encode(units, books, beam)
    if n_books:  # given the codes, each codebook in turn by least squares on what the others leave
        left = units - sum(book[word] for book, word in zip(books, codes.T, strict=True))
        for _ in range(2):
            for book, word in zip(books, codes.T, strict=True):
                left += book[word]
                count = np.bincount(word, minlength=n_words)
                total = np.stack([np.bincount(word, x, n_words) for x in left.T], 1)
                book[:] = (total + RIDGE * book) / (count + RIDGE)[:, None]
                left -= book[word]
    return books


def cells(units: np.ndarray, n_words: int = CELLS, seed: int = 5) -> np.ndarray:
    """The first codebook: k-means of the unit vectors, eight or more to a cell."""
    return learn_words(units.astype(np.float64), max(1, min(n_words, len(units) // 8)), np.random.default_rng(seed), 8)


def nearest_cells(vectors_: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Cells of each row, nearest first."""
    return np.argsort(-(vectors_ @ first.T), axis=1, kind="stable")


def probes(vectors_: np.ndarray, first: np.ndarray, k: int, recall: float, asked: np.ndarray | None = None) -> int:
    """How many cells a query must visit so that they hold this share of its k nearest of these vectors: the more of the averages over some of these and
    over asked. Queries need not lie as the other vectors do. A query's own vector is not among its nearest."""
    if recall >= 1 or len(vectors_) < 2:
        return len(first)
    k = min(k, len(vectors_) - 1)
    word = nearest_word(vectors_ / np.linalg.norm(vectors_, axis=1, keepdims=True), first)
    own, most = {v.tobytes(): i for i, v in enumerate(vectors_)}, 1
    for some in (vectors_[:PROBE_QUERIES], vectors_[:0] if asked is None else asked):
        scores = some @ vectors_.T
        for i, v in enumerate(some):
            if (at := own.get(v.tobytes())) is not None:
                scores[i, at] = -np.inf
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = nearest_cells(some, first)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(first))[None, :], 1)
        held = np.bincount(np.take_along_axis(rank, word[near], 1).ravel(), minlength=len(first))
        most = max(most, int(np.searchsorted(np.cumsum(held), recall * held.sum())) + 1)
    return most


def learn_words(left: np.ndarray, n_words: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    book = left[rng.permutation(len(left))[np.arange(n_words) % len(left)]]
    for _ in range(rounds):
        word = nearest_word(left, book)
        count = np.bincount(word, minlength=n_words)
        total = np.stack([np.bincount(word, x, n_words) for x in left.T], 1)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


def nearest_word(left: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.argmin((book**2).sum(1) - 2 * left @ book.T, axis=1)


def shaped(units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word of the first codebook, length of what it leaves, direction of that)."""
    word = nearest_word(units, first)
    left = units - first[word]
    length = np.linalg.norm(left, axis=1)
    return word, length, left / np.maximum(length, 1e-12)[:, None]


def usable(vector: str) -> Column:
    """Not null, not zero, without null or non-finite components."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of a row, ties to smaller ids."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def vectors(column: pa.ChunkedArray | pa.Array, kind: type = np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def search(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector: str = "embedding", rerank: int = RERANK, recall: float = PROBE_RECALL, exact: bool = False) -> DataFrame:
    """For each row of df where is_query holds, its k nearest other rows by inner product, in doubles: query_id, rank, vec_id, score.

    Every usable vector is coded. What is approximate is which cells a query visits (on average they hold the share ``recall`` of a sample's nearest; 1: it
    visits all) and which ``rerank`` of the codes there are looked at exactly. exact: all vectors are compared instead of codes. Equal vectors are one
    candidate with their k + 1 smallest ids, as no more can be among the nearest, so copies crowd nothing out. Vectors of another length than
    most have (ties: the longer) take no part. Rows that repeat an id count once, with the smallest vector. An empty table gives no rows.
    """
    spark = df.sparkSession
    worker_path(spark)
    whole = F.col(vector).alias("v")
    rows = stored(df.where(usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole, is_query.alias("q")).groupBy("id").agg(F.min(F.struct("v", "q")).alias("m")).select("id", "m.v", "m.q"), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if("q").alias("asked")).orderBy(F.desc("n"), F.desc("d")).first()
    out = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if sizes is None:
        return spark.createDataFrame([], out)
    rows = rows.where(F.size("v") == sizes["d"])
    low = Window.partitionBy("v").orderBy("id")
    firsts = rows.select("id", "v").withColumn("r", F.row_number().over(low)).where(F.col("r") <= k + 1)
    distinct = stored(firsts.groupBy("v").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids")), "distinct")
    sample = vectors(distinct.select("v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["v"])
    units = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    first = cells(units) if not exact else units[:1]
    books = learn(shaped(units, first)[2], BOOKS).astype(np.float32) if not exact else np.zeros((0, 1, sizes["d"]), np.float32)
    some = vectors(rows.where("q").select("v").orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(PROBE_QUERIES).toArrow()["v"]) if not exact and sizes["asked"] else None
    visits = len(first) if exact else probes(sample, first, k, recall, some)

    def code(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                v = vectors(part.column(1))
                norm = np.linalg.norm(v, axis=1)
                word, length, shape = shaped(v / norm[:, None], first)
                if exact:
                    coded = v.view(np.uint8).reshape(len(v), -1)
                else:
                    coded = np.hstack([norm.astype("<f4").view(np.uint8).reshape(-1, 4), length.astype("<f4").view(np.uint8).reshape(-1, 4), encode(shape, books, BEAM)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(word.astype(np.int32)), pa.array(map(bytes, coded), pa.binary())], names=["id", "cell", "code"])

    codes = stored(distinct.select("id", "v").mapInArrow(code, "id long, cell int, code binary"), "codes")
    held = {r["cell"]: r["n"] for r in codes.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes_of = np.array([held.get(cell, 0) for cell in range(len(first))])
    # Small cells share a block, large ones are dealt to several; queries are dealt to so many groups that one is small.
    begin, many, total, place = np.zeros(len(first), np.int64), np.ones(len(first), np.int64), 0, 0
    for cell in range(len(first)):
        n = int(sizes_of[cell])
        if total and total + n > CODE_BLOCK:
            place, total = place + 1, 0
        begin[cell], many[cell] = place, max(1, -(-n // CODE_BLOCK))
        total = total + n if many[cell] == 1 else 0
        place += many[cell] if many[cell] > 1 else 0
    groups = max(1, -(-sizes["asked"] // QUERY_BLOCK))
    literal = lambda x: F.array(*[F.lit(int(i)) for i in x])
    at_cell = lambda x: F.get(literal(x), F.col("cell"))
    spread = lambda n: F.pmod(F.xxhash64("id"), n if isinstance(n, Column) else F.lit(n)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    codes = codes.withColumn("b", at_cell(begin).cast("int") + spread(at_cell(many))).select("*", every.alias("a"))

    def visit(batches):
        for b in batches:
            ids, of, v = b.column(0).to_numpy(), [], vectors(b.column(1))
            order = nearest_cells(v, first)
            # More cells where those hold fewer codes than are ranked anew.
            enough = np.maximum(visits, (np.cumsum(sizes_of[order], 1) < rerank + 1).sum(1) + 1)
            for i in range(len(ids)):
                found: dict[int, list[int]] = {}
                for cell in order[i, : enough[i]].tolist():
                    for block in range(begin[cell], begin[cell] + many[cell]):
                        found.setdefault(block, []).append(cell)
                of += [(i, block, found[block]) for block in found]
            for lo in range(0, len(of), 4096):
                some = of[lo : lo + 4096]
                take = pa.array([i for i, _, _ in some], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array([x for _, x, _ in some], pa.int32()), pa.array([np.array(c, "<i4").tobytes() for _, _, c in some], pa.binary())], names=["id", "v", "b", "cells"])

    asked = rows.where("q").select("id", "v").mapInArrow(visit, f"id long, v {rows.schema['v'].dataType.simpleString()}, b int, cells binary").withColumn("a", spread(groups))

    def score(codes: pa.Table, asked: pa.Table) -> pa.Table:
        codes = codes.sort_by("cell")
        ids, of, found = codes["id"].to_numpy(), codes["cell"].to_numpy(), ([], [], [])
        coded = np.frombuffer(b"".join(codes["code"].to_pylist()), np.uint8).reshape(len(ids), -1) if len(ids) else None
        here = [(int(c), int(lo), int(hi)) for c, lo, hi in zip(*(lambda u, at: (u, at, [*at[1:], len(ids)]))(*np.unique(of, return_index=True)), strict=True)]
        query_ids = asked["id"].to_numpy()
        for at in range(0, len(query_ids) if len(ids) else 0, 256):
            v = vectors(asked["v"].slice(at, 256), np.float64 if exact else np.float32)
            scores = np.full((len(ids), len(v)), -np.inf, v.dtype)
            if exact:
                scores[:] = coded.view(np.float64) @ v.T
            else:
                wanted = np.zeros((len(v), len(first)), bool)
                for i, c in enumerate(asked["cells"].slice(at, 256)):
                    wanted[i, np.frombuffer(c.as_py(), "<i4")] = True
                tables, near = [np.ascontiguousarray((v @ book.T).T) for book in books], v @ first.astype(np.float32).T
                for cell, lo, hi in here:
                    on = np.flatnonzero(wanted[:, cell])
                    if len(on):
                        few = [t[:, on] if len(on) < len(v) else t for t in tables]
                        total = np.zeros((hi - lo, len(on)), np.float32)
                        for t, word in zip(few, coded[lo:hi, 8:].T, strict=True):
                            total += t[word]
                        norm, length = (coded[lo:hi, i : i + 4].copy().view("<f4") for i in (0, 4))
                        scores[lo:hi, on] = (total * length + near[on, cell]) * norm
            for i, q in enumerate(query_ids[at : at + 256]):
                own = scores[:, i]
                top = best(own, ids, rerank)
                top = top[own[top] > -np.inf]
                for x, y in zip(found, (q, own[top].astype("<f8").tobytes(), ids[top].astype("<i8").tobytes()), strict=True):
                    x.append(y)
        return pa.table([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["query_id", "s", "ids"])

    near = codes.groupBy("a", "b").cogroup(asked.groupBy("a", "b")).applyInArrow(score, "query_id long, s binary, ids binary")

    def merge(batches):
        now, scores, ids = None, np.zeros(0), np.zeros(0, np.int64)

        def done():
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), now, np.int64)), pa.array(ids)], names=["query_id", "id"])

        for b in batches:
            for q, s, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if q != now:
                    if now is not None:
                        yield done()
                    now, scores, ids = q, scores[:0], ids[:0]
                scores, ids = np.concatenate([scores, np.frombuffer(s, "<f8")]), np.concatenate([ids, np.frombuffer(x, "<i8")])
                if len(ids) > rerank:
                    top = best(scores, ids, rerank)
                    scores, ids = scores[top], ids[top]
        if now is not None:
            yield done()

    # Blocks' lists of a query meet in a sorted stream, which keeps the best so far only.
    pairs = near.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(merge, "query_id long, id long")
    product = F.aggregate(F.zip_with("v", "qv", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(distinct, "id").join(rows.where("q").select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id").select("query_id", "id", "ids", product.alias("score"))
    # k + 1 distinct vectors hold k ids besides the query's own.
    ahead = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    near = scored.withColumn("r", F.row_number().over(ahead)).where(F.col("r") <= k + 1)
    scored = near.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op5_nearest": op5_nearest}
ORACLE: dict[str, str] = {}
