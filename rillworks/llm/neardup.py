"""Near-duplicate detection with SetSketch registers.

A register is the exponentially spaced, truncated minimum of one of m Poisson processes that the elements of a set drive; registers of a union are
the maxima of the sets' registers, and two sets' registers agree with a probability close to their similarity. Bands of registers give
candidates, registers give a joint likelihood that drops most of the wrong ones, and full sets confirm the rest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, among, map_arrow, mix, runs, stored, table, worker_path

#: Registers in a band and bands: of pairs that are 0.8 alike, (1 - 0.8 ** 6) ** 40, 5 in a million, share no band.
ROWS, BANDS = 6, 40
REGISTERS = ROWS * BANDS
#: The base of the registers' scale, and the value of a minimum of 1.
BASE, ZERO = 1.001, 30_000
#: A candidate is dropped if its registers are exp(SURE) times as likely at their best similarity as at the threshold (5 standard deviations).
SURE = 12.5
#: Bytes of text that are sketched at once.
SKETCH_BYTES = 2 << 20
#: Members of a bucket, and bytes of their sets, that are compared in one task; larger buckets are split by further bands.
BLOCK, BLOCK_BYTES = 1_024, 64 << 20
#: How many bands more a bucket is split by, before what is left of it is compared block by block.
DEPTH = 3

GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64 bits each, sorted) of all documents in a row, and the n + 1 offsets of the documents in them."""
    words = Words(column, lower=True)
    h, first = words.hashes(), words.first
    n = len(first) - 1
    count = np.diff(first)
    doc = np.repeat(np.arange(n), count)
    if len(h) >= k:
        inside = np.arange(len(h) - k + 1) + k <= np.repeat(first[1:], count)[: len(h) - k + 1]
        values, of = runs(h, k)[inside], doc[: len(h) - k + 1][inside]
    else:
        values, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for size in range(1, k):  # fewer words: the whole sequence
        short = np.flatnonzero(count == size)
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for j in range(size):
                total = mix(total + h[first[short] + j] + GOLD)
            values, of = np.concatenate([values, mix(total + np.uint64(size))]), np.concatenate([of, short])
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    values, of = values[fresh], of[fresh]
    return values, np.searchsorted(of, np.arange(n + 1))


def registers(values: np.ndarray, first: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """Registers (documents, m) as unsigned 16-bit integers.

    Each element marks registers at rising times; one whose time is past all minima of its document can change nothing more and rests.
    """
    n = len(first) - 1
    least = np.full((n, m), np.inf)
    flat = least.reshape(-1)
    of = np.repeat(np.arange(n), np.diff(first))
    state, time = mix(values + GOLD), np.zeros(len(values))
    bound = np.full(n, np.inf)
    step = 0
    while len(of):
        state = mix(state + GOLD)
        time += -np.log1p(-(state >> np.uint64(11)).astype(np.float64) * 2.0**-53) / m
        at = of * m + (mix(state ^ GOLD) % np.uint64(m)).astype(np.int64)
        np.minimum.at(flat, at, time)
        step += 1
        if step <= 4 or step % 16 == 0:
            live = np.unique(of)
            bound[live] = least[live].max(1)
            on = time < bound[of]
            of, state, time = of[on], state[on], time[on]
    with np.errstate(divide="ignore"):
        value = np.floor(ZERO - np.log(least) / np.log(BASE))
    return np.clip(np.where(np.isinf(least), 0, value), 0, 65535).astype(np.uint16)


def likely(more: np.ndarray, less: np.ndarray, m: int, n_u: np.ndarray, n_v: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the threshold is not ruled out, given in how many of m registers one set's is larger (more) or smaller, and both sizes."""
    u = n_u / (n_u + n_v)
    top = np.minimum(n_u, n_v) / np.maximum(n_u, n_v)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p = lambda x: np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-9, 1)
        up, down = p(u - (1 - u) * j), p(1 - u - u * j)
        return more * np.log(up) + less * np.log(down) + (m - more - less) * np.log(np.clip(1 - up - down, 1e-9, 1))

    at = log_likelihood(np.minimum(threshold, top))
    best = np.max([log_likelihood(top * s) for s in np.linspace(0, 0.9999, 51)], 0)
    est_high = np.max([log_likelihood(threshold + (top - threshold) * s) for s in np.linspace(0, 0.9999, 9)], 0)
    return (top >= threshold - 1e-12) & (best - np.maximum(at, est_high) <= SURE)


def bands(sketch: np.ndarray) -> np.ndarray:
    """64 bits for each band of each row."""
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * GOLD
    parts = sketch.reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(total, (len(sketch), BANDS)).copy()
    for j in range(ROWS):
        total = mix(total + parts[:, :, j] + GOLD)
    return total


def sketches(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b) but the components' smallest nodes, which name them. Large and small stars in turn until
    nothing changes; edges stay distributed."""
    now, before = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"), None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if seen == before or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = seen
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        now = stored(small.distinct(), "edges")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set) of the documents (id, t) among ids (id, distinct): shingles as sorted 64-bit integers."""
    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, first = shingles(batch.column(0), k)
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array([values[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())], names=["id", "set"])

    few = among(docs.where("id is not null").select("id", "t"), ids, "id").join(ids, "id", "left_semi")
    return map_arrow(few.select("t", "id"), cut, "id long, set binary").groupBy("id").agg(F.min("set").alias("set"))


def _overlap(a: bytes, b: bytes) -> tuple[int, int]:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both, len(x) + len(y) - both


def link(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each of df: id_col (integers), n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set is its distinct shingles of k words, the whole sequence
    if there are fewer, empty without words. Documents with 100 * common >= percent * union are linked, empty sets with none; component_id
    is the smallest id that links reach, and a document with that id is kept. Rows that repeat an id are one document in links (of
    rows with different texts, the one with the smallest set stands for it). Rows with a null id are linked with none, have a null component and are kept.
    Equal sets are one node from the start, so copies cost nothing; buckets that links to two leaders don't make one component are looked at
    further, as far as components differ: small ones pair by pair, large ones split by the further bands their members share.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, first = shingles(batch.column(0), k)
        held = registers(values, first)
        digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first, first[1:], strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(first)), pa.array(digests, pa.binary()), pa.array([r.tobytes() for r in held], pa.binary())], names=["id", "n", "digest", "sketch"])

    all_rows = stored(map_arrow(docs.select("t", "id"), sketch, "id long, n long, digest binary, sketch binary", SKETCH_BYTES), "sketches")
    linked = all_rows.where("n > 0 and id is not null")
    # Stored, here and below, where the other side of the join has hot keys: so that side is shuffled for the join alone and can be split.
    classes = stored(linked.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    nodes = stored(linked.join(classes.select("digest", F.col("rep").alias("id")), ["digest", "id"], "left_semi").groupBy("id").agg(F.min(F.struct("n", "sketch")).alias("s")).select("id", "s.n", "s.sketch"), "nodes")

    def band_rows(batches):
        for b in batches:
            keys = bands(sketches(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(b.column(0).to_numpy(), BANDS))], names=["band", "id"])

    worker_path(spark)
    spread = nodes.select("id", "sketch").mapInArrow(band_rows, "band long, id long").withColumn("c", F.col("id"))
    members, links = _stars(docs, nodes, spread, k, percent)
    first = components(links)
    final = _rest(docs, nodes, members, first, links, k, percent)
    of = all_rows.where("id is not null").select("id", "n", "digest").join(classes, "digest", "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")))
    # A repeated id may stand for several sets: each row goes by its own set's node, then by its id's.
    placed = of.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    none = all_rows.where("id is null").select("id", "n", F.lit(None).cast("long").alias("component"))
    return placed.unionAll(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _stars(docs: DataFrame, nodes: DataFrame, spread: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of buckets (band, id, c) the members of those that hold several components c, with their leader and number (band, id, low, size); and the confirmed
    links of members to leaders in other components."""
    # Two leaders a bucket: its smallest id, which is the same in all buckets of a group, and of three members or more the one whose buckets hold most:
    # what many texts were copied from shares more bands with them than they do among themselves.
    leaders = spread.groupBy("band").agg(F.min(F.struct("id", "c")).alias("low"), F.count("*").alias("size"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2")
    members = stored(spread.join(stored(leaders.select("band", "low", "size"), "leaders"), "band"), "members")
    several = members.where("size > 2")
    weights = stored(several.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    central = stored(several.join(weights, "id").groupBy("band").agg(F.max(F.struct("weight", "id", "c")).alias("m")).select("band", F.struct("m.id", "m.c").alias("to")), "central")
    pairs = members.select("id", "c", F.col("low").alias("to")).unionAll(several.select("band", "id", "c").join(central, "band").select("id", "c", "to"))
    stars = pairs.where("c <> to.c").select(F.greatest("id", "to.id").alias("a"), F.least("id", "to.id").alias("b")).distinct()

    def by_registers(batches):
        for b in batches:
            x, y = sketches(b.column(3)), sketches(b.column(5))
            n_x, n_y = b.column(2).to_numpy().astype(float), b.column(4).to_numpy().astype(float)
            ok = likely((x > y).sum(1), (x < y).sum(1), REGISTERS, n_x, n_y, percent / 100)
            yield b.filter(pa.array(ok)).select(["a", "b"])

    side = lambda key, n, s: nodes.select(F.col("id").alias(key), F.col("n").alias(n), F.col("sketch").alias(s))
    sized = stars.join(side("a", "na", "sa"), "a").join(side("b", "nb", "sb"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    maybe = stored(sized.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(by_registers, "a long, b long"), "maybe")
    sets = stored(_sets(docs, maybe.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k), "sets")

    def confirmed(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                both, all_ = _overlap(x.as_py(), y.as_py())
                ok.append(100 * both >= percent * all_)
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    whole = lambda key, s: sets.select(F.col("id").alias(key), F.col("set").alias(s))
    return members.select("band", "id", "low.id", "size").toDF("band", "id", "low", "size"), stored(maybe.join(whole("a", "xa"), "a").join(whole("b", "xb"), "b").select("a", "b", "xa", "xb").mapInArrow(confirmed, "a long, b long"), "links")


def _rest(docs: DataFrame, nodes: DataFrame, members: DataFrame, found: DataFrame, links: DataFrame, k: int, percent: int, depth: int = 0) -> DataFrame:
    """Components of links and of those between members of a bucket that were in different components.

    Members of a small bucket that are outside its leader's component are compared with all its members. Members of large buckets go to a bucket for each
    two of their large buckets, which get leaders of their own, and so on: members that share a passage and no more soon share no bucket, and those
    that are alike share several (of pairs 0.8 alike, 8 in 100,000 share one band alone). What is still large after some splits is compared block
    by block.
    """
    placed = members.where("size > 2").join(found.withColumnRenamed("node", "id"), "id", "left").select("band", "id", "size", F.coalesce("component", "id").alias("c"), (F.col("id") == F.col("low")).alias("leads"))
    split = placed.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.max(F.when(F.col("leads"), F.col("c"))).alias("main")).where("c1 <> c2")
    rest = placed.join(stored(split.select("band", "main"), "split"), "band").join(nodes.select("id", "n"), "id")
    rest = stored(rest.select("band", "id", "n", "size", "c", (F.col("c") != F.col("main")).alias("stray")), "rest")
    if rest.isEmpty():
        return found
    weights = rest.groupBy("band").agg(F.greatest(F.ceil(F.max("size") / BLOCK), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"))
    rest = stored(rest.drop("n", "size").join(weights, "band"), "weighed")
    large = rest.where("blocks > 1")
    last = depth == DEPTH or large.isEmpty()
    # A member of small buckets alone meets all whom it shares a bucket with in the first of them; others may share a large one first, which is split.
    small = F.lit(last) if last or depth else F.max("blocks").over(Window.partitionBy("id")) == 1
    rest = stored(rest.withColumn("small", small), "sided") if not last and not depth else rest.withColumn("small", small)
    links = stored(links.unionAll(_compared(docs, nodes, rest if last else rest.where("blocks = 1"), depth == 0, k, percent)), "links")
    if last:
        return components(links)

    def pairs(t: pa.Table) -> pa.Table:
        bands_ = np.sort(t["band"].to_numpy()).view(np.uint64)
        i, j = np.triu_indices(len(bands_), 1)
        keys = mix(mix(bands_[i] + GOLD) + bands_[j])
        return pa.table([pa.array(keys.view(np.int64)), *[pa.array(np.full(len(keys), t[x][0].as_py(), np.int64)) for x in ("id", "c")]], names=["band", "id", "c"])

    finer, more = _stars(docs, nodes, stored(large.select("id", "band", "c").groupBy("id").applyInArrow(pairs, "band long, id long, c long"), "finer"), k, percent)
    links = stored(links.unionAll(more), "links")
    return _rest(docs, nodes, finer, components(links), links, k, percent, depth + 1)


def _compared(docs: DataFrame, nodes: DataFrame, rest: DataFrame, first_shared: bool, k: int, percent: int) -> DataFrame:
    """Links (a, b) between rows (band, id, c, stray, blocks, small) of a band that are in different components c, as many as join these: strays against
    all, block by block. first_shared: a pair that shares several bands is looked at in the first of them, if one of the two is in small buckets alone."""
    sets = stored(_sets(docs, rest.select("id").distinct(), k).join(nodes, "id"), "restsets")
    own = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    strays = own.where("stray").select("band", F.col("block").alias("i"), every.alias("j"), "id", "c", "small", F.lit(True).alias("s"))
    others = own.select("band", every.alias("i"), F.col("block").alias("j"), "id", "c", "small", F.lit(False).alias("s"))
    # Blocks of strays that are not there need no partner.
    others = others.join(stored(strays.select("band", "i").distinct(), "blocks"), ["band", "i"], "left_semi")
    rows = strays.unionByName(others).join(sets, "id").select("band", "i", "j", "id", "c", "small", "s", "n", "sketch", "set")

    def compare(t: pa.Table) -> pa.Table:
        s = t["s"].to_numpy()
        ids, c, n = t["id"].to_numpy(), t["c"].to_numpy(), t["n"].to_numpy().astype(float)
        held = sketches(t["sketch"])
        keys = bands(held)
        here = int(np.flatnonzero((keys == np.int64(t["band"][0].as_py()).astype(np.uint64)).any(0))[0]) if len(ids) and first_shared else 0
        left, right = np.flatnonzero(s), np.flatnonzero(~s)
        able = (ids[left][:, None] != ids[right]) & (c[left][:, None] != c[right])
        small = t["small"].to_numpy()
        alone = small[left][:, None] | small[right]
        for band in range(here):
            able &= ~alone | (keys[left, band][:, None] != keys[right, band])
        able &= np.minimum(n[left][:, None], n[right]) * 100 >= percent * np.maximum(n[left][:, None], n[right])
        x, y = np.nonzero(able)
        close, xs, ys = [], [], []
        for at in range(0, len(x), 20_000):
            a, b = left[x[at : at + 20_000]], right[y[at : at + 20_000]]
            more, less = (held[a] > held[b]).sum(1), (held[a] < held[b]).sum(1)
            ok = likely(more, less, REGISTERS, n[a], n[b], percent / 100)
            close.append((more + less)[ok])
            xs.append(a[ok])
            ys.append(b[ok])
        top: dict[int, int] = {}

        def root(v: int) -> int:
            while top.get(v, v) != v:
                v = top[v]
            return v

        out = []
        if close:
            order = np.argsort(np.concatenate(close), kind="stable")
            for a, b in zip(np.concatenate(xs)[order], np.concatenate(ys)[order], strict=True):
                p, q = root(int(c[a])), root(int(c[b]))
                if p != q:  # else they are linked by others already
                    both, all_ = _overlap(t["set"][int(a)].as_py(), t["set"][int(b)].as_py())
                    if 100 * both >= percent * all_:
                        top[max(p, q)] = min(p, q)
                        out.append((int(ids[a]), int(ids[b])))
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], names=["a", "b"])

    return stored(rows.groupBy("band", "i", "j").applyInArrow(compare, "a long, b long"), "more")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), k=4)


QUERIES = {"op3_near_dedup": op3_near_dedup}
ORACLE = {
    "op3_near_dedup": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
lowest AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id, least(d.doc_id, coalesce(l.y, d.doc_id)) = d.doc_id AS kept
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.x = d.doc_id""",
}
