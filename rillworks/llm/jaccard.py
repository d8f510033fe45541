"""Jaccard self-join of n-gram sets by a tree of count vectors.

Tokens are hashed into groups, and a set is a point: how many of its tokens each group holds. What two points share is at most the sum of their
coordinates' minima, and the same bound holds for a box, which has the largest count of each group over its points. The tree has three levels:

- The root has very many groups. A point whose counts have too small minima with all other points together is linked with none and goes no further.
- Below the root is a cell for each group. A point lies in the cells of its rarest groups, as many as a partner can't lack all of, so that partners meet.
- In a cell, points are split at medians of their size and of their counts in a few wide groups into tiles of bounded size, each with its box. Boxes
  decide which tiles meet, points' own vectors which points do, and full sets what is linked.

Every test is a bound, so no link is lost. Cells are linked to two of their members first; only points that this leaves in different components meet in tiles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import bucketed
from .common import among, map_arrow, mix, plan_bytes, release, stored, table, worker_path
from .neardup import components, shingles
from .passages import by_part, pack, unpack

#: Bytes of text that are turned into points at once.
POINT_BYTES = 2 << 20
#: Wide groups, whose counts make boxes and bounds of pairs.
WIDE = 64
#: Share of the root's groups, by hash, that are counted over the corpus. It must be well above the share of tokens that partners may lack.
COUNTED = 5 / 16
#: Bytes of counted groups in a chunk of points, and bytes of input for each part of the groups.
CHUNK_BYTES, PART_BYTES = 4 << 20, 8 << 20
#: Points in a tile, and bytes of their sets.
LEAF, LEAF_BYTES = 2_048, 32 << 20
#: Marks cells of groups outside the counted share.
OUTSIDE = np.uint64(1 << 56)
SALT = np.uint64(0xD6E8FEB86659FD93)


def lacking(n, percent: int):
    """Tokens of a set of n that a partner may lack."""
    return n - -(-percent * n // 100)


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Common tokens that sets of n and m need: 100 * common >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def points(values: np.ndarray, first: np.ndarray, width: int, percent: int) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """(counts in wide groups, counted groups, and where these are too few to meet all partners the first groups of the rest), by set. Groups have width bytes."""
    n = len(first) - 1
    sizes = np.diff(first)
    of = np.repeat(np.arange(n), sizes)
    h = mix(values ^ SALT)
    counts = np.bincount(of * WIDE + (mix(h ^ SALT) % np.uint64(WIDE)).astype(np.int64), minlength=n * WIDE).reshape(n, WIDE)
    group, counted = h >> np.uint64(64 - 8 * width), (h & np.uint64(0xFFFF)) < int(COUNTED * 65536)
    order = np.lexsort((group, ~counted, of))
    group, counted = group[order], counted[order]
    fresh = np.ones(len(group), bool)
    fresh[1:] = (group[1:] != group[:-1]) | (counted[1:] != counted[:-1]) | (of[1:] != of[:-1])
    group, counted, of = group[fresh], counted[fresh], of[fresh]
    lo, held = np.searchsorted(of, np.arange(n + 1)), np.bincount(of[counted], minlength=n)
    own = [squeezed(group[a : a + c], width) for a, c in zip(lo, held, strict=False)]
    more = np.maximum(0, lacking(sizes, percent) + 1 - held)
    return counts, own, [squeezed(group[a + c : min(a + c + x, b)], width) if x else b"" for a, b, c, x in zip(lo, lo[1:], held, more, strict=False)]


def digest_of(values: bytes) -> bytes:
    return hashlib.blake2b(values, digest_size=16).digest()


def squeezed(groups: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(groups.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def expanded(packed: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(groups of all in a row, how many of each)."""
    cut = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, width)
    whole = np.zeros((len(cut), 8), np.uint8)
    whole[:, :width] = cut
    return whole.view("<u8").ravel(), np.array([len(p) // width for p in packed], np.int64)


def totals(blobs: list[bytes]) -> list[bytes | None]:
    """Of groups and their points by chunk: for each chunk its groups that several points of the corpus hold, and how many do."""
    if not blobs:
        return []
    met = [unpack(b, 2) for b in blobs]
    groups, at = np.unique(np.concatenate([m[0] for m in met]), return_inverse=True)
    total = np.bincount(at, np.concatenate([m[1] for m in met]).astype(np.float64), len(groups)).astype(np.uint64)
    out, lo = [], 0
    for m in met:
        own = total[at[lo : lo + m.shape[1]]]
        lo += m.shape[1]
        several = own > 1
        out.append(pack(m[0][several], own[several]) if several.any() else None)
    return out


def cells(groups: np.ndarray, held: np.ndarray, sizes: np.ndarray, known: np.ndarray, total: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, group) of the cells that points lie in, given their counted groups (held of each) and those that several points hold (known, with totals).

    The counts' minima with all other points together are the groups that others hold as well. A point needs so many of its groups, rarest first, that a
    partner can't lack them all; those that no other point holds are lacked by all.
    """
    of = np.repeat(np.arange(len(held)), held)
    place = np.minimum(np.searchsorted(known, groups), max(0, len(known) - 1))
    shared = known[place] == groups if len(known) else np.zeros(len(groups), bool)
    alone = held - np.bincount(of[shared], minlength=len(held))
    want = lacking(sizes, percent) + 1 - alone
    of, groups, often = of[shared], groups[shared], total[place[shared]] if len(known) else groups[shared]
    order = np.lexsort((groups, often, of))
    of, groups = of[order], groups[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    taken = rank < want[of]
    return of[taken], groups[taken]


def join(df: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row for each of df: id_col (integers), n_shingles, component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a document's set is its distinct shingles of k words, the whole sequence
    if there are fewer, empty without words. Documents with 100 * common >= percent * union are linked, empty sets with none; component_id
    is the smallest id that links reach. Rows that repeat an id are one document in links (of rows with different texts, the one with the smallest
    set stands for it). Rows with a null id are linked with none and have a null component. Equal sets are one point. Other columns of df play no part.
    Shingles are compared by 64-bit hashes, equal sets by 128 bits.
    """
    spark = df.sparkSession
    worker_path(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("t"))
    size = plan_bytes(docs)
    # 64 groups at least for each byte of input, so that few tokens meet by chance.
    width = min(7, max(5, -(-(size.bit_length() + 6) // 8)))

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, first = shingles(batch.column(0), k)
        wide, own, more = points(values, first, width, percent)
        digests = [digest_of(values[a:b].tobytes()) for a, b in zip(first, first[1:], strict=False)]
        counts = pa.ListArray.from_arrays(pa.array(np.arange(0, WIDE * len(wide) + 1, WIDE, dtype=np.int32)), pa.array(wide.ravel().astype(np.int32)))
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(first)), pa.array(digests, pa.binary()), counts, pa.array(own, pa.binary()), pa.array(more, pa.binary())], names=["id", "n", "digest", "wide", "own", "more"])

    all_rows = stored(map_arrow(docs.select("t", "id"), sketch, "id long, n long, digest binary, wide array<int>, own binary, more binary", POINT_BYTES), "points")
    light = all_rows.select("id", "n", "digest").where("n > 0 and id is not null")
    classes = stored(light.groupBy("digest").agg(F.min("id").alias("rep"), F.min("n").alias("n")), "classes")
    chosen = stored(classes.groupBy("rep").agg(F.min(F.struct("n", "digest")).alias("s")).select(F.col("rep").alias("id"), "s.digest"), "chosen")
    nodes = spark.table(_chunked(all_rows.join(chosen, ["digest", "id"], "left_semi").select("id", "n", "wide", "own", "more")))
    members = _members(_filed(nodes, size, width, percent))
    found, links = _stars(docs, nodes, members, k, percent)
    final = _rest(docs, nodes, members, found, links, k, percent)
    of = all_rows.where("id is not null").select("id", "n", "digest").join(classes.select("digest", "rep"), "digest", "left").withColumn("rep", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")))
    placed = of.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    none = all_rows.where("id is null").select("id", "n", F.lit(None).cast("long").alias("component"))
    return placed.unionAll(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def _chunked(rows: DataFrame) -> str:
    """rows as a table in chunks of bounded bytes, where they stay; its name. A row that repeats the one before is left out."""

    def chunks(batches):
        task, number, size, last = TaskContext.get().partitionId(), 0, 0, None
        for b in batches:
            ids, own = b.column("id").to_pylist(), b.column("own")
            fresh = [i for i, x in enumerate(ids) if x != (ids[i - 1] if i else last)]
            names = []
            for i in fresh:
                if size > CHUNK_BYTES:
                    number, size = number + 1, 0
                names.append(f"{task}-{number}")
                size += len(own[i].as_buffer()) + 4 * WIDE
            last = ids[-1] if ids else last
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *b.take(pa.array(fresh, pa.int64())).columns], names=["chunk", *b.schema.names])
        release()

    schema = "chunk string, id long, n long, wide array<int>, own binary, more binary"
    return bucketed(rows.mapInArrow(chunks, schema), "count_vectors", int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["chunk"])


def _filed(nodes: DataFrame, size: int, width: int, percent: int) -> DataFrame:
    """(cell, id): the cells that points lie in. Points stay in their chunks; what moves is groups, once for each chunk, to the part that counts them, and back
    those that several points hold."""
    buckets = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(4 * buckets, -(-size // PART_BYTES))

    def send(t: pa.Table) -> pa.Table:
        groups, counts = np.unique(expanded(t["own"].to_pylist(), width)[0], return_counts=True)
        full, blobs = by_part(groups, 8 * width, parts, lambda a, b: pack(groups[a:b], counts[a:b].astype(np.uint64)))
        return pa.table([pa.array([t["chunk"][0].as_py()] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["chunk", "part", "packed"])

    def answer(t: pa.Table) -> pa.Table:
        found = totals(t["packed"].to_pylist())
        kept = [i for i, x in enumerate(found) if x is not None]
        return pa.table([t["chunk"].combine_chunks().take(pa.array(kept, pa.int64())), pa.array([found[i] for i in kept], pa.binary())], names=["chunk", "packed"])

    def file(answers: pa.Table, rows: pa.Table) -> pa.Table:
        met = np.concatenate([unpack(b, 2) for b in answers["packed"].to_pylist()] or [np.zeros((2, 0), np.uint64)], 1)
        met = met[:, np.argsort(met[0])]
        groups, held = expanded(rows["own"].to_pylist(), width)
        ids, n = rows["id"].to_numpy(), rows["n"].to_numpy()
        of, cell = cells(groups, held, n, met[0], met[1], percent)
        more, extra = expanded(rows["more"].to_pylist(), width)
        of, cell = np.concatenate([of, np.repeat(np.arange(len(ids)), extra)]), np.concatenate([cell, more | OUTSIDE])
        return pa.table([pa.array(cell.astype(np.int64)), pa.array(ids[of], pa.int64())], names=["cell", "id"])

    asked = nodes.groupBy("chunk").applyInArrow(send, "chunk string, part int, packed binary")
    answers = asked.groupBy("part").applyInArrow(answer, "chunk string, packed binary")
    return stored(answers.groupBy("chunk").cogroup(nodes.select("chunk", "id", "n", "own", "more").groupBy("chunk")).applyInArrow(file, "cell long, id long"), "filed")


def _members(filed: DataFrame) -> DataFrame:
    """(cell, id, low, size) of cells with several points, low being the smallest; of cells with the same points one stays."""
    h = [F.bit_xor(F.xxhash64(F.lit(i), "id")).alias(f"x{i}") for i in (1, 2)]
    several = filed.groupBy("cell").agg(F.min("id").alias("low"), F.count("*").alias("size"), *h).where("size > 1")
    kept = stored(several.groupBy("size", "low", "x1", "x2").agg(F.min("cell").alias("cell")).select("cell", "low", "size"), "cells")
    return stored(filed.join(kept, "cell").select("cell", "id", "low", "size"), "members")


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set) of ids (id, distinct): shingles as sorted 64-bit integers."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, first = shingles(batch.column(0), k)
        sets = [values[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)]
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(first)), pa.array([digest_of(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], names=["id", "n", "digest", "set"])

    few = among(docs.where("id is not null"), ids, "id").join(ids, "id", "left_semi")
    found = map_arrow(few.select("t", "id"), cut, "id long, n long, digest binary, set binary").where("n > 0")
    return found.groupBy("id").agg(F.min(F.struct("n", "digest", "set")).alias("s")).select("id", F.col("s.set").alias("set"))


def _wide(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy().reshape(-1, WIDE)


def _linked(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _stars(docs: DataFrame, nodes: DataFrame, members: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(components of links to two members of each cell, those links): the smallest one, and the one whose cells hold most."""
    several = members.where("size > 2")
    weights = stored(several.groupBy("id").agg(F.sum("size").alias("weight")), "weights")
    central = stored(several.join(weights, "id").groupBy("cell").agg(F.max(F.struct("weight", "id")).alias("m")).select("cell", F.col("m.id").alias("to")), "central")
    pairs = members.select("id", F.col("low").alias("to")).unionAll(several.join(central, "cell").select("id", "to"))
    pairs = pairs.where("id <> to").select(F.greatest("id", "to").alias("a"), F.least("id", "to").alias("b")).distinct()

    def bounded(batches):
        for b in batches:
            n, m = b.column("na").to_numpy(), b.column("nb").to_numpy()
            most = np.minimum(_wide(b.column("wa")), _wide(b.column("wb"))).sum(1)
            yield b.filter(pa.array(most >= needed(n, m, percent))).select(["a", "b"])

    side = lambda x: nodes.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}"))
    sized = stored(pairs, "pairs").join(side("a"), "a").join(side("b"), "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    maybe = stored(sized.select("a", "b", "na", "nb", "wa", "wb").mapInArrow(bounded, "a long, b long"), "maybe")
    sets = stored(_sets(docs, maybe.select(F.explode(F.array("a", "b")).alias("id")).distinct(), k), "sets")

    def confirmed(batches):
        for b in batches:
            ok = [_linked(x.as_py(), y.as_py(), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    whole = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"s{x}"))
    links = stored(maybe.join(whole("a"), "a").join(whole("b"), "b").select("a", "b", "sa", "sb").mapInArrow(confirmed, "a long, b long"), "links")
    return components(links), links


def _rest(docs: DataFrame, nodes: DataFrame, members: DataFrame, found: DataFrame, links: DataFrame, k: int, percent: int) -> DataFrame:
    """Components of links and of those between points of a cell that links left in different components."""
    placed = members.where("size > 2").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id"))
    main = F.max(F.when(F.col("id") == F.col("low"), F.col("c"))).alias("main")
    open_ = stored(placed.groupBy("cell").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), main).where("c1 <> c2").select("cell", "main"), "open")
    rows = placed.join(open_, "cell").select("cell", "id", "c", (F.col("c") != F.col("main")).alias("stray"))
    rows = stored(rows.join(nodes.select("id", "n", "wide"), "id"), "rest")
    if rows.isEmpty():
        return found
    # Points share many cells, so what may be linked is put together first: clusters, where each point and its set come once.
    near = stored(_met(_tiled(rows), percent).groupBy("cell", "i", "j").applyInArrow(_forest(percent), "a long, b long").distinct(), "near")
    if near.isEmpty():
        return found
    clusters = stored(components(near), "clusters")
    ids = stored(clusters.select("node", "component").unionAll(clusters.select(F.col("component").alias("node"), "component").distinct()).toDF("id", "cell"), "clustered")
    own = ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("cell", "id", F.coalesce("component", "id").alias("c"), F.lit(True).alias("stray"))
    met = _met(_tiled(stored(own.join(nodes.select("id", "n", "wide"), "id"), "own")), percent, once=True)
    sets = stored(_sets(docs, ids.select("id"), k), "restsets")
    more = met.join(sets, "id").groupBy("cell", "i", "j").applyInArrow(_verified(percent), "a long, b long")
    return components(links.unionAll(stored(more, "more")))


def _tiled(rows: DataFrame) -> DataFrame:
    """rows with ``tile``: cells of over LEAF points or LEAF_BYTES of sets are split at the median of their sizes, then of their counts in one wide group after the other (where
    half of them are equal, by the ids' hashes), until no tile holds more."""
    now, level = rows.withColumn("tile", F.lit(1)), 0
    while True:
        at: Column = F.col("n") if level == 0 else F.get("wide", F.lit((level - 1) % WIDE))
        large = now.withColumn("x", at).groupBy("cell", "tile").agg(F.count("*").alias("size"), F.percentile_approx("x", [0.25, 0.5, 0.75]).alias("q"), F.sum("n").alias("total")).where((F.col("size") > LEAF) | (F.col("size") > 1) & (F.col("total") * 8 > LEAF_BYTES))
        low, mid, high = (F.get("q", F.lit(i)) for i in range(3))
        large = stored(large.select("cell", "tile", low.alias("low"), mid.alias("mid"), high.alias("high")), "large")
        if large.isEmpty():
            return now
        upper = F.when(F.col("low") < F.col("mid"), at >= F.col("mid")).when(F.col("mid") < F.col("high"), at > F.col("mid")).otherwise(F.xxhash64(F.lit(level), "id") % 2 == 0)
        child = F.when(F.col("mid").isNull(), F.col("tile")).otherwise(F.col("tile") * 2 + upper.cast("int"))
        now = stored(now.join(large, ["cell", "tile"], "left").withColumn("tile", child).select(*rows.columns, "tile"), "tiles")
        level += 1


def _met(tiled: DataFrame, percent: int, once: bool = False) -> DataFrame:
    """(cell, i, j, id, c, n, wide, left): for each two tiles of a cell whose boxes allow a link, the strays of tile i (left) and all points of tile j.
    once: for tiles that hold strays alone, each two of them in one order only."""
    wide = [F.max(F.get("wide", F.lit(g))).alias(f"g{g}") for g in range(WIDE)]
    tiles = tiled.groupBy("cell", "tile").agg(F.min("n").alias("least"), F.max("n").alias("largest"), F.count_if("stray").alias("strays"), *wide)
    boxes = stored(tiles.select("cell", "tile", "least", "largest", "strays", F.array(*[f"g{g}" for g in range(WIDE)]).alias("box")), "boxes")
    side = lambda x: boxes.select("cell", *[F.col(c).alias(f"{c}_{x}") for c in ("tile", "least", "largest", "strays", "box")])
    minima = F.aggregate(F.zip_with("box_i", "box_j", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    fits = (F.col("largest_j") * 100 >= F.col("least_i") * percent) & (F.col("largest_i") * 100 >= F.col("least_j") * percent) & (minima * (100 + percent) >= (F.col("least_i") + F.col("least_j")) * percent)
    fits = fits & (F.col("tile_i") <= F.col("tile_j")) if once else fits
    pairs = stored(side("i").where("strays_i > 0").join(side("j"), "cell").where(fits).select("cell", F.col("tile_i").alias("i"), F.col("tile_j").alias("j")), "tilepairs")
    columns = ["cell", "i", "j", "id", "c", "n", "wide", "left"]
    left = tiled.where("stray").withColumn("i", F.col("tile")).join(pairs, ["cell", "i"]).withColumn("left", F.lit(True))
    right = tiled.withColumn("j", F.col("tile")).join(pairs, ["cell", "j"]).withColumn("left", F.lit(False))
    return left.select(columns).unionAll(right.select(columns))


def _able(t: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of the left side, rows of the right side, slack) of pairs that sizes and summed minima allow, in different components; slack is how much more
    than needed their bound is."""
    left, ids, c, n, wide = t["left"].to_numpy(), t["id"].to_numpy(), t["c"].to_numpy(), t["n"].to_numpy(), _wide(t["wide"])
    rows, right = np.flatnonzero(left), np.flatnonzero(~left)
    xs, ys, slack = [], [], []
    for x in rows:
        y = right[(c[right] != c[x]) & (ids[right] != ids[x])]
        y = y[np.minimum(n[y], n[x]) * 100 >= percent * np.maximum(n[y], n[x])]
        over = np.minimum(wide[y], wide[x]).sum(1) - needed(n[y], n[x], percent)
        y, over = y[over >= 0], over[over >= 0]
        xs.append(np.full(len(y), x))
        ys.append(y)
        slack.append(over)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *xs]), np.concatenate([none, *ys]), np.concatenate([none, *slack])


def _forest(percent: int):
    """Of pairs that may be linked so many that they hold together what all hold together."""

    def work(t: pa.Table) -> pa.Table:
        ids, out, top = t["id"].to_numpy(), [], Roots()
        for a, b in zip(*_able(t, percent)[:2], strict=True):
            if top.joined(int(ids[a]), int(ids[b])):
                out.append((int(ids[a]), int(ids[b])))
        return _pairs(out)

    return work


def _verified(percent: int):
    """Links of full sets, as many as join the components of all."""

    def work(t: pa.Table) -> pa.Table:
        x, y, slack = _able(t, percent)
        ids, c, sets, out, top = t["id"].to_numpy(), t["c"].to_numpy(), t["set"], [], Roots()
        for at in np.argsort(-slack, kind="stable"):
            a, b = int(x[at]), int(y[at])
            if top.of(int(c[a])) != top.of(int(c[b])) and _linked(sets[a].as_py(), sets[b].as_py(), percent):
                top.joined(int(c[a]), int(c[b]))
                out.append((int(ids[a]), int(ids[b])))
        return _pairs(out)

    return work


def _pairs(found: list[tuple[int, int]]) -> pa.Table:
    return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])


class Roots:
    """Which numbers have been joined."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def of(self, v: int) -> int:
        top = v
        while (nxt := self.up.get(top, top)) != top:
            top = nxt
        while (nxt := self.up.get(v, v)) != top:
            self.up[v], v = top, nxt
        return top

    def joined(self, a: int, b: int) -> bool:
        """Whether they weren't joined before."""
        a, b = self.of(a), self.of(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"), k=4, percent=85)


QUERIES = {"op12_jaccard_join": op12_jaccard_join}
ORACLE = {
    "op12_jaccard_join": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
lowest AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN lowest l ON l.x = d.doc_id""",
}
