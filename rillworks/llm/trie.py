"""The trie of conversations' prefixes, by polynomial rolling fingerprints.

A numpy scan over sorted turns gives each prefix a fingerprint; prefixes of one depth and fingerprint are a group, and its smallest conversation
represents it. A group is verified turn by turn: its members' last turns must be its representative's, and so, by induction over depths, are all turns
before. Groups that fail are split by a further fingerprint of the conversations that pass through them, until none fails. What nodes add up over
their subtrees is summed along each representative from its end, and added once to each prefix on the way.

A conversation may be as long as the table: positions, fingerprints and sums are scans over ranges of rows, and one row for each range carries
on what a conversation brings along from the range before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table, worker_path

#: Primes below 2 ** 31, and bases, of the polynomials: 93 bits together.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 69069, 1664525)
#: A digest of a turn as four columns.
DIGEST = ("s1", "s2", "s3", "s4")


def powers(base: int, k: np.ndarray, prime: int) -> np.ndarray:
    """base ** k modulo prime, by squaring."""
    out, square, rest = np.ones(len(k), np.int64), base % prime, k.astype(np.int64)
    while rest.any():
        odd = rest & 1 == 1
        out[odd] = out[odd] * square % prime
        square, rest = square * square % prime, rest >> 1
    return out


class Sums:
    """Running sums over the rows of an id, within one range of rows. folds: (column, base, prime) for values that count times base ** place modulo
    prime, (column, 1, 0) for plain sums."""

    def __init__(self, folds: list[tuple[str, int, int]]):
        self.folds, self.now, self.count, self.last = folds, None, 0, [0] * len(folds)

    def of(self, ids: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """(place in the id's rows from 1, sums with the row, sums before it) for the next rows."""
        n = len(ids)
        fresh = np.ones(n, bool)
        fresh[1:] = ids[1:] != ids[:-1]
        fresh[0] = self.now is None or ids[0] != self.now
        start = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        place = np.arange(n) - start + np.where(start < 0, self.count, 1)
        sums, before = [], []
        for j, ((_, base, prime), v) in enumerate(zip(self.folds, values, strict=True)):
            term = v % prime * powers(base, place, prime) % prime if prime else v
            total = np.cumsum(term)
            own = total + np.where(start < 0, self.last[j], 0) - np.where(start > 0, total[np.maximum(start, 1) - 1], 0)
            sums.append(own % prime if prime else own)
            before.append((own - term) % prime if prime else own - term)
            self.last[j] = int(sums[-1][-1])
        self.now, self.count = ids[-1], int(place[-1])
        return place, sums, before


def scanned(rows: DataFrame, order: list[Column], folds: list[tuple[str, int, int]] = ()) -> DataFrame:
    """rows (id, ...) with ``place``, from 1 in the order of the id's rows, and for each of folds, of a column x, ``x_sum`` and ``x_before`` (see ``Sums``).

    Rows are sorted by id and order in ranges, so an id's rows may be in several of them. Each range is scanned alone; one row for each range, of its
    last id, goes to the driver, and what the ranges before hold of a range's first id comes back as one row for a range.
    """
    spark, folds = rows.sparkSession, list(folds)
    worker_path(spark)
    outs = ["_row", "place", *[f"{c}{end}" for c, _, _ in folds for end in ("_sum", "_before")]]
    schema = T.StructType([*rows.schema, *[T.StructField(c, T.LongType()) for c in outs]])

    def scan(batches):
        sums, at = Sums(folds), 0
        for b in batches:
            if not b.num_rows:
                continue
            place, own, before = sums.of(b.column("id").to_numpy(), [b.column(c).to_numpy() for c, _, _ in folds])
            made = [np.arange(at, at + len(place)), place, *[x for pair in zip(own, before, strict=True) for x in pair]]
            at += len(place)
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, made)], names=[*b.schema.names, *outs])

    ranged = rows.repartitionByRange("id", *order).sortWithinPartitions("id", *order)
    local = stored(ranged.mapInArrow(scan, schema).withColumn("_part", F.spark_partition_id()), "scan")
    last = F.max_by(F.struct("id", "place", *[f"{c}_sum" for c, _, _ in folds]), "_row").alias("last")
    carried, now, count, held = [], None, 0, [0] * len(folds)
    for r in sorted(local.groupBy("_part").agg(F.min_by("id", "_row").alias("first"), last).collect(), key=lambda r: r["_part"]):
        if r["first"] == now:
            carried.append((r["_part"], now, count, *[x for h, (_, base, prime) in zip(held, folds, strict=True) for x in (h, pow(base, count, prime) if prime else 1)]))
        end = r["last"]
        onward = end["id"] == now  # the whole range is of one id, which began before
        scale = [pow(base, count, prime) if onward and prime else 1 for _, base, prime in folds]
        sums = [(held[j] if onward else 0) + scale[j] * end[2 + j] for j in range(len(folds))]
        held = [x % prime if prime else x for x, (_, _, prime) in zip(sums, folds, strict=True)]
        now, count = end["id"], (count if onward else 0) + end["place"]
    names = ["_part", "id", "_count", *[f"_{c}_{x}" for c, _, _ in folds for x in ("held", "scale")]]
    carry = spark.createDataFrame(carried, T.StructType([T.StructField(c, T.IntegerType() if c == "_part" else T.LongType()) for c in names]))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def whole(c: str, end: str, prime: int) -> Column:
        x = F.coalesce(f"_{c}_held", zero) + F.coalesce(f"_{c}_scale", one) * F.col(c + end)
        return (x % prime if prime else x).alias(c + end)

    out = [whole(c, end, prime) for c, _, prime in folds for end in ("_sum", "_before")]
    return local.join(F.broadcast(carry), ["_part", "id"], "left").select(*rows.columns, (F.col("place") + F.coalesce("_count", zero)).alias("place"), *out)


def digested(role: Column, text_digest: Column) -> Column:
    """A turn's digest, of its role and the hexadecimal SHA-256 of its text (64 letters, so no two turns run together alike)."""
    return F.unhex(F.sha2(F.concat(role, text_digest), 256))


def turns_of(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """id, place (from 1), digest and chars (code points) of the turns of df, whose texts are read once and go no further. Equal turns are in the order of
    role and the text's SHA-256. Null roles and texts are empty; rows with a null conversation are left out."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    read = df.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("id"), F.col(turn).alias("turn"), blank(role).alias("role"), F.sha2(blank(text), 256).alias("t"), F.char_length(blank(text)).cast("long").alias("chars"))
    placed = scanned(stored(read, "turns"), [F.col("turn"), F.col("role"), F.col("t")])
    return placed.select("id", "place", digested(F.col("role"), F.col("t")).alias("digest"), "chars")


def rebuilt(turns: DataFrame, every: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations (id), their turns (id, own, place, digest, chars)): of each conversation c the first h turns of c - c % every, h being
    crc32(c as text) % heads, and then its own after the first h."""
    ids = stored(turns.groupBy("id").agg(F.count("*").alias("n")).select("id"), "ids")
    h = F.crc32(F.col("id").cast("string").cast("binary")) % heads
    lead = turns.where((F.col("id") % every == 0) & (F.col("place") < heads)).withColumnRenamed("id", "base")
    taken = ids.withColumns({"base": F.col("id") - F.col("id") % every, "h": h}).join(lead, "base").where("place <= h").select("id", F.lit(0).alias("own"), "place", "digest", "chars")
    return ids, taken.unionAll(turns.where(F.col("place") > h).select("id", F.lit(1).alias("own"), "place", "digest", "chars"))


def _longs(rows: DataFrame) -> DataFrame:
    """rows with the digest as the columns DIGEST."""
    schema = T.StructType([*[f for f in rows.schema if f.name != "digest"], *[T.StructField(c, T.LongType()) for c in DIGEST]])

    def split(batches):
        for b in batches:
            cut = np.frombuffer(b"".join(b.column("digest").to_pylist()), np.int64).reshape(-1, 4)
            kept = [i for i, c in enumerate(b.schema.names) if c != "digest"]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in kept], *[pa.array(np.ascontiguousarray(cut[:, j])) for j in range(4)]], names=schema.names)

    worker_path(rows.sparkSession)
    return rows.mapInArrow(split, schema)


def trie(ids: DataFrame, turns: DataFrame, order: list[str], primes: tuple[int, ...] = PRIMES) -> DataFrame:
    """One row for each distinct sequence of first turns of ids (id; those without turns count as well), the empty one included.

    turns: id, the columns of order, digest (32 bytes that tell a turn) and chars. Columns: conv_id (the smallest member), depth, parent_conv_id (null for
    the root), n_convs (members), n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, (n_convs - 1) times the last
    turn's chars), ends_sha256 (of the comma-joined ids, rising, of members with no further turn; of the empty text if there are none). No ids, no rows.
    primes: of the first fingerprint; fewer or smaller ones collide more, and cost only further rounds.
    """
    empty = F.lit(bytes(32))
    order = [F.col(c).alias(f"_{i}") for i, c in enumerate(order, 1)]
    turns = turns.select("id", F.lit(1).alias("_0"), *order, "digest", F.col("chars").cast("long").alias("chars"))
    roots = ids.select("id", F.lit(0).alias("_0"), *[F.lit(None).cast(turns.schema[f"_{i}"].dataType).alias(f"_{i}") for i in range(1, len(order) + 1)], empty.alias("digest"), F.lit(0).cast("long").alias("chars"))
    rows = stored(_longs(roots.unionByName(turns)), "sequences")
    parts = [f"f{i}" for i in range(len(primes))]
    valued = rows.withColumns({f: F.col(DIGEST[i % 4]) for i, f in enumerate(parts)})
    marked = scanned(valued, [F.col(f"_{i}") for i in range(len(order) + 1)], [(f, BASES[i % len(BASES)], p) for i, (f, p) in enumerate(zip(parts, primes, strict=True))])
    marked = marked.select("id", (F.col("place") - 1).alias("depth"), "chars", *DIGEST, *[F.col(f"{f}_sum").alias(f) for f in parts], *[F.col(f"{f}_before").alias(f"p{f}") for f in parts])
    marked = stored(marked, "prefixes")
    again = 0
    while True:
        nodes, bad = _groups(marked, parts)
        if bad.isEmpty():
            break
        again += 1
        extra = f"g{again}"
        failed = marked.join(bad, ["depth", *parts], "left_semi").select("id").distinct()
        # Another base each time: conversations that ran together once part again.
        valued = marked.join(failed, "id", "left_semi").select("id", "depth", F.col(DIGEST[again % 4]).alias(extra))
        told = scanned(stored(valued, "failed"), [F.col("depth")], [(extra, BASES[again % 3] + 2 * again, PRIMES[again % 3])]).select("id", "depth", F.col(f"{extra}_sum").alias(extra), F.col(f"{extra}_before").alias(f"p{extra}"))
        marked = stored(marked.join(told, ["id", "depth"], "left").fillna(0, [extra, f"p{extra}"]), "prefixes")
        parts = [*parts, extra]
    return _rolled_up(marked, nodes, parts)


def _groups(marked: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(Groups of prefixes with what they are made of, keys of those whose members' last turns differ). All members are compared, in columns of their
    digests, by the least and the largest: nothing of a group is gathered."""
    ends = [f(c).alias(f"{name}_{c}") for c in DIGEST for f, name in ((F.min, "low"), (F.max, "high"))]
    grouped = stored(marked.groupBy("depth", *parts).agg(F.min("id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("chars").alias("chars"), *[F.min(f"p{f}").alias(f"p{f}") for f in parts], *ends), "groups")
    differ = F.lit(False)
    for c in DIGEST:
        differ = differ | (F.col(f"low_{c}") != F.col(f"high_{c}"))
    return grouped.select("depth", *parts, *[f"p{f}" for f in parts], "conv_id", "n_convs", "chars"), grouped.where(differ).select("depth", *parts)


def _rolled_up(marked: DataFrame, nodes: DataFrame, parts: list[str]) -> DataFrame:
    key = ["depth", *parts]
    above = [(F.col("depth") - 1).alias("depth"), *[F.col(f"p{f}").alias(f) for f in parts]]
    children = nodes.where("depth > 0").select(*above).groupBy(*key).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, key, "left").fillna(0, ["n_children"]), "nodes")
    # A conversation represents the nodes at its end, from some depth on. Summed from the end, its own nodes' weights up to a prefix are what it adds to
    # the subtree of that prefix's node, whoever represents that.
    own = nodes.select(F.col("conv_id").alias("id"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    weighed = stored(marked.select("id", *key).join(own, ["id", "depth"], "left").fillna(0, ["saved", "leaf"]), "weighed")
    summed = scanned(weighed, [F.desc("depth")], [("saved", 1, 0), ("leaf", 1, 0)])
    subtree = summed.groupBy(*key).agg(F.sum("saved_sum").alias("saved_tokens"), F.sum("leaf_sum").alias("n_leaves"))
    ends = _ends(stored(summed.where("place = 1").select(*key, "id"), "ends"), key)
    # Stored, so that the side with hot parents is shuffled for the join alone and can be split.
    known = stored(nodes.join(subtree, key).join(ends, key, "left"), "known")
    parents = stored(nodes.where("n_children > 0").select(*key, F.col("conv_id").alias("parent_conv_id")), "parents")
    lower = stored(known.where("depth > 0").select(*[F.col(c).alias(f"_{c}") for c in key], *above, "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "lower")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below = lower.join(parents, key).withColumn("depth", F.col("_depth"))
    top = known.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return top.select(columns).unionAll(below.select(columns)).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())))


def _ends(ends: DataFrame, key: list[str]) -> DataFrame:
    """key, ends_sha256 of the ids (key, id) of each key. Ranges of keys and ids are sorted and written out as texts beside each other; what a key is left
    with is a text for each Arrow batch, and only the digest itself is a chain, which streams."""
    kinds = [T.StructField(c, T.LongType()) for c in key]

    def write(batches):
        at = 0
        for b in batches:
            if not b.num_rows:
                continue
            held = [b.column(c).to_numpy() for c in key]
            fresh = np.ones(b.num_rows, bool)
            fresh[1:] = np.any([h[1:] != h[:-1] for h in held], 0)
            begins = np.flatnonzero(fresh)
            texts = b.column("id").cast(pa.string()).to_pylist()
            joined = [",".join(texts[lo:hi]) for lo, hi in zip(begins, [*begins[1:], len(texts)], strict=True)]
            yield pa.RecordBatch.from_arrays([*[pa.array(h[begins]) for h in held], pa.array(np.arange(at, at + len(begins))), pa.array(joined)], names=[*key, "seq", "ids"])
            at += len(begins)

    def digest(batches):
        now, chain = None, None
        for b in batches:
            keys, texts = list(zip(*[b.column(c).to_pylist() for c in key], strict=True)), b.column("ids").to_pylist()
            done = []
            for k, x in zip(keys, texts, strict=True):
                if k == now:
                    chain.update(b"," + x.encode())
                    continue
                if now is not None:
                    done.append((*now, chain.hexdigest()))
                now, chain = k, hashlib.sha256(x.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*key, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, chain.hexdigest())], names=[*key, "ends_sha256"])

    worker_path(ends.sparkSession)
    sorted_ = ends.withColumn("depth", F.col("depth").cast("long")).repartitionByRange(*key, "id").sortWithinPartitions(*key, "id")
    texts = sorted_.mapInArrow(write, T.StructType([*kinds, T.StructField("seq", T.LongType()), T.StructField("ids", T.StringType())])).withColumn("part", F.spark_partition_id())
    return texts.repartition(*key).sortWithinPartitions(*key, "part", "seq").mapInArrow(digest, T.StructType([*kinds, T.StructField("ends_sha256", T.StringType())]))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, turns = rebuilt(stored(turns_of(table(spark, sf_dir, "conversations")), "placed"))
    return trie(ids, turns, ["own", "place"])


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLE = {
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id, sha256(coalesce(role, '') || sha256(coalesce(text, ''))) AS s, length(coalesce(text, '')) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS b, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
         lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda s, z: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT c.conv_id, 0 AS own, i, s, chars FROM c JOIN t ON t.conv_id = c.b AND t.i <= c.h
  UNION ALL SELECT c.conv_id, 1, i, s, chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h),
q AS (SELECT conv_id, string_agg(s, '' ORDER BY own, i) AS k, list(chars ORDER BY own, i) AS cs FROM r GROUP BY conv_id),
w AS (SELECT c.conv_id, coalesce(k, '') AS k, coalesce(cs, []) AS cs FROM c LEFT JOIN q ON q.conv_id = c.conv_id),
p AS (SELECT conv_id, d, substr(k, 1, 64 * d) AS k, d = len(cs) AS last, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars FROM (SELECT *, unnest(range(len(cs) + 1)) AS d FROM w)),
n AS (
  SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM p GROUP BY k),
kids AS (SELECT substr(k, 1, length(k) - 64) AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.k = n.k),
under AS (SELECT u.k, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens FROM m u JOIN m v ON starts_with(v.k, u.k) GROUP BY u.k)
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN under ON under.k = m.k LEFT JOIN m up ON m.depth > 0 AND up.k = substr(m.k, 1, length(m.k) - 64)""",
}
