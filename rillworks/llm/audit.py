"""Filter interaction audit by direct relational replay: every document's flags meet all orders of the filters, whose steps are exploded; the first
filter that a document fails decides what each step does with it, and conditional sums are combined before the shuffle.

DataFrame functions only. Texts are read once and never shuffled: what moves is a digest, an id and the flags.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

WORD = r"[^\x20\x09-\x0D]+"
#: Filters that an audit takes: the orders are their permutations, 720 for six, and are sent to every task.
MOST = 6


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions of a text that is not null: few words, repeated words, capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * F.lit(100).cast("long") < n * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("long") > F.char_length(text) * F.lit(2).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(df: DataFrame, conditions: dict[str, Column], copy: str | None = None, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """id, part (null: empty) and mask of each row of df, stored: bit i is set if the i-th filter, in the letters' order, fails it. conditions are over the
    column ``t``, the text with null as empty. copy: the letter of one more filter, which fails a text that a row with a smaller id has as well.

    Texts are compared by SHA-256. Who is first is kept by (id, digest), so that a text that many rows share is no hot key of the join. Rows with
    a null id are no copy of anything, nor is anything a copy of them; rows that repeat an id with one text are no copies of each other.
    """
    letters = sorted([*conditions, *([copy] if copy else [])])
    bit = {c: F.lit(1 << i) for i, c in enumerate(letters)}
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    mask = F.lit(0)
    for c, fails in conditions.items():
        mask = mask.bitwiseOR(F.when(fails, bit[c]).otherwise(0))
    judged = rows.select("id", "part", mask.alias("mask"), *([F.unhex(F.sha2("t", 256)).alias("digest")] if copy else []))
    if not copy:
        return stored(judged, "flags")
    judged = stored(judged, "flags")
    named = judged.where("id is not null")
    first = named.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    told = named.join(first, ["id", "digest"], "left").withColumn("mask", F.when(F.col("first").isNull(), F.col("mask").bitwiseOR(bit[copy])).otherwise(F.col("mask")))
    return told.select("id", "part", "mask").unionAll(judged.where("id is null").select("id", "part", "mask"))


def replay(flags: DataFrame, letters: str, losses: dict[str, str]) -> DataFrame:
    """One row for each part, order of the letters and step: part, filter_order, step, kept, removed, redundant, unique_fails, shapley, and for each entry of
    losses (name to a boolean column of flags) how many of those rows are removed at the step.

    flags: part, mask (bit i: the i-th letter's filter fails) and the columns of losses. Every row meets every order, and every step of it; a task adds up
    what it meets, so that one row for each part, order and step leaves it, however many rows a part has. An empty input gives no rows.
    """
    if not 0 < len(letters) <= MOST or sorted(set(letters)) != list(letters):
        raise ValueError(f"letters must be 1 to {MOST} different ones, in order")
    n = len(letters)
    orders = ["".join(p) for p in permutations(letters)]
    bits = flags.sparkSession.createDataFrame([(number, [1 << letters.index(c) for c in order]) for number, order in enumerate(orders)], "number int, bits array<int>")
    at = lambda i: F.get("bits", F.lit(i))
    hits = lambda b: F.col("mask").bitwiseAND(b) != 0
    first = F.lit(n + 1)
    for i in reversed(range(n)):
        first = F.when(hits(at(i)), i + 1).otherwise(first)
    met = flags.crossJoin(F.broadcast(bits)).select("part", "mask", *losses.values(), "number", first.alias("first"), F.posexplode("bits").alias("pos", "bit"))
    step, gone = F.col("pos") + 1, F.col("first") == F.col("pos") + 1
    sums = {
        "kept": F.col("first") > step,
        "removed": gone,
        "redundant": hits(F.col("bit")) & (F.col("first") < step),
        "unique_fails": F.col("mask") == F.col("bit"),
        **{name: gone & F.col(column) for name, column in losses.items()},
    }
    counted = met.groupBy("part", "number", "pos", "bit").agg(*[F.count_if(c).alias(name) for name, c in sums.items()])
    names = F.element_at(F.array(*map(F.lit, orders)), F.col("number") + 1)
    share = F.sum("removed").over(Window.partitionBy("part", "bit"))  # over the orders, once for each
    return counted.select("part", names.alias("filter_order"), (F.col("pos") + 1).alias("step"), *sums, share.alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``replay`` of filters A to D of ``failures`` and E, a copy of a smaller id's text, over docs, with good_lost (``quality`` is 1) and toxic_lost (``toxic``
    is 1) by labels (id_col, quality, toxic).

    Null texts are empty, and so are null parts. Labels that repeat an id count as one, with 1 if any row has it; null ids have no label. Other columns
    of docs and labels play no part. Without documents there are no rows.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    is_one = lambda c: F.coalesce(F.col(c) == 1, F.lit(False)).alias(c)
    flags = flagged(docs, failures(F.col("t")), "E", id_col, text, part).join(marks, "id", "left").select("part", "mask", is_one("quality"), is_one("toxic"))
    return replay(flags, "ABCDE", {"good_lost": "quality", "toxic_lost": "toxic"})


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLE = {
    "op11_filter_audit": r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS d FROM w GROUP BY t),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (
  SELECT w.part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * (length(w.t) - length(regexp_replace(w.t, '[A-Z]', '', 'g'))) > 2 * length(w.t) AS c,
         regexp_matches(w.t, '[#$%&*|]') AS d, coalesce(firsts.d < w.doc_id, false) AS e, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad
  FROM w JOIN firsts ON firsts.t = w.t LEFT JOIN l ON l.doc_id = w.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE q.x <> p.x AND r.x NOT IN (p.x, q.x) AND s.x NOT IN (p.x, q.x, r.x) AND t.x NOT IN (p.x, q.x, r.x, s.x)),
fails AS (SELECT *, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS failed FROM f),
firstfail AS (
  SELECT part, failed, good, bad, o, coalesce((SELECT min(i) FROM range(1, 6) r(i) WHERE contains(failed, o[i])), 6) AS first, n
  FROM (SELECT part, failed, good, bad, count(*) AS n FROM fails GROUP BY ALL), orders),
steps AS (
  SELECT part, o AS filter_order, i::INTEGER AS step, o[i] AS letter, sum(n) FILTER (WHERE first > i) AS kept, sum(n) FILTER (WHERE first = i) AS removed, sum(n) FILTER (WHERE first < i AND contains(failed, o[i])) AS redundant,
         sum(n) FILTER (WHERE failed = o[i]) AS unique_fails, sum(n) FILTER (WHERE first = i AND good) AS good_lost, sum(n) FILTER (WHERE first = i AND bad) AS toxic_lost
  FROM firstfail, range(1, 6) r(i) GROUP BY part, o, i)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM steps""",
}
