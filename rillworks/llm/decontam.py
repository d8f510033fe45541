"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of e is cut into e + 1 pieces. Where a text holds the item within e edits, at least one piece stands there
unchanged, so exact hits of pieces (one Aho-Corasick pass for all items) find every place to verify with Myers' bit-parallel distance.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_arrow, table

#: Edits allowed, as a share of the item's characters.
ERROR_RATE = 0.08
#: Characters of items whose automaton is in memory at once; more items are taken in more passes.
SHARD_CHARS = 4_000_000

_WORD = re.compile(r"\S+")


def normal(text: str | None) -> str:
    """Lower case, white space to single spaces, none at the ends."""
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float) -> int:
    return int(n * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces that together are the item: (offset, piece). Each has a character at least if errors < len(item)."""
    cut = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def masks(pattern: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def myers(peq: dict[str, int], n: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a stretch of text, and where the first such stretch ends.

    anchored: stretches begin at the text's begin.
    """
    full, top = (1 << n) - 1, 1 << (n - 1)
    pv, mv, score, found, end = full, 0, n, n, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full | anchored
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < found:
            found, end = score, j + 1
    return found, end


class Matcher:
    """Finds items (id, normal text) in normal texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        self.peq: dict[int, dict[str, int]] = {}
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, errors) in enumerate(self.items):
            for offset, piece in pieces(t, errors):
                at.setdefault(piece, []).append((k, offset))
        self.auto = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.auto.add_word(piece, (len(piece), uses))
        if at:
            self.auto.make_automaton()
        self.empty = not at

    def find(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of each item's best place in the text, the first of equals."""
        if self.empty:
            return
        places: dict[int, set[int]] = {}
        for last, (n, uses) in self.auto.iter(text):
            for k, offset in uses:
                places.setdefault(k, set()).add(last - n + 1 - offset)
        for k, begins in places.items():
            item_id, item, errors = self.items[k]
            best = None
            for lo, hi in self._windows(sorted(begins), errors):
                part = text[max(0, lo - errors) : hi + len(item) + errors]
                distance, end = myers(self.peq.setdefault(k, masks(item)), len(item), part)
                if distance <= errors and (best is None or distance < best[0]):
                    best = distance, max(0, lo - errors), end, part
                    if not distance:
                        break
            if best:
                distance, base, end, part = best
                _, size = myers(masks(item[::-1]), len(item), part[:end][::-1], True)
                yield item_id, distance, base + end - size, base + end

    @staticmethod
    def _windows(begins: list[int], errors: int) -> Iterator[tuple[int, int]]:
        """Begins closer than the budget are verified together."""
        lo = hi = begins[0]
        for b in begins[1:]:
            if b - hi > errors:
                yield lo, hi
                lo = b
            hi = b
        yield lo, hi


def span(text: str, start: int, end: int) -> tuple[int, int]:
    """Where the normal text's [start, end) stands in the text it was made of."""
    at, first, last = 0, None, 0
    for m in _WORD.finditer(text):
        size = len(m[0].lower())
        if first is None and start < at + size:
            first = m.start() + max(0, start - at)
        if at < end:
            last = m.start() + min(end - at, size)
        at += size + 1
    return (first or 0, min(last, len(text)))


def matches(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """For each row of df and each item that its text holds within the budget: id, item id, distance, start, end (code points of the text).

    Texts are compared in lower case with white space as single spaces. Null and empty texts match nothing, nor do null and empty items;
    items of equal text are matched each; repeated rows give repeated matches. Items are taken in shards of bounded size, each in one pass over df.
    """
    kind, item_kind = df.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    item_type = to_arrow_type(items.schema[item_id].dataType)
    rows, found = df.select(F.col(text).cast("string").alias("t"), F.col(id_col).alias("id")), None
    for matcher in _shards(items, item_id, item_text, rate):

        def work(batch: pa.RecordBatch, matcher=matcher) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for t, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for item, distance, start, end in matcher().find(normal(t)):
                    for column, x in zip(out, (key, item, distance, *span(t, start, end)), strict=True):
                        column.append(x)
            kinds = (batch.schema.field(1).type, item_type, pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["id", "item", "distance", "start", "end"])

        part = map_arrow(rows, work, f"id {kind}, item {item_kind}, distance int, start int, end int")
        found = part if found is None else found.unionAll(part)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "distance", "start", "end")


def _shards(items: DataFrame, item_id: str, item_text: str, rate: float) -> Iterator[Callable[[], Matcher]]:
    """For each shard of items, what gives its matcher on a worker (made once a task)."""
    spark = items.sparkSession
    shards = 1 + (items.agg(F.sum(F.length(item_text)).alias("n")).first()["n"] or 0) // SHARD_CHARS
    for s in range(shards):
        own = items.where(F.pmod(F.xxhash64(item_id), F.lit(shards)) == s).select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).collect()
        sent, made = spark.sparkContext.broadcast([(r["i"], normal(r["t"])) for r in own]), []

        def matcher(sent=sent, made=made) -> Matcher:
            if not made:
                made.append(Matcher(sent.value, rate))
            return made[0]

        yield matcher


def decontaminate(df: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE) -> DataFrame:
    """The rows of df whose text holds no item, unchanged, by the rules of ``matches``. Each row is judged by itself, in place."""
    names = [f"c{i}" for i in range(len(df.columns))]
    kinds = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema, strict=True))
    out = df.toDF(*names)
    for matcher in _shards(items, item_id, item_text, rate):

        def keep(batch: pa.RecordBatch, matcher=matcher) -> pa.RecordBatch:
            clean = [next(matcher().find(normal(t)), None) is None for t in batch.column(0).to_pylist()]
            return batch.filter(pa.array(clean, pa.bool_())).select(batch.schema.names[1:])

        out = map_arrow(out.select(F.col(names[df.columns.index(text)]).cast("string").alias("t"), *names), keep, kinds)
    return out.toDF(*df.columns)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLE: dict[str, str] = {}
