"""A corpus pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillworks.llm import bpe, decontam, lines, neardup, toxicity
from rillworks.llm.common import crc_mod, stored, table


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with names that no operator uses, and the names it had. Columns doc_id and text keep theirs."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"_{i}_{c}" for i, c in enumerate(docs.columns)]), docs.columns


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. The learning rows are those of the operator's query."""
    own, names = _aside(docs)
    judged = toxicity.judge(own, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return judged.where("predicted = 0").select(own.columns).toDF(*names)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; every document stays, with n_chars, if it has that column, counted anew."""
    own, names = _aside(docs)
    out = lines.dedup_lines(own).select(own.columns).toDF(*names)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays, once; rows with a null id all stay."""
    own, names = _aside(docs)
    kept = neardup.link(own).where("kept and doc_id is not null").select("doc_id").distinct()
    named = own.where("doc_id is not null")
    if not named.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rest = [c for c in own.columns if c != "doc_id"]
        named = named.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("s")).select(*[F.col(c) if c == "doc_id" else F.col(f"s.{c}") for c in own.columns])
    return named.join(kept, "doc_id", "left_semi").select(own.columns).unionAll(own.where("doc_id is null")).toDF(*names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its budget of edits, go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as token ids: how many, a digest of them, and one of what they decode to."""
    return bpe.encode(docs, *bpe.digests())


STAGES = [("toxicity", drop_toxic), ("line-dedup", drop_lines), ("near-dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("byte-bpe", tokens)]

#: The stages learn scores, link sketches and merge tokens, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
