"""A corpus pipeline of five operators of ``ionforge.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads back as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionforge.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from ionforge.llm.common import free_names, rows_without_keys, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Each row has its own decision, also where ids are null or repeated: rows of
    one id, source, language and text, and only those, are scored alike.  A null
    source, language or text counts as an empty one.
    """
    (name,) = free_names(docs, "key")
    host, path, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("source", "lang", "text"))
    key = F.sha2(F.concat(F.sha2(host, 256), F.sha2(path, 256), text), 256)
    scored = quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), key=key)
    rejected = written(scored.filter("not accepted").select("doc_id", F.col("key").alias(name)), "pipeline-rejected")
    return rows_without_keys(docs.withColumn(name, key), rejected, ["doc_id", name]).drop(name)


def first_of_groups(docs: DataFrame, groups_of, name: str) -> DataFrame:
    """Of each group the row of the smallest doc_id, nulls last.

    ``groups_of`` takes the numbered rows and the number's name, and gives
    (that name, group); a row that it leaves out stays.  The numbers are written,
    so that they stay.
    """
    (row,) = free_names(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), f"{name}-rows")
    groups = written(groups_of(rows, row), f"{name}-groups")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first")
    kept = groups.join(rows.select(row, "doc_id"), row).groupBy("group").agg(first).select(f"first.{row}")
    gone = written(groups.select(row).join(kept, row, "left_anti"), f"{name}-gone")
    return rows_without_keys(rows, gone, [row]).drop(row)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays, in one row.

    A null id stays only where the group has no other.  A null text counts as
    an empty one.
    """
    return first_of_groups(docs, lambda rows, row: exact_dedup.exact_groups(rows, id_col=row).filter("group_size > 1").select(row, F.col("keep_id").alias("group")), "pipeline-exact")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five words, a similarity of 0.8 or more.

    Rows are grouped by a number of their own, as ids may be null or repeated.
    The smallest id of a group stays; a null id stays only where the group has no other.
    A text without words is a group of its own.
    """
    return first_of_groups(docs, lambda rows, row: near_dedup.near_groups(rows, id_col=row, n=5, percent=80).select(row, F.col("component_id").alias("group")), "pipeline-near")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, and each row is judged alone."""
    (leaks,) = free_names(docs, "leaks")
    return decontaminate.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), result=leaks).filter(F.size(leaks) == 0).drop(leaks)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in its bin; a document without words has one row and no bin."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", packing_stage),
]

#: SQL can express neither the classifier nor the latent search; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
