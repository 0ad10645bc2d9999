"""Operator 7, exact dedup by skew-safe combining.

Texts are equal when identical after each run of white space is replaced by
one space; null counts as empty.  Copies are combined in three steps, each of
which groups by the digest *and* the full text: within each task (partial
aggregation), within each salt of a digest, and over the salts' winners.  So
no task gets more than one row per earlier task for any text, however often
that text occurs.  Only texts whose digest occurs more than once are moved at
all.

Defined results: one row out for each row in, repeated rows included.  The
smallest id of a group stays; a null id stays only where the group has no other
id.  Rows that repeat the id of the row that stays are taken as that row, and
are kept as well.  An empty table gives an empty result.  Extra columns are
carried along by :func:`keep_first` and ignored by :func:`exact_groups`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free_names, rows_with_keys, rows_without_keys, written

#: Salts of a digest; they bound what one task of the second step receives.
SALTS = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, text_sha256.

    A group's label is its SHA-256 with a second hash and the length; should
    two different texts ever share a label, the query fails rather than merge
    them.
    """
    text = normalised(F.col(text_col))
    rows = df.select(F.col(id_col).alias("id"), text.alias("t"))
    labelled = written(
        rows.select("id", F.sha2("t", 256).alias("digest"), F.xxhash64("t").alias("second"), F.octet_length("t").alias("size")),
        "exact-labels",
    )
    repeated = written(labelled.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "exact-repeated")
    rows = rows_with_keys(rows.select("id", "t", F.sha2("t", 256).alias("digest")), repeated, ["digest"], exact=False)
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)))
        .groupBy("digest", "salt", "t")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    groups = (
        salted.groupBy("digest", "t")
        .agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
        .select("digest", F.xxhash64("t").alias("second"), F.octet_length("t").alias("size"), "keep_id", "group_size")
    )
    groups = written(groups, "exact-groups")
    if not groups.groupBy("digest", "second", "size").count().filter("count > 1").isEmpty():
        raise ValueError("different texts share a label")
    found = labelled.join(groups.filter("group_size > 1"), ["digest", "second", "size"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, that stay."""
    (digest,) = free_names(df, "digest")
    gone = exact_groups(df, id_col, text_col).filter("not kept").select(F.col(id_col), F.col("text_sha256").alias(digest))
    gone = written(gone, "exact-gone")
    marked = df.withColumn(digest, F.sha2(normalised(F.col(text_col)), 256))
    return rows_without_keys(marked, gone, [id_col, digest]).drop(digest)
