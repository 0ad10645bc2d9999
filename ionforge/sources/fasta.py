"""FASTA files, plain or compressed, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import digest


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, accession, sequence); records are split by the reader, so large files are split too."""
    raw = spark.read.text(path, lineSep="\n>")
    text = F.regexp_replace(F.regexp_replace("value", r"^>", ""), "\r", "")
    parts = raw.select(F.split(text, "\n", 2).alias("p"))
    rows = parts.select(
        F.col("p")[0].alias("header"),
        F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s+", "").alias("sequence"),
    ).filter("length(trim(header)) > 0")
    return rows.select("header", digest.accession(F.col("header")).alias("accession"), "sequence")


def read_decoys(spark: SparkSession, path: str) -> DataFrame:
    """The same records read backwards, with a decoy prefix."""
    r = read_fasta(spark, path)
    return r.select(
        F.concat(F.lit(digest.DECOY_PREFIX), "header").alias("header"),
        F.concat(F.lit(digest.DECOY_PREFIX), "accession").alias("accession"),
        F.reverse("sequence").alias("sequence"),
    )
