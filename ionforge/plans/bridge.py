"""The domain's views over the general test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(accession, sequence): the letters A-Z of each document's whole text."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]+", ""))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("DOC_"), F.col("doc_id").cast("string")).alias("accession"), letters.alias("sequence"))


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spec_id, charge, precursor_mz)."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("spec_id"), (1 + F.col("event_id") % 6).cast("int").alias("charge"), (200 + 5 * F.col("value")).alias("precursor_mz"))


def peak_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spec_id, pos, mz, intensity), one row per peak; pos counts a spectrum's peaks from 0 by m/z."""
    df = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("spec_id"), (F.col("l_extendedprice") / 50).alias("mz"), F.col("l_quantity").alias("intensity"), "l_orderkey", "l_linenumber")
    return df


def peak_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spec_id, peaks): a spectrum's peaks by m/z."""
    rows = peak_rows(spark, sf_dir)
    sorted_ = F.sort_array(F.collect_list(F.struct("mz", "intensity", "l_orderkey", "l_linenumber")))
    return rows.groupBy("spec_id").agg(F.transform(sorted_, lambda p: F.struct(p.mz.alias("mz"), p.intensity.alias("intensity"))).alias("peaks"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, embedding, mass, is_decoy)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (500 + (F.col("vec_id") * 7919) % 4500).cast("double").alias("mass"), (F.col("label") % 2 == 1).alias("is_decoy"))


def psms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(psm_id, score, is_decoy, delta_mass); lower scores are better, and the better ones have fewer decoys."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("psm_id"),
        (-F.floor(F.col("o_totalprice") / 1000).cast("long")).alias("score"),
        ((F.col("o_custkey") % 7 == 0) & (F.col("o_totalprice") < 250000)).alias("is_decoy"),
        (F.col("o_totalprice") % 900 - 200).alias("delta_mass"),
    )
