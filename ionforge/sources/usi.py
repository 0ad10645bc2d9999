"""Spectra as JSON documents with a universal spectrum identifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.peaks import zip_peaks

SCHEMA = "usi string, mzs array<double>, intensities array<double>, precursorMZ double"


def read_usi(spark: SparkSession, path: str) -> DataFrame:
    """(usi, peptide, modification, charge, precursorMZ, peaks) of each file below ``path``."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    last = F.element_at(F.split("usi", ":"), -1)
    name = F.regexp_replace(last, r"/\d+$", "")
    return raw.select(
        "usi",
        F.regexp_replace(name, r"\[[^\]]*\]|[^A-Za-z]", "").alias("peptide"),
        modification(name).alias("modification"),
        F.regexp_extract(last, r"/(\d+)$", 1).try_cast("int").alias("charge"),
        "precursorMZ",
        zip_peaks(F.col("mzs"), F.col("intensities")).alias("peaks"),
    )


def modification(name: Column) -> Column:
    """The bracketed modification of a peptide, or ``unmod.``."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"\[([^\]]*)\]", 1), F.lit("")), F.lit("unmod."))
