"""MGF spectra as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_mgf(spark: SparkSession, path: str) -> DataFrame:
    """(raw_file, index, scan, precursorMZ, charge, peaks) of every spectrum.

    ``index`` counts a file's spectra from 1 in their order, by the position of
    their end markers: within each block that the reader takes, in order, and
    behind the spectra of the file's blocks before, which are counted first.  A
    spectrum without m/z or charge has nulls there.
    """
    raw = spark.read.text(path, lineSep="END IONS").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    raw = raw.filter(F.col("value").contains("BEGIN IONS"))
    counts = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("path", "block", F.coalesce(earlier, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("path", "block").orderBy("at"))
    raw = raw.withColumn("own", own).join(F.broadcast(before), ["path", "block"]).withColumn("index", (F.col("before") + F.col("own")).cast("int"))

    return parse(raw).select(F.regexp_replace("file", r"\.[^.]*$", "").alias("raw_file"), "index", "scan", "precursorMZ", "charge", "peaks")


def parse(raw: DataFrame) -> DataFrame:
    """Adds scan, precursorMZ, charge and peaks to rows with a spectrum's text as ``value``."""

    def field(name: str):
        return F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^\s*{name}=(.*)$", 1)), F.lit(""))

    lines = F.filter(F.split(F.regexp_replace("value", "\r", ""), "\n"), lambda x: x.rlike(r"^\s*[0-9]"))
    peaks = F.transform(lines, lambda x: F.split(F.trim(x), r"\s+"))
    peaks = F.transform(peaks, lambda p: F.struct(p[0].cast("double").alias("mz"), F.coalesce(F.get(p, F.lit(1)).cast("double"), F.lit(0.0)).alias("intensity")))
    title = F.element_at(F.split(field("TITLE"), r"\."), -1)
    return raw.withColumns(
        {
            "scan": F.coalesce(field("SCANS").try_cast("int"), title.try_cast("int")),
            "precursorMZ": F.regexp_extract(field("PEPMASS"), r"^(\S+)", 1).try_cast("double"),
            "charge": F.regexp_extract(field("CHARGE"), r"(\d+)", 1).try_cast("int"),
            "peaks": peaks,
        }
    )
