"""Result tables: one folder, a partition per raw file; the peptide database by mass or by bucket; exports."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a row group of a table sorted by mass, and of a file of it, about.
GROUP_ROWS, FILE_ROWS = 20_000, 1_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, which driver and executors share; on a local master without one, in a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ionforge-scratch-")
    return f"{at.rstrip('/')}/ionforge-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def put(df: DataFrame, path: str) -> None:
    """Write results; a raw file's earlier results are replaced, other files' stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("raw_file").parquet(path)


def get(spark: SparkSession, path: str, raw_files: list[str] | None = None) -> DataFrame:
    """All results, or those of some raw files, whose partitions alone are read."""
    df = spark.read.option("basePath", path).parquet(path)
    return df if raw_files is None else df.filter(df["raw_file"].isin(raw_files))


def write_pin(df: DataFrame, path: str) -> None:
    """Tab-separated files with headers, a folder per raw file."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).partitionBy("raw_file").csv(path)


def read_pin(spark: SparkSession, path: str) -> DataFrame:
    """The rows of :func:`write_pin`, as text."""
    return spark.read.option("sep", "\t").option("header", True).option("basePath", path).csv(path)


def write_fasta(proteins: DataFrame, path: str, width: int = 60) -> None:
    """(header, sequence) as FASTA text, sequences in lines of ``width`` letters."""
    lines = F.rtrim(F.regexp_replace("sequence", f"(.{{1,{width}}})", "$1\n"), F.lit("\n"))
    proteins.select(F.concat(F.lit(">"), "header", F.lit("\n"), lines).alias("value")).write.mode("overwrite").text(path)


def write_mgf(spectra: DataFrame, path: str) -> None:
    """(scan, precursorMZ, charge, peaks) as MGF text; a null charge or m/z is left out."""
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}="), c.cast("string"), F.lit("\n"))).otherwise("")
    peaks = F.array_join(F.transform("peaks", lambda p: F.concat_ws(" ", p.mz.cast("string"), p.intensity.cast("string"))), "\n")
    spectra.select(F.concat(F.lit("BEGIN IONS\n"), line("SCANS", F.col("scan")), line("PEPMASS", F.col("precursorMZ")), line("CHARGE", F.col("charge")), peaks, F.lit("\nEND IONS")).alias("value")).write.mode("overwrite").text(path)


def write_by_mass(db: DataFrame, path: str, mass: str = "mass", group_rows: int = GROUP_ROWS, file_rows: int = FILE_ROWS) -> None:
    """The database in files of mass ranges, sorted by mass, in row groups of about ``group_rows`` rows.

    A search of a mass window then reads the few row groups whose least and
    greatest mass admit it.  Rows without a mass stand in the first file.
    """
    files = max(1, -(-db.count() // file_rows))
    ordered = db.repartitionByRange(files, mass).sortWithinPartitions(mass)
    # Parquet ends a row group by its bytes, which it looks at every so many rows; one byte is always exceeded
    options = {"parquet.block.size": 1, "parquet.page.row.count.limit": group_rows, "parquet.block.size.row.check.min": group_rows, "parquet.block.size.row.check.max": group_rows, "parquet.page.size.row.check.min": group_rows, "parquet.page.size.row.check.max": group_rows}
    ordered.write.mode("overwrite").options(**options).parquet(path)


def mass_window(spark: SparkSession, path: str, low: float, high: float, mass: str = "mass") -> DataFrame:
    """The rows of :func:`write_by_mass` with a mass within the bounds, both included."""
    return spark.read.parquet(path).filter(F.col(mass).between(low, high))


def write_members(db: DataFrame, path: str, bucket: str = "bucket") -> None:
    """The rows of each bucket in a folder of its own: its members, whatever their number, without a list."""
    db.write.mode("overwrite").partitionBy(bucket).parquet(path)


def members(spark: SparkSession, path: str, wanted: DataFrame, bucket: str = "bucket") -> DataFrame:
    """The rows of the buckets that ``wanted`` names, each once; the other buckets' folders are not read.

    There are at most 256 buckets, so the distinct ones are broadcast, and the
    folders are chosen while the query runs, when they are known.
    """
    return spark.read.parquet(path).join(F.broadcast(wanted.select(bucket).distinct()), bucket, "left_semi")


def write_map(df: DataFrame, path: str) -> None:
    """The peptide-to-protein map as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("peptide string, accessions array<string>").json(path)
