"""Reports: rescoring tables, the inspection view, delta-mass profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARGES = (2, 3, 4, 5)
#: The columns of the inspection view.
INSPECTED = ["raw_file", "scan", "index", "precursorMZ", "pepmass", "charge", "best_is_decoy", "best_distance", "best_score", "best_peptide", "peptide_mass", "delta_mass", "accession"]


def charge_columns(df: DataFrame, charges: tuple[int, ...] = CHARGES) -> DataFrame:
    return df.withColumns({f"charge{z}": (F.col("charge") == z).cast("int") for z in charges})


def pin(scored: DataFrame, charges: tuple[int, ...] = CHARGES, neutral_mass: bool = False, proteins: str | None = None) -> DataFrame:
    """The table an external rescorer reads; ExpMass is the precursor m/z unless ``neutral_mass``."""
    df = charge_columns(scored, charges)
    return df.select(
        "raw_file",
        F.concat_ws("_", "raw_file", "index", "index", "charge").alias("SpecId"),
        F.when(F.col("best_is_decoy"), -1).otherwise(1).alias("Label"),
        F.col("scan").alias("ScanNr"),
        F.col("pepmass" if neutral_mass else "precursorMZ").alias("ExpMass"),
        F.lit(1).alias("rank"),
        "best_score",
        "best_distance",
        "pepmass",
        "delta_mass",
        F.length("best_peptide").alias("peptide_length"),
        *(f"charge{z}" for z in charges),
        F.concat(F.lit("X."), "best_peptide", F.lit(".X")).alias("Peptide"),
        (F.col(proteins) if proteins else F.lit("PROTEIN_0")).alias("Proteins"),
    )


def inspect(filtered: DataFrame) -> DataFrame:
    return filtered.select(*INSPECTED)


def delta_profile(df: DataFrame, bins: int = 10_000, least: float = 0.1, most: float = 200.0, column: str = "delta_mass", empty: bool = False) -> DataFrame:
    """(bin, center, n): equal-width histogram between the least and greatest delta; the last bin is closed."""
    d = df.select(F.col(column).cast("double").alias("d")).filter((F.abs("d") > least) & (F.abs("d") < most))
    r = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi")).first()
    if r["lo"] is None:
        return df.sparkSession.createDataFrame([], "bin int, center double, n long")
    lo, width = float(r["lo"]), (float(r["hi"]) - float(r["lo"])) / bins
    k = F.lit(0) if width == 0 else F.least(F.lit(bins - 1), F.floor((F.col("d") - lo) / width).cast("int"))
    out = d.groupBy(k.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    if empty:
        out = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(out, "bin", "left").fillna(0, ["n"])
    return out.select("bin", (F.lit(lo) + (F.col("bin") + 0.5) * F.lit(width)).alias("center"), "n")


def top_bins(profile: DataFrame, n: int = 6) -> DataFrame:
    return profile.orderBy(F.desc("n"), F.desc("bin")).limit(n)
