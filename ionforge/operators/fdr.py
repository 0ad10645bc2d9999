"""Target-decoy false discovery rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of scores over which running sums are computed side by side.
RANGES = 64


def transform_score(score: Column) -> Column:
    """-ln(score + 1): infinite at -1 and NaN below."""
    return (
        F.when(score > -1, -F.log1p(score))
        .when(score == -1, F.lit(float("inf")))
        .when(score.isNotNull(), F.lit(float("nan")))
    )


def within_delta(df: DataFrame, low: float = -150.0, high: float = 500.0, column: str = "delta_mass") -> DataFrame:
    return df.filter((F.col(column) > low) & (F.col(column) < high))


def q_values(psms: DataFrame, score: str = "score", decoy: str = "is_decoy", ranges: int = RANGES) -> DataFrame:
    """(score, n_target, n_decoy, q) for each distinct score; lower scores are better.

    Rows are summed up by score first.  Scores are then dealt into ranges at
    approximate quantiles; running sums and least values are taken within each
    range, and offsets from the other ranges, a table of ``ranges`` rows, are
    added.  So no task sorts all scores.
    """
    by = psms.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(decoy), 0).otherwise(1)).cast("long").alias("n_target"),
        F.sum(F.when(F.col(decoy), 1).otherwise(0)).cast("long").alias("n_decoy"),
    )
    cuts = by.filter(~F.isnan("score") if dict(by.dtypes)["score"] in ("double", "float") else F.lit(True)).agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    bin_ = F.lit(0)
    for c in cuts:
        bin_ = bin_ + (F.col("score") > F.lit(c)).cast("int")
    by = by.withColumn("bin", bin_)
    sums = by.groupBy("bin").agg(F.sum("n_target").alias("t"), F.sum("n_decoy").alias("d"))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("bin", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"))
    up = Window.partitionBy("bin").orderBy("score").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # rows beyond the last: the table has at most one row per range
    f = by.join(F.broadcast(offsets), "bin")
    f = f.withColumn("ct", F.sum("n_target").over(up) + F.col("t0")).withColumn("cd", F.sum("n_decoy").over(up) + F.col("d0"))
    f = f.withColumn("f", F.coalesce(F.try_divide(F.col("cd").cast("double"), F.col("ct").cast("double")), F.lit(float("inf"))))
    later = Window.orderBy("bin").rowsBetween(1, Window.unboundedFollowing)
    best = f.groupBy("bin").agg(F.min("f").alias("least")).select("bin", F.coalesce(F.min("least").over(later), F.lit(float("inf"))).alias("later"))
    down = Window.partitionBy("bin").orderBy("score").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    f = f.withColumn("own", F.min("f").over(down)).join(F.broadcast(best), "bin")
    return f.select("score", "n_target", "n_decoy", F.least("own", "later").alias("q"))


def with_q(psms: DataFrame, score: str = "score", decoy: str = "is_decoy") -> DataFrame:
    q = q_values(psms, score, decoy).select(F.col("score").alias("__score"), "q")
    return psms.join(q, psms[score] == q["__score"]).drop("__score")


def filter_fdr(psms: DataFrame, level: float = 0.01, score: str = "score", decoy: str = "is_decoy", remove_decoys: bool = True) -> DataFrame:
    kept = with_q(psms, score, decoy).filter(F.col("q") <= level)
    return kept.filter(~F.col(decoy)) if remove_decoys else kept


def with_accessions(psms: DataFrame, protein_map: DataFrame, peptide: str = "best_peptide") -> DataFrame:
    """Adds the accessions of each peptide; a peptide without any raises."""
    m = protein_map.select(F.col("peptide").alias("__peptide"), "accessions")
    joined = psms.join(m, psms[peptide] == m["__peptide"], "left").drop("__peptide")
    missing = F.raise_error(F.concat(F.lit("no protein has "), F.col(peptide))).cast("array<string>")
    return joined.withColumn("accession", F.coalesce("accessions", missing)).drop("accessions")
