"""Enzymatic digestion, decoys and the peptide-to-protein map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import ODD_RESIDUES, enzyme_rule

DECOY_PREFIX = "DECOY_"


def accession(header: Column) -> Column:
    """The first word of a header."""
    return F.element_at(F.split(F.trim(header), r"\s+"), 1)


def parse_header(header: Column, kind: str = "generic") -> Column:
    """(species, protein) of a FASTA header in one of three conventions."""
    if kind == "generic":
        species, protein = F.lit(None).cast("string"), header
    elif kind == "uniprot":
        species = F.nullif(F.regexp_extract(header, r"OS=(.*?)\s*OX=", 1), F.lit(""))
        protein = F.trim(F.split(F.get(F.split(header, r"\|"), F.lit(2)), "OX=")[0])
    elif kind == "ncbi":
        species = F.nullif(F.regexp_extract(header, r"\[(.*)\]", 1), F.lit(""))
        protein = F.trim(F.regexp_extract(header, r"^\S+\s+([^\[]*)", 1))
    else:
        raise ValueError("generic, uniprot or ncbi")
    return F.struct(species.alias("species"), protein.alias("protein"))


def fragments(sequence: Column, enzyme: str = "trypsin") -> Column:
    """The pieces between cuts, in order; nothing for an empty sequence."""
    return F.filter(F.split(sequence, enzyme_rule(enzyme)), lambda x: x != "")


def _runs(f: Column, n: Column, k: int) -> Column:
    """Each run of ``k`` + 1 pieces, joined."""
    if k == 0:
        return f
    if k < 4:
        joined = F.transform(F.sequence(F.lit(1), n - k), lambda i: F.concat(*(F.element_at(f, i + j) for j in range(k + 1))))
    else:
        joined = F.transform(F.sequence(F.lit(1), n - k), lambda i: F.array_join(F.slice(f, i, k + 1), ""))
    return F.when(n > k, joined).otherwise(F.array().cast("array<string>"))


def digest(
    proteins: DataFrame,
    enzyme: str = "trypsin",
    missed: int = 1,
    min_length: int = 7,
    max_length: int = 42,
    semi: bool = False,
) -> DataFrame:
    """(accession, peptide), distinct: runs of up to ``missed`` + 1 pieces.

    With ``semi`` every prefix and suffix of such a run counts as well.
    Peptides are of a length within the bounds and without odd residues.  The
    set per protein is built within its row; nothing is shuffled, but with
    ``semi`` the proteins are, by accession, as they are less than their ends.
    """
    if semi:
        proteins = proteins.repartition("accession")
    pieces = proteins.select("accession", fragments(F.col("sequence"), enzyme).alias("f"))
    n = F.size("f")
    runs = F.flatten(F.array(*(_runs(F.col("f"), n, k) for k in range(missed + 1))))
    peptides = pieces.select("accession", F.explode(F.array_distinct(runs)).alias("peptide"))
    if semi:
        top = F.least(F.lit(max_length), F.length("peptide"))
        sizes = F.when(top >= min_length, F.sequence(F.lit(min_length), top)).otherwise(F.array().cast("array<int>"))
        both = F.concat(
            F.transform(sizes, lambda k: F.substring(F.col("peptide"), F.lit(1), k)),
            F.transform(sizes, lambda k: F.substring(F.col("peptide"), F.length("peptide") - k + 1, k)),
        )
        peptides = peptides.select("accession", F.explode(F.array_distinct(both)).alias("peptide")).distinct()
    return peptides.filter(F.length("peptide").between(min_length, max_length) & ~F.col("peptide").rlike(f"[{ODD_RESIDUES}]"))


def protein_map(peptides: DataFrame) -> DataFrame:
    """(peptide, accessions), the accessions sorted.

    A peptide's list is one value, as the result demands, and as long as the
    proteins that hold it; for a table of many proteins with one peptide in
    common keep :func:`digest`'s rows (peptide, accession) instead.
    """
    return peptides.groupBy("peptide").agg(F.sort_array(F.collect_set("accession")).alias("accessions"))


def reverse_proteins(proteins: DataFrame, prefix: str = DECOY_PREFIX) -> DataFrame:
    """Decoys: each protein read backwards."""
    return proteins.select(F.concat(F.lit(prefix), "accession").alias("accession"), F.reverse("sequence").alias("sequence"))


def sanitise(decoys: DataFrame, targets: DataFrame) -> DataFrame:
    """The distinct decoy peptides that are not target peptides."""
    return decoys.select("peptide").subtract(targets.select("peptide"))


def shared(decoys: DataFrame, targets: DataFrame) -> DataFrame:
    """The peptides that both have."""
    return targets.select("peptide").intersect(decoys.select("peptide"))


def search_database(targets: DataFrame, decoys: DataFrame) -> DataFrame:
    """(peptide, is_decoy): distinct targets, and the decoys that are not targets."""
    t = targets.select("peptide").distinct().withColumn("is_decoy", F.lit(False))
    return t.unionByName(sanitise(decoys, targets).withColumn("is_decoy", F.lit(True)))


def check_size(peptides: DataFrame, most: int = 100_000_000) -> DataFrame:
    """The same peptides; fails, rather than cutting, if there are more than ``most``."""
    n = peptides.count()
    if n > most:
        raise ValueError(f"{n} peptides; at most {most} are allowed")
    return peptides
