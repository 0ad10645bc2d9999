"""Peptides as padded strings and residue ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import ALPHABET, PAD


def pad_peptide(peptide: Column, width: int) -> Column:
    """Pad to the right; a longer peptide stays as it is."""
    return F.when(F.length(peptide) >= width, peptide).otherwise(F.rpad(peptide, width, PAD))


def residue_ids(peptide: Column) -> Column:
    """Each letter's place in the alphabet; an unknown letter raises."""
    known = F.transform(
        F.filter(F.split(peptide, ""), lambda c: c != ""),
        lambda c: F.instr(F.lit(ALPHABET), c) - 1,
    )
    return F.when(F.exists(known, lambda i: i < 0), F.raise_error(F.concat(F.lit("unknown residue in "), peptide))).otherwise(known)
