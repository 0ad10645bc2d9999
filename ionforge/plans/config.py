"""The search's parameters."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class SearchConfig:
    """One field per key of the YAML file; keys that steer hardware only are ignored.

    ``n_buckets_narrow`` sets the width of the mass cells by which the narrow
    search joins; it changes the plan and no result.
    """

    fasta: str = ""
    raws: str = ""
    results_dir: str = "results"
    max_n_peaks: int = 100
    normalization_method: str = "L2"
    db_peptide_minimum_length: int = 7
    db_peptide_maximum_length: int = 42
    max_missed_cleavages: int = 1
    enzyme: str = "trypsin"
    semi_specific_cleavage: bool = False
    k: int = 50
    min_peptide_mass: float = 500.0
    max_peptide_mass: float = 5000.0
    n_buckets_narrow: int = 2250
    n_buckets_open: int = 12
    fdr: float = 0.01
    max_n_fragments: int = 200
    tolerance_dalton: float = 0.01
    min_matching_peaks: int = 4
    min_delta_mass: float = -150.0
    max_delta_mass: float = 500.0
    min_charge: int = 2
    max_charge: int = 5
    peptide_maximum_length: int = 42
    max_database_size: int = 100_000_000
    #: Without it the narrow search alone gives candidates, k of them.
    open_search: bool = True

    @classmethod
    def from_mapping(cls, values: dict) -> SearchConfig:
        known = {f.name: f.type for f in fields(cls)}
        given = {k.lower(): v for k, v in values.items()}
        return cls(**{k: v for k, v in given.items() if k in known})

    @classmethod
    def from_yaml(cls, path: str | None = None, variable: str = "SEARCH_CONFIG") -> SearchConfig:
        """Read a file; without a path, the one that the environment variable names."""
        import yaml

        with open(path or os.environ[variable], encoding="utf-8") as f:
            return cls.from_mapping(yaml.safe_load(f) or {})

    def __post_init__(self) -> None:
        if self.db_peptide_maximum_length > self.peptide_maximum_length:
            raise ValueError("db_peptide_maximum_length exceeds peptide_maximum_length, to which peptides are padded")
        if self.n_buckets_narrow < 1 or self.max_n_fragments < 1 or self.k < 1:
            raise ValueError("n_buckets_narrow, max_n_fragments and k are at least 1")

    @property
    def narrow_radius(self) -> float:
        """The width of a mass cell of the narrow search; it must exceed 2, the largest distance of unit vectors."""
        return max(2.5, (self.max_peptide_mass - self.min_peptide_mass) / self.n_buckets_narrow)

    def inputs(self, spark: SparkSession | None = None) -> tuple[str | None, list[str]]:
        """The first FASTA file, by name, and all spectra files, in any store that Spark reads."""
        spark = spark or SparkSession.builder.getOrCreate()
        fasta = files(spark, self.fasta)
        return (fasta[0] if fasta else None), files(spark, self.raws)


def files(spark: SparkSession, pattern: str) -> list[str]:
    """The sorted paths that a pattern names."""
    if not pattern:
        return []
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or [])
