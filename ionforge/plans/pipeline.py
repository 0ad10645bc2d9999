"""The whole search: database, search, rescoring, filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import buckets, chemistry, peaks
from ..operators import digest, embed, fdr, knn, match, towers
from ..sources import fasta, mgf, store
from .config import SearchConfig


#: Pairs of spectra and peptides from which the open search goes by pivots.
PIVOT_PAIRS = 10**10


def build_database(proteins: DataFrame, config: SearchConfig, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(peptide, is_decoy, mass) of targets and sanitised decoys, and the target map; ``check`` counts the targets first."""
    how = dict(
        enzyme=config.enzyme,
        missed=config.max_missed_cleavages,
        min_length=config.db_peptide_minimum_length,
        max_length=config.db_peptide_maximum_length,
        semi=config.semi_specific_cleavage,
    )
    targets = digest.digest(proteins, **how)
    decoys = digest.digest(digest.reverse_proteins(proteins), **how)
    if check:
        digest.check_size(targets.select("peptide").distinct(), config.max_database_size)
    db = digest.search_database(targets, decoys).withColumn("mass", chemistry.peptide_mass(F.col("peptide")))
    return db.filter("mass is not null"), digest.protein_map(targets)


def prepare_spectra(spectra: DataFrame, config: SearchConfig) -> DataFrame:
    """Spectra with a mass and charge within bounds, peaks normalised and trimmed; those without m/z, charge or intensity go."""
    mass = chemistry.precursor_mass(F.col("precursorMZ"), F.col("charge"))
    df = spectra.withColumn("pepmass", mass).filter(F.col("pepmass").between(config.min_peptide_mass, config.max_peptide_mass) & F.col("charge").between(config.min_charge, config.max_charge))
    # a filter on null peaks would compute them once more, and so would each of their uses
    zipped = F.transform(F.array("peaks"), lambda ps: peaks.zip_peaks(F.transform(ps, lambda p: p.mz), peaks.normalise(F.transform(ps, lambda p: p.intensity), config.normalization_method)))
    cut = F.filter(F.transform(zipped, lambda ps: peaks.trim(ps, config.max_n_peaks)), lambda ps: ps.isNotNull())
    return df.withColumn("peaks", F.explode(cut)).withColumn("spec_id", F.xxhash64("raw_file", "index"))


def search(spectra: DataFrame, db: DataFrame, config: SearchConfig, embedder: embed.Embedder | None = None) -> DataFrame:
    """Each spectrum (spec_id) with its up to 2k candidates, or k without the open search, as rows (spec_id, pos, peptide, distance, is_decoy).

    Embeddings are used by both searches, so they are persisted (and computed
    anew where an executor is lost).
    """
    queries, vectors, found = _narrow(spectra, db, config, embedder)
    if config.open_search:
        found = knn.hybrid(found, _open(queries, vectors, config), config.k)
    return _named(found, vectors)


def _narrow(spectra: DataFrame, db: DataFrame, config: SearchConfig, embedder: embed.Embedder | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries and database rows as they are compared, both persisted, and what the narrow search finds."""
    embedder = embedder or embed.HashEmbedder()
    fitted = buckets.fit_uniform(db, "mass", config.n_buckets_open)
    within = db.filter(F.col("mass").between(config.min_peptide_mass, config.max_peptide_mass))
    vectors = embedder.peptides(within).select(F.xxhash64("peptide", "is_decoy").alias("id"), "peptide", "embedding", "mass", fitted.ordinal(F.col("mass")).alias("bucket"), "is_decoy").persist()
    queries = embedder.spectra(spectra).select(F.col("spec_id").alias("id"), "embedding", F.col("pepmass").alias("mass"), fitted.ordinal(F.col("pepmass")).alias("bucket")).persist()
    if getattr(embedder, "unit_length", False):
        return queries, vectors, knn.knn_narrow_pruned(queries, vectors, config.k, config.narrow_radius)
    return queries, vectors, knn.knn(queries, vectors, config.k, "narrow")


def _open(queries: DataFrame, vectors: DataFrame, config: SearchConfig) -> DataFrame:
    # with few pairs the table of pivots costs more than it saves
    many = queries.count() * vectors.count() > PIVOT_PAIRS
    return knn.knn_open_pivots(queries, vectors, config.k) if many else knn.knn(queries, vectors, config.k, "open")


def _named(found: DataFrame, vectors: DataFrame) -> DataFrame:
    names = vectors.select(F.col("id").alias("db_id"), "peptide")
    return found.join(names, "db_id").select(F.col("query_id").alias("spec_id"), "pos", "peptide", "distance", "is_decoy")


def rescore(spectra: DataFrame, candidates: DataFrame, config: SearchConfig) -> DataFrame:
    """The best candidate of each spectrum, with masses."""
    return _best(spectra, _scored(spectra, candidates, config))


def _scored(spectra: DataFrame, candidates: DataFrame, config: SearchConfig) -> DataFrame:
    return match.score_candidates(spectra.select("spec_id", "charge", "peaks"), candidates, config.tolerance_dalton, config.min_matching_peaks, config.max_n_peaks, config.max_n_fragments)


def _best(spectra: DataFrame, scored: DataFrame) -> DataFrame:
    best = match.best_per_spectrum(scored).select("spec_id", F.col("is_decoy").alias("best_is_decoy"), F.col("distance").alias("best_distance"), F.col("score").alias("best_score"), F.col("peptide").alias("best_peptide"))
    out = spectra.join(best, "spec_id").withColumn("peptide_mass", chemistry.peptide_mass(F.col("best_peptide")))
    return out.withColumn("delta_mass", F.col("pepmass") - F.col("peptide_mass"))


def search_best(spectra: DataFrame, db: DataFrame, config: SearchConfig, embedder: embed.Embedder | None = None) -> DataFrame:
    """As :func:`rescore` of :func:`search` has it, without ``best_distance``; the open search is left out where it cannot change the best candidate.

    No score exceeds that of a candidate which matches every peak.  Where the
    whole database has one such peptide (``match.complete_candidates``) and the
    narrow search has found it, it is the best, whatever the open search would
    add, and no other candidate is scored.  All other spectra are searched openly,
    against all rows, and all their candidates are scored.
    """
    queries, vectors, found = _narrow(spectra, db, config, embedder)
    if not config.open_search:
        return _best(spectra, _scored(spectra, _named(found, vectors), config)).drop("best_distance")
    found = found.persist()
    # a score grows with matches where there are more than the least, no intensity is negative, and some are more than 0
    whole = F.size("peaks")
    sound = spectra.filter((whole > config.min_matching_peaks) & (whole <= config.max_n_peaks) & F.forall("peaks", lambda p: p.intensity >= 0) & F.exists("peaks", lambda p: p.intensity > 0))
    complete = match.complete_candidates(sound, vectors.select("peptide"), config.tolerance_dalton, config.max_n_fragments)
    only = complete.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n"), F.first("peptide").alias("peptide")).filter("n = 1")
    ids = (F.xxhash64("peptide", F.lit(decoy)) for decoy in (False, True))  # as _narrow has them
    settled = found.join(only.select(F.col("spec_id").alias("query_id"), "peptide"), "query_id").filter(F.col("db_id").isin(*ids))
    settled = settled.select(F.col("query_id").alias("spec_id"), "pos", "peptide", "distance", "is_decoy").persist()
    rest = queries.join(settled.select(F.col("spec_id").alias("id")), "id", "left_anti").persist()
    near = found.join(rest.select(F.col("id").alias("query_id")), "query_id", "left_semi")
    more = _open(rest, vectors, config).withColumn("pos", F.col("pos") + config.k)
    scored = _scored(spectra, settled.unionByName(_named(near.unionByName(more.select(*near.columns)), vectors)), config)
    return _best(spectra, scored).drop("best_distance")


def accept(scored: DataFrame, protein_map: DataFrame, config: SearchConfig) -> DataFrame:
    """Targets at the FDR, best first, with accessions; best_score is transformed."""
    df = fdr.within_delta(scored, config.min_delta_mass, config.max_delta_mass)
    df = df.withColumn("best_score", fdr.transform_score(F.col("best_score")))
    kept = fdr.filter_fdr(df, config.fdr, "best_score", "best_is_decoy")
    return fdr.with_accessions(kept, protein_map).orderBy("best_score")


def fitted_embedder(spark: SparkSession, config: SearchConfig) -> towers.LinearTowers:
    """Towers fitted to the identifications that an earlier :func:`run` accepted."""
    accepted = spark.read.parquet(f"{config.results_dir}/search_results_scored_filtered")
    return towers.LinearTowers.fit(accepted.select(F.col("best_peptide").alias("peptide"), "peaks"))


def run(spark: SparkSession, config: SearchConfig, embedder: embed.Embedder | None = None) -> DataFrame:
    """From files to accepted identifications; each stage is written to the results folder."""
    fasta_path, raws = config.inputs(spark)
    proteins = fasta.read_fasta(spark, fasta_path)
    db, protein_map = build_database(proteins, config, check=False)
    out = config.results_dir
    db.write.mode("overwrite").parquet(f"{out}/db")
    protein_map.write.mode("overwrite").parquet(f"{out}/map")
    db, protein_map = spark.read.parquet(f"{out}/db"), spark.read.parquet(f"{out}/map")
    digest.check_size(db.filter("not is_decoy"), config.max_database_size)
    store.put(prepare_spectra(mgf.read_mgf(spark, raws), config), f"{out}/spectra")
    spectra = store.get(spark, f"{out}/spectra")
    search(spectra, db, config, embedder).write.mode("overwrite").parquet(f"{out}/candidates")
    store.put(rescore(spectra, spark.read.parquet(f"{out}/candidates"), config), f"{out}/search_results_scored")
    accepted = accept(store.get(spark, f"{out}/search_results_scored"), protein_map, config)
    accepted.write.mode("overwrite").parquet(f"{out}/search_results_scored_filtered")
    return spark.read.parquet(f"{out}/search_results_scored_filtered").orderBy("best_score")
