"""Readers, writers, configuration and the search from files to identifications."""

import gzip

import pytest
from pyspark.sql import functions as F

from ionforge.functions import chemistry
from ionforge.plans import pipeline
from ionforge.plans.config import SearchConfig
from ionforge.sources import fasta, mgf, store
from ionforge.streaming import search_stream

FASTA = ">P1 first protein\nMKAA\nRPK\n>P2\nACDEFGHK\n\n>P3 empty\n"
MGF = """BEGIN IONS
TITLE=f.7
PEPMASS=500.25 1000
CHARGE=2+
100.5 10
200.5 0.5

END IONS
BEGIN IONS
TITLE=f.x
SCANS=9
PEPMASS=400
100 1
END IONS
"""


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(FASTA)
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(FASTA.replace("\n", "\r\n"))
    for name in ("a.fasta", "b.fasta.gz"):
        got = [(r.accession, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / name)).collect()]
        assert sorted(got) == [("P1", "MKAARPK"), ("P2", "ACDEFGHK"), ("P3", "")]
    d = {r.accession: r.sequence for r in fasta.read_decoys(spark, str(tmp_path / "a.fasta")).collect()}
    assert d["DECOY_P1"] == "KPRAAKM"


def test_mgf(spark, tmp_path):
    (tmp_path / "run1.mgf").write_text(MGF)
    a, b = sorted(mgf.read_mgf(spark, str(tmp_path / "run1.mgf")).collect(), key=lambda r: r["index"])
    assert (a.raw_file, a["index"], a.scan, a.precursorMZ, a.charge) == ("run1", 1, 7, 500.25, 2)
    assert [(p.mz, p.intensity) for p in a.peaks] == [(100.5, 10), (200.5, 0.5)]
    assert (b["index"], b.scan, b.precursorMZ, b.charge) == (2, 9, 400.0, None)


def test_store_replaces_only_its_raw_files(spark, tmp_path):
    p = str(tmp_path / "s")
    store.put(spark.createDataFrame([("a", 1), ("b", 2)], "raw_file string, x int"), p)
    store.put(spark.createDataFrame([("a", 3)], "raw_file string, x int"), p)
    assert sorted((r.raw_file, r.x) for r in store.get(spark, p).collect()) == [("a", 3), ("b", 2)]
    assert store.get(spark, p, ["b"]).count() == 1


def test_map_and_pin_files(spark, tmp_path):
    m = spark.createDataFrame([("AK", ["P1", "P2"])], "peptide string, accessions array<string>")
    store.write_map(m, str(tmp_path / "m"))
    assert store.read_map(spark, str(tmp_path / "m")).collect() == m.collect()
    store.write_pin(spark.createDataFrame([("r", 1, "X.A.X")], "raw_file string, Label int, Peptide string"), str(tmp_path / "pin"))
    text = next((tmp_path / "pin" / "raw_file=r").glob("*.csv")).read_text()
    assert text == "Label\tPeptide\n1\tX.A.X\n"


def test_config(tmp_path, monkeypatch):
    (tmp_path / "c.yaml").write_text("K: 7\nFDR: 0.05\nENZYME: trypsin\nGPU: 0\nFASTA: %s/*.fasta\n" % tmp_path)
    (tmp_path / "b.fasta").write_text("")
    (tmp_path / "a.fasta").write_text("")
    c = SearchConfig.from_yaml(str(tmp_path / "c.yaml"))
    assert (c.k, c.fdr, c.max_n_peaks) == (7, 0.05, 100)
    assert c.inputs()[0].endswith("a.fasta")
    monkeypatch.setenv("SEARCH_CONFIG", str(tmp_path / "c.yaml"))
    assert SearchConfig.from_yaml() == c


def _write_inputs(spark, folder):
    """Proteins, and spectra of some of their peptides; one in three carries a shift."""
    import random

    rng = random.Random(4)
    seqs = ["".join(rng.choice("ACDEFGHILMNPQSTVWY") + ("K" if k % 11 == 10 else "") for k in range(120)) for _ in range(15)]
    (folder / "p.fasta").write_text("".join(f">Q{i} x\n{s}\n" for i, s in enumerate(seqs)))
    config = SearchConfig(fasta=f"{folder}/p.fasta", raws=f"{folder}/*.mgf", results_dir=f"{folder}/out", k=10, fdr=0.05)
    db, _ = pipeline.build_database(fasta.read_fasta(spark, config.fasta), config)
    rows = db.filter("not is_decoy and mass between 800 and 3500").withColumn("ions", chemistry.fragment_ions(F.col("peptide"), F.lit(2))).orderBy("peptide").limit(60).collect()
    truth, text = {}, []
    for i, r in enumerate(rows):
        shift = 15.9949 if i % 3 == 0 else 0.0
        mz = (r.mass + shift) / 2 + 1.00782503207
        truth[i + 1] = r.peptide
        text.append(f"BEGIN IONS\nTITLE=s.{i + 1}\nPEPMASS={mz:.6f}\nCHARGE=2+\n" + "".join(f"{m:.6f} 1.0\n" for m in r.ions) + "END IONS\n")
    (folder / "run.mgf").write_text("".join(text))
    return config, truth


def test_whole_search_recovers_synthetic_spectra(spark, tmp_path):
    config, truth = _write_inputs(spark, tmp_path)
    got = {r["index"]: r for r in pipeline.run(spark, config).collect()}
    same = lambda a, b: a.replace("I", "L") == b.replace("I", "L")
    right = sum(same(got[i].best_peptide, p) for i, p in truth.items() if i in got)
    assert right >= 0.9 * len(truth)
    assert all(g.accession for g in got.values())
    shifted = [g.delta_mass for i, g in got.items() if (i - 1) % 3 == 0 and same(g.best_peptide, truth[i])]
    assert shifted and all(abs(d - 15.9949) < 0.01 for d in shifted)


def test_stream_of_spectra(spark, tmp_path):
    config, truth = _write_inputs(spark, tmp_path)
    db, _ = pipeline.build_database(fasta.read_fasta(spark, config.fasta), config)
    spectra = mgf.read_mgf(spark, config.raws)
    spectra.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spectra.schema).parquet(str(tmp_path / "in"))
    q = search_stream.start(stream, db, config, str(tmp_path / "scored"), str(tmp_path / "cp"))
    q.awaitTermination(300)
    assert q.exception() is None
    assert store.get(spark, str(tmp_path / "scored")).count() == len(truth)


def test_unknown_values_are_dropped(spark):
    df = spark.createDataFrame([("r", 1, 1, None, 2, [(1.0, 1.0)]), ("r", 2, 2, 500.0, None, [(1.0, 1.0)]), ("r", 3, 3, 500.0, 2, [(1.0, 0.0)]), ("r", 4, 4, 500.0, 2, [(1.0, 2.0)])], "raw_file string, index int, scan int, precursorMZ double, charge int, peaks array<struct<mz:double,intensity:double>>")
    assert [r["index"] for r in pipeline.prepare_spectra(df, SearchConfig()).collect()] == [4]


@pytest.mark.parametrize("bad", [{"K": 5}, {"k": 5, "UNKNOWN": 1}])
def test_mapping(bad):
    assert SearchConfig.from_mapping(bad).k == 5


def test_usi(spark, tmp_path):
    import json

    from ionforge.sources import usi

    for k, name in enumerate(["mzspec:PXD1:run:scan:7:PEPT[Oxidation]IDE/2", "mzspec:PXD1:run:scan:8:ACDK/3", "mzspec:PXD1:run:scan:9"]):
        (tmp_path / f"{k}.json").write_text(json.dumps({"usi": name, "mzs": [1.5, 2.5], "intensities": [3, 4], "precursorMZ": 500.5}, indent=1))
    got = {r.usi: r for r in usi.read_usi(spark, str(tmp_path)).collect()}
    r = got["mzspec:PXD1:run:scan:7:PEPT[Oxidation]IDE/2"]
    assert (r.peptide, r.modification, r.charge, r.precursorMZ) == ("PEPTIDE", "Oxidation", 2, 500.5)
    assert [(p.mz, p.intensity) for p in r.peaks] == [(1.5, 3), (2.5, 4)]
    assert got["mzspec:PXD1:run:scan:8:ACDK/3"].modification == "unmod."
    assert got["mzspec:PXD1:run:scan:9"].charge is None
