"""What tasks hold and compute is bounded, and results stay those of the plain ways."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from ionforge.operators import knn


class _Sent:
    def __init__(self, *value):
        self.value = value


def _vectors(n, seed=1):
    v = np.random.default_rng(seed).standard_normal((n, 64))
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _batch(p, side):
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, 64, dtype=np.int32)), pa.array(p.ravel().astype(np.float32)))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(p))), flat, pa.array(side), pa.array(np.zeros(len(p), bool))], ["id", "embedding", "side", "is_decoy"])


@pytest.mark.parametrize("mode", ["narrow", "open"])
def test_a_large_batch_is_searched_in_little_memory(mode):
    p, q = _vectors(10_000), _vectors(2_000, 2)
    side, q_side = (np.random.default_rng(n).integers(0, 12, n).astype(float) for n in (10_000, 2_000))
    b = _batch(p, side)
    tracemalloc.start()
    found = pa.Table.from_batches(list(knn._search(_Sent(np.arange(2_000), q, q_side), 10, mode)([b])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 120 << 20
    p = knn.vectors_of(b.column(1))
    d = knn._distances(q[:200], q_side[:200], p, side, mode)
    want = knn._least(d, np.broadcast_to(np.arange(10_000), d.shape), np.zeros(d.shape, bool), 10)[1]
    assert (found.column("db_id").to_numpy()[:2000].reshape(200, 10) == want).all()


def test_nearer_rows_are_counted_up_to_k():
    p = _vectors(20_000)
    own = np.arange(0, 20_000, 20)
    q = p[own] + 0.3 * np.random.default_rng(3).standard_normal((1_000, 64))
    cut = knn.squared_distances(q, p)[np.arange(1_000), own]
    none = np.zeros(20_000)
    near = knn._Nearer(own, q, none[:1_000], cut, 10)
    for lo in range(0, 20_000, 1_000):
        near.add(np.arange(lo, lo + 1_000), p[lo : lo + 1_000], none[:1_000])
    want = (knn.squared_distances(q, p) < cut[:, None] - 1e-12).sum(1)
    assert 0 < (want < 10).sum() < 1_000
    assert near.left.tolist() == np.flatnonzero(want < 10).tolist()
    assert near.n[near.left].tolist() == want[want < 10].tolist()


def test_own_rows_among_the_nearest(spark):
    p = _vectors(300)
    q = p[::3] + 0.4 * np.random.default_rng(3).standard_normal((100, 64))
    q[1], p[4] = p[3], p[3]  # a row as near as its own, with a higher id
    db = spark.createDataFrame([(i, x.tolist(), 0.0, i % 5, False) for i, x in enumerate(p)], "id long, embedding array<float>, mass double, bucket int, is_decoy boolean")
    asked = spark.createDataFrame([(3 * i, x.tolist(), 0.0, i % 4, False) for i, x in enumerate(q)], db.schema)
    want = {r.query_id for r in knn.knn(asked, db, 3, "open").filter("query_id = db_id").collect()}
    assert 0 < len(want) < 100
    for block in (4096, 2):
        assert {r.query_id for r in knn.among_nearest(asked, db, 3, block).collect()} == want


def test_normalising_computes_its_denominator_once(spark):
    from pyspark.sql import functions as F

    from ionforge.functions import peaks

    e = peaks.normalise(F.col("v"))
    plan = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("v")).select(e.alias("v"))
    assert plan.first().v == [0.6, 0.8]
    many = spark.range(2).select(F.transform(F.sequence(F.lit(1), F.lit(20000)), lambda k: k.cast("double")).alias("v")).repartition(2)
    many.select(F.sum(F.size(e))).collect()
    at = time.time()
    many.select(F.sum(F.size(e)), F.sum(F.element_at(e, 1))).collect()
    assert time.time() - at < 10


def test_ions_of_a_batch_are_those_of_the_expression(spark):
    from pyspark.sql import functions as F

    from ionforge.functions import chemistry
    from ionforge.operators import match

    rows = [("PEPTIDEK", 2), ("MmCCAW", 3), ("A", 1), ("GXG", 2), ("", 2), (None, 1), ("SAMPLER", None), ("AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAK", 3)]
    df = spark.createDataFrame(rows, "peptide string, charge int")
    for limit in (200, 7):
        want = [[x for x in r.i or [] if x is not None] for r in df.select(chemistry.fragment_ions(F.col("peptide"), F.col("charge"), limit).alias("i")).collect()]
        ions, row = match.ions_of(pa.array([p for p, _ in rows]), pa.array([z for _, z in rows], pa.int32()), limit)
        assert [ions[row == i].tolist() for i in range(len(rows))] == want


def test_matched_peaks_are_those_of_the_band_join(spark):
    from pyspark.sql import functions as F

    from ionforge.functions import chemistry
    from ionforge.operators import match

    spectra = spark.createDataFrame([(i, 2, [(100.0 + 37 * j + i, float(j + 1)) for j in range(30)]) for i in range(5)], "spec_id long, charge int, peaks array<struct<mz:double,intensity:double>>")
    c = spark.createDataFrame([(i, p) for i in range(5) for p in ("PEPTIDEK", "SAMPLER", "GG")], "spec_id long, peptide string")
    got = {(r.spec_id, r.peptide, r.n, r.intensity) for r in match.matched_peaks(spectra, c, 2.0).collect()}
    ions = c.select("spec_id", "peptide", F.explode(chemistry.fragment_ions(F.col("peptide"), F.lit(2))).alias("ion"))
    rows = spectra.select("spec_id", F.explode("peaks").alias("p")).select("spec_id", "p.*").join(c, "spec_id")
    hit = match.band_matches(rows, ions, 2.0, ["spec_id", "peptide"]).groupBy("spec_id", "peptide").agg(F.count(F.lit(1)).alias("n"), F.sum("intensity").alias("intensity"))
    assert got == {tuple(r) for r in hit.collect()} and len(got) > 5


def test_semi_specific_ends_are_not_shuffled(spark):
    from ionforge.operators import digest

    p = spark.createDataFrame([("a", "MKAAAAAAAAAAAAAAAR"), ("b", "CCCCCCCCCCCC"), ("a", "AAAAAAAAAAAAAAAR")], "accession string, sequence string")
    d = digest.digest(p, missed=0, min_length=8, max_length=15, semi=True)
    rows = [tuple(r) for r in d.collect()]
    assert len(rows) == len(set(rows)) == 8 + 8 + 5
    assert d.groupBy("accession").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_slice_numbers_few_rows(spark):
    from pyspark.sql import functions as F

    from ionforge.operators import sample

    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("v"), (F.col("id") % 3).alias("w"))
    want = sorted((r.w, r.v) for r in df.collect())
    for lo, hi in ((0, 10), (2400, 2555), (4990, 6000), (7000, 8000)):
        assert sorted((r.w, r.v) for r in sample.row_slice(df, lo, hi, "w", "v").collect()) == want[lo:hi]
    assert sample.numbered(df, "w", "v", places=(2400, 2500)).count() < 500


def test_spectra_are_counted_without_being_parsed(tmp_path, monkeypatch):
    from ionforge.sources import mgf_source

    path = tmp_path / "a.mgf"
    path.write_text("".join(f"BEGIN IONS\nSCANS={i}\nPEPMASS={500 + i}.5\nCHARGE=2+\n100.5 {i}\n200.25\nEND IONS\n" for i in range(2500)))
    whole = [b for s in (10_000, 1 << 30) for r in [mgf_source.MgfReader(f"file://{path}", s)] for p in r.partitions() for b in r.read(p)]
    rows = pa.Table.from_batches(whole).to_pylist()
    assert [r["scan"] for r in rows] == 2 * list(range(2500))
    assert rows[7]["peaks"] == [{"mz": 100.5, "intensity": 7.0}, {"mz": 200.25, "intensity": 0.0}] and rows[7]["precursorMZ"] == 507.5 and rows[7]["charge"] == 2
    monkeypatch.setattr(mgf_source, "_parse", None)
    bare = mgf_source.MgfReader(f"file://{path}", 10_000, True)
    assert sum(b.num_rows for p in bare.partitions() for b in bare.read(p)) == 2500
