"""Golden values and micro fixtures of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from ionforge.functions import buckets, chemistry, constants, encode, peaks
from ionforge.operators import fdr

#: precursor m/z, charge, neutral mass, peptide, its mass, delta
GOLDEN = [
    (699.032500, 3, 2094.074025, "ADTAGVHGAALGADEIELTRK", 2094.070485, 0.003540),
    (900.941528, 2, 1799.867407, "DIVTQFHGAEAAVDAEK", 1799.868945, -0.001538),
    (925.985352, 2, 1849.955053, "TLIEGLDEISHGGLPSGR", 1849.953345, 0.001708),
    (900.942505, 2, 1799.869360, "DIVTQFHGAEAAVDAEK", 1799.868945, 0.000415),
    (779.408800, 3, 2335.202925, "SIEAEQLKDDLPTIHVGDTVR", 2335.201905, 0.001020),
    (473.229095, 2, 944.442541, "MFDIFTR", 928.447665, 15.994876),
    (608.333801, 2, 1214.651952, "NVADEVIKEAK", 1214.650635, 0.001318),
    (474.262451, 2, 946.509252, "IAETLTGSR", 946.508345, 0.000908),
    (337.198120, 3, 1008.570885, "LLGHTEIAR", 1008.571605, -0.000719),
    (473.229431, 2, 944.443212, "MFDIFTR", 928.447665, 15.995548),
]


def test_golden_masses(spark):
    df = spark.createDataFrame([(r[0], r[1], r[3]) for r in GOLDEN], "mz double, z int, p string")
    got = df.select(chemistry.precursor_mass(F.col("mz"), F.col("z")).alias("a"), chemistry.peptide_mass(F.col("p")).alias("b")).collect()
    for g, r in zip(got, GOLDEN, strict=True):
        assert g.a == pytest.approx(r[2], abs=2e-6)
        assert g.b == pytest.approx(r[4], abs=1e-6)
        assert g.a - g.b == pytest.approx(r[5], abs=3e-6)


def test_mass_of_unknown_residue_is_null(spark):
    df = spark.createDataFrame([("PEPXIDE",), ("",), (None,)], "p string")
    got = [r.m for r in df.select(chemistry.peptide_mass(F.col("p")).alias("m")).collect()]
    assert got[0] is None and got[1] == pytest.approx(constants.WATER) and got[2] is None


def test_proton_variant(spark):
    df = spark.createDataFrame([(500.0, 2)], "mz double, z int")
    a, b = df.select(chemistry.precursor_mass(F.col("mz"), F.col("z")), chemistry.precursor_mass(F.col("mz"), F.col("z"), proton=True)).first()
    assert b - a == pytest.approx(2 * (constants.HYDROGEN - constants.PROTON))


def test_fragment_ions(spark):
    want = [36.525831, 72.044386, 74.060039, 116.541158, 147.112801, 154.075366, 180.588638, 189.593921, 232.075040, 307.143455, 360.170000, 378.180565]
    df = spark.createDataFrame([("ACK", 2)], "p string, z int")
    got = df.select(chemistry.fragment_ions(F.col("p"), F.col("z"))).first()[0]
    assert got == pytest.approx(want, abs=2e-6)
    few = df.select(chemistry.fragment_ions(F.col("p"), F.col("z"), 3)).first()[0]
    assert few == pytest.approx(want[:3], abs=2e-6)


@pytest.mark.parametrize(("method", "want"), [("L2", 1 / math.sqrt(6)), ("sum", 1 / 6), ("max", 1.0), ("ion_current", 1 / 6)])
def test_normalise(spark, method, want):
    df = spark.createDataFrame([([1.0] * 6,), ([0.0, 0.0],)], "x array<double>")
    got = df.select(peaks.normalise(F.col("x"), method).alias("y")).collect()
    assert got[0].y == pytest.approx([want] * 6) and got[1].y is None


def test_normalise_unknown_method():
    with pytest.raises(ValueError):
        peaks.denominator(F.lit(1), "median")


def test_trim_keeps_order_and_later_ties(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [5.0, 1.0, 9.0]), ([1.0, 2.0, 3.0], [4.0, 4.0, 4.0])], "m array<double>, i array<double>")
    got = df.select(peaks.trim(peaks.zip_peaks(F.col("m"), F.col("i")), 2).alias("p")).collect()
    assert [(p.mz, p.intensity) for p in got[0].p] == [(1, 5), (3, 9)]
    assert [p.mz for p in got[1].p] == [2, 3]


def test_pad(spark):
    assert spark.range(1).select(peaks.pad(F.array(F.lit(1.0)), 3)).first()[0] == [1, 0, 0]


@pytest.mark.parametrize(("n", "want"), [(5, 10.206207), (4, -1.632993), (0, 0.0)])
def test_score(spark, n, want):
    a = 1 / math.sqrt(6)
    df = spark.createDataFrame([([(100.0 * k, a) for k in range(1, 7)], [100.0 * k + 0.005 for k in range(1, n + 1)] or [9.0])], "p array<struct<mz:double,intensity:double>>, ions array<double>")
    hit = peaks.matched(F.col("p"), F.col("ions"), 0.01)
    assert df.select(peaks.match_score(hit)).first()[0] == pytest.approx(want, abs=1e-6)


def test_zero_never_matches(spark):
    df = spark.createDataFrame([([(0.0, 1.0)], [0.0])], "p array<struct<mz:double,intensity:double>>, ions array<double>")
    assert df.select(F.size(peaks.matched(F.col("p"), F.col("ions"), 0.01))).first()[0] == 0


def test_score_transform(spark):
    df = spark.createDataFrame([(10.206207,), (-0.408248,), (0.0,), (-1.632993,), (-1.0,), (None,)], "s double")
    got = [r[0] for r in df.select(fdr.transform_score(F.col("s"))).collect()]
    assert got[:3] == pytest.approx([-2.416468, 0.524668, 0.0], abs=1e-6)
    assert math.isnan(got[3]) and got[4] == math.inf and got[5] is None


def test_encode(spark):
    df = spark.createDataFrame([("PEPK",)], "p string")
    padded, ids = df.select(encode.pad_peptide(F.col("p"), 6), encode.residue_ids(encode.pad_peptide(F.col("p"), 6))).first()
    assert padded == "PEPK__" and ids == [8, 3, 8, 15, 0, 0]
    with pytest.raises(Exception, match="unknown residue"):
        df.select(encode.residue_ids(F.lit("PE?"))).collect()


def test_pad_never_cuts(spark):
    assert spark.range(1).select(encode.pad_peptide(F.lit("PEPTIDE"), 3)).first()[0] == "PEPTIDE"


def test_hamming(spark):
    assert spark.range(1).select(buckets.hamming(F.lit(7), F.lit(8))).first()[0] == 4


def test_buckets(spark):
    df = spark.createDataFrame([(float(k),) for k in range(101)], "mass double")
    b = buckets.fit_uniform(df, "mass", 10)
    got = df.select(b.ordinal(F.col("mass")).alias("b"), b.ordinal(F.col("mass") + 1000).alias("hi"), b.ordinal(F.col("mass") - 1000).alias("lo")).collect()
    assert [r.b for r in got] == [min(9, k // 10) for k in range(101)]
    assert {r.hi for r in got} == {9} and {r.lo for r in got} == {0}
    q = buckets.fit_quantile(df, "mass", 4)
    sizes = [r["count"] for r in df.groupBy(q.ordinal(F.col("mass"))).count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 2
    with pytest.raises(ValueError):
        buckets.fit_uniform(df, "mass", 257)


def test_buckets_of_nothing(spark):
    df = spark.createDataFrame([], "mass double")
    assert buckets.fit_uniform(df, "mass", 3).n == 3


@pytest.mark.parametrize(("name", "want"), [("trypsin", constants.ENZYMES["trypsin"]), ("r'(?<=K)(?=A)'", "(?<=K)(?=A)")])
def test_enzyme_rule(name, want):
    assert constants.enzyme_rule(name) == want
