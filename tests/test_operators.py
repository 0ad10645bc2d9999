"""Micro fixtures and properties of the operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ionforge.functions import chemistry, constants
from ionforge.operators import digest, embed, fdr, knn, match, report


def proteins(spark, *seqs):
    return spark.createDataFrame([(f"P{i}", s) for i, s in enumerate(seqs)], "accession string, sequence string")


def pieces(spark, s):
    return spark.range(1).select(digest.fragments(F.lit(s))).first()[0]


def test_cuts(spark):
    assert pieces(spark, "AKKBRPCWKPDMRPEK") == ["AK", "K", "BRPCWK", "PDMR", "PEK"]
    assert pieces(spark, "MK") == ["MK"]
    assert pieces(spark, "") == []


def test_pieces_rebuild_the_protein(spark):
    rng = random.Random(1)
    for _ in range(10):
        s = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(200))
        assert "".join(pieces(spark, s)) == s


def test_missed_cleavages_and_filters(spark):
    got = digest.digest(proteins(spark, "AKCRBK"), missed=1, min_length=2, max_length=4)
    assert {r.peptide for r in got.collect()} == {"AK", "CR", "AKCR"}


def test_semi(spark):
    got = {r.peptide for r in digest.digest(proteins(spark, "ACDK"), missed=0, min_length=2, max_length=3, semi=True).collect()}
    assert got == {"AC", "ACD", "DK", "CDK"}


def test_empty_and_null_proteins(spark):
    p = spark.createDataFrame([("A", ""), ("B", None)], "accession string, sequence string")
    assert digest.digest(p).count() == 0


def test_map_and_decoys(spark):
    t = digest.digest(proteins(spark, "ACDEFGHK", "ACDEFGHK"), missed=0)
    assert [tuple(r) for r in digest.protein_map(t).collect()] == [("ACDEFGHK", ["P0", "P1"])]
    r = digest.reverse_proteins(proteins(spark, "MKAARPK")).first()
    assert tuple(r) == ("DECOY_P0", "KPRAAKM")


def test_no_decoy_is_a_target(spark):
    rng = random.Random(2)
    p = proteins(spark, *("".join(rng.choice("AGKR") for _ in range(60)) for _ in range(30)))
    t, d = (digest.digest(x, missed=1, min_length=2, max_length=6) for x in (p, digest.reverse_proteins(p)))
    db = digest.search_database(t, d)
    assert db.groupBy("peptide").count().filter("count > 1").count() == 0
    assert digest.shared(d, t).count() > 0
    assert db.filter("is_decoy").join(t, "peptide", "left_semi").count() == 0


def test_size_guard(spark):
    with pytest.raises(ValueError):
        digest.check_size(spark.range(3), 2)


@pytest.mark.parametrize(
    ("kind", "header", "want"),
    [
        ("generic", "X1 thing", (None, "X1 thing")),
        ("uniprot", "sp|P1|NAME_X Protein x OS=Homo sapiens OX=9606", ("Homo sapiens", "NAME_X Protein x OS=Homo sapiens")),
        ("ncbi", "WP_1 some enzyme [E. coli]", ("E. coli", "some enzyme")),
    ],
)
def test_headers(spark, kind, header, want):
    s, p = spark.range(1).select(digest.parse_header(F.lit(header), kind).alias("h")).first().h
    assert s == want[0] and p == (want[1] if kind != "uniprot" else "NAME_X Protein x OS=Homo sapiens")


def vectors(spark, n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(8)]
        s = math.sqrt(sum(x * x for x in v))
        rows.append((i, [x / s for x in v], 500 + rng.random() * 50, rng.randrange(12), i % 2 == 1))
    return rows, spark.createDataFrame(rows, "id long, embedding array<float>, mass double, bucket int, is_decoy boolean")


@pytest.mark.parametrize("mode", ["narrow", "open"])
@pytest.mark.parametrize("block", [7, 1000])
def test_knn_equals_brute_force(spark, mode, block):
    rows, db = vectors(spark, 120)
    rows = {r.id: r for r in db.collect()}
    got = knn.knn(db.filter("id % 5 = 0"), db, 6, mode, block=block).collect()
    for q in [r for r in rows.values() if r.id % 5 == 0]:
        def d(p, q=q):
            e = sum((a - b) ** 2 for a, b in zip(q.embedding, p.embedding, strict=True))
            return e + ((q.mass - p.mass) ** 2 if mode == "narrow" else (q.bucket ^ p.bucket).bit_count())
        want = sorted((round(d(p), 9), p.id) for p in rows.values())[:6]
        mine = sorted((g.pos, g.db_id, g.distance) for g in got if g.query_id == q.id)
        assert [m[1] for m in mine] == [w[1] for w in want]
        assert [m[2] for m in mine] == pytest.approx([w[0] for w in want], abs=1e-6)


def test_pruned_knn_equals_full(spark):
    _, db = vectors(spark, 150, 3)
    q = db.filter("id % 4 = 0")
    key = lambda df: sorted((r.query_id, r.pos, r.db_id) for r in df.collect())
    for radius in (2.1, 5.0, 60.0):
        assert key(knn.knn_narrow_pruned(q, db, 5, radius)) == key(knn.knn(q, db, 5, "narrow"))


def test_small_database_gives_fewer(spark):
    _, db = vectors(spark, 3)
    assert knn.knn(db, db, 10, "open").count() == 9
    assert knn.knn(db.limit(0), db, 10, "open").count() == 0
    assert knn.knn(db, db.limit(0), 10, "open").count() == 0


def test_hybrid_has_two_k(spark):
    _, db = vectors(spark, 40)
    q = db.filter("id < 3")
    h = knn.hybrid(knn.knn(q, db, 5, "narrow"), knn.knn(q, db, 5, "open"), 5)
    assert {r.query_id: r["count"] for r in h.groupBy("query_id").count().collect()} == {0: 10, 1: 10, 2: 10}
    assert {r.pos for r in h.collect()} == set(range(1, 11))


def test_band_matches_equal_loops(spark):
    rng = random.Random(5)
    p = [(rng.randrange(3), rng.random() * 20) for _ in range(200)] + [(0, 0.0)]
    i = [(rng.randrange(3), rng.random() * 20) for _ in range(100)] + [(0, 0.0)]
    got = match.band_matches(spark.createDataFrame(p, "s int, mz double"), spark.createDataFrame(i, "s int, ion double"), 0.1, ["s"]).collect()
    want = sorted(x for x in p if x[1] and any(x[0] == y[0] and y[1] and abs(x[1] - y[1]) < 0.1 for y in i))
    assert sorted(tuple(r) for r in got) == want


def test_ties_go_to_the_later_position(spark):
    df = spark.createDataFrame([(1, 1, 5.0, "A"), (1, 2, 5.0, "B"), (1, 3, 4.0, "C")], "spec_id int, pos int, score double, peptide string")
    assert match.best_per_spectrum(df).first().peptide == "B"
    assert [r.peptide for r in match.best_per_spectrum(df, 2).orderBy("rank").collect()] == ["B", "A"]


def test_own_spectrum_scores_best(spark):
    names = ["ADTAGVHGAALGADEIELTRK", "DIVTQFHGAEAAVDAEK", "TLIEGLDEISHGGLPSGR", "NVADEVIKEAK"]
    p = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "spec_id int, peptide string")
    spectra = p.select("spec_id", F.lit(2).alias("charge"), F.transform(chemistry.fragment_ions(F.col("peptide"), F.lit(2)), lambda m: F.struct(m.alias("mz"), F.lit(1.0).alias("intensity"))).alias("peaks"))
    c = p.select(F.col("peptide"), (F.col("spec_id") + 1).alias("pos")).join(p.select("spec_id"))
    best = match.best_per_spectrum(match.score_candidates(spectra, c)).collect()
    assert {r.spec_id: r.peptide for r in best} == dict(enumerate(names))


def q_reference(rows):
    out = {}
    for s in {r[0] for r in rows}:
        t = sum(1 for r in rows if r[0] <= s and not r[1])
        d = sum(1 for r in rows if r[0] <= s and r[1])
        out[s] = d / t if t else math.inf
    return {s: min(f for k, f in out.items() if k >= s) for s in out}


def test_q_values_micro(spark):
    df = spark.createDataFrame([(-3.0, False), (-2.5, False), (-2.5, True), (-2.0, False), (-1.0, True), (-0.5, False)], "score double, is_decoy boolean")
    got = {r.score: r.q for r in fdr.q_values(df).collect()}
    assert got == pytest.approx({-3.0: 0, -2.5: 1 / 3, -2.0: 1 / 3, -1.0: 0.5, -0.5: 0.5})


@pytest.mark.parametrize("ranges", [1, 2, 7, 64])
def test_q_values_equal_loops(spark, ranges):
    rng = random.Random(ranges)
    rows = [(float(rng.randrange(60)), rng.random() < 0.3) for _ in range(300)]
    got = {r.score: r.q for r in fdr.q_values(spark.createDataFrame(rows, "score double, is_decoy boolean"), ranges=ranges).collect()}
    assert got == pytest.approx(q_reference(rows))
    ordered = [got[k] for k in sorted(got)]
    assert ordered == sorted(ordered)


def test_q_values_of_nothing(spark):
    assert fdr.q_values(spark.createDataFrame([], "score double, is_decoy boolean")).count() == 0


def test_filter_drops_decoys(spark):
    df = spark.createDataFrame([(float(i), i >= 90) for i in range(100)], "score double, is_decoy boolean")
    assert fdr.filter_fdr(df, 0.01).count() == 90


def test_missing_accession_raises(spark):
    a = spark.createDataFrame([("AK",)], "best_peptide string")
    m = spark.createDataFrame([("CK", ["P"])], "peptide string, accessions array<string>")
    with pytest.raises(Exception, match="no protein has AK"):
        fdr.with_accessions(a, m).collect()


def test_profile(spark):
    df = spark.createDataFrame([(float(x),) for x in (0.05, 1.0, 1.0, 2.0, 11.0, 500.0)], "delta_mass double")
    got = {r.bin: r.n for r in report.delta_profile(df, bins=10).collect()}
    assert got == {0: 2, 1: 1, 9: 1}
    assert report.delta_profile(df, bins=10, empty=True).count() == 10
    assert report.top_bins(report.delta_profile(df, bins=10), 1).first().bin == 0


def test_pin_micro(spark):
    df = spark.createDataFrame([("f", 3, 7, 500.0, 998.0, 2, True, 0.1, 1.5, "PEPK", 900.0, 98.0)], "raw_file string, scan int, index int, precursorMZ double, pepmass double, charge int, best_is_decoy boolean, best_distance double, best_score double, best_peptide string, peptide_mass double, delta_mass double")
    r = report.pin(df).first()
    assert (r.SpecId, r.Label, r.Peptide, r.ExpMass, r.charge2, r.charge3, r.peptide_length) == ("f_7_7_2", -1, "X.PEPK.X", 500.0, 1, 0, 4)
    assert report.pin(df, neutral_mass=True).first().ExpMass == 998.0


def test_embedder(spark):
    e = embed.HashEmbedder()
    df = spark.createDataFrame([("PEPTIDEK",), ("ACDEFGHK",)], "peptide string")
    v = {r.peptide: r.embedding for r in e.peptides(df).collect()}
    assert all(len(x) == 64 and sum(y * y for y in x) == pytest.approx(1, abs=1e-5) for x in v.values())
    assert e.vector([]) == [0.0] * 64
    ions = df.select("peptide", chemistry.fragment_ions(F.col("peptide"), F.lit(1)).alias("i")).collect()
    s = spark.createDataFrame([(r.peptide, [(m, 1.0) for m in r.i]) for r in ions], "peptide string, peaks array<struct<mz:double,intensity:double>>")
    for r in e.spectra(s).collect():
        assert r.embedding == pytest.approx(v[r.peptide], abs=1e-5)


def test_water():
    assert constants.WATER == pytest.approx(18.0105646837)


def test_batch_matching_equals_expressions(spark):
    from ionforge.functions import peaks

    rng = random.Random(31)
    rows = []
    for k in range(60):
        ions = sorted(rng.choice([0.0, 100 + rng.random() * 3]) for _ in range(rng.randrange(0, 30)))
        p = sorted((rng.choice([0.0, 100 + rng.random() * 3]), rng.random()) for _ in range(rng.randrange(0, 30)))
        rows.append((k, p, ions))
    df = spark.createDataFrame(rows, "k int, p array<struct<mz:double,intensity:double>>, ions array<double>")
    hit = peaks.matched(F.col("p"), F.col("ions"), 0.05)
    want = df.select("k", F.size(hit).alias("n"), peaks.match_score(hit, 4).alias("s")).orderBy("k").collect()
    import pyarrow as pa

    lists = [pa.array(x, pa.list_(pa.float64())) for x in ([[m for m, _ in r[1]] for r in rows], [[i for _, i in r[1]] for r in rows], [r[2] for r in rows])]
    score, n = match.match_batch(*lists, 0.05, 4)
    assert n.tolist() == [w.n for w in want]
    assert score.tolist() == pytest.approx([w.s for w in want])
