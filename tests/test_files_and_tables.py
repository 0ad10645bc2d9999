"""The MGF data source, sorted and bucketed tables, table functions, numbering and permutations."""

import gzip
import random
import re

import pytest
from pyspark.sql import functions as F

from ionforge.functions import chemistry, tables
from ionforge.operators import digest, sample
from ionforge.sources import fasta, mgf, mgf_source, store


def spectra_text(rng, n):
    out = []
    for k in range(n):
        head = [f"TITLE=run.{k}", f"PEPMASS={rng.uniform(200, 900):.4f} 10", f"CHARGE={rng.randrange(1, 5)}+"]
        if k % 3 == 0:
            head.append(f"SCANS={k}")
        if k % 5 == 0:
            head = head[:1]
        peaks = [f"{rng.uniform(100, 900):.3f} {rng.uniform(0, 9):.2f}" for _ in range(rng.randrange(30))]
        out.append("\n".join(["BEGIN IONS", *head, *peaks, "END IONS"]))
    return "\n\n".join(out) + "\n"


@pytest.mark.parametrize("split", [50, 997, 20_000, 1 << 26])
def test_data_source_equals_reader(spark, tmp_path, split):
    rng = random.Random(1)
    (tmp_path / "a.mgf").write_text(spectra_text(rng, 120))
    (tmp_path / "b.mgf").write_text(spectra_text(rng, 7).replace("\n", "\r\n"))
    (tmp_path / "c.mgf").write_text("")
    if split > 900:
        with gzip.open(tmp_path / "d.mgf.gz", "wt") as f:
            f.write(spectra_text(rng, 20))
    got = mgf_source.read(spark, str(tmp_path), split)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(rows(got), key=key) == sorted(rows(mgf.read_mgf(spark, str(tmp_path))), key=key)


def rows(df):
    return [(re.sub(r"\.mgf$", "", r.raw_file), r["index"], r.scan, r.precursorMZ, r.charge, tuple(map(tuple, r.peaks))) for r in df.collect()]


def test_ranges_of_one_file(spark, tmp_path):
    text = spectra_text(random.Random(2), 60)
    (tmp_path / "a.mgf").write_text(text)
    mgf_source.register(spark)
    df = spark.read.format("mgf").option("split_bytes", 500).load(str(tmp_path / "a.mgf"))
    assert df.rdd.getNumPartitions() == -(-len(text) // 500) > 20
    got = df.collect()
    assert [r.offset for r in sorted(got, key=lambda r: r.offset)] == [m.start() for m in re.finditer("BEGIN IONS", text)]
    assert all(r.offset // 500 == r.split for r in got) and len({r.split for r in got}) > 10
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("mgf").load(str(tmp_path / "nowhere")).count()


def test_spectrum_fields():
    f = mgf_source.parse_spectrum
    assert f("\nTITLE=a.b.12\nPEPMASS=1.5 3\nCHARGE=2+ and 3+\n10 1\n 20.5\t2\n30\n") == (12, 1.5, 2, [{"mz": 10.0, "intensity": 1.0}, {"mz": 20.5, "intensity": 2.0}, {"mz": 30.0, "intensity": 0.0}])
    assert f("SCANS=x\nTITLE=a.5\nPEPMASS=abc") == (5, None, None, [])
    assert f("SCANS=3000000000\nCHARGE=") == (None, None, None, [])


def test_written_fasta_and_mgf_are_read_as_they_were(spark, tmp_path):
    p = spark.createDataFrame([("P1 one", "ACDEFGHIKL" * 13), ("P2", ""), ("P3 x", "M")], "header string, sequence string")
    store.write_fasta(p, str(tmp_path / "f"), 7)
    assert sorted((r.header, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "f")).collect()) == sorted(map(tuple, p.collect()))
    s = spark.createDataFrame([(1, 500.25, 2, [(1.5, 2.0), (3.0, 4.0)]), (2, None, None, [(7.0, 1.0)])], "scan int, precursorMZ double, charge int, peaks array<struct<mz:double,intensity:double>>")
    store.write_mgf(s, str(tmp_path / "m"))
    key = lambda df: sorted((r.scan, r.precursorMZ, r.charge, [tuple(p) for p in r.peaks]) for r in df.select("scan", "precursorMZ", "charge", "peaks").collect())
    assert key(mgf.read_mgf(spark, str(tmp_path / "m"))) == key(mgf_source.read(spark, str(tmp_path / "m"), 30)) == key(s)


def scanned(df):
    """Rows that the scan below a query gave, as its metric says."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value(), plan


def test_a_mass_window_reads_few_row_groups(spark, tmp_path):
    db = spark.range(0, 40_000, 1, 8).select(F.col("id").alias("peptide"), (500 + (F.col("id") * 7919) % 40_000 / 10).alias("mass"))
    db = db.unionByName(spark.createDataFrame([(-1, None)], "peptide long, mass double"))
    path = str(tmp_path / "db")
    store.write_by_mass(db, path, group_rows=1000, file_rows=15_000)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = store.mass_window(spark, path, 1000.0, 1020.0)
        n, plan = scanned(got)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.peptide for r in got.collect()) == sorted(r.peptide for r in db.filter("mass between 1000 and 1020").collect())
    assert "PushedFilters: [IsNotNull(mass), GreaterThanOrEqual(mass,1000.0), LessThanOrEqual(mass,1020.0)]" in got._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert 200 < n <= 3000
    assert spark.read.parquet(path).count() == 40_001


def test_members_are_read_from_the_wanted_buckets_alone(spark, tmp_path):
    db = spark.range(5000).select("id", (F.col("id") % 10).cast("int").alias("bucket"))
    path = str(tmp_path / "members")
    store.write_members(db, path)
    wanted = spark.createDataFrame([(3, "x"), (3, "x"), (7, "x"), (8, "y"), (None, "x")], "bucket int, kind string").filter("kind = 'x'")
    got = store.members(spark, path, wanted)
    assert sorted(r.id for r in got.collect()) == [i for i in range(5000) if i % 10 in (3, 7)]
    assert "dynamicpruning" in got._jdf.queryExecution().toString()
    assert store.members(spark, path, wanted.limit(0)).count() == 0


def test_table_functions_equal_the_expressions(spark):
    tables.register(spark)
    rng = random.Random(3)
    made = [(f"P{i}", "".join(rng.choice("ACDEFGHIKLMNPQRSTVWYKRPX") for _ in range(rng.randrange(120)))) for i in range(60)]
    p = spark.createDataFrame([*made, ("N", None), ("E", "")], "accession string, sequence string")
    for enzyme in ("trypsin", "lysc", "aspn", "chymotrypsin"):
        for missed in (0, 2):
            got = spark.sql(f"select accession, c.peptide from {{p}}, lateral cleave(sequence, '{enzyme}', {missed}, 5, 30) c", p=p)
            want = digest.digest(p, enzyme=enzyme, missed=missed, min_length=5, max_length=30)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("accession", "peptide").collect()))
    q = spark.createDataFrame([("PEPTIDEK", 2), ("CmK", 3), ("A", 1), ("XX", 1), (None, 2), ("", 1)], "peptide string, charge int")
    got = spark.sql("select peptide, sort_array(collect_list(f.mz)) as m from {q}, lateral fragments(peptide, charge) f group by peptide", q=q).collect()
    want = {r.peptide: r.m for r in q.withColumn("m", chemistry.fragment_ions(F.col("peptide"), F.col("charge"))).collect() if r.m and None not in r.m}
    assert {r.peptide: pytest.approx(r.m) for r in got} == want


def test_rows_are_numbered_in_order_whatever_the_partitions(spark):
    rng = random.Random(4)
    made = [(rng.choice([None, 1.0, 2.0, 2.5]), rng.choice(["a", "b", None]), i) for i in range(500)]
    df = spark.createDataFrame(made, "x double, y string, id long")
    low = lambda v: (v is not None, v if v is not None else 0)
    want = [i for *_, i in sorted(made, key=lambda r: (low(r[0]), (r[1] is not None, r[1] or ""), r[2]))]
    for d in (df, df.repartition(7)):
        for ranges in (1, 5, 200):
            got = sample.numbered(d, "x", "y", "id", ranges=ranges).collect()
            assert [r.id for r in sorted(got, key=lambda r: r.k)] == want and sorted(r.k for r in got) == list(range(500))
    assert sorted(r.id for r in sample.row_slice(df, 100, 120, "x", "y", "id").collect()) == sorted(want[100:120])
    assert sample.row_slice(df, 490, 9999, "x", "y", "id").count() == 10
    assert sample.numbered(df.limit(0), "x").count() == 0 and sample.row_slice(df, 5, 5, "id").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 97, 1000, 4097])
def test_permutations_are_bijections(spark, n):
    one, other = (spark.range(n).select("id", sample.permuted(F.col("id"), n, seed).alias("p")).collect() for seed in (1, 2))
    assert sorted(r.p for r in one) == sorted(r.p for r in other) == list(range(n))
    if n >= 97:
        moved = {r.id: r.p for r in one}
        assert sum(moved[i] == i for i in moved) < 10 and moved != {r.id: r.p for r in other}
        assert sum(abs(moved[i + 1] - moved[i]) == 1 for i in range(n - 1)) < 0.1 * n + 5
        assert {r.id: r.p for r in spark.range(0, n, 1, 5).select("id", sample.permuted(F.col("id"), n, 1).alias("p")).collect()} == moved


def test_stacked(spark):
    df = sample.stacked(spark.range(3), 3)
    assert sorted(map(tuple, df.collect())) == [(i, c) for i in range(3) for c in range(3)]


def test_fragments_are_planned_without_python(spark):
    tables.register(spark)
    q = spark.createDataFrame([("ACmK", 2), ("AXK", 2), ("AK", None), ("AK", 0)], "peptide string, charge int")
    got = spark.sql("select peptide, f.* from {q}, lateral fragments(peptide, charge) f", q=q)
    assert "UDTF" not in got._jdf.queryExecution().toString()
    prefix, want = [0.0], []
    for c in "ACmK":
        prefix.append(prefix[-1] + tables._MASS[c])
    for i in range(1, 5):
        for z in (1, 2):
            want += [("ACmK", "b", i, z, (prefix[i] + z * tables.K.PROTON) / z), ("ACmK", "y", i, z, (prefix[-1] - prefix[4 - i] + tables.K.WATER + z * tables.K.PROTON) / z)]
    assert [tuple(r) for r in got.collect()] == want
