"""Paths that large tables take, on small ones."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionforge.operators import embed, knn, match
from ionforge.plans import pipeline
from ionforge.plans.config import SearchConfig
from ionforge.sources import mgf


def vectors(spark, n, seed, width=16):
    rng = np.random.default_rng(seed)
    e = rng.standard_normal((n, width))
    e /= np.sqrt((e * e).sum(1, keepdims=True))
    rows = [(k, [float(x) for x in np.float32(v)], float(500 + (k * 37) % 60), int(k * 5 % 12), k % 3 == 0) for k, v in enumerate(e)]
    return spark.createDataFrame(rows, "id long, embedding array<float>, mass double, bucket int, is_decoy boolean")


def nearest(q, p, k, mode):
    out = set()
    for a in q.collect():
        d = []
        for b in p.collect():
            gap = float(((np.array(a.embedding) - np.array(b.embedding)) ** 2).sum())
            gap += (a.mass - b.mass) ** 2 if mode == "narrow" else (a.bucket ^ b.bucket).bit_count()
            d.append((round(gap, 9), b.id))
        out |= {(a.id, pos + 1, i) for pos, (_, i) in enumerate(sorted(d)[:k])}
    return out


@pytest.mark.parametrize("mode", ["narrow", "open"])
@pytest.mark.parametrize("most", [1, 16])
def test_rounds_of_blocks(spark, monkeypatch, mode, most):
    monkeypatch.setattr(knn, "MOST_BROADCAST", most)
    monkeypatch.setattr(knn, "PART", 50)
    q, p = vectors(spark, 40, 1), vectors(spark, 230, 2)
    got = knn.knn(q, p, 5, mode, block=7)
    assert {(r.query_id, r.pos, r.db_id) for r in got.collect()} == nearest(q, p, 5, mode)
    decoys = {r.id: r.is_decoy for r in p.collect()}
    assert all(r.is_decoy == decoys[r.db_id] for r in got.collect())


@pytest.mark.parametrize("radius", [2.5, 7.0])
@pytest.mark.parametrize("size", [7, 5000])
def test_narrow_search_by_masses(spark, monkeypatch, radius, size):
    monkeypatch.setattr(knn, "PART", size)
    monkeypatch.setattr(knn, "BLOCK", size)
    q, p = vectors(spark, 40, 3), vectors(spark, 230, 4)
    got = knn.knn_narrow_pruned(q, p, 5, radius)
    assert {(r.query_id, r.pos, r.db_id) for r in got.collect()} == nearest(q, p, 5, "narrow")
    few = p.limit(3)
    assert knn.knn_narrow_pruned(q, few, 5, radius).count() == 120


def test_no_queries_and_no_database(spark):
    q, p = vectors(spark, 4, 5), vectors(spark, 4, 6)
    for a, b in ((q.limit(0), p), (q, p.limit(0))):
        assert knn.knn(a, b, 3, "open").count() == 0
        assert knn.knn_narrow_pruned(a, b, 3).count() == 0


def test_spectra_of_a_split_file_are_numbered(spark, tmp_path):
    rng = random.Random(1)
    text = "".join(f"BEGIN IONS\nTITLE=a.{k}\nPEPMASS={400 + k}\nCHARGE=2+\n" + "".join(f"{100 + j}.5 {rng.randrange(9)}\n" for j in range(rng.randrange(1, 30))) + "END IONS\n\n" for k in range(1, 301))
    (tmp_path / "a.mgf").write_text(text)
    with gzip.open(tmp_path / "b.mgf.gz", "wt") as f:
        f.write(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = mgf.read_mgf(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path), lineSep="END IONS").rdd.getNumPartitions() > 4
        got = {}
        for r in rows.collect():
            got.setdefault(r.raw_file, []).append((r["index"], r["scan"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: sorted(v) for k, v in got.items()} == {k: [(i, i) for i in range(1, 301)] for k in ("a", "b.mgf")}


def test_configuration_takes_effect(spark):
    with pytest.raises(ValueError, match="padded"):
        SearchConfig(db_peptide_maximum_length=50)
    with pytest.raises(ValueError, match="at least 1"):
        SearchConfig(max_n_fragments=0)
    assert SearchConfig(n_buckets_narrow=10).narrow_radius == 450.0 and SearchConfig().narrow_radius == 2.5
    proteins = spark.createDataFrame([("P", "AAAAAAAKCCCCCCCKDDDDDDDR")], "accession string, sequence string")
    with pytest.raises(ValueError, match="at most 2"):
        pipeline.build_database(proteins, SearchConfig(max_database_size=2))


def test_fewer_fragments_match_less(spark):
    spectra = spark.createDataFrame([(1, 2, [(m, 1.0) for m in (72.04, 147.11, 232.07, 307.14, 360.17, 378.18)])], "spec_id long, charge int, peaks array<struct<mz:double,intensity:double>>")
    c = spark.createDataFrame([(1, 1, "ACK")], "spec_id long, pos long, peptide string")
    n = {k: match.score_candidates(spectra, c, 0.05, n_fragments=k).first().n_matched for k in (3, 200)}
    assert n == {3: 1, 200: 6}


def test_embeddings_of_a_batch_equal_single_ones(spark):
    e = embed.HashEmbedder()
    rows = [("ACDK", None), ("GGGGGK", None), ("", None)]
    df = spark.createDataFrame([r[:1] for r in rows], "peptide string")
    ions = df.select("peptide", embed.chemistry.fragment_ions(F.col("peptide"), F.lit(1), 10_000).alias("i")).collect()
    want = {r.peptide: e.vector(r.i or []) for r in ions}
    assert {r.peptide: list(r.embedding) for r in e.peptides(df).collect()} == want


def onnx_file(path, kind: int, shape: list[int], axes: list[int]) -> None:
    """A network that takes the mean over ``axes``, written field by field: (number, value) of a message, an int as varint, the rest by length."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(*pairs) -> bytes:
        out = b""
        for number, value in pairs:
            if isinstance(value, int):
                out += varint(number << 3) + varint(value)
            else:
                value = value.encode() if isinstance(value, str) else value
                out += varint(number << 3 | 2) + varint(len(value)) + value
        return out

    def tensor(name: str, kind: int, dims: list) -> bytes:
        size = message(*((1, message((2, d) if isinstance(d, str) else (1, d))) for d in dims))
        return message((1, name), (2, message((1, message((1, kind), (2, size))))))

    cast = message((1, "x"), (2, "f"), (4, "Cast"), (5, message((1, "to"), (3, 1), (20, 2))))
    attributes = (message((1, "axes"), *((8, a) for a in axes), (20, 7)), message((1, "keepdims"), (3, 0), (20, 2)))
    mean = message((1, "f"), (2, "y"), (4, "ReduceMean"), *((5, a) for a in attributes))
    left = [d for i, d in enumerate(["n", *shape]) if i not in axes]
    graph = message((1, cast), (1, mean), (2, "g"), (11, tensor("x", kind, ["n", *shape])), (12, tensor("y", 1, left)))
    path.write_bytes(message((1, 7), (7, graph), (8, message((1, ""), (2, 13)))))


def test_exported_networks(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    float_, int64 = 1, 7
    onnx_file(tmp_path / "s.onnx", float_, [100, 2], [1])
    onnx_file(tmp_path / "p.onnx", int64, [1, 42], [1])
    e = embed.ExportedEmbedder("", str(tmp_path / "s.onnx"))
    df = spark.createDataFrame([(1, [(100.0, 1.0), (300.0, 3.0)]), (2, [])], "id int, peaks array<struct<mz:double,intensity:double>>")
    assert {r.id: [round(x, 4) for x in r.embedding] for r in e.spectra(df).collect()} == {1: [4.0, 0.04], 2: [0.0, 0.0]}
