"""The pipeline's stages on small documents with planted cases, against brute force."""

import random
from collections import Counter

import corpus_pipeline

from ionforge.llm import packing

from .test_operators import exact, near, prose


def planted(tmp_path, spark):
    rng = random.Random(21)
    bench = [(k, prose(rng, 40, 5000)) for k in range(5)]
    docs = [(k, prose(rng, rng.randrange(30, 120), 5000).capitalize() + ".", f"s{k % 4}") for k in range(120)]
    docs += [(200 + k, docs[k][1].replace(" ", "  "), "s0") for k in range(5)]
    docs += [(300 + k, docs[10 + k][1] + " more", "s1") for k in range(5) if len(docs[10 + k][1].split()) > 60]
    docs += [(400 + k, prose(rng, 60, 5000) + " " + bench[k][1], "s2") for k in range(5)]
    docs += [(500 + k, " ".join(w + "%%%" for w in prose(rng, 60, 5000).split()), "s3") for k in range(30)]
    docs += [(600, None, None)]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(not 500 <= i < 600), 0) for i, _, _ in docs if i % 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return docs


def test_stages(spark, tmp_path):
    rows = planted(tmp_path, spark)
    d = str(tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d)
        assert docs.columns == columns, name
        out = f"{d}/out-{name}"
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append({(r.doc_id, r.text) for r in docs.collect()})
    first = {(i, t) for i, t, _ in rows if not 500 <= i < 600}
    assert {x for x in kept[0] if x[0] != 600} == {x for x in first if x[0] != 600}
    want = {i for i, _, _, k, _ in exact(list(kept[0])) if k}
    assert {i for i, _ in kept[1]} == want
    groups = near(list(kept[1]), n=5)
    assert {i for i, _ in kept[2]} == {i for i, (_, c) in groups.items() if i == c}
    assert {i for i, _ in kept[3]} == {i for i, _ in kept[2] if not 400 <= i < 500}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in kept[3]}
    assert Counter(r.bin_length for r in packed if r.bin_id is not None).keys() <= set(packing.LENGTHS)


def test_run_is_the_stages(spark, tmp_path):
    planted(tmp_path, spark)
    got = corpus_pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in got.collect()}
    assert ids and not any(200 <= i < 600 for i in ids)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "decontaminate", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None


def stage(spark, tmp_path, name, rows):
    """The (doc_id, text) rows that stage ``name`` keeps of these."""
    planted(tmp_path, spark)
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in kept.collect())


def test_quality_decides_by_row(spark, tmp_path):
    rng = random.Random(22)
    good = [prose(rng, 60, 5000).capitalize() + "." for _ in range(40)]
    bad = [" ".join(w + "%%%" for w in prose(rng, 60, 5000).split()) for _ in range(8)]
    labelled = [(k, t) for k, t in enumerate(good[:30])] + [(501 + 2 * k, t) for k, t in enumerate(bad[:6])]
    rows = [*labelled, *((None, t) for t in good[30:36]), (None, bad[6]), (700, good[36]), (700, bad[7]), (None, None)]
    kept = stage(spark, tmp_path, "quality", rows)
    assert {x: n for x, n in kept.items() if x[1]} == {x: 1 for x in rows if x[1] and x[1] not in bad}


def test_near_decides_by_row(spark, tmp_path):
    rng = random.Random(23)
    a, b, c, d, e = (prose(rng, 100, 5000) for _ in range(5))
    rows = [(1, a), (2, a + " more"), (2, b), (None, a + " again"), (None, c), (None, c + " more"), (None, d), (3, d + " more"), (4, e), (None, None), (4, None)]
    kept = stage(spark, tmp_path, "near", rows)
    assert len([x for x in kept if x[0] is None and x[1] and x[1].startswith(c)]) == 1
    assert {x for x in kept if not (x[1] or "").startswith(c)} == {(1, a), (2, b), (3, d + " more"), (4, e), (None, None), (4, None)}
    assert set(kept.values()) == {1}


def test_exact_and_near_keep_one_row_of_a_group(spark, tmp_path):
    rng = random.Random(24)
    a, b = (prose(rng, 100, 5000) for _ in range(2))
    rows = [(1, a), (1, a), (2, a.replace(" ", "  ")), (None, a), (None, b), (None, b), (5, None), (5, ""), (5, b + " more")]
    kept = stage(spark, tmp_path, "exact", rows)
    assert sorted((i or 0, (t or "")[:20], n) for (i, t), n in kept.items()) == sorted([(1, a[:20], 1), (0, b[:20], 1), (5, "", 1), (5, b[:20], 1)])
    kept = dict(corpus_pipeline.STAGES)["near"](spark, spark.createDataFrame([(1, a), (1, a), (2, b)], "doc_id long, text string"), str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (2, b)]
