"""The spectral plane against brute force and against principal components."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ionforge.operators import layout, sample


def rolled(n, seed):
    """A strip rolled up in space, to which planes of principal components fit badly."""
    rng = np.random.default_rng(seed)
    t, h = 4.5 * (1 + 2 * rng.random(n)), 6 * rng.random(n)
    return np.stack([t * np.cos(t), h, t * np.sin(t)] + [0.01 * rng.normal(size=n) for _ in range(5)], axis=1), t


def nearest(v, k):
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    return [{int(j) for j in np.lexsort((np.arange(len(v)), np.round(row, 9)))[:k]} for row in d]


@pytest.fixture(scope="module")
def strip(spark):
    v, t = rolled(1500, 1)
    df = spark.createDataFrame([(i, [float(x) for x in np.float32(r)], float(t[i])) for i, r in enumerate(v)], "id long, embedding array<float>, t double").persist()
    return df, v


def planes(df):
    spectral = layout.spectral_plane(df, landmarks=500).select("id", F.array(F.col("x").cast("float"), F.col("y").cast("float")).alias("embedding"))
    pca = sample.plane(df).select("id", F.transform("projection", lambda x: x.cast("float")).alias("embedding"))
    return spectral, pca


def test_neighbourhoods_are_kept_better_than_by_principal_components(strip):
    df, v = strip
    kept = [layout.preservation(df, p, "id % 10 = 0", 20).first() for p in planes(df)]
    assert kept[0].n == 150 and kept[0].kept > kept[1].kept and kept[0].kept > 0.4


def test_preservation_equals_brute_force(strip):
    df, v = strip
    p = planes(df)[0]
    at = {r.id: r.embedding for r in p.collect()}
    a, b = nearest(np.float32(v).astype(float), 20), nearest(np.array([at[i] for i in range(len(v))], float), 20)
    want = sum(len(a[i] & b[i]) for i in range(0, len(v), 10)) / (20 * 150)
    assert layout.preservation(df, p, "id % 10 = 0", 20).first().kept == pytest.approx(want)


def test_the_strip_is_unrolled(strip):
    df, _ = strip
    r = layout.spectral_plane(df, landmarks=500).select("t", "x").toPandas().rank()
    assert abs(r.t.corr(r.x)) > 0.95


def test_few_equal_and_missing_rows(spark):
    make = lambda vs: spark.createDataFrame(list(enumerate(vs)), "id long, embedding array<float>")
    got = layout.spectral_plane(make([[1.0, 0.0], None, [0.0, 1.0]]))
    assert [(r.x is None, r.y is None) for r in got.orderBy("id").collect()] == [(False, False), (True, True), (False, False)]
    same = layout.spectral_plane(make([[1.0, 2.0]] * 50)).collect()
    assert len(same) == 50 and all(np.isfinite([r.x, r.y]).all() for r in same)
    assert layout.spectral_plane(make([[1.0]]).limit(0)).count() == 0
    parts = layout.spectral_plane(make([[float(i % 3 * 100 + i * 0.01), 1.0] for i in range(60)])).collect()
    assert all(np.isfinite([r.x, r.y]).all() for r in parts)
