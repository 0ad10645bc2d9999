"""Operators that SQL does not express, against slow versions of their whole results."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from ionforge.llm import packing, quality, toxicity

from .test_operators import frame, prose, quality_rows

# --------------------------------------------------------------------- packing


def slow_best_fit(lengths, capacity):
    """Contents of bins by best fit, longest first, piece by piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if capacity - sum(b) >= n]
        if fits:
            min(fits, key=lambda b: capacity - sum(b)).append(n)
        else:
            bins.append([n])
    return Counter(sum(b) for b in bins)


@pytest.mark.parametrize("seed", range(6))
def test_bins_equal_slow_best_fit(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 5, 7, 11, 30, 33, 64]) if rng.random() < 0.5 else rng.randrange(1, 65) for _ in range(rng.randrange(1, 300))]
    _, sized, segments = packing.plan(dict(Counter(sizes)), (64,))
    assert Counter({u: n for u, n in Counter(x for _, n, _, u in sized for x in [u] * n).items()}) == slow_best_fit(sizes, 64)
    if seed < 2:
        rows = [(k, prose(rng, n)) for k, n in enumerate(sizes)]
        used = defaultdict(int)
        for r in packing.pack(frame(spark, rows), (64,)).collect():
            used[r.bin_id] += r.length
        assert Counter(used.values()) == slow_best_fit(sizes, 64)


# --------------------------------------------------------------------- quality


def test_posteriors_and_scores_by_hand(spark):
    """Both levels, their priors' strengths and the score, row by row in plain Python."""
    rng = random.Random(14)
    rows = quality_rows(rng, 160)
    sites = [(rng.choice(["a", "a", "a", "b", "c", None, ""]), rng.choice(["x", "y", None, ""])) for _ in rows]
    docs = spark.createDataFrame([(i, t, p, h) for (i, t, _), (h, p) in zip(rows, sites, strict=True)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.score(docs, labels).collect()}
    assert {r.host for r in got.values()} == {"a", "b", "c", ""}  # null and empty are one
    p = {i: 1 / (1 + math.exp(-r.evidence)) for i, r in got.items()}
    top = (sum(p.values()) + 1) / (len(p) + 2)

    def summed(key):
        out = defaultdict(lambda: [0, 0.0])
        for i, r in got.items():
            out[key(r)][0] += 1
            out[key(r)][1] += p[i]
        return out

    host, path = summed(lambda r: r.host), summed(lambda r: (r.host, r.path))

    def strength(level, mean):
        total = sum(n for n, _ in level.values())
        spread = sum(n * (g / n - mean(k)) ** 2 for k, (n, g) in level.items()) / total
        base = sum(n * mean(k) * (1 - mean(k)) for k, (n, _) in level.items()) / total
        return min(1e4, max(1.0, base / max(spread - base * len(level) / total, 1e-9) - 1))

    k_host, k_path = strength(host, lambda k: top), strength(path, lambda k: host[k[0]][1] / host[k[0]][0])
    for i, r in got.items():
        n, g = host[r.host]
        host_post = (k_host * top + g - p[i]) / (k_host + n - 1)
        n, g = path[r.host, r.path]
        path_post = (k_path * host_post + g - p[i]) / (k_path + n - 1)
        q = min(1 - 1e-6, max(1e-6, path_post))
        assert r.host_posterior == pytest.approx(host_post, rel=1e-6) and r.path_posterior == pytest.approx(path_post, rel=1e-6)
        assert r.score == pytest.approx(1 / (1 + math.exp(-(r.evidence + math.log(q / (1 - q))))), rel=1e-5)
        assert r.accepted == (r.score >= quality.THRESHOLD)


# -------------------------------------------------------------------- toxicity


def slow_value(net, x, words):
    """One window, step by step: two gated units, then attention over their states."""
    h = toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    states = []
    for way, order in ((0, words), (1, words[::-1])):
        cols = [slice((2 * g + way) * h, (2 * g + way + 1) * h) for g in range(3)]
        rows = slice(way * h, (way + 1) * h)
        s, out = np.zeros(h), []
        for w in order:
            a = x[w].astype(float) @ net.w + net.b
            z = sig(a[cols[0]] + s @ net.u[rows, cols[0]])
            r = sig(a[cols[1]] + s @ net.u[rows, cols[1]])
            cand = np.tanh(a[cols[2]] + r * (s @ net.u[rows, cols[2]]))
            s = z * s + (1 - z) * cand
            out.append(s)
        states.append(out if way == 0 else out[::-1])
    both = np.array([np.concatenate(p) for p in zip(*states, strict=True)])
    e = np.exp(both @ net.v[:, 0])
    return float((e / e.sum()) @ (both @ net.v[:, 1]) + net.c[0])


def test_scores_equal_a_slow_pass(spark):
    rng = random.Random(15)
    net = toxicity.Network(7)
    gen = np.random.default_rng(8)
    for name in ("word", "char", "b"):
        setattr(net, name, (gen.standard_normal(getattr(net, name).shape) * 0.5).astype(np.float32))
    texts = [prose(rng, n, 50) for n in (1, 2, 15, 16, 17, 31, 32, 33, 47, 48, 49, 100)] + ["", "... !"]
    import pyarrow as pa

    got = net.scores(pa.array([*texts, None]))
    assert got[-3:].tolist() == [0.0, 0.0, 0.0]
    for text, score in zip(texts[:-2], got, strict=False):
        t = toxicity.Texts(*toxicity._joined([text]))
        x = net.inputs(t)
        n, half = len(t.number), toxicity.WINDOW // 2
        starts = range(0, max(1, n - half), half)
        worst = max(slow_value(net, x, t.number[s : s + toxicity.WINDOW].tolist()) for s in starts)
        assert score == pytest.approx(1 / (1 + math.exp(-(net.scale[0] * worst + net.scale[1]))), abs=1e-4)
