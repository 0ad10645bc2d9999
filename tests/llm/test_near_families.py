"""op4: near copies in large groups whose links are all just above the threshold."""

import random

import numpy as np
import pyarrow as pa

from ionforge.llm import near_dedup


def family(rng, n, words=150, edits=(3, 4)):
    """An original and ``n`` copies of it, each with some words replaced; most pairs of copies are no links."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    base = [word() for _ in range(words)]
    out = [base]
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(3, words - 3), rng.choice(edits)):
            copy[at] = word()
        out.append(copy)
    return [" ".join(w) for w in out]


def brute(rows, n, percent):
    """Components by all pairs of sets of word tuples."""
    sets = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, w in ((i, t.split()) for i, t in rows)}
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in sets}


def test_copies_of_an_original_that_is_no_hub_are_found(spark):
    rng = random.Random(5)
    texts = [t for _ in range(6) for t in family(rng, 40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows, 4, 80)
    assert len(set(want.values())) < 30
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), n=4).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_bits_that_differ_are_counted_whatever_the_sign():
    n, words = 40, near_dedup.BITS // 64
    rng = np.random.default_rng(1)
    bits = np.tile(rng.integers(-(2**63), 2**63, words, dtype=np.int64), (n, 1))
    for k in range(1, n):  # the highest and lowest bits differ, and no others
        bits[k, : k + 20] ^= np.int64(1 - 2**63)
    bands = rng.integers(1, 2**62, (n, near_dedup.BANDS), dtype=np.int64)
    bands[:, 0] = 7
    block = [[{"node": k, "component": k, "main": k == 0, "size": 100, "bands": bands[k].tolist(), "bits": bits[k].tolist()} for k in range(n)]]
    kind = pa.list_(pa.struct([("node", pa.int64()), ("component", pa.int64()), ("main", pa.bool_()), ("size", pa.int64()), ("bands", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))]))
    batch = pa.RecordBatch.from_arrays([pa.array([7]), pa.array(block, kind)], ["key", "m"])
    pairs = {(a, b) for out in near_dedup._able(80)([batch]) for a, b in zip(*(c.to_pylist() for c in out.columns), strict=True)}
    assert pairs == {(a, b) for a in range(n) for b in range(a + 1, n)}
