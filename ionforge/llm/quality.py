"""Operator 2, a quality classifier by hierarchical empirical Bayes.

A logistic model gives each document's evidence, the log of how much likelier
its features are in good than in bad documents.  Posteriors of the share of
good documents are kept for each path, shrunk toward its host's, which is
shrunk toward the global share: sparse sites follow the prior above them, rich
ones their own documents.  The strength of each prior is estimated from the
spread of the sites (method of moments).  Sites are summarised by grouped
partial aggregation, so a host with a third of all rows is no burden.  A
document's own evidence is taken out of its site's counts before both are
combined.

The model is fitted on at most ``fit_rows`` labelled rows, those with the
smallest hash of the id; everything else covers all rows.

Defined results: null or empty text has the features of an empty text; null
and empty hosts are one host, and so are such paths; repeated rows are scored
one by one and all count; an id labelled both ways counts as good; null ids are
carried; an empty table gives an empty result; without labels of both classes
the evidence is a fixed rule on the share of odd bytes.  Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LETTERS, SPACED, Words, byte_table, shingles, sliced, spread, with_workers, written

FIT_ROWS = 20_000
THRESHOLD = 0.5

#: Classes of bytes whose shares are features.
CLASSES = {
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "symbol": b"#$%&*+<=>@[]\\^_`{}~",
    "bang": b"!?",
    "bar": b"|",
    "stop": b".,;:",
    "line": b"\n",
    "space": b" \t",
}
FEATURES = (*CLASSES, "log_words", "word_length", "same_lines", "same_runs", "odd_words", "same_next")
_WORDS, _LINES = Words(SPACED), Words(byte_table("\n"))
_BARE = Words(LETTERS)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text, computed over whole texts."""
    out = np.zeros((len(texts), len(FEATURES)))
    kind = np.full(256, len(CLASSES))
    for k, chars in enumerate(CLASSES.values()):
        kind[list(chars)] = k
    for first, at, data in _WORDS.chunks(texts):
        n = len(at) - 1
        size = np.maximum(at[1:] - at[:-1], 1)
        row = np.repeat(np.arange(n), at[1:] - at[:-1])
        counts = np.bincount(row * (len(CLASSES) + 1) + kind[data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)
        block = out[first : first + n]
        block[:, : len(CLASSES)] = counts[:, :-1] / size[:, None]
        h, start, end, row = _WORDS.split(at, data)
        words = np.bincount(row, minlength=n)
        block[:, 8] = np.log1p(words) / 5
        block[:, 9] = np.bincount(row, end - start, n) / np.maximum(words, 1) / 10
        block[:, 10] = _repeated(*_LINES.split(at, data)[::3], n)
        block[:, 11] = _repeated(*shingles(h, row, n, 4), n)
        again = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        block[:, 13] = np.bincount(row[1:][again], minlength=n) / np.maximum(words, 1)
        b = _BARE.split(at, data)
        # words that carry bytes other than letters and digits at more than one place
        bare = np.bincount(b[3], b[2] - b[1], n)
        block[:, 12] = 1 - bare / np.maximum(np.bincount(row, end - start, n), 1)
    return out


def _repeated(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """The share of a row's items that repeat an earlier one."""
    total = np.bincount(row, minlength=n)
    if not len(h):
        return np.zeros(n)
    order = np.argsort(h, kind="stable")
    hs, rs = h[order], row[order]
    order = np.argsort(rs, kind="stable")
    hs, rs = hs[order], rs[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (rs[1:] != rs[:-1])
    return 1 - np.bincount(rs[new], minlength=n) / np.maximum(total, 1)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30, ridge: float = 1e-3) -> dict:
    """Logistic regression by Newton steps on standardised features, classes weighted alike, so that its logit is evidence."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    b = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + ridge * b
        hess = (z.T * (weight * np.maximum(p * (1 - p), 1e-9))) @ z + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, grad)
        b -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "scale": scale, "b": b}


def evidence(x: Column, model: dict | None) -> Column:
    """The logit of ``fit``'s model as a column over the array ``x`` of features."""
    if model is None:
        return F.lit(4.0) - 40.0 * (F.element_at(x, 3) + F.element_at(x, 5))
    terms = [(F.element_at(x, i + 1) - float(m)) * float(b / s) for i, (m, s, b) in enumerate(zip(model["mean"], model["scale"], model["b"], strict=False))]
    total = F.lit(float(model["b"][-1]))
    for t in terms:
        total = total + t
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q / (1 - q))


def _strength(level: DataFrame, mean: str, n: str, good: str) -> Column:
    """Prior strength from the spread of the rates: m(1-m)/v - 1, within 1 and 10,000 rows."""
    rate = F.col(good) / F.col(n)
    noise = F.sum(F.lit(1.0))
    spread = F.sum(F.col(n) * (rate - F.col(mean)) ** 2) / F.sum(n)
    base = F.sum(F.col(n) * F.col(mean) * (1 - F.col(mean))) / F.sum(n)
    # sampling alone spreads the rates by base * (groups / rows)
    true = spread - base * noise / F.sum(n)
    return F.least(F.lit(1e4), F.greatest(F.lit(1.0), F.try_divide(base, F.greatest(true, F.lit(1e-9))) - 1))


def score(docs: DataFrame, labels: DataFrame | None, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, key: Column | None = None) -> DataFrame:
    """Per row: id, host, path, evidence, host_posterior, path_posterior, score, accepted.

    ``host`` and ``path`` default to ``source`` and ``lang``; for a table of
    URLs give their host and first path segment.  ``labels`` has doc_id and
    quality.  A ``key``, a string, is carried along as the last column.
    """
    spark = docs.sparkSession
    with_workers(spark)
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).alias("text"), *([] if key is None else [key.alias("key")]))
    more = rows.columns[4:]

    def run(batches):
        for b in sliced(batches):
            x = features(b.column(3))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), flat, *(b.column(c) for c in more)], ["id", "host", "path", "x", *more])

    idt = docs.schema[id_col].dataType.simpleString()
    feats = written(spread(rows).mapInArrow(run, f"id {idt}, host string, path string, x array<double>" + "".join(f", {c} string" for c in more)), "quality-features")
    model = None
    if labels is not None:
        marked = labels.filter("quality in (0, 1)").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
        marked = written(marked.withColumn("h", F.xxhash64("id")), "quality-labels")
        # the smallest hashes: first a share of the hashes that holds enough of them, then the exact bound
        bound = min(2**63 - 1, -(2**63) + int(min(1.0, 1.5 * fit_rows / max(marked.count(), 1)) * 2**64))
        few = marked.filter(F.col("h") <= bound).orderBy("h", "id").limit(fit_rows)
        # one row of each id, however often it occurs
        known = feats.join(few, "id").groupBy("id", "quality").agg(F.min("x").alias("x")).orderBy("id").collect()
        y = np.array([r["quality"] for r in known], float)
        if 0 < y.sum() < len(y):
            model = fit(np.array([r["x"] for r in known]), y)
    feats = feats.select("id", "host", "path", evidence(F.col("x"), model).alias("evidence"), *more).withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    # sums by path, then host, then all: each level is far smaller than the one below
    paths = feats.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("p").alias("good"))
    paths = written(paths, "quality-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good")), "quality-hosts")
    top = hosts.agg(F.coalesce((F.sum("host_good") + 1) / (F.sum("host_n") + 2), F.lit(0.5)).alias("mean")).first()["mean"]
    hosts = hosts.withColumn("mean", F.lit(float(top)))
    k_host = float(hosts.agg(_strength(hosts, "mean", "host_n", "host_good").alias("k")).first()["k"] or 1.0)
    both = paths.join(hosts, "host").withColumn("own", F.col("host_good") / F.col("host_n"))
    k_path = float(both.agg(_strength(both, "own", "n", "good").alias("k")).first()["k"] or 1.0)
    sites = written(both.select("host", "path", "n", "good", "host_n", "host_good"), "quality-sites")
    out = feats.join(sites, ["host", "path"])
    # without the document itself
    host_post = (F.lit(k_host * float(top)) + F.col("host_good") - F.col("p")) / (k_host + F.col("host_n") - 1)
    out = out.withColumn("host_posterior", host_post)
    path_post = (k_path * F.col("host_posterior") + F.col("good") - F.col("p")) / (k_path + F.col("n") - 1)
    out = out.withColumn("path_posterior", path_post)
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + _logit(F.col("path_posterior"))))))
    return out.select(F.col("id").alias(id_col), "host", "path", "evidence", "host_posterior", "path_posterior", "score", (F.col("score") >= threshold).alias("accepted"), *more)

