"""A plane layout of vectors that keeps neighbourhoods: a spectral layout of a neighbour graph.

The graph is that of about ``LANDMARKS`` rows, drawn by the hash of their ids:
each is joined to its nearest ones, with weights that fall from one at the
nearest, and both directions are united.  The two slowest directions of the
random walk on it are the landmarks' coordinates.  Every row, landmarks
included, is then placed where a step of that walk takes it on average, from
its own nearest landmarks.  So fitting is bounded, whatever the rows, and all
rows are placed in one pass without a shuffle.

A small weight between all landmarks joins the graph's parts.  Rows without a
vector have null coordinates; with fewer than three landmarks all are at zero.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import workers
from . import knn

#: Rows of the graph, about; neighbours of each; the weight that joins all of them, shared among them.
LANDMARKS, NEIGHBOURS, JOINED = 1000, 15, 1e-3
_TILE = 1024


def _weights(d: np.ndarray, k: int) -> np.ndarray:
    """Of squared distances, weights of each row's ``k`` nearest columns: one at the nearest, falling with the distance beyond it."""
    d = np.sqrt(np.maximum(d, 0))
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(d, near, 1)
    own -= own.min(1, keepdims=True)
    scale = own.mean(1, keepdims=True)
    w = np.zeros_like(d)
    np.put_along_axis(w, near, np.exp(-own / np.where(scale > 0, scale, 1)), 1)
    return w


def fitted_plane(v: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Coordinates of landmarks, divided by how much a step of the walk shrinks them."""
    n = len(v)
    if n < 3:
        return np.zeros((n, 2))
    d = knn.squared_distances(v, v)
    np.fill_diagonal(d, np.inf)
    w = _weights(d, min(neighbours, n - 1))
    w = w + w.T - w * w.T + JOINED / n
    root = 1 / np.sqrt(w.sum(1))
    values, u = np.linalg.eigh(root[:, None] * w * root)
    at = [n - 2, n - 3]  # the last one is the same for all
    plane = u[:, at] * root[:, None]
    plane = plane / np.maximum(np.abs(plane).max(0), 1e-12)
    plane *= np.sign(plane[np.abs(plane).argmax(0), [0, 1]])
    return plane / np.maximum(np.abs(values[at]), 1e-6)


def spectral_plane(df: DataFrame, id_col: str = "id", vector: str = "embedding", landmarks: int = LANDMARKS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Adds ``x`` and ``y`` to the rows of ``df``."""
    workers.prepare(df.sparkSession)
    given = df.filter(F.col(vector).isNotNull())
    drawn = given.filter(F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-given.count() // landmarks)))) == 0).select(F.col(vector).alias("v")).toArrow()
    if not drawn.num_rows:
        return df.withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")})
    v = knn.vectors_of(drawn.column("v").combine_chunks())
    sent = df.sparkSession.sparkContext.broadcast((v, fitted_plane(v, neighbours)))
    names = df.columns

    def run(batches):
        marks, plane = sent.value
        for b in batches:
            for lo in range(0, b.num_rows, _TILE):
                some = b.slice(lo, _TILE)
                col = some.column("__vector")
                there = np.asarray(col.is_valid())
                out = np.full((some.num_rows, 2), np.nan)
                if there.any():
                    w = _weights(knn.squared_distances(knn.vectors_of(col.drop_null()), marks), min(neighbours, len(marks)))
                    out[there] = (w @ plane) / w.sum(1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*(some.column(n) for n in names), *(pa.array(out[:, i], mask=~there) for i in (0, 1))], [*names, "x", "y"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.withColumn("__vector", F.col(vector)).mapInArrow(run, f"{types}, x double, y double")


def preservation(before: DataFrame, after: DataFrame, queries: str, k: int = 10) -> DataFrame:
    """(n, kept): of the queries' ``k`` nearest rows before, the share that is among their ``k`` nearest after.

    Both have (id, embedding); ``queries`` is a condition on ids.
    """
    rows = lambda df: df.select("id", "embedding", F.lit(0.0).alias("mass"), F.lit(0).alias("bucket"), F.lit(False).alias("is_decoy"))
    near = [knn.knn(rows(df).filter(queries), rows(df), k, "open").select("query_id", "db_id") for df in (before, after)]
    both = near[0].join(near[1], ["query_id", "db_id"]).agg(F.count(F.lit(1)).alias("both"))
    asked = near[0].agg(F.countDistinct("query_id").alias("n"), F.count(F.lit(1)).alias("asked"))
    return asked.join(F.broadcast(both)).select("n", (F.col("both") / F.col("asked")).alias("kept"))
