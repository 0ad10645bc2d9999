"""Operator 11, hard negatives by dual-tree search.

Every row is put into a cell by a tree of balls whose top is fitted on
``FIT_ROWS`` rows: a node parts its rows by the direction between two far ones,
at the median.  A cell's rows make blocks of about ``BLOCK`` rows, each one a
row of a written table; a task grows the lower part of the tree within each
block.  Anchors are taken in waves of about ``WAVE`` rows, each wave with a tree
of its own, which is broadcast, and each wave meets the blocks where they lie.

Two trees meet level by level: of each pair of nodes the inner product lies
within <c, d> -+ (|c| s + |d| r + r s), for balls with centres c, d and radii
r, s.  The pair is left out, for all anchors of the node at once, where that
interval shows that no score can count.  Leaf pairs are scored exactly.

* Positives: an upper end below the fifth best score that every anchor of the
  node has already, or blocks without a label of the node.
* Negatives: an interval outside what the anchors' positives admit
  (30 * positive <= 100 * negative <= 90 * positive), or below the tenth best
  score that every anchor and positive of the node has already.

The bests of the rows on which the tree is fitted are looked up first, once for
each anchor.  They are rows like others, so what they reach holds for the whole
table as a lower bound, which every task starts with.  Scores are integers,
exact in float64 as long as their bound allows, and in 64-bit integers
otherwise.  A task keeps the bests of a wave, five and fifty a row, and sends
them once.

Defined results: rows with a null id, label or vector, and those with a null or
non-finite component, or one of size 2**16 or more, take no part.  A vector
shorter than the longest counts as padded with zeros.  Of rows that share an id
the one with the least label, then vector, counts; repeated rows are so one
row.  An anchor without another row of its label has no row in the result, and
neither has a positive whose score admits no negative.  Columns other than the
three are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_with_keys, rows_without_keys, with_workers, written

#: Rows on which the top of the tree is fitted, and which give first bests.
FIT_ROWS = 8192
#: Rows of a block at most, on average; rows of a leaf.
BLOCK, LEAF = 4096, 32
#: Anchors of a wave; at 64 dimensions a broadcast of some 50 MB.
WAVE = 1 << 16
#: Positives of an anchor, and negatives of a positive.
N_POSITIVE, N_NEGATIVE = 5, 10
#: The least and greatest hundredths of a positive's score that a negative may have.
LOW, HIGH = 30, 90
#: Components are multiplied by it and rounded down.
SCALE = 256
#: Components of this size and beyond take no part.
LIMIT = 1 << 16
#: Levels of the tree's top at most.
DEPTH = 12
#: No score is as small.
NONE = -(1 << 62)


def prepared(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, label, codes) of the rows that take part, one row an id."""
    x = F.transform(vector_col, lambda v: v.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    rows = rows.filter("id is not null and label is not null and x is not null").filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= LIMIT)))
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("id", label.alias("label"), F.transform("x", lambda v: F.floor(v * SCALE).cast("int")).alias("codes"))
    repeated = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"), "negatives-repeated")
    one = rows_with_keys(rows, repeated, ["id"]).groupBy("id").agg(F.min(F.struct("label", "codes")).alias("r")).select("id", "r.label", "r.codes")
    return rows_without_keys(rows, repeated, ["id"]).unionByName(one)


# ------------------------------------------------------------------- the trees


def _halves(v: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction between two far rows, and the median along it."""
    far = v[((v - v.mean(0)) ** 2).sum(1).argmax()]
    other = v[((v - far) ** 2).sum(1).argmax()]
    along = other - far
    return along, float(np.median(v @ along))


@dataclass
class Top:
    """The tree's top: a direction and a cut for each inner node, numbered as in a heap."""

    along: np.ndarray
    cut: np.ndarray

    @classmethod
    def fitted(cls, v: np.ndarray, depth: int) -> Top:
        along, cut = np.zeros((2**depth - 1, v.shape[1])), np.zeros(2**depth - 1)
        parts = {0: v}
        for node in range(2**depth - 1):
            part = parts.pop(node)
            if len(part) > 1:
                along[node], cut[node] = _halves(part)
            right = part @ along[node] > cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[~right], part[right]
        return cls(along, cut)

    def cells(self, v: np.ndarray) -> np.ndarray:
        node = np.zeros(len(v), np.int64)
        while len(self.cut) and node.max(initial=0) < len(self.cut):
            node = 2 * node + 1 + ((v * self.along[node]).sum(1) > self.cut[node])
        return node - len(self.cut)


@dataclass
class Tree:
    """Rows in the order of a balanced tree; node k of a level has rows ``edges[level][k]`` to the next edge."""

    order: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    edges: list
    centre: list
    radius: list

    @classmethod
    def grown(cls, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> Tree:
        order = np.arange(len(v))
        levels = [np.array([0, len(v)])]
        while np.diff(levels[-1]).max() > LEAF:
            e = levels[-1]
            cuts = [0]
            for a, b in zip(e[:-1], e[1:], strict=True):
                part = v[order[a:b]]
                order[a:b] = order[a:b][np.argsort(part @ _halves(part)[0], kind="stable")]
                cuts += [(a + b) // 2, b]
            levels.append(np.array(cuts))
        v = v[order]
        centre, radius = [], []
        for e in levels:
            c = np.add.reduceat(v, e[:-1], axis=0) / np.diff(e)[:, None]
            own = np.repeat(np.arange(len(c)), np.diff(e))
            centre.append(c)
            radius.append(np.sqrt(np.maximum.reduceat(((v - c[own]) ** 2).sum(1), e[:-1])))
        return cls(order, ids[order], labels[order], v, levels, centre, radius)

    def least(self, of_rows: np.ndarray) -> list:
        """For each level the least of a value of each node's rows."""
        return [np.minimum.reduceat(of_rows, e[:-1]) for e in self.edges]


def _meetings(a: Tree, b: Tree, counts) -> list[tuple[int, np.ndarray]]:
    """(leaf of ``a``, leaves of ``b``) that no interval excludes; ``counts(level, i, low, high)`` says which pairs count."""
    i, j = np.zeros(1, np.int64), np.zeros(1, np.int64)
    x = y = 0
    while True:
        c, d, r, s = a.centre[x], b.centre[y], a.radius[x][i], b.radius[y][j]
        mid = (c @ d.T)[i, j]
        slack = np.sqrt((c * c).sum(1))[i] * s + np.sqrt((d * d).sum(1))[j] * r + r * s
        slack += 1e-9 * (np.abs(mid) + slack) + 1e-6
        keep = counts(x, i, mid - slack, mid + slack)
        i, j = i[keep], j[keep]
        deeper_a, deeper_b = x + 1 < len(a.edges), y + 1 < len(b.edges)
        if not len(i) or not (deeper_a or deeper_b):
            break
        if deeper_a:
            i, j, x = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j]), x + 1
        if deeper_b:
            i, j, y = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1]), y + 1
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    at = np.flatnonzero(np.diff(i, prepend=-1))
    return [(int(i[k]), part) for k, part in zip(at, np.split(j, at[1:]), strict=True)] if len(i) else []


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


class _Bests:
    """For each of ``n`` keys the ``k`` best (score, id): greater scores first, then smaller ids."""

    def __init__(self, n: int, k: int, least: np.ndarray | None) -> None:
        self.k = k
        self.score, self.id = np.full((n, k), NONE), np.full((n, k), NONE)
        self.given = np.full(n, NONE) if least is None else least

    def least(self) -> np.ndarray:
        """What a candidate of each key has to reach."""
        return np.maximum(self.score[:, -1], self.given)

    def add(self, keys: np.ndarray, score: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        """Candidates of ``keys``, a row of ``score`` each; ``fit`` says which count."""
        fit = fit & (score >= np.maximum(self.score[keys, -1], self.given[keys])[:, None])
        some = np.flatnonzero(fit.any(1))
        if not len(some):
            return
        keys, score, fit = keys[some], np.where(fit[some], score[some], NONE), None
        if score.shape[1] > 2 * self.k:
            # ids ascend, so that of equal scores the first columns are the better ones
            kth = np.partition(score, score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
            above, equal = score > kth[:, None], score == kth[:, None]
            take = above | (equal & (np.cumsum(equal, 1) <= self.k - above.sum(1)[:, None]))
            cols = np.nonzero(take)[1].reshape(len(keys), self.k)
            score, new = np.take_along_axis(score, cols, 1), ids[cols]
        else:
            new = np.broadcast_to(ids, score.shape)
        score = np.concatenate([self.score[keys], score], axis=1)
        new = np.concatenate([self.id[keys], np.where(score[:, self.k :] == NONE, NONE, new)], axis=1)
        order = np.lexsort((new, -score), axis=1)[:, : self.k]
        self.score[keys], self.id[keys] = np.take_along_axis(score, order, 1), np.take_along_axis(new, order, 1)


class _Search:
    """What a task knows of one wave of anchors.

    ``positive`` has the scores of the anchors' positives, without it these are
    searched; ``least`` what a candidate has to reach in any case.
    """

    def __init__(self, wave: Tree, positive: np.ndarray | None = None, least: np.ndarray | None = None) -> None:
        self.wave, self.positive = wave, positive
        n = len(wave.ids)
        if positive is None:
            self.bests = _Bests(n, N_POSITIVE, least)
        else:
            # 30 * positive <= 100 * negative <= 90 * positive, for every anchor and positive; an absent one admits nothing
            absent = positive == NONE
            p = np.where(absent, -1, positive)
            self.low, self.high = np.where(absent, 1, -((-LOW * p) // 100)), np.where(absent, 0, (HIGH * p) // 100)
            self.bests = _Bests(n * N_POSITIVE, N_NEGATIVE, least)
            self.top = [np.maximum.reduceat(np.where(self.low <= self.high, self.high, NONE).max(1), e[:-1]) for e in wave.edges]

    def meet(self, block: Tree) -> None:
        wave = self.wave
        if self.positive is None:
            shared = np.isin(wave.labels, block.labels)
            if not shared.any():
                return
            # an anchor whose label the block lacks needs nothing of it
            need = wave.least(np.where(shared, self.bests.least(), -NONE))
            pairs = _meetings(wave, block, lambda x, i, low, high: high >= need[x][i])
        else:
            worst = self.bests.least().reshape(self.low.shape)
            need = wave.least(np.where(self.low <= self.high, np.maximum(self.low, worst), -NONE).min(1))
            pairs = _meetings(wave, block, lambda x, i, low, high: (high >= need[x][i]) & (low <= self.top[x][i]))
        mine, theirs = wave.edges[-1], block.edges[-1]
        for leaf, leaves in pairs:
            rows = np.arange(mine[leaf], mine[leaf + 1])
            cols = np.concatenate([np.arange(theirs[k], theirs[k + 1]) for k in leaves])
            cols = cols[np.argsort(block.ids[cols], kind="stable")]
            self.score(rows, _scores(wave.v[rows], block.v[cols]), block.ids[cols], block.labels[cols])

    def score(self, rows: np.ndarray, s: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        same = self.wave.labels[rows][:, None] == labels
        if self.positive is None:
            self.bests.add(rows, s, ids, same & (self.wave.ids[rows][:, None] != ids))
            return
        for k in range(N_POSITIVE):
            low, high = self.low[rows, k][:, None], self.high[rows, k][:, None]
            self.bests.add(rows * N_POSITIVE + k, s, ids, ~same & (s >= low) & (s <= high))


# ------------------------------------------------------------------ Spark's part


def _matrix(col: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of ``width`` float64 numbers, padded with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    out = np.zeros((len(col), width))
    size = np.diff(np.asarray(col.offsets)).astype(np.int64)
    row = np.repeat(np.arange(len(col)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def _numbers(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.int64) if isinstance(col, pa.Array) else col.to_numpy().astype(np.int64)


def _blocks(rows: DataFrame, top: Top, n: int, width: int) -> DataFrame:
    """(ids, labels, codes): the rows of each cell, dealt to blocks by id."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(top)
    n_cells = len(top.cut) + 1

    def cells(batches):
        for b in batches:
            at = sent.value.cells(_matrix(b.column(2), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], ["id", "label", "codes", "cell"])

    rows = rows.mapInArrow(cells, "id long, label long, codes array<int>, cell long")
    rows = written(rows, "negatives-rows")
    sizes = F.broadcast(rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / max(LEAF, min(BLOCK, n // max(1, n_cells)))).alias("parts")))  # a number for each cell
    dealt = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    packed = dealt.groupBy("cell", "part").agg(F.collect_list(F.struct("id", "label", "codes")).alias("r"))
    return written(packed.select(F.col("r.id").alias("ids"), F.col("r.label").alias("labels"), F.col("r.codes").alias("codes")), "negatives-blocks")


def _tree(table: pa.Table | pa.RecordBatch, width: int) -> Tree:
    return Tree.grown(_numbers(table.column("id")), _numbers(table.column("label")), _matrix(table.column("codes"), width))


def _lists(col: pa.Array, n: int) -> np.ndarray:
    """Lists of scores as rows of ``n``, NONE behind their ends."""
    return np.array([x + [NONE] * (n - len(x)) for x in col.to_pylist()], np.int64).reshape(-1, n)


def _search(table: pa.Table | pa.RecordBatch, width: int) -> _Search:
    """The search for a table (id, label, codes[, p][, least]) of anchors."""
    wave = _tree(table, width)
    names = table.schema.names
    positive = _lists(table.column("p"), N_POSITIVE)[wave.order] if "p" in names else None
    least = _lists(table.column("least"), 1 if positive is None else N_POSITIVE)[wave.order].ravel() if "least" in names else None
    return _Search(wave, positive, least)


def _with_least(anchors: DataFrame, first: Tree, width: int) -> DataFrame:
    """Adds ``least``: what the rows of ``first`` reach for each anchor, or each of its positives."""
    sent = anchors.sparkSession.sparkContext.broadcast(first)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            search = _search(b, width)
            search.meet(sent.value)
            least = np.empty((b.num_rows, len(search.bests.given) // b.num_rows), np.int64)
            least[search.wave.order] = search.bests.least().reshape(least.shape)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least.tolist(), pa.list_(pa.int64()))], [*b.schema.names, "least"])

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema.fields)
    return anchors.mapInArrow(run, f"{types}, least array<long>")


def _found(blocks: DataFrame, anchors: DataFrame, width: int) -> DataFrame:
    """(anchor_id, k, id, score): what each task finds best for the anchors of a wave; ``k`` is the positive's place."""
    sent = blocks.sparkSession.sparkContext.broadcast(anchors.toArrow())  # about WAVE rows
    per = N_POSITIVE if "p" in anchors.columns else 1

    def run(batches):
        search = None
        for b in batches if sent.value.num_rows else ():
            for at in range(b.num_rows):
                ids, labels, codes = (b.column(c).slice(at, 1).flatten() for c in range(3))
                search = search or _search(sent.value, width)
                search.meet(Tree.grown(_numbers(ids), _numbers(labels), _matrix(codes, width)))
        if search is None:
            return
        keys, cols = np.nonzero(search.bests.score != NONE)
        for at in range(0, len(keys), 1 << 16):
            k, c = keys[at : at + (1 << 16)], cols[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(search.wave.ids[k // per]), pa.array(k % per), pa.array(search.bests.id[k, c]), pa.array(search.bests.score[k, c])], ["anchor_id", "k", "id", "score"])

    return blocks.mapInArrow(run, "anchor_id long, k long, id long, score long")


def _best(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def hard_negatives(df: DataFrame, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", wave_rows: int = WAVE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows whose id is divisible by ``every``."""
    spark = df.sparkSession
    with_workers(spark)
    rows = written(prepared(df, id_col, vector_col, label_col), "negatives-prepared")
    n, width, n_anchors = rows.agg(F.count(F.lit(1)), F.max(F.size("codes")), F.count(F.when(F.col("id") % every == 0, 1))).first()
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width = max(1, width)
    first = _tree(rows.filter(F.pmod(F.xxhash64("id"), F.lit(-(-n // FIT_ROWS))) == 0).toArrow(), width)  # about FIT_ROWS rows
    depth = min(DEPTH, (n // BLOCK).bit_length(), max(0, (len(first.ids) // 2).bit_length() - 1))
    blocks = _blocks(rows, Top.fitted(first.v, depth), n, width)

    waves = -(-n_anchors // wave_rows)
    anchors = rows.filter(F.col("id") % every == 0).withColumn("wave", F.pmod(F.xxhash64("id"), F.lit(waves)))
    named, negatives = None, None
    for k in range(waves):
        own = anchors.filter(F.col("wave") == k).drop("wave")
        started = written(_with_least(own, first, width), "negatives-anchors")
        positives = written(_best(_found(blocks, started, width), ["anchor_id"], N_POSITIVE).select("anchor_id", (F.col("rank") - 1).cast("long").alias("k"), "id", "score"), "negatives-positives")
        listed = positives.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("k", "score"))).alias("p"))  # five at most
        known = own.join(listed, "id").select("id", "label", "codes", F.transform("p", lambda x: x.score).alias("p"))
        started = written(_with_least(known, first, width), "negatives-anchors")
        found = written(_best(_found(blocks, started, width), ["anchor_id", "k"], N_NEGATIVE), "negatives-found")
        named = positives if named is None else named.unionByName(positives)
        negatives = found if negatives is None else negatives.unionByName(found)
    named = named.select("anchor_id", "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named, ["anchor_id", "k"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
