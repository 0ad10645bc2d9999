"""Operator 4, MinHash near-dedup by min-max hashing.

A document's set holds its distinct word shingles.  Under each permutation both
the least and the greatest value are kept, so half as many permutations give a
signature of a certain length.  ``bands`` bands of ``rows`` values make the
buckets.

* Equal word sequences are one class, known by its 128-bit fingerprint, and one
  node of a number of its own, whatever the rows' ids.
* Each node is compared with one hub, the least node of a bucket, and of its
  buckets' hubs with that of which it shares most buckets.  Near copies become
  one component by one comparison each.
* Buckets that then still hold several components have their members compared
  with the bucket's hub, if that is of another component.
* What is left are pairs of one bucket in different components.  Members outside
  a bucket's largest component are compared with those of other components,
  unless sizes exclude a link, or ``BITS`` min-max values of one bit each differ
  in more places than :func:`most_differing` allows.  They meet in blocks, and
  only the numbers of pairs that are left go on: in a family of texts just below
  the threshold these are still most of its pairs.

Comparisons are exact, on the full sets of 64-bit shingle hashes.  A hub's text
is sent once to each ``HUB_ROWS`` of the nodes that are compared with it, and
they pass it one by one.

What can be lost, for a link at the threshold of 0.8 and permutations that are
random and independent of each other: both values of a permutation agree with a
probability of 0.6 at least, whatever the set's size (least for sets of 4 and
5), and each of them with 0.8 (:func:`least_agreement`).  As two neighbouring
bands share one permutation, all 64 bands fail with a probability below 3e-10
(:func:`most_missed`).  The bits exclude a link with a probability below 1e-10,
by Chernoff's bound, which holds for any size.
So a link is lost with a probability below 4e-10, and only where no other links
join its components.

Defined results: null and empty texts and texts without words have an empty
set and are linked with nothing; rows that repeat a document are copies of it.
Rows are judged one by one: rows that repeat an id with another text have the
component of their own text.  A null id is a component of its own; an empty
table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, drop_written, mixed, rows_with_keys, shingles, sliced, spread, with_workers, written
from .graph import components, relabelled

BANDS, ROWS = 64, 5
#: Min-max values of one bit, kept for documents in buckets with several components.
BITS = 4352
#: Nodes to which a hub's text is sent once.
HUB_ROWS = 500
#: Members of a bucket that meet in one block, about, and pairs of them that are tested at once.
BLOCK, CHUNK = 512, 1 << 14
#: Texts of a file.
TEXT_ROWS = 20_000
_WORDS = Words(SPACED)


def signatures(h: np.ndarray, row: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
    """(n, bands) hashes of the bands of min-max signatures; ``row`` ascends and has every number."""
    perms = -(-bands * rows // 2)
    rng = np.random.Generator(np.random.PCG64(11))
    a = rng.integers(1, 2**32, perms, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, perms, dtype=np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    first = np.searchsorted(row, np.arange(n))
    sig = np.empty((2 * perms, n), np.uint32)
    y = np.empty_like(x)
    with np.errstate(over="ignore"):
        for k in range(perms):
            np.multiply(x, a[k], out=y)
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            y += b[k]
            sig[2 * k] = np.minimum.reduceat(y, first)
            sig[2 * k + 1] = np.maximum.reduceat(y, first)
        out = np.empty((n, bands), np.uint64)
        for j in range(bands):
            x64 = np.full(n, j + 1, np.uint64)
            for k in range(rows):
                x64 = mixed(x64 + sig[j * rows + k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[:, j] = x64
    return out


def bit_signatures(h: np.ndarray, row: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """(n, bits / 64) words of one bit from each min-max value."""
    rng = np.random.Generator(np.random.PCG64(13))
    x = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    first = np.searchsorted(row, np.arange(n))
    out = np.zeros((n, bits // 64), np.uint64)
    y, z = np.empty_like(x), np.empty_like(x)
    with np.errstate(over="ignore"):
        for k in range(bits // 2):
            a, b = rng.integers(1, 2**32, 2, dtype=np.uint32)
            np.multiply(x, a | np.uint32(1), out=y)
            np.right_shift(y, np.uint32(15), out=z)
            y ^= z
            y *= np.uint32(0x2C1B3C6D)
            y += b
            for j, v in ((2 * k, np.minimum.reduceat(y, first)), (2 * k + 1, np.maximum.reduceat(y, first))):
                v = (v * np.uint32(0x297A2D39)) >> np.uint32(31)
                out[:, j // 64] |= v.astype(np.uint64) << np.uint64(j % 64)
    return out


def least_agreement(percent: int) -> float:
    """The least probability that both values of a permutation agree for a link at the threshold, over all sizes.

    With ``c`` of ``u`` shingles in common both agree if neither the first nor
    the last of the union is one of the others: c (c - 1) / (u (u - 1)).
    """
    both = ((-(-percent * u // 100), u) for u in range(2, 1000))
    return min(c * (c - 1) / (u * (u - 1)) for c, u in both if c < u)


def most_missed(percent: int, bands: int = BANDS, rows: int = ROWS) -> float:
    """A bound of the probability that a link at the threshold shares no band."""
    one, two = percent / 100, least_agreement(percent)
    half = two ** (rows // 2)
    if rows % 2 == 0:
        return (1 - half) ** bands
    # a permutation gives its least value to one band and its greatest to the next
    neighbours = two * (1 - half) ** 2 + 2 * (one - two) * (1 - half) + (1 - 2 * one + two)
    return neighbours ** (bands // 2) * (1 - half * one) ** (bands % 2)


def most_differing(percent: int, bits: int = BITS, loss: float = 1e-10) -> int:
    """Bits that a link exceeds with a probability below ``loss``.

    A value differs with the probability q = 1 - similarity, and then its bit
    does so half the time.  Both values of a permutation agree with
    c (c - 1) / (u (u - 1)) <= (c / u)**2, so both differ with q**2 at most, and
    the moments of the sum are at most those of independent bits: Chernoff's
    bound of a binomial sum holds for sets of any size.
    """
    q = (1 - percent / 100) / 2
    k = math.ceil(bits * q) + 1
    while bits * (k / bits * math.log(k / bits / q) + (1 - k / bits) * math.log((1 - k / bits) / (1 - q))) < -math.log(loss):
        k += 1
    return k - 1


def _sets(texts: pa.Array, n: int):
    """(first row, rows, hashes, row of each) of the distinct shingles of texts, some texts at a time; hashes ascend within a row."""
    for first, at, data in _WORDS.chunks(texts):
        m = len(at) - 1
        h, _, _, row = _WORDS.split(at, data)
        s, at_row = shingles(h, row, m, n)
        order = np.lexsort((s, at_row))
        s, at_row = s[order], at_row[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (at_row[1:] != at_row[:-1])
        yield first, m, s[new], at_row[new], h, row


def _longs(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists of longs."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.view(np.int64).ravel()))


def _bits(texts: DataFrame, n: int) -> DataFrame:
    """node and the bit signature of its text's set."""

    def run(batches):
        for b in sliced(batches):
            out = np.zeros((b.num_rows, BITS // 64), np.uint64)
            for first, _, s, at_row, _, _ in _sets(b.column(1), n):
                if len(s):
                    some = np.unique(at_row)
                    out[first + some] = bit_signatures(s, np.searchsorted(some, at_row), len(some))
            yield pa.RecordBatch.from_arrays([b.column(0), _longs(out)], ["node", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, bits array<long>")


def _sketch(df: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """id, hash of the text, size of the set, fingerprint of the word sequence (two longs), bands."""

    def run(batches):
        for b in sliced(batches):
            texts = b.column(2)
            size, f1, f2 = (np.zeros(len(texts), np.int64) for _ in range(3))
            sig = np.zeros((len(texts), bands), np.uint64)
            for first, m, s, at_row, h, row in _sets(texts, n):
                if not len(h):
                    continue
                count = np.bincount(row, minlength=m)
                place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
                some = np.flatnonzero(count)
                begin = (np.cumsum(count) - count)[some]
                with np.errstate(over="ignore"):
                    for f, c in ((f1, 0x9E3779B97F4A7C15), (f2, 0xC2B2AE3D27D4EB4F)):
                        v = mixed(h + place.astype(np.uint64) * np.uint64(c))
                        f[first + some] = np.add.reduceat(v, begin).view(np.int64)
                size[first : first + m] = np.bincount(at_row, minlength=m)
                dense = np.cumsum(np.concatenate([[0], (at_row[1:] != at_row[:-1]).astype(np.int64)]))
                sig[first + some] = signatures(s, dense, len(some), bands, rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size), pa.array(f1), pa.array(f2), _longs(sig)], ["id", "t", "size", "f1", "f2", "bands"])

    return df.select("id", "t", "text").mapInArrow(run, "id long, t long, size long, f1 long, f2 long, bands array<long>")


def _confirm(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Adds ``linked`` to (a, b), from the full sets of both texts.

    Pairs are dealt by their hub ``a``, at most about HUB_ROWS of them together.
    """
    counts = pairs.groupBy("a").agg(F.expr(f"count(1) div {HUB_ROWS}").alias("last"))
    dealt = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("last") + 1).alias("part"), "b", F.col("b").alias("node"))
    hubs = counts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    texts = rows_with_keys(texts, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))), ["node"], exact=False)
    rows = hubs.unionByName(dealt).join(texts, "node").select("a", "part", "b", "text")
    rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "text")

    def run(batches):
        hub = None
        for b in sliced(batches):
            a, member = b.column(0).to_numpy(), b.column(1)
            is_hub = member.is_null().to_numpy(zero_copy_only=False)
            linked = np.zeros(b.num_rows, bool)
            for first, m, s, at_row, _, _ in _sets(b.column(2), n):
                size = np.bincount(at_row, minlength=m)
                ends = np.concatenate([[0], np.cumsum(size)])
                # rows of one hub follow it, here or among the texts before
                starts = np.flatnonzero(is_hub[first : first + m]).tolist()
                if not starts or starts[0]:
                    starts.insert(0, 0)
                for lo, hi in zip(starts, [*starts[1:], m], strict=True):
                    if is_hub[first + lo]:
                        hub = s[ends[lo] : ends[lo + 1]]
                        lo += 1
                    if hi > lo:
                        linked[first + lo : first + hi] = _like(hub, s[ends[lo] : ends[hi]], at_row[ends[lo] :], size, percent, lo, hi)
            some = ~is_hub
            yield pa.RecordBatch.from_arrays([pa.array(a[some]), member.filter(pa.array(some)), pa.array(linked[some])], ["a", "b", "linked"])

    return rows.mapInArrow(run, "a long, b long, linked boolean")


def _like(hub: np.ndarray, s: np.ndarray, row: np.ndarray, size: np.ndarray, percent: int, lo: int, hi: int) -> np.ndarray:
    """Whether the sets of rows ``lo`` to ``hi``, whose hashes are ``s``, are linked with the hub's."""
    if not len(hub):
        return np.zeros(hi - lo, bool)
    at = np.minimum(np.searchsorted(hub, s), len(hub) - 1)
    common = np.bincount(row[: len(s)][hub[at] == s] - lo, minlength=hi - lo)
    return (common > 0) & (100 * common >= percent * (len(hub) + size[lo:hi] - common))


def _open(members: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The rows (key, node, hub, component) of buckets with more than one component."""
    rows = members.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    keys = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return written(rows.join(keys, "key", "left_semi"), "near-open", most)


def _rest(open_: DataFrame, nodes: DataFrame, texts: DataFrame, n: int, percent: int, most: int) -> DataFrame:
    """The pairs (a, b) of nodes of one bucket and different components that may be links.

    A bucket's members meet in blocks of about BLOCK, by whole arrays; of their
    pairs only the numbers of those leave a task that no test excludes.
    """
    counts = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.ceil(F.sum("n") / BLOCK).alias("parts"))
    wanted = written(open_.select("node").distinct(), "near-wanted", most)
    marks = _bits(rows_with_keys(texts, wanted, ["node"], exact=False), n).join(rows_with_keys(nodes, wanted, ["node"], exact=False).select("node", "size", "bands"), "node")
    marks = written(marks, "near-marks", most, TEXT_ROWS)
    # only members outside a bucket's largest component are compared, with those of other components
    rows = open_.select("key", "node", "component").join(keys, "key").withColumn("main", F.col("component") == F.col("main"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).join(marks, "node")
    blocks = rows.groupBy("key", "parts", "part").agg(F.collect_list(F.struct("node", "component", "main", "size", "bands", "bits")).alias("m"))
    large = blocks.filter("parts > 1")
    met = large.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1))).filter("other > part")
    met = met.join(large.select("key", F.col("part").alias("other"), F.col("m").alias("m2")), ["key", "other"])
    schema = "a long, b long"
    return blocks.select("key", "m").mapInArrow(_able(percent), schema).unionByName(met.select("key", "m", "m2").mapInArrow(_able(percent), schema))


def _members(col: pa.Array) -> tuple[np.ndarray, ...]:
    """Of a block: nodes, components, whether each is of the main one, sizes, bands and bits, the latter without a sign, as the bits of a negative number are not counted."""
    flat = col.flatten()
    plain = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "component", "main", "size")]
    bands, bits = (flat.field(c).flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1) for c in ("bands", "bits"))
    return *plain, bands, bits.view(np.uint64)


def _able(percent: int):
    """The pairs of a block, or of two, that sizes and bits allow to be links, each in the first bucket that it shares."""

    def run(batches):
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            for row, key in enumerate(keys):
                node, component, main, size, bands, bits = left = _members(b.column(1).slice(row, 1))
                node2, component2, main2, size2, bands2, bits2 = right = _members(b.column(2).slice(row, 1)) if b.num_columns > 2 else left
                fit = (component[:, None] != component2) & ~(main[:, None] & main2) & (100 * np.minimum(size[:, None], size2) >= percent * np.maximum(size[:, None], size2))
                if right is left:
                    fit = np.triu(fit, 1)
                band = int((bands[0] == key).argmax())
                i, j = np.nonzero(fit)
                for at in range(0, len(i), CHUNK):
                    x, y = i[at : at + CHUNK], j[at : at + CHUNK]
                    new = ~(bands[x, :band] == bands2[y, :band]).any(1)
                    x, y = x[new], y[new]
                    near = np.bitwise_count(bits[x] ^ bits2[y]).sum(1) <= most_differing(percent)
                    p, q = node[x[near]], node2[y[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], ["a", "b"])

    return run


def _links(keys: DataFrame, nodes: DataFrame, texts_of, n: int, percent: int, count: int) -> DataFrame | None:
    """The components (node, component) of ``keys`` (key, node), or None where no bucket holds two nodes."""
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub")
    members = written(keys.join(hubs, "key"), "near-members")
    rows = members.count()
    if not rows:
        return None
    texts = texts_of(members.select("node").distinct())
    shared = members.filter("node != hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = shared.groupBy("node").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("hub"))
    tested = written(_confirm(written(best.select(F.col("hub").alias("a"), F.col("node").alias("b")), "near-pairs", count), texts, n, percent), "near-tested", count, TEXT_ROWS)
    labels = components(tested.filter("linked"), count)
    open_ = _open(members, labels, rows)
    if not open_.isEmpty():
        hubs = open_.filter("node = hub").select("key", F.col("component").alias("other"))
        pairs = open_.join(hubs, "key").filter("component != other").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "near-pairs", rows)
        again = written(_confirm(pairs, texts, n, percent), "near-tested", rows, TEXT_ROWS)
        labels = relabelled(labels, again.filter("linked"), count)
        open_ = _open(open_.drop("component"), labels, rows)
        if not open_.isEmpty():
            tested = tested.unionByName(again).select("a", "b")
            pairs = written(_rest(open_, nodes, texts, n, percent, rows).join(tested, ["a", "b"], "left_anti"), "near-pairs", rows, TEXT_ROWS)
            last = written(_confirm(pairs, texts, n, percent), "near-tested", rows, TEXT_ROWS)
            labels = relabelled(labels, last.filter("linked"), count)
    drop_written(texts)
    drop_written(members)
    return labels


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    spark = df.sparkSession
    with_workers(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("t", F.xxhash64("text"))
    sketch = written(_sketch(spread(docs), n, bands, rows), "near-sketch")
    count = sketch.count()
    # equal word sequences have one node, which stands for a row by its id and text
    classes = sketch.filter("size > 0 and id is not null").groupBy("f1", "f2").agg(F.min_by(F.struct("id", "t", "bands"), F.struct("id", "t")).alias("x"), F.min("size").alias("size"), F.count(F.lit(1)).alias("n"))
    nodes = written(classes.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "x.*", "size", "n"), "near-nodes", count, TEXT_ROWS)

    def texts_of(wanted: DataFrame) -> DataFrame:
        wanted = written(nodes.select("node", "id", "t").join(wanted, "node", "left_semi"), "near-wanted", count)
        found = rows_with_keys(docs, wanted, ["id", "t"], exact=False).groupBy("id", "t").agg(F.min("text").alias("text"))
        return written(found.join(wanted, ["id", "t"]).select("node", "text"), "near-texts", count, TEXT_ROWS)

    labels = _links(nodes.select("node", F.explode("bands").alias("key")), nodes, texts_of, n, percent, count)
    of = nodes.select("node", "f1", "f2", "id", "n")
    if labels is None:
        of = of.filter("n > 1").select("f1", "f2", F.col("id").alias("component"))
    else:
        of = of.join(labels, "node", "left")
        least = of.filter("component is not null").groupBy("component").agg(F.min("id").alias("least"))
        of = of.filter("n > 1 or component is not null").join(least, "component", "left").select("f1", "f2", F.coalesce("least", "id").alias("component"))
    of = written(of, "near-classes", count)
    drop_written(nodes)
    out = sketch.drop("bands", "t").join(of, ["f1", "f2"], "left")
    component = F.when((F.col("size") > 0) & F.col("component").isNotNull() & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("size").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
