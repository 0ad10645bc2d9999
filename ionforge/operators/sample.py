"""Seeded samples, numbered rows, slices and permutations, accuracy, and planes through the vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order in which rows are numbered, and rows among which their bounds are chosen.
RANGES, SAMPLE = 200, 20_000
#: Cuts that are passed over at once when a row's range is looked for.
STEP = 14
#: A prime below 2**31, and rounds of the permutation.
PRIME, ROUNDS = 2_147_483_647, 4
#: Times that a number beyond the range is permuted again, at most.
WALKS = 64


def seeded(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows in an order that depends on seed and key only: the same rows for any partitions."""
    return df.orderBy(F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def _place(cuts: Column, n: int, key: Column) -> Column:
    """How many of the ``n`` ascending cuts are not above the key: every STEP-th cut is compared, then those behind the last of them."""
    coarse = F.array(*(F.get(cuts, F.lit(i)) for i in range(0, n, STEP)))
    own = F.size(F.filter(coarse, lambda c: c <= key))
    return F.when(own == 0, 0).otherwise(_let((own - 1) * STEP + 1, lambda base: base + F.size(F.filter(F.slice(cuts, base + 1, STEP - 1), lambda c: c <= key))))


def numbered(df: DataFrame, *order: str, name: str = "k", ranges: int = RANGES, places: tuple[int, int] | None = None) -> DataFrame:
    """Adds ``name``: each row's place from 0 in the order of its columns, nulls first.

    Rows are dealt to ranges of the order, whose bounds are rows of a sample
    drawn by hash; within a range they are numbered by a window, and only the
    ranges' sizes meet in one task.  The numbers don't depend on bounds or
    partitions, provided that no two rows agree in all columns of ``order``.
    With ``places`` only the ranges that reach into these places are numbered.
    """
    key = F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    drawn = df.filter(F.pmod(F.xxhash64(*order), F.lit(max(1, -(-df.count() // SAMPLE)))) == 0).select(key.alias("o")).orderBy("o").collect()  # about SAMPLE rows
    cuts = [drawn[len(drawn) * i // ranges].o for i in range(1, ranges)] if drawn else []
    kind = df.select(key.alias("o")).schema["o"].dataType
    part, own, before = "__range", "__own", "__before"
    above = F.array(*(F.struct(*(F.lit(v).alias(f.name) for v, f in zip(c, kind.fields, strict=True))).cast(kind) for c in dict.fromkeys(cuts)))
    rows = df.withColumn(part, _place(above, len(dict.fromkeys(cuts)), key) if cuts else F.lit(0))
    sizes = rows.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select(part, F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before), "n")
    if places:
        sizes = sizes.filter((F.col(before) < places[1]) & (F.col(before) + F.col("n") > places[0])).persist()  # at most a row for each range
        rows = rows.join(F.broadcast(sizes.select(part)), part, "left_semi")
    sizes = sizes.drop("n")
    rows = rows.withColumn(own, F.row_number().over(Window.partitionBy(part).orderBy(*(F.col(c).asc_nulls_first() for c in order))) - 1)
    return rows.join(F.broadcast(sizes), part).withColumn(name, F.col(before) + F.col(own)).drop(part, own, before)


def row_slice(df: DataFrame, start: int, stop: int, *order: str) -> DataFrame:
    """The rows at the places ``start`` to ``stop``, the latter excluded, in the order of these columns."""
    at = "__place"
    return numbered(df, *order, name=at, places=(start, stop)).filter((F.col(at) >= start) & (F.col(at) < stop)).drop(at)


def permutation_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A factor and a summand for each round."""
    x, out = seed % PRIME, []
    for _ in range(2 * rounds):
        x = (x * 48_271 + 11) % PRIME
        out.append(1 + x % (PRIME - 1))
    return list(zip(out[::2], out[1::2], strict=True))


def sides(n: int) -> tuple[int, int]:
    """Two numbers whose product is the least of this kind that is ``n`` or more."""
    a = max(1, math.isqrt(n))
    a += a * a < n
    return a, max(1, -(-n // a))


def permuted(k: Column, n: int, seed: int) -> Column:
    """Another number below ``n`` for each number below ``n``: a permutation, known from ``n`` and ``seed`` alone.

    A number is a pair of remainders, of which each round adds a hash of the one
    to the other, which can be undone.  The pairs may be more than ``n`` by less
    than a row of them; a result beyond ``n`` is permuted again, until one is below.
    """
    a, b = sides(n)

    def shuffled(x: Column) -> Column:
        pair = F.struct(F.call_function("div", x, F.lit(b)).alias("l"), (x % b).alias("r"))
        for i, (factor, summand) in enumerate(permutation_keys(seed)):

            def turned(p: Column, factor=F.lit(factor).cast("long"), summand=F.lit(summand).cast("long"), left=i % 2 == 0) -> Column:
                v = ((p.r if left else p.l) * factor + summand) % PRIME
                h = (v * v) % PRIME
                l, r = ((p.l + h) % a, p.r) if left else (p.l, (p.r + h) % b)
                return F.struct(l.alias("l"), r.alias("r"))

            pair = _let(pair, turned)
        return _let(pair, lambda p: p.l * b + p.r)

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), shuffled(k.cast("long")), lambda x, _: F.when(x < n, x).otherwise(shuffled(x)))
    return _let(walked, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("no number below the bound was reached")).cast("long")))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def stacked(df: DataFrame, times: int = 2) -> DataFrame:
    """The rows ``times`` times, with ``copy`` from 0."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def accuracy(df: DataFrame, truth: str, found: str) -> DataFrame:
    """The share of rows where both agree; rows without a truth count as wrong."""
    return df.agg(F.avg(F.coalesce(F.col(truth) == F.col(found), F.lit(False)).cast("int")).alias("accuracy"))


def plane(df: DataFrame, vector: str = "embedding", k: int = 2) -> DataFrame:
    """Adds ``projection``, the first ``k`` principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = df.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="__v", outputCol="__p").fit(ready)
    return model.transform(ready).withColumn("projection", vector_to_array("__p")).drop("__v", "__p")
