"""Operator 1, variable-capacity best-fit packing.

Documents are packed into bins of several permitted lengths.  A document
longer than the largest length is cut into pieces of that length and a rest.
Packing works on the histogram of piece lengths, which has at most as many
entries as the largest length, so the plan has a bounded size whatever the
corpus: bins that look alike are handled as one class with a multiplicity.

* Best fit, longest first: pieces of a length go to the open bins with the
  least room that holds them.
* Where no open bin has room, a bin of the least cost per token it can expect
  to hold is opened; the cost of a bin is its length plus ``bin_cost``.
* All non-empty choices of permitted lengths are planned, and the plan with
  the least total cost after downsizing is taken, so the lengths are optimised
  jointly.
* At the end each bin is downsized to the smallest permitted length that holds
  its contents.

Defined results: one row per piece.  A document without tokens (null or empty
text) has one row with n_tokens 0 and null bin_id.  Repeated rows are packed
one by one; pieces of a length are ranked by a hash of id, piece and length,
dealt into parts of about ``PART_ROWS`` by it, and within a part by id and piece,
so results do not depend on the partitions.  Null ids are allowed.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, written

LENGTHS = (1024, 2048, 4096)
#: What opening a bin costs besides its tokens.
BIN_COST = 32
#: Pieces that one window ranks, about; the number of parts is bounded, so with very many pieces a window ranks more.
PART_ROWS = 2_000


def word_count(text: Column) -> Column:
    """Words between white space; a plain stand-in where no tokenizer is given."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")).cast("long")


def _pack(hist: dict[int, int], lengths: tuple[int, ...], bin_cost: int):
    """Classes [capacity, used, multiplicity, first bin] and segments (length, rank, end, bin, per bin, offset)."""
    remaining = sum(k * n for k, n in hist.items())
    by_room: dict[int, list[list[int]]] = {}
    segments, bins = [], 0
    rooms: list[int] = []
    def open_class(capacity: int, used: int, n: int, first: int) -> None:
        room = capacity - used
        if room not in by_room:
            by_room[room] = []
            insort(rooms, room)
        by_room[room].append([capacity, used, n, first])

    for length in sorted(hist, reverse=True):
        rank, n = 0, hist[length]
        while n:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                capacity, used, m, first = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[k]
                each = min(room // length, n)
                full = min(m, n // each)
                segments.append((length, rank, rank + full * each, first, each, used))
                open_class(capacity, used + each * length, full, first)
                rank, n, remaining = rank + full * each, n - full * each, remaining - full * each * length
                if m > full:
                    open_class(capacity, used, m - full, first + full)
            else:
                capacity = min((c for c in lengths if c >= length), key=lambda c: ((c + bin_cost) / min(c, max(remaining, length)), c))
                each = min(capacity // length, n)
                m = max(1, n // each)
                open_class(capacity, 0, m, bins)
                bins += m
    return [x for xs in by_room.values() for x in xs], segments


def plan(hist: dict[int, int], lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST):
    """The cheapest plan over all choices of lengths that keep the largest.

    Returns (chosen lengths, [(first bin, bins, final length, used)], segments).
    """
    lengths = tuple(sorted(set(lengths)))
    best = None
    for r in range(len(lengths)):
        for some in combinations(lengths[:-1], r):
            classes, segments = _pack(hist, (*some, lengths[-1]), bin_cost)
            sized = [(first, n, next(c for c in lengths if c >= used), used) for _, used, n, first in classes if used]
            cost = sum(n * (c + bin_cost) for _, n, c, _ in sized)
            if best is None or cost < best[0]:
                best = (cost, (*some, lengths[-1]), sized, segments)
    return best[1:]


def pack(df: DataFrame, lengths: tuple[int, ...] = LENGTHS, bin_cost: int = BIN_COST, id_col: str = "doc_id", text_col: str = "text", n_tokens: Column | None = None) -> DataFrame:
    """id, n_tokens, piece, pieces, start, length, bin_id, bin_length, bin_offset of each piece.

    ``n_tokens`` gives each document's tokens; without it words are counted.
    """
    spark = df.sparkSession
    longest = max(lengths)
    n = F.coalesce((word_count(F.col(text_col)) if n_tokens is None else n_tokens).cast("long"), F.lit(0))
    docs = written(df.select(F.col(id_col).alias("id"), n.alias("n_tokens")), "packing-lengths")
    pieces = docs.select(
        "id",
        "n_tokens",
        F.explode(F.sequence(F.lit(0), F.greatest(F.expr(f"cast((n_tokens + {longest - 1}) div {longest} as int)"), F.lit(1)) - 1)).alias("piece"),
        F.greatest(F.expr(f"cast((n_tokens + {longest - 1}) div {longest} as int)"), F.lit(1)).alias("pieces"),
    ).withColumn("start", F.col("piece").cast("long") * longest)
    pieces = pieces.withColumn("length", F.least(F.lit(longest), F.col("n_tokens") - F.col("start")).cast("int"))
    hist = {r["length"]: r["n"] for r in pieces.filter("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    _, sized, segments = plan(hist, lengths, bin_cost) if hist else ((), [], [])
    scale = max(PART_ROWS, sum(hist.values()) // (4 * longest) + 1)
    parts = spark.createDataFrame([(k, 1 + m // scale) for k, m in hist.items()], "length int, parts int")
    full = pieces.filter("length > 0").join(F.broadcast(parts), "length")
    full = full.withColumn("part", F.pmod(F.xxhash64("id", "piece", "n_tokens"), F.col("parts")).cast("int")).drop("parts")
    offsets, before = [], {}
    counts = sorted((r["length"], r["part"], r["n"]) for r in full.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    for length, part, m in counts:
        offsets.append((length, part, before.get(length, 0)))
        before[length] = before.get(length, 0) + m
    offsets = spark.createDataFrame(offsets, "length int, part int, offset long")
    ranks = spark.createDataFrame(segments, "length int, first long, end long, bin long, each long, used long")
    ranked = full.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece", "n_tokens")) - 1)
    placed = (
        ranked.join(F.broadcast(offsets), ["length", "part"])
        .withColumn("rank", F.col("rank") + F.col("offset"))
        .join(F.broadcast(ranks), "length")
        .filter("rank >= first and rank < end")
        .withColumn("bin_id", F.expr("bin + (rank - first) div each"))
        .withColumn("bin_offset", F.expr("used + ((rank - first) % each) * length"))
    )
    placed = _with_length(placed, sized)
    cols = ["id", "n_tokens", "piece", "pieces", "start", "length", "bin_id", "bin_length", "bin_offset"]
    none = pieces.filter("length <= 0").select("id", "n_tokens", "piece", "pieces", "start", "length", *(F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "long"), ("bin_length", "int"), ("bin_offset", "long"))))
    return placed.select(*cols).unionByName(none).withColumnRenamed("id", id_col)


def _with_length(placed: DataFrame, sized: list[tuple[int, int, int, int]]) -> DataFrame:
    """Adds bin_length by the run of bins that holds bin_id: the runs' first bins, sorted, in one array literal."""
    spark = placed.sparkSession
    runs: list[list[int]] = []
    for first, n, length, _ in sorted(sized):
        if runs and runs[-1][2] == length and runs[-1][1] == first:
            runs[-1][1] = first + n
        else:
            runs.append([first, first + n, length])
    total = max((r[1] for r in runs), default=1)
    width = max(1, total // 4096)
    rows = [(b, lo, hi, length) for lo, hi, length in runs for b in range(lo // width, (hi - 1) // width + 1)]
    table = spark.createDataFrame(rows, "block long, lo long, hi long, bin_length int")
    return placed.withColumn("block", F.expr(f"bin_id div {width}")).join(F.broadcast(table), "block").filter("bin_id >= lo and bin_id < hi")
