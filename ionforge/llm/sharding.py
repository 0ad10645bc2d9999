"""Operator 6, sharding by a consistent-hash ring with bounded loads.

Each shard owns ``vnodes`` points of a ring of 2**32 places; a row's place is
the hash of its id, and the row belongs to the next point clockwise.  A shard
takes no more rows than its quota; rows beyond it continue clockwise to the
next point whose shard has room.  The quotas differ by one at most and add up
to the rows, so the law ``rows`` holds: counts at most one apart.

Only counts per arc of the ring reach the driver (``shards * vnodes`` numbers,
whatever the table's size, and as many again for the parts into which arcs are
cut so that no window sorts more than its share of the rows).  The driver
walks the ring over these counts and returns ranges of ranks, which are
broadcast; each row then finds its shard and slot by its rank within its arc.

Defined results: null text has size 16 and checksum 0; a null id has a place
of its own like any other; repeated rows are placed one by one; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows above which a part of an arc is cut further; the number of parts is bounded.
PART_ROWS = 200_000
RING = 2**32


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """Sorted (place, shard) of every virtual node."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=4).digest(), "big")
            while at in points:
                at = (at + 1) % RING
            points[at] = s
    return sorted(points.items())


def walk(points: list[tuple[int, int]], counts: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot) for rows counted by arc.

    Each arc first fills its own shard; then, in ring order, what is left
    continues clockwise.
    """
    total = sum(counts)
    order = list(dict.fromkeys(s for _, s in points))
    room = {s: total // shards + (k < total % shards) for k, s in enumerate(order)}
    slot = dict.fromkeys(order, 0)
    out, left = [], [0] * len(points)

    def give(arc: int, rank: int, shard: int, n: int) -> None:
        out.append((arc, rank, rank + n, shard, slot[shard]))
        slot[shard] += n
        room[shard] -= n

    for arc, (_, shard) in enumerate(points):
        if n := min(counts[arc], room[shard]):
            give(arc, 0, shard, n)
        left[arc] = n
    for arc in range(len(points)):
        k = arc
        while left[arc] < counts[arc]:
            k = (k + 1) % len(points)
            shard = points[k][1]
            if n := min(counts[arc] - left[arc], room[shard]):
                give(arc, left[arc], shard, n)
                left[arc] += n
    return out


def shard_rows(df: DataFrame, shards: int = 40, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc id, size, text_crc32, law, shard, slot and grown_shard of each row."""
    spark = df.sparkSession
    points = ring_points(shards, vnodes)
    places = [p for p, _ in points]
    text = F.coalesce(F.col(text_col), F.lit(""))
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit("place")), F.lit(RING))
    rows = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text).alias("text_crc32"),
        place.alias("place"),
        F.xxhash64(F.col(id_col), text).alias("tie"),
    )
    bounds = spark.createDataFrame([(i, places[i - 1] + 1 if i else 0, p + 1) for i, p in enumerate(places)] + [(0, places[-1] + 1, RING)], "arc int, lo long, hi long")
    # equi-join on cells of the ring: every arc lists the cells it touches
    width = RING // 4096
    lists = bounds.filter("hi > lo").select("arc", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))).alias("cell"))
    placed = (
        rows.withColumn("cell", F.expr(f"place div {width}"))
        .join(F.broadcast(lists), "cell")
        .filter("place >= lo and place < hi")
        .select("id", "size", "text_crc32", "tie", "arc")
    )
    counts = {r["arc"]: r["n"] for r in placed.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = [counts.get(i, 0) for i in range(len(points))]
    # an arc's part is decided by the row's hash; a part has about PART_ROWS rows
    scale = max(PART_ROWS, sum(each) // (4 * len(points)) + 1)
    parts = spark.createDataFrame([(i, 1 + n // scale) for i, n in enumerate(each)], "arc int, parts int")
    placed = placed.join(F.broadcast(parts), "arc").withColumn("part", F.pmod(F.col("tie"), F.col("parts")).cast("int")).drop("parts")
    if any(n > scale for n in each):
        sizes = sorted((r["arc"], r["part"], r["n"]) for r in placed.groupBy("arc", "part").agg(F.count(F.lit(1)).alias("n")).collect())
    else:
        sizes = [(i, 0, n) for i, n in enumerate(each) if n]
    before, offsets = {}, []
    for arc, part, n in sizes:
        offsets.append((arc, part, before.get(arc, 0)))
        before[arc] = before.get(arc, 0) + n
    plan = walk(points, each, shards) if sum(each) else []
    offsets = spark.createDataFrame(offsets, "arc int, part int, offset long")
    plan = spark.createDataFrame(plan, "arc int, first long, end long, shard int, start long")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("arc", "part").orderBy("tie", "id", "text_crc32", "size")) - 1)
    return (
        ranked.join(F.broadcast(offsets), ["arc", "part"])
        .withColumn("rank", F.col("rank") + F.col("offset"))
        .join(F.broadcast(plan), "arc")
        .filter("rank >= first and rank < end")
        .select(
            F.col("id").alias(id_col),
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("start") + F.col("rank") - F.col("first")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
