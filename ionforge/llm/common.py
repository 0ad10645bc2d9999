"""Shared folders, written tables and the byte-level word kernel."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch while a table is written; for that time only.
BATCH_BYTES = 8 << 20
#: Rows that a Python function handles at once.
BATCH_ROWS = 1000
#: Bytes of text that the kernel handles at once; its arrays of them stay in the CPU's cache.
CHUNK_BYTES = 1 << 18

SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


# ---------------------------------------------------------------- shared files


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset
    and all of Spark runs in this process, as in tests, a temporary folder is
    made and set; on a cluster an unset folder is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ionforge-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/ionforge-{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing will read again."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def make_folder(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)


def cleanup(spark: SparkSession) -> None:
    """Delete every table this application wrote; call it after the last read."""
    delete(spark, shared_dir(spark))


#: Rows of a file of a table of small rows.
FILE_ROWS = 200_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_BYTES within the block; the session's own bound comes back behind it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, most: int | None = None, file_rows: int = FILE_ROWS) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    With ``most``, a bound of its rows, the last stage has no more tasks, and so
    the table no more files, than there are cores or files of ``file_rows`` rows.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if most is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, 1 + most // file_rows))
    with small_batches(spark):
        df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.ionforge_path = path
    return back


def sliced(batches) -> Iterator:
    """The same rows in batches of BATCH_ROWS at most, without a copy."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            yield b.slice(at, BATCH_ROWS)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def kept_apart(df: DataFrame, *results: str) -> DataFrame:
    """``df`` with columns by the names of results renamed: ``_in`` is appended, as often as it takes."""
    for c in df.columns:
        if c.lower() in {r.lower() for r in results}:
            new = c + "_in"
            while new.lower() in {x.lower() for x in df.columns}:
                new += "_in"
            df = df.withColumnRenamed(c, new)
    return df


def drop_written(df: DataFrame) -> None:
    delete(df.sparkSession, df.ionforge_path)


#: Keys are summed up in this many buckets; their numbers are the most that is broadcast.
KEY_BUCKETS = 1 << 20


def _bucketed(keys: DataFrame, cols: list[str], name: str) -> DataFrame:
    return F.broadcast(keys.select(F.pmod(F.xxhash64(*cols), F.lit(KEY_BUCKETS)).alias(name)).distinct())


def rows_with_keys(df: DataFrame, keys: DataFrame, cols: list[str], exact: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``cols`` are in ``keys``.

    Only rows whose key falls in a bucket of some key are shuffled; the buckets'
    numbers, at most KEY_BUCKETS of them, are broadcast.  With very many keys
    all buckets have one, and all rows are shuffled by key.  Without ``exact``
    rows of other keys in the same buckets may be among the result, and nothing
    is shuffled.
    """
    (bucket,) = free_names(df, "bucket")
    some = df.withColumn(bucket, F.pmod(F.xxhash64(*cols), F.lit(KEY_BUCKETS))).join(_bucketed(keys, cols, bucket), bucket, "left_semi").drop(bucket)
    if not exact:
        return some
    return some.join(keys.select(*cols).distinct(), cols, "left_semi")


def rows_without_keys(df: DataFrame, keys: DataFrame, cols: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``cols`` are not in ``keys``; a null is a value like others."""
    bucket, *gone_cols = free_names(df, "bucket", *(f"gone_{c}" for c in cols))
    marked = df.withColumn(bucket, F.pmod(F.xxhash64(*cols), F.lit(KEY_BUCKETS)))
    buckets = _bucketed(keys, cols, bucket)
    clear = marked.join(buckets, bucket, "left_anti").drop(bucket)
    gone = keys.select(*(F.col(c).alias(g) for c, g in zip(cols, gone_cols, strict=True))).distinct()
    same = None
    for c, g in zip(cols, gone_cols, strict=True):
        eq = F.col(c).eqNullSafe(F.col(g))
        same = eq if same is None else same & eq
    rest = marked.join(buckets, bucket, "left_semi").drop(bucket).join(gone, same, "left_anti")
    return clear.unionByName(rest)


def with_workers(spark: SparkSession) -> None:
    """Let Python workers find this package."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def _is_scan(plan) -> bool:
    """Is this optimized plan a scan with projections and filters only?"""
    name = plan.getClass().getSimpleName()
    if name == "LogicalRelation":
        return True
    return name in ("Project", "Filter") and _is_scan(plan.children().head())


def spread(df: DataFrame) -> DataFrame:
    """The same rows over all cores, if the files of a plain scan make fewer partitions than there are cores.

    Large inputs stay as they are, and so does every other plan: to ask it for
    its partitions could run its stages.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not _is_scan(df._jdf.queryExecution().optimizedPlan()):
        return df
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


# ------------------------------------------------------------------ the kernel


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finish 64-bit hashes so that low and high bits are alike."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


mixed = _mixed


class Words:
    """Splits Arrow strings into words and hashes each word, by whole arrays.

    ``inside`` says for each byte whether it belongs to a word.  A word's hash
    is a polynomial in per-byte random numbers modulo 2**64, taken as a
    difference of running sums; A-Z hash as a-z.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, inside: np.ndarray, lower: bool = True, seed: int = 7):
        self.inside = np.asarray(inside, dtype=bool)
        r = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, 256, dtype=np.uint64)
        if lower:
            r[65:91] = r[97:123]
        self.r = r * np.uint64(2) + np.uint64(1)
        self._grow(1 << 16)

    def __getstate__(self):
        return {"inside": self.inside, "r": self.r}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        inverse = np.uint64(pow(self.BASE, -1, 2**64))
        with np.errstate(over="ignore"):
            for name, base in (("power", np.uint64(self.BASE)), ("back", inverse)):
                x = np.full(n + 1, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))

    def chunks(self, texts: pa.Array):
        """Yield (first row, row offsets, bytes) of at most about CHUNK_BYTES each; a longer text makes its own chunk."""
        data, at = text_bytes(texts)
        i, n = 0, len(texts)
        while i < n:
            j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_BYTES, "right")) - 1)
            yield i, at[i : j + 1] - at[i], data[at[i] : at[j]]
            i = j

    def split(self, at: np.ndarray, data: np.ndarray):
        """(hash, start, end, row) of each word; ``row`` counts from the chunk's first."""
        n = len(data)
        if n == 0:
            z = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), z, z, z
        if n >= len(self.power):
            self._grow(n + 1)
        inside = self.inside[data]
        full = at[1:] > at[:-1]
        edge = np.zeros(n + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[0] = edge[n] = True
        edge[at[:-1][full]] = True
        cut = np.flatnonzero(edge)
        keep = inside[cut[:-1]]
        start, end = cut[:-1][keep], cut[1:][keep]
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(self.r[data] * self.power[:n], out=total[1:])
            h = _mixed((total[end] - total[start]) * self.back[start])
        return h, start, end, np.searchsorted(at, start, "right") - 1


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, null as empty, and each string's offsets."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def byte_table(outside: str) -> np.ndarray:
    """For each byte: does it belong to a word, if ``outside`` lists the bytes that do not?"""
    table = np.ones(256, bool)
    table[[ord(c) for c in outside]] = False
    return table


#: Words between white space.
SPACED = byte_table("\x20\x09\x0a\x0b\x0c\x0d")
#: Words of ASCII letters and digits and of anything that is not ASCII.
LETTERS = byte_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of ``n`` words within a row, and their rows.

    A row with fewer than ``n`` words, but some, has its whole sequence as one.
    """
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    with np.errstate(over="ignore"):
        weights = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA5A3564E27F88699, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0x9FB21C651E98DF25)]
        if n > len(weights):
            raise ValueError(f"at most {len(weights)} words to a shingle")
        m = len(h) - n + 1
        if m > 0:
            s = h[:m] * weights[0]
            for k in range(1, n):
                s += h[k : k + m] * weights[k]
            whole = row[:m] == row[n - 1 :]
            s, at = _mixed(s[whole]), row[:m][whole]
        else:
            s, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            extra = np.empty(len(short), np.uint64)
            for i, d in enumerate(short):
                x = np.uint64(0x51ED270B * count[d])
                for k in range(count[d]):
                    x = x + h[first[d] + k] * weights[k]
                extra[i] = x
            s, at = np.concatenate([s, _mixed(extra)]), np.concatenate([at, short])
            order = np.argsort(at, kind="stable")
            s, at = s[order], at[order]
    return s, at
