"""Operator 13, periodic runs of words by harmonic grid probing.

A run is a stretch of words with smallest period ``q`` and a length of
``max(LEAST, 2 * q)`` at least, which no neighbouring word extends.  A stretch
of period p and length 2 * p holds two neighbouring points of the grid 0, p,
2 * p ..., so for each p only words on that grid are compared: n/1 + n/2 + ...
comparisons for a text of n words, each an array operation.

* Grid points whose words agree are survivors.  Those that lie with their
  partner in a run found before, of a period that divides p, are skipped: the
  stretch around them is that run.
* A survivor's neighbours are compared by whole arrays, ``NEAR`` words to each
  side; what still agrees is extended by chunks of doubling length, to the left
  no further than the end of the stretch of the same period before it.
* A stretch of which a prime part of p is a period too is no run of period p
  (as it holds 2 * p words, its smallest period divides p).

Words are compared by 64-bit hashes; each run found is then compared word by
word, and a text in which that fails is done again with exact numbers.

Rows don't meet: there is no shuffle, and a task holds one Arrow batch and one
text's words.

Defined results: one row out for each row in, repeated rows included.  A null or
empty text, or one without words, has no runs and four nulls, and its collapsed
text is empty.  A null id is carried along, and nothing is planted in its text.
Columns other than id and text are ignored, whatever their names.  An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, spread, with_workers

#: The least length of a run.
LEAST = 12
#: Words to each side of a survivor that are compared for all survivors at once.
NEAR = 16
#: Texts of up to so many words use one table of all grid points.
TABLE_WORDS = 2048
#: Grid points of a long text that are looked at at once.
CHUNK = 1 << 20

_COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli"]


def _grid_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All grid points (i, i + p) of texts of TABLE_WORDS words, by i + p; and how many of them a text of n words has."""
    n = TABLE_WORDS
    periods = np.arange(1, n // 2 + 1)
    counts = (n - 1) // periods
    p = np.repeat(periods, counts)
    j = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    order = np.argsort(p * (j + 1), kind="stable")
    i, k = (p * j)[order], (p * (j + 1))[order]
    return i, k, np.searchsorted(k, np.arange(n + 1))


class _Inside:
    """The longest run found so far around each word: which grid points can be skipped."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.end: np.ndarray | None = None

    def add(self, start: int, end: int, p: int) -> None:
        if self.end is None:
            self.end, self.length, self.period = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64), np.ones(self.n, np.int64)
        at = start + np.flatnonzero(self.length[start:end] < end - start)
        self.end[at], self.length[at], self.period[at] = end, end - start, p

    def one(self, at: int, p: int) -> bool:
        """Does the point stand with its partner in a run whose period divides ``p``?"""
        return self.end is not None and at + p < self.end[at] and p % self.period[at] == 0

    def outside(self, at: np.ndarray, p: np.ndarray | int) -> np.ndarray:
        if self.end is None:
            return np.ones(len(at), bool)
        return (at + p >= self.end[at]) | (p % self.period[at] != 0)


class Finder:
    """Finds the runs of sequences of numbers; holds the grid table."""

    def __init__(self) -> None:
        self.i, self.k, self.upto = _grid_table()

    def runs(self, w: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, by start and period."""
        n = len(w)
        if n < LEAST:
            return []
        found: list[tuple[int, int, int]] = []  # start, length, period
        inside = _Inside(n)
        ends: dict[int, int] = {}  # by period, the end of the last stretch's equal pairs
        for i, p in self._survivors(w, n, inside):
            i, p = _close(w, i, p)
            for a, q in zip(i.tolist(), p.tolist(), strict=True):
                if a < ends.get(q, 0) or inside.one(a, q):
                    continue
                left = a - _reach(w, a - 1, q, -1, a - ends.get(q, 0))
                right = a + 1 + _reach(w, a + 1, q, 1, n - q - a - 1)
                ends[q] = right
                if right - left + q >= max(LEAST, 2 * q) and _primitive(w, left, q):
                    found.append((left, right + q - left, q))
                    inside.add(left, right + q, q)
        return sorted(found)

    def _survivors(self, w: np.ndarray, n: int, inside: _Inside) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Agreeing grid points (i, p), periods ascending."""
        if n <= TABLE_WORDS:
            m = self.upto[n]
            i, k = self.i[:m], self.k[:m]
            same = w[i] == w[k]
            i, p = i[same], (k - i)[same]
            fit = p <= n // 2
            i, p = i[fit], p[fit]
            order = np.lexsort((i, p))
            yield i[order], p[order]
            return
        root = int(n**0.5)
        for p in range(1, root + 1):
            at = np.arange(0, n - p, p)
            at = at[w[at] == w[at + p]]
            at = at[inside.outside(at, p)]
            yield at, np.full(len(at), p)
        # beyond the root a period has few grid points: all periods of a stretch at once, by the point's number
        step = max(1, CHUNK // root)
        for low in range(root + 1, n // 2 + 1, step):
            parts = []
            for j in range((n - 1) // low):
                p = np.arange(low, min(low + step, n // 2 + 1, (n - 1) // (j + 1) + 1))
                p = p[w[p * j] == w[p * (j + 1)]]
                p = p[inside.outside(p * j, p)]
                parts.append((p * j, p))
            i, p = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((i, p))
            yield i[order], p[order]


def _close(w: np.ndarray, i: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points around which enough neighbours agree, as far as NEAR words tell."""
    n = len(w)
    total = np.ones(len(i), np.int64)
    for step in (1, -1):
        live = np.arange(len(i))
        for d in range(1, NEAR + 1):
            at = i[live] + step * d
            inside = (at >= 0) & (at + p[live] < n)
            live, at = live[inside], at[inside]
            live = live[w[at] == w[at + p[live]]]
            if not len(live):
                break
            total[live] += 1
    keep = total >= np.minimum(np.maximum(p, LEAST - p), NEAR + 1)
    return i[keep], p[keep]


def _reach(w: np.ndarray, at: int, p: int, step: int, most: int) -> int:
    """How many of the ``most`` words from ``at`` on, in a direction, agree with those ``p`` behind them."""
    done, size = 0, 64
    while done < most:
        m = min(size, most - done)
        if step > 0:
            x = w[at + done : at + done + m] != w[at + done + p : at + done + p + m]
        else:
            end = at - done + 1
            x = (w[end - m : end] != w[end - m + p : end + p])[::-1]
        k = int(x.argmax())
        if x[k]:
            return done + k
        done += m
        size *= 2
    return done


def _primitive(w: np.ndarray, at: int, p: int) -> bool:
    """Is ``p`` the smallest period of a stretch of 2 * p words or more that starts at ``at``?"""
    rest, f = p, 2
    while rest > 1:
        if rest % f == 0:
            q = p // f
            if (w[at : at + p - q] == w[at + q : at + p]).all():
                return False
            while rest % f == 0:
                rest //= f
        f = f + 1 if f * f <= rest else max(rest, f + 1)
    return True


def planted(words: list, doc_id: int | None) -> list:
    """The sequence in which runs are looked for: in one of ten texts, chosen by the id, a part is repeated up to the end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a : a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[: n - a]


def found_runs(words: list, finder: Finder) -> list[tuple[int, int, int]]:
    """The runs of a sequence of words."""
    runs = finder.runs(np.fromiter(map(hash, words), np.int64, len(words)))
    if all(words[s : s + n - q] == words[s + q : s + n] for s, n, q in runs):
        return runs
    numbers: dict = {}
    return finder.runs(np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int64, len(words)))


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that a run repeats."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [words[i] for i in np.flatnonzero(keep)]


def described(words: list, finder: Finder) -> tuple:
    """n_runs, the greatest run's start, length, period and exponent, and both digests."""
    runs = found_runs(words, finder)
    best = (None,) * 4
    if runs:
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest())


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) of each row.

    ``plant`` puts repeats into a tenth of the texts first, chosen by their ids,
    so that runs of known places are among those found.
    """
    with_workers(df.sparkSession)

    def run(batches):
        finder = Finder()
        schema = None
        for b in sliced(batches):
            rows = []
            ids = b.column(0).to_pylist()
            for doc_id, text in zip(ids, b.column(1), strict=True):
                raw = text.as_py() or b""
                words = raw.split()  # bytes are split at the six white-space characters of ASCII
                rows.append(described(planted(words, doc_id) if plant else words, finder))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            schema = schema or pa.schema([(x, pa.int64()) for x in _COLUMNS] + [(x, pa.string()) for x in ("runs_sha256", "collapsed_sha256")])
            rest = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(cols, schema, strict=True)], schema=schema)
            yield pa.RecordBatch.from_arrays([b.column(0), *rest.columns], [b.schema.field(0).name, *schema.names])

    kind = df.schema[id_col].dataType.simpleString()
    out = ", ".join([f"`{id_col}` {kind}", *(f"{x} long" for x in _COLUMNS), "runs_sha256 string", "collapsed_sha256 string"])
    return spread(df.select(F.col(id_col), F.encode(F.col(text_col), "UTF-8").alias("__text"))).mapInArrow(run, out)
