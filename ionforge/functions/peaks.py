"""Peak lists as arrays of (mz, intensity): normalising, trimming, matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METHODS = ("ion_current", "L2", "sum", "max")


def denominator(intensities: Column, method: str) -> Column:
    """What intensities are divided by; ion_current is the sum of squares itself, not its root."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if method == "max":
        return F.array_max(intensities)
    if method == "sum":
        return F.aggregate(intensities, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(intensities, F.lit(0.0), lambda a, x: a + x * x)
    return F.sqrt(squares) if method == "L2" else squares


def normalise(intensities: Column, method: str = "L2") -> Column:
    """Null for a spectrum whose intensities are all zero."""
    # either is computed once per spectrum, not once per peak
    return _let(intensities, lambda v: _let(denominator(v, method), lambda d: F.when(d != 0, F.transform(v, lambda x: x / d))))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda's variable, where a column would be computed at each use."""
    return F.transform(F.array(value), body)[0]


def zip_peaks(mzs: Column, intensities: Column) -> Column:
    return F.zip_with(mzs, intensities, lambda m, i: F.struct(m.alias("mz"), i.alias("intensity")))


def trim(peaks: Column, n: int) -> Column:
    """The ``n`` most intense peaks in their original order; of equal ones the later stays."""
    marked = F.transform(peaks, lambda p, k: F.struct((-p.intensity).alias("by"), (-k).alias("back"), p.alias("p")))
    best = F.slice(F.array_sort(marked), 1, n)
    cut = F.transform(F.array_sort(F.transform(best, lambda x: F.struct((-x.back).alias("k"), x.p.alias("p")))), lambda x: x.p)
    # nothing is sorted where nothing is to be left out
    return F.when(F.size(peaks) <= n, peaks).otherwise(cut)


def pad(values: Column, n: int) -> Column:
    """Zeros to the right up to ``n`` values; longer arrays stay."""
    return F.concat(values, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(n) - F.size(values))))


def matched(peaks: Column, ions: Column, tolerance: float) -> Column:
    """The peaks that lie closer than ``tolerance`` to some ion; zeros never match."""
    return F.filter(peaks, lambda p: (p.mz != 0) & F.exists(ions, lambda i: (i != 0) & (F.abs(p.mz - i) < tolerance)))


def match_score(matches: Column, least: int = 4) -> Column:
    """Matches times their intensity where more than ``least`` match, else less the intensity."""
    total = F.aggregate(matches, F.lit(0.0), lambda a, p: a + p.intensity)
    return F.when(F.size(matches) > least, F.size(matches) * total).otherwise(-total)
