"""Mass buckets: equal-width or quantile bins and the windows over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BUCKETS = 256


@dataclass(frozen=True)
class Buckets:
    """Fitted bins; ``edges`` has one more entry than there are bins."""

    edges: tuple[float, ...]
    uniform: bool = True

    @property
    def n(self) -> int:
        return len(self.edges) - 1

    def ordinal(self, mass: Column) -> Column:
        """The bin of a mass, clipped to the first and last."""
        lo, hi = self.edges[0], self.edges[-1]
        if self.uniform:
            if hi == lo:
                return F.lit(0)
            k = F.floor((mass - F.lit(lo)) / F.lit((hi - lo) / self.n)).cast("int")
            return F.greatest(F.lit(0), F.least(F.lit(self.n - 1), k))
        k = F.lit(0)
        for e in self.edges[1:-1]:
            k = k + (mass >= F.lit(e)).cast("int")
        return F.when(mass.isNotNull(), k)

    def window(self, mass: Column, delta: float) -> tuple[Column, Column]:
        """The bins of ``mass`` less and plus ``delta``."""
        return self.ordinal(mass - F.lit(delta)), self.ordinal(mass + F.lit(delta))

    def window_edges(self, mass: Column, delta: float) -> tuple[Column, Column]:
        """The lower edge of the window's first bin and the upper edge of its last."""
        low, high = self.window(mass, delta)
        edges = F.array(*(F.lit(float(e)) for e in self.edges))
        return F.get(edges, low), F.get(edges, high + 1)


def fit_uniform(df: DataFrame, mass: str, n: int) -> Buckets:
    if not 1 <= n <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    r = df.agg(F.min(mass).alias("lo"), F.max(mass).alias("hi")).first()
    lo, hi = (0.0, 0.0) if r["lo"] is None else (float(r["lo"]), float(r["hi"]))
    return Buckets(tuple(lo + (hi - lo) * k / n for k in range(n)) + (hi,))


def fit_quantile(df: DataFrame, mass: str, n: int, accuracy: int = 1_000_000) -> Buckets:
    """Edges at the k/n quantiles (an element of the data each)."""
    if not 1 <= n <= MOST_BUCKETS:
        raise ValueError(f"between 1 and {MOST_BUCKETS} buckets")
    inner = [k / n for k in range(1, n)]
    r = df.agg(F.min(mass).alias("lo"), F.max(mass).alias("hi"), F.percentile_approx(mass, [0.0, *inner], accuracy).alias("q")).first()
    if r["lo"] is None:
        return Buckets((0.0, 0.0), uniform=False)
    edges = sorted({float(x) for x in r["q"][1:]} - {float(r["lo"])})
    return Buckets((float(r["lo"]), *edges, float(r["hi"])), uniform=False)


def hamming(a: Column, b: Column) -> Column:
    """Squared distance of two bucket codes written as bits."""
    return F.bit_count(a.bitwiseXOR(b))
