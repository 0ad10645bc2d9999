"""Table functions for SQL: ``cleave`` and ``fragments``, in a lateral join.

    from ionforge.functions import tables
    tables.register(spark)
    spark.sql("select accession, c.peptide from proteins, lateral cleave(sequence, 'trypsin', 1, 7, 42) c")

Their results equal those of ``operators.digest.digest`` and
``functions.chemistry.fragment_ions``.  Catalyst does not see into ``cleave``,
which is Python; ``fragments`` is a function of SQL, and planned as an expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .. import workers
from . import constants as K

_ODD = re.compile(f"[{K.ODD_RESIDUES}]")
_MASS = {**K.RESIDUE_MASS, "C": K.RESIDUE_MASS["C"] + K.CARBAMIDOMETHYL, "m": K.RESIDUE_MASS["M"] + K.OXIDATION}


class Cleave:
    """(peptide) of each run of up to ``missed`` + 1 pieces of a protein, each once, of a length within the bounds and without odd residues."""

    def __init__(self) -> None:
        self.rules: dict[str, re.Pattern] = {}

    def eval(self, sequence: str, enzyme: str, missed: int, least: int, most: int) -> Iterator[tuple[str]]:
        if sequence is None:
            return
        if enzyme not in self.rules:
            self.rules[enzyme] = re.compile(K.enzyme_rule(enzyme))
        cuts = [0, *(m.start() for m in self.rules[enzyme].finditer(sequence) if m.start() > 0), len(sequence)]
        seen = set()
        for i in range(len(cuts) - 1):
            for end in cuts[i + 1 : i + missed + 2]:
                n = end - cuts[i]
                if n > most:
                    break
                peptide = sequence[cuts[i] : end]
                if n >= least and peptide not in seen and not _ODD.search(peptide):
                    seen.add(peptide)
                    yield (peptide,)


def _fragments() -> str:
    """(kind, position, charge, mz) of each b and y ion of a peptide, for charges 1 .. ``charge``, as a function of SQL: prefix sums once, and an array of all ions."""
    letters, masses = "".join(_MASS), ", ".join(f"{m!r}d" for m in _MASS.values())
    prefix = f"aggregate(filter(split(peptide, ''), c -> c != ''), array(0d), (a, c) -> array_append(a, element_at(a, -1) + try_element_at(array({masses}), nullif(instr('{letters}', c), 0))))"
    b = f"named_struct('kind', 'b', 'position', i, 'charge', z, 'mz', (p[i] + z * {K.PROTON!r}d) / z)"
    y = f"named_struct('kind', 'y', 'position', i, 'charge', z, 'mz', (y + z * {K.PROTON!r}d) / z)"
    of_place = f"transform(array(element_at(p, -1) - p[size(p) - 1 - i] + {K.WATER!r}d), y -> flatten(transform(sequence(1, charge), z -> array({b}, {y}))))[0]"
    # nothing where a residue has no mass, as sums are null from there on
    ions = f"transform(array({prefix}), p -> if(element_at(p, -1) is not null, flatten(transform(sequence(1, size(p) - 1), i -> {of_place})), null))[0]"
    return f"""create or replace temporary function fragments(peptide string, charge int) returns table (kind string, position int, charge int, mz double)
        return select e.kind, e.position, e.charge, e.mz from (select inline(if(length(peptide) > 0 and charge >= 1, {ions}, null))) e"""


def register(spark: SparkSession) -> None:
    """Make both known to a session's SQL; rows are sent to ``cleave`` in Arrow batches, and ``fragments`` is planned with the query, as no row leaves the JVM for it."""
    workers.prepare(spark)
    spark.udtf.register("cleave", udtf(Cleave, returnType="peptide string", useArrow=True))
    spark.sql(_fragments())
