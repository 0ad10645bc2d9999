"""MGF files as a data source of their own: ``spark.read.format("mgf").load(path)``.

A file is read in byte ranges of ``split_bytes``; a range has the spectra whose
begin marker starts in it, wherever they end.  The executors open the files
themselves, in any store that Arrow knows; of stores that only Spark reaches,
take :func:`ionforge.sources.mgf.read_mgf`.  Compressed files are one range.

Lines outside of spectra are left out.  ``offset`` is where a spectrum begins in
its file; :func:`read` numbers a file's spectra by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import workers

SCHEMA = "path string, split int, offset long, scan int, precursorMZ double, charge int, peaks array<struct<mz:double,intensity:double>>"
_ARROW = pa.schema(
    [
        ("path", pa.string()),
        ("split", pa.int32()),
        ("offset", pa.int64()),
        ("scan", pa.int32()),
        ("precursorMZ", pa.float64()),
        ("charge", pa.int32()),
        ("peaks", pa.list_(pa.struct([("mz", pa.float64()), ("intensity", pa.float64())]))),
    ]
)
BEGIN, END = b"BEGIN IONS", b"END IONS"
#: Bytes of a range, and those read at once; spectra of a batch.
SPLIT_BYTES, READ_BYTES, BATCH_ROWS = 64 << 20, 4 << 20, 1000
_LINE = re.compile(r"^\s*([A-Z]+)=(.*)$")
_WHOLE = re.compile(r"[+-]?\d+")


@dataclass
class Range(InputPartition):
    path: str
    split: int
    start: int
    end: int | None  # None: to the file's end


def _int(text: str | None) -> int | None:
    """A whole number of 32 bits, or nothing."""
    if text is None or not _WHOLE.fullmatch(text.strip()):
        return None
    n = int(text)
    return n if -(2**31) <= n < 2**31 else None


def parse_spectrum(text: str) -> tuple[int | None, float | None, int | None, list[dict]]:
    """(scan, m/z, charge, peaks) of the lines of a spectrum; the first line of a name counts."""
    mzs: list[float] = []
    heights: list[float] = []
    head = _parse(text, mzs, heights)
    return *head, [{"mz": m, "intensity": i} for m, i in zip(mzs, heights, strict=True)]


def _parse(text: str, mzs: list[float], heights: list[float]) -> tuple[int | None, float | None, int | None]:
    """(scan, m/z, charge) of a spectrum, its peaks appended to two lists."""
    fields: dict[str, str] = {}
    for line in text.splitlines():
        part = line.split()
        if part and part[0][0].isascii() and part[0][0].isdigit():
            mzs.append(float(part[0]))
            heights.append(float(part[1]) if len(part) > 1 else 0.0)
        elif m := _LINE.match(line):
            fields.setdefault(m[1], m[2].strip())
    scan = _int(fields.get("SCANS"))
    if scan is None and fields.get("TITLE"):
        scan = _int(fields["TITLE"].rpartition(".")[2])
    mass = (fields.get("PEPMASS") or "").split()
    charge = re.search(r"\d+", fields.get("CHARGE", ""), re.ASCII)
    try:
        mz = float(mass[0]) if mass else None
    except ValueError:
        mz = None
    return scan, mz, _int(charge[0]) if charge else None


class _Rows:
    """Spectra of a range, as flat columns."""

    def __init__(self, part: Range, bare: bool):
        self.part, self.bare = part, bare
        self.offsets: list[int] = []
        self.heads: list[tuple] = []
        self.ends: list[int] = [0]
        self.mzs: list[float] = []
        self.heights: list[float] = []

    def add(self, offset: int, text: str) -> None:
        self.offsets.append(offset)
        if not self.bare:
            self.heads.append(_parse(text, self.mzs, self.heights))
            self.ends.append(len(self.mzs))

    def batch(self) -> pa.RecordBatch:
        n = len(self.offsets)
        own = [pa.array([self.part.path] * n, pa.string()), pa.array([self.part.split] * n, pa.int32()), pa.array(self.offsets, pa.int64())]
        if self.bare:
            return pa.RecordBatch.from_arrays([*own, *(pa.nulls(n, f.type) for f in list(_ARROW)[3:])], schema=_ARROW)
        heads = [pa.array(list(x), f.type) for x, f in zip(zip(*self.heads, strict=True), list(_ARROW)[3:6], strict=True)]
        peaks = pa.StructArray.from_arrays([pa.array(self.mzs, pa.float64()), pa.array(self.heights, pa.float64())], fields=list(_ARROW.field("peaks").type.value_type))
        return pa.RecordBatch.from_arrays([*own, *heads, pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), peaks, type=_ARROW.field("peaks").type)], schema=_ARROW)


def _spectra(file: pa.NativeFile, start: int, end: int | None) -> Iterator[tuple[int, str]]:
    """(offset, text) of the spectra that begin in a range; what is held at once is a spectrum and READ_BYTES."""
    at, held = start, b""  # the offset of what is held
    ended = False
    while True:
        begin = held.find(BEGIN)
        if begin >= 0 and end is not None and at + begin >= end:
            return
        stop = held.find(END, begin) if begin >= 0 else -1
        if stop >= 0:
            yield at + begin, held[begin + len(BEGIN) : stop].decode("utf-8", "replace")
            held, at = held[stop + len(END) :], at + stop + len(END)
            continue
        if begin < 0 and (len(held) > len(BEGIN)):  # nothing in it but perhaps a marker's first letters
            held, at = held[-len(BEGIN) + 1 :], at + len(held) - len(BEGIN) + 1
        if ended or begin < 0 and end is not None and at >= end:
            return
        more = file.read(READ_BYTES)
        ended = not more
        held += more


class MgfReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, bare: bool = False):
        self.path, self.split_bytes, self.bare = path, split_bytes, bare

    def partitions(self) -> list[Range]:
        store, at = pafs.FileSystem.from_uri(self.path)
        info = store.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(pafs.FileSelector(at, recursive=True))
        out = []
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            step = max(1, self.split_bytes)
            ends = [*range(step, f.size, step), None] if not f.path.endswith(".gz") else [None]
            out += [Range(f.path, k, 0 if k == 0 else ends[k - 1], end) for k, end in enumerate(ends)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.path)
        rows = _Rows(part, self.bare)
        with store.open_input_stream(part.path) if part.path.endswith(".gz") else store.open_input_file(part.path) as file:
            if part.start:
                file.seek(part.start)
            for offset, text in _spectra(file, part.start, part.end):
                rows.add(offset, text)
                if len(rows.offsets) == BATCH_ROWS:
                    yield rows.batch()
                    rows = _Rows(part, self.bare)
        if rows.offsets:
            yield rows.batch()


class MgfDataSource(DataSource):
    """Options: ``path``, a file or folder, ``split_bytes``, and ``bare``: true gives where spectra begin only, the rest null."""

    @classmethod
    def name(cls) -> str:
        return "mgf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MgfReader:
        path = self.options["path"]
        return MgfReader(path if "://" in path or path.startswith("file:") else f"file://{path}", int(self.options.get("split_bytes", SPLIT_BYTES)), str(self.options.get("bare", "false")).lower() == "true")


def register(spark: SparkSession) -> None:
    workers.prepare(spark)
    spark.dataSource.register(MgfDataSource)


def read(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The columns of :func:`ionforge.sources.mgf.read_mgf`; the ranges' spectra are counted first, so that ``index`` counts those of a file."""
    register(spark)
    raw = spark.read.format("mgf").option("split_bytes", split_bytes).load(path)
    # counted without reading what the spectra hold
    bare = spark.read.format("mgf").option("split_bytes", split_bytes).option("bare", "true").load(path)
    counts = bare.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("path", "split", F.coalesce(earlier, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("path", "split").orderBy("offset"))
    rows = raw.withColumn("own", own).join(F.broadcast(before), ["path", "split"])
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return rows.select(name.alias("raw_file"), (F.col("before") + F.col("own")).cast("int").alias("index"), "scan", "precursorMZ", "charge", "peaks")
