"""Operator 5, a WARC writer with a Zstandard dictionary in each archive.

Each archive is a ``.warc.zst`` file: a skippable frame that holds a dictionary
built from the archive's own records, then each record as a frame of its own
compressed with that dictionary, so that a record can be read alone at its
offset.  An archive is closed at ``archive_bytes`` of records, so writer and
reader hold a bounded amount.

Of the records with equal payloads of at least ``revisit_bytes`` that with the
largest page id is the response and the others are revisits of it, with the
full payload's digest and length but no payload.

Files are written through ``pyarrow.fs`` into the shared folder under names
given by the partition, first under a temporary name and then renamed; a task
that runs again writes the same bytes to the same names.

Joins carry html, so no key of theirs is large: groups that hold a thousandth
of all repeated rows are fewer than a thousand and are broadcast, and rows that
need no partner are spread.  Rows that agree in id, payload and url are written
by one task, one after the other.

Defined results: null html is an empty payload; a null id is an empty header, a
null url none, and both are read back as null; equal payloads without any page
id are all responses; among equal payloads with equal page
ids one row is the response and the rest revisits of it; an empty table gives
an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import make_folder, new_path, with_workers, written

ARCHIVE_BYTES = 16 << 20
REVISIT_BYTES = 1000
#: Groups of equal payloads that are broadcast are fewer.
HOT_GROUPS = 1000
#: Archives that a writing task fills, about.
ARCHIVES = 16
DICTIONARY_BYTES = 64 << 10
#: Bytes of an archive's records from which its dictionary is built.
TRAINING_BYTES = 2 << 20
#: The skippable frame that holds a dictionary in a .warc.zst file.
DICTIONARY_FRAME = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3


def record(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    text = lambda x: "" if x is None else str(x).replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{text(page_id)}>",
        *([] if url is None else [f"WARC-Target-URI: {text(url)}"]),
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{text(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record, with its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    urn = lambda x: int(x[10:-1]) if x[10:-1] else None
    return {
        "page_id": urn(fields["WARC-Record-ID"]),
        "url": fields.get("WARC-Target-URI"),
        "payload_bytes": size,
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex(),
        "record_type": fields["WARC-Type"],
        "refers_to": urn(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
        "payload": payload,
    }


def archive(records: list[bytes]) -> bytes:
    """A whole .warc.zst file.

    The dictionary is learnt from the first 128 KiB of about TRAINING_BYTES of
    its records; the records themselves are written whole.  Where there are too
    few of them to learn from, the first record's bytes are the dictionary.
    """
    samples, n = [], 0
    for r in records[:: max(1, sum(map(len, records)) // TRAINING_BYTES)]:
        samples.append(r[: 128 << 10])
        n += len(samples[-1])
        if n >= TRAINING_BYTES:
            break
    try:
        size = min(DICTIONARY_BYTES, max(1024, n // 10))
        content = zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too few records to learn from: the first is the dictionary's raw content
        content = samples[0][:DICTIONARY_BYTES] if samples else b""
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(content)
    one = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed + b"".join(one.compress(r) for r in records)


def records(data: bytes) -> Iterator[bytes]:
    """The records of a whole .warc.zst file."""
    magic, n = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame at the start")
    content = zstandard.ZstdDecompressor().decompress(data[8 : 8 + n])
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    rest = memoryview(data)[8 + n :]
    while len(rest):
        d = one.decompressobj()
        out = d.decompress(rest)
        yield out
        rest = rest[len(rest) - len(d.unused_data) :]


def write_archives(pages: DataFrame, path: str | None = None, revisit_bytes: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Write all pages (page_id, url, html) to archives; returns their folder."""
    spark = pages.sparkSession
    with_workers(spark)
    path = path or new_path(spark, "warc")
    # SHA-1, and for payloads that may be revisited SHA-256 behind it
    long = F.coalesce(F.octet_length("html") >= revisit_bytes, F.lit(False))
    key = F.concat(F.sha1(F.coalesce("html", F.lit(""))), F.when(long, F.sha2("html", 256)).otherwise(""))
    rows = pages.select("page_id", "url", "html", key.alias("key"), long.alias("long"))
    groups = written(rows.filter("long").groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null"), "warc-groups")
    whole = groups.agg(F.sum("n").alias("n")).first()["n"] or 0
    size = pages.agg(F.sum(F.octet_length("html")).alias("n")).first()["n"] or 0
    # fewer than HOT_GROUPS groups hold such a share of the repeated rows; what is left has no large key
    large = F.col("n") * HOT_GROUPS > whole
    hot, rest = groups.filter(large).select("key", "refers_to"), groups.filter(~large).select(F.col("key").alias("at"), F.col("refers_to").alias("other"))
    rows = rows.join(F.broadcast(hot), "key", "left")
    spread_out = F.xxhash64("page_id", "url").cast("string")
    rows = rows.withColumn("at", F.when(F.col("long") & F.col("refers_to").isNull(), F.col("key")).otherwise(spread_out)).join(rest, "at", "left")
    refers_to = F.coalesce("refers_to", "other")
    # rows of one payload and its largest page id meet in one task, where the first is the response
    top = F.coalesce(F.col("page_id") == refers_to, F.lit(False))
    rows = rows.select("page_id", "url", "html", "key", top.alias("top"), refers_to.alias("refers_to"))
    parts = max(spark.sparkContext.defaultParallelism, 1 + size // (ARCHIVES * archive_bytes))
    rows = rows.repartition(parts, F.xxhash64("page_id", "key", F.when(~F.col("top"), F.col("url")))).sortWithinPartitions("page_id", "key", "url")
    target = path

    def write(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, folder = fs.FileSystem.from_uri(target)
        store.create_dir(folder, recursive=True)
        part, held, size, k, last = TaskContext.get().partitionId(), [], 0, 0, None

        def flush():
            nonlocal held, size, k
            data, name = archive(held), f"{folder}/part-{part:06d}-{k:05d}.warc.zst"
            hidden = f"{folder}/_{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write(data)
            store.move(hidden, name)
            done = (name, len(held), len(data))
            held, size, k = [], 0, k + 1
            return done

        for b in batches:
            made = []
            for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                page_id, url, body, key, top, refers = r
                body = (body or "").encode()
                what = "response" if refers is None or (top and (page_id, key) != last) else "revisit"
                last = (page_id, key)
                held.append(record(page_id, url, body, key[:40], len(body), what, refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    made.append(flush())
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["file", "n", "size"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in flush()], ["file", "n", "size"])

    make_folder(spark, path)  # also where there is nothing to write
    manifest = rows.mapInArrow(write, "file string, n long, size long")
    written(manifest, "warc-manifest")
    return path


def read_archives(spark, path: str) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and html of each record below ``path``.

    A response's digest and length are computed from its payload and must
    agree with its headers.
    """
    with_workers(spark)

    def read(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for data in b.column(0):
                held, size = [], 0
                for raw in records(data.as_py()):
                    r = parse(raw)
                    body = r.pop("payload")
                    if r["record_type"] == "response" and (hashlib.sha1(body).hexdigest() != r["payload_digest"] or len(body) != r["payload_bytes"]):
                        raise ValueError(f"record {r['page_id']} does not hold what its headers say")
                    r["html"] = body.decode() if r["record_type"] == "response" else None
                    held.append(r)
                    size += len(body)
                    if size > 4 << 20 or len(held) >= 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], t) for n, t in zip(names, kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], t) for n, t in zip(names, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    return files.select("content").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")
