"""WARC archives as seekable Zstandard bundles.

Every record is a frame of its own, so that one record can be read and
decompressed without the others. A bundle ends in the seek table of the
seekable Zstandard format: a skippable frame with the compressed and plain
size of every frame and a footer. The table and the records' ids give an index
(record id -> bundle, offset, length) that is stored beside the bundles.

Records of equal payload are written once: the one with the largest id is the
response, the others are revisit records without payload that name it.
Duplicates meet by digest; only ids and digests are shuffled for it before the
payloads go to their bundles, in which records are ordered by digest.

Defined results: a null page is an empty payload; equal payloads under one id
(repeated rows) are each a response; a null page_id is never referred to
unless all ids of its payload are null (then all are responses); a null url is
written without target URI. Empty tables write nothing. Further columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilocast.llm.common import new_folder, read, read_file, stored, write_file

BUNDLE_BYTES = 16 << 20
LEVEL = 3
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, bundle string, frame long, offset long, length long"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit holds the digest and length of its payload, not the payload."""
    body = b"" if revisit else payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}')}>"),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"),
        ("WARC-Identified-Payload-Type", "text/html"),
        ("Content-Type", "text/html"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if revisit:
        fields.append(("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{refers_to}')}>"))
        fields.append(("WARC-Profile", PROFILE))
        fields.append(("X-Refers-To-Page", str(refers_to)))
    fields.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return fields, body


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The closing skippable frame: compressed and plain size of each frame, and the footer."""
    table = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(table)) + table


def read_seek_table(uri: str) -> list[tuple[int, int]]:
    """Offset and length of each frame of a bundle, from its end alone."""
    count, _, magic = struct.unpack("<IBI", read_file(uri, -9, 9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    table = read_file(uri, -9 - 8 * count, 8 * count)
    out, at = [], 0
    for i in range(count):
        size = struct.unpack_from("<I", table, 8 * i)[0]
        out.append((at, size))
        at += size
    return out


def write_bundles(pages: DataFrame, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) to bundles; returns the stored index, a row for each record."""
    folder = new_folder(pages.sparkSession, "warc")
    plain = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    plain = plain.withColumn("digest", F.sha1("payload"))
    latest = plain.groupBy("digest").agg(F.max("page_id").alias("response"))
    typed = plain.join(latest, "digest").select(
        "page_id", "url", "payload", "response", (~F.col("page_id").eqNullSafe(F.col("response"))).alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_, context, turn = zstandard.ZstdCompressor(level=LEVEL), TaskContext.get(), 0
        frames: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        rows: list[dict] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal frames, sizes, rows, held, turn
            path = f"{folder}/bundle-{context.partitionId():06d}-{turn:06d}.warc.zst"
            write_file(path, [*frames, seek_table(sizes)], context.taskAttemptId())
            out = pa.RecordBatch.from_pylist([r | {"bundle": path} for r in rows], schema)
            frames, sizes, rows, held, turn = [], [], [], 0, turn + 1
            return out

        schema = pa.schema([("page_id", pa.int64()), ("bundle", pa.string()), *[(n, pa.int64()) for n in ("frame", "offset", "length")]])
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "response", "revisit"))):
                data = record(*row)
                frame = zip_.compress(data)
                rows.append({"page_id": row[0], "frame": len(frames), "offset": held, "length": len(frame)})
                frames.append(frame)
                sizes.append((len(frame), len(data)))
                held += len(frame)
                if held >= bundle_bytes:
                    yield flush()
        if frames:
            yield flush()

    return stored(typed.mapInArrow(run, INDEX))


def _row(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes]:
    fields, body = parse(data)
    known = {k: int(fields[k]) if k in fields else None for k in ("X-Page-Id", "X-Refers-To-Page", "X-Payload-Length")}
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and digest_of(body) != digest:
        raise ValueError("a payload does not match its digest")
    return (
        known["X-Page-Id"], fields.get("WARC-Target-URI"), known["X-Payload-Length"], digest, fields["WARC-Type"],
        known["X-Refers-To-Page"], body,
    )


def read_bundles(index: DataFrame, with_body: bool = False) -> DataFrame:
    """The records of the bundles that the index names, read frame by frame along their seek tables."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for bundle in batch.column("bundle").to_pylist():
                frames, data = read_seek_table(bundle), read_file(bundle)
                for i in range(0, len(frames), 500):
                    rows = [_row(unzip.decompress(data[a : a + n])) for a, n in frames[i : i + 500]]
                    columns = list(zip(*rows))[: 7 if with_body else 6]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, kinds)], names + ["body"] * with_body
                    )

    count = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bundles = index.select("bundle").distinct().repartition(count)
    return bundles.mapInArrow(run, schema + (", body binary" if with_body else ""))


def fetch(index: DataFrame, page_id: int) -> list[bytes]:
    """The records of one page: its rows of the index, then only their frames."""
    places = index.where(F.col("page_id") == page_id).select("bundle", "offset", "length").collect()
    return [zstandard.ZstdDecompressor().decompress(read_file(b, at, n)) for b, at, n in places]


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_bundles(write_bundles(read(spark, sf_dir, "pages"))).drop("url")
