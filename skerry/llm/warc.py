"""WARC archives of Zstandard frames with an embedded dictionary.

Each archive file starts with a skippable frame (magic 0x184D2A5D) that holds a Zstandard
dictionary trained on the archive's own records; every record is a frame of its own,
compressed with it. A file holds about ``archive_bytes`` of payload, so its records fit
into a task's memory, and its dictionary is trained on records spread over all of them.

Of records with equal payloads of at least ``revisit_bytes`` the one with the largest
page_id is a response and the others are revisits that refer to it.

Rows: null html is an empty payload; a null url gets a urn; null page_ids are archived and
read back as null, and never referred to; of repeated page_ids with the largest id all are
responses; other columns are ignored; an empty table gives no archive and no row.
"""

from __future__ import annotations

import base64
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, new_folder, open_fs, task_count, task_file
from .tokens import slices

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_NAMESPACE = 0x7765_6270_6167_4000
_NO_ID = 0x8000_0000_0000_0001


def record_id(page_id: int | None) -> str:
    """A record's id holds its page_id in the low 64 bits."""
    low = (page_id or 0) & 0xFFFF_FFFF_FFFF_FFFF
    high = _NAMESPACE if page_id is not None else _NO_ID
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | low)}>"


def page_of(record: str | None) -> int | None:
    """The page_id of a record id."""
    if record is None:
        return None
    n = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    low = n & 0xFFFF_FFFF_FFFF_FFFF
    return None if n >> 64 == _NO_ID else low - (1 << 64) * (low >> 63)


def make_record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, date: str) -> bytes:
    """A response record, or a revisit record if it refers to another page."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[5:5] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*head, "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    own = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(own["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record has another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return own, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def train_dictionary(records: list[bytes], size: int = 16384) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from parts of records spread evenly over all of them; None if there is too little."""
    step = max(1, sum(map(len, records)) // (100 * size))
    samples = [r[:4096] for r in records[::step] if r]
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:  # too few or too equal samples: their text is the dictionary
        raw = b"".join(samples)[-size:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 64 else None


def archive_bytes_of(records: list[bytes], level: int = 3) -> Iterator[bytes]:
    """The archive's frames: the dictionary in a skippable frame, then each record."""
    trained = train_dictionary(records)
    if trained is not None:
        raw = trained.as_bytes()
        yield struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw
        trained.precompute_compress(level=level)
    pack = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    for r in records:
        yield pack.compress(r)


def _frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends."""
    checksum = data[at + 4] >> 2 & 1
    p = at + zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        head = int.from_bytes(data[p : p + 3], "little")
        p += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return p + 4 * checksum


def read_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive."""
    view, at, unpack = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(data):
        magic, size = struct.unpack_from("<II", data, at)
        if magic == DICTIONARY_MAGIC:
            raw = data[at + 8 : at + 8 + size]
            if struct.unpack_from("<I", raw)[0] == FRAME_MAGIC:
                raw = zstandard.ZstdDecompressor().decompress(raw)
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        elif magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
        else:
            end = _frame_end(view, at)
            yield unpack.decompress(view[at:end])
            at = end


MANIFEST = "archive string, records long, bytes long"


def _write(folder: str, date: str, limit: int):
    schema = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0

        def close():
            store, path, uri = task_file(folder, ".warc.zst")
            total = 0
            with store.open_output_stream(path) as f:
                for frame in archive_bytes_of(held):
                    f.write(frame)
                    total += len(frame)
            return pa.RecordBatch.from_pylist([{"archive": uri, "records": len(held), "bytes": total}], schema=schema)

        for batch in batches:
            for part in slices(batch, column="html"):
                for row in part.to_pylist():
                    held.append(make_record(row["page_id"], row["url"], row["html"].encode(), row["sha1"], row["refers_to"], date))
                    size += len(held[-1])
                    if size >= limit:
                        yield close()
                        held, size = [], 0
        if held:
            yield close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, date: str = "1970-01-01T00:00:00Z", revisit_bytes: int = 1000, archive_bytes: int = 16 << 20) -> DataFrame:
    """Archive ``pages`` (page_id, url, html); returns the manifest as a written table.

    Payloads are compared by SHA-1 and length. A hot payload may be most of the rows: the
    largest page_id comes from a partially aggregated groupBy, and the join back is an
    equi-join whose hot key Spark's adaptive execution splits. Payloads that occur once or
    are small do not take part in that key.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha1": F.sha1("html"), "n": F.octet_length("html").cast("long")})
    equal = rows.where(F.col("n") >= revisit_bytes).groupBy("sha1", "n").agg(F.max("page_id").alias("winner"), F.count("*").alias("copies")).where("copies > 1").select(F.concat_ws(":", "sha1", "n").alias("key"), "winner")
    keyed = rows.withColumn("key", F.when(F.col("n") >= revisit_bytes, F.concat_ws(":", "sha1", "n")).otherwise(F.concat(F.lit("#"), F.xxhash64("page_id", "url"))))
    marked = keyed.join(equal, "key", "left").select("page_id", "url", "html", "sha1", F.when(F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner")).alias("refers_to"))
    return materialize(marked.mapInArrow(_write(folder, date, archive_bytes), MANIFEST), "manifest")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    for batch in batches:
        for uri in batch.column("archive").to_pylist():
            store, path = open_fs(uri)
            with store.open_input_stream(path) as f:
                data = f.read()
            rows = []
            for raw in read_archive(data):
                own, http, payload = parse_record(raw)
                digest = base64.b32decode(own["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                n = int(http["Content-Length"])
                if own["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != n):
                    raise ValueError(f"{uri}: a payload does not match its digest")
                rows.append((page_of(own["WARC-Record-ID"]), own["WARC-Target-URI"], n, digest, own["WARC-Type"], page_of(own.get("WARC-Refers-To"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives; response payloads are held against their digests."""
    return manifest.select("archive").repartition(task_count(manifest.sparkSession)).mapInArrow(_read, RECORDS)


def archive_pages(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as archives and read them back, one row for each page."""
    return read_archives(write_archives(pages, revisit_bytes=revisit_bytes))
