"""Length-delimited binary records of token ids, with an offset index for shuffled reads.

File format: for each sequence an unsigned 64-bit length, the masked CRC-32C of those
eight bytes, the record, and the masked CRC-32C of the record (all little-endian). A
record is doc_id (int64), a flag for a present doc_id (uint16), the bytes of an id
(uint16: 2 if the vocabulary allows it, else 4), the number of ids (uint32) and the ids. Beside each data file lies its index: one uint64
offset for each record.

Rows: a null text is an empty one; a null doc_id is kept, sorts first and is read back as
null; repeated doc_ids keep all their rows, ordered by text; other columns are ignored; an
empty table gives no file and no row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize, new_folder, open_fs, task_count, task_file
from .crc32c import crc32c, masked
from .tokens import default_tokenizer, encoder, read_tokenizer, slices

MANIFEST = "data string, index string, records long, ids long, bytes long, first_id long"


def _write(folder: str, content: str, end_id: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = encoder(content), None
        width = 2 if max(own.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

        def body(key: int | None, ids: bytes) -> bytes:
            all_ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
            return struct.pack("<qHHI", key or 0, key is not None, width, len(all_ids)) + all_ids.astype(f"<u{width}").tobytes()

        def close():
            out["file"].close()
            store, path, uri = task_file(folder, ".idx")
            with store.open_output_stream(path) as f:
                f.write(np.concatenate(out["offsets"]).astype("<u8").tobytes())
            return pa.RecordBatch.from_pylist([{"data": out["uri"], "index": uri, "records": out["records"], "ids": out["ids"], "bytes": out["at"], "first_id": out["first"]}], schema=schema)

        for batch in batches:
            for part in slices(batch):
                keys, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                bodies = [body(k, ids) for k, ids in zip(keys, own.encode(texts), strict=True)]
                heads = [struct.pack("<Q", len(b)) for b in bodies]
                head_crc, body_crc = masked(crc32c(heads)).astype("<u4"), masked(crc32c(bodies)).astype("<u4")
                if out is not None and out["at"] >= limit and keys[0] != out["last"]:  # rows of one doc_id stay in one file
                    yield close()
                    out = None
                if out is None:
                    store, path, uri = task_file(folder, ".rec")
                    out = {"file": store.open_output_stream(path), "uri": uri, "at": 0, "records": 0, "ids": 0, "offsets": [], "first": keys[0]}
                size = np.array([len(b) for b in bodies], dtype=np.int64) + 16
                out["file"].write(b"".join(x for i, b in enumerate(bodies) for x in (heads[i], head_crc[i].tobytes(), b, body_crc[i].tobytes())))
                out["offsets"].append(out["at"] + np.cumsum(size) - size)
                out["at"] += int(size.sum())
                out["records"] += len(bodies)
                out["ids"] += int((size - 32).sum()) // width
                out["last"] = keys[-1]
        if out is not None:
            yield close()

    schema = pa.schema([("data", pa.string()), ("index", pa.string()), ("records", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64())])
    return run


def write_records(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 0, file_bytes: int = 256 << 20) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending doc_id order into record files.

    Returns the manifest as a written table: one row for each data file and its index,
    with the number of records and ids. Only files of finished attempts are listed.
    """
    folder = folder or new_folder(docs.sparkSession, "records")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    content = read_tokenizer(tokenizer or default_tokenizer())
    return materialize(ordered.mapInArrow(_write(folder, content, end_id, file_bytes), MANIFEST), "manifest")


def read_file(data: str, block: int = 8 << 20) -> Iterator[list[tuple[int | None, bytes]]]:
    """(doc_id, ids as uint32 bytes) of a data file in its order, checksums verified, some megabytes at a time."""
    store, path = open_fs(data)
    with store.open_input_stream(path) as f:
        rest = b""
        while True:
            got = f.read(block)
            rest += got
            heads, bodies, sums, at = [], [], [], 0
            while at + 12 <= len(rest):
                (n,) = struct.unpack_from("<Q", rest, at)
                if at + 16 + n > len(rest):
                    break
                heads.append(rest[at : at + 8])
                bodies.append(rest[at + 12 : at + 12 + n])
                sums.append((struct.unpack_from("<I", rest, at + 8)[0], struct.unpack_from("<I", rest, at + 12 + n)[0]))
                at += 16 + n
            if bodies:
                have = np.array(sums, dtype=np.uint32)
                if (masked(crc32c(heads)) != have[:, 0]).any() or (masked(crc32c(bodies)) != have[:, 1]).any():
                    raise ValueError(f"{data}: a checksum does not match")
                out = []
                for b in bodies:
                    key, there, width, n = struct.unpack_from("<qHHI", b)
                    if len(b) != 16 + width * n:
                        raise ValueError(f"{data}: a record has another length than it says")
                    out.append((key if there else None, np.frombuffer(b, f"<u{width}", offset=16).astype("<u4").tobytes()))
                yield out
            rest = rest[at:]
            if not got:
                break
        if rest:
            raise ValueError(f"{data}: {len(rest)} bytes are left over")


def read_shuffled(data: str, index: str, seed: int) -> Iterator[tuple[int | None, np.ndarray]]:
    """Records of a file in a random order, each read at its offset from the index."""
    store, path = open_fs(index)
    offsets = np.frombuffer(store.open_input_stream(path).read(), "<u8")
    store, path = open_fs(data)
    with store.open_input_file(path) as f:
        for at in np.random.default_rng(seed).permutation(offsets).tolist():
            (n,) = struct.unpack("<Q", f.read_at(8, at))
            body, crc = f.read_at(n, at + 12), f.read_at(4, at + 12 + n)
            if masked(crc32c([body]))[0] != struct.unpack("<I", crc)[0]:
                raise ValueError(f"{data}: a checksum does not match")
            key, there, width, _ = struct.unpack_from("<qHHI", body)
            yield (key if there else None), np.frombuffer(body, f"<u{width}", offset=16)


_ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, before in zip(batch.column("data").to_pylist(), batch.column("before").to_pylist(), strict=True):
            for rows in read_file(data):
                n = np.array([len(ids) // 4 for _, ids in rows], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array([zlib.crc32(ids) for _, ids in rows], pa.int64())], schema=_ROWS)
                before += int(n.sum())


def read_records(manifest: DataFrame) -> DataFrame:
    """Read record files back: doc_id, start (ids before it), n_tokens, ids_crc32.

    The running sum goes over one row for each file, not over documents.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy(F.col("first_id").asc_nulls_first(), "data").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("before", before.cast("long")).select("data", "before").repartition(task_count(manifest.sparkSession))
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Write and read back: the digest of every document from its record."""
    return read_records(write_records(docs, None, tokenizer, end_id))
