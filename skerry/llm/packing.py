"""Best-fit packing of documents into sequences, bettered by swap-based local search.

Documents become token ids with an end id. Longer ones than a sequence are cut into whole
sequences, the first piece taking what is left over. Pieces are dealt by a hash into
shards of about ``shard_items`` pieces; each shard is packed best-fit decreasing, then
local search moves pieces out of the emptiest bin and exchanges one-for-one or two-for-one
with other underfull bins. Every step raises the sum of squared fills, so the search ends;
a bin that becomes empty goes away. What stays underfull in any shard is
packed again in shards of ``merge`` times the size, so that loss does not add up.

Rows: null text counts as empty (its one piece is the end id alone); null and repeated
doc_ids are packed like others; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from .tokens import default_tokenizer, encoder, read_tokenizer, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item numbers. Lengths are 1 to ``capacity``."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    frees = 0  # bit f: some bin has f free
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = frees >> n
        if fit:
            f = n + (fit & -fit).bit_length() - 1
            b = by_free[f].pop()
            if not by_free[f]:
                frees &= ~(1 << f)
            bins[b].append(i)
        else:
            f, b = capacity, len(bins)
            bins.append([i])
        by_free[f - n].append(b)
        frees |= 1 << (f - n)
    return bins


class _Places:
    """Underfull bins by the lengths of their pieces: for each length the fullest bin up to any fill.

    Length 0 stands for no piece, which every bin can give back.
    """

    def __init__(self, capacity: int) -> None:
        self.bins: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]  # length -> fill -> bins
        self.top = np.full((capacity + 1, capacity + 1), -1, np.int16 if capacity < 32_768 else np.int64)

    def _row(self, n: int) -> None:
        row = np.full(self.top.shape[1], -1, self.top.dtype)
        fills = list(self.bins[n])
        row[fills] = fills
        self.top[n] = np.maximum.accumulate(row)

    def add(self, b: int, fill: int, lengths: set[int]) -> None:
        for n in (0, *lengths):
            own = self.bins[n].setdefault(fill, {})
            own[b] = None
            if len(own) == 1:
                self._row(n)

    def remove(self, b: int, fill: int, lengths: set[int]) -> None:
        for n in (0, *lengths):
            own = self.bins[n][fill]
            del own[b]
            if not own:
                del self.bins[n][fill]
                self._row(n)

    def best(self, out: list[int], singles: int, fill: int):
        """(place in ``out``, length to take back, bin) of the exchange that gains most; the first ``singles`` may also move."""
        n, back = np.array(out, np.int64)[:, None], np.arange(self.top.shape[0])
        more = n - back
        room = self.top[back, np.clip(self.top.shape[1] - 1 - more, 0, self.top.shape[1] - 1)].astype(np.int64)
        gain = np.where((more > 0) & (room >= 0), 2 * more * (room - fill + more), 0)
        gain[singles:, 0] = 0
        k, s = divmod(int(gain.argmax()), gain.shape[1])
        return (k, s, next(iter(self.bins[s][int(room[k, s])]))) if gain[k, s] > 0 else None


def local_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Empty underfull bins by moves and exchanges that raise the sum of squared fills.

    The emptiest bin gives until it is empty or no exchange helps; then the next one. Bins
    that were settled are taken up again after others have changed. Stops at the least number of
    bins that the total length allows, or when no exchange of any two bins helps.
    """
    fills = [int(lengths[b].sum()) for b in bins]
    size = lengths.tolist()
    least, count = -(-int(lengths.sum()) // capacity), len(bins)
    if count <= least:
        return [b for b in bins if b]
    items = {b: list(bins[b]) for b in range(len(bins)) if fills[b] < capacity}
    places, kinds = _Places(capacity), lambda b: {size[i] for i in items[b]}
    for b in items:
        places.add(b, fills[b], kinds(b))
    todo = [(fills[b], b) for b in items]
    heapq.heapify(todo)
    settled, changes = {}, 0  # bin -> number of changes when it was settled
    while count > least:
        if not todo:
            todo = [(fills[b], b) for b, at in settled.items() if at < changes]
            if not todo:
                break
            for _, b in todo:
                del settled[b]
            heapq.heapify(todo)
        fill, a = heapq.heappop(todo)
        if a not in items or fill != fills[a] or a in settled:
            continue
        one = {size[i]: (i,) for i in sorted(items[a])}
        two = {}
        for x, i in enumerate(items[a]):
            for j in items[a][x + 1 :]:
                if size[i] + size[j] not in two:
                    two[size[i] + size[j]] = (i, j)
        ways = [*one.items(), *two.items()]
        places.remove(a, fill, kinds(a))
        step = places.best([n for n, _ in ways], len(one), fill)
        if step is None:
            places.add(a, fill, kinds(a))
            settled[a] = changes
            continue
        k, s, b = step
        places.remove(b, fills[b], kinds(b))
        back = [next(i for i in items[b] if size[i] == s)] if s else []
        for i in ways[k][1]:
            items[a].remove(i)
            items[b].append(i)
        for i in back:
            items[b].remove(i)
            items[a].append(i)
        fills[a] -= ways[k][0] - s
        fills[b] += ways[k][0] - s
        changes += 1
        for x in (a, b):
            settled.pop(x, None)
            if not items[x] or fills[x] == capacity:
                bins[x] = items.pop(x)
                count -= not bins[x]
            else:
                places.add(x, fills[x], kinds(x))
                heapq.heappush(todo, (fills[x], x))
    for b, own in items.items():
        bins[b] = own
    return [b for b in bins if b]


def _cut(content: str, end_id: int, capacity: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content).encode
        for batch in batches:
            for part in slices(batch):
                rows = []
                for key, ids in zip(part.column("doc_id").to_pylist(), encode(part.column("text").to_pylist()), strict=True):
                    ids += end
                    n, at = len(ids) // 4, 0
                    for piece in range(-(-n // capacity)):
                        to = at + ((n - 1) % capacity + 1 if not piece else capacity)
                        rows.append((key, piece, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                        at = to
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    return run


def pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Every document's pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32."""
    content = read_tokenizer(tokenizer or default_tokenizer())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(content, end_id, capacity), PIECES)


def _packer(capacity: int, base: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        bins = local_search(lengths, best_fit(lengths, capacity), capacity)
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, own in enumerate(bins):
            sequence[own] = (base + int(key[0]) << 24) + k
            offset[own] = np.cumsum(lengths[own]) - lengths[own]
        return rows.assign(sequence_id=sequence, offset=offset).drop(columns="shard")

    return run


def pack(items: DataFrame, capacity: int = 1024, shard_items: int = 8192, merge: int = 8) -> DataFrame:
    """Pack rows with a ``length`` (see ``PIECES``) into sequences: adds sequence_id and offset.

    ``items`` must give the same rows whenever it is read. Shards hold about
    ``shard_items`` rows at any size of the input, dealt by a hash of all their columns.
    """
    spread = F.xxhash64("doc_id", "piece", "start", "ids_crc32")

    def dealt(df: DataFrame, each: int, base: int) -> DataFrame:
        shards = max(1, -(-df.count() // each))
        return df.withColumn("shard", F.pmod(spread, F.lit(shards))).groupBy("shard").applyInPandas(_packer(capacity, base), PACKED)

    first = materialize(dealt(items, shard_items, 0), "packed")
    fill = first.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where(F.col("fill") < capacity).select("sequence_id")
    under = first.join(fill, "sequence_id", "left_semi").drop("sequence_id", "offset")
    again = dealt(materialize(under, "underfull"), shard_items * merge, 1 << 30)
    return first.join(fill, "sequence_id", "left_anti").unionByName(again)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 2, tokenizer: str | None = None, shard_items: int = 8192, merge: int = 8) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(materialize(pieces(docs, capacity, end_id, tokenizer), "pieces"), capacity, shard_items, merge)
