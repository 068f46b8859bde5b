"""Near-duplicates by HyperMinHash sketches, confirmed on the full shingle sets.

1. Every text becomes its set of word shingles (64-bit hashes of ``width`` words each).
   Texts with equal sets are one class, found by a groupBy on a hash of the set; a second
   hash tells sets apart that share the first, and these get classes of their own.
2. A class's sketch has 256 buckets; each holds, in 16 bits, the leading zeros and the next
   ten bits of the least hash that falls there. Empty buckets borrow from another bucket by
   a fixed order. Bands of six registers are hashed; classes that share a band meet.
3. In each bucket every class is held against the bucket's least class: first by the share
   of equal registers, corrected for registers that agree by chance, then on the full sets.
4. Confirmed links give components. Buckets whose other classes are not all in one component
   are then compared exactly, block against block of at most about ``block`` classes and
   ``room`` shingles, so no link in a bucket is lost, whatever its size, and only links are
   emitted. Blocks hold sets of like size and meet only blocks whose sizes allow a link.

No step emits all pairs of a group; hot bands and copies are reduced by partial aggregation
and joined back by keys that adaptive execution can split.

A link of similarity s is missed if no band agrees: for 42 bands of six and s = 0.85 about
once in 10**8 links, for s = 0.8 once in 10**5. The estimate lets a pair pass to the exact
comparison unless it lies five standard errors of 256 buckets below the threshold, which
befalls a link at the threshold itself less than once in 10**5 and a closer one less often
(measured in the tests: none of 2,000 links at the threshold).

Rows: null, empty and blank texts have an empty set, are linked with nothing and kept; fewer
words than ``width`` are one shingle; long texts are read whole; rows with null doc_id are linked as others are and join
components but name none, and are kept where theirs has no doc_id at all; repeated doc_ids keep their rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from .components import components
from .tokens import slices

BUCKETS, ROWS, BANDS, MANTISSA = 256, 6, 42, 10
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def _stir(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct shingle hashes of a text; words' hashes are remembered."""

    def __init__(self, width: int) -> None:
        self.width, self.memo = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII blanks only
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        k = min(self.width, len(h))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _stir(out * _MIX[0] + h[i : len(h) - k + 1 + i] + _MIX[1])
        return np.unique(out)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers, a row of 256 for each set; 0 where a bucket is empty."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    for row, s in zip(out, sets, strict=True):
        bucket = (s >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        rest = s[first] & np.uint64((1 << 56) - 1)
        top = np.maximum(np.frexp(rest.astype(np.float64))[1] - 1, 0)  # place of the leading one
        shift = np.maximum(top - MANTISSA, 0).astype(np.uint64)
        low = np.where(top >= MANTISSA, rest >> shift, rest << np.maximum(MANTISSA - top, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
        row[bucket[first]] = ((np.minimum(55 - top, 61) + 1).astype(np.uint64) << np.uint64(MANTISSA) | low).astype(np.uint16)
    return out


_ORDER = np.random.default_rng(20).permuted(np.tile(np.arange(BUCKETS), (BUCKETS, 1)), axis=1)


def filled(sketch: np.ndarray) -> np.ndarray:
    """Empty buckets take the register of the first bucket in their own order that is not empty."""
    out, own = sketch.copy(), np.flatnonzero((sketch == 0).any(axis=1) & (sketch != 0).any(axis=1))
    for step in range(BUCKETS):
        if not len(own):
            break
        part = out[own]
        part = np.where(part == 0, sketch[own][:, _ORDER[:, step]], part)
        out[own] = part
        own = own[(part == 0).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    x = filled(sketch)[:, : ROWS * BANDS].reshape(len(sketch), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2])
    for i in range(ROWS):
        h = _stir(h * _MIX[2] + x[:, :, i] + _MIX[0])
    return h.astype(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity of pairs of sketches corrected for chance, and the buckets it rests on."""
    used = ((a != 0) | (b != 0)).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    edge = 0.5 ** np.arange(41)[None, :]
    share_a, share_b = (-np.diff((1 - (1 - edge) ** (n[:, None] / BUCKETS)), axis=1) for n in (n_a, n_b))
    chance = (share_a * share_b).sum(axis=1) / (1 << MANTISSA)
    seen = same / np.maximum(used, 1)
    return (seen - chance) / (1 - chance), used


def _name(shingles: bytes) -> tuple[int, int]:
    """Node and proof of the class with this shingle set: the halves of a 128-bit hash."""
    high, low = divmod(xxhash.xxh3_128_intdigest(shingles), 1 << 64)
    return low - (1 << 63), high - (1 << 63)


FEATURES = "doc_id long, n_shingles long, node long, proof long, name long, sketch binary"


def _features(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("proof", pa.int64()), ("name", pa.int64()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for part in slices(batch):
                sets = [shingles(t) for t in part.column("text").to_pylist()]
                sketch = registers(sets)
                name = [_name(s.tobytes()) if len(s) else (None, None) for s in sets]
                node, proof = (pa.array([x[i] for x in name], pa.int64()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), node, proof, node, pa.array([r.tobytes() for r in sketch], pa.binary())], schema=schema)

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 4096):
            part = batch.slice(i, 4096)
            sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            node = np.asarray(part.column("node"))
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(sketch).reshape(-1)), pa.array(np.repeat(node, BANDS))], names=["band", "node"])


def _likely(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("sketch", "pivot_sketch"))
                got, used = estimate(a, b, *(np.asarray(part.column(c), dtype=np.float64) for c in ("n", "pivot_n")))
                keep = got >= threshold - 5 * np.sqrt(threshold * (1 - threshold) / np.maximum(used, 1))
                yield part.select(["node", "pivot"]).filter(pa.array(keep))

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for part in slices(batch):
                found = [shingles(t).tobytes() for t in part.column("text").to_pylist()]
                own = [_name(s)[1] == p for s, p in zip(found, part.column("proof").to_pylist(), strict=True)]  # another row may have the same doc_id
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(found, pa.binary())], names=["node", "shingles"]).filter(pa.array(own, pa.bool_()))

    return run


def _named_sets(width: int):
    """The set of each text with both halves of the hash that names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for part in slices(batch):
                found = [s.tobytes() for s in map(shingles, part.column("text").to_pylist()) if len(s)]
                names = [_name(s) for s in found]
                halves = [pa.array([n[i] for n in names], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*halves, pa.array(found, pa.binary())], names=["name", "proof", "shingles"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("shingles"), batch.column("pivot_shingles"), strict=True):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.sort(np.concatenate([a, b]))
                inter = int((both[1:] == both[:-1]).sum())
                keep.append(den * inter >= num * (len(a) + len(b) - inter))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("pivot")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _blocks(num: int, den: int):
    """Exact links between classes of one bucket's two blocks, as a forest."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if rows["root"].nunique() < 2:
            return none
        rows = rows.drop_duplicates("node").sort_values("node")
        sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"]]
        size = np.array([len(s) for s in sets], np.int64)
        owner, flat = np.repeat(np.arange(len(sets)), size), np.concatenate(sets)
        _, at, often = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(often > 1)
        place = np.full(len(often), -1)
        place[shared] = np.arange(len(shared))
        at = place[at]
        inter = np.zeros((len(sets), len(sets)), np.float64)
        order = np.argsort(at, kind="stable")
        at, owner = at[order], owner[order]
        for lo in range(0, len(shared), 4096):
            a, b = np.searchsorted(at, [lo, lo + 4096])
            m = np.zeros((len(sets), min(4096, len(shared) - lo)), np.float32)
            m[owner[a:b], at[a:b] - lo] = 1
            inter += m @ m.T
        union = size[:, None] + size[None, :] - inter
        root, node = rows["root"].to_numpy(), rows["node"].to_numpy()
        i, j = np.nonzero(np.triu((den * inter >= num * union) & (root[:, None] != root[None, :]), 1))
        parent = {r: r for r in root.tolist()}

        def find(r):
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        out = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            p, q = find(root[x]), find(root[y])
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append((node[x], node[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64") if out else none

    return run


def classes_of(features: DataFrame) -> DataFrame:
    """A row for each node: least doc_id, sketch, size, its least and last proof, and the first half of the hash that names its set."""
    some = features.where("n_shingles > 0").groupBy("node")
    return materialize(some.agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"), F.min("proof").alias("proof"), F.max("proof").alias("last"), F.min("name").alias("name")), "classes")


def told_apart(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features and their classes, each class with a node of its own.

    Nodes are 64 bits; of n classes some n * n / 2**65 share one (three of 10**10). Those
    with another proof than the least one of their node are given another node.
    """
    classes = classes_of(features)
    while not (shared := classes.where("proof <> last").select("node", F.col("proof").alias("own"))).isEmpty():
        other = F.col("proof") != F.col("own")
        rows = features.join(shared, "node", "left").withColumn("node", F.when(other, F.xxhash64("node", "proof")).otherwise(F.col("node")))
        features = materialize(rows.select(features.columns), "features")
        classes = classes_of(features)
    return features, classes


def in_blocks(classes: DataFrame, limit: Fraction, block: int, room: int) -> DataFrame:
    """(band, node, root, n) of open buckets, dealt to each pair of blocks (l, i, m, j) that may hold a link.

    A level holds the sizes within one ratio of 1 / ``limit``, so that a link joins one level or two neighbours.
    """
    ratio = max(math.log(1 / limit), 1e-3) * (1 + 1e-9)
    rows = materialize(classes.withColumn("level", F.floor(F.log("n") / ratio).cast("int")), "open")
    parts = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / room)).cast("int")
    sizes = rows.groupBy("band", "level").agg(parts.alias("parts"))
    for name, step in (("below", 1), ("above", -1)):
        rows = rows.join(sizes.select("band", (F.col("level") + step).alias("level"), F.col("parts").alias(name)), ["band", "level"], "left")
    rows = rows.join(sizes, ["band", "level"]).withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    level, own = F.col("level"), F.col("own")

    def pairs(parts: str, to_pair) -> Column:
        return F.when(F.col(parts).isNotNull(), F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda x: F.struct(*(c.alias(n) for n, c in zip("limj", to_pair(x), strict=True)))))

    same = pairs("parts", lambda x: (level, F.least(own, x), level, F.greatest(own, x)))
    up = pairs("above", lambda x: (level, own, level + 1, x))
    down = pairs("below", lambda x: (level - 1, x, level, own))
    return rows.select("band", "node", "root", F.inline(F.flatten(F.array_compact(F.array(same, up, down)))))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: Fraction | str = "0.8", block: int = 512, room: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id (the component's smallest doc_id), kept, for every document."""
    limit = Fraction(threshold)
    num, den = limit.numerator, limit.denominator
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = materialize(rows.mapInArrow(_features(width), FEATURES), "features")
    features, classes = told_apart(features)
    some = features.where("n_shingles > 0")

    bands = classes.select("node", "sketch").mapInArrow(_bands, "band long, node long")
    full = bands.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    members = materialize(bands.join(full, "band"), "members")
    pairs = members.where("node <> pivot").select("node", "pivot").distinct()
    left, right = classes.select("node", "sketch", "n"), classes.select(F.col("node").alias("pivot"), F.col("sketch").alias("pivot_sketch"), F.col("n").alias("pivot_n"))
    likely = materialize(pairs.join(left, "node").join(right, "pivot").mapInArrow(_likely(float(limit)), "node long, pivot long"), "likely")

    # full sets of the classes that meet another one: the shingles of one of their texts, found by its doc_id, or by its set's name where no row has one
    meets = members.where("size > 2").select("node").union(likely.select("node")).union(likely.select("pivot")).distinct()
    chosen = classes.join(meets, "node").select("node", "proof", "name", F.col("least").alias("doc_id"))
    texts = rows.join(chosen.drop("name"), "doc_id")
    sets = texts.select("node", "proof", "text").mapInArrow(_sets(width), "node long, shingles binary")
    nameless = rows.where("doc_id IS NULL AND text IS NOT NULL").select("text").mapInArrow(_named_sets(width), "name long, proof long, shingles binary")
    sets = sets.unionByName(nameless.join(chosen.where("doc_id IS NULL").drop("doc_id"), ["name", "proof"]).select("node", "shingles"))
    sets = materialize(sets.dropDuplicates(["node"]), "sets")
    pivots = sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("pivot_shingles"))
    links = materialize(likely.join(sets, "node").join(pivots, "pivot").select("node", "pivot", "shingles", "pivot_shingles").mapInArrow(_confirm(num, den), "a long, b long"), "links")
    roots = components(links)

    # buckets with classes beside the least one that are still apart: blocks, exactly
    others = members.where("size > 2").join(roots, "node", "left").select("band", "node", "pivot", F.coalesce("root", "node").alias("root"))
    apart = others.where("node <> pivot").groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    open_ = others.where("node <> pivot").join(apart, "band").join(classes.select("node", "n"), "node").select("band", "node", "root", "n")
    dealt = in_blocks(open_, limit, block, room)
    more = dealt.join(sets, "node").groupBy("band", "l", "i", "m", "j").applyInPandas(_blocks(num, den), "a long, b long")
    more = materialize(more.distinct(), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    named = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(names, "root").select("node", "component_id")
    linked = some.select("doc_id", "n_shingles", "node").join(label, "node").select("doc_id", "n_shingles", "component_id")
    alone = features.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.unionByName(alone).withColumn("kept", kept)


def one_of_each(docs: DataFrame, width: int = 5, threshold: Fraction | str = "0.8") -> DataFrame:
    """The document of each component with the smallest doc_id, with all columns; rows without doc_id stay."""
    kept = near_duplicates(docs, width, threshold).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept")).distinct()
    named = docs.join(kept, F.col("doc_id") == F.col("_kept"), "left_semi")
    return named.unionByName(docs.where("doc_id IS NULL"))
