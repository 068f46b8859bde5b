"""Language by bit-sliced Bloom filters of letter n-grams.

Each language has a Bloom filter of the n-grams that it holds. The filters are sliced: a row
for each bit position, with a bit for each language, so that the rows of an n-gram's
positions, and-ed, give at once the mask of all languages whose filter contains it. A
document's popcount of a language is the number of its n-grams with that language's bit.
Filters of languages with many n-grams answer yes more often by chance; with the measured
rate f of such answers, the share of n-grams held is (count / n - f) / (1 - f). The language
with the largest share is the answer, and the share its score.

n-grams are windows of three and four characters over lower-cased words with a mark at both
ends, so each letter has one of three. A language holds an n-gram that makes up at least
``RATIO`` of the share among its own n-grams that it has among all languages' ones: a foreign word or passage in a
few documents doesn't make its n-grams the language's own.

Counts come from every document that may be learned from: they are added up in each task,
then by a partially aggregated groupBy, and stay a table. Only the slices go to the tasks, of
``SLICES`` bytes at most whatever the corpus; the number of rows is a power of two, at least eight for each n-gram of
the largest language as long as that bound allows, and beyond it the filters fill up and the correction grows.
At most ``LANGUAGES`` languages are told apart; with more an error is raised.

Rows: null texts and texts without a letter are ``und`` with score 0, as is every text where
nothing can be learned; null doc_ids are held out; a null lang is not learned from, an empty one is a language; repeated rows count each; equal
texts are alike; equal shares go to the language with more n-grams, then to the first in byte order; long
texts are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from .labelled import held_out
from .tokens import slices

PROBES, RATIO = 4, 0.5
SLICES, LANGUAGES, BLOCK = 1 << 25, 1 << 12, 1 << 16
UNKNOWN = "und"
CHARS = 400_000  # characters whose n-grams are held at once

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True for code points that are letters; made once in a worker."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def stir(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place of its text) of every n-gram: three characters around each letter, and four if another letter follows."""
    lower = [t.lower() if t else "" for t in texts]
    points = np.frombuffer(("\n" + "\n".join(lower) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(lower), dtype=np.int32), np.array([len(t) + 1 for t in lower], np.int64))
    letter = letters()[points]
    kept = letter | np.append(True, letter[:-1])  # letters, and one mark behind each word
    kept[0] = True
    x = np.where(letter[kept], points[kept], 0).astype(np.uint64)
    owner = np.append(np.int32(0), owner)[kept]
    at = np.flatnonzero(x[1:-1]) + 1
    three = x[at - 1] << np.uint64(42) | x[at] << np.uint64(21) | x[at + 1]
    more = np.flatnonzero(x[at + 1])
    four = stir(three[more]) + x[at[more] + 2] + np.uint64(1)
    return np.concatenate([stir(three), stir(four)]), np.concatenate([owner[at], owner[at[more]]])


def _count(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("gram", pa.int64()), ("lang", pa.string()), ("n", pa.int64())])
    found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(grams, kind="stable")
        grams, n = grams[order], n[order]
        first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
        return grams[first], np.add.reduceat(n, first)

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, parts in found.items():
            grams, n = merged(parts)
            for i in range(0, len(grams), 100_000):
                g = grams[i : i + 100_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array([lang] * len(g), pa.string()), pa.array(n[i : i + 100_000])], schema=schema)

    size = 0
    for batch in batches:
        for part in slices(batch, CHARS):
            langs = part.column("lang").to_pylist()
            names = list(dict.fromkeys(langs))
            hashes, owner = ngrams(part.column("text").to_pylist())
            of = np.array([names.index(v) for v in langs] if len(names) < 50 else pd.factorize(np.array(langs, object))[0])[owner]
            order = np.argsort(of, kind="stable") if len(names) > 1 else slice(None)
            cuts = np.append(0, np.cumsum(np.bincount(of, minlength=len(names))))
            hashes = hashes[order]
            for i, name in enumerate(names):
                own = np.sort(hashes[cuts[i] : cuts[i + 1]])
                if len(own):
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    found.setdefault(name, []).append((own[first], np.diff(first, append=len(own))))
                    size += len(first)
            if size > most:
                found = {k: [merged(v)] for k, v in found.items()}
                size = sum(len(v[0][0]) for v in found.values())
                if size > most // 2:
                    yield from rows()
                    found, size = {}, 0
    yield from rows()


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(gram, lang, n): occurrences in all documents that may be learned from."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = train.select("text", "lang").mapInArrow(_count, "gram long, lang string, n long")
    return materialize(counts.groupBy("gram", "lang").agg(F.sum("n").alias("n")), "ngrams")


class Filters:
    """Bit-sliced Bloom filters: ``rows`` holds a byte for each bit position and eight languages."""

    def __init__(self, names: list[str], rows: np.ndarray) -> None:
        self.names, self.rows = names, rows
        bits = np.zeros(8 * rows.shape[1], np.int64)
        for j in range(rows.shape[1]):
            bits[8 * j : 8 * j + 8] = np.bincount(rows[:, j], minlength=256) @ _BITS
        self.chance = (bits[: len(names)] / len(rows)) ** PROBES

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bytes of eight bits."""
        last = np.uint64(len(self.rows) - 1)
        step = hashes >> np.uint64(32) | np.uint64(1)
        found = self.rows[hashes & last]
        for i in range(1, PROBES):
            found &= self.rows[(hashes + np.uint64(i) * step) & last]
        return found

    def popcounts(self, hashes: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
        """For each text, how many of its n-grams each language contains."""
        masks, out = self.masks(hashes), np.zeros((texts, 8 * self.rows.shape[1]), np.int64)
        for j in range(masks.shape[1]):  # a histogram of the mask's bytes, and the bits in each byte
            seen = np.bincount(owner.astype(np.int64) << 8 | masks[:, j], minlength=texts << 8)
            out[:, 8 * j : 8 * j + 8] = seen.reshape(texts, 256) @ _BITS
        return out[:, : len(self.names)]

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams, share of them that each language holds, corrected for chance) of each text."""
        hashes, owner = ngrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        seen = self.popcounts(hashes, owner, len(texts)) / np.maximum(n, 1)[:, None]
        return n, (seen - self.chance) / np.maximum(1 - self.chance, 1e-9)


_BITS = (np.arange(256)[:, None] >> np.arange(8)[None, :] & 1).astype(np.int64)


def _slice(width: int):
    """The rows of a block of bit positions for eight languages, as bytes."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(width, np.uint8)
        out[rows["at"].to_numpy() % width] = rows["bits"].to_numpy()
        return pd.DataFrame({"block": [key[0]], "byte": [key[1]], "bits": [out.tobytes()]})

    return run


def fit_filters(docs: DataFrame, ratio: float = RATIO, slices_bytes: int = SLICES) -> Filters | None:
    """The filters of all languages, or None where nothing can be learned."""
    counts = count_ngrams(docs)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).orderBy(F.col("total").desc(), "lang").limit(LANGUAGES + 1).collect()
    if len(totals) > LANGUAGES:
        raise ValueError(f"at most {LANGUAGES} languages are told apart")
    if not totals:
        return None
    names, everything = [r.lang for r in totals], sum(r.total for r in totals)
    known = docs.sparkSession.createDataFrame([(r.lang, i, r.total) for i, r in enumerate(totals)], "lang string, own int, total long")
    pooled = counts.groupBy("gram").agg(F.sum("n").alias("pooled"))
    held = counts.join(pooled, "gram").join(F.broadcast(known), "lang").where(F.col("n") / F.col("total") >= ratio * F.col("pooled") / F.lit(everything))
    held = materialize(held.select("gram", "own"), "held")
    largest = held.groupBy("own").count().agg(F.max("count")).first()[0]
    bytes_of_row = -(-len(names) // 8)
    size = 1 << min(max(16, (8 * largest - 1).bit_length()), (slices_bytes // bytes_of_row).bit_length() - 1)
    step = F.shiftrightunsigned("gram", 32).bitwiseOR(F.lit(1).cast("long"))
    low = F.col("gram").bitwiseAND(F.lit(size - 1).cast("long"))
    places = F.array(*((low + F.lit(i) * step).bitwiseAND(F.lit(size - 1).cast("long")) for i in range(PROBES)))
    bits = held.select(F.explode(places).alias("at"), (F.col("own") / 8).cast("int").alias("byte"), F.expr("shiftleft(1, own % 8)").alias("bit"))
    bits = bits.groupBy("at", "byte").agg(F.bit_or("bit").alias("bits"))
    width = min(size, BLOCK)
    blocks = bits.groupBy(F.floor(F.col("at") / width).alias("block"), "byte").applyInPandas(_slice(width), "block long, byte int, bits binary")
    rows = np.zeros((size, bytes_of_row), np.uint8)
    for r in blocks.toLocalIterator():
        rows[r.block * width : (r.block + 1) * width, r.byte] = np.frombuffer(r.bits, np.uint8)
    return Filters(names, rows)


def _predict(sent):
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        for batch in batches:
            for part in slices(batch, CHARS):
                n, shares = filters.shares(part.column("text").to_pylist())
                best = shares.argmax(axis=1)
                score = np.where(n > 0, np.clip(shares[np.arange(len(n)), best], 0, 1), 0.0)
                names = [filters.names[b] if k else UNKNOWN for b, k in zip(best.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], schema=schema)

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    filters = fit_filters(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if filters is None:
        found = rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        found = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(filters)), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
