"""Quality by a factorisation machine over hashed words, structure and length.

Features of a text: its distinct lower-cased words hashed into ``2 ** WORD_BITS`` places
(values of equal length in all, so that texts of any size compare), twelve statistics of
its structure, each as a number and as one of 16 steps, and its length. The machine
adds to linear weights a low-rank interaction of every pair of features, computed in linear
time as half of (square of the sum minus sum of the squares) in each dimension.

It is fitted on a bounded sample of ``sample`` labelled rows that are not held out, taken
by a hash of doc_id; everything else covers all rows. Labels, lang, source and doc_id are
no features.

Rows: null text counts as empty and gets a score like others; null doc_ids are held out;
repeated doc_ids are all scored; without labels every score is 1; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_labels
from .tokens import slices

WORD_BITS, RANK, STEPS, SAMPLE = 16, 8, 16, 8000
_MARKS, _HEAVY = re.compile(r"[^\w\s]+"), re.compile(r"([^\w\s])\1|[|$%&#*]")
_LATIN = bytes(range(256)).decode("latin-1")
_UPPER, _LOWER, _DIGIT = ("".join(re.findall(p, _LATIN)).encode("latin-1") for p in (r"[A-ZÀ-ÖØ-Þ]", r"[a-zß-öø-ÿ]", r"[0-9]"))
_ONLY_MARKS = re.sub(r"[\w\s]", " ", _LATIN).encode("latin-1")
STATISTICS = 12
SIZE = (1 << WORD_BITS) + STATISTICS * (STEPS + 1)


def signs(text: str) -> tuple[int, int, int, int, int]:
    """Numbers of upper and lower letters, digits, marks, and heavy ones: doubled marks and those of tables and code.

    Letters and digits counted are of Latin-1, where a byte is a character, so what goes when they are deleted tells their number.
    """
    near = text.encode("latin-1", "ignore")
    upper, lower, digits = (len(near) - len(near.translate(None, some)) for some in (_UPPER, _LOWER, _DIGIT))
    marks = near.translate(_ONLY_MARKS).decode("latin-1").split() if len(near) == len(text) else _MARKS.findall(text)
    return upper, lower, digits, sum(map(len, marks)), len(_HEAVY.findall(" ".join(marks)))


def structure(text: str, words: Counter) -> np.ndarray:
    """Twelve numbers between 0 and 1 about a text's form."""
    n, count = len(text) or 1, sum(words.values()) or 1
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    upper, lower, digits, marks, heavy = signs(text)
    return np.array([
        min(1.0, np.log1p(len(text)) / 14),
        upper / (upper + lower or 1),
        digits / n,
        min(1.0, 3 * marks / n),
        min(1.0, 10 * heavy / n),
        len(words) / count,
        max(words.values()) / count if words else 0.0,
        min(1.0, sum(len(w) * c for w, c in words.items()) / count / 20),
        len(set(lines)) / len(lines) if lines else 1.0,
        min(1.0, np.log1p(n / max(1, len(lines))) / 10),
        (text.count(".") + text.count("?") + text.count("!")) / n * 10 if n else 0.0,
        1.0 if not words else 0.0,
    ]).clip(0, 1)


def measures(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """A text's word places, distinct and ascending, and its structure."""
    words = Counter((text or "").split())
    places = {zlib.crc32(w.lower().encode()) & ((1 << WORD_BITS) - 1) for w in words}  # cheaper than to look up words in a large memory
    own = np.fromiter(places, np.int64, len(places))
    own.sort()
    return own, structure(text or "", words)


def features(own: np.ndarray, form: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text's measures."""
    base = 1 << WORD_BITS
    steps = base + STATISTICS + np.arange(STATISTICS) * STEPS + np.minimum(STEPS - 1, (form * STEPS).astype(np.int64))
    numbers = np.concatenate([own, base + np.arange(STATISTICS), steps])
    values = np.concatenate([np.full(len(own), 1 / np.sqrt(max(1, len(own)))), form, np.full(STATISTICS, 0.5)])
    return numbers, values.astype(np.float32)


def featurize(text: str | None, places: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and values of a text; ``places`` is not used any more."""
    return features(*measures(text))


class Sample(Sequence):
    """Features of the sample's rows, made when asked for from two bytes a word and the structure, which is all that the driver holds."""

    def __init__(self, own: pa.ChunkedArray, form: pa.ChunkedArray) -> None:
        self.own, self.form = own, form

    def __len__(self) -> int:
        return len(self.own)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return features(np.frombuffer(self.own[i].as_buffer(), np.uint16).astype(np.int64), np.frombuffer(self.form[i].as_buffer(), np.float64))


class Machine:
    """Weights of a factorisation machine."""

    def __init__(self, size: int = SIZE, rank: int = RANK, seed: int = 7) -> None:
        self.bias, self.linear = 0.0, np.zeros(size, np.float32)
        self.factors = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32)

    def margin(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Score before the logistic curve; every row has features."""
        starts = np.cumsum([0, *(len(a) for a, _ in rows[:-1])])
        at, x = np.concatenate([a for a, _ in rows]), np.concatenate([b for _, b in rows])
        return self._margin(at, x, starts)[0]

    def _margin(self, at, x, starts):
        v = self.factors[at] * x[:, None]
        sums = np.add.reduceat(v, starts, axis=0)
        squares = np.add.reduceat(v * v, starts, axis=0)
        return self.bias + np.add.reduceat(self.linear[at] * x, starts) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def fit(self, rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.1, ridge: float = 1e-5, seed: int = 7) -> Machine:
        """Logistic loss by AdaGrad over shuffled batches."""
        order, share = np.random.default_rng(seed), min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(share / (1 - share)))
        seen_l, seen_f, seen_b = np.full_like(self.linear, 1e-6), np.full_like(self.factors, 1e-6), 1e-6
        for _ in range(epochs):
            for part in np.array_split(order.permutation(len(rows)), max(1, len(rows) // batch)):
                own = [rows[i] for i in part]
                n = np.array([len(a) for a, _ in own])
                at, x, starts = np.concatenate([a for a, _ in own]), np.concatenate([b for _, b in own]), np.cumsum(n) - n
                z, sums = self._margin(at, x, starts)
                err = ((1 / (1 + np.exp(-z.clip(-30, 30)))) - y[part]).astype(np.float32) / len(part)
                each = np.repeat(err, n) * x
                to, back = np.unique(at, return_inverse=True)
                gl = np.bincount(back, each, len(to)).astype(np.float32) + ridge * self.linear[to]
                gv = np.repeat(sums, n, axis=0) - self.factors[at] * x[:, None]
                gf = np.stack([np.bincount(back, each * gv[:, k], len(to)) for k in range(gv.shape[1])], axis=1).astype(np.float32) + ridge * self.factors[to]
                seen_l[to] += gl * gl
                seen_f[to] += gf * gf
                seen_b += float(err.sum()) ** 2
                self.linear[to] -= rate * gl / np.sqrt(seen_l[to])
                self.factors[to] -= rate * 0.5 * gf / np.sqrt(seen_f[to])
                self.bias -= rate * float(err.sum()) / np.sqrt(seen_b)
        return self


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            got = [measures(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([a.astype(np.uint16).tobytes() for a, _ in got], pa.binary()), pa.array([b.tobytes() for _, b in got], pa.binary())], names=["doc_id", "y", "own", "form"])


def _score(machine):
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = machine.value
        for batch in batches:
            for part in slices(batch):
                z = fitted.margin([featurize(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 / (1 + np.exp(-z.clip(-500, 500).astype(np.float64))))], schema=schema)

    return run


def _accept(machine, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = float(np.log(threshold / (1 - threshold)))
        for batch in batches:
            for part in slices(batch):
                z = machine.value.margin([featurize(t) for t in part.column("text").to_pylist()])
                yield part.filter(pa.array(z >= least))

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine | None:
    """A machine fitted on at most ``sample`` labelled rows; None without any."""
    y = training_labels(labels, "quality")
    chosen = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    got = rows.mapInArrow(_measured, "doc_id long, y int, own binary, form binary").toArrow().sort_by("doc_id")  # sorted by Spark, they would be measured twice
    if not got.num_rows:
        return None
    return Machine().fit(Sample(got["own"], got["form"]), got["y"].to_numpy().astype(np.float32))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    machine = fit_quality(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if machine is None:
        scored = rows.select("doc_id", F.lit(1.0).alias("score"))
    else:
        scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(machine)), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def of_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    machine = fit_quality(docs, labels, sample)
    return docs if machine is None else docs.mapInArrow(_accept(docs.sparkSession.sparkContext.broadcast(machine), threshold), docs.schema)
