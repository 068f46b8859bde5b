"""Toxicity by class-conditional Kneser-Ney models of the letters in words.

Two models of order 5 give the log-likelihood of each letter of a word (and of its end)
from the letters before it, back to the word's start: one learned from toxic, one from
ordinary labelled documents. Each discounts its own counts and gives the discounted share to one
shared Kneser-Ney distribution of the shorter context, whose orders count distinct contexts
in both classes; a context that a class doesn't know leaves all to the shared one. So an
inflected or rare expression is judged by the letter sequences that it shares with known
ones. The classes' discounts have the ratio of their sizes (``DISCOUNT`` in the smaller one), so that an
expression as frequent in both loses the same share in both.

The words of a text are compared one by one, each by the ratio of its two likelihoods (``MOST`` at most, as a
logarithm), and the text's score is the logarithm of the mean of these ratios over its words: the
likelihood that a word at some place of it, none preferred, is the toxic model's, against that of ordinary words
alone, normalised by the number of places. So a single expression stands out of a long text, where a mean of
logarithms would drown it. The score goes through a
logistic curve fitted to the labelled rows, whose middle lies at the cut with the fewest wrong rows among them, a missed
toxic one counted as ``MISSED``.

Counts come from every labelled row (never held-out ones): the documents that have a word
are counted by a partially aggregated groupBy, and letter sequences from the counted words.
Sequences, contexts and continuations are tables that grow with the corpus; so are the
log-probabilities of all sequences of all documents' distinct words, counted or not, which are joined with
these words. The values of the ``CACHE`` sequences that most words have, and later of the ``CACHE`` words that most documents
have, go to the tasks, so that words send only their other sequences, and documents only their other words, to a join:
caches, which change no result, as log-probabilities and ratios are added up in whole units of 2**-30 and 2**-24.

Rows: null and empty texts have no letters and get the curve's value at 0; null doc_ids
are held out; repeated doc_ids are all scored, equal texts alike; long texts are read whole; without labels of both classes every
document gets the share of toxic labels, or 0 without labels; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize
from .labelled import held_out, logistic, training_labels
from .tokens import slices

ORDER, DISCOUNT, SHARED_DISCOUNT = 5, 3.0, 0.75
UNIT = 1 << 30  # whole units of a log-probability
MOST, RATIO_UNIT = 8.0, 1 << 24  # the largest logarithm of a word's ratio that counts, and whole units of ratios
MISSED = 3.0
CACHE, CACHED_LETTERS = 200_000, 64
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a text."""
    return _WORD.findall(text.lower()) if text else []


def sequences(word: str, order: int = ORDER) -> list[str]:
    """For each letter of the word and its end: the letter after those before it, at most ``order`` in all."""
    marked = f"^{word}$"
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("plain", pa.int64())])

    def flush(found):
        words = list(dict.fromkeys([*found[1], *found[0]]))
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([found[1][w] for w in words], pa.int64()), pa.array([found[0][w] for w in words], pa.int64())], schema=schema)

    found = (Counter(), Counter())
    for batch in batches:
        for part in slices(batch):
            for text, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist(), strict=True):
                found[y].update(set(words_of(text)))
                if len(found[0]) + len(found[1]) > 300_000:
                    yield flush(found)
                    found = (Counter(), Counter())
    if found[0] or found[1]:
        yield flush(found)


def _count_sequences(order: int):
    schema = pa.schema([("gram", pa.string()), ("toxic", pa.int64()), ("plain", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64())], schema=schema)

        for batch in batches:
            for word, t, p in zip(*(batch.column(c).to_pylist() for c in ("word", "toxic", "plain")), strict=True):
                for gram in sequences(word, order):
                    v = found[gram]
                    v[0] += t
                    v[1] += p
                if len(found) > 300_000:
                    yield flush()
                    found.clear()
        if found:
            yield flush()

    return run


def _before(gram: str):
    """A sequence without its last letter."""
    return F.substr(F.col(gram), F.lit(1), F.length(gram) - 1)


def _after(gram: str):
    """A sequence without its first letter."""
    return F.substr(F.col(gram), F.lit(2))


class SharedBackoff:
    """Kneser-Ney distribution of a sequence's last letter over distinct continuations in both classes.

    ``known`` (tail, shared) has every counted sequence without its first letter and all that
    these back off to; ``contexts`` (context, below) the share that each context leaves to the shorter one.
    """

    def __init__(self, grams: DataFrame, order: int = ORDER, discount: float = SHARED_DISCOUNT) -> None:
        cuts = F.transform(F.sequence(F.lit(1), F.length("gram") - 1), lambda at: F.substr(F.col("gram"), at))
        parts = grams.where(F.length("gram") > 1).select(F.explode(cuts).alias("part")).distinct()
        kinds = materialize(parts.groupBy(_after("part").alias("tail")).agg(F.count("*").alias("n")), "kinds")
        sums = kinds.groupBy(_before("tail").alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("fan"))
        sums = sums.withColumn("below", discount * F.col("fan") / F.col("total"))
        self.order, self.start = order, 1.0 / (kinds.where(F.length("tail") == 1).count() + 1)
        self.contexts = materialize(sums.select("context", "below"), "contexts")
        own = F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")
        terms = materialize(kinds.join(sums, _before("tail") == F.col("context")).select("tail", own.alias("own"), "below"), "terms")
        done = [materialize(terms.where(F.length("tail") == 1).select("tail", (F.col("own") + F.col("below") * self.start).alias("shared")), "shared")]
        for n in range(2, order):  # settled by a join with those one letter shorter
            shorter = done[-1].select(F.col("tail").alias("shorter"), "shared")
            level = terms.where(F.length("tail") == n).join(shorter, _after("tail") == F.col("shorter"))
            done.append(materialize(level.select("tail", (F.col("own") + F.col("below") * F.col("shared")).alias("shared")), "shared"))
        self.known = reduce(DataFrame.unionByName, done)

    def of(self, grams: DataFrame) -> DataFrame:
        """(gram, shared) of any sequences: the longest known tail, and what the contexts beyond it leave to it."""
        tails = F.transform(F.sequence(F.lit(2), F.length("gram")), lambda at: F.substr(F.col("gram"), at))
        rows = grams.select("gram", F.explode(tails).alias("tail"))
        rows = rows.join(self.known, "tail", "left").join(self.contexts, _before("tail") == F.col("context"), "left")
        steps = F.sort_array(F.collect_list(F.struct(F.length("tail").alias("n"), "shared", "below")))  # at most ``order`` of them
        found = F.aggregate("steps", F.lit(self.start), lambda s, x: F.coalesce(x["shared"], F.coalesce(x["below"], F.lit(1.0)) * s))
        return rows.groupBy("gram").agg(steps.alias("steps")).select("gram", found.alias("shared"))


class ClassModels:
    """Both classes' probabilities of a sequence's last letter after the others, from counted sequences (gram, toxic, plain)."""

    def __init__(self, grams: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> None:
        self.grams, self.backoff = grams, SharedBackoff(grams, order)
        toxic, plain = grams.where(F.length("gram") == 2).agg(F.sum("toxic"), F.sum("plain")).first()  # words
        least = max(1, min(toxic or 0, plain or 0))
        self.discounts = tuple(discount * max(1.0, (n or 0) / least) for n in (toxic, plain))
        sums = [F.sum("toxic").alias("nt"), F.sum("plain").alias("no")]
        lost = [F.sum(F.least(F.col(c), F.lit(d))).alias(name) for c, d, name in zip(("toxic", "plain"), self.discounts, ("lt", "lo"), strict=True)]
        self.contexts = materialize(grams.groupBy(_before("gram").alias("context")).agg(*sums, *lost), "class-contexts")

    def scores(self, grams: DataFrame) -> DataFrame:
        """(gram, toxic, plain): logarithms in whole units for distinct sequences, whether they were counted or not."""
        seen = grams.join(self.grams, "gram").join(self.backoff.known, _after("gram") == F.col("tail")).select("gram", "toxic", "plain", "shared")
        new = self.backoff.of(grams.join(self.grams, "gram", "left_anti")).select("gram", F.lit(0).alias("toxic"), F.lit(0).alias("plain"), "shared")
        rows = seen.unionByName(new).join(self.contexts, _before("gram") == F.col("context"), "left")
        for c, d, n, lost in zip(("toxic", "plain"), self.discounts, ("nt", "no"), ("lt", "lo"), strict=True):
            p = (F.greatest(F.col(c) - d, F.lit(0.0)) + F.col(lost) * F.col("shared")) / F.nullif(n, F.lit(0))
            rows = rows.withColumn(c, F.round(F.log(F.coalesce(p, "shared")) * UNIT).cast("long"))
        return rows.select("gram", "toxic", "plain")


def _valued(sent, order: int):
    """Each word's sum of the differences of its sequences that were sent; the others in ``rest``, null without any."""
    schema = pa.schema([("word", pa.string()), ("docs", pa.int64()), ("difference", pa.int64()), ("rest", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = dict(zip(*(sent.value[c].to_pylist() for c in ("gram", "difference")), strict=True))
        for batch in batches:
            sums, rest = [], []
            for word in batch.column("word").to_pylist():
                own = sequences(word, order)
                found = [values.get(g) for g in own]
                if None in found:
                    rest.append([g for g, v in zip(own, found, strict=True) if v is None])
                    sums.append(sum(v for v in found if v is not None))
                else:
                    rest.append(None)
                    sums.append(sum(found))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("docs"), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.string()))], schema=schema)

    return run


def _frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """At most ``most`` of the rows with the largest counts, cut between steps of the count's logarithm."""
    stepped = rows.withColumn("step", F.floor(F.log2(count) * 4))
    cut, left = None, most
    for r in stepped.groupBy("step").agg(F.count("*").alias("n")).orderBy(F.col("step").desc()).collect():
        left -= r.n
        if left < 0:
            break
        cut = r.step
    return stepped.where(F.lit(False) if cut is None else F.col("step") >= cut).drop("step")


def word_values(docs: DataFrame, models: ClassModels, order: int = ORDER, cache: int = CACHE) -> DataFrame:
    """(word, docs, ratio): the ratio of each distinct word's two likelihoods in whole units, and how many documents have it.

    The ``cache`` sequences that most words have go to the tasks with their values; only words with others are joined.
    """
    counted = docs.where(F.col("text").isNotNull()).select("text", F.lit(0).alias("y")).mapInArrow(_count_words, "word string, toxic long, plain long")
    words = materialize(counted.groupBy("word").agg(F.sum("plain").alias("docs")), "vocabulary")
    spelt = words.select("word", F.lit(0).alias("toxic"), F.lit(1).alias("plain")).mapInArrow(_count_sequences(order), "gram string, toxic long, plain long")
    grams = materialize(spelt.groupBy("gram").agg(F.sum("plain").alias("n")), "spelt")
    scores = models.scores(grams.select("gram")).select("gram", (F.col("toxic") - F.col("plain")).alias("difference"))
    scores = materialize(scores.join(grams, "gram"), "scores")
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(scores, "n", cache).select("gram", "difference").toArrow())
    valued = materialize(words.mapInArrow(_valued(sent, order), "word string, docs long, difference long, rest array<string>"), "valued")
    other = valued.select("word", F.explode("rest").alias("gram")).join(scores.drop("n").withColumnRenamed("difference", "more"), "gram").groupBy("word").agg(F.sum("more").alias("more"))
    joined = valued.where(F.col("rest").isNotNull()).join(other, "word").select("word", "docs", (F.col("difference") + F.col("more")).alias("difference"))
    values = valued.where(F.col("rest").isNull()).select("word", "docs", "difference").unionByName(joined)
    ratio = F.exp(F.least(F.col("difference") / F.lit(float(UNIT)), F.lit(MOST)))
    return materialize(values.select("word", "docs", F.round(ratio * RATIO_UNIT).cast("long").alias("ratio")), "values")


def _cached(values: DataFrame, most: int) -> pa.Table:
    """(word, ratio): at most ``most`` of the words that most documents have, with their values."""
    return _frequent(values.where(F.length("word") <= CACHED_LETTERS), "docs", most).select("word", "ratio").toArrow()


def _partly(cached):
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("ratio", pa.int64()), ("words", pa.int64()), ("rest", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = dict(zip(*(cached.value[c].to_pylist() for c in ("word", "ratio")), strict=True))
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column("text").to_pylist():
                    words = Counter(words_of(text))
                    ratio, rest = 0, []
                    for w, n in words.items():
                        v = values.get(w)
                        if v is None:
                            rest.append(w)
                        else:
                            ratio += n * v
                    rows.append((ratio, words.total(), rest, [words[w] for w in rest]))
                columns = [pa.array(c, schema.field(i + 2).type) for i, c in enumerate(zip(*rows))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *columns], schema=schema)

    return run


def _key(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def text_differences(docs: DataFrame, models: ClassModels, order: int = ORDER, cache: int = CACHE) -> DataFrame:
    """(doc_id, key, difference) of every document: the logarithm of the mean ratio of its words.

    ``key`` is the text's digest.
    """
    values = word_values(docs, models, order, cache)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("key"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(_cached(values, cache))
    partly = rows.mapInArrow(_partly(sent), "doc_id long, key string, ratio long, words long, rest array<string>, times array<bigint>")
    partly = materialize(partly.withColumn("row", F.monotonically_increasing_id()), "partly")
    other = partly.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("word"), "x.times")
    other = other.join(values.drop("docs"), "word").groupBy("row").agg(F.sum(F.col("times") * F.col("ratio")).alias("other"))
    mean = F.greatest(F.col("ratio") + F.coalesce("other", F.lit(0)), F.lit(1)) / F.lit(float(RATIO_UNIT)) / F.col("words")
    whole = partly.drop("rest", "times").join(other, "row", "left")
    return whole.select("doc_id", "key", F.when(F.col("words") > 0, F.log(mean)).otherwise(0.0).alias("difference"))


class ToxicityModel:
    """The logistic curve over the differences."""

    def __init__(self, slope: float, offset: float) -> None:
        self.slope, self.offset = slope, offset

    def curve(self, raw: DataFrame) -> DataFrame:
        """doc_id, held_out, score, predicted from (doc_id, difference)."""
        score = 1 / (1 + F.exp(-(F.col("difference") * self.slope + self.offset)))
        return raw.select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

    def accept(self, docs: DataFrame, raw: DataFrame, threshold: float = 0.5) -> DataFrame:
        """The rows of ``docs``, of which ``raw`` has the differences, that score below the threshold, with all their columns."""
        if not self.slope > 0:
            return docs if 1 / (1 + math.exp(-self.offset)) < threshold else docs.limit(0)
        most = (math.log(threshold / (1 - threshold)) - self.offset) / self.slope
        rejected = raw.where(F.col("difference") >= most).select(F.col("key").alias("_rejected")).distinct()
        return docs.join(rejected, _key(docs["text"]) == F.col("_rejected"), "left_anti")


def best_middle(x: np.ndarray, positive: np.ndarray, total: np.ndarray, missed: float = MISSED) -> float:
    """The cut between ascending places with the fewest wrong rows, positive ones below it weighed by ``missed``; the lowest of equals."""
    wrong = missed * np.append(0, np.cumsum(positive)) + np.append(np.cumsum((total - positive)[::-1])[::-1], 0)
    at = int(wrong.argmin())
    between = np.concatenate([x[:1] - 1, (x[:-1] + x[1:]) / 2, x[-1:] + 1])
    return float(between[at])


def count_sequences(docs: DataFrame, y: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, toxic, plain): the letter sequences of all labelled rows that are not held out, by the documents that have their words."""
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").isNotNull() & ~held_out()).join(y, "doc_id")
    counted = train.select("text", "y").mapInArrow(_count_words, "word string, toxic long, plain long")
    words = counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))
    grams = words.mapInArrow(_count_sequences(order), "gram string, toxic long, plain long")
    return materialize(grams.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain")), "sequences")


def fit_toxicity(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> tuple[ToxicityModel, DataFrame]:
    """Learn from the labelled rows that are not held out; the model, and every document's difference.

    The curve is fitted to counts of labelled rows in at most 4096 bins of the difference.
    """
    y = materialize(training_labels(labels, "toxic"), "labels")
    raw = materialize(text_differences(docs, ClassModels(count_sequences(docs, y, order), order), order), "differences")
    model = ToxicityModel(0.0, 0.0)
    low, high = raw.agg(F.min("difference"), F.max("difference")).first()
    span = (high - low) / 4096 if low is not None and high > low else 1.0
    bins = raw.join(y, "doc_id").groupBy(F.floor((F.col("difference") - (low or 0.0)) / span).alias("bin")).agg(F.avg("difference").alias("x"), F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    if len(bins):
        total, positive = bins["n"].to_numpy(float), bins["y"].to_numpy(float)
        if 0 < positive.sum() < total.sum():
            x = bins["x"].to_numpy(float)
            model.slope, model.offset = logistic(x, positive, total)
            if model.slope > 0:
                model.offset = -model.slope * best_middle(x, positive, total)
        else:
            model.offset = 700.0 if positive.sum() else -700.0
    else:
        model.offset = -700.0
    return model, raw


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model, raw = fit_toxicity(docs, labels)
    return model.curve(raw)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject."""
    model, raw = fit_toxicity(docs, labels)
    return model.accept(docs, raw)
