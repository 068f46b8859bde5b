"""Thresholds from the tails of score distributions, and how detections compare with labels."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skerry.sources.written import written

from .ordering import blocks, joined, numbered, running


def value_at(scores: DataFrame, by: list[str], level: float, accuracy: int = 1000) -> DataFrame:
    """``threshold``, the value at place floor(level * n) from 0 of each key's sorted scores, and their number ``n``; null scores don't count.

    A sketch brackets the place: its rank error is at most n / accuracy, and the bracket's ends lie
    four times as far away. What is below is counted, and only the bracket's distinct values are
    sorted, each with the number of its rows.
    """
    low, high = max(0.0, level - 4 / accuracy), min(1.0, level + 4 / accuracy)
    known = scores.where("score IS NOT NULL")
    ends = known.groupBy(*by).agg(F.count("*").alias("n"), F.min("score").alias("_min"), F.max("score").alias("_max"), F.percentile_approx("score", [low, high], accuracy).alias("_ends"))
    ends = ends.select(*by, "n", (F.col("_min") if low == 0 else F.col("_ends")[0]).alias("_low"), (F.col("_max") if high == 1 else F.col("_ends")[1]).alias("_high"))
    side = F.when(F.col("score") < F.col("_low"), -1).when(F.col("score") > F.col("_high"), 1).otherwise(0)
    near = joined(known.select(*by, "score"), ends, by).select(*by, "n", side.alias("_side"), F.when(side == 0, F.col("score")).alias("_value"))
    counts = near.where("_side <= 0").groupBy(*by, "n", "_side", "_value").agg(F.count("*").alias("_c"))
    up_to = F.sum("_c").over(Window.partitionBy(*by).orderBy("_side", "_value"))  # the bracket, and one row for all below it
    there = counts.withColumn("_k", up_to).where((F.col("_side") == 0) & (F.col("_k") > F.floor(F.col("n") * level)))
    return there.groupBy(*by, "n").agg(F.min("_value").alias("threshold"))


def initial_threshold(scores: DataFrame, by: list[str], level: float = 0.99) -> DataFrame:
    """The value at place floor(level * n) of each key's sorted scores, and the number of larger ones."""
    above = F.when(F.col("score") > F.col("threshold"), F.col("score") - F.col("threshold"))
    rows = joined(scores.select(*by, "score"), value_at(scores, by, level), by)
    return rows.groupBy(*by, "threshold", "n").agg(F.count(above).alias("peaks"), F.coalesce(F.avg(above), F.lit(0.0)).alias("mean_excess"))


def gpd_quantile(threshold, gamma, sigma, n, peaks, q):
    """Level that a share ``q`` of values exceeds, of a generalised Pareto tail with these columns."""
    ratio = q * n / peaks
    return F.when(F.abs(gamma) < 1e-8, threshold - sigma * F.log(ratio)).otherwise(threshold + sigma / gamma * (F.pow(ratio, -gamma) - 1))


def fit_tail(excess: np.ndarray, grid: int = 200) -> tuple[float, float, float]:
    """(gamma, sigma, log-likelihood) of excesses: the exponential tail, or a better root of Grimshaw's equation.

    The equation u(x) v(x) = 1 with u = mean(1 / (1 + x y)), v = 1 + mean(log(1 + x y)) is
    searched for sign changes on a grid and settled by bisection.
    """
    mean, low, high = float(excess.mean()), float(excess.min()), float(excess.max())
    best = (0.0, mean, -len(excess) * (1 + math.log(mean)))

    def gap(x: float) -> float:
        s = 1 + x * excess
        return float((1 / s).mean() * (1 + np.log(s).mean()) - 1)

    edge = 1 / high
    spans = [np.linspace(-edge * (1 - 1e-8), -1e-8 * edge, grid)]
    if low > 0 and mean > low:
        top = 2 * (mean - low) / (low * low)
        spans.append(np.geomspace(min(1e-6 / mean, top / 2), min(top, 1e6 / mean), 2 * grid))
    for span in spans:
        values = [gap(x) for x in span]
        for a, b, fa, fb in zip(span, span[1:], values, values[1:]):
            if not fa * fb < 0:
                continue
            for _ in range(80):
                m = (a + b) / 2
                fm = gap(m)
                a, fa, b = (m, fm, b) if fa * fm > 0 else (a, fa, m)
            x = (a + b) / 2
            gamma = float(np.log(1 + x * excess).mean())
            if abs(gamma) < 1e-12:
                continue
            sigma = gamma / x
            likelihood = -len(excess) * math.log(sigma) - (1 + 1 / gamma) * float(np.log(1 + x * excess).sum()) if sigma > 0 else -math.inf
            if likelihood > best[2]:
                best = (gamma, sigma, likelihood)
    return best


def _grid_sums(grids):
    """Partial sums of 1 / (1 + x y) and log(1 + x y) over the excesses y, for each x of each key's spans.

    ``grids`` makes the places of a span from its number and its two ends; a task gives one row for each key and span.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def rows() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[i] for k in keys], kind) for i, kind in ((0, pa.int64()), (1, pa.int32()))]
            sums = [pa.array([held[k][i].tolist() for k in keys], pa.list_(pa.float64())) for i in range(3)]
            return pa.RecordBatch.from_arrays([*columns, *sums], ["id", "span", "x", "inv", "log"])

        for batch in batches:
            ids, y = np.asarray(batch.column("id")), np.asarray(batch.column("y"))
            for key, first in zip(*np.unique(ids, return_index=True), strict=True):
                own = y[ids == key]
                for number, (low, high) in enumerate(zip(*(batch.column(c)[int(first)].as_py() for c in ("lows", "highs")), strict=True)):
                    x = grids(number, low, high)
                    at = held.setdefault((int(key), number), [x, np.zeros_like(x), np.zeros_like(x)])
                    for i in range(0, len(own), 2048):
                        s = 1 + x[:, None] * own[None, i : i + 2048]
                        at[1] += (1 / s).sum(axis=1)
                        at[2] += np.log(s).sum(axis=1)
            if len(held) > 4096:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return run


def _evaluated(peaks: DataFrame, spans: DataFrame, grids) -> DataFrame:
    """(id, n, span, at, x, inv, log): the sums of all tasks added up, place by place."""
    given = peaks.select("id", "y").join(spans.select("id", "lows", "highs"), "id")
    parts = given.mapInArrow(_grid_sums(grids), "id long, span int, x array<double>, inv array<double>, log array<double>")
    each = parts.select("id", "span", F.posexplode(F.arrays_zip("x", "inv", "log")).alias("at", "v"))
    sums = each.groupBy("id", "span", "at").agg(F.max("v.x").alias("x"), F.sum("v.inv").alias("inv"), F.sum("v.log").alias("log"))
    return sums.join(spans.select("id", "n"), "id")


def fit_tails(peaks: DataFrame, rounds: int = 2, grid: int = 200, finer: int = 512) -> DataFrame:
    """(id, n, gamma, sigma) of each key's excesses (id, y): the exponential tail, or a better root of Grimshaw's equation.

    As in ``fit_tail``, but no task holds a key's excesses: the equation's two means are summed
    in each task for a whole grid of places and added up. Where the sign changes, the next
    round's grid lies; the last interval is cut where a straight line would.
    """
    excess = peaks.groupBy("id").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"))
    edge, mean, low = 1 / F.col("high"), F.col("mean"), F.col("low")
    top = 2 * (mean - low) / (low * low)
    right = (low > 0) & (mean > low)
    lows = F.array_compact(F.array(-edge * (1 - 1e-8), F.when(right, F.least(1e-6 / mean, top / 2))))
    highs = F.array_compact(F.array(-1e-8 * edge, F.when(right, F.least(top, 1e6 / mean))))
    excess = written(excess.withColumns({"lows": lows, "highs": highs}), "excess")

    def coarse(number: int, a: float, b: float) -> np.ndarray:
        return np.geomspace(a, b, 2 * grid) if number else np.linspace(a, b, grid)

    def fine(number: int, a: float, b: float) -> np.ndarray:
        return np.linspace(a, b, finer + 1)

    spans, own = excess.select("id", "n", "lows", "highs"), Window.partitionBy("id", "span").orderBy("at")
    gap = F.col("inv") / F.col("n") * (1 + F.col("log") / F.col("n")) - 1
    for i in range(rounds + 1):
        at = _evaluated(peaks, spans, fine if i else coarse).withColumn("gap", gap)
        cut = at.select("id", "n", "x", "gap", F.lead("x").over(own).alias("next"), F.lead("gap").over(own).alias("next_gap")).where("gap * next_gap < 0")
        if i == rounds:
            root = F.col("x") - F.col("gap") * (F.col("next") - F.col("x")) / (F.col("next_gap") - F.col("gap"))
            cut = cut.select("id", "n", root.alias("x"), root.alias("next"))
        found = F.sort_array(F.collect_list(F.struct("x", "next")))  # as many as the equation has roots
        spans = cut.groupBy("id", "n").agg(found.alias("s")).select("id", "n", F.col("s.x").alias("lows"), F.col("s.next").alias("highs"))
        spans = written(spans, "spans")
    at = _evaluated(peaks, spans, lambda number, a, b: np.array([a])).withColumn("gamma", F.col("log") / F.col("n"))
    at = at.withColumn("sigma", F.col("gamma") / F.col("x")).where("abs(gamma) >= 1e-12 AND sigma > 0")
    rooted = at.select("id", "gamma", "sigma", (-F.col("n") * F.log("sigma") - (1 + 1 / F.col("gamma")) * F.col("log")).alias("likelihood"), (-1 - F.col("span")).alias("turn"))
    plain = excess.select("id", F.lit(0.0).alias("gamma"), F.col("mean").alias("sigma"), (-F.col("n") * (1 + F.log("mean"))).alias("likelihood"), F.lit(0).alias("turn"))
    best = rooted.unionByName(plain).groupBy("id").agg(F.max_by(F.struct("gamma", "sigma"), F.struct("likelihood", "turn")).alias("b"))
    return best.join(excess.select("id", "n"), "id").select("id", "n", "b.gamma", "b.sigma")


def pot(scores: DataFrame, by: str, level: float = 0.99, q: float = 0.005) -> DataFrame:
    """Peaks-over-threshold level of each key: excesses over the initial threshold, a fitted tail, its quantile.

    Only excesses (a share 1 - level of the rows) are read by the fit, and never one key's in one task.
    """
    start = initial_threshold(scores, [by], level).where("peaks > 0").select(by, "threshold", F.col("n").alias("all"), "peaks")
    start = written(start.withColumn("id", F.monotonically_increasing_id()), "thresholds")
    peaks = joined(scores.select(by, "score"), start, [by]).where("score > threshold").select("id", (F.col("score") - F.col("threshold")).alias("y"))
    rows = start.join(fit_tails(written(peaks, "peaks")).drop("n"), "id")
    z = gpd_quantile(F.col("threshold"), F.col("gamma"), F.col("sigma"), F.col("all"), F.col("peaks"), q)
    return rows.select(by, "threshold", F.col("all").alias("n"), "peaks", "gamma", "sigma", z.alias("z"))


def both_tails(scores: DataFrame, by: str, level: float = 0.98, q: float = 0.005) -> DataFrame:
    """Upper and lower level of each key: the lower one from the mirrored scores."""
    up = pot(scores, by, level, q).select(by, F.col("z").alias("upper"))
    low = pot(scores.withColumn("score", -F.col("score")), by, level, q).select(by, (-F.col("z")).alias("lower"))
    return up.join(low, by, "full")


def drifting(scores: DataFrame, by: str, depth: int = 10, order: str = "time") -> DataFrame:
    """Scores less the mean of the ``depth`` before them, where that many are there."""
    frame = Window.partitionBy(by).orderBy(order).rowsBetween(-depth, -1)
    rows = scores.withColumns({"_n": F.count("score").over(frame), "_m": F.avg("score").over(frame)})
    return rows.where(F.col("_n") == depth).withColumn("score", F.col("score") - F.col("_m")).drop("_n", "_m")


def streaming_pot(rows: pd.DataFrame, start: int = 100, level: float = 0.98, q: float = 0.005, every: int = 10) -> pd.DataFrame:
    """One key's scores in order: an alarm above the level, a new peak between both levels refits the tail.

    For ``applyInPandas`` by key: what follows depends on every earlier row of the key.
    """
    x = rows.sort_values("time")["score"].to_numpy(float)
    out = pd.DataFrame({"time": rows.sort_values("time")["time"], "score": x, "level": np.nan, "alarm": False})
    if len(x) <= start:
        return out
    t = float(np.sort(x[:start])[int(level * start)])
    peaks = [v - t for v in x[:start] if v > t]
    n, z, new = start, math.inf, every
    levels, alarms = [math.nan] * start, [False] * start
    for v in x[start:]:
        if new >= every and peaks:
            gamma, sigma, _ = fit_tail(np.array(peaks))
            ratio = q * n / len(peaks)
            z = t - sigma * math.log(ratio) if abs(gamma) < 1e-8 else t + sigma / gamma * (ratio**-gamma - 1)
            new = 0
        alarms.append(v > z)
        levels.append(z)
        if v <= z:
            n += 1
            if v > t:
                peaks.append(v - t)
                new += 1
    return out.assign(level=levels, alarm=alarms)


def dilate(rows: DataFrame, flag: str, by: list[str], order: str, reach: int = 49) -> DataFrame:
    """``flag`` spread to ``reach`` rows on either side within each key."""
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach)
    return rows.withColumn(f"{flag}_near", F.max(flag).over(frame))


def segments(rows: DataFrame, flag: str, by: list[str], order: str) -> DataFrame:
    """Consecutive rows with the flag: key, first, last and length of each run."""
    runs = _runs(rows.select(*by, order, flag), flag, by, order).where(F.col(flag))
    return runs.groupBy(*by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("_run")


def _runs(rows: DataFrame, flag: str, by: list[str], order: str) -> DataFrame:
    """``_run``: the number of changes of ``flag`` up to each row in its key's order."""
    near = blocks(numbered(rows, by, [order], "_n"), 0, "_n", behind=1)
    last = F.lag(flag).over(Window.partitionBy(*by, "_block").orderBy("_n"))
    changes = near.withColumn("_change", F.coalesce((F.col(flag) != last).cast("int"), F.lit(0))).where("_own").drop("_own", "_block")
    return running(changes, by, "_change", "_run", "_n").drop("_change", "_n")


def point_adjust(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """``predict`` true over every run of true labels in which it is true once."""
    runs = _runs(rows, "label", by, order)
    hit = runs.where("label").groupBy(*by, "_run").agg(F.max("predict").alias("_hit"))
    found = joined(runs, hit, [*by, "_run"], "left")
    return found.withColumn("adjusted", F.when(F.col("label"), F.col("_hit")).otherwise(F.col("predict"))).drop("_run", "_hit")


def best_cut(rows: DataFrame, by: list[str], order: str, score: str, eps: float = 1e-5) -> DataFrame:
    """(key, cut, tp, fp, fn, precision, recall, f1): the cut of all distinct scores with the best point-adjusted F1, the smallest of equals.

    A row is predicted from a score at the cut on. A run of labels counts whole from its largest
    score on, so each run is one event, and one sweep over the distinct scores from above adds up what every cut finds.
    """
    runs = _runs(rows.select(*by, order, "label", F.col(score).alias("_score")), "label", by, order)
    hits = runs.where("label").groupBy(*by, "_run").agg(F.max("_score").alias("_score"), F.count("*").alias("_tp")).select(*by, "_score", "_tp", F.lit(0).cast("long").alias("_fp"))
    each = runs.select(*by, "_score", F.lit(0).cast("long").alias("_tp"), (~F.col("label")).cast("long").alias("_fp"))
    events = hits.unionByName(each).groupBy(*by, "_score").agg(F.sum("_tp").alias("_tp"), F.sum("_fp").alias("_fp"))
    swept = numbered(events.withColumn("_down", -F.col("_score")), by, ["_down"], "_n")
    for c in ("tp", "fp"):
        swept = running(swept, by, f"_{c}", c, "_n")
    labels = runs.groupBy(*by).agg(F.count_if("label").alias("_labels"))
    c = joined(swept, labels, by).withColumn("fn", F.col("_labels") - F.col("tp"))
    c = c.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp") + eps), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + eps)})
    c = c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))
    best = c.groupBy(*by).agg(F.max_by(F.struct(F.col("_score").alias("cut"), "tp", "fp", "fn", "precision", "recall", "f1"), F.struct(F.round("f1", 9), "_down")).alias("b"))
    return best.select(*by, "b.*")


def confusion(rows: DataFrame, by: list[str], predict: str = "predict", eps: float = 1e-5) -> DataFrame:
    """True and false positives and negatives with precision, recall and F1."""
    p, y = F.col(predict), F.col("label")
    c = rows.groupBy(*by).agg(F.count_if(p & y).alias("tp"), F.count_if(~p & ~y).alias("tn"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    c = c.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp") + eps), "recall": F.col("tp") / (F.col("tp") + F.col("fn") + eps)})
    return c.withColumn("f1", 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + eps))
