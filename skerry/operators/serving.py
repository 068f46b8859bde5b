"""What stands around a model when it serves: choice of features, attention, headers and samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Metrics that no model takes, and parts of names that mark bounds of a forecast.
REMOVED = ["socket_count"]
BOUNDS = ["upper", "lower"]

# Bucket of each weekday, Monday first, by training mode.
WEEKDAY_BUCKETS = {
    "daily": [0, 0, 0, 0, 0, 0, 0],
    "workingday": [0, 0, 0, 0, 0, 5, 5],
    "weekday": [0, 1, 2, 3, 4, 5, 6],
    "bizday": [0, 1, 2, 3, 4, 5, 6],
}


def nan_to_null(c: Column) -> Column:
    """Null for what is no number; null stays null."""
    return F.when(~F.isnan(c), c)


def floor_to(c: Column, places: int) -> Column:
    """Digits after ``places`` are dropped towards minus infinity."""
    return F.floor(c * 10**places) / float(10**places)


def weekday_bucket(time: Column, mode: str) -> Column:
    """The bucket of training data to which a time's weekday belongs."""
    return F.element_at(F.array(*(F.lit(b) for b in WEEKDAY_BUCKETS[mode])), F.weekday(time) + 1)


def features(rows: DataFrame, name: str = "name") -> DataFrame:
    """Rows of metrics that a model may take: neither removed ones nor bounds of forecasts; null names go."""
    bound = F.lit(False)
    for part in BOUNDS:
        bound = bound | F.contains(F.col(name), F.lit(part))
    return rows.where(~F.col(name).isin(*REMOVED) & ~bound)


def with_own(neighbours: Column, own: Column, place: Column) -> Column:
    """A row of the attention matrix: the attention to the others, with the own one at its place (from 0) on the diagonal."""
    return F.concat(F.slice(neighbours, F.lit(1), place), F.array(own), F.slice(neighbours, place + 1, F.size(neighbours) - place))


def attention_map(names: Column, row: Column, anomaly: Column) -> Column:
    """Attention by metric to four places; null unless there is an anomaly."""
    return F.when(anomaly, F.map_from_arrays(names, F.transform(row, lambda x: F.round(x, 4))))


def header(rows: DataFrame, at: Column, threshold: float, most: int, by: str = "target_id") -> DataFrame:
    """One header for each key: lines from the serving minute on, those with a higher score than ``threshold``, and whether they are more than ``most``.

    Lines before ``at`` or without a time are not counted; a key without an anomaly has a null header.
    """
    late = F.col("time") >= at
    counts = rows.groupBy(by).agg(F.count_if(late).alias("total_count"), F.count_if(late & (F.col("line_score") > threshold)).alias("anomaly_count"))
    body = F.struct("total_count", "anomaly_count", (F.col("anomaly_count") > most).alias("anomaly"), F.lit(most).alias("anomaly_threshold"))
    return counts.select(by, F.when(F.col("anomaly_count") > 0, body).alias("header"))


def unmined(rows: DataFrame, day: str, first: Column, last: Column) -> DataFrame:
    """Rows of days outside the period that templates were mined of; rows without a day go."""
    return rows.where((F.col(day) < first) | (F.col(day) > last))


def uniform(seed: int, *keys: str | Column, part: int = 0) -> Column:
    """A number between 0 and 1 that seed and keys fix, so a task that runs again gets the same; ``part`` (0 to 3) tells several apart."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys).cast("binary")), 8 * part + 1, 8)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / 2.0**32


def normal(seed: int, *keys: str | Column) -> Column:
    """A draw of the standard normal distribution that seed and keys fix (from two uniform ones)."""
    return F.sqrt(-2 * F.log(uniform(seed, *keys))) * F.cos(2 * math.pi * uniform(seed, *keys, part=1))


def draw(rows: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement (all, if fewer), by a hash of their keys, so a task that runs again draws the same ones.

    Each task keeps its own ``n`` first rows before they are merged. Rows with equal keys are drawn in any order.
    """
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), *keys).cast("binary")), *keys).limit(n)
