"""Moving statistics, scaling and bands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import SERIES


def ewm(rows: DataFrame, value: str, span: int = 3, order: str = "seq", by: list[str] = SERIES) -> DataFrame:
    """Exponentially weighted mean with adjusted weights, over all earlier steps.

    Weights below 1e-18 of the newest one (60 steps back at a span of 3) cannot change a
    double, so the frame ends there and costs the same at every length of a series.
    """
    alpha = 2.0 / (span + 1)
    depth = max(1, math.ceil(18 / -math.log10(1 - alpha)))
    frame = Window.partitionBy(*by).orderBy(order).rowsBetween(-depth, 0)
    values = F.collect_list(value).over(frame)
    n = F.size(values)
    weights = F.transform(F.sequence(F.lit(1), n), lambda i: F.pow(F.lit(1 - alpha), (n - i).cast("double")))
    total = F.aggregate(F.zip_with(values, weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("ewm", total / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def scaler_fit(points: DataFrame) -> DataFrame:
    """Mean and population deviation of each series; a constant one has scale 1."""
    sd = F.stddev_pop("real_value")
    return points.groupBy(*SERIES).agg(F.avg("real_value").alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("std"))


def scale(points: DataFrame, scaler: DataFrame) -> DataFrame:
    """z-scores; series without a fitted scaler go away."""
    return points.join(scaler, SERIES).withColumn("scaled", (F.col("real_value") - F.col("mean")) / F.col("std"))


def unscale(x: Column, mean: Column, std: Column) -> Column:
    """A z-score back in its unit, not below 0, half-even rounded to two places."""
    return F.bround(F.greatest(x * std + mean, F.lit(0.0)), 2)


def min_max(points: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Values between 0 and 1 within each series."""
    own = Window.partitionBy(*SERIES)
    low, high = F.min("real_value").over(own), F.max("real_value").over(own)
    return points.withColumn("scaled", (F.col("real_value") - low) / (high - low + eps))


def trailing(points: DataFrame, width: int) -> DataFrame:
    """Mean and deviation of the ``width`` values before each point, and how many there are."""
    frame = Window.partitionBy(*SERIES).orderBy("time").rowsBetween(-width, -1)
    return points.withColumns({"n_before": F.count("real_value").over(frame), "mean_before": F.avg("real_value").over(frame), "std_before": F.stddev_pop("real_value").over(frame)})


def band(points: DataFrame, width: int = 24, sigma: float | Column = 3.0, least: float = 0.1) -> DataFrame:
    """Band of ``sigma`` deviations around the trailing mean, and points outside it.

    Points below ``least`` or without a full window before them are never outside.
    """
    rows = trailing(points, width).where(F.col("n_before") == width)
    mean, sd, x = F.col("mean_before"), F.col("std_before"), F.col("real_value")
    rows = rows.withColumns({"lower": F.greatest(mean - sigma * sd, F.lit(0.0)), "upper": mean + sigma * sd})
    outside = ((x > F.col("upper")) | (x < F.col("lower"))) & (x >= least)
    deviation = F.when(x > F.col("upper"), x - F.col("upper")).when(x < F.col("lower"), F.col("lower") - x).otherwise(0.0)
    return rows.withColumns({"anomaly": outside, "deviation": deviation, "z_score": F.try_divide(x - mean, sd)})
