"""Scores: as-of lookups, contributions, grades and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import carried, numbered


def _asof(rows: DataFrame, lookup: DataFrame, by: list[str], at: Column, found_at: Column, found_first: bool, result: str) -> DataFrame:
    """Both sides in one numbered order within each key; the last lookup seen is carried on over its blocks."""
    left = rows.withColumns({"_at": at, "_side": F.lit(int(found_first)), "_result": F.lit(None).cast("double")})
    names = [c for c in left.columns if c not in by]
    right = lookup.select(*by, found_at.alias("_at"), F.lit(int(not found_first)).alias("_side"), F.col(result).cast("double").alias("_result")).where("_at IS NOT NULL")
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_left", F.col("_side") == int(found_first))
    both = numbered(both, by, ["_at", "_side", "_result"], "_n", ties=True)
    found = carried(both, by, "_result", result, "_n").where("_left")
    return found.select(*by, *(n for n in names if n[0] != "_"), result)


def asof_backward(rows: DataFrame, lookup: DataFrame, by: list[str], value: str, at: str, result: str) -> DataFrame:
    """The lookup row with the largest ``at`` not above ``value``; null where there is none.

    The cost is a sort of both sides in ranges, whatever the size of either and however the rows fall
    to the keys. Ties count as not above; of equal lookups the one with the largest result counts.
    """
    return _asof(rows, lookup, by, F.col(value), F.col(at), True, result)


def asof_forward(rows: DataFrame, lookup: DataFrame, by: list[str], value: str, at: str, result: str) -> DataFrame:
    """The lookup row with the smallest ``at`` above the number ``value``; null where there is none."""
    return _asof(rows, lookup, by, -F.col(value), -F.col(at), False, result)


def score_table(losses: DataFrame, by: list[str]) -> DataFrame:
    """loss and score (100 for the least loss down to 0 for the largest) of each key's distinct losses."""
    rows = numbered(losses.select(*by, "loss").distinct(), by, ["loss"], "_n", "_total")
    rank = F.coalesce(F.try_divide(F.col("_n") - 1, F.col("_total") - 1), F.lit(0.0))
    return rows.select(*by, "loss", (100 - 100 * rank).alias("score"))


def grade(score: Column) -> Column:
    """2 up to 30, 1 up to 50, else 0."""
    return F.when(score <= 30, 2).when(score <= 50, 1).otherwise(0)


def floored(score: Column) -> Column:
    """Scores above 5 half-even rounded to one place, others 5."""
    return F.when(score > 5, F.bround(score, 1)).otherwise(5.0)


def forward_score(cdf: Column, is_anomaly: Column) -> Column:
    """Half the cdf in percent below 50 for anomalies, below 100 for others, half-even rounded to one place; 5 at least, and where no larger loss is known."""
    base = F.when(is_anomaly, 50.0).otherwise(100.0)
    return F.when(cdf.isNull(), 5.0).otherwise(F.greatest(F.bround(base - cdf / 2 * 100, 1), F.lit(5.0)))


def share(value: str, by: list[str]) -> Column:
    """Percent of the key's total; null where the total is 0."""
    return F.try_divide(100 * F.col(value), F.sum(value).over(Window.partitionBy(*by)))


def top_share(rows: DataFrame, by: list[str], value: str, tie: str, k: int = 5) -> DataFrame:
    """The ``k`` largest values of each key with their percent of these values' sum."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), tie)
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.withColumn("contribution", F.try_divide(100 * F.col(value), F.sum(value).over(Window.partitionBy(*by))))
