"""Orders, running sums and carried values of hot keys without a task that holds a whole key.

Rows are put in ranges of the whole order by splitters that Spark samples from all of them, so ranges are
about equal in rows for any ids and however the rows fall to the keys. A key's ranges are counted,
and the counts of the ranges before go before the places inside a range. What follows an
order (running sums, carried values, neighbours) goes by blocks of numbered rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skerry.sources.written import written


def joined(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join by keys of which null is one; the right side's other columns are added."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in by})
    same = reduce(lambda a, b: a & b, (left[c].eqNullSafe(right[f"_right_{c}"]) for c in by))
    return left.join(right, same, how).drop(*(f"_right_{c}" for c in by))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n", total: str | None = None, ties: bool = False) -> DataFrame:
    """Row numbers from 1 in each key's order, and with ``total`` the key's number of rows.

    Null keys are a key of their own; a null order value comes first. Rows that are alike in all key and
    order columns stay in one range unless ``ties`` says that there may be many: then they are told apart by
    a further column, for which they are written once more.
    """
    keys = [*by, *order]
    if ties:
        rows = written(rows.withColumn("_tie", F.monotonically_increasing_id()), "unordered")
        keys.append("_tie")
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = written(placed.withColumn("_place", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_place", 33))
    spans = placed.groupBy(*by, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_c"))
    each = Window.partitionBy(*by)  # a row for each range that holds the key
    before = F.coalesce(F.sum("_c").over(each.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select(*by, "_part", (before - F.col("_first") + 1).alias("_shift"), F.sum("_c").over(each).alias("_all"))
    found = joined(placed, spans, [*by, "_part"]).withColumn(name, F.col("_place") + F.col("_shift"))
    if total:
        found = found.withColumn(total, F.col("_all"))
    return found.drop("_place", "_part", "_shift", "_all")


def blocks(rows: DataFrame, ahead: int, name: str = "n", size: int = 8192, behind: int = 0) -> DataFrame:
    """Numbered rows in blocks of ``size`` by ``_block``, of which they are ``_own``; the ``behind`` rows before and the ``ahead`` after a block are in it too."""
    own, place = F.floor((F.col(name) - 1) / size), F.pmod(F.col(name) - 1, F.lit(size))
    near = [own, F.when((place < ahead) & (own > 0), own - 1), F.when(place >= size - behind, own + 1)]
    return rows.withColumn("_at", own).withColumn("_block", F.explode(F.array_compact(F.array(*near)))).withColumn("_own", F.col("_at") == F.col("_block")).drop("_at")


def _by_block(rows: DataFrame, by: list[str], inside: Column, whole: Column, over_blocks, name: str, put, n: str, size: int) -> DataFrame:
    rows = rows.withColumn("_block", F.floor((F.col(n) - 1) / size))
    keys = [*by, "_block"]
    sums = rows.groupBy(*keys).agg(whole.alias("_whole"))
    past = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, over_blocks(F.col("_whole")).over(past).alias("_before"))
    own = Window.partitionBy(*keys).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)
    found = joined(rows.withColumn("_inside", inside.over(own)), sums, keys)
    return found.withColumn(name, put(F.col("_before"), F.col("_inside"))).drop("_block", "_inside", "_before")


def running(rows: DataFrame, by: list[str], value: str, name: str, n: str = "n", size: int = 8192) -> DataFrame:
    """Sum of ``value`` up to each numbered row, itself included."""
    return _by_block(rows, by, F.sum(value), F.sum(value), F.sum, name, lambda a, b: F.coalesce(a + b, b, a), n, size)


def carried(rows: DataFrame, by: list[str], value: str, name: str, n: str = "n", size: int = 8192) -> DataFrame:
    """The last value that is not null up to each numbered row, itself included."""
    whole = F.max_by(value, F.when(F.col(value).isNotNull(), F.col(n)))
    return _by_block(rows, by, F.last(value, True), whole, lambda c: F.last(c, True), name, lambda a, b: F.coalesce(b, a), n, size)


def places(rows: DataFrame, by: list[str], name: str, n: str = "n", size: int = 8192) -> DataFrame:
    """Row numbers from 1 of numbered rows inside finer keys, of which most have few rows: only keys of more than ``size`` go by blocks.

    ``rows`` are read three times, so they should be written. At most one in ``size`` rows is a key that is broadcast.
    """
    hot = rows.groupBy(*by).agg(F.count("*").alias("_c")).where(F.col("_c") > size).select(*by, F.lit(True).alias("_hot"))
    rows = joined(rows, F.broadcast(hot), by, "left")
    few, many = rows.where("_hot IS NULL").drop("_hot"), rows.where("_hot").drop("_hot")
    few = few.withColumn(name, F.count("*").over(Window.partitionBy(*by).orderBy(n).rowsBetween(Window.unboundedPreceding, 0)))
    return few.unionByName(running(many.withColumn("_one", F.lit(1)), by, "_one", name, n, size).drop("_one"))
