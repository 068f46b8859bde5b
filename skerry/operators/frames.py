"""Time grids: spine, gaps, interpolation, windows and reshaping of long metric points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["target_id", "name"]


def spine(points: DataFrame, steps: int = 60, unit: str = "HOUR") -> DataFrame:
    """``steps`` times ending at each series' last one, whether measured or not."""
    last = points.groupBy(*SERIES).agg(F.max("time").alias("last"))
    times = F.expr(f"sequence(last - INTERVAL '{steps - 1}' {unit}, last, INTERVAL '1' {unit})")
    return last.select(*SERIES, F.posexplode(times).alias("seq", "time"))


def on_spine(points: DataFrame, steps: int = 60, unit: str = "HOUR") -> DataFrame:
    """Left join onto the spine; duplicate times must be averaged before."""
    return spine(points, steps, unit).join(points.select(*SERIES, "time", "real_value"), [*SERIES, "time"], "left")


def gap_status(framed: DataFrame, recent: int = 3, most: int = 5) -> DataFrame:
    """Status of each series: E704 if the last ``recent`` steps are all missing or more than ``most`` are."""
    missing = F.col("real_value").isNull()
    top = Window.partitionBy(*SERIES)
    rows = framed.withColumn("last_seq", F.max("seq").over(top))
    counts = rows.groupBy(*SERIES).agg(F.count_if(missing).alias("missing"), F.count_if(missing & (F.col("seq") > F.col("last_seq") - recent)).alias("missing_recent"), F.count("*").alias("steps"))
    bad = (F.col("missing_recent") >= recent) | (F.col("missing") > most)
    return counts.withColumn("error_code", F.when(bad, "E704").otherwise("OK"))


def interpolate(framed: DataFrame, both: bool = True) -> DataFrame:
    """Linear interpolation between known steps; outside them the nearest known value.

    With ``both`` False, leading gaps take the next value and series without any take 0.
    """
    order = Window.partitionBy(*SERIES).orderBy("seq")
    back, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("real_value").isNotNull(), F.col("seq"))
    rows = framed.withColumns({"x0": F.last(known, True).over(back), "y0": F.last("real_value", True).over(back), "x1": F.first(known, True).over(ahead), "y1": F.first("real_value", True).over(ahead)})
    inside = F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("seq") - F.col("x0")) / (F.col("x1") - F.col("x0"))
    value = F.when(F.col("real_value").isNotNull(), F.col("real_value")).when(F.col("y0").isNotNull() & F.col("y1").isNotNull(), inside).otherwise(F.coalesce("y0", "y1"))
    if not both:
        value = F.coalesce(value, F.lit(0.0))
    return rows.withColumn("filled", value).drop("x0", "y0", "x1", "y1")


def drop_all_null(framed: DataFrame) -> DataFrame:
    """Series that have at least one value."""
    return framed.join(framed.groupBy(*SERIES).agg(F.count("real_value").alias("n")).where("n > 0").select(*SERIES), SERIES, "left_semi")


def drop_targets_any_null(framed: DataFrame) -> DataFrame:
    """Targets all of whose series have a value."""
    empty = framed.groupBy(*SERIES).agg(F.count("real_value").alias("n")).where("n = 0").select("target_id").distinct()
    return framed.join(empty, "target_id", "left_anti")


def long_enough(points: DataFrame, least: int = 60) -> DataFrame:
    """Points of targets with at least ``least`` rows (repeated rows count)."""
    return points.join(points.groupBy("target_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("target_id"), "target_id", "left_semi")


def pivot(points: DataFrame, names: list[str]) -> DataFrame:
    """One row for each target and time, a column for each of the named metrics."""
    return points.where(F.col("name").isin(*names)).groupBy("target_id", "time").pivot("name", names).agg(F.avg("real_value"))


def unpivot(wide: DataFrame, names: list[str]) -> DataFrame:
    """Back to long rows, nulls kept."""
    return wide.unpivot(["target_id", "time"], names, "name", "real_value")


def tail(points: DataFrame, n: int = 30) -> DataFrame:
    """The last ``n`` points of each series, numbered from the latest."""
    latest = Window.partitionBy(*SERIES).orderBy(F.col("time").desc())
    return points.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= n)


def sliding(points: DataFrame, width: int = 30, column: str = "real_value") -> DataFrame:
    """Full windows of ``width`` values with the value after them."""
    order = Window.partitionBy(*SERIES).orderBy("time")
    rows = points.withColumns({"window": F.collect_list(column).over(order.rowsBetween(1 - width, 0)), "next_value": F.lead(column).over(order)})
    return rows.where(F.size("window") == width)


def late_filter(saved: DataFrame, arrived: DataFrame, at, behind: int = 65, ahead: int = 5, serve: int = 60, unit: str = "HOUR") -> DataFrame:
    """Union of saved and arrived points without repeated rows, kept in (at - behind, at + ahead].

    ``served`` marks those in (at - serve, at].
    """
    step = lambda n: F.expr(f"INTERVAL '{n}' {unit}")
    rows = saved.unionByName(arrived, allowMissingColumns=True).dropDuplicates()
    kept = rows.where((F.col("time") > at - step(behind)) & (F.col("time") <= at + step(ahead)))
    return kept.withColumn("served", (F.col("time") > at - step(serve)) & (F.col("time") <= at))
