"""Canonical relations: long metric points and log lines, and the readers behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRIC_POINT = T.StructType([T.StructField("time", T.TimestampNTZType()), T.StructField("inst_type", T.StringType()), T.StructField("target_id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("real_value", T.DoubleType())])

#: A request of the serving interface: a header and an untyped list of measurements.
ENVELOPE = "id1 string, standard_datetime string, header struct<sys_id string, target_id string, inst_type string, business_list array<string>, group_type string, group_id string>, body array<map<string,string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, query: str, driver: str, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A query of a relational store; ``partition`` (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("driver", driver).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, parts = partition
    return reader.option("dbtable", f"({query}) AS q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts).load()


def parse_envelopes(raw: DataFrame, column: str = "value") -> DataFrame:
    """Requests as JSON text into one long row for each measured value; text that does not parse gives an error row."""
    parsed = raw.select(F.from_json(column, ENVELOPE).alias("r"))
    rows = parsed.select("r.id1", F.try_to_timestamp("r.standard_datetime").cast("timestamp_ntz").alias("at"), "r.header.sys_id", "r.header.target_id", "r.header.inst_type", F.explode_outer("r.body").alias("m"))
    values = rows.select("id1", "at", "sys_id", "target_id", "inst_type", F.try_to_timestamp(F.col("m")["time"]).cast("timestamp_ntz").alias("time"), F.explode_outer(F.map_filter("m", lambda k, _: k != "time")).alias("name", "value"))
    return values.withColumn("real_value", F.expr("try_cast(value AS double)")).withColumn("error_code", F.when(F.col("time").isNull(), F.lit("E703"))).drop("value")


def kind_of(user: Column) -> Column:
    """Instance type of a user number."""
    return F.when(user % 3 == 0, "was").when(user % 3 == 1, "db").otherwise("os")


def metric_points(events: DataFrame, grain: str = "hour") -> DataFrame:
    """Long metric points: the mean of the values of a target's metric in each step of time.

    Sums go over whole hundredths, so the mean does not hang on the order of rows.
    """
    user = F.col("user_id")
    rows = events.select(F.date_trunc(grain, "ts").cast("timestamp_ntz").alias("time"), kind_of(user).alias("inst_type"), F.concat_ws("_", kind_of(user), (user % 3).cast("string")).alias("target_id"), F.col("event_type").alias("name"), F.round(F.col("value") * 100).cast("long").alias("cents"))
    return rows.groupBy("time", "inst_type", "target_id", "name").agg((F.sum("cents").cast("double") / (F.count("cents") * 100.0)).alias("real_value"))


METRIC_SQL = """mp AS (
  SELECT date_trunc('hour', ts) AS time, k AS inst_type, k || '_' || CAST(user_id % 3 AS VARCHAR) AS target_id, event_type AS name,
    CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / (count(value) * 100.0) AS real_value
  FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'was' WHEN 1 THEN 'db' ELSE 'os' END AS k FROM events) e GROUP BY 1, 2, 3, 4
)"""


def log_lines(documents: DataFrame, width: int | None = 300) -> DataFrame:
    """target_id, doc_id, pos, msg: the lines of texts, cut to ``width`` characters or whole (None), in order of (doc_id, pos)."""
    rows = documents.select(F.col("source").alias("target_id"), "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    msg = F.col("line") if width is None else F.substring("line", 1, width)
    return rows.select("target_id", "doc_id", F.col("pos").cast("long").alias("pos"), msg.alias("msg"))


LOG_SQL = """ll AS (
  SELECT source AS target_id, doc_id, pos, substring(line, 1, 300) AS msg
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS pos FROM documents WHERE text IS NOT NULL) x
)"""
WHOLE_SQL = LOG_SQL.replace("substring(line, 1, 300)", "line")
