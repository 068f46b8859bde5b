"""Values by key: a table of JSON values in place of a key-value server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_of(keys: list[str]) -> Column:
    """One text for the keys, nulls included: other keys never give the same."""
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def put(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write all columns but ``keys`` as one JSON value under the keys; null is a key like others."""
    value = F.to_json(F.struct(*(c for c in rows.columns if c not in keys)))
    rows.select(key_of(keys).alias("key"), value.alias("value")).write.mode("overwrite").parquet(path)


def get(asked: DataFrame, path: str, keys: list[str], schema: str) -> DataFrame:
    """``asked`` with the fields of ``schema`` from its keys' values, null where there is none; of repeated keys the largest value counts.

    Keys must have the names and types under which they were put.
    """
    held = asked.sparkSession.read.parquet(path).groupBy("key").agg(F.max("value").alias("_value"))
    rows = asked.withColumn("_key", key_of(keys)).join(held.withColumnRenamed("key", "_key"), "_key", "left")
    return rows.select(*asked.columns, F.from_json("_value", schema).alias("_value")).select(*asked.columns, "_value.*")
