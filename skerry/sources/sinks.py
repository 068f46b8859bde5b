"""Results to where they go: fact and summary tables, alarm messages, relational upserts, batches of a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def detection_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """Detections (target_id, detection_type, ...) into facts and summaries of rare lines and of keywords.

    Type 1 is both, 2 rare, 3 a keyword.
    """
    sparse, keyword = rows.where("detection_type IN (1, 2)"), rows.where("detection_type IN (1, 3)")
    count = lambda d: d.groupBy("target_id").agg(F.count("*").alias("n"))
    return {"sparse": sparse, "keyword": keyword, "sparse_summary": count(sparse), "keyword_summary": count(keyword)}


def append_anomalies(rows: DataFrame, path: str) -> None:
    """Append the rows of targets with at least one anomaly."""
    rows.where("anomaly_count >= 1").write.mode("append").parquet(path)


def write_jdbc(rows: DataFrame, url: str, table: str, driver: str, **options: str) -> None:
    """Append to a relational table from every partition."""
    rows.write.format("jdbc").option("url", url).option("dbtable", table).option("driver", driver).options(**options).mode("append").save()


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after changes: the row with the latest ``order`` of each key (changes win ties)."""
    both = current.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    others = [c for c in current.columns if c not in keys]
    latest = both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(order, "_new")).alias("_r"))
    return latest.select(*keys, "_r.*").select(*current.columns)


def alarm_messages(sparse: DataFrame, keyword: DataFrame, graph: DataFrame) -> DataFrame:
    """(key, value) for a message queue: one JSON message for each target that has anything to say.

    Each input has target_id and a struct ``item``; lists are sorted, so equal inputs give equal messages.
    """
    part = lambda d, n: d.groupBy("target_id").agg(F.sort_array(F.collect_list("item")).alias(n))
    rows = part(sparse, "sparseLog").join(part(keyword, "keywordLog"), "target_id", "full").join(part(graph, "digcnLog"), "target_id", "full")
    return rows.select(F.col("target_id").alias("key"), F.to_json(F.struct(F.lit("log").alias("inst_type"), "target_id", F.struct("digcnLog", "keywordLog", "sparseLog").alias("data"))).alias("value"))


def each_batch(*writers: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: give one batch, computed once, to several writers."""

    def run(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            for write in writers:
                write(held)
        finally:
            held.unpersist()

    return run
