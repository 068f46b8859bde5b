"""Streaming queries, each run to its end over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.sources import tables
from skerry.sources.relations import METRIC_SQL
from skerry.sources.written import folder, written
from skerry.streaming import jobs

from .metrics import points
from .registry import query


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def stream_tumbling_counts(spark, sf_dir):
    feed = jobs.event_feed(spark, sf_dir)
    rows = jobs.run_fed(feed, jobs.tumbling(jobs.timed(feed.stream)), "update", "tumbling")
    return jobs.latest(rows.withColumn("start", F.col("window.start").cast("timestamp_ntz")).drop("window"), ["start", "event_type"])


@query("SELECT date_trunc('hour', ts) - to_hours(CAST(i AS INTEGER)) AS start, event_type, count(*) AS n FROM events, range(6) t(i) GROUP BY 1, 2")
def stream_hopping_counts(spark, sf_dir):
    feed = jobs.event_feed(spark, sf_dir)
    rows = jobs.run_fed(feed, jobs.hopping(jobs.timed(feed.stream)), "update", "hopping")
    return jobs.latest(rows.withColumn("start", F.col("window.start").cast("timestamp_ntz")).drop("window"), ["start", "event_type"])


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedup_watermark(spark, sf_dir):
    """Every row comes twice, and late ones again in the next batch; the watermark's memory drops the others."""
    feed = jobs.event_feed(spark, sf_dir, again="4 MINUTES")
    twice = jobs.timed(feed.stream).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")
    return jobs.run_fed(feed, jobs.deduplicated(twice), "append", "dedup").groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_type, count(*) AS seen, count(*) >= 31 AS ready, round(sum(value) FILTER (k <= 30), 3) AS tail_sum FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) x GROUP BY 1""")
def stream_carry_tail(spark, sf_dir):
    """The state of the last 30 values of each type after all batches, carried from batch to batch."""
    feed = jobs.event_feed(spark, sf_dir)
    stream = jobs.timed(feed.stream).select("event_type", "event_id", "ts", "value")
    rows = stream.groupBy("event_type").applyInPandasWithState(jobs.keep_tail, "event_type string, seen long, ready boolean, tail_sum double", jobs.TAIL_STATE, "update", "NoTimeout")
    return jobs.latest(jobs.run_fed(feed, rows, "update", "tail"), ["event_type"]).select("event_type", "seen", "ready", F.round("tail_sum", 3).alias("tail_sum"))


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1")
def stream_progress_upsert(spark, sf_dir):
    """Each user's last event, merged batch by batch into a table."""
    feed = jobs.event_feed(spark, sf_dir)
    stream = feed.stream.select("user_id", F.struct("ts", "event_id").alias("at"), "event_id", "event_type", "value")
    return jobs.upserted(feed, stream, ["user_id"], "at", "progress").drop("at")


@query("""SELECT 'kept' AS kind, event_type AS name, count(*) AS n FROM events WHERE value >= 100 GROUP BY 2 UNION ALL SELECT 'seen', event_type, count(*) FROM events GROUP BY 2""")
def stream_two_sinks(spark, sf_dir):
    """Facts and counts of each batch, written together: both have the same batches."""
    feed = jobs.event_feed(spark, sf_dir)
    both = tables.Together(folder(spark, "sinks"), {"facts": lambda b: b.where("value >= 100").select("event_type", "event_id"), "counts": lambda b: b.groupBy("event_type").agg(F.count("*").alias("n"))})
    jobs.drive(feed, feed.stream.writeStream.foreachBatch(both.write).option("checkpointLocation", folder(spark, "sinks-state")))
    facts = both.read(spark, "facts", "event_type string, event_id long").groupBy(F.lit("kept").alias("kind"), F.col("event_type").alias("name")).agg(F.count("*").alias("n"))
    return facts.unionByName(both.read(spark, "counts", "event_type string, n long").groupBy(F.lit("seen").alias("kind"), F.col("event_type").alias("name")).agg(F.sum("n").alias("n")))


@query(f"""WITH {METRIC_SQL}, b AS (SELECT epoch_us(min(time)) AS lo, epoch_us(max(time)) AS hi FROM mp), o AS (SELECT *, row_number() OVER s AS k, avg(real_value) OVER (s ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS m FROM mp WINDOW s AS (PARTITION BY target_id, name ORDER BY time))
SELECT target_id, name, time, CAST(least(k, 60) AS BIGINT) AS n, round(m, 6) AS mean, NULL AS error_code FROM o
UNION ALL SELECT target_id, name, time, NULL, NULL, 'E704' FROM mp, b, range(1, 3) t(i) WHERE epoch_us(time) < lo + (hi - lo) * i // 3 AND epoch_us(time) >= lo + (hi - lo) * i // 3 - 7200000000""")
def stream_rolling_buffer(spark, sf_dir):
    """The last 60 points of each series as keyed state over three batches; two hours come again with each, as error rows."""
    feed = jobs.Feed(written(points(spark, sf_dir), "points"), "time", again="2 HOURS")
    rows = jobs.rolled(feed)
    return rows.select("target_id", "name", F.col("time").cast("timestamp_ntz").alias("time"), "n", F.round("mean", 6).alias("mean"), "error_code")
