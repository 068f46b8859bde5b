"""Structured Streaming forms of the minute-by-minute operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skerry.sources import tables
from skerry.sources.written import folder

TAIL_STATE = "seen long, tail array<double>"


class Feed:
    """A table as a stream that comes in several batches in order of time.

    Each ``add`` appends the next of ``batches`` equal spans of time to the folder that the stream reads; with
    ``again`` (an interval) every one but the first also brings the rows of so long before its span once more.
    """

    def __init__(self, rows: DataFrame, time: str, batches: int = 3, again: str | None = None) -> None:
        self.rows, self.time, self.again = rows, time, again
        self.low, self.high = rows.agg(F.min(time), F.max(time)).first()
        self.left = list(range(batches if self.low is not None else 0))
        self.batches, self.out = batches, folder(rows.sparkSession, "feed")
        rows.limit(0).write.parquet(self.out)
        self.stream = rows.sparkSession.readStream.schema(rows.schema).parquet(self.out)

    def start(self, i: int):
        """The first time of a span."""
        return self.low + (self.high - self.low) * i / self.batches

    def add(self) -> bool:
        """False where nothing is left."""
        if not self.left:
            return False
        i, t = self.left.pop(0), F.col(self.time)
        since = F.lit(self.start(i)) if not i or self.again is None else F.lit(self.start(i)) - F.expr(f"INTERVAL {self.again}")
        until = t < F.lit(self.start(i + 1)) if i < self.batches - 1 else F.lit(True)
        self.rows.where((t >= since) & until).write.mode("append").parquet(self.out)
        return True


def event_feed(spark: SparkSession, sf_dir: str, batches: int = 3, again: str | None = None) -> Feed:
    """events as a stream."""
    return Feed(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", batches, again)


def timed(stream: DataFrame) -> DataFrame:
    """``ts`` as a timestamp that can carry a watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "5 minutes") -> DataFrame:
    """Counts and sums in windows that follow one another."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))


def hopping(stream: DataFrame, width: str = "6 hours", step: str = "1 hour", late: str = "5 minutes") -> DataFrame:
    """Counts in overlapping windows."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"))


def deduplicated(stream: DataFrame, late: str = "5 minutes") -> DataFrame:
    """Rows whose id has not come within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def keep_tail(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The last 30 values of each key carried from batch to batch; fewer than 31 rows are only saved."""
    seen, tail = state.get if state.exists else (0, [])
    rows = pd.concat(frames).sort_values(["ts", "event_id"])
    seen += len(rows)
    values = [*tail, *rows["value"].tolist()]
    state.update((seen, [float(v) for v in values[-30:]]))
    yield pd.DataFrame({"event_type": [key[0]], "seen": [seen], "ready": [len(values) >= 31], "tail_sum": [round(sum(values[-30:]), 4)]})


def drive(feed: Feed, writer) -> None:
    """Start the query for every batch of the feed anew, from its checkpoint, as after a stop."""
    while feed.add():
        writer.trigger(availableNow=True).start().awaitTermination()


def run_fed(feed: Feed, stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Run over all that the feed brings, write each batch as a table, and read the batches back with their number."""
    spark = stream.sparkSession
    out, state = folder(spark, name), folder(spark, f"{name}-state")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/part={number}")

    drive(feed, stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state))
    schema = spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0)).schema
    return spark.read.schema(schema).parquet(out).drop("part") if feed.low is not None else spark.createDataFrame([], schema)


def upserted(feed: Feed, stream: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """A table with the row of the latest ``order`` of each key, after all that the feed brings."""
    spark = stream.sparkSession
    table = tables.Bucketed(folder(spark, name), keys, order)
    drive(feed, stream.writeStream.foreachBatch(table.merge).option("checkpointLocation", folder(spark, f"{name}-state")))
    return table.read(spark, stream.schema)


class RollingBuffer(StatefulProcessor):
    """The last ``size`` points of each series, whatever batch they came in, and an error row for a time that has come before.

    A list holds the points and a map how often each of their times came; both are as long as the buffer, and with
    ``keep`` (milliseconds) forgotten so long after their last change.
    """

    def __init__(self, size: int = 60, keep: int | None = None) -> None:
        self.size, self.keep = size, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.points = handle.getListState("points", "time timestamp, real_value double", self.keep)
        self.times = handle.getMapState("times", "time timestamp", "times int", self.keep)

    def handleInputRows(self, key, rows, timerValues):
        held = [tuple(p) for p in self.points.get()] if self.points.exists() else []
        seen = {k[0]: v[0] for k, v in self.times.iterator()} if self.times.exists() else {}
        out = []
        for time, value in sorted((r.time.to_pydatetime(), float(r.real_value)) for frame in rows for r in frame.itertuples()):
            seen[time] = seen.get(time, 0) + 1
            if seen[time] > 1:
                out.append((*key, time, None, None, "E704"))
                continue
            held = sorted([*held, (time, value)])[-self.size :]
            out.append((*key, time, len(held), sum(v for _, v in held) / len(held), None))
        self.points.put(held)
        self.times.clear()
        for time, _ in held:
            self.times.updateValue((time,), (seen[time],))
        frame = pd.DataFrame(out, columns=["target_id", "name", "time", "n", "mean", "error_code"])
        yield frame.astype({"n": "Int64", "mean": "Float64"})

    def close(self) -> None:
        pass


ROLLED = "target_id string, name string, time timestamp, n long, mean double, error_code string"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rolling(stream: DataFrame, size: int = 60, keep: int | None = None) -> DataFrame:
    """Points (target_id, name, time, real_value) with the number and mean of their series' buffer, or as error rows.

    The session's state store must be ``ROCKS``. With ``keep``, state goes by the clock, so such a stream has no end of its own.
    """
    mode = "None" if keep is None else "ProcessingTime"
    return stream.groupBy("target_id", "name").transformWithStateInPandas(RollingBuffer(size, keep), ROLLED, "Append", mode)


def rolled(feed: Feed, size: int = 60) -> DataFrame:
    """The buffers' rows for every point that the feed brings."""
    spark = feed.rows.sparkSession
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        return run_fed(feed, rolling(feed.stream.withColumn("time", F.col("time").cast("timestamp")), size), "append", "rolled")
    finally:
        spark.conf.set(STORE, before)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last batch's row of each key: what an updated table holds."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")
