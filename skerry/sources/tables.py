"""Tables that batches of a stream change, each batch once however often it runs."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import sinks


class Manifest:
    """Small JSON files by batch number in a shared folder, read and written through Spark's file systems.

    What a batch has written counts once its manifest is there; a batch that runs again writes the same over it.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def _folder(self, spark: SparkSession):
        jvm = spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def numbers(self, spark: SparkSession) -> list[int]:
        _, path, store = self._folder(spark)
        if not store.exists(path):
            return []
        names = [f.getPath().getName() for f in store.listStatus(path)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def read(self, spark: SparkSession, number: int) -> dict:
        return json.loads(spark.read.text(f"{self.path}/{number}.json", wholetext=True).first()[0])

    def write(self, spark: SparkSession, number: int, content: dict) -> None:
        jvm, path, store = self._folder(spark)
        part, whole = (jvm.org.apache.hadoop.fs.Path(path, f"{number}{end}") for end in (".part", ".json"))
        out = store.create(part, True)
        try:
            out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            out.close()
        store.delete(whole, False)
        if not store.rename(part, whole):
            raise OSError(f"{whole.toString()}: the manifest could not be renamed")


class Bucketed:
    """A table by hash buckets of its keys, in which a batch rewrites only the buckets that it changes.

    The manifest of a batch names for each bucket the batch that wrote it last. Buckets of a batch are read
    from the manifest before it, so a batch that runs again gives the same table.
    """

    def __init__(self, path: str, keys: list[str], order: str, buckets: int = 64) -> None:
        self.path, self.keys, self.order, self.buckets = path, keys, order, buckets
        self.manifest = Manifest(f"{path}/manifest")

    def _of(self, spark: SparkSession, schema: StructType, found: Mapping[str, int], only: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/batch={n}/bucket={b}" for b, n in sorted(found.items(), key=lambda x: int(x[0])) if only is None or int(b) in only]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: the latest row of each key."""
        spark = batch.sparkSession
        before = [n for n in self.manifest.numbers(spark) if n < number]
        found = self.manifest.read(spark, before[-1]) if before else {}
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        held = batch.persist()
        try:
            touched = [r.bucket for r in held.select(bucket.alias("bucket")).distinct().collect()]  # at most ``buckets``
            if touched:
                rows = sinks.upsert(self._of(spark, batch.schema, found, touched), held, self.keys, self.order)
                rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={number}")
        finally:
            held.unpersist()
        self.manifest.write(spark, number, found | {str(b): number for b in touched})

    def read(self, spark: SparkSession, schema: StructType) -> DataFrame:
        """The table after the last batch that was finished."""
        numbers = self.manifest.numbers(spark)
        return self._of(spark, schema, self.manifest.read(spark, numbers[-1]) if numbers else {})


class Together:
    """Several tables that take the same batches: what a batch gives to them is there in all or in none.

    ``sinks`` makes each table's rows from a batch, which is computed once. Each writes under the batch's number, and the
    manifest follows when all have; readers see only batches in the manifest.
    """

    def __init__(self, path: str, sinks: Mapping[str, Callable[[DataFrame], DataFrame]]) -> None:
        self.path, self.sinks, self.manifest = path, dict(sinks), Manifest(f"{path}/manifest")

    def write(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``."""
        held = batch.persist()
        try:
            for name, make in self.sinks.items():
                make(held).write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        finally:
            held.unpersist()
        self.manifest.write(batch.sparkSession, number, {"sinks": sorted(self.sinks)})

    def read(self, spark: SparkSession, name: str, schema: StructType | str) -> DataFrame:
        """A table's rows of all batches in the manifest."""
        paths = [f"{self.path}/{name}/batch={n}" for n in self.manifest.numbers(spark)]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
