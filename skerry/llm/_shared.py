"""Folders, written tables and file access that hold on a cluster."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where one machine is all there is (as in tests), a missing setting gives a new local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skerry-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_WRITTEN: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """URI of a folder in the shared root that no other run uses."""
    _WRITTEN.append(f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def drop_folders() -> None:
    """Remove the folders that this driver's operators have written, once their results are saved elsewhere."""
    while _WRITTEN:
        store, path = open_fs(_WRITTEN.pop())
        if store.get_file_info(path).type == pafs.FileType.Directory:
            store.delete_dir(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again.

    Cuts lineage: what follows is recomputed from these files if executors are lost.
    """
    uri = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def dealt(df: DataFrame) -> DataFrame:
    """A table as read, dealt over as many partitions as ``spark.skerry.readPartitions`` says, if it is set.

    For small tables of one file, which Spark reads in one task; unset, tables stay as they are split.
    """
    parts = df.sparkSession.conf.get("spark.skerry.readPartitions", None)
    return df.repartition(int(parts)) if parts else df


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; file, hdfs, s3 and gs URIs work on any executor."""
    return pafs.FileSystem.from_uri(uri)


def task_file(folder: str, suffix: str) -> tuple[pafs.FileSystem, str, str]:
    """A file name of its own for every attempt of a task: (file system, path, URI).

    A repeated attempt never writes over a file that another attempt reported.
    """
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    store, path = open_fs(folder)
    store.create_dir(path, recursive=True)
    return store, f"{path}/{uri.rsplit('/', 1)[1]}", uri


def task_count(spark: SparkSession) -> int:
    """Number of partitions for small lists of work such as files to read."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
