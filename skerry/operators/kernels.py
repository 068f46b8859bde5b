"""Kernel sums on a grid by partial vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def grid_sums(rows: DataFrame, top: float, grid: int, bandwidth: float, fan: int = 32) -> DataFrame:
    """(key, i, n, sum): for each key and place of a grid from 0 to ``top`` the sum of exp(-((place - v) / bandwidth)**2 / 2) over its rows.

    A task adds a vector of ``grid`` sums for each of its keys and shuffles these; ``fan`` groups for
    each key add up the tasks' vectors, and one adds up these. ``key`` is a string, of which null is one.
    """
    at = np.arange(grid) * top / (grid - 1)

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}

        def vectors() -> pa.RecordBatch:
            columns = [pa.array(list(held), pa.string()), pa.array([h[0] for h in held.values()], pa.int64()), pa.array([h[1].tolist() for h in held.values()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, ["key", "n", "sums"])

        for batch in batches:
            keys, v = batch.column("key").dictionary_encode(null_encoding="encode"), np.asarray(batch.column("v"))
            code = np.asarray(keys.indices)
            for k, key in enumerate(keys.dictionary.to_pylist()):
                own = v[code == k]
                sums = held.setdefault(key, [0, np.zeros(grid)])
                sums[0] += len(own)
                for i in range(0, len(own), 512):
                    sums[1] += np.exp(-0.5 * ((at[None, :] - own[i : i + 512, None]) / bandwidth) ** 2).sum(axis=0)
            if len(held) > 2000:
                yield vectors()
                held.clear()
        if held:
            yield vectors()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [rows["key"].iloc[0]], "n": [int(rows["n"].sum())], "sums": [np.sum(np.stack(rows["sums"].to_numpy()), axis=0)]})

    known = rows.where(F.col("v").isNotNull() & ~F.isnan("v"))
    schema = "key string, n long, sums array<double>"
    parts = known.mapInArrow(partly, schema).withColumn("fan", F.spark_partition_id() % fan)
    once = parts.groupBy("key", "fan").applyInPandas(added, schema)
    whole = once.groupBy("key").applyInPandas(added, schema)
    return whole.select("key", "n", F.posexplode("sums").alias("i", "sum"))
