"""Transition graphs of log templates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordering import blocks, joined


def transitions(lines: DataFrame, by: list[str], template: str) -> DataFrame:
    """Edges between the templates of numbered lines (``n``) that follow one another, with how often they do."""
    rows = blocks(lines.select(*by, "n", template), 1)
    own = Window.partitionBy(*by, "_block").orderBy("n")
    pairs = rows.select(*by, "_own", F.col(template).alias("src"), F.lead(template).over(own).alias("dst")).where("_own AND dst IS NOT NULL")
    return pairs.groupBy(*by, "src", "dst").agg(F.count("*").alias("weight"))


def row_normalized(edges: DataFrame, by: list[str]) -> DataFrame:
    """Transition probabilities after adding a self-loop of weight 1 to every node."""
    nodes = edges.select(*by, "src").union(edges.select(*by, F.col("dst").alias("src"))).distinct()
    loops = nodes.select(*by, "src", F.col("src").alias("dst"), F.lit(1).cast("long").alias("weight"))
    all_edges = edges.unionByName(loops).groupBy(*by, "src", "dst").agg(F.sum("weight").alias("weight"))
    totals = all_edges.groupBy(*by, "src").agg(F.sum("weight").alias("total"))
    return joined(all_edges, totals, [*by, "src"]).withColumn("p", F.col("weight") / F.col("total")).drop("total")


def first_sights(windows: np.ndarray) -> np.ndarray:
    """For each place of each window the first place with the same template: windows of one shape get the same row."""
    m, width = windows.shape
    out = np.tile(np.arange(width, dtype=np.uint8), (m, 1))
    for j in range(1, width):
        same = windows[:, :j] == windows[:, j : j + 1]
        out[:, j] = np.where(same.any(axis=1), same.argmax(axis=1), j)
    return out


def edge_counts(shapes: np.ndarray) -> np.ndarray:
    """Distinct steps of each window."""
    codes = np.sort(shapes[:, :-1].astype(np.int32) * shapes.shape[1] + shapes[:, 1:], axis=1)
    return (np.diff(codes, axis=1) != 0).sum(axis=1) + 1


def _types(rows: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)


def _by_blocks(lines: DataFrame, by: list[str], kept: list[str], template: str, width: int, behind: int, run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], more: str) -> DataFrame:
    """``run`` over each block of numbered lines and its windows of template ids; a block is bounded, whatever a target's size."""

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", ignore_index=True)
        ids = rows[template].to_numpy(np.int64)
        windows = np.lib.stride_tricks.sliding_window_view(ids, width) if len(ids) >= width else np.zeros((0, width), np.int64)
        return run(rows, windows)

    dealt = blocks(lines.select(*dict.fromkeys([*by, *kept, "n"]), template), width - 1, behind=behind)
    return dealt.groupBy(*by, "_block").applyInPandas(block, f"{_types(lines, [*by, *kept])}, {more}")


def line_windows(lines: DataFrame, by: list[str], order: list[str], template: str = "t", width: int = 30) -> DataFrame:
    """One row for each run of ``width`` numbered lines (``n``, with a 64-bit ``template``), told by its first line.

    ``nodes`` are its templates by first sight, ``shape`` each place's template by the place where it is first seen: a byte each.
    """
    kept = [*order, "n"]

    def run(rows: pd.DataFrame, windows: np.ndarray) -> pd.DataFrame:
        own = np.flatnonzero(rows["_own"].to_numpy()[: len(windows)])
        shapes = first_sights(windows[own])
        out = rows.iloc[own][[*by, *kept]].reset_index(drop=True)
        new = shapes == np.arange(width)
        out["nodes"] = pd.Series([w[k].tolist() for w, k in zip(windows[own], new, strict=True)], dtype=object)  # a block may begin no window
        out["edges"] = edge_counts(shapes) if len(own) else np.zeros(0, np.int64)
        out["shape"] = pd.Series([s.tobytes() for s in shapes], dtype=object)
        return out

    return _by_blocks(lines, by, kept, template, width, 0, run, "nodes array<bigint>, edges long, shape binary")


def window_graphs(windows: DataFrame) -> DataFrame:
    """The number of nodes and edges of each window's graph, and whether it has more than one edge."""
    return windows.drop("shape").withColumns({"nodes": F.size("nodes").cast("long"), "proper": F.col("edges") > 1})


def own_shares(windows: np.ndarray) -> np.ndarray:
    """For each place of each window the share of its places that have the same template."""
    return (windows[:, :, None] == windows[:, None, :]).mean(axis=2)


def line_scores(lines: DataFrame, by: list[str], order: list[str], score: Callable[[np.ndarray], np.ndarray], template: str = "t", width: int = 30) -> DataFrame:
    """Mean over the windows with more than one edge that cover a numbered line of its place's score in each.

    ``score`` gives the scores of an array of windows, place by place. Lines that no window covers are not there.
    """

    def run(rows: pd.DataFrame, windows: np.ndarray) -> pd.DataFrame:
        total, covered = np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        for i in range(0, len(windows), 1024):
            part = windows[i : i + 1024]
            proper = edge_counts(first_sights(part)) > 1
            scores = score(part) * proper[:, None]
            for j in range(width):
                total[i + j : i + j + len(part)] += scores[:, j]
                covered[i + j : i + j + len(part)] += proper
        there = np.flatnonzero((covered > 0) & rows["_own"].to_numpy())
        return rows.iloc[there][[*by, *order]].assign(line_score=total[there] / covered[there])

    return _by_blocks(lines, by, order, template, width, width - 1, run, "line_score double")


def _inverse(x: np.ndarray) -> np.ndarray:
    return np.divide(1.0, x, out=np.zeros_like(x), where=x != 0)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Divided by the roots of both ends' row sums."""
    root = _inverse(np.sqrt(np.maximum(m.sum(axis=-1), 0)))
    return root[..., :, None] * m * root[..., None, :]


def _walk(weights: np.ndarray) -> np.ndarray:
    looped = weights + np.eye(weights.shape[-1])
    return looped * _inverse(looped.sum(axis=-1))[..., :, None]


def directed_laplacian(weights: np.ndarray, alpha: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric operators of directed graphs (stacked), and the stationary vectors that they rest on.

    A walker leaves its graph for an outer node with probability ``alpha`` and comes back to any node.
    """
    p, n = _walk(weights), weights.shape[-1]
    # pi = (1 - alpha) pi P + outer / n, with outer = alpha * sum(pi): a linear system up to scale
    turned = np.swapaxes(p, -1, -2)
    pi = np.linalg.solve(np.eye(n) - (1 - alpha) * turned, np.full((*weights.shape[:-1], 1), 1.0 / n))[..., 0]
    pi /= pi.sum(axis=-1, keepdims=True)
    root = np.sqrt(pi)
    half = root[..., :, None] * p * _inverse(root)[..., None, :]
    return _scaled((half + np.swapaxes(half, -1, -2)) / 2), pi


def second_order(weights: np.ndarray) -> np.ndarray:
    """Mean of the proximities by what leads to two nodes and by where they lead, where both are there."""
    p = _walk(weights)
    turned = np.swapaxes(p, -1, -2)
    into, out = turned @ p, p @ turned
    both = (into != 0) & (out != 0)
    return _scaled(np.where(both, (into + out) / 2, 0.0))


def shape_weights(shapes: np.ndarray) -> np.ndarray:
    """Weighted graphs (stacked) of windows that have equally many nodes: how often a node follows another."""
    new = shapes == np.arange(shapes.shape[1])
    node = np.cumsum(new, axis=1) - 1
    places = np.take_along_axis(node, shapes.astype(np.int64), axis=1)
    weights = np.zeros((len(shapes), int(new[0].sum()), int(new[0].sum())))
    at = np.repeat(np.arange(len(shapes)), shapes.shape[1] - 1)
    np.add.at(weights, (at, places[:, :-1].ravel(), places[:, 1:].ravel()), 1)
    return weights


def _solved(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("shape").to_pylist()
            if not raw:
                continue
            shapes = np.stack([np.frombuffer(s, np.uint8) for s in raw])
            sizes = (shapes == np.arange(shapes.shape[1])).sum(axis=1)
            for n in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == n)
                for i in range(0, len(own), 512):
                    part = own[i : i + 512]
                    operators, pi = directed_laplacian(shape_weights(shapes[part]))
                    if order == 2:
                        operators = second_order(operators)
                    at, src, dst = np.nonzero(operators)
                    ends = np.append(0, np.cumsum(np.bincount(at, minlength=len(part)))).astype(np.int32)
                    edges = pa.StructArray.from_arrays([pa.array(src.astype(np.int32)), pa.array(dst.astype(np.int32)), pa.array(operators[at, src, dst])], names=["src", "dst", "weight"])
                    shares = pa.ListArray.from_arrays(np.arange(0, pi.size + 1, n, dtype=np.int32), pa.array(pi.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([raw[k] for k in part.tolist()], pa.binary()), pa.ListArray.from_arrays(ends, edges), shares], names=["shape", "operator", "pi"])

    return run


def window_operators(windows: DataFrame, order: int = 1) -> DataFrame:
    """The first- or second-order ``operator`` of each window's graph as edges between places of ``nodes``, and the stationary shares ``pi`` of the nodes.

    It hangs on the window's shape alone: each distinct shape is solved once, many of a size in one stacked solution, and joined back.
    """
    solved = windows.select("shape").distinct().mapInArrow(_solved(order), "shape binary, operator array<struct<src:int,dst:int,weight:double>>, pi array<double>")
    return windows.join(solved, "shape").drop("shape")
