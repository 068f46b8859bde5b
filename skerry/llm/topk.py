"""Exact top-k inner products by ball-tree branch and bound, shard by shard.

Vectors become integers floor(scale * x). Candidates are dealt by a hash of their id into
shards of about ``shard`` vectors and at most ``cells`` components, queries into blocks of
about ``block``. A shard's ball tree is built once and written as a row with its vectors;
each task takes one shard's row and answers one block. A node's upper bound for a query is its
centre's product plus its radius times the query's length; leaves are taken in order of
the least bound of their nodes, in rounds of growing number, as long as it reaches the kth score known so far.

The kth score is shared: shards are searched in rounds, the first of one shard and each
next one of three times all before, and every round starts from the kth scores of the
rounds before it, so that later shards need only look for better ones. Each shard
answers with at most k rows for a query, which a window ranks after every round.

Rows: vectors that are null or hold null, NaN or infinite components take no part; vectors
of other lengths count as filled up with zeros; rows with null ids take no part; a query
never matches rows of its own id, so of repeated ids every other row is a candidate and
each query row is answered once for its id's smallest vector; rows with equal ids and scores
are each ranked; other columns are ignored; an empty table gives no rows.
Products are exact while they fit into 64 bits; larger ones are held at the limits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

ANSWER = "query_id long, vec_id long, score long"
TREE = "shard int, width int, ids binary, vectors binary, places binary, centres binary, radii binary, spans binary, children binary"


class BallTree:
    """Centres and radii of a binary tree over rows of integers."""

    def __init__(self, places: np.ndarray, centres: np.ndarray, radii: np.ndarray, spans: np.ndarray, children: np.ndarray) -> None:
        self.places, self.centres, self.radii, self.spans, self.children = places, centres, radii, spans, children

    @classmethod
    def over(cls, vectors: np.ndarray, leaf: int = 64) -> BallTree:
        x = vectors.astype(np.float64)
        places = np.arange(len(x))
        centres, radii, spans, children = [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            own = places[lo:hi]
            centre = x[own].mean(axis=0)
            far = np.sqrt(((x[own] - centre) ** 2).sum(axis=1))
            number = len(centres)
            centres.append(centre)
            radii.append(far.max() * (1 + 1e-9))
            spans.append((lo, hi))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = number
            if hi - lo > leaf:
                a = x[own[far.argmax()]]
                b = x[own[((x[own] - a) ** 2).sum(axis=1).argmax()]]
                along = np.argsort(x[own] @ (b - a), kind="stable")
                places[lo:hi] = own[along]
                middle = (lo + hi) // 2
                todo += [(lo, middle, number, 0), (middle, hi, number, 1)]
        return cls(places, np.stack(centres), np.array(radii), np.array(spans), np.array(children))

    def row(self) -> dict[str, bytes]:
        """The tree's arrays as the columns of a table."""
        return {c: getattr(self, c).tobytes() for c in ("places", "centres", "radii", "spans", "children")}

    @classmethod
    def of_row(cls, row: pd.Series) -> BallTree:
        """The tree that :meth:`row` wrote."""
        radii = np.frombuffer(row["radii"])
        spans, children = (np.frombuffer(row[c], np.int64).reshape(-1, 2) for c in ("spans", "children"))
        return cls(np.frombuffer(row["places"], np.int64), np.frombuffer(row["centres"]).reshape(len(radii), -1), radii, spans, children)


def _scores(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Products of every vector with every query, held at the limits of 64 bits."""
    products = vectors @ queries.T
    if products.dtype == object:
        return np.array([max(-(2**63), min(2**63 - 1, v)) for v in products.ravel()], dtype=np.int64).reshape(products.shape)
    return products


def _reach(tree: BallTree, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the leaves, and for each the highest product of each query that its ball and those around it allow."""
    bounds = tree.centres @ q.T
    bounds += tree.radii[:, None] * np.sqrt((q * q).sum(axis=1))
    slack = np.abs(bounds)
    slack += 1
    slack *= 1e-6
    bounds += slack
    del slack
    np.maximum(bounds, -(2.0**63), out=bounds)  # where products are held, too
    for node, (left, right) in enumerate(tree.children.tolist()):  # a node stands before its children
        if left >= 0:
            for child in (left, right):
                np.minimum(bounds[child], bounds[node], out=bounds[child])
    leaf = tree.children[:, 0] < 0
    return tree.spans[leaf], bounds[leaf]


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest scores of each row, of equal ones those with the least ids, in order of row and score."""
    order = np.lexsort((ids, ~scores, rows))  # ~ turns the order and, unlike -, has a value for the least number
    rows = rows[order]
    top = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[top], ids[order][top], scores[order][top]


def search(tree: BallTree, vectors: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, known: np.ndarray, k: int, held: int = 1 << 14):
    """(query_id, vec_id, score) of the best k candidates of each query that reach its known kth score.

    Each query takes leaves in order of their bounds, in rounds of three times as many as all before; in a round, all queries
    that still reach a leaf are multiplied with its vectors at once. Candidates are cut to the best k after
    every round, or sooner if there are more than ``held``.
    """
    q, floor = queries.astype(np.float64), known.astype(np.float64)
    spans, bounds = _reach(tree, q)
    ends = [1]  # leaves that each query has taken after each round
    while ends[-1] < len(spans):
        ends.append(min(len(spans), 4 * ends[-1]))
    lows, above = np.sort(bounds, axis=0)[[len(spans) - n for n in ends]], np.full(len(q), np.inf)
    largest = [max(float(x.max()), -float(x.min())) for x in (vectors, queries)]
    as_floats = largest[0] * largest[1] * vectors.shape[1] < 2**53  # then products of floats are exact, and many times faster
    none = np.zeros(0, np.int64)
    best, found, waiting = (none, none, none), [], 0

    def cut() -> None:
        nonlocal best, waiting
        best = _best(*(np.concatenate(c) for c in zip(best, *found, strict=True)), k)
        found.clear()
        waiting = 0
        last = np.searchsorted(best[0], np.arange(len(q)), side="right") - 1  # each query's lowest
        full = np.bincount(best[0], minlength=len(q)) == k
        floor[full] = np.maximum(floor[full], best[2][last[full]].astype(np.float64))

    for low in lows:
        for (lo, hi), bound in zip(spans.tolist(), bounds, strict=True):
            reaching, own, step = np.flatnonzero((bound >= low) & (bound >= floor) & (bound < above)), tree.places[lo:hi], max(1, held // (hi - lo))
            for open_ in (reaching[i : i + step] for i in range(0, len(reaching), step)):
                scores = _scores(vectors[own].astype(np.float64), q[open_]) if as_floats else _scores(vectors[own], queries[open_])
                row, at = np.nonzero(((scores >= floor[open_]) & (ids[own][:, None] != query_ids[open_])).T)
                found.append((open_[row], ids[own][at], scores[at, row].astype(np.int64)))
                waiting += len(row)
                if waiting > held:
                    cut()
        if found:
            cut()
        above = low
    cuts = np.searchsorted(best[0], np.arange(len(q) + 1))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        yield query_ids[i], best[1][a:b], best[2][a:b]


def _integers(rows: pd.Series, width: int) -> np.ndarray:
    """Rows of integers, filled up with zeros."""
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's vectors and ball tree as one row."""
    rows = rows.sort_values("vec_id", kind="stable")
    width = max(1, max(map(len, rows["v"])))
    vectors = _integers(rows["v"], width)
    row = {"shard": key[0], "width": width, "ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "vectors": vectors.tobytes()}
    return pd.DataFrame([row | BallTree.over(vectors).row()])


def _answer(k: int):
    def run(key: tuple, shard: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "vec_id", "score")})
        if not len(shard) or not len(queries):
            return none
        row, tree = shard.iloc[0], BallTree.of_row(shard.iloc[0])
        queries = queries.sort_values("query_id", kind="stable")
        ids, vectors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(-1, row["width"])
        width = max(row["width"], max(map(len, queries["v"])))
        asked = _integers(queries["v"], width)
        if width > row["width"]:
            more = ((0, 0), (0, width - row["width"]))
            vectors, tree.centres = np.pad(vectors, more), np.pad(tree.centres, more)
        if max(np.abs(x.astype(np.float64)).max() for x in (vectors, asked)) >= 1 << 28:  # products beyond 64 bits
            vectors, asked = vectors.astype(object), asked.astype(object)
        known = queries["known"].astype("float64").fillna(-np.inf).to_numpy()
        found, vec_ids, scores = zip(*search(tree, vectors, ids, asked, queries["query_id"].to_numpy(), known, k), strict=True)
        return pd.DataFrame({"query_id": np.repeat(found, [len(i) for i in vec_ids]), "vec_id": np.concatenate(vec_ids), "score": np.concatenate(scores)})

    return run


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of vectors whose components are all finite."""
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard: int = 8192, block: int = 4096, cells: int = 1 << 22) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all rows for each vec_id divisible by ``every``.

    Shards' rows go to each query block's tasks and queries to each shard's; a task holds
    one shard and one block. Trees are built once.
    """
    rows = materialize(integer_vectors(vectors, scale), "vectors")
    n, width = rows.agg(F.count("*"), F.greatest(F.max(F.size("v")), F.lit(1))).first()
    shard, block = (max(1, min(most, cells // width)) for most in (shard, block))
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n // (every * block)))
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every_one = lambda lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi - 1)))
    trees = materialize(rows.groupBy(deal("vec_id", shards).alias("shard")).applyInPandas(_grow, TREE), "trees")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    asked = materialize(asked.withColumn("block", deal(F.col("query_id") + 1, blocks)), "asked")

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = rows.sparkSession.createDataFrame([], f"{ANSWER}, rank int")
    done = 0
    while done < shards:
        last = min(shards, max(1, 4 * done))
        kth = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("known"))
        open_ = asked.join(kth, "query_id", "left").withColumn("shard", every_one(done, last))
        near = trees.where(F.col("shard").between(done, last - 1)).withColumn("block", every_one(0, blocks))
        found = near.groupBy("shard", "block").cogroup(open_.groupBy("shard", "block")).applyInPandas(_answer(k), ANSWER)
        ranked = best.drop("rank").unionByName(found).withColumn("rank", F.row_number().over(order))
        best, done = materialize(ranked.where(F.col("rank") <= k), "best"), last
    return best.select("query_id", "rank", "vec_id", "score")
