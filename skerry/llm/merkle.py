"""Merkle manifest of a table of documents: one tree for each source, one over their roots.

1. Each row's leaf is the SHA-256 of its fields, computed by Spark's own functions; so is the
   leaf of the row as it would be after tampering, where a row is to be tampered with.
2. Leaves are numbered in each source by a range-partitioned sort: places inside a partition,
   and a running sum over the partitions' counts, so that no task orders a whole source.
3. Blocks of ``ARITY ** LEVELS`` leaves become a row each, and every block's subtree is
   reduced to one node where the block lies.
4. These nodes are the leaves of a small top tree. The driver builds it and broadcasts, for
   each of its nodes, the subroot, the root and the siblings on the way up: the suffix of
   every path below. It holds at most ``TOP`` nodes of some 40 steps of two digests (20 MB);
   with more, the nodes are themselves numbered in blocks and reduced by Spark, round by
   round, and their suffixes are joined instead.
5. Each block's rows then get the rest of their path from their block's subtree; the proof's
   digest and the fold from the leaf to the root are computed row by row.

Rows: null fields are ``-`` in a leaf; a null source is a source of its own and comes first; null
doc_ids come first in their source and aren't tampered with; repeated doc_ids are ordered by leaf, and
repeated rows are leaves of their own; empty texts have no bytes, very long ones are hashed whole by Spark; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialize

ARITY, LEVELS, TOP = 3, 7, 8192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

STEP = pa.struct([("before", pa.binary()), ("after", pa.binary())])
PATH = "array<struct<before:binary,after:binary>>"


def leaf_of(*values: Column) -> Column:
    """Digest of a row: each value as its UTF-8 byte count, a colon and itself, or ``-`` for null."""
    texts = [v.cast("string") for v in values]
    fields = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, h, changed): each row's source and leaf, and its leaf after tampering where that differs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)) & F.coalesce(F.contains("text", F.lit("\n")), F.lit(False))
    cut = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    return rows.select(F.col("source").alias("tree"), "doc_id", leaf_of(*map(F.col, FIELDS)).alias("h"), F.when(hit, leaf_of(*cut)).alias("changed"))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with their place (``rank``, from 0) in their tree's order, nulls first, and the tree's ``size``.

    Rows that are alike in all these columns may fall into several partitions: a last key
    of no meaning tells them apart.
    """
    rows = materialize(rows.withColumn("tie", F.monotonically_increasing_id()), "unordered")
    keys = [tree, *order, "tie"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()), "ordered").withColumn("part", F.shiftright("place", 33))
    spans = placed.groupBy(F.col(tree).alias("t"), F.col("part").alias("p")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    each = Window.partitionBy("t")  # a row for each partition that holds the tree
    before = F.coalesce(F.sum("n").over(each.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = spans.select("t", "p", (before - F.col("first")).alias("shift"), F.sum("n").over(each).alias("size"))
    found = placed.join(spans, F.col(tree).eqNullSafe(F.col("t")) & (F.col("part") == F.col("p")))
    return found.withColumn("rank", F.col("place") + F.col("shift")).drop("t", "p", "part", "place", "shift")


def in_blocks(nodes: DataFrame, columns: list[str], levels: int = LEVELS) -> DataFrame:
    """(tree, block, size, rows): the nodes (tree, rank, size, ...) of each block in order, as one written row."""
    block = F.floor(F.col("rank") / F.lit(ARITY**levels)).cast("long").alias("block")
    rows = nodes.select("tree", block, "size", F.struct("rank", *columns).alias("row"))
    return materialize(rows.groupBy("tree", "block", "size").agg(F.sort_array(F.collect_list("row")).alias("rows")), "blocks")


def digest(*parts: bytes) -> bytes:
    """SHA-256 as hex text of the joined parts."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def runs(nodes: list[bytes]) -> list[bytes]:
    """The level above: the digest of each run of ``ARITY`` nodes."""
    return [digest(*nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]


def subtree(nodes: list[bytes], size: int, most: int = LEVELS) -> list[list[bytes]]:
    """Levels of a block in a tree of ``size`` nodes: up to its root, or ``most`` of them if the tree has other blocks."""
    levels = [nodes]
    while len(levels) <= most and (len(levels[-1]) > 1 or size > ARITY**most):
        levels.append(runs(levels[-1]))
    return levels


def steps(levels: list[list[bytes]], at: int) -> list[tuple[bytes, bytes]]:
    """The siblings before and after on each level from a node up to the subtree's root."""
    out = []
    for nodes in levels[:-1]:
        first = at - at % ARITY
        out.append((b"".join(nodes[first:at]), b"".join(nodes[at + 1 : first + ARITY])))
        at //= ARITY
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    return reduce(lambda h, step: digest(step[0], h, step[1]), path, leaf)


def _hex(raw: bytes) -> bytes:
    return raw.hex().encode()


def _packed(path: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"before": bytes.fromhex(a.decode()), "after": bytes.fromhex(b.decode())} for a, b in path]


def _unpacked(path: list[dict]) -> list[tuple[bytes, bytes]]:
    return [(_hex(s["before"]), _hex(s["after"])) for s in path]


_ROOTS = pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("size", pa.int64()), ("h", pa.binary())])


def block_roots(blocks: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, rank, size, h): each block as one node of its tree's next round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                top = subtree([_hex(x["h"]) for x in r["rows"]], r["size"], levels)[-1][0]
                out.append({"tree": r["tree"], "rank": r["block"], "size": -(-r["size"] // ARITY**levels), "h": bytes.fromhex(top.decode())})
            yield pa.RecordBatch.from_pylist(out, schema=_ROOTS)

    narrow = blocks.select("tree", "block", "size", F.transform("rows", lambda r: F.struct(r["h"].alias("h"))).alias("rows"))
    return narrow.mapInArrow(run, "tree string, rank long, size long, h binary")


SUFFIX = f"tree string, rank long, subroot binary, root binary, path {PATH}"
_SUFFIXES = pa.schema([("tree", pa.string()), ("rank", pa.int64()), ("subroot", pa.binary()), ("root", pa.binary()), ("path", pa.list_(STEP))])


def _below(most: int):
    """Suffixes of a block's nodes from the block's own suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                levels = subtree([_hex(x["h"]) for x in r["rows"]], r["size"], most)
                paths = [_packed(steps(levels, i)) + r["path"] for i in range(len(levels[0]))]
                yield pa.RecordBatch.from_pylist([{"tree": r["tree"], "rank": x["rank"], "subroot": r["subroot"], "root": r["root"], "path": p} for x, p in zip(r["rows"], paths, strict=True)], schema=_SUFFIXES)

    return run


def top_tree(nodes: list, one: bool) -> list[tuple]:
    """(tree, rank, subroot, root, path) of the nodes (tree, rank, h) of few trees; ``one``: they are one tree, that of all subroots."""
    if not nodes:
        return []
    trees: dict[str | None, list] = {}
    for r in sorted(nodes, key=lambda r: (r.tree is not None, (r.tree or "").encode(), r["rank"])):
        trees.setdefault(r.tree, []).append(_hex(bytes(r.h)))
    own = {t: whole(h) for t, h in trees.items()}
    over = whole([levels[-1][0] for levels in own.values()]) if not one else [[own[None][-1][0]]]
    root, out = over[-1][0], []
    for i, (t, levels) in enumerate(own.items()):
        above = steps(over, i)
        for at in range(len(levels[0])):
            out.append((t, at, bytes.fromhex(levels[-1][0].decode()), bytes.fromhex(root.decode()), _packed(steps(levels, at) + above)))
    return out


def whole(nodes: list[bytes]) -> list[list[bytes]]:
    """All levels up to one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append(runs(levels[-1]))
    return levels


def suffixes(nodes: DataFrame, top: int = TOP, levels: int = LEVELS, one: bool = False) -> DataFrame:
    """(tree, rank, subroot, root, path) of each node (tree, rank, size, h): the way from it to the root of all.

    At most ``top`` nodes come to the driver, and what they give is broadcast. More are
    reduced in blocks first; sources that are whole wait as single nodes, and if only such
    are left, they are numbered as the leaves of the last tree.
    """
    nodes = materialize(nodes, "nodes")
    if nodes.limit(top + 1).count() <= top:
        return F.broadcast(nodes.sparkSession.createDataFrame(top_tree(nodes.select("tree", "rank", "h").collect(), one), SUFFIX))
    if not nodes.where("size > 1").isEmpty():
        blocks = in_blocks(nodes, ["h"], levels)
        return _joined(blocks, suffixes(block_roots(blocks, levels), top, levels, one)).mapInArrow(_below(levels), SUFFIX)
    order = numbered(nodes.select(F.lit(None).cast("string").alias("all"), F.col("tree").alias("source"), "h"), "all", ["source"])
    flat = materialize(order.select(F.col("all").alias("tree"), "rank", "size", "h", "source"), "sources")
    above = suffixes(flat.select("tree", "rank", "size", "h"), top, levels, True).select(F.col("rank").alias("at"), "root", "path")
    return flat.join(above, F.col("rank") == F.col("at")).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("rank"), F.col("h").alias("subroot"), "root", "path")


def _joined(blocks: DataFrame, above: DataFrame) -> DataFrame:
    above = above.select(F.col("tree").alias("t"), F.col("rank").alias("b"), "subroot", "root", "path")
    return blocks.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b"))).drop("t", "b")


_OUT = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]


def _finish(most: int):
    """The rows of blocks with their proofs and folds."""
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in _OUT), ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                levels = subtree([_hex(x["h"]) for x in r["rows"]], r["size"], most)
                suffix, subroot, root = _unpacked(r["path"]), r["subroot"].hex(), _hex(r["root"])
                out = []
                for i, x in enumerate(r["rows"]):
                    path = steps(levels, i) + suffix
                    leaf = levels[0][i]
                    folded = fold(_hex(x["changed"]) if x["changed"] is not None else leaf, path)
                    proof = digest(*(part for step in path for part in step))
                    out.append((x["doc_id"], leaf.decode(), subroot, root.decode(), proof.decode(), folded.decode(), folded == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(j).type) for j, c in enumerate(zip(*out, strict=True))], schema=schema)

    return run


def manifest(docs: DataFrame, top: int = TOP, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every document."""
    placed = numbered(leaves(docs), "tree", ["doc_id", "h"])
    blocks = in_blocks(placed, ["doc_id", "h", "changed"], levels)
    done = _joined(blocks, suffixes(block_roots(blocks, levels), top, levels))
    return done.mapInArrow(_finish(levels), "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
