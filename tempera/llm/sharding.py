"""Sharding by k-d tree: nodes split at weighted medians along their widest metadata dimension.

Every level of the tree takes one pass for the extent of all nodes and a few passes that narrow
down all their medians at once: each pass counts the bytes of at most ``BINS`` ranges a node and the
driver picks the range that holds the cut. The driver only sees those sums (nodes times bins, both
fixed), never rows. Rows equal in the split dimension are divided by a hash of the whole row, so one
value or text may hold any part of the bytes. A node of k leaves splits in the proportion of the
leaves on either side; leaves end up at the target bytes to within a document and ``TOLERANCE``.

Languages and sources are dimensions by the rank of their whole strings, which Spark sorts.

Defined cases: a null text has size 16 and the checksum of no bytes; null metadata sorts first;
repeated rows are rows of their own; a null doc_id is a document like others; an empty table gives no rows; fewer rows than shards leave
shards empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempera.llm.common import joined, mapped, n_partitions, written

DIMS = 4  # language, source, characters, id
BINS = 1024
TOLERANCE = 0.001  # of the target bytes of a leaf
_TIE_BITS, _SUB_BITS = 40, 8
OVERHEAD = 16  # bytes counted for each document besides its text


@dataclass
class _Node:
    """A node still to be split: its leaves are the shards first to first + leaves - 1."""

    first: int
    leaves: int
    bytes: int = 0
    dim: int = 0
    lo: int = 0  # range of the split dimension, then of the tie hash, that holds the cut
    hi: int = 0
    cut: int | None = None  # rows below it, or at it with a tie below cut_tie, go left
    cut_tie: int = 0
    left: int = 0  # bytes known to lie left of the range
    children: tuple[_Node, _Node] | None = None


def ranks(docs: DataFrame, column: str) -> DataFrame:
    """``value, rank`` (from 0) of the distinct strings of a column: Spark deals them out by ranges, each of
    which is numbered by itself, from the count of those before it."""
    values = docs.select(F.col(column).alias("value")).where("value is not null").distinct()
    dealt = values.repartitionByRange(n_partitions(docs.sparkSession), "value").withColumn("part", F.spark_partition_id())
    dealt = written(dealt, "kd-values")
    counts = {r["part"]: r["count"] for r in dealt.groupBy("part").count().collect()}
    before = {p: sum(n for q, n in counts.items() if q < p) for p in counts}
    starts = docs.sparkSession.createDataFrame(sorted(before.items()), "part int, start long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    return dealt.join(F.broadcast(starts), "part").select("value", (inside + F.col("start")).cast("long").alias("rank"))


def document_table(docs: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32``, the dimensions ``d0..`` and the tie hash, without the text."""
    raw = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long"))
    table = docs.select(
        "doc_id",
        (F.length(raw) + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        whole("n_chars").alias("d2"),
        whole("doc_id").alias("d3"),
        F.monotonically_increasing_id().alias("row"),
    )
    for name, c in (("d0", "lang"), ("d1", "source")):
        of = written(ranks(docs.select(F.col(c).cast("string").alias(c)), c).toDF(c, "rank"), "kd-ranks")
        table = joined(table, of, c, "left", 64).withColumn(name, whole("rank")).drop("rank")
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "row"), 64 - _TIE_BITS)
    return table.select("doc_id", "size", "text_crc32", *[f"d{i}" for i in range(DIMS)], tie.alias("tie"))


def _routed(root: _Node, columns: dict[str, np.ndarray]) -> np.ndarray:
    """The node that each row of a batch has reached."""
    out = np.zeros(len(columns["tie"]), np.int64)
    todo = [(root, np.arange(len(out)))]
    while todo:
        n, at = todo.pop()
        if n.children is None:
            out[at] = n.first
            continue
        value, tie = columns[f"d{n.dim}"][at], columns["tie"][at]
        right = (value > n.cut) | ((value == n.cut) & (tie >= n.cut_tie)) if n.cut is not None else np.zeros(len(at), bool)
        todo += [(n.children[0], at[~right]), (n.children[1], at[right])]
    return out


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}


def _sums(rows: DataFrame, of) -> list:
    """Sum, least and greatest value by key, of what ``of`` gives for a batch: arrays of keys, bytes
    and values. A task gives one row a key and batch; Spark adds them up."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, key, size, value = of(_columns(batch))
            if not len(node):
                continue
            order = np.lexsort((value, key, node))
            node, key, size, value = node[order], key[order], size[order], value[order]
            first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (key[1:] != key[:-1])])
            last = np.r_[first[1:], len(node)] - 1
            parts = node[first], key[first], np.add.reduceat(size, first), value[first], value[last]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in parts], ["node", "key", "b", "lo", "hi"])

    found = mapped(rows, partial, "node long, key long, b long, lo long, hi long").groupBy("node", "key")
    return found.agg(F.sum("b").alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()


def _measure(rows: DataFrame, root: _Node, level: list[_Node], extent: list[tuple[int, int]]) -> None:
    """Bytes of each node, and its widest dimension, as a share of that dimension's whole extent."""

    def of(c: dict) -> tuple:
        node = np.tile(_routed(root, c), DIMS)
        return node, np.repeat(np.arange(DIMS), len(c["tie"])), np.tile(c["size"], DIMS), np.concatenate([c[f"d{i}"] for i in range(DIMS)])

    nodes = {n.first: n for n in level}
    spreads: dict[int, list] = {}
    for r in _sums(rows, of):
        lo, hi = extent[r["key"]]
        spreads.setdefault(r["node"], []).append(((r["hi"] - r["lo"]) / max(1, hi - lo), -r["key"], r["b"], r["lo"], r["hi"]))
    for k, found in spreads.items():
        if n := nodes.get(k):
            _, dim, n.bytes, n.lo, n.hi = max(found)
            n.dim = -dim


def _narrow(rows: DataFrame, root: _Node, level: list[_Node], tolerance: float) -> None:
    """Weighted medians of all nodes by repeated histograms."""
    open_ = [n for n in level if n.bytes]
    while open_:
        state = {n.first: (n.dim, n.cut, n.lo, n.hi, -(-(n.hi - n.lo + 1) // BINS)) for n in open_}

        def of(c: dict, state=state) -> tuple:
            node, parts = _routed(root, c), []
            for k, (dim, cut, lo, hi, width) in state.items():
                at = np.flatnonzero(node == k)
                value = c[f"d{dim}"][at]
                if cut is not None:
                    at = at[value == cut]
                    value = c["tie"][at]
                inside = (value >= lo) & (value <= hi)
                at, value = at[inside], value[inside]
                parts.append((node[at], (value - lo) // width, c["size"][at], value))
            return tuple(map(np.concatenate, zip(*parts, strict=True)))

        bins: dict[int, list] = {}
        for r in _sums(rows, of):
            bins.setdefault(r["node"], []).append((r["key"], r["b"], r["lo"], r["hi"]))
        still = []
        for n in open_:
            goal, tie, found, k = n.bytes * (n.leaves // 2) / n.leaves, n.cut is not None, sorted(bins[n.first]), 0
            while k < len(found) - 1 and n.left + found[k][1] <= goal:
                n.left += found[k][1]
                k += 1
            _, weight, lo, hi = found[k]
            if weight <= tolerance or (tie and lo == hi):  # whole to the nearer side
                edge = hi + 1 if n.left + weight / 2 <= goal else lo
                n.cut, n.cut_tie = (n.cut, edge) if tie else (edge, 0)
                continue
            if lo == hi:  # one value holds the cut: go on with the tie hash
                n.cut, lo, hi = lo, 0, (1 << _TIE_BITS) - 1
            n.lo, n.hi = lo, hi
            still.append(n)
        open_ = still


def kd_tree(rows: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> _Node:
    """The tree over rows of a ``document_table``: every node cut at the weighted median of its widest
    dimension."""
    ends = [f(f"d{i}").alias(f"{n}{i}") for i in range(DIMS) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), *ends).first()
    n_shards = n_shards or max(1, round(whole["b"] / target_bytes))
    extent = [(whole[f"lo{i}"] or 0, whole[f"hi{i}"] or 0) for i in range(DIMS)]
    root = _Node(0, n_shards)
    level = [root]
    while level := [n for n in level if n.leaves > 1]:
        _measure(rows, root, level, extent)
        _narrow(rows, root, level, TOLERANCE * whole["b"] / n_shards)
        for n in level:
            half = n.leaves // 2
            n.children = (_Node(n.first, half), _Node(n.first + half, n.leaves - half))
        level = [m for n in level for m in n.children]
    return root


def assign_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row. Give the number of
    shards, or the bytes a leaf should reach. ``law`` is ``bytes``: shard sizes are near equal."""
    rows = written(document_table(docs), "kd-documents")
    root = kd_tree(rows, n_shards, target_bytes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = pa.array(_routed(root, _columns(batch.select([f"d{i}" for i in range(DIMS)] + ["tie"]))), pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "size", "text_crc32", "tie")], shard], ["doc_id", "size", "text_crc32", "tie", "shard"])

    return _slots(mapped(rows, place, "doc_id long, size long, text_crc32 long, tie long, shard int"))


def _slots(rows: DataFrame) -> DataFrame:
    """Gapless numbers inside each shard: shards are cut into ``2 ** _SUB_BITS`` ranges of the tie
    hash, numbered side by side, each from the count of the ranges before it."""
    rows = rows.withColumn("_sub", F.shiftright("tie", _TIE_BITS - _SUB_BITS))
    counts = rows.groupBy("shard", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_sub").orderBy("tie", "doc_id", "text_crc32")
    placed = rows.join(F.broadcast(starts), ["shard", "_sub"])  # shards times 256 rows
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int"),
        (F.row_number().over(inside) - 1 + F.col("_start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
