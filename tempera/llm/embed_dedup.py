"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosine, components.

Components are doubles throughout. Equal vectors, told by 128-bit digests, are one class first, so copies cost nothing and only digests
go back to the rows. Classes are dealt to buckets by the signs
of their products with random hyperplanes, in enough tables to find a pair at the threshold with
``RECALL``. Inside a bucket all cosines are computed exactly, block by block; a pair counts in the
first table whose buckets it shares only, so links are counted once and no pairs are emitted: a
bucket returns counts and one edge a vector to the least vector of its local component. Buckets
above ``BLOCK`` vectors are split into pairs of blocks, which together still compare everything.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component links with
nothing, nor does a null vec_id, which is kept; vectors of different lengths never link; repeated rows
are vectors of their own; an empty table gives no rows; other columns, labels too, are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.llm.common import joined, mapped, written
from tempera.llm.components import connected_components

COSINE = 0.9
RECALL = 0.995  # of a pair right at the threshold
BUCKET = 500  # mean classes a bucket
BLOCK = 2048
_SEED = 20240229


def plan_tables(n: int, cosine: float, recall: float) -> tuple[int, int]:
    """Bits a table and tables for n classes: buckets of about ``BUCKET`` classes if signs were
    fair coins, and as many tables as the recall asks for."""
    bits = max(2, round(math.log2(max(1, n) / BUCKET)))
    together = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - together)))


def _codes(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    planes = np.random.default_rng([_SEED, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2).astype(np.int32)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of length one, in double precision; scaled by their greatest component first, as squares may not fit."""
    x = np.array([np.frombuffer(v, np.float64) for v in column.to_pylist()])
    return _unit(x)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """``rep, copies, dim, vector`` (binary) and ``codes`` of each class."""

    def run(batches):
        for batch in batches:
            vectors = [np.array(v, np.float64) for v in batch.column("vector").to_pylist()]
            if len({len(v) for v in vectors}) > 1:
                codes = [_codes(_unit(v[None]), bits, tables)[0] for v in vectors]
            else:
                codes = _codes(_unit(np.array(vectors)), bits, tables) if vectors else []
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("copies"), pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary()), pa.array([c for c in codes], pa.list_(pa.int32()))],
                ["rep", "copies", "dim", "vector", "codes"],
            )

    return mapped(classes, run, "rep long, copies long, dim int, vector binary, codes array<int>")


def _compare(cosine: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        t, left, right = key[1].as_py(), key[3].as_py(), key[4].as_py()
        rep, copies = (rows.column(c).to_numpy() for c in ("rep", "copies"))
        x = _matrix(rows.column("vector"))
        codes = np.array(rows.column("codes").to_pylist(), np.int32).reshape(len(rep), t)  # of the tables before this one
        block = rows.column("block").to_numpy()
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        links, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        pairs = []
        for k in range(0, len(a), 256):
            part = a[k : k + 256]
            i, j = np.nonzero(x[part] @ x[b].T >= cosine)
            i, j = part[i], b[j]
            if left == right:
                i, j = i[i < j], j[i < j]
            first = ~(codes[i] == codes[j]).any(1)
            i, j = i[first], j[first]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            pairs.append((i, j))
        i, j = map(np.concatenate, zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
        order = np.argsort(np.argsort(rep, kind="stable"), kind="stable")  # the least rep is the root
        label = order.copy()
        while len(i):
            low = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            if (before == label).all():
                break
        root = np.sort(rep, kind="stable")[label]
        some = (links > 0) | (root != rep)
        return pa.table({"rep": pa.array(rep[some]), "links": pa.array(links[some]), "root": pa.array(root[some])})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.coalesce(F.forall("vector", finite) & F.exists("vector", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(usable & F.col("vec_id").isNotNull(), F.col("vector")))
    digest = lambda k, other: F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(k), "vector")).otherwise(other)
    rows = rows.select("vec_id", "vector", F.col("vector").isNotNull().alias("usable"), digest(1, F.col("vec_id")).alias("d1"), digest(2, F.lit(0)).alias("d2"))
    classes = rows.where("usable").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = written(classes, "vector-classes")
    bits, tables = plan_tables(classes.count(), cosine, recall)
    hashed = written(_hashed(classes, bits, tables), "vector-codes")
    places = hashed.select("dim", F.posexplode("codes").alias("t", "code"))
    big = places.groupBy("dim", "t", "code").count().where(F.col("count") > BLOCK)
    blocks = written(big.select("dim", "t", "code", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "vector-blocks")
    dealt = hashed.select("rep", "copies", "dim", "vector", "codes", F.posexplode("codes").alias("t", "code")).withColumn("codes", F.slice("codes", F.lit(1), F.col("t")))
    dealt = joined(dealt, blocks, ["dim", "t", "code"], "left", 24).fillna(1, ["blocks"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other"))
    found = dealt.groupBy("dim", "t", "code", "left", "right").applyInArrow(_compare(cosine), "rep long, links long, root long")
    found = written(found, "vector-links")
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.select("d1", "d2", "rep", "copies").join(links, "rep", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("d1", "d2", F.lit(True).alias("usable"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("vector").join(of_class, ["d1", "d2", "usable"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
