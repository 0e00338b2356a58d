"""Comparing labellings: statistics of one, overlap of two, agreement with trusted clusters.

A labelling is a DataFrame of ``point_id, cluster_id`` (-1: none); points have ``x0, x1``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempera.operators.numbering import numbered
from tempera.sources.scratch import Written

#: Tables of clusters of at most so many bytes are broadcast.
BROADCAST_BYTES = 16 << 20


def relabel_sponge(labels: DataFrame, sponge_id: int, n_clusters: int) -> DataFrame:
    """Points of the sponge as clusters of their own, numbered on from ``n_clusters`` in the order of
    the points."""
    alone = numbered(labels.where(F.col("cluster_id") == sponge_id).select("point_id"), "point_id")
    alone = alone.select("point_id", (F.lit(n_clusters) + F.col("idx")).alias("cluster_id"))
    return labels.where(F.col("cluster_id") != sponge_id).select("point_id", F.col("cluster_id").cast("long")).unionByName(alone)


def size_histogram(labels: DataFrame, edges: tuple[int, ...]) -> DataFrame:
    """Clusters and points by category of size: 0 below the first edge, and so on."""
    sizes = labels.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n"))
    category = sum((F.when(F.col("n") >= e, 1).otherwise(0) for e in edges), F.lit(0))
    return sizes.groupBy(category.cast("int").alias("category")).agg(F.count("*").alias("clusters"), F.sum("n").alias("points"))


def cluster_widths(points: DataFrame, labels: DataFrame, params: tuple[float, float]) -> DataFrame:
    """Size, mean and scaled square widths of each cluster, from sums of one pass: the first
    dimension's scale follows its mean."""
    rows = points.join(labels.where("cluster_id >= 0"), "point_id")
    means = rows.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("x0").alias("m0"), F.avg("x1").alias("m1"), F.var_pop("x0").alias("v0"), F.var_pop("x1").alias("v1"))
    s0 = params[0] * F.col("m0")
    return means.select("cluster_id", "n", "m0", "m1", (F.col("v0") * F.col("n") / (s0 * s0)).alias("width0"), (F.col("v1") * F.col("n") / (params[1] * params[1])).alias("width1"))


def labelling_statistics(points: DataFrame, labels: DataFrame, params: tuple[float, float], edges: tuple[int, ...], sponge_factor: float) -> DataFrame:
    """By category of size: clusters, points, mean widths, and the cost, half the square widths;
    a single point costs half the square of the sponge factor."""
    w = cluster_widths(points, labels, params)
    category = sum((F.when(F.col("n") >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    cost = F.when(F.col("n") == 1, 0.5 * sponge_factor**2).otherwise(0.5 * (F.col("width0") + F.col("width1")))
    return w.groupBy(category.alias("category")).agg(
        F.count("*").alias("clusters"), F.sum("n").alias("points"), (F.sum("width0") / F.sum("n")).alias("width0"), (F.sum("width1") / F.sum("n")).alias("width1"), F.sum(cost).alias("cost")
    )


def overlaps(base: DataFrame, target: DataFrame) -> DataFrame:
    """Points that each pair of clusters shares; points without a target cluster don't count."""
    b = base.where("cluster_id >= 0").select("point_id", F.col("cluster_id").alias("base"))
    t = target.where("cluster_id >= 0").select("point_id", F.col("cluster_id").alias("target"))
    return b.join(t, "point_id").groupBy("base", "target").agg(F.count("*").alias("n"))


def best_overlap(base: DataFrame, target: DataFrame) -> DataFrame:
    """The target cluster that shares most with each base cluster (of equals the least id)."""
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("target").alias("target")))
    return overlaps(base, target).groupBy("base").agg(best.alias("b")).select("base", F.col("b.target").alias("target"), (-F.col("b.k")).alias("n"))


def difference(base: DataFrame, target: DataFrame, limits: tuple[int, ...] = (0, 2, 5, 10, 20, 50)) -> DataFrame:
    """For base clusters above each limit of size: how many there are, their points, how many of
    these lie in the best matching target, and target clusters that match best for some base
    cluster (major) or only share points (stray, single or larger)."""
    sizes = base.where("cluster_id >= 0").groupBy(F.col("cluster_id").alias("base")).agg(F.count("*").alias("base_n"))
    target_sizes = target.where("cluster_id >= 0").groupBy(F.col("cluster_id").alias("target")).agg(F.count("*").alias("target_n"))
    pairs = overlaps(base, target)
    ranked = pairs.withColumn("rk", F.row_number().over(Window.partitionBy("base").orderBy(F.desc("n"), "target"))).join(sizes, "base")
    by_limit = ranked.withColumn("lim", F.explode(F.array(*map(F.lit, limits)))).where(F.col("base_n") > F.col("lim"))
    bases = by_limit.groupBy("lim").agg(F.count_if(F.col("rk") == 1).alias("base_clusters"), F.sum("n").alias("base_points"), F.sum(F.when(F.col("rk") == 1, F.col("n"))).alias("points_in_major"))
    kinds = by_limit.groupBy("lim", "target").agg(F.min("rk").alias("rk")).join(target_sizes, "target")
    targets = kinds.groupBy("lim").agg(
        F.count_if(F.col("rk") == 1).alias("major"), F.count_if((F.col("rk") > 1) & (F.col("target_n") == 1)).alias("stray_single"), F.count_if((F.col("rk") > 1) & (F.col("target_n") > 1)).alias("stray")
    )
    return bases.join(targets, "lim")


def offsets(points: DataFrame, labels: DataFrame, params: tuple[float, float], min_size: int) -> DataFrame:
    """Scaled offsets of points from the mean of their cluster, in clusters above a size."""
    w = cluster_widths(points, labels, params).where(F.col("n") > min_size).select("cluster_id", "m0", "m1")
    rows = points.join(labels.where("cluster_id >= 0"), "point_id").join(w, "cluster_id")
    return rows.select("point_id", "cluster_id", ((F.col("x0") - F.col("m0")) / (params[0] * F.col("m0"))).alias("o0"), ((F.col("x1") - F.col("m1")) / params[1]).alias("o1"))


def peak_histogram_1d(offset: DataFrame, column: str, interval: float, bins: int) -> DataFrame:
    at = F.least(F.floor(F.abs(F.col(column)) / interval), F.lit(bins - 1)).cast("int")
    return offset.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def peak_histogram_2d(offset: DataFrame, interval: float, bins: int) -> DataFrame:
    radial = F.col("o0") * F.col("o0") + F.col("o1") * F.col("o1")
    return offset.groupBy(F.least(F.floor(radial / interval), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def trim_histogram(hist: DataFrame) -> DataFrame:
    """A histogram without empty bins at its end; of nothing, the first bin."""
    last = hist.agg(F.coalesce(F.max(F.when(F.col("n") > 0, F.col("bin"))), F.lit(0)).alias("_last"))
    return hist.crossJoin(F.broadcast(last)).where(F.col("bin") <= F.col("_last")).drop("_last")


def trimmed_centers(points: DataFrame, labels: DataFrame, params: tuple[float, float], cut: float = 0.7, rounds: int = 10, min_size: int = 3, mode: int = 0) -> DataFrame:
    """Means of clusters above a size, each over its points within the cut (mode 0: square, scaled and
    radial; mode 1: scaled, in every dimension by itself) of the mean before; a cluster that would lose all its points keeps its mean. ``n_in`` counts the
    points within the cut of the last. The labelled points are written once; a round reads them and the centres of the round before,
    which are broadcast up to ``BROADCAST_BYTES``, aggregates with a combine on the map side, and writes its centres, so its plan
    is as small in the last round as in the first, and no cluster is gathered in a task."""
    rows = points.join(labels.where("cluster_id >= 0"), "point_id").select("cluster_id", "x0", "x1")
    rows = Written(rows)
    try:
        centers = Written(rows.df.groupBy("cluster_id").agg(F.count("*").alias("n"), F.avg("x0").alias("c0"), F.avg("x1").alias("c1")).where(F.col("n") > min_size).withColumn("n_in", F.lit(0).cast("long")))
        small = centers.df.count() * 40 <= BROADCAST_BYTES
        for _ in range(rounds):
            d0, d1 = (F.col("x0") - F.col("c0")) / (params[0] * F.col("c0")), (F.col("x1") - F.col("c1")) / params[1]
            inside = d0 * d0 + d1 * d1 <= cut if mode == 0 else (F.abs(d0) <= cut) & (F.abs(d1) <= cut)
            own = centers.df.drop("n_in")
            seen = rows.df.join(F.broadcast(own) if small else own, "cluster_id").withColumn("_in", inside)
            mean = lambda x, c: F.coalesce(F.avg(F.when(F.col("_in"), F.col(x))), F.max(c)).alias(c)
            after = Written(seen.groupBy("cluster_id", "n").agg(mean("x0", "c0"), mean("x1", "c1"), F.count_if("_in").alias("n_in")))
            centers.drop()
            centers = after
    finally:
        rows.drop()
    return centers.df.select("cluster_id", "n", "c0", "c1", "n_in")


def golden_match(points: DataFrame, golden: DataFrame, method: DataFrame, params: tuple[float, float], min_size: int = 3) -> DataFrame:
    """For each trusted cluster above a size: the best matching cluster of a method, the points they
    share, those outside, and the offset of their means."""
    trusted = cluster_widths(points, golden, params).where(F.col("n") > min_size)
    theirs = cluster_widths(points, method, params).select(F.col("cluster_id").alias("target"), F.col("n").alias("target_n"), F.col("m0").alias("t0"), F.col("m1").alias("t1"))
    best = best_overlap(golden, method).withColumnRenamed("n", "shared")
    rows = trusted.join(best, trusted["cluster_id"] == best["base"]).join(theirs, "target")
    return rows.select(
        F.col("cluster_id").alias("golden"), "n", "target", "shared", (F.col("n") - F.col("shared")).alias("outside"), (F.col("target_n") - F.col("shared")).alias("strangers"),
        ((F.col("t0") - F.col("m0")) / (params[0] * F.col("m0"))).alias("shift0"), ((F.col("t1") - F.col("m1")) / params[1]).alias("shift1"),
    )


def solution_histograms(clusters: DataFrame, bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Histograms of occupation and of distances between centres (each pair once, itself too), over
    their own ranges."""
    from tempera.functions.exprs import bin_with_overflow

    c = clusters.where("not is_sponge")

    def over(rows: DataFrame, v: str) -> DataFrame:
        ends = rows.agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
        return rows.crossJoin(F.broadcast(ends)).groupBy(bin_with_overflow(F.col(v), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count("*").alias("n"))

    return over(c.select(F.col("occupation").cast("double").alias("v")), "v"), distance_counts(c, bins)


#: Clusters that a task meets with as many others at once.
BLOCK = 2048


def distance_counts(clusters: DataFrame, bins: int) -> DataFrame:
    """``bin, n`` of all distances between centres by the scales of the one with the lesser id. Clusters are packed into blocks by
    their order; a block meets those after it and itself. No pair leaves a task: a first pass finds the ends, a second counts."""
    spark = clusters.sparkSession
    rows = numbered(clusters.select(F.col("cluster_id").cast("long").alias("id"), "y0", "y1", "s0", "s1"), "id")
    blocks = rows.groupBy(F.expr(f"idx div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "y0", "y1", "s0", "s1"))).alias("c"))
    blocks = Written(blocks)  # at most BLOCK clusters a row
    n = blocks.df.count()
    mine = blocks.df.select(F.col("block").alias("a"), F.col("c").alias("ca"), F.explode(F.sequence(F.col("block"), F.lit(n - 1).cast("long"))).alias("b"))
    pairs = mine.join(blocks.df.select(F.col("block").alias("b"), F.col("c").alias("cb")), "b").select("a", "b", "ca", "cb")

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for a, b, ca, cb in zip(*(batch.column(c) for c in ("a", "b", "ca", "cb")), strict=True):
                v, w = (np.stack([c.values.field(f).to_numpy() for f in ("y0", "y1", "s0", "s1")], 1) for c in (ca, cb))
                for low in range(0, len(v), 256):
                    part = v[low : low + 256]
                    d = np.sqrt((part[:, None, 0] - w[None, :, 0]) ** 2 / part[:, None, 2] + (part[:, None, 1] - w[None, :, 1]) ** 2 / part[:, None, 3])
                    yield d[np.arange(len(w))[None] >= np.arange(low, low + len(part))[:, None]] if a.as_py() == b.as_py() else d.ravel()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in distances(batches):
            yield pa.RecordBatch.from_arrays([pa.array([d.min()]), pa.array([d.max()])], ["lo", "hi"])

    found = pairs.mapInArrow(ends, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first()
    if found[0] is None:
        blocks.drop()
        return spark.createDataFrame([], "bin int, n long")
    lo, hi = (float(v) for v in found)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In the bins of ``exprs.bin_with_overflow``; all in the first if there is one distance only."""
        n = np.zeros(bins + 1, np.int64)
        for d in distances(batches):
            n += np.bincount(np.minimum(np.floor((d - lo) * bins / (hi - lo)), bins - 1).astype(int) + 1 if hi > lo else np.ones(len(d), int), minlength=bins + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bins + 1), pa.int32()), pa.array(n)], ["bin", "n"])

    return pairs.mapInArrow(counted, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).where("n > 0")
