"""Several labellings held against a trusted one, at several least sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.operators import compare
from tempera.operators.compare import difference

LEVELS = (3, 15, 40)
PEAKS = (5, 10, 20, 50)  # least sizes of clusters whose peaks are drawn
EDGES = (2, 3, 6, 11, 31, 101)


def cut_minimum(level: int) -> int:
    """Large levels are taken a little lower."""
    return level - 4 if level > 10 else level


def comparison_report(trusted: DataFrame, methods: dict[str, DataFrame], levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """The difference of the trusted labelling to each method, by ``method`` and level ``lim``."""
    limits = tuple(map(cut_minimum, levels))
    parts = [difference(trusted, m, limits).withColumn("method", F.lit(name)) for name, m in methods.items()]
    return reduce(DataFrame.unionByName, parts)


def peak_report(points: DataFrame, labels: DataFrame, params: tuple[float, float], sizes: tuple[int, ...] = PEAKS, interval: tuple[float, float] = (0.05, 0.025), bins: tuple[int, int] = (100, 321)) -> DataFrame:
    """Histograms of the offsets inside clusters above each size: ``size, kind, bin, n`` for both dimensions
    alone (``0``, ``1``) and for the square radius (``r``). Offsets are made once."""
    widths = compare.cluster_widths(points, labels, params).select("cluster_id", F.col("n").alias("size_"))
    offsets = compare.offsets(points, labels, params, min(sizes)).join(widths, "cluster_id")
    rows = offsets.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).where(F.col("size_") > F.col("size"))
    radial = F.col("o0") * F.col("o0") + F.col("o1") * F.col("o1")
    at = lambda v, k: F.least(F.floor(v / interval[k]), F.lit(bins[k] - 1)).cast("int")
    kinds = [("0", at(F.abs(F.col("o0")), 0)), ("1", at(F.abs(F.col("o1")), 0)), ("r", at(radial, 1))]
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("bin")) for k, b in kinds])).alias("k")
    return rows.select("size", one).groupBy("size", "k.kind", "k.bin").agg(F.count("*").alias("n"))


def golden_report(points: DataFrame, trusted: DataFrame, methods: dict[str, DataFrame], params: tuple[float, float], levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """By method and level: the trusted clusters matched, their points, the share of these that the best
    match holds, and the mean offsets of the means."""
    parts = []
    for name, m in methods.items():
        found = compare.golden_match(points, trusted, m, params, min(map(cut_minimum, levels)))
        rows = found.withColumn("lim", F.explode(F.array(*[F.lit(cut_minimum(x)) for x in levels]))).where(F.col("n") > F.col("lim"))
        sums = rows.groupBy("lim").agg(F.count("*").alias("clusters"), F.sum("n").alias("points"), (F.sum("shared") / F.sum("n")).alias("share"), F.avg("shift0").alias("shift0"), F.avg("shift1").alias("shift1"))
        parts.append(sums.withColumn("method", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def full_comparison(points: DataFrame, trusted: DataFrame, methods: dict[str, DataFrame], params: tuple[float, float], sponge_factor: float) -> dict[str, DataFrame]:
    """All that a comparison of labellings reports, by name: the differences both ways, statistics and
    peaks of every labelling, and the agreement with the trusted one."""
    all_ = {"golden": trusted, **methods}
    named = lambda frames: reduce(DataFrame.unionByName, [f.withColumn("method", F.lit(k)) for k, f in frames.items()])
    back = {name: difference(m, trusted, tuple(map(cut_minimum, LEVELS))) for name, m in methods.items()}
    return {
        "differences": comparison_report(trusted, methods),
        "differences_back": named(back),
        "statistics": named({k: compare.labelling_statistics(points, m, params, EDGES, sponge_factor) for k, m in all_.items()}),
        "peaks": named({k: peak_report(points, m, params) for k, m in all_.items()}),
        "golden": golden_report(points, trusted, methods, params),
    }
