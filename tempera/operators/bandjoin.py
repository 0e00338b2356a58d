"""Joins on nearness: equality of bins, then the exact condition. A bare ``abs(a - b) <= e`` would
plan as a nested loop over all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, l_col: str, r_col: str, width: float, more: Column | None = None) -> DataFrame:
    """Pairs whose columns differ by at most ``width``: the right side is dealt to three bins."""
    size = max(width, 1e-300)
    a = left.withColumn("_bin", F.floor(F.col(l_col) / size))
    b = right.withColumn("_bin", F.explode(F.array(*[F.floor(F.col(r_col) / size) + k for k in (-1, 0, 1)])))
    near = F.abs(F.col(l_col) - F.col(r_col)) <= width
    return a.join(b, "_bin").where(near if more is None else near & more).drop("_bin")


def transfer_labels(points: DataFrame, labelled: DataFrame, tol0: float = 1e-6, tol1: float = 1e-5, offset: int = 0) -> DataFrame:
    """Points with the label of the one at the same place in another file, plus an offset; others
    keep 0."""
    other = labelled.select(F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), (F.col("label") + offset).alias("_label"))
    met = band_join(points, other, "x0", "_x0", tol0, F.abs(F.col("x1") - F.col("_x1")) <= tol1)
    found = met.groupBy("point_id").agg(F.min("_label").alias("label"))
    return points.join(found, "point_id", "left").fillna(0, ["label"])


def reachable(points: DataFrame, clusters: DataFrame, temperature: float, cut: float, bin_size: float) -> DataFrame:
    """Pairs of points and clusters near enough in the first dimension to matter at a temperature:
    each cluster is dealt to the bins of its reach."""
    reach = F.sqrt(2 * cut * temperature * F.col("s0"))
    bins = F.sequence(F.floor((F.col("y0") - reach) / bin_size), F.floor((F.col("y0") + reach) / bin_size))
    b = clusters.select("cluster_id", "y0", "s0", F.explode(bins).alias("_bin"))
    a = points.withColumn("_bin", F.floor(F.col("x0") / bin_size))
    near = (F.col("x0") - F.col("y0")) * (F.col("x0") - F.col("y0")) / F.col("s0") < 2 * cut * temperature
    return a.join(b, "_bin").where(near).drop("_bin", "y0", "s0")
