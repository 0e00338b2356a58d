"""Readers for the text formats: a record a line, blank lines skipped, fields split at single tabs or
spaces (commas too in vector files). Any other DataFrame with the same columns will do as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.functions.exprs import to_label

CENTER_LABEL = 100_000_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def fields(rows: DataFrame, pattern: str = "[\t ]") -> DataFrame:
    return rows.select(F.split("line", pattern).alias("f"))


def _double(i: int) -> Column:
    return F.get("f", F.lit(i)).try_cast("double")


def peaks(rows: DataFrame, kind: int = 0, d: int = 2) -> DataFrame:
    """Points of a raw file (0) or an own output file (1): ``point_id, x0.., label, experiment``.
    Lines whose numbers don't parse are headers."""
    label, experiment = (1 + d, 8) if kind == 0 else (4, None)
    f = fields(rows)
    last = F.element_at("f", -1).try_cast("int")
    out = f.select(
        F.get("f", F.lit(0)).try_cast("long").alias("point_id"),
        *[_double(1 + i).alias(f"x{i}") for i in range(d)],
        F.get("f", F.lit(label)).try_cast("int").alias("label"),
        F.coalesce(F.get("f", F.lit(experiment)).try_cast("int") if experiment else F.when(F.size("f") > 5, last), F.lit(0)).alias("experiment"),
    )
    return out.where(" and ".join(f"{c} is not null" for c in ("point_id", *[f"x{i}" for i in range(d)], "label")))


def select_label(points: DataFrame, selected: int) -> DataFrame:
    """Rows of one label, or without one (negative)."""
    return points.where(F.col("label") == selected) if selected >= 0 else points.where(F.col("label") != -selected)


def centers(points: DataFrame) -> DataFrame:
    return points.where(F.col("label") == CENTER_LABEL)


def census(points: DataFrame, bins: int = 200) -> DataFrame:
    """Rows by label: bin 0 takes negative labels, the last all that are too large."""
    return points.groupBy(F.greatest(F.lit(0), F.least(F.lit(bins - 1), 1 + F.col("label"))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def vectors(rows: DataFrame, d: int, start: int = 1, label: int | None = None) -> DataFrame:
    """``x`` (array) from column ``start`` on, and the label less 1 (1 without one)."""
    f = fields(rows, "[\t ,]")
    x = F.transform(F.slice("f", start + 1, d), lambda v: v.try_cast("double"))
    found = F.get("f", F.lit(label)).try_cast("int") - 1 if label is not None else F.lit(None).cast("int")
    out = f.select(x.alias("x"), F.coalesce(found, F.lit(1)).alias("label"))
    return out.where((F.size("x") == d) & F.forall("x", lambda v: v.isNotNull()))


def plot3d(rows: DataFrame, k: int = 3) -> DataFrame:
    f = fields(rows, "[\t ,]")
    pos = F.transform(F.slice("f", 2, k), lambda v: v.try_cast("double"))
    return f.select(F.get("f", F.lit(0)).try_cast("long").alias("point_id"), pos.alias("pos")).where((F.size("pos") == k) & F.forall("pos", lambda v: v.isNotNull()) & F.col("point_id").isNotNull())


def comparison_labels(rows: DataFrame) -> DataFrame:
    """``point_id, golden, golden_label, mclust, medea, experiment``; what isn't a number is -1."""
    at = lambda i: F.coalesce(to_label(F.get("f", F.lit(i))), F.lit(-1))
    out = fields(rows).select(F.get("f", F.lit(0)).try_cast("long").alias("point_id"), at(5).alias("golden"), F.get("f", F.lit(4)).alias("golden_label"), at(6).alias("mclust"), at(7).alias("medea"), at(8).alias("experiment"))
    return out.where("point_id is not null")


def replicate(points: DataFrame, times: int) -> DataFrame:
    """Every point so many times, for scaling tests; a new ``copy`` tells them apart."""
    return points.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def restart_state(points: DataFrame, centers_: DataFrame) -> DataFrame:
    """Clusters from a former output: positions of the centres, sizes from the labels, label 0 as the
    sponge; ``p`` is the share of the points."""
    sizes = points.where(F.col("label") != CENTER_LABEL).groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").cast("double").alias("c"))
    n = sizes.agg(F.sum("c").alias("_n"))
    out = centers_.select("cluster_id", "y0", "y1").join(sizes, "cluster_id", "full").fillna(0.0, ["c"])
    return out.crossJoin(F.broadcast(n)).select("cluster_id", (F.col("cluster_id") == 0).alias("is_sponge"), "y0", "y1", "c", (F.col("c") / F.col("_n")).alias("p"))
