"""The reductions of the cluster programs, as aggregate columns and small DataFrame helpers. All
combine on the map side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def or_(c: Column) -> Column:
    return F.coalesce(F.bool_or(c), F.lit(False))


def sum_(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def max_from_zero(c: Column) -> Column:
    """The maximum, at least 0."""
    return F.greatest(F.coalesce(F.max(c), F.lit(0.0)), F.lit(0.0))


def max_from_far_below(c: Column) -> Column:
    return F.greatest(F.coalesce(F.max(c), F.lit(-1e10)), F.lit(-1e10))


def mean(c: Column) -> Column:
    """The mean; 0 of nothing."""
    return F.coalesce(F.avg(c), F.lit(0.0))


def sigma(c: Column) -> Column:
    return F.coalesce(F.stddev_pop(c), F.lit(0.0))


def counts_by_bin(df: DataFrame, bin_: Column, n: int) -> DataFrame:
    """Rows by bin from 0 to n - 1; what lies outside is dropped."""
    return df.select(bin_.cast("int").alias("bin")).where(F.col("bin").between(0, n - 1)).groupBy("bin").agg(F.count("*").alias("n"))


def vector_sum(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Sums by place of an array column: rows of keys, ``i`` and ``total``."""
    return df.select(*keys, F.posexplode(vector).alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("total"))


def vector_mean(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("i", "v")).groupBy(*keys, "i").agg(F.avg("v").alias("mean"))


def scatter_sum(df: DataFrame, entries: str, *values: str) -> DataFrame:
    """Sums by ``cluster_id`` of an array of structs: a row gives to several groups."""
    rows = df.select(F.explode(entries).alias("_e"))
    return rows.groupBy(F.col("_e.cluster_id").alias("cluster_id")).agg(*[F.sum(f"_e.{v}").alias(v) for v in values])


def least_with_index(value: str, index: str) -> Column:
    """The least value and the least index that has it."""
    return F.min(F.struct(F.col(value).alias("value"), F.col(index).alias("index")))


def greatest_with_index(value: str, index: str) -> Column:
    """The greatest value and the least index that has it."""
    best = F.min(F.struct((-F.col(value)).alias("value"), F.col(index).alias("index")))
    return F.struct((-best["value"]).alias("value"), best["index"].alias("index"))


def k_least(df: DataFrame, value: str, index: str, k: int) -> DataFrame:
    return df.orderBy(value, index).limit(k)


def k_least_by_group(df: DataFrame, group: str, value: str, index: str, k: int) -> DataFrame:
    """The k least of each group with ``rank`` from 1; window limits prune before the shuffle."""
    order = Window.partitionBy(group).orderBy(value, index)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def k_least_and_rest(df: DataFrame, group: str, value: str, index: str, k: int) -> DataFrame:
    """By group: the k least values in order, and the least of the others (null: there is none)."""
    order = Window.partitionBy(group).orderBy(value, index)
    ranked = df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    kept = F.sort_array(F.collect_list(F.when(F.col("rank") <= k, F.col(value))))
    return ranked.groupBy(group).agg(kept.alias("least"), F.min(F.when(F.col("rank") > k, F.col(value))).alias("rest"))


def dense_clusters(labels: DataFrame, cluster: str = "cluster_id", trusted: str = "golden") -> DataFrame:
    """Clusters of a labelling with their size, their points that have a trusted label, and a dense
    index in the order of the ids."""
    sizes = labels.where(F.col(cluster) >= 0).groupBy(cluster).agg(F.count("*").alias("n"), F.count_if(F.col(trusted) >= 0).alias("n_golden"))
    return sizes.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(cluster)) - 1)
