"""The engine's inputs as views over the star schema: events are points in two dimensions with three
labellings, embeddings are long vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.functions.exprs import sigma2

PARAMS = (50.0, 300.0)  # scales of the two dimensions
RELATIVE = (0.1, 300.0)  # the first in proportion to the centre
TEMPERATURE, SPONGE = 1.0, 1.5
SPONGE_ID = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return e.select(
        F.col("event_id").alias("point_id"),
        (F.lit(500.0) + F.col("value")).alias("x0"),
        ((F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")) / F.lit(60.0)).alias("x1"),
        F.array_position(kinds, F.col("event_type")).cast("int").alias("charge"),
        (F.col("user_id") % 37 + 1).cast("int").alias("experiment"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.col("user_id") % 50).cast("int").alias("mclust"),
        F.floor(F.col("value") / 10).cast("int").alias("medea"),
    )


def labelling(points: DataFrame, method: str) -> DataFrame:
    label = F.when(F.col("k") < 20, F.col("k")).otherwise(-1) if method == "golden" else F.col(method)
    return points.select("point_id", label.alias("cluster_id"))


def centers5(points: DataFrame, sponge: bool = False, method: int = 1) -> DataFrame:
    """A cluster for each charge at the mean of its points; the sponge, if asked for, gets a tenth of
    the weight."""
    means = points.groupBy(F.col("charge").alias("cluster_id")).agg(F.avg("x0").alias("y0"), F.avg("x1").alias("y1"), F.count("*").alias("occupation"))
    n = points.agg(F.count("*").alias("_n"))
    s = sigma2([F.col("y0"), F.col("y1")], method, PARAMS if method < 2 else RELATIVE)
    share = F.col("occupation") / F.col("_n")
    own = means.crossJoin(F.broadcast(n)).select("cluster_id", F.lit(False).alias("is_sponge"), "y0", "y1", s[0].alias("s0"), s[1].alias("s1"), (share * 0.9 if sponge else share).alias("p"), "occupation")
    if not sponge:
        return own
    row = points.sparkSession.range(1).select(F.lit(SPONGE_ID).alias("cluster_id"), F.lit(True).alias("is_sponge"), *[F.lit(v).alias(c) for c, v in (("y0", 0.0), ("y1", 0.0), ("s0", 1.0), ("s1", 1.0), ("p", 0.1))], F.lit(0).cast("long").alias("occupation"))
    return own.unionByName(row)


def centers40(points: DataFrame) -> DataFrame:
    """More clusters: a mean for each value of medea."""
    means = points.groupBy(F.col("medea").alias("cluster_id")).agg(F.avg("x0").alias("y0"), F.avg("x1").alias("y1"), F.count("*").alias("occupation"))
    return means.select("cluster_id", F.lit(False).alias("is_sponge"), "y0", "y1", F.lit(PARAMS[0] ** 2).alias("s0"), F.lit(PARAMS[1] ** 2).alias("s1"), F.lit(0.02).alias("p"), "occupation")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").cast("array<double>").alias("x"), "label")
