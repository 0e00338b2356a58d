"""Scoring a stream of points against clusters that no longer change: stateless, so it needs neither
watermark nor state, and the same code serves batches."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tempera.operators.em import e_step, hard_assignment


def score_stream(points: DataFrame, clusters: DataFrame, temperature: float, sponge_factor: float | None = None) -> DataFrame:
    """Points with the cluster of their greatest membership; ``clusters`` is a small batch table and
    is fixed as literals, so the stream's plan joins nothing."""
    rows = clusters.collect()
    spark = points.sparkSession
    return hard_assignment(e_step(points, spark.createDataFrame(rows, clusters.schema), temperature, sponge_factor))
