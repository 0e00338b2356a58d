"""Gapless numbers for rows, in the order of an id, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, id_: str, name: str = "idx") -> DataFrame:
    """``rows`` with ``name`` from 0 in the order of ``id_`` (a long without repeats). Ids are numbered inside ranges of 2 ** 16,
    these from the counts before them inside spans of 2 ** 30 ids, and the spans among themselves."""
    ranged = rows.withColumn("_range", F.shiftright(F.col(id_).cast("long"), 16))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_span", F.shiftright("_range", 14))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = counts.groupBy("_span").agg(F.sum("_n").alias("_n")).select("_span", before(Window.partitionBy(F.lit(1)).orderBy("_span")).alias("_first"))  # a row for 2 ** 30 ids
    ranges = counts.withColumn("_start", before(Window.partitionBy("_span").orderBy("_range"))).join(spans, "_span")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(id_)) - 1
    out = ranged.join(ranges.select("_range", (F.col("_start") + F.col("_first")).alias("_start")), "_range")
    return out.withColumn(name, (F.col("_start") + place).cast("long")).drop("_range", "_start")
