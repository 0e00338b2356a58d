"""Writers of the text formats, as DataFrames of lines: ``df.write.text(path)`` stores them."""

from __future__ import annotations

import decimal
import os
import platform
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempera.sources.text import CENTER_LABEL


#: The columns of the timing file.
TIMING_HEADER = "\t".join(
    "Duration(ms) HPDuration(us) Thread# MPIperNode Node# Pattern Parallelism Point#/Process Point#/Global maxNcent PTsplitting Ratio1 MPIReduce Ratio2 MPISRBasic Ratio3 MPISREigen Ratio4 MPIBdcast Ratio5 DataFileName CurrentTime ProcessorName".split()
)


def cluster_rows(assigned: DataFrame, clusters: DataFrame, n_points: int) -> DataFrame:
    """Points with their cluster, then centres (not the sponge) as rows of their own."""
    k = clusters.count()
    points = assigned.select(F.col("point_id").alias("row_id"), "x0", "x1", F.col("cluster_id").cast("long").alias("label"))
    own = clusters.where("not is_sponge").select((F.col("cluster_id") + n_points).cast("long").alias("row_id"), F.col("y0").alias("x0"), F.col("y1").alias("x1"), F.lit(max(CENTER_LABEL, k)).cast("long").alias("label"))
    return points.unionByName(own)


def cluster_lines(rows: DataFrame, extra: tuple[str, ...] = (), experiment: str | None = None) -> DataFrame:
    parts: list[Column] = [F.col("row_id").cast("string"), F.format_string("%.6f", "x0"), F.format_string("%.6f", "x1"), F.lit("0.0"), F.col("label").cast("string")]
    parts += [F.col(c).cast("string") for c in (*extra, *([experiment] if experiment else []))]
    return rows.select(F.concat_ws(" ", *parts).alias("value"))


def kmeans_lines(assigned: DataFrame, centers: DataFrame, n_points: int) -> DataFrame:
    """``row_id, value`` for points (point_id, x, cluster_id) and then centres (cluster_id, y) of any
    dimension: number, position (a zero after two places), cluster; a centre's is the label of centres."""
    k = centers.count()
    points = assigned.select(F.col("point_id").cast("long").alias("row_id"), "x", F.col("cluster_id").cast("long").alias("label"))
    rows = points.unionByName(centers.select((F.col("cluster_id") + n_points).cast("long").alias("row_id"), F.col("y").alias("x"), F.lit(max(CENTER_LABEL, k)).cast("long").alias("label")))
    place = F.array_join(F.transform("x", lambda v: F.format_string("%.6f", v)), " ")
    return rows.select("row_id", F.concat_ws(" ", F.col("row_id").cast("string"), place, F.when(F.size("x") == 2, "0.0"), F.col("label").cast("string")).alias("value"))


def scaled_rows(rows: DataFrame, method: int, params: tuple[float, float]) -> DataFrame:
    """Positions in units of the scales; the first as a logarithm where its scale is proportional."""
    first = F.when(F.col("x0") != 0, F.log("x0")).otherwise(F.col("x0")) if method >= 2 else F.col("x0")
    return rows.withColumns({"x0": first / params[0], "x1": F.col("x1") / params[1]})


def plot_lines(labels: DataFrame, positions: DataFrame) -> DataFrame:
    """``id x y z label`` for points with a place in three dimensions."""
    rows = positions.join(labels, "point_id")
    pos = F.array_join(F.transform("pos", lambda v: F.format_string("%.6f", v)), " ")
    return rows.select(F.concat_ws(" ", F.col("point_id").cast("string"), pos, F.col("cluster_id").cast("string")).alias("value"))


def shift_lines(shifts: DataFrame) -> DataFrame:
    """A tab-separated line for each experiment."""
    return shifts.select(F.concat_ws("\t", F.col("experiment").cast("string"), *[F.format_string("%.6f", c) for c in ("shift0", "sd0", "shift1", "sd1")]).alias("value"))


def thin_trace(trace: DataFrame, n: int, keep: int = 500) -> DataFrame:
    """About ``keep`` of n steps for a plot."""
    return trace.where(F.col("step") % max(1, n // keep) == 0)


class Stopwatch:
    """Named wall-clock totals of a run."""

    def __init__(self):
        self.totals: dict[str, float] = {}

    @contextmanager
    def of(self, name: str):
        began = time.perf_counter()
        try:
            yield
        finally:
            self.totals[name] = self.totals.get(name, 0.0) + time.perf_counter() - began

    def share(self, name: str) -> decimal.Decimal:
        """Part of the sum of all, rounded up to four places."""
        whole = sum(self.totals.values()) or 1.0
        return decimal.Decimal(self.totals[name] / whole).quantize(decimal.Decimal("0.0001"), decimal.ROUND_UP)

    def append_run(self, path: str, threads: int, nodes: int, points: int, clusters: int, data_file: str, part: str = "split") -> None:
        """A tab-separated line of the timing file with its fixed columns; the header only where the file is
        new. What message passing took has no equal here and is 0."""
        whole = sum(self.totals.values())
        share = self.share(part) if part in self.totals else 0
        cores, zero = threads * nodes, (0, 0.0)
        row = (round(whole * 1000), round(whole * 1e6), threads, 1, nodes, f"{threads}x1x{nodes}", cores, -(-points // max(1, cores)), points, clusters, round(self.totals.get(part, 0.0) * 1e6), float(share), *zero * 4, data_file, time.strftime("%Y-%m-%d %H:%M:%S"), platform.node())
        new = not os.path.exists(path)
        with open(path, "a", encoding="utf-8") as f:
            f.write((TIMING_HEADER if new else "") + "\n" + "\t".join(map(str, row)))

    def append_to(self, path: str) -> None:
        """A tab-separated line; the header only where the file is new."""
        new = not os.path.exists(path)
        with open(path, "a", encoding="utf-8") as f:
            if new:
                f.write("\t".join(self.totals) + "\n")
            f.write("\t".join(f"{v:.6f}" for v in self.totals.values()) + "\n")


def append_summary(path: str, lines: list[str]) -> None:
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(f"{x}\n" for x in lines)
