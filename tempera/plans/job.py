"""A whole run from a configuration: scan, cluster, write, and compare, all as Spark jobs."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempera.operators import kmeans, quality
from tempera.operators.numbering import numbered
from tempera.plans import anneal as A
from tempera.plans.comparison import full_comparison
from tempera.plans.presets import preset
from tempera.sources import text, writers
from tempera.sources.config import Config, command_line


@dataclass
class Outputs:
    """What a run made. ``reports`` has the tables of a comparison, ``None`` without one."""

    config: Config
    result: A.Result
    labels: DataFrame  # point_id, cluster_id
    reports: dict[str, DataFrame] | None


def read_points(spark: SparkSession, config: Config) -> DataFrame:
    """``point_id, x0, x1, label, experiment, x`` of the points that the configuration selects, with copies
    if it asks for them (``copy``)."""
    rows = text.lines(spark, config.LabelFile)
    points = text.peaks(rows, config.InputFileType).where(F.col("label") != text.CENTER_LABEL)
    selected = config.SelectedInputLabel
    if config.RestartTemperature >= 0 and config.RestartSelectedInputLabel != Config.RestartSelectedInputLabel:
        selected = config.RestartSelectedInputLabel
    if config.InputFileType == 0 or selected >= 0:
        points = text.select_label(points, selected)
    if config.Replicate > 1:
        points = text.replicate(points, config.Replicate)
    return points.withColumn("x", F.array("x0", "x1"))


def cluster_table(spark: SparkSession, result: A.Result, labels: DataFrame) -> DataFrame:
    """The clusters of a result as the relational operators take them, with their points counted."""
    c, s2 = result.clusters, result.schedule.sigma2(result.clusters.y)
    shift = 0 if c.sponge else 1  # number 0 is the sponge's
    rows = [(k + shift, bool(c.sponge and k == 0), *map(float, (*c.y[k], *s2[k], c.p[k]))) for k in range(len(c))]
    table = spark.createDataFrame(rows, "cluster_id long, is_sponge boolean, y0 double, y1 double, s0 double, s1 double, p double")
    counts = labels.groupBy("cluster_id").agg(F.count("*").alias("occupation"))
    return table.join(counts, "cluster_id", "left").fillna(0, ["occupation"])


def restart_rows(spark: SparkSession, config: Config) -> list:
    """The clusters of a former run's file: as many rows as it had clusters. Where the points come from such a file too
    (``InputFileType`` 1), its centres follow, numbered on, with the shares of their points."""
    state = _former(spark, config.RestartClusterFile)
    if config.InputFileType == 1 and config.LabelFile and config.LabelFile != config.RestartClusterFile:
        last = max((r["cluster_id"] for r in state), default=0)
        more = [r for r in _former(spark, config.LabelFile) if not r["is_sponge"] and r["y0"] is not None]
        state += [r | {"cluster_id": last + k} for k, r in enumerate(more, 1)]
        size = sum(r["c"] for r in state)
        state = [r | {"p": r["c"] / size if size else 1.0 / len(state)} for r in state]
    return state


def _former(spark: SparkSession, path: str) -> list[dict]:
    points = text.peaks(text.lines(spark, path), 1)
    first = points.where(F.col("label") != text.CENTER_LABEL).agg(F.count("*")).first()[0]
    numbered_ = text.centers(points).select((F.col("point_id") - first).alias("cluster_id"), F.col("x0").alias("y0"), F.col("x1").alias("y1"))
    return [r.asDict() for r in text.restart_state(points, numbered_).collect()]


def run(spark: SparkSession, config: Config, out_dir: str | None = None, **limits) -> Outputs:
    """Cluster as the mode of the configuration says, and write below ``out_dir``: ``clusters`` and
    ``clusters-scaled`` (unless ``ClusterCountOutput`` is negative; at 1 with the clusters at every count), ``status``, ``shifts`` (lines of
    text), the histograms ``occupations`` and ``distances`` and the comparison's tables as Parquet. ``limits`` go to ``anneal``. A restart temperature of zero or more goes on from ``RestartClusterFile``; without
    iterations at the end the former clusters are only analysed."""
    config = preset(config)
    watch = writers.Stopwatch()
    with watch.of("read"):
        points = read_points(spark, config).persist()
        n = points.count()
    with watch.of("cluster"):
        restart = restart_rows(spark, config) if config.RestartTemperature >= 0 else None
        result = A.anneal(points, config, restart=restart, **limits)
    labels = A.labels(points, result.clusters, result.schedule)
    if not result.clusters.sponge:
        labels = labels.withColumn("cluster_id", F.col("cluster_id") + 1)
    labels = labels.persist()
    clusters = cluster_table(spark, result, labels).persist()
    assigned = points.join(labels, "point_id") if config.Replicate <= 1 else points.join(labels.distinct(), "point_id")
    sponge_id, cut = (0 if result.clusters.sponge else None), result.schedule.sponge_factor
    params = tuple(config.SigmaVectorParameters_i[:2])
    reports = None
    if config.CompareSolution > 0:
        names = text.comparison_labels(text.lines(spark, config.ComparisonClusterFile))
        methods = {"own": labels} | {m: names.select("point_id", F.col(m).alias("cluster_id")) for m in ("mclust", "medea")}
        reports = full_comparison(points, names.select("point_id", F.col("golden").alias("cluster_id")), methods, params, config.SpongeFactor2)
    if out_dir:
        with watch.of("write"):
            if config.ClusterCountOutput >= 0:
                rows = writers.cluster_rows(assigned, clusters, n)
                writers.cluster_lines(rows).write.text(f"{out_dir}/clusters")
                writers.cluster_lines(writers.scaled_rows(rows, config.SigmaMethod, params)).write.text(f"{out_dir}/clusters-scaled")
            for t, c in result.by_count:
                rows = [(k, float(t), *map(float, y), float(size)) for k, (y, size) in enumerate(zip(c.y, c.c, strict=True))]
                spark.createDataFrame(rows, "cluster_id long, temperature double, " + ", ".join(f"y{i} double" for i in range(c.y.shape[1])) + ", size double").write.mode("append").parquet(f"{out_dir}/clusters-by-count/count={len(c)}")
            near = config.NearbySpongePointLimit if config.NearbySpongePointLimit > 0 else cut
            stats = quality.point_statistics(quality.point_quality(assigned, clusters, cut, sponge_id, near))
            quality.occupation_histogram(clusters, config.HistogramOccupationMax).write.parquet(f"{out_dir}/occupations")
            quality.distance_histogram(clusters, config.HistogramDistancesMax).write.parquet(f"{out_dir}/distances")
            table = quality.status_table(clusters, stats, config.NumberNearbyClusters, cut, config.SigmaMethod, params)
            quality.status_file_lines(table).select("value").write.text(f"{out_dir}/status")
            writers.shift_lines(quality.experiment_shifts(assigned, clusters, params)).write.text(f"{out_dir}/shifts")
            for name, frame in (reports or {}).items():
                frame.write.parquet(f"{out_dir}/{name}")
            summary = [f"{k}: {v:.3f} s" for k, v in watch.totals.items()] + [f"{len(result.clusters)} clusters of {n} points at T {result.schedule.t:.4g}: {result.reason}"]
            spark.createDataFrame([(x,) for x in summary], "value string").coalesce(1).write.text(f"{out_dir}/summary")
    return Outputs(config, result, labels, reports)


def follow_up_kmeans(points: DataFrame, result: A.Result, cut: float = 1e-5, max_rounds: int = 1000) -> tuple[np.ndarray, list[dict]]:
    """K-means from the means of an annealed solution's labels, with all distances; the solution has no sponge."""
    if result.clusters.sponge:
        raise ValueError("a solution with a sponge has no K-means")
    labels = A.labels(points, result.clusters, result.schedule)
    rows = kmeans.centers_of(points.join(labels, "point_id"), "cluster_id").orderBy("cluster_id").collect()
    return kmeans.run(points, np.array([r["y"] for r in rows]), max_rounds, cut, prune=False)


def run_kmeans(spark: SparkSession, config: Config, vectors: DataFrame, out_dir: str | None = None) -> tuple[np.ndarray, list[dict], DataFrame]:
    """K-means of ``vectors`` (point_id, x) from blocks of points, by the configuration's count of clusters; the
    assignment is returned and written below ``out_dir`` with the centres."""
    seeds = kmeans.initial_labels(numbered(vectors, "point_id"), config.InitialNcent)
    rows = kmeans.centers_of(seeds, "label").orderBy("cluster_id").collect()
    y, trace = kmeans.run(vectors, np.array([r["y"] for r in rows]), 1000, 1e-5)
    assigned = vectors.join(kmeans.assign_pruned(vectors, y), "point_id")
    if out_dir:
        centers = spark.createDataFrame([(k, [float(v) for v in c]) for k, c in enumerate(y)], "cluster_id long, y array<double>")
        writers.kmeans_lines(assigned, centers, vectors.count()).select("value").write.text(f"{out_dir}/kmeans")
    return y, trace, assigned


def main(argv: list[str] | None = None) -> Outputs:
    """Run a properties file: ``-c file -n nodes -t threads``, and ``--set Key=value`` before the file. Tables go to folders named after
    ``ClusterFile`` without its ending; a line of timing is appended to ``TimingFile`` and the summary to ``SummaryFile``, which the
    driver writes. Nodes times threads is the least number of partitions of a shuffle."""
    given = command_line(sys.argv[1:] if argv is None else argv)
    with open(given.configFile, encoding="utf-8") as f:
        config = Config.from_properties(f.read(), dict(x.split("=", 1) for x in given.set))
    spark = SparkSession.builder.appName("tempera").getOrCreate()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), given.nodeCount * given.threadCount)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    watch, out_dir = writers.Stopwatch(), config.ClusterFile.rsplit(".", 1)[0]
    with watch.of("all"):
        out = run(spark, config, out_dir)
    n = int(out.labels.count())
    writers.append_summary(config.SummaryFile, [f"{config.LabelFile}: {len(out.result.clusters)} clusters of {n} points at T {out.result.schedule.t:.4g}: {out.result.reason}", *(f"{k}: {v:.3f} s" for k, v in watch.totals.items())])
    watch.append_run(config.TimingFile, given.threadCount, given.nodeCount, n, len(out.result.clusters), config.LabelFile, "all")
    return out


if __name__ == "__main__":
    main()
