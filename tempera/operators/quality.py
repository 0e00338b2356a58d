"""Quality of a clustering: histograms of sizes and distances, nearest clusters, points near or far."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tempera.functions.exprs import fixed
from tempera.operators.boxes import ends, leaves
from tempera.operators.em import near_pairs, scaled_distance, with_clusters


def occupation_histogram(clusters: DataFrame, bins: int) -> DataFrame:
    """Clusters by their count of points; the last bin takes all larger ones."""
    return clusters.where("not is_sponge").groupBy(F.least(F.col("occupation"), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def distance_histogram(clusters: DataFrame, bins: int) -> DataFrame:
    near = near_pairs(clusters, bins)
    return near.groupBy(F.least(F.floor(F.col("d2") + 0.5), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def nearby_counts(clusters: DataFrame, cut: float) -> DataFrame:
    """Clusters within the cut of each; ``average`` over all of them, each pair once."""
    found = near_pairs(clusters, cut * cut).where(F.col("d2") < cut * cut).groupBy("cluster_id").agg(F.count("*").alias("n"))
    near = clusters.where("not is_sponge").select("cluster_id").join(found, "cluster_id", "left").fillna(0, ["n"])
    every = Window.partitionBy(F.lit(1))  # a row a cluster
    return near.withColumn("average", F.sum("n").over(every) / (2.0 * F.count("*").over(every)))


#: Clusters of a range, about; a range with twice as many (of equal first positions) is dealt by id as well.
RANGE = 20_000
_NEAREST = "cluster_id long, other long, d2 double, rank int"


def _k_nearest(mine: np.ndarray, others: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``mine`` and ``others`` have id, y0, y1, s0, s1 in their rows. For some of mine at once: their rows, the ids of their k nearest others
    and the square distances, ties by id (-1 and infinite where there are fewer). A box of clusters looks only at those no farther off than
    its k + 1 surest ones, which proves the kth."""
    y = others[:, 1:3]
    for rows in leaves(mine[:, 1:3]):
        part = mine[rows]
        near, _ = ends(part[:, 1:3].min(0), part[:, 1:3].max(0), y, part[:, 3:5].max(0), None)
        _, far = ends(part[:, 1:3].min(0), part[:, 1:3].max(0), y, part[:, 3:5].min(0), None)
        cols = np.flatnonzero(near <= np.partition(far, k)[k] * (1 + 1e-9)) if len(far) > k else np.arange(len(y))
        d2 = (y[None, cols, 0] - part[:, None, 1]) ** 2 / part[:, None, 3] + (y[None, cols, 1] - part[:, None, 2]) ** 2 / part[:, None, 4]
        ids = np.broadcast_to(others[cols, 0].astype(np.int64), d2.shape)
        d2 = np.where(ids == part[:, :1].astype(np.int64), np.inf, d2)
        order = np.lexsort((ids, d2), 1)[:, :k]
        d2, ids = np.take_along_axis(d2, order, 1), np.take_along_axis(ids, order, 1)
        if d2.shape[1] < k:
            more = ((0, 0), (0, k - d2.shape[1]))
            d2, ids = np.pad(d2, more, constant_values=np.inf), np.pad(ids, more, constant_values=-1)
        yield rows, ids, d2


def _rows(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.float64) for c in ("cluster_id", "y0", "y1", "s0", "s1")], 1)


def nearest_clusters(clusters: DataFrame, k: int, range_size: int = RANGE) -> DataFrame:
    """``cluster_id, other, d2, rank`` (from 1; ties by id) of each cluster's k nearest, by its own scales. Clusters are dealt by ranges of
    the first dimension. Each range first bounds the distance of its kth neighbours by its own clusters; then it gets
    those that lie within that bound, and no others. Ids are below 2 ** 53."""
    kind = clusters.schema["cluster_id"].dataType
    c = clusters.where("not is_sponge").select(F.col("cluster_id").cast("long").alias("cluster_id"), *[F.col(x).cast("double").alias(x) for x in ("y0", "y1", "s0", "s1")])
    n = c.count()
    parts = max(1, -(-n // range_size))
    cuts = sorted(set(c.approxQuantile("y0", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    dealt = c.withColumn("part", F.size(F.filter(F.array(*map(F.lit, cuts)), lambda x: x <= F.col("y0"))) if cuts else F.lit(0))
    ranges = {r["part"]: r for r in dealt.groupBy("part").agg(F.min("y0").alias("lo"), F.max("y0").alias("hi"), F.max("s0").alias("s0"), F.count("*").alias("n")).collect()}
    halves = {p: -(-r["n"] // (2 * range_size)) for p, r in ranges.items()}
    of = lambda values, default: F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in values.items() for v in kv]), F.col("part")), F.lit(default))
    dealt = dealt.withColumn("sub", F.pmod(F.xxhash64("cluster_id"), of(halves, 1)).cast("int") if max(halves.values(), default=1) > 1 else F.lit(0))

    def found(mine: np.ndarray, others: np.ndarray) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        for rows, ids, d2 in _k_nearest(mine, others, k):
            row, rank = np.nonzero(np.isfinite(d2))
            for column, v in zip(out, (mine[rows[row], 0].astype(np.int64), ids[row, rank], d2[row, rank], (rank + 1).astype(np.int32)), strict=True):
                column.append(v)
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
        return pa.table([pa.array(np.concatenate(v) if v else [], t) for v, t in zip(out, types, strict=True)], [x.split()[0] for x in _NEAREST.split(", ")])

    if len(ranges) <= 1 and max(halves.values(), default=1) == 1:
        near = dealt.groupBy("part").applyInArrow(lambda t: found(_rows(t), _rows(t)), _NEAREST)
    else:

        def bound(t: pa.Table) -> pa.Table:
            mine = _rows(t)
            worst = max(float(d2[:, -1].max()) for _, _, d2 in _k_nearest(mine, mine, k))
            return pa.table({"part": t.column("part").slice(0, 1), "bound": [worst]})

        bounds = {r["part"]: r["bound"] for r in dealt.groupBy("part", "sub").applyInArrow(bound, "part int, bound double").groupBy("part").agg(F.max("bound").alias("bound")).collect()}
        windows = []  # a row a range
        for p, r in ranges.items():
            reach = np.sqrt(bounds[p] * r["s0"]) * (1 + 1e-9)
            windows += [(p, i, float(r["lo"] - reach), float(r["hi"] + reach)) for i in range(halves[p])]
        window = c.sparkSession.createDataFrame(windows, "part int, sub int, lo double, hi double").agg(F.collect_list(F.struct("*")).alias("ws"))
        sent = c.crossJoin(F.broadcast(window)).select("*", F.explode(F.filter("ws", lambda w: F.col("y0").between(w["lo"], w["hi"]))).alias("w"))
        sent = sent.select(*[F.col(x).alias(x) for x in c.columns], F.col("w.part").alias("part"), F.col("w.sub").alias("sub"))
        near = dealt.groupBy("part", "sub").cogroup(sent.groupBy("part", "sub")).applyInArrow(lambda a, b: found(_rows(a), _rows(b)), _NEAREST)
    return near.select(F.col("cluster_id").cast(kind), F.col("other").cast(kind), "d2", "rank")


def point_quality(assigned: DataFrame, clusters: DataFrame, cut: float, sponge_id: int | None, sponge_cut: float | None = None) -> DataFrame:
    """Points with their nearest cluster, their distance to it and to their own, and where they
    should go: sponge points within the cut (or one of their own, ``sponge_cut``) go to the nearest; points beyond the cut of their own
    are illegal, and go to the sponge if there is one."""
    near = cut if sponge_cut is None else sponge_cut
    rows = with_clusters(assigned, clusters.where("not is_sponge"))
    all_ = F.transform("cs", lambda c: F.struct(scaled_distance(F.col("x0"), F.col("x1"), c).alias("d2"), c["cluster_id"].alias("id")))
    rows = rows.withColumn("_all", all_).withColumn("_best", F.array_min("_all"))
    own = F.get(F.filter("_all", lambda x: x["id"] == F.col("cluster_id")), F.lit(0))["d2"]
    is_sponge = F.col("cluster_id") == sponge_id if sponge_id is not None else F.lit(False)
    rows = rows.select("point_id", "cluster_id", F.col("_best.id").alias("nearest"), F.col("_best.d2").alias("nearest_d2"), own.alias("own_d2"), is_sponge.alias("in_sponge"))
    illegal = ~F.col("in_sponge") & (F.col("own_d2") > cut * cut)
    confused = F.col("in_sponge") & (F.col("nearest_d2") <= near * near)
    target = F.when(confused, F.col("nearest")).when(illegal, F.lit(sponge_id) if sponge_id is not None else F.col("cluster_id")).otherwise(F.col("cluster_id"))
    return rows.withColumns({"illegal": illegal, "confused": confused, "target": target})


def point_statistics(quality: DataFrame) -> DataFrame:
    """By cluster: its legal points, illegal ones, sponge points near it, and its extension. One pass:
    a point counts for its own cluster and for the nearest one."""
    legal = ~F.col("in_sponge") & ~F.col("illegal")
    side = lambda id_, **more: F.struct(F.col(id_).alias("cluster_id"), *[v.alias(k) for k, v in more.items()])
    no = F.lit(False)
    own = side("cluster_id", mine=~F.col("in_sponge"), legal=legal, illegal=F.col("illegal"), d2=F.when(legal, F.col("own_d2")), near=no)
    near = side("nearest", mine=no, legal=no, illegal=no, d2=F.lit(None).cast("double"), near=F.col("confused"))
    rows = quality.select(F.explode(F.array(own, near)).alias("s")).select("s.*")
    out = rows.groupBy("cluster_id").agg(
        F.count_if("legal").alias("n_legal"), F.count_if("illegal").alias("n_illegal"), F.sqrt(F.max("d2")).alias("extension"), F.count_if("near").alias("n_sponge_near"), F.bool_or("mine").alias("_mine")
    )
    return out.where("_mine").drop("_mine")


def experiment_shifts(assigned: DataFrame, clusters: DataFrame, params: tuple[float, float], sponge_id: int | None = None) -> DataFrame:
    """Mean and deviation of the scaled offsets from their clusters, by experiment, in one pass: points
    of no cluster (the sponge's) have no offset."""
    own = clusters.where("not is_sponge").select("cluster_id", "y0", "y1")
    rows = assigned.join(F.broadcast(own), "cluster_id", "left")
    shift0, shift1 = (F.col("x0") - F.col("y0")) / (params[0] * F.col("y0")), (F.col("x1") - F.col("y1")) / params[1]
    stats = [f(s).alias(f"{n}{i}") for i, s in enumerate((shift0, shift1)) for n, f in (("shift", F.avg), ("sd", F.stddev_pop))]
    sponge = [] if sponge_id is None else [F.count_if(F.col("cluster_id") == sponge_id).alias("n_sponge")]
    return rows.groupBy("experiment").agg(F.count("y0").alias("n"), *stats, *sponge).where("n > 0")


def status_lines(clusters: DataFrame, k: int) -> DataFrame:
    """One line of text a cluster: id, position, points, and its k nearest clusters as id(distance)."""
    near = nearest_clusters(clusters, k)
    text = F.format_string("%d(%s)", F.col("other"), fixed(F.sqrt("d2"), 2))
    near = near.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), " ").alias("near"))
    c = clusters.where("not is_sponge").join(near, "cluster_id", "left")
    return c.select("cluster_id", F.format_string("%d %s %s %d %s", F.col("cluster_id"), fixed(F.col("y0"), 4), fixed(F.col("y1"), 4), F.col("occupation"), F.coalesce("near", F.lit(""))).alias("line"))


def status_table(clusters: DataFrame, statistics: DataFrame, k: int, cut: float, method: int, params: Sequence[float]) -> DataFrame:
    """A row a cluster, as ``status_file_lines`` writes it: position in units of the scales (the first as a
    logarithm where its scale is proportional), points, clusters within the cut, and of ``point_statistics`` the
    sponge points near it, its illegal points and its extension; ``near``: its k nearest clusters as id(distance)."""
    close = nearby_counts(clusters, cut).select("cluster_id", F.col("n").alias("n_near"))
    text = F.format_string("%d(%.2f)", F.col("other"), F.sqrt("d2"))
    near = nearest_clusters(clusters, k).groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", text.alias("t")))), lambda x: x["t"]), "\t").alias("near"))
    c = clusters.where("not is_sponge").join(close, "cluster_id", "left").join(statistics, "cluster_id", "left").join(near, "cluster_id", "left")
    first = F.log("y0") if method >= 2 else F.col("y0")
    none = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return c.select(
        "cluster_id", (first / params[0]).alias("y0"), (F.col("y1") / params[1]).alias("y1"), "occupation", none("n_near"), none("n_sponge_near"), none("n_illegal"),
        F.coalesce("extension", F.lit(0.0)).alias("extension"), F.coalesce("near", F.lit("")).alias("near"),
    )


# Fixed value: the first line of a status file.
STATUS_HEADER = "Label\tY-0\tY-1\tCount\tNearby Clusters\tNearby Sponge Points\tIllegal Points\tMax Extension\tNearby Cluster Points"


def status_file_lines(table: DataFrame) -> DataFrame:
    """``cluster_id, value``: a tab-separated line for each row of ``status_table``; the header is ``STATUS_HEADER``."""
    fixed = F.format_string("%d\t%.4f\t%.4f\t%d\t%d\t%d\t%d\t%.3f", "cluster_id", "y0", "y1", "occupation", "n_near", "n_sponge_near", "n_illegal", "extension")
    return table.select("cluster_id", F.concat_ws("\t", fixed, F.when(F.col("near") != "", F.col("near"))).alias("value"))
