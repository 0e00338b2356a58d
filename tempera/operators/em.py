"""Soft clustering steps as DataFrame operations.

``points`` have ``point_id, x0, x1`` (more columns may follow); ``clusters`` have ``cluster_id,
is_sponge, y0, y1, s0, s1, p``. Clusters are few: they ride along as one array, a single broadcast
row, so a step is one narrow pass over the points and one small aggregation, without a shuffle of
points times clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_P = 1e-7
#: Cells that a cluster's reach may meet in a dimension, about.
CELLS = 64
EXP_CUT1, EXP_CUT2, EXP_CUT3 = 20.0, 40.0, 50.0
_FIELDS = ("cluster_id", "is_sponge", "y0", "y1", "s0", "s1", "p")


def with_clusters(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """Every point with all clusters as ``cs``, in the order of their ids."""
    row = clusters.agg(F.sort_array(F.collect_list(F.struct(*_FIELDS))).alias("cs"))
    return points.crossJoin(F.broadcast(row))


def once(rows: DataFrame, column: str) -> DataFrame:
    """The same rows; conditions on the column, or on what is made of it, are not pushed below this point,
    where they would compute it again, inside the clusters' join."""
    return rows.withColumn(column, F.explode(F.array(column)))


def scaled_distance(x0: Column, x1: Column, c: Column) -> Column:
    d0, d1 = x0 - c["y0"], x1 - c["y1"]
    return d0 * d0 / c["s0"] + d1 * d1 / c["s1"]


def _distances(x0: Column, x1: Column, sponge_factor: float | None) -> Column:
    far = F.lit(float(sponge_factor or 0) ** 2)
    return F.transform("cs", lambda c: F.when(c["is_sponge"], far).otherwise(scaled_distance(x0, x1, c)))


def e_step(points: DataFrame, clusters: DataFrame, temperature: float, sponge_factor: float | None = None, cut: float = EXP_CUT1) -> DataFrame:
    """Memberships: points with ``ms``, an array of struct<cluster_id, d2, m> of those above zero."""
    rows = with_clusters(points, clusters).withColumn("d2", _distances(F.col("x0"), F.col("x1"), sponge_factor))
    least = F.array_min("d2")
    weights = F.zip_with("d2", "cs", lambda d, c: F.when((d - least) / temperature < 2 * cut, F.greatest(F.lit(MIN_P), c["p"]) * F.exp(-0.5 * ((d - least) / temperature))).otherwise(0.0))
    rows = rows.withColumn("w", weights).withColumn("total", F.aggregate("w", F.lit(0.0), lambda s, v: s + v))
    ms = F.transform("cs", lambda c, i: F.struct(c["cluster_id"].alias("cluster_id"), F.get("d2", i).alias("d2"), (F.get("w", i) / F.col("total")).alias("m")))
    return once(rows.withColumn("ms", F.filter(ms, lambda x: x["m"] > 0)).drop("cs", "d2", "w", "total"), "ms")


def long_form(points: DataFrame) -> DataFrame:
    """One row a membership. The outer form spares the filter on the array's size that Spark infers
    from the inner one: pushed below the clusters' join it would compute the array again for every element."""
    others = [c for c in points.columns if c != "ms"]
    rows = points.select(*others, F.explode_outer("ms").alias("_m")).where("_m is not null")
    return rows.select(*others, "_m.cluster_id", "_m.d2", "_m.m")


def accumulate(points: DataFrame) -> DataFrame:
    """Size, freezing measure, mean position and scaled square width of each cluster."""
    m, c = F.col("m"), F.sum("m")
    return long_form(points).groupBy("cluster_id").agg(
        c.alias("c"),
        (F.sum(m * (1 - m)) / c).alias("freezing"),
        (F.sum(m * F.col("x0")) / c).alias("y0"),
        (F.sum(m * F.col("x1")) / c).alias("y1"),
        (F.sum(m * F.col("d2")) / c).alias("width2"),
    )


def update_p(sizes: DataFrame, n: float, sponge_weight: float | None = None, sponge_id: int = 0) -> DataFrame:
    """``p`` from sizes (cluster_id, c, ...): shares of the points; with a sponge weight the sponge's
    is that over the number of clusters, and the others share the rest in proportion."""
    out = sizes.withColumn("p", F.col("c") / n)
    if sponge_weight is None:
        return out
    every = Window.partitionBy(F.lit(1))  # a row a cluster
    k, old = F.count("*").over(every), F.max(F.when(F.col("cluster_id") == sponge_id, F.col("p"))).over(every)
    ps = F.lit(float(sponge_weight)) / k
    return out.withColumn("p", F.when(F.col("cluster_id") == sponge_id, ps).otherwise(F.col("p") * (1 - ps) / (1 - old)))


def correlations(points: DataFrame, clusters: DataFrame, temperature: float) -> DataFrame:
    """Upper triangle of each cluster's correlation matrix and the derivative of its size, with half
    memberships, as a split sees them."""
    rows = long_form(points).join(F.broadcast(clusters.where("not is_sponge").select("cluster_id", "y0", "y1", "s0", "s1")), "cluster_id")
    m, d0, d1 = F.col("m") * 0.5, F.col("x0") - F.col("y0"), F.col("x1") - F.col("y1")
    t = F.lit(float(temperature))
    return rows.groupBy("cluster_id").agg(
        F.sum("m").alias("c"),
        F.sum(m * d0 * d0 / (t * F.col("s0"))).alias("corr00"),
        F.sum(m * d0 * d1 / (t * F.sqrt(F.col("s0") * F.col("s1")))).alias("corr01"),
        F.sum(m * d1 * d1 / (t * F.col("s1"))).alias("corr11"),
        F.sum(d0 * m * (1 - m) / (F.sqrt("s0") * t)).alias("dc0"),
        F.sum(d1 * m * (1 - m) / (F.sqrt("s1") * t)).alias("dc1"),
    )


def hard_assignment(points: DataFrame) -> DataFrame:
    """The greatest membership of each point; the first of equals."""
    best = F.array_min(F.transform("ms", lambda x: F.struct((-x["m"]).alias("k"), x["cluster_id"].alias("cluster_id"))))
    return points.withColumn("cluster_id", best["cluster_id"]).drop("ms")


def candidates(points: DataFrame, clusters: DataFrame, temperature: float, target: int, cut: float = EXP_CUT2) -> DataFrame:
    """The nearest clusters of each point: at most ``target``, none further than the cut allows;
    ``rank`` from 1, ties by id."""
    rows = with_clusters(points, clusters.where("not is_sponge"))
    near = F.sort_array(F.transform("cs", lambda c: F.struct(scaled_distance(F.col("x0"), F.col("x1"), c).alias("d2"), c["cluster_id"].alias("cluster_id"))))
    near = F.slice(near, 1, target)
    rows = rows.select("point_id", near.alias("near")).select("point_id", F.filter("near", lambda x: x["d2"] - F.get("near", F.lit(0))["d2"] <= 2 * cut * temperature).alias("near"))
    rows = rows.select("point_id", F.posexplode_outer("near").alias("rank", "c")).where("c is not null")  # outer: see long_form
    return rows.select("point_id", (F.col("rank") + 1).alias("rank"), "c.cluster_id", "c.d2")


def reassigned(points: DataFrame, clusters: DataFrame, temperature: float, target: int, cut: float = EXP_CUT2) -> DataFrame:
    """Memberships (``ms``) over new lists of clusters: the sponge, if there is one, then the nearest within the
    cut, together at most ``target``. Clusters that stay keep their membership, new ones begin at zero; they
    are scaled to one, or become uniform if less than 0.2 is left."""
    rows = with_clusters(points, clusters)
    sponge = F.filter("cs", lambda c: c["is_sponge"])
    near = F.sort_array(F.transform(F.filter("cs", lambda c: ~c["is_sponge"]), lambda c: F.struct(scaled_distance(F.col("x0"), F.col("x1"), c).alias("d2"), c["cluster_id"].alias("cluster_id"))))
    rows = rows.withColumns({"_sponge": F.transform(sponge, lambda c: c["cluster_id"]), "_near": F.slice(near, F.lit(1), F.greatest(F.lit(1), F.lit(target) - F.size(sponge)))})
    least = F.get("_near", F.lit(0))["d2"]
    within = F.transform(F.filter("_near", lambda x: x["d2"] - least <= 2 * cut * temperature), lambda x: x["cluster_id"])
    rows = rows.withColumn("_ids", F.concat("_sponge", within)).withColumn("_old", F.map_from_entries(F.transform("ms", lambda x: F.struct(x["cluster_id"], F.struct(x["m"], x["d2"])))))
    dist = F.map_from_entries(F.transform("_near", lambda x: F.struct(x["cluster_id"], x["d2"])))
    rows = rows.withColumn("_dist", dist).withColumn("_m", F.transform("_ids", lambda k: F.coalesce(F.try_element_at("_old", k)["m"], F.lit(0.0))))
    rows = rows.withColumn("_sum", F.aggregate("_m", F.lit(0.0), lambda s, v: s + v))
    share = lambda m: F.when(F.col("_sum") < 0.2, 1.0 / F.size("_ids")).otherwise(m / F.col("_sum"))
    d2 = lambda k: F.coalesce(F.try_element_at("_dist", k), F.try_element_at("_old", k)["d2"])
    ms = F.zip_with("_ids", "_m", lambda k, m: F.struct(k.alias("cluster_id"), d2(k).alias("d2"), share(m).alias("m")))
    return rows.withColumn("ms", ms).drop("cs", "_sponge", "_near", "_ids", "_old", "_dist", "_m", "_sum")


def trimmed(points: DataFrame, clusters: DataFrame, temperature: float, target: int, cut: float = EXP_CUT2) -> DataFrame:
    """``reassigned`` only for points with more memberships (``ms``) than ``target``; ``changed`` says for which."""
    rows = points.withColumn("changed", F.size("ms") > target)
    new = reassigned(rows.where("changed"), clusters, temperature, target, cut)
    return rows.where("not changed").unionByName(new)


def repaired(memberships: DataFrame, removed: DataFrame, split: DataFrame) -> DataFrame:
    """Long memberships after clusters went (``cluster_id``) and others split (``cluster_id, child_id``): what a
    point loses goes to its other clusters in proportion, evenly if it loses 0.99 or more; both halves of a
    split get half."""
    gone = removed.select("cluster_id", F.lit(True).alias("_gone"))
    rows = memberships.join(F.broadcast(gone), "cluster_id", "left").join(F.broadcast(split.select("cluster_id", "child_id")), "cluster_id", "left")
    mine, lost = Window.partitionBy("point_id"), F.when(F.col("_gone"), F.col("m")).otherwise(0.0)
    rows = rows.withColumns({"_lost": F.sum(lost).over(mine), "_n": F.count_if(F.col("_gone").isNull()).over(mine)}).where("_gone is null")
    rows = rows.withColumn("m", F.when(F.col("_lost") >= 0.99, 1.0 / F.col("_n")).otherwise(F.col("m") / (1 - F.col("_lost"))))
    both = F.when(F.col("child_id").isNull(), F.array("cluster_id")).otherwise(F.array("cluster_id", F.col("child_id").cast(memberships.schema["cluster_id"].dataType)))
    rows = rows.withColumn("m", F.col("m") / F.size(both)).withColumn("_ids", both)
    return rows.select("point_id", F.explode("_ids").alias("cluster_id"), "m")


def near_pairs(clusters: DataFrame, limit: float) -> DataFrame:
    """Ordered pairs of clusters (no sponge) at most ``limit`` apart, square and by the first one's scale:
    ``cluster_id, occupation, other, other_occupation, d2``. A cluster looks into the cells of both dimensions that its own reach meets. Cells are
    as wide as the mean reach, so a few wide clusters look into more of them and the others don't meet more; where that would be more
    than ``CELLS`` in a dimension, all cells are wider."""
    c = clusters.where("not is_sponge").withColumns({f"_r{i}": F.greatest(F.sqrt(F.lit(float(limit)) * F.col(f"s{i}")), F.lit(1e-300)) for i in (0, 1)})
    width = c.agg(*[F.greatest(F.avg(f"_r{i}"), F.max(f"_r{i}") * 2 / CELLS, F.lit(1e-300)).alias(f"_w{i}") for i in (0, 1)])
    c = c.crossJoin(F.broadcast(width))
    cell = lambda v, i: F.floor(v / F.col(f"_w{i}"))
    reach = lambda i: F.explode(F.sequence(cell(F.col(f"y{i}") - F.col(f"_r{i}"), i), cell(F.col(f"y{i}") + F.col(f"_r{i}"), i))).alias(f"_c{i}")
    own = ("cluster_id", "occupation", "y0", "y1", "s0", "s1")
    a = c.select(*own, "_r1", "_w1", reach(0)).select(*own, "_c0", reach(1))
    b = c.select(cell(F.col("y0"), 0).alias("_c0"), cell(F.col("y1"), 1).alias("_c1"), F.col("cluster_id").alias("other"), F.col("occupation").alias("other_occupation"), F.col("y0").alias("o0"), F.col("y1").alias("o1"))
    d2 = scaled_distance(F.col("o0"), F.col("o1"), {k: F.col(k) for k in ("y0", "y1", "s0", "s1")})
    return a.join(b, ["_c0", "_c1"]).where("cluster_id <> other").select("cluster_id", "occupation", "other", "other_occupation", d2.alias("d2")).where(F.col("d2") <= limit)


def close_clusters(clusters: DataFrame, limit: float) -> DataFrame:
    """Clusters near one that holds more points (of equals the greater id goes)."""
    more = "d2 < {0} and (other_occupation > occupation or (other_occupation = occupation and other < cluster_id))"
    near = near_pairs(clusters, limit).where(more.format(limit)).select("cluster_id").distinct()
    return clusters.join(near, "cluster_id", "left_semi")


def split_candidates(stats: DataFrame, min_width2: float = 1.5, min_size: float = 4.0) -> DataFrame:
    """Least eigenpair of C/2 - correlations by cluster (with ``c, width2`` and the correlations);
    ``splittable`` if it is negative and the cluster is wide and large enough."""
    from tempera.functions.exprs import min_eigen_2x2

    half = F.col("c") * 0.5
    rows = stats.withColumn("eigen", min_eigen_2x2(half - F.col("corr00"), -F.col("corr01"), half - F.col("corr11")))
    good = (F.col("width2") > min_width2) & (F.col("c") > min_size) & (F.col("eigen.value") < 0)
    return rows.select("*", F.col("eigen.value").alias("eigenvalue"), F.col("eigen.v0").alias("v0"), F.col("eigen.v1").alias("v1"), good.alias("splittable")).drop("eigen")


def split_centers(candidates_: DataFrame) -> DataFrame:
    """Both halves of each cluster that splits: its centre moved along the eigenvector either way."""
    w = F.sqrt("width2")
    along = F.col("v0") * F.col("dc0") + F.col("v1") * F.col("dc1")
    step = F.least(F.greatest(F.abs(0.025 * F.col("c") / along), 0.05 * w), 0.2 * w)
    rows = candidates_.where("splittable").withColumn("step", step)
    side = F.explode(F.array(F.lit(1), F.lit(-1))).alias("side")
    rows = rows.select("*", side)
    return rows.select("cluster_id", "side", (F.col("y0") + F.col("side") * F.col("v0") * F.col("step") * F.sqrt("s0")).alias("y0"), (F.col("y1") + F.col("side") * F.col("v1") * F.col("step") * F.sqrt("s1")).alias("y1"), (F.col("c") / 2).alias("c"))


def renormalised(memberships: DataFrame, removed: DataFrame) -> DataFrame:
    """Long memberships without the removed clusters, summing to one again; where less than 0.2 is
    left they become uniform."""
    kept = memberships.join(F.broadcast(removed.select("cluster_id")), "cluster_id", "left_anti")
    mine = Window.partitionBy("point_id")
    rows = kept.withColumn("_sum", F.sum("m").over(mine)).withColumn("_n", F.count("*").over(mine))
    return rows.withColumn("m", F.when(F.col("_sum") < 0.2, 1.0 / F.col("_n")).otherwise(F.col("m") / F.col("_sum"))).drop("_sum", "_n")


def initial_state(points: DataFrame, s0: float, s1: float) -> DataFrame:
    """Mean position and first temperature: one and a half times the mean square distance to it."""
    a = points.agg(F.avg("x0").alias("y0"), F.avg("x1").alias("y1"))
    d = points.crossJoin(F.broadcast(a))
    d2 = (F.col("x0") - F.col("y0")) * (F.col("x0") - F.col("y0")) / s0 + (F.col("x1") - F.col("y1")) * (F.col("x1") - F.col("y1")) / s1
    return d.agg(F.max("y0").alias("y0"), F.max("y1").alias("y1"), (1.5 * F.avg(d2)).alias("temperature"))
