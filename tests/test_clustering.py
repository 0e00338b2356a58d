"""Small cases worked by hand, and the invariants of the loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempera import queries
from tempera.operators import bandjoin, compare, em, kmeans
from tempera.plans import anneal as A
from tempera.plans.presets import preset
from tempera.sources import text, writers
from tempera.sources.config import Config, command_line

BLOBS = [(i, 0.0 + dx, 0.0 + dy) for i, (dx, dy) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])] + [(4 + i, 100.0 + dx, dy) for i, (dx, dy) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]


def points(spark, rows=BLOBS):
    return spark.createDataFrame([(i, float(a), float(b)) for i, a, b in rows], "point_id long, x0 double, x1 double")


def clusters(spark, rows):
    return spark.createDataFrame(rows, "cluster_id int, is_sponge boolean, y0 double, y1 double, s0 double, s1 double, p double, occupation long")


TWO = [(1, False, 0.0, 0.0, 1.0, 1.0, 0.5, 4), (2, False, 100.0, 0.0, 1.0, 1.0, 0.5, 4)]


def test_memberships_sum_to_one_and_follow_the_blobs(spark):
    m = em.e_step(points(spark), clusters(spark, TWO), 1000.0)
    assert {round(r[0], 9) for r in m.select(F.aggregate("ms", F.lit(0.0), lambda s, x: s + x["m"])).collect()} == {1.0}
    hard = {r.point_id: r.cluster_id for r in em.hard_assignment(m).collect()}
    assert hard == {i: 1 + (i >= 4) for i in range(8)}


def test_far_terms_leave_a_single_membership(spark):
    m = em.e_step(points(spark), clusters(spark, TWO), 0.01).collect()
    assert all(len(r.ms) == 1 and r.ms[0].m == 1.0 for r in m)


def test_an_outlier_goes_to_the_sponge(spark):
    c = clusters(spark, [(0, True, 0.0, 0.0, 1.0, 1.0, 0.1, 0), *TWO])
    hard = em.hard_assignment(em.e_step(points(spark, [*BLOBS, (8, 50.0, 500.0)]), c, 1.0, 3.0))
    assert {r.point_id: r.cluster_id for r in hard.collect()}[8] == 0


def test_of_equal_close_clusters_the_greater_id_goes(spark):
    c = clusters(spark, [(1, False, 0.0, 0.0, 1.0, 1.0, 0.5, 4), (2, False, 0.1, 0.0, 1.0, 1.0, 0.3, 4), (3, False, 9.0, 0.0, 1.0, 1.0, 0.2, 9)])
    assert [r.cluster_id for r in em.close_clusters(c, 0.5).collect()] == [2]


@pytest.mark.parametrize(("gap", "met"), [(5e-7, True), (2e-6, False)])
def test_label_transfer_at_the_edge_of_the_band(spark, gap, met):
    p = points(spark, [(1, 10.0, 1.0)])
    other = spark.createDataFrame([(10.0 + gap, 1.0, 7)], "x0 double, x1 double, label int")
    assert bandjoin.transfer_labels(p, other).first().label == (7 if met else 0)


def test_a_labelling_differs_from_itself_in_nothing(spark):
    x = spark.createDataFrame([(i, i % 7) for i in range(200)], "point_id long, cluster_id int")
    for r in compare.difference(x, x, (0, 5)).collect():
        assert (r.base_points, r.major, r.stray, r.stray_single) == (r.points_in_major, r.base_clusters, 0, 0)


def test_points_without_a_target_are_left_out(spark):
    a = spark.createDataFrame([(1, 1), (2, 1)], "point_id long, cluster_id int")
    b = spark.createDataFrame([(1, -1), (2, 5)], "point_id long, cluster_id int")
    assert [tuple(r) for r in compare.best_overlap(a, b).collect()] == [(1, 5, 1)]


def test_pruned_and_plain_nearest_centres_agree():
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(size=(300, 5)), rng.normal(size=(300, 5)) + 20]
    y = np.r_[rng.normal(size=(6, 5)), rng.normal(size=(6, 5)) + 20]
    a, d, work = kmeans.nearest(x, y)
    b, e, _ = kmeans.nearest(x, y, prune=False)
    assert (a == b).all() and np.allclose(d, e) and work < len(x) * len(y)


def test_kmeans_settles_and_an_empty_start_is_an_error(spark):
    p = points(spark).select("point_id", F.array("x0", "x1").alias("x"))
    y, trace = kmeans.run(p, np.array([[1.0, 1.0], [90.0, 0.0]]))
    assert np.allclose(y, [[0, 0], [100, 0]]) and trace[-1]["change"] == 0
    with pytest.raises(ValueError, match="empty"):
        kmeans.run(p, np.array([[0.0, 0.0], [1e6, 0.0]]))


def test_annealing_finds_the_blobs_and_replicas_change_nothing(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *(rng.normal(size=2) + [40 * (i % 3), 30 * (i % 3 == 1)])) for i in range(300)]
    config = Config(SigmaMethod=1, SigmaVectorParameters_i=(1.0, 1.0), Tminimum=-2000.0, InitialCoolingFactor1=0.7, InitialCoolingFactor2=0.7, FineCoolingFactor1=0.7, FineCoolingFactor2=0.7, WaitIterations=1, ConvergenceLoopLimit=12, TemperatureForClosenessTest=1.0)
    p = points(spark, rows).select(F.array("x0", "x1").alias("x")).coalesce(2).persist()
    out = A.anneal(p, config, max_clusters=3, max_steps=400)
    found = out.clusters.y[np.argsort(out.clusters.y[:, 0])]
    assert np.allclose(found, [[0, 0], [40, 30], [80, 0]], atol=0.5)
    assert abs(out.clusters.c.sum() - 300) < 1e-6 and abs(out.clusters.p.sum() - 1) < 1e-9
    now = (out.clusters.y, np.ones((3, 2)), out.clusters.p, 1.0, None)
    one, three = A.em_sums(p, now, None, 20.0), A.em_sums(p.withColumn("r", F.explode(F.lit([1, 2, 3]))).select("x"), now, None, 20.0)
    assert np.allclose(3 * one["c"], three["c"]) and np.allclose(one["mean"], three["mean"])


def test_a_run_says_what_ended_it_and_the_registered_one_ends(spark, monkeypatch):
    rows = [(i, float(i % 2) * 40 + i / 100, 0.0) for i in range(60)]
    config = Config(SigmaMethod=1, SigmaVectorParameters_i=(1.0, 1.0), Tminimum=0.5, InitialCoolingFactor1=0.5, InitialCoolingFactor2=0.5, FineCoolingFactor1=0.5, FineCoolingFactor2=0.5, WaitIterations=1, ConvergenceLoopLimit=4)
    p = points(spark, rows).select(F.array("x0", "x1").alias("x")).coalesce(1).persist()
    assert A.anneal(p, config, max_steps=3).reason == "step limit"
    assert A.anneal(p, config).reason not in ("", "step limit")
    ends, run = [], A.anneal
    monkeypatch.setattr(A, "anneal", lambda *a, **k: ends.append(run(*a, **k)) or ends[-1])
    assert queries.anneal_run(spark, "/root/testdata/sf0.001").count() == len(ends[0].clusters)
    assert ends[0].reason not in ("", "step limit")


def test_the_configured_limit_holds_back_splits_and_is_reported(spark):
    p = points(spark, [(i, float(i % 4) * 40 + i / 100, 0.0) for i in range(60)]).select(F.array("x0", "x1").alias("x")).coalesce(1).persist()
    config = {"SigmaMethod": 1, "SigmaVectorParameters_i": (1.0, 1.0), "Tminimum": 0.5, "InitialCoolingFactor1": 0.5, "InitialCoolingFactor2": 0.5, "FineCoolingFactor1": 0.5, "FineCoolingFactor2": 0.5, "WaitIterations": 1, "ConvergenceLoopLimit": 4}
    held, free = A.anneal(p, Config(**config, MaxNcentTotal=2)), A.anneal(p, Config(**config))
    assert len(held.clusters) <= 2 and held.limited
    assert len(free.clusters) > 2 and not free.limited


def test_removed_clusters_leave_weights_that_sum_to_one():
    c = A.Clusters(np.zeros((3, 2)), np.array([0.2, 0.3, 0.5]), np.arange(3), np.full(3, 2), sponge=True)
    assert np.allclose(c.keep(np.array([True, False, True])).p.sum(), 1)


def test_schedules():
    c = Config(SpongeFactor1=2.0, SpongeFactor2=1.0, SpongeTemperature1=5.0, SpongeTemperature2=2.0, FinalTargetTemperature=3.0, FinalTargetSigma0=0.1)
    assert [A.sponge_factor(c, t) for t in (1, 2, 3.5, 5)] == [1, 1, 1.5, 2]
    assert A.next_sigma(c, 2.0, 0.5, 0.9) == 0.1 and 0.1 < A.next_sigma(c, 30.0, 0.5, 0.9) < 0.5


def test_configuration_presets_and_command_line():
    c = Config.from_properties("UseSponge=true\nLCMSmode = 4\nMagicTemperatures=2.0,1.0\n# no\nMaxMPITransportBuffer=5", {"SpongeFactor1": "4"})
    assert c.UseSponge and c.SpongeFactor1 == 4.0 and c.MagicTemperatures == (2.0, 1.0)
    assert preset(c).SpongeFactor1 == 2.0 and preset(c).RestartTemperature == 0.025
    assert command_line(["-c", "f", "-n", "2", "-t", "4"]).threadCount == 4


def test_text_files_go_round(spark, tmp_path):
    rows = points(spark).select(F.col("point_id").alias("row_id"), "x0", "x1", F.lit(3).alias("label"), F.lit(9).alias("experiment"))
    writers.cluster_lines(rows, experiment="experiment").write.text(str(tmp_path / "out"))
    back = text.peaks(text.lines(spark, str(tmp_path / "out")), kind=1)
    assert sorted((r.point_id, r.x0, r.x1, r.label, r.experiment) for r in back.collect()) == [(i, float(a), float(b), 3, 9) for i, a, b in BLOBS]
    watch = writers.Stopwatch()
    with watch.of("all"):
        pass
    watch.append_to(str(tmp_path / "t.tsv"))
    watch.append_to(str(tmp_path / "t.tsv"))
    assert len((tmp_path / "t.tsv").read_text().splitlines()) == 3
    for _ in range(2):
        watch.append_run(str(tmp_path / "run.tsv"), 4, 2, 1001, 7, "in.txt", "all")
    head, *rows = [x.split("\t") for x in (tmp_path / "run.tsv").read_text().splitlines()]
    assert len(head) == 23 and [len(x) for x in rows] == [23, 23]
    assert rows[0][2:10] == ["4", "1", "2", "4x1x2", "8", "126", "1001", "7"] and rows[0][11] == "1.0" and rows[0][20] == "in.txt"


def test_a_stream_is_scored_like_a_batch(spark, tmp_path):
    from tempera.streaming.score import score_stream

    points(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("point_id long, x0 double, x1 double").parquet(str(tmp_path / "in"))
    q = score_stream(stream, clusters(spark, TWO), 1.0).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert {r.point_id: r.cluster_id for r in spark.table("scored").collect()} == {i: 1 + (i >= 4) for i in range(8)}


def test_the_sponge_comes_when_it_is_cold_and_takes_outliers(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *(rng.normal(size=2) + [40 * (i % 2), 0])) for i in range(200)] + [(200 + i, 20.0, 60.0 + 50 * i) for i in range(4)]
    config = Config(UseSponge=True, SpongeTemperature1=3.0, SpongeTemperature2=1.0, SigmaMethod=1, SigmaVectorParameters_i=(1.0, 1.0), Tminimum=0.5, InitialCoolingFactor1=0.7, InitialCoolingFactor2=0.7, FineCoolingFactor1=0.7, FineCoolingFactor2=0.7, WaitIterations=1, ConvergenceLoopLimit=8)
    p = points(spark, rows).select(F.array("x0", "x1").alias("x")).coalesce(2).persist()
    out = A.anneal(p, config, max_clusters=4, max_steps=300)
    assert out.clusters.sponge and 0 < out.clusters.c[0] < 30 and abs(out.clusters.c.sum() - 204) < 1e-6
    state = [{"cluster_id": 1, "is_sponge": False, "y0": 0.5, "y1": 0.0, "p": 0.5}, {"cluster_id": 2, "is_sponge": False, "y0": 39.0, "y1": 0.0, "p": 0.5}]
    again = A.anneal(p, Config(SigmaMethod=1, SigmaVectorParameters_i=(1.0, 1.0), RestartTemperature=1.0, Tminimum=0.5, MaxNumberSplitClusters=0, InitialCoolingFactor1=0.7, InitialCoolingFactor2=0.7), restart=state, max_steps=100)
    assert len(again.clusters) == 2


@pytest.mark.parametrize("name", ["e_step", "em_counts", "m_step", "correlations", "candidates_topk", "point_stats", "experiment_shift", "sponge_relabel", "assign_hard", "kmeans_update"])
def test_no_plan_computes_memberships_in_a_join_or_filter(spark, name):
    """Spark must not push conditions below the clusters' join, where they repeat the arrays' expressions."""
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if line.strip(" :+-").startswith("Join"):
            assert "lambda" not in line, line
        if line.strip(" :+-").startswith("Filter"):
            assert "exp(" not in line.lower(), line


def grid(spark, k: int = 6, each: int = 40, seed: int = 3):
    """Blobs on a square grid, far apart, and where their centres are."""
    r = np.random.default_rng(seed)
    centres = np.array([(100.0 * i, 100.0 * j) for i in range(k) for j in range(k)])
    x = np.concatenate([c + r.normal(size=(each, 2)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, x array<double>").repartition(3)
    return df, centres


@pytest.mark.parametrize("sponge", [None, 4.0])
def test_the_pruned_kernel_equals_the_dense_one_with_fewer_distances(spark, sponge):
    p, y = grid(spark)
    if sponge:
        y = np.r_[y[:1], y]
    s2, weights = np.tile([1.0, 2.0], (len(y), 1)), np.full(len(y), 1 / len(y))
    now, before = (y, s2, weights, 30.0, sponge), (y + 1.5, s2, weights, 35.0, sponge)
    dense, pruned = (A.em_sums(p, now, before, 20.0, metric) for metric in (False, True))
    for name in dense:
        if name != "work":
            assert np.allclose(dense[name], pruned[name], rtol=1e-9, atol=1e-9), name
    assert pruned["work"].sum() < 0.5 * dense["work"].sum()
    blocks = A.em_sums(p, now, before, 20.0, True, many_parts=True)
    assert np.allclose(blocks["corr"], pruned["corr"], rtol=1e-12)
    few, every = (A.em_sums(p, (*now[:3], 1e6, sponge), None, 20.0, metric, 5) for metric in (True, False))
    assert np.allclose(few["c"], every["c"]) and abs(few["c"].sum() - 1440) < 1e-6


def test_at_most_so_many_clusters_count_for_a_point():
    x, y = np.array([[0.0]]), np.array([[0.0], [1.0], [2.0], [3.0]])
    m, _ = A.memberships(x, y, np.ones((4, 1)), np.full(4, 0.25), 10.0, None, 20.0, 2)
    assert (m > 0).tolist() == [[True, True, False, False]] and abs(m.sum() - 1) < 1e-12
    m, _ = A.memberships(x, y, np.ones((4, 1)), np.full(4, 0.25), 10.0, 1.0, 20.0, 3)
    assert (m > 0).tolist() == [[True, True, True, False]]


def test_labels_follow_the_blobs_and_a_function_may_give_the_scales(spark):
    p, y = grid(spark, 3)
    config = Config(SigmaMethod=1, SigmaVectorParameters_i=(1.0, 1.0), Tminimum=-2000.0, InitialCoolingFactor1=0.8, InitialCoolingFactor2=0.8, FineCoolingFactor1=0.8, FineCoolingFactor2=0.8, WaitIterations=1, ConvergenceLoopLimit=8, MagicTemperatures=(500.0, 50.0))
    p = p.persist()
    plain = A.anneal(p, config, max_clusters=9, max_steps=600)
    own = A.anneal(p, config, max_clusters=9, max_steps=600, sigma=lambda centres: np.ones_like(centres))
    assert plain.schedule.magic == 2 and plain.work < 1 and own.work == 1
    assert np.allclose(np.sort(plain.clusters.y, 0), np.sort(own.clusters.y, 0), atol=1e-6)
    found = {r.point_id: r.cluster_id for r in A.labels(p, plain.clusters, plain.schedule).collect()}
    near = np.argmin(((np.array([r.x for r in p.orderBy("point_id").collect()])[:, None] - plain.clusters.y[None]) ** 2).sum(2), 1)
    assert [found[i] for i in range(len(near))] == near.tolist()


def test_closeness_is_tested_again_only_after_a_drop_of_a_quarter():
    c = Config(TemperatureForClosenessTest=4.0)
    assert not A.tests_closeness(4.0, None, c) and A.tests_closeness(3.9, None, c)
    assert not A.tests_closeness(3.7, 3.9, c) and A.tests_closeness(3.6, 3.9, c)


def test_bounds_spare_distances_and_give_the_same_assignment(spark):
    p, y = grid(spark)
    moved = y + np.array([0.3, -0.2])
    state = kmeans.scan(p, y)
    after = kmeans.rescan(state.drop("work"), moved, y).collect()
    plain = {r.point_id: r.cluster_id for r in kmeans.assign_pruned(p, moved).collect()}
    assert {r.point_id: r.cluster_id for r in after} == plain
    assert sum(r.work for r in after) < 0.1 * len(after) * len(y)


def test_nearest_keeps_the_first_of_equal_centres():
    r = np.random.default_rng(5)
    y = r.integers(0, 4, (40, 2)).astype(float)  # many equal ones
    x = r.integers(0, 4, (300, 2)).astype(float) + r.choice([0.0, 0.5], (300, 1))
    for a, b in zip(kmeans.nearest(x, y)[:2], kmeans.nearest(x, y, prune=False)[:2], strict=True):
        assert (a == b).all()


def test_a_configuration_runs_from_its_files_to_outputs(spark, tmp_path):
    from tempera.plans import job

    r = np.random.default_rng(1)
    lines = []
    for i in range(240):
        c = i % 3
        x = 500 + 40 * c + r.normal(), 10 + 20 * c + r.normal()
        lines.append(f"{i} {x[0]:.6f} {x[1]:.6f} 2 P {c} {c} {c} {i % 5 + 1}")
    (tmp_path / "in.txt").write_text("\n".join([*lines, "999 1.0 1.0 7 P 0 0 0 1"]))
    text_of = f"LabelFile={tmp_path}/in.txt\nComparisonClusterFile={tmp_path}/in.txt\nSelectedInputLabel=2\nCompareSolution=1\nSigmaMethod=1\nSigmaVectorParameters_i=1.0,1.0\nTminimum=-500\nInitialCoolingFactor1=0.8\nInitialCoolingFactor2=0.8\nFineCoolingFactor1=0.8\nFineCoolingFactor2=0.8\nWaitIterations=1\nConvergenceLoopLimit=8\nNumberNearbyClusters=2\n"
    out = job.run(spark, Config.from_properties(text_of), f"file://{tmp_path}/out", max_clusters=3, max_steps=500)
    assert out.result.reason != "step limit" and out.labels.count() == 240
    groups = {}
    for x in out.labels.collect():
        groups.setdefault(x.cluster_id, set()).add(x.point_id % 3)
    assert sorted(map(sorted, groups.values())) == [[0], [1], [2]]
    read = lambda name: [x.value for x in spark.read.text(f"file://{tmp_path}/out/{name}").collect()]
    assert len(read("clusters")) == 243 and len(read("status")) == 3 and len(read("shifts")) == 5 and any("clusters of 240 points" in x for x in read("summary"))
    own = [x for x in out.reports["golden"].collect() if x.method == "own"]
    assert {x.lim for x in own} == {3, 11, 36} and all(x.clusters == 3 and x.share == 1 for x in own)
    assert {"differences", "differences_back", "statistics", "peaks"} <= out.reports.keys()
    # go on from the written clusters, without refinement
    parts = read("clusters")
    (tmp_path / "again.txt").write_text("\n".join(parts))
    again = job.run(spark, Config.from_properties(text_of + f"LCMSmode=5\nRestartClusterFile={tmp_path}/again.txt\n", {"MaxNumberSplitClusters": "0"}), max_steps=200)
    assert np.allclose(np.sort(again.result.clusters.y, 0), np.sort(out.result.clusters.y, 0), atol=0.1)


def test_kmeans_follows_an_annealed_solution_and_a_configuration(spark, tmp_path):
    from dataclasses import replace

    from tempera.plans import job
    from tempera.plans.presets import basic_annealing, basic_kmeans

    p, y = grid(spark, 2)
    p = p.persist()
    config = replace(basic_annealing(Config()), ParameterVectorDimension=2, InitialCoolingFactor1=0.8, InitialCoolingFactor2=0.8, FineCoolingFactor1=0.8, FineCoolingFactor2=0.8, WaitIterations=1, ConvergenceLoopLimit=8, Tminimum=-50.0)
    out = A.anneal(p, config, max_clusters=4, max_steps=500)
    centres, trace = job.follow_up_kmeans(p, out)
    assert np.allclose(np.sort(centres, 0), np.sort(y, 0), atol=1) and trace[-1]["change"] < 1e-3
    _, _, assigned = job.run_kmeans(spark, replace(basic_kmeans(Config()), InitialNcent=4), p, f"file://{tmp_path}/out")
    lines = [x.value for x in spark.read.text(f"file://{tmp_path}/out/kmeans").collect()]
    assert len(lines) == p.count() + 4 and sum(x.endswith(" 0.0 100000000") for x in lines) == 4 and assigned.count() == p.count()


def three_d(corr, c=100.0, width2=3.0, priority=-1):
    """One cluster in three dimensions with the upper triangle of its correlations."""
    return A.Clusters(np.zeros((1, 3)), np.ones(1), np.zeros(1, int), np.array([priority]), False, np.array([c]), np.zeros(1), np.array([width2]), np.array([c]), np.array([corr]), np.array([[1.0, 1.0, 1.0]]))


def test_clusters_split_along_their_widest_direction_in_any_dimension():
    schedule = A.Schedule(Config(ParameterVectorDimension=3), 1.0, 0.1, 1.0, 3.0, 1.0)
    v = np.array([1.0, 2.0, 2.0]) / 3
    corr = 10 * np.eye(3) + 90 * np.outer(v, v)
    (k, found), = A.splits(three_d(corr[np.triu_indices(3)]), schedule, 100.0)
    assert k == 0 and abs(abs(found @ v) - 1) < 1e-12
    halves = A.split(three_d(corr[np.triu_indices(3)]), 0, found, schedule)
    assert len(halves) == 2 and np.allclose(halves.y[0], -halves.y[1]) and np.allclose(halves.c, 50) and np.allclose(halves.p, 0.5)
    assert 0.05 * 3**0.5 - 1e-9 <= np.linalg.norm(halves.y[0]) <= 0.2 * 3**0.5 + 1e-9


def test_only_clusters_wide_large_unstable_and_old_enough_split():
    schedule = A.Schedule(Config(ParameterVectorDimension=3), 1.0, 0.1, 1.0, 3.0, 1.0)
    unstable, stable = np.diag([90.0, 10, 10])[np.triu_indices(3)], np.diag([40.0, 10, 10])[np.triu_indices(3)]
    assert A.splits(three_d(unstable), schedule, 100.0)
    for c in (three_d(stable), three_d(unstable, width2=1.5), three_d(unstable, c=4.0), three_d(unstable, priority=0)):
        assert not A.splits(c, schedule, 100.0)
    young = three_d(unstable, priority=2)
    assert [bool(A.splits(young, schedule, 100.0)) for _ in range(8)] == [False] * 3 + [True] * 5 and young.priority[0] == -1


def test_seeds_by_policy(spark):
    rows = spark.range(100).select(F.col("id").alias("idx"))
    label = lambda policy: [r.label for r in kmeans.initial_labels(rows, 7, policy).orderBy("idx").collect()]
    for policy in (-1, -2, -3, -4):
        assert set(label(policy)) <= set(range(7))
    assert label(-2)[:7] == list(range(7)) and label(-3)[::14][:7] == list(range(7)) and label(-4) == [min(i // 14, 6) for i in range(100)]
    assert len(set(label(-1))) > 1


def test_the_summary_grows(tmp_path):
    for x in ("one", "two"):
        writers.append_summary(str(tmp_path / "s"), [x, x])
    assert (tmp_path / "s").read_text().split() == ["one", "one", "two", "two"]


def test_facing_lists_bound_what_they_leave_out_while_centres_move():
    r = np.random.default_rng(6)
    y = r.normal(size=(300, 6))
    facing = kmeans.Facing.of(y, 20)
    assert facing.ids.shape == (300, 20) and facing.rebuilt == 300
    for step in (1e-3, 1e-3, 0.2):
        y = y + step * r.normal(size=y.shape)
        facing = facing.moved_to(y)
        apart = np.sqrt(((y[:, None] - y[None]) ** 2).sum(2))
        for k in range(300):
            listed = np.isin(np.arange(300), facing.ids[k])
            assert (facing.apart[k] - facing.slack[k] <= apart[k, facing.ids[k]] + 1e-9).all()
            others = ~listed & (np.arange(300) != k)
            assert (apart[k, others] >= facing.beyond[k] - facing.slack[k] - 1e-9).all()
            assert facing.half[k] <= np.delete(apart[k], k).min() / 2 + 1e-9
    assert facing.rebuilt == 600  # all lists once more after the long move, none after the short ones


@pytest.mark.parametrize("length", [1, 4, 64])
def test_nearest_by_lists_equals_all_distances(monkeypatch, length):
    r = np.random.default_rng(7)
    y = r.integers(0, 30, (200, 2)) * 1.0
    x = np.r_[r.uniform(0, 30, (2000, 2)), y[:50], y[:50] + 0.5]
    facing = kmeans.Facing.of(y, length)
    truth = kmeans.nearest(x, y, prune=False)
    for guess in (None, truth[0], r.integers(0, 200, len(x))):
        found = kmeans.nearest(x, y, facing=facing, guess=guess)
        assert (found[0] == truth[0]).all() and (found[1] == truth[1]).all()
    assert length < 64 or kmeans.nearest(x, y, facing=facing, guess=truth[0])[2] < 0.2 * truth[2]


def test_a_run_over_stored_bounds_has_the_trace_of_brute_force(spark):
    p, y = grid(spark, 5)
    start = y + np.random.default_rng(2).normal(size=y.shape) * 20
    traces = [kmeans.run(p, start, 12, cut=0.0, **how)[1] for how in ({"prune": False}, {}, {"bounds": True})]
    for other in traces[1:]:
        assert len(other) == len(traces[0]) and other[-1]["reason"] == traces[0][-1]["reason"]
        for a, b in zip(traces[0], other, strict=True):
            assert np.allclose([a[c] for c in ("change", "radius", "width")], [b[c] for c in ("change", "radius", "width")], rtol=1e-9)
    bounded = traces[2]
    assert bounded[0]["work"] == 1 and all(t["work"] < 0.2 for t in bounded[1:]) and all(t["bytes"] > 0 for t in bounded)
    assert kmeans.run(p, start, 2, cut=0.0)[1][-1]["reason"] == "round limit"


def test_loops_use_a_partition_a_core(spark):
    one = points(spark, [(i, float(i % 50), float(i)) for i in range(2000)]).select("point_id", F.array("x0", "x1").alias("x")).coalesce(1)
    dealt = A.spread(one)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 600
    same = A.spread(points(spark, [(i, 1.0, 1.0) for i in range(2000)]).select("point_id", F.array("x0", "x1").alias("x")))
    assert max(r["count"] for r in same.groupBy(F.spark_partition_id()).count().collect()) < 600  # equal points are parted by id


@pytest.mark.parametrize(("sponge", "scale"), [(None, 0.0), (3.0, 0.0), (None, 0.02)])
def test_clusters_by_range_give_the_sums_of_the_dense_kernel(spark, sponge, scale):
    from tempera.plans import ranged

    r = np.random.default_rng(4)
    x = r.uniform(0, 1000, (3000, 2)) * [1, 0.05]
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, x array<double>").repartition(3)
    y = r.uniform(0, 1000, (400, 2)) * [1, 0.05]
    s2 = np.tile([4.0, 9.0], (400, 1))
    if scale:
        s2[:, 0] = (scale * y[:, 0] + 1) ** 2
    now = (y, s2, r.dirichlet(np.ones(400)), 0.5, sponge)
    before = (y + r.normal(size=y.shape) * 0.3, s2, now[2], 0.6, sponge)
    dealt = ranged.deal(p, 2, 6)
    for was in (None, before):
        a, b = A.em_sums(p, now, was, 20.0, False, 8), dealt.sums(now, was, 20.0, 8)
        for name in a:
            if name != "work":
                assert np.allclose(a[name], b[name], rtol=1e-9, atol=1e-9), name
        assert b["work"].sum() < 0.3 * a["work"].sum() and dealt.sent < 0.6 * 6 * 400
    passes = dealt.bound_passes
    dealt.sums((y + 0.01, *now[1:]), None, 20.0, 8)
    assert dealt.bound_passes == passes + bool(scale)  # a short move needs no new bounds, unless scales differ


def test_a_step_with_200000_centres_stays_in_bounded_memory(spark):
    """As many centres as the largest known use, one pass, no array of centres by centres."""
    import resource

    from tempera.plans import ranged

    k = 200_000
    rows = spark.range(100_000).select(F.col("id").alias("point_id"), F.array(F.rand(1) * 100_000, F.rand(2) * 10).alias("x")).repartition(8)
    p = rows.persist()
    r = np.random.default_rng(1)
    y = np.c_[r.uniform(0, 100_000, k), r.uniform(0, 10, k)]
    now = (y, np.tile([0.25, 0.25], (k, 1)), np.full(k, 1 / k), 0.1, None)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    dealt = ranged.deal(p, 2, 16)
    out = dealt.sums(now, None, 20.0, 8)
    assert abs(out["c"].sum() - 100_000) < 1e-6 and dealt.sent < 1.1 * k
    assert out["work"].sum() < 0.002 * 100_000 * k
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000  # KB; a dense matrix would take 320 GB
    some = p.where("x[0] < 50")  # the same sums from all clusters near a few points
    near = np.flatnonzero(y[:, 0] < 60)
    dense = A.em_sums(some, (y[near], now[1][near], now[2][near], 0.1, None), None, 20.0, False, 8)
    inner = np.flatnonzero(y[near, 0] < 40)
    assert np.allclose(dense["c"][inner], out["c"][near][inner], rtol=1e-9, atol=1e-12)
    dealt.unpersist()
    p.unpersist()


def test_annealing_takes_ranges_for_many_clusters(spark, monkeypatch):
    p, y = grid(spark, 3)
    config = Config(SigmaMethod=1, SigmaVectorParameters_i=(1.0, 1.0), Tminimum=-2000.0, InitialCoolingFactor1=0.7, InitialCoolingFactor2=0.7, FineCoolingFactor1=0.7, FineCoolingFactor2=0.7, WaitIterations=1, ConvergenceLoopLimit=4)
    plain = A.anneal(p, config, max_clusters=9, max_steps=150)
    monkeypatch.setattr(A, "SENT_BYTES", 400)  # from six clusters on
    ranged_ = A.anneal(p, config, max_clusters=9, max_steps=150)
    assert len(plain.trace) == len(ranged_.trace) and np.allclose(plain.clusters.y, ranged_.clusters.y, atol=1e-6)


@pytest.mark.parametrize("sponge", [None, 2.5])
def test_passes_over_lists_give_the_sums_of_full_ones(spark, sponge):
    from tempera.plans.listed import Listed

    r = np.random.default_rng(9)
    x = r.uniform(0, 100, (4000, 2))
    p = A.packed(A.spread(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, x array<double>")), 2).persist()
    y, k, most = r.uniform(0, 100, (300, 2)), 300, 10
    s2, weights = np.tile([9.0, 16.0], (k, 1)), r.dirichlet(np.ones(k))
    state = lambda move, t: (y + move, s2, weights, t, sponge)
    listed, before = Listed(p, 2, 20.0, most), None
    steps = [r.normal(size=y.shape) * size for size in (0.0, 0.02, 0.02, 3.0, 0.02)]
    for step, move in enumerate(steps):
        now = state(sum(steps[: step + 1]), 1.0 - 0.1 * step)
        full, lists = A.em_sums(p, now, before, 20.0, True, most), listed.sums(now, before, 8)
        for name in full:
            if name != "work":
                assert np.allclose(full[name], lists[name], rtol=1e-8, atol=1e-8), (step, name)
        if step in (1, 2):
            assert listed.builds == 1 and listed.missed <= 0.05 and lists["work"].sum() < 0.5 * full["work"].sum()
        if step == 3:
            assert listed.missed > 0.05  # the long move; treated in full, and made anew next
        before = now
    assert listed.builds == 2 and listed.bytes > 0
    listed.close()


def test_lists_say_why_they_end():
    from tempera.operators.associated import lists

    x, y = np.array([[0.0], [50.0]]), np.array([[0.0], [1.0], [2.0], [3.0], [52.0]])
    state = (y, np.ones((5, 1)), np.full(5, 0.2), 0.5, None)
    ids, near, rest, status = lists(x, state, 5.0, 2)
    assert ids.tolist() == [[0, 1], [4, -1]] and status.tolist() == [2, 1] and rest.tolist() == [4.0, 4.0 + 5.0]
    assert near[0].tolist() == [0.0, 1.0] and near[1, 0] == 4.0
    _, _, rest, status = lists(x[:1], (*state[:3], 1e6, None), 5.0, 5)
    assert status.tolist() == [0] and np.isinf(rest).all()


def test_annealing_over_lists_follows_the_plain_path(spark, monkeypatch):
    p, y = grid(spark, 3)
    config = Config(SigmaMethod=1, SigmaVectorParameters_i=(1.0, 1.0), Tminimum=-2000.0, InitialCoolingFactor1=0.7, InitialCoolingFactor2=0.7, FineCoolingFactor1=0.7, FineCoolingFactor2=0.7, WaitIterations=1, ConvergenceLoopLimit=4, TargetNcentPerPoint=4)
    plain = A.anneal(p, config, max_clusters=9, max_steps=150)
    monkeypatch.setattr(A, "LISTED_FROM", 2)
    lists = A.anneal(p, config, max_clusters=9, max_steps=150)
    assert len(plain.trace) == len(lists.trace) and np.allclose(plain.clusters.y, lists.clusters.y, atol=1e-6)


def test_power_iteration_equals_the_eigenvectors(spark):
    from tempera.operators.power import products, widest

    r = np.random.default_rng(3)
    d, k = 12, 4
    x = np.concatenate([r.normal(size=(150, d)) * r.uniform(0.5, 3, d) + 8 * r.normal(size=d) for _ in range(k)])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, x array<double>").repartition(3)
    y = np.stack([x[150 * i : 150 * i + 150].mean(0) for i in range(k)])
    state = (y, np.tile(r.uniform(0.5, 2, d), (k, 1)), np.full(k, 1 / k), 2.0, None)
    sums = A.em_sums(p, state, None, 20.0)
    ks, upper = np.array([0, 2, 3]), np.triu_indices(d)
    v = r.normal(size=(3, d))
    full = []
    for i in ks:
        a = np.zeros((d, d))
        a[upper] = sums["corr"][i]
        full.append(a + np.triu(a, 1).T)
    got = products(A.packed(p, d), state, 20.0, None, ks, v)
    assert np.allclose(got, [a @ u for a, u in zip(full, v, strict=True)], rtol=1e-9)
    values, vectors, settled = widest(p, state, 20.0, None, ks)
    for a, value, u in zip(full, values, vectors, strict=True):
        w, e = np.linalg.eigh(a)
        assert abs(value - w[-1]) < 1e-3 * w[-1] and abs(u @ e[:, -1]) > 0.999
    assert settled.all() and not widest(p, state, 20.0, None, ks, most_rounds=2)[2].any()


def test_clusters_in_many_dimensions_split_without_matrices(spark, monkeypatch):
    r = np.random.default_rng(1)
    d = 20
    centres = np.zeros((2, d))
    centres[1, :4] = 30
    x = np.concatenate([c + r.normal(size=(120, d)) for c in centres])
    p = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, x array<double>")
    config = Config(ParameterVectorDimension=d, SigmaMethod=0, Tminimum=-3000.0, InitialCoolingFactor1=0.6, InitialCoolingFactor2=0.6, FineCoolingFactor1=0.6, FineCoolingFactor2=0.6, WaitIterations=1, ConvergenceLoopLimit=4)
    assert A.sums_width(d) == 7 + 2 * d
    found = A.anneal(p, config, max_clusters=2, max_steps=150).clusters
    assert len(found) == 2 and found.corr.shape[1] == 0
    assert np.allclose(found.y[np.argsort(found.y[:, 0])], centres, atol=1.0)


def many_clusters(spark, n=900, seed=2):
    r = np.random.default_rng(seed)
    rows = [(int(i), False, float(np.round(r.exponential(50), 1)), float(np.round(r.uniform(0, 40))), float(r.choice([1.0, 4.0, 25.0])), 9.0, 0.1, int(r.integers(1, 90))) for i in r.permutation(n)]
    rows += [(n + i, False, 5.0, 5.0, 1.0, 9.0, 0.1, 3) for i in range(90)]  # at one place
    return clusters(spark, [(9999, True, 0.0, 0.0, 1.0, 1.0, 0.1, 0), *rows]).repartition(5), [x for x in rows if not x[1]]


@pytest.mark.parametrize("range_size", [20_000, 100, 17])
def test_nearest_clusters_by_ranges_equal_brute_force(spark, range_size):
    from tempera.operators.quality import nearest_clusters

    df, rows = many_clusters(spark)
    found = {(r["cluster_id"], r["rank"]): (r["other"], r["d2"]) for r in nearest_clusters(df, 4, range_size).collect()}
    ids, y, s = np.array([r[0] for r in rows]), np.array([r[2:4] for r in rows]), np.array([r[4:6] for r in rows])
    assert len(found) == 4 * len(rows)
    for i, a, scale in zip(ids, y, s, strict=True):
        d2 = ((y - a) ** 2 / scale).sum(1)
        order = [j for j in np.lexsort((ids, d2)) if ids[j] != i][:4]
        assert [found[i, k + 1][0] for k in range(4)] == ids[order].tolist()
        assert np.allclose([found[i, k + 1][1] for k in range(4)], d2[order])
    few = nearest_clusters(df.where("cluster_id < 3"), 5, range_size)
    assert few.count() == 6 and nearest_clusters(df.where("is_sponge"), 5, range_size).count() == 0


def test_distances_of_solutions_by_blocks(spark, monkeypatch):
    df, rows = many_clusters(spark, 300)
    monkeypatch.setattr(compare, "BLOCK", 37)
    got = {r["bin"]: r["n"] for r in compare.solution_histograms(df, 20)[1].collect()}
    rows = sorted(rows)
    y, s = np.array([r[2:4] for r in rows]), np.array([r[4:6] for r in rows])
    d = np.concatenate([np.sqrt(((y[i:] - y[i]) ** 2 / s[i]).sum(1)) for i in range(len(rows))])
    at = np.minimum(np.floor((d - d.min()) * 20 / (d.max() - d.min())), 19).astype(int) + 1
    assert got == {int(b): int(n) for b, n in zip(*np.unique(at, return_counts=True), strict=True)}


def test_rounds_of_trimming_leave_no_longer_plans(spark):
    p = points(spark, [(i, 10.0 + (i % 10) / 10, float(i % 7)) for i in range(300)])
    names = p.select("point_id", (F.col("point_id") % 4).alias("cluster_id"))
    plans = [compare.trimmed_centers(p, names, (0.1, 3.0), rounds=n)._jdf.queryExecution().optimizedPlan().toString() for n in (1, 12)]
    assert len(plans[0].splitlines()) == len(plans[1].splitlines()) < 6


def test_rows_are_numbered_without_gaps(spark):
    from tempera.operators.numbering import numbered

    ids = [5, 70_000, -3, 1 << 40, (1 << 40) + 1, 65_535, 65_536, 0]
    got = {r.id: r.idx for r in numbered(spark.createDataFrame([(i,) for i in ids], "id long"), "id").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids))}


def test_callables_take_the_place_of_steps_of_kmeans(spark):
    p, y = grid(spark, 2)
    seen = []

    def search(x, y):
        d2 = np.abs(x[:, None] - y[None]).sum(2) ** 2  # city blocks
        best = d2.argmin(1)
        return best, d2[np.arange(len(x)), best], d2.size

    def radius(n, far, width):
        seen.append(n.sum())
        return np.sqrt(width / n)

    found, trace = kmeans.run(p, y + 5, 40, search=search, center=lambda old, n, total: old + 0.5 * (total / n[:, None] - old), radius=radius)
    assert np.allclose(found, y, atol=1) and len(seen) == len(trace) and all(s == p.count() for s in seen)
    halves = [b["change"] / a["change"] for a, b in zip(trace[:4], trace[1:4], strict=False)]
    assert np.allclose(halves, 0.5, atol=0.05) and trace[0]["work"] == 1
    with pytest.raises(ValueError, match="bounds"):
        kmeans.run(p, y, bounds=True, search=search)


def test_the_command_line_runs_a_file_to_its_outputs(spark, tmp_path):
    from tempera.plans import job

    r = np.random.default_rng(1)
    lines = [f"{i} {500 + 40 * (i % 3) + r.normal():.6f} {10 + 20 * (i % 3) + r.normal():.6f} 2 P {i % 3} {i % 3} {i % 3} {i % 5 + 1}" for i in range(150)]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    (tmp_path / "run.properties").write_text(
        f"LabelFile={tmp_path}/in.txt\nClusterFile={tmp_path}/out.txt\nTimingFile={tmp_path}/timings.txt\nSummaryFile={tmp_path}/summary.txt\nSelectedInputLabel=2\nSigmaMethod=1\nSigmaVectorParameters_i=1.0,1.0\nTminimum=-500\n"
        "InitialCoolingFactor1=0.8\nInitialCoolingFactor2=0.8\nFineCoolingFactor1=0.8\nFineCoolingFactor2=0.8\nWaitIterations=1\nConvergenceLoopLimit=6\nNumberNearbyClusters=2\nMaxNcentTotal=3\nHistogramOccupationMax=30\nHistogramDistancesMax=9\nNearbySpongePointLimit=4.0\nExpArgumentCut2=35\nExpArgumentCut3=45\n"
    )
    out = job.main(["-c", f"{tmp_path}/run.properties", "-n", "1", "-t", "4", "--set", "ClusterCountOutput=1"])
    assert len(out.result.clusters) == 3 and out.config.ClusterCountOutput == 1
    read = lambda name: [x.value for x in spark.read.text(f"file://{tmp_path}/out/{name}").collect()]
    assert len(read("clusters")) == 153 and "3 clusters of 150 points" in (tmp_path / "summary.txt").read_text()
    assert (tmp_path / "timings.txt").read_text().splitlines()[1].split("\t")[8:10] == ["150", "3"]
    bins = {r.bin: r.n for r in spark.read.parquet(f"file://{tmp_path}/out/occupations").collect()}
    assert bins == {29: 3}  # all three hold more than 30 points
    counts = spark.read.parquet(f"file://{tmp_path}/out/clusters-by-count").groupBy("count").count().collect()
    assert {r["count"] for r in counts} == {1, 2, 3} or len(counts) == 3
    none = job.run(spark, Config.from_properties((tmp_path / "run.properties").read_text(), {"ClusterCountOutput": "-1"}), f"file://{tmp_path}/silent")
    assert not (tmp_path / "silent" / "clusters").exists() and (tmp_path / "silent" / "status").exists() and none.result.by_count == []


def test_limits_for_distribution_and_created_clusters_come_from_the_configuration(spark, monkeypatch):
    p, y = grid(spark, 3)
    made = []
    from tempera.plans import ranged

    real = ranged.deal
    monkeypatch.setattr(ranged, "deal", lambda *a: made.append(a) or real(*a))
    base = {"SigmaMethod": 1, "SigmaVectorParameters_i": (1.0, 1.0), "Tminimum": -200.0, "InitialCoolingFactor1": 0.6, "InitialCoolingFactor2": 0.6, "FineCoolingFactor1": 0.6, "FineCoolingFactor2": 0.6, "WaitIterations": 1, "ConvergenceLoopLimit": 3}
    plain = A.anneal(p, Config(**base), max_clusters=4, max_steps=60)
    assert not made
    spread = A.anneal(p, Config(**base, ClusterLimitForDistribution=3), max_clusters=4, max_steps=60)
    assert len(made) == 1 and np.allclose(plain.clusters.y, spread.clusters.y, atol=1e-6)
    few = A.anneal(p, Config(**base, maxNcentCreated=3, MagicIndex=5), max_steps=60)
    assert len(few.clusters) <= 3 and few.limited and few.schedule.magic == 5


def test_a_restart_takes_the_centres_of_two_files(spark, tmp_path):
    from tempera.plans import job

    (tmp_path / "one.txt").write_text("0 1.0 1.0 0.0 1\n1 1.1 1.0 0.0 1\n2 9.0 9.0 0.0 0\n3 1.05 1.0 0.0 100000000\n4 0.0 0.0 0.0 100000000")
    (tmp_path / "two.txt").write_text("0 5.0 5.0 0.0 1\n1 5.5 5.0 0.0 1\n2 7.0 7.0 0.0 2\n3 5.25 5.0 0.0 100000000\n4 7.0 7.0 0.0 100000000")
    one = job.restart_rows(spark, Config(RestartClusterFile=f"{tmp_path}/one.txt", LabelFile=f"{tmp_path}/two.txt", InputFileType=0))
    both = job.restart_rows(spark, Config(RestartClusterFile=f"{tmp_path}/one.txt", LabelFile=f"{tmp_path}/two.txt", InputFileType=1))
    assert len(both) > len(one) and abs(sum(r["p"] for r in both) - 1) < 1e-9
    extra = [(r["y0"], r["y1"]) for r in both[len(one) :]]
    assert (7.0, 7.0) in extra or (5.25, 5.0) in extra


def events_table(spark, path, events):
    """Events of (second of the day, type, value, k)."""
    rows = [(i, i % 7, s, t, float(v), f'{{"k": {k}}}') for i, (s, t, v, k) in enumerate(events)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, s long, event_type string, value double, props string")
    e.select("event_id", F.timestamp_seconds(F.col("s") + 1704067200).alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.parquet(f"{path}/events.parquet")


def same_as_sql(spark, path, name, events):
    """Rows of a query, equal to those of its SQL."""
    import duckdb

    events_table(spark, path, events)
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    con.execute(f"create view events as select * replace (ts::timestamp as ts) from '{path}/events.parquet/*.parquet'")
    mine = [tuple(r) for r in queries.QUERIES[name](spark, str(path)).collect()]
    assert sorted(mine, key=str) == sorted(con.execute(queries.ORACLE_SQL[name]).fetchall(), key=str)
    return mine


NINE = [(36000 * (i % 3) + 60 * (j % 5), "view", 100 * (i // 3) + j % 4, 1) for i in range(9) for j in range(600 if i == 4 else 40)]


def test_registered_annealing_takes_as_many_clusters_as_there_are(spark, tmp_path):
    assert same_as_sql(spark, tmp_path, "anneal_invariants", NINE)[0][:2] == (920, 920)


def test_the_registered_run_ends_where_six_clusters_would_hold_back_a_split(spark, tmp_path):
    events_table(spark, tmp_path, NINE)
    found = queries.anneal_run(spark, str(tmp_path)).collect()
    assert found and abs(sum(r.c for r in found) - len(NINE)) < 1e-6


def test_the_registered_run_ends_where_splits_and_removals_could_follow_each_other_for_ever(spark, tmp_path, monkeypatch):
    n, run, ends = 6000, A.anneal, []
    events_table(spark, tmp_path, [(i * 3571 % 86400, "view", round(-50 * math.log(1 - (i * 7919 % n + 0.5) / n) * (i % 6 + 1), 2), 1) for i in range(n)])
    monkeypatch.setattr(A, "anneal", lambda *a, **k: ends.append(run(*a, **k, max_steps=300)) or ends[-1])
    found = queries.anneal_run(spark, str(tmp_path)).collect()
    assert len(found) > 2 and abs(sum(r.c for r in found) - n) < 1e-3
    assert ends[0].reason == "least temperature" and not ends[0].limited


def test_clusters_that_win_no_point_are_left_out_of_the_kernel_s_sums(spark, tmp_path):
    events = [(60 * (i % 5), "error" if i % 4 == 0 else "click", 10 + i % 5, 1) for i in range(40)] + [(40000, "view", 300 + i, 1) for i in range(5)]
    assert [r[0] for r in sorted(same_as_sql(spark, tmp_path, "em_kernel", events))] == [1, 5]


def test_labels_go_to_their_own_events_where_value_and_id_make_up_for_each_other(spark, tmp_path):
    events = [(5, "view", 9 - i, 2 + i) for i in range(6)] + [(5, "view", 3.0, 8), (5, "view", 2.0, 7)]
    assert sum(r[1] > 0 for r in same_as_sql(spark, tmp_path, "label_transfer", events)) == 4


def test_status_lines_round_ties_by_the_value_of_the_double(spark, tmp_path):
    events = [(60 * m, "view", 10 * m + 7 * m % 100 / 100 + (0 if i else 0.01), 1) for m in range(20) for i in range(8)]
    assert len(same_as_sql(spark, tmp_path, "status_lines", events)) == 20
