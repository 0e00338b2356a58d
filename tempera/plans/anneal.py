"""Clustering by annealing: expectation maximisation at a falling temperature, in which clusters
split along their most unstable direction and go when they are small or too close.

The points stay distributed; the driver holds the clusters. One iteration is one Spark job: an Arrow
kernel turns each batch into sums by cluster, with the memberships before and after from parameters
alone, so memberships are never stored and lineage doesn't grow. A batch of points that lie close together meets only
the clusters that its box can reach within the exponents' cut (``operators.boxes``); beyond ``SENT_BYTES`` of clusters a
task gets only those as well (``ranged``). At most the nearest ``TargetNcentPerPoint`` count. Partial sums are added in the
order of the partitions, which makes a run repeatable."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.functions.exprs import ANNEALED, PROPORTIONAL, UNIT
from tempera.operators.boxes import compact, met, part_of
from tempera.sources.config import Config

MIN_P = 1e-7
Y_CHANGE = 1e-6
#: Clusters of more bytes are sent only to the tasks that they reach.
SENT_BYTES = 1 << 20
#: In more dimensions than these, directions of splits come from power iteration instead of matrices by cluster.
MATRIX_DIMENSIONS = 16
#: Lists by point pay from so many times the clusters that count for a point.
LISTED_FROM = 6
#: Partial sums of at most so many rows are added on the driver, without a shuffle.
GATHERED_SUMS = 1 << 16


@dataclass
class Clusters:
    """What the driver knows of the clusters; the sponge, if any, is the first."""

    y: np.ndarray
    p: np.ndarray
    created: np.ndarray
    priority: np.ndarray
    sponge: bool = False
    c: np.ndarray | None = None
    freezing: np.ndarray | None = None
    width2: np.ndarray | None = None
    occupation: np.ndarray | None = None
    corr: np.ndarray | None = None
    dc: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.p)

    @property
    def own(self) -> np.ndarray:
        """True for clusters other than the sponge."""
        out = np.ones(len(self), bool)
        out[: int(self.sponge)] = False
        return out

    def keep(self, mask: np.ndarray) -> Clusters:
        """Without some clusters; the survivors' weights sum to one."""
        part = {k: v[mask] for k, v in self.__dict__.items() if isinstance(v, np.ndarray)}
        part["p"] = part["p"] / part["p"].sum()
        return replace(self, **part)


@dataclass
class Schedule:
    """Temperature and what depends on it."""

    config: Config
    t: float
    t_min: float
    t0: float
    sponge_factor: float
    sigma0: float
    sigma: Callable[[np.ndarray], np.ndarray] | None = None  # squared scales of centres, in place of a method
    magic: int = 0  # clean-ups done

    def sigma2(self, y: np.ndarray) -> np.ndarray:
        c = self.config
        if self.sigma:
            return np.array(self.sigma(y), float)
        if c.SigmaMethod == UNIT:
            return np.ones_like(y)
        s = np.tile(np.square(c.SigmaVectorParameters_i[: y.shape[1]]), (len(y), 1))
        if c.SigmaMethod >= PROPORTIONAL:
            s[:, 0] = np.square((self.sigma0 if c.SigmaMethod == ANNEALED else c.SigmaVectorParameters_i[0]) * y[:, 0])
        return s

    @property
    def metric(self) -> bool:
        """Whether all clusters have the same scales, so that scaled distances obey the triangle inequality."""
        return self.sigma is None and self.config.SigmaMethod < PROPORTIONAL

    def cleans_up(self) -> bool:
        """Whether the next of the magic temperatures is reached; then there is no cooling this time."""
        due = self.magic < len(self.config.MagicTemperatures) and self.t <= self.config.MagicTemperatures[self.magic]
        self.magic += due
        return due

    def cool(self, fine: bool) -> None:
        c = self.config
        late = self.t < c.CoolingTemperatureSwitch
        steps = (c.FineCoolingFactor1, c.FineCoolingFactor2) if fine else (c.InitialCoolingFactor1, c.InitialCoolingFactor2)
        ratio = steps[late]
        if c.UseSponge:
            self.sponge_factor = sponge_factor(c, self.t)
        if c.SigmaMethod == ANNEALED:
            self.sigma0 = next_sigma(c, self.t, self.sigma0, ratio)
        self.t *= ratio


def sponge_factor(c: Config, t: float) -> float:
    """Linear between the two temperatures, the second factor below, never less than it."""
    t1, t2 = c.SpongeTemperature1, c.SpongeTemperature2
    if t <= t2 or t1 <= t2:
        return c.SpongeFactor2
    return max(c.SpongeFactor2, c.SpongeFactor2 + (c.SpongeFactor1 - c.SpongeFactor2) * (t - t2) / (t1 - t2))


def next_sigma(c: Config, t: float, sigma0: float, ratio: float) -> float:
    """The first dimension's scale on its way to its last value at the target temperature."""
    if t <= c.FinalTargetTemperature:
        return c.FinalTargetSigma0
    step = np.log(ratio) * (np.log(c.FinalTargetSigma0) - np.log(sigma0)) / min(np.log(c.FinalTargetTemperature) - np.log(t), np.log(ratio))
    return max(c.FinalTargetSigma0, float(sigma0 * np.exp(step)))


def memberships(x: np.ndarray, y: np.ndarray, s2: np.ndarray, p: np.ndarray, t: float, sponge: float | None, cut: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Memberships and scaled square distances of a batch; ``sponge`` is the factor of the first one.
    Only the sponge and the nearest clusters, ``most`` together, count (all: None)."""
    d2 = sum((x[:, None, i] - y[None, :, i]) ** 2 / s2[None, :, i] for i in range(x.shape[1]))
    if sponge is not None:
        d2[:, 0] = sponge * sponge
    e = (d2 - d2.min(1, keepdims=True)) / t
    w = np.where(e < 2 * cut, np.maximum(MIN_P, p) * np.exp(-0.5 * e), 0.0)
    skip = int(sponge is not None)
    if most is not None and w.shape[1] > most:
        order = np.argsort(d2[:, skip:], 1, kind="stable")[:, max(1, most - skip) :] + skip
        np.put_along_axis(w, order, 0.0, 1)
    return w / w.sum(1, keepdims=True), d2


def _folded(rows: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    """Vectors ``v`` by keys, added in an order."""
    vs = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "v"))).alias("vs"))
    return vs.select(*keys, F.aggregate("vs", F.array_repeat(F.lit(0.0), width), lambda s, v: F.zip_with(s, v["v"], lambda a, b: a + b)).alias("v"))


def block_sums(x: np.ndarray, now: tuple, before: tuple | None, cut: float, most: int | None) -> np.ndarray:
    """Sums of some points by cluster, in the columns that ``sums_by_name`` names. Moments are taken about the points' middle."""
    y, s2, _, t, _ = now
    m, d2 = memberships(x, *now, cut, most)
    moved = np.abs(m - memberships(x, *before, cut, most)[0]).sum(0) if before else np.full(len(y), np.inf)
    d, middle, m2 = x.shape[1], x.mean(0), m * m
    pairs = pairs_of(d)
    xc, off = x - middle, middle - y  # x - y = xc + off
    moments = m.T @ np.c_[np.ones(len(x)), xc, np.stack([xc[:, i] * xc[:, j] for i, j in pairs] or [xc[:, 0]], 1)]
    size, first, second = moments[:, 0], moments[:, 1 : 1 + d], moments[:, 1 + d :]
    square = m2.T @ np.c_[np.ones(len(x)), xc]
    quarter = (size / 2 - square[:, 0] / 4)[:, None] * off + first / 2 - square[:, 1:] / 4  # of half (1 - half) (x - y)
    columns = [size, size - square[:, 0], (m * d2).sum(0), moved, np.bincount(m.argmax(1), minlength=len(y)), np.full(len(y), len(x)), (m > 0).sum(0)]
    columns += list((first + size[:, None] * middle).T)
    columns += list((quarter / (np.sqrt(s2) * t)).T)
    columns += [(second[:, n] + off[:, i] * first[:, j] + off[:, j] * first[:, i] + size * off[:, i] * off[:, j]) / (2 * t * np.sqrt(s2[:, i] * s2[:, j])) for n, (i, j) in enumerate(pairs)]
    return np.stack(columns, 1)


def pairs_of(d: int) -> list[tuple[int, int]]:
    """Places of the upper triangle of a cluster's correlations, none where there are too many dimensions."""
    return [(i, j) for i in range(d) for j in range(i, d)] if d <= MATRIX_DIMENSIONS else []


def sums_width(d: int) -> int:
    return 7 + d + d + len(pairs_of(d))


def sums_by_name(v: np.ndarray, d: int) -> dict[str, np.ndarray]:
    """``v`` has a row a cluster. ``work`` counts the memberships that were computed, ``useful`` those above zero."""
    c = v[:, 0]
    safe, at = np.maximum(c, 1e-300), 7 + d
    return {"c": c, "freezing": v[:, 1] / safe, "width2": v[:, 2] / safe, "moved": v[:, 3], "occupation": v[:, 4], "work": v[:, 5], "useful": v[:, 6], "mean": v[:, 7:at] / safe[:, None], "dc": v[:, at : at + d], "corr": v[:, at + d :]}


def added_up(x: np.ndarray, now: tuple, before: tuple | None, cut: float, most: int | None, prune: bool, total: np.ndarray, ordered: bool = False) -> None:
    """Add the sums of points to ``total``, a row a cluster."""
    for rows, cols in met(x, now, before, cut, ordered) if prune else [(np.arange(len(x)), np.arange(len(now[0])))]:
        mine, was = part_of(now, cols), part_of(before, cols)
        for r in np.array_split(rows, max(1, len(rows) * len(cols) >> 18)):
            total[cols] += block_sums(x[r], mine, was, cut, most)


def em_sums(points: DataFrame, now: tuple, before: tuple | None, cut: float, prune: bool = False, most: int | None = None, many_parts: bool = False, parts: int | None = None) -> dict[str, np.ndarray]:
    """One pass: sums by cluster under ``now`` (y, s2, p, t, sponge factor), and how far memberships
    moved from those under ``before``. ``prune``: batches of points meet only the clusters that their box can
    reach. ``points`` have ``x`` or are ``packed``. ``many_parts``: add the partitions' sums in blocks of 256 first. ``parts``: how many partitions there are, if known."""
    k, d = now[0].shape
    packed = points.columns == ["xs"]
    if before is not None and before[0].shape != now[0].shape:
        before = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((k, sums_width(d)))
        for batch in batches:
            for x in unpacked(batch.column(0), d) if packed else [batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)]:
                added_up(x, now, before, cut, most, prune, total, packed)
        part, some = TaskContext.get().partitionId(), np.flatnonzero(total[:, 5])
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int64()), pa.array([part >> 8] * len(some), pa.int64()), pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], ["part", "block", "k", "v"])

    rows = (points if packed else points.select("x")).mapInArrow(run, "part long, block long, k long, v array<double>")
    return sums_by_name(collected(rows, k, sums_width(d), many_parts, parts), d)


def unpacked(column: pa.Array, d: int) -> Iterator[np.ndarray]:
    for packed in column:
        yield np.frombuffer(packed.as_buffer(), np.float64).reshape(-1, d)


def packed(points: DataFrame, d: int) -> DataFrame:
    """Points (x) as ``xs``, some thousands to a row, in an order that keeps close ones together: read in every pass, they
    cost a copy of bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            if len(x):
                spread = np.maximum(x.std(0), 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array([x[compact(x, spread)].tobytes()], pa.binary())], ["xs"])

    return points.select("x").mapInArrow(run, "xs binary")


def collected(rows: DataFrame, k: int, width: int, many_parts: bool = False, parts: int | None = None) -> np.ndarray:
    """Partial sums (part, block, k, v) added in the order of the parts, a row a cluster."""
    if parts and parts * k <= GATHERED_SUMS:
        found, out = rows.toArrow(), np.zeros((k, width))
        order = np.lexsort((found.column("part").to_numpy(),))
        np.add.at(out, found.column("k").to_numpy()[order], found.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order])
        return out
    added = _folded(_folded(rows, ["k", "block"], "part", width), ["k"], "block", width) if many_parts else _folded(rows, ["k"], "part", width)
    found, out = added.toArrow(), np.zeros((k, width))
    out[found.column("k").to_numpy()] = found.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def labels(points: DataFrame, c: Clusters, schedule: Schedule) -> DataFrame:
    """``point_id, cluster_id`` (long): the cluster of the greatest membership, the first of equals; the
    sponge, if any, is 0."""
    now = (c.y, schedule.sigma2(c.y), c.p, schedule.t, schedule.sponge_factor if c.sponge else None)
    cut, most, d = schedule.config.ExpArgumentCut1, schedule.config.TargetNcentPerPoint or None, c.y.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            out = np.zeros(len(x), np.int64)
            for rows, cols in met(x, now, None, cut):
                for r in np.array_split(rows, max(1, len(rows) * len(cols) >> 18)):
                    out[r] = cols[memberships(x[r], *part_of(now, cols), cut, most)[0].argmax(1)]
            yield pa.RecordBatch.from_arrays([batch.column("point_id"), pa.array(out)], ["point_id", "cluster_id"])

    return points.select(F.col("point_id").cast("long"), "x").mapInArrow(run, "point_id long, cluster_id long")


@dataclass
class Result:
    clusters: Clusters
    schedule: Schedule
    trace: list[tuple[int, float, int, float]] = field(default_factory=list)  # step, temperature, clusters, H
    limited: bool = False  # whether the cluster limit held back a split
    restored: bool = False  # whether the solution of the least H was taken in place of the last
    work: float = 0.0  # memberships computed, as a share of points times clusters
    reason: str = ""  # what ended the run; "step limit" if it isn't finished
    by_count: list[tuple[float, Clusters]] = field(default_factory=list)  # with ClusterCountOutput 1: temperature and clusters when their number changed


def hamiltonian(c: Clusters) -> float:
    return float(0.5 * (c.width2 * c.c).sum())


def initial(points: DataFrame, config: Config, sigma: Callable | None = None) -> tuple[Clusters, Schedule]:
    """One cluster at the mean (and the sponge), the temperature from the spread."""
    d = config.ParameterVectorDimension
    mean = np.array(points.agg(*[F.avg(F.get("x", F.lit(i))) for i in range(d)]).first(), float)
    schedule = Schedule(config, 1.0, 0.0, 1.0, config.SpongeFactor1, config.InitialSigma0 or config.SigmaVectorParameters_i[0], sigma)
    s2 = schedule.sigma2(mean[None])[0]
    d2 = sum((F.get("x", F.lit(i)) - float(mean[i])) ** 2 / float(s2[i]) for i in range(d))
    schedule.t = schedule.t0 = 1.5 * points.agg(F.avg(d2)).first()[0]
    schedule.t_min = config.Tminimum if config.Tminimum > 0 else schedule.t0 / abs(config.Tminimum)
    sponge = config.UseSponge and not sponge_later(config)
    k = 1 + sponge
    y = np.tile(mean, (k, 1))
    return Clusters(y, np.full(k, 1.0 / k), np.arange(k), np.full(k, 2), sponge), schedule


def sponge_later(config: Config) -> bool:
    """Whether the sponge waits for a temperature or a width."""
    return config.SpongeTemperature1 > 0 or config.CreateSpongeScaledSquaredWidth > 0


def wants_sponge(c: Clusters, schedule: Schedule) -> bool:
    cfg = schedule.config
    narrow = (c.width2 * c.c).sum() / c.c.sum() <= cfg.CreateSpongeScaledSquaredWidth
    return cfg.UseSponge and not c.sponge and (narrow or schedule.t < cfg.SpongeTemperature1)


def with_sponge(c: Clusters, config: Config) -> Clusters:
    """The same clusters behind a new sponge, whose weight they give up in proportion."""
    ps = config.SpongePWeight / (len(c) + 1)
    out = {k: np.concatenate([v[:1] * 0, v]) for k, v in c.__dict__.items() if isinstance(v, np.ndarray)}
    out["p"] = np.r_[ps, c.p * (1 - ps)]
    out["created"][0] = c.created.max() + 1
    out["y"][0] = c.y[0]
    return replace(c, sponge=True, **out)


def restarted(state: list, config: Config, sigma: Callable | None = None) -> tuple[Clusters, Schedule]:
    """Clusters of a former run (rows of ``sources.text.restart_state``), the sponge first, at the
    restart temperature."""
    rows = sorted(state, key=lambda r: (not r["is_sponge"], r["cluster_id"]))
    sponge = bool(rows and rows[0]["is_sponge"])
    y = np.array([[r["y0"] or 0.0, r["y1"] or 0.0] for r in rows])
    t = config.RestartTemperature
    schedule = Schedule(config, t, config.Tminimum if config.Tminimum > 0 else t / abs(config.Tminimum), t, config.SpongeFactor1, config.InitialSigma0 or config.SigmaVectorParameters_i[0], sigma)
    return Clusters(y, np.array([r["p"] for r in rows]), np.arange(len(rows)), np.full(len(rows), 2), sponge), schedule


def update_p(c: Clusters, config: Config, n: float) -> np.ndarray:
    p = c.c / n
    if c.sponge and config.SpongePOption == 1:
        ps = config.SpongePWeight / len(p)
        p = np.where(c.own, p * (1 - ps) / max(1e-300, 1 - p[0]), ps)
    return p


def tests_closeness(t: float, last: float | None, config: Config) -> bool:
    """Below its temperature, and not again before the temperature fell by a quarter."""
    return t < config.TemperatureForClosenessTest and (last is None or t < last - 0.25)


def invalid(c: Clusters, schedule: Schedule, closeness: bool = True) -> np.ndarray:
    """Clusters that are too small, or (``closeness``) too close to one with more points."""
    cfg = schedule.config
    small = c.c < (cfg.MinimumCountForClusterCkWithSponge if c.sponge else cfg.MinimumCountForClusterCk)
    small |= c.occupation < cfg.MinimuCountForClusterPoints
    close = np.zeros(len(c), bool)
    if closeness:
        s2, limit = schedule.sigma2(c.y), cfg.ScaledSquaredDistanceAtClosenessTest
        order = np.flatnonzero(c.own)[np.argsort(c.y[c.own, 0], kind="stable")]
        at, width = c.y[order, 0], np.sqrt(limit * s2[:, 0])
        first, last = np.searchsorted(at, c.y[:, 0] - width, "left"), np.searchsorted(at, c.y[:, 0] + width, "right")
        for k in np.flatnonzero(c.own & ~small):
            near = order[first[k] : last[k]]  # the others are too far off in the first dimension alone
            near = near[((c.y[near] - c.y[k]) ** 2 / s2[k]).sum(1) < limit]
            close[k] = ((c.occupation[near] > c.occupation[k]) | ((c.occupation[near] == c.occupation[k]) & (near < k))).any()
    return (small | close) & c.own


def splits(c: Clusters, schedule: Schedule, n: float, widest: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None) -> list[tuple[int, np.ndarray]]:
    """Clusters to split, most urgent first, with the unit vector of their least eigenvalue. ``widest`` gives the greatest
    eigenvalue and its vector of the correlations of clusters whose matrices weren't summed."""
    cfg, d = schedule.config, c.y.shape[1]
    ks = np.flatnonzero(c.own & (c.width2 > cfg.MinimumScaledWidthSquaredToSplit) & (c.c > cfg.TooSmallToSplit) & (c.priority != 0))
    aged = ks[c.priority[ks] >= 1]
    c.priority[aged] = np.where(c.priority[aged] >= 8, -1, c.priority[aged] + 1)
    ks = ks[(c.priority[ks] < 0) | (c.priority[ks] >= 6)]
    if not len(ks):
        return []
    if widest is not None:
        most, vectors = widest(ks)
        values = c.c[ks] / 2 - most
    else:
        a = np.zeros((len(ks), d, d))
        a[:, *np.triu_indices(d)] = c.corr[ks]
        a = np.eye(d) * c.c[ks, None, None] / 2 - (a + np.triu(a, 1).transpose(0, 2, 1))
        values, vectors = np.linalg.eigh(a)
        values, vectors = values[:, 0], vectors[:, :, 0]
    priority = c.priority[ks]
    urgency = np.where(priority > 0, priority - 10, 0) + 20 * (c.c[ks] >= 2 * n / len(c)) + 20 * (c.c[ks] >= 6 * n / len(c))
    found = [(-int(urgency[i]), float(values[i]), int(ks[i]), vectors[i]) for i in np.flatnonzero(values < 0)]
    found.sort(key=lambda x: x[:3])
    return [(k, v) for _, _, k, v in found[: cfg.MaxNumberSplitClusters]]


def split(c: Clusters, k: int, v: np.ndarray, schedule: Schedule) -> Clusters:
    """The cluster and its new twin move apart along ``v``; size and weight are halved."""
    s, w = np.sqrt(schedule.sigma2(c.y[k : k + 1])[0]), np.sqrt(c.width2[k])
    along = float(v @ c.dc[k])
    step = np.clip(abs(0.025 * c.c[k] / along) if along else np.inf, 0.05 * w, 0.2 * w)
    out = {name: np.concatenate([x, x[k : k + 1]]) for name, x in c.__dict__.items() if isinstance(x, np.ndarray)}
    out["y"][k], out["y"][-1] = c.y[k] + v * step * s, c.y[k] - v * step * s
    for name in ("p", "c"):
        out[name][k] = out[name][-1] = out[name][k] / 2
    out["priority"][k] = out["priority"][-1] = 2
    out["created"][-1] = c.created.max() + 1
    return replace(c, **out)


def anneal(points: DataFrame, config: Config, max_clusters: int | None = None, max_steps: int = 5000, restart: list | None = None, sigma: Callable[[np.ndarray], np.ndarray] | None = None) -> Result:
    """Run to the end of the schedule, from one cluster or from a former run's state. ``points`` have
    ``x`` (array<double>); persist them first. The limit on clusters, sponge included, is ``max_clusters``
    or else ``MaxNcentTotal``, whose default of 0 sets none. ``sigma`` gives the squared scales of centres
    (a row each) in place of the configured method. The points are dealt anew, to a partition a core at
    least (``spread``)."""
    config = config.checked()
    limit_k = max_clusters if max_clusters is not None else config.MaxNcentTotal or sys.maxsize
    most = config.TargetNcentPerPoint if config.TargetNcentPerPoint > 0 else None
    points = spread(points)
    passes = Passes(points, config)
    try:
        return _annealed(points, passes, config, limit_k, most, max_steps, restart, sigma)
    finally:
        passes.close()
        points.unpersist()


def spread(points: DataFrame) -> DataFrame:
    """Points dealt by ranges of their first dimension (equal ones by ``point_id``) to at least as many partitions as there
    are cores, persisted: partitions of points that lie together have batches with small boxes."""
    parts = max(points.sparkSession.sparkContext.defaultParallelism, points.rdd.getNumPartitions())
    salt = F.xxhash64("point_id") if "point_id" in points.columns else F.lit(0)
    rows = points.select(*[c for c in ("point_id", "x") if c in points.columns], F.get("x", F.lit(0)).alias("_first"), salt.alias("_salt"))
    return rows.repartitionByRange(parts, "_first", "_salt").drop("_first", "_salt").persist()


class Passes:
    """Passes over the same points: all clusters to every task, or, where they are very many (or the configuration's limits for
    distribution are met), to those that they reach; where there are far more than count for a point, over lists kept by point."""

    def __init__(self, points: DataFrame, config: Config):
        self.points, self.d, self.dealt, self.listed, self.config = points, config.ParameterVectorDimension, None, None, config
        d = self.d
        self.packed = packed(points, d).persist()
        self.parts = points.rdd.getNumPartitions()

    def sums(self, now: tuple, before: tuple | None, cut: float, prune: bool, most: int | None) -> dict[str, np.ndarray]:
        cfg = self.config
        many = 16 * (2 * self.d + 1) * len(now[0]) > SENT_BYTES or 0 < cfg.ClusterLimitForDistribution <= len(now[0]) or now[3] < cfg.TemperatureLimitForDistribution
        if not many:
            if prune and most is not None and len(now[0]) >= LISTED_FROM * most:
                from tempera.plans.listed import Listed

                self.listed = self.listed or Listed(self.packed, self.d, cut, most, max(cut, cfg.ExpArgumentCut2))
                return self.listed.sums(now, before, self.parts)
            return em_sums(self.packed, now, before, cut, prune, most, self.parts > 256, self.parts)
        if self.dealt is None:
            from tempera.plans.ranged import deal

            self.dealt = deal(self.points, self.d)
        return self.dealt.sums(now, before, cut, most, max(cut, cfg.ExpArgumentCut3))

    def widest(self, state: tuple, cut: float, most: int | None) -> Callable | None:
        """Power iteration for some clusters of a state, where their matrices aren't summed."""
        if self.d <= MATRIX_DIMENSIONS:
            return None
        from tempera.operators.power import widest

        return lambda ks: widest(self.packed, state, cut, most, ks, self.parts)[:2]

    def expire(self) -> None:
        """Lists by point are made anew in the next pass."""
        if self.listed is not None:
            self.listed.close()
            self.listed.at = None

    def close(self) -> None:
        self.packed.unpersist()
        if self.dealt is not None:
            self.dealt.unpersist()
        if self.listed is not None:
            self.listed.close()


def _annealed(points: DataFrame, passes: Passes, config: Config, limit_k: int, most: int | None, max_steps: int, restart: list | None, sigma: Callable | None) -> Result:
    n = float(points.count())
    c, schedule = restarted(restart, config, sigma) if restart else initial(points, config, sigma)
    schedule.magic = config.MagicIndex
    out, before, since, waited, final, rises, last_h, fine = Result(c, schedule), None, 0, 0, False, 0, None, False
    best: tuple[Clusters, float] | None = None  # the solution when H last fell
    close_at, done, asked, wait = None, 0.0, 0.0, config.WaitIterations
    for step in range(max_steps):
        now = (c.y, schedule.sigma2(c.y), c.p, schedule.t, schedule.sponge_factor if c.sponge else None)
        sums = passes.sums(now, before if since else None, config.ExpArgumentCut1, schedule.metric and len(c) >= 8, most)
        if abs(sums["c"].sum() - n) > max(0.5, 1e-6 * n):
            raise ArithmeticError("memberships don't sum to the points")
        done, asked = done + sums["work"].sum(), asked + n * len(c)
        c = replace(c, **{k: sums[k] for k in ("c", "freezing", "width2", "occupation", "corr", "dc")})
        moved = sums["moved"].sum() / n
        c.p = update_p(c, config, n)
        y = np.where((c.own & (c.c > config.CountForClusterCkToBeZero))[:, None], sums["mean"], c.y)
        shift = ((y - c.y) ** 2 / now[1])[c.own].sum(1).mean()
        c.y, before, since = y, now, since + 1
        limit = config.MalphaMaxChange1 if final else config.MalphaMaxChange
        settled = since > 1 and moved <= limit and (not final or shift <= Y_CHANGE * max(1e-300, c.width2[c.own].mean()))
        if not settled and since < config.ConvergenceLoopLimit:
            continue
        h = hamiltonian(c)
        out.trace.append((step, schedule.t, len(c), h))
        if config.ClusterCountOutput > 0 and (not out.by_count or len(out.by_count[-1][1]) != len(c)):
            out.by_count.append((schedule.t, replace(c, **{k: v.copy() for k, v in c.__dict__.items() if isinstance(v, np.ndarray)})))
        falls = last_h is None or h <= last_h
        if falls:
            best = replace(c, **{k: v.copy() for k, v in c.__dict__.items() if isinstance(v, np.ndarray)}), h
        closeness = tests_closeness(schedule.t, close_at, config)
        close_at = schedule.t if closeness else close_at
        gone = invalid(c, schedule, closeness)
        if gone.any() and gone.sum() < c.own.sum():
            c, before, since, last_h, waited, wait = c.keep(~gone), None, 0, None, 0, config.WaitIterationsConverge
            continue
        if final:
            rises += not falls
            frozen = bool((c.freezing[c.own] <= config.FreezingLimit).all())
            if frozen or rises >= 5 or schedule.t <= schedule.t_min or len(out.trace) > config.IterationAtEnd:
                out.reason = "frozen" if frozen else "H rises" if rises >= 5 else "least temperature"
                out.restored = best is not None and len(best[0]) == len(c) and best[1] < h
                c = best[0] if out.restored else c
                break
        elif schedule.t <= schedule.t_min:
            final = True
        last_h = h
        if not final and wants_sponge(c, schedule):
            c, before, since, last_h = with_sponge(c, config), None, 0, None
            continue
        waited += 1
        if waited > wait:
            waited, wait = 0, config.WaitIterations
        # So many temperatures must pass after splits and removals; without them, at one temperature, these could follow each other for ever.
        splitting, room = not final and (waited == 0 or wait <= 0 or len(c) == 1), max(0, limit_k - len(c))
        chosen = splits(c, schedule, n, passes.widest(before, config.ExpArgumentCut1, most)) if splitting else []
        if config.maxNcentCreated > 0:
            room = max(0, min(room, config.maxNcentCreated - 1 - int(c.created.max())))
        out.limited |= len(chosen) > room
        if chosen and room:
            for k, v in chosen[:room]:
                c = split(c, k, v, schedule)
            before, since, waited, wait, fine, last_h = None, 0, 0, config.WaitIterations, True, None
            continue
        if schedule.cleans_up():
            passes.expire()
            before, since, waited, last_h = None, 0, 0, None
            continue
        schedule.cool(fine)
        since = 0 if since >= config.ConvergenceLoopLimit else 1
    else:
        out.reason = "step limit"
    out.clusters, out.schedule, out.work = c, schedule, done / max(1.0, asked)
    return out
