"""K-means over vectors of any length: a relational step, and a loop whose Arrow kernel skips centres
that the triangle inequality rules out.

``points`` have ``point_id, x`` (array<double>); centres are a small matrix on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.functions.exprs import array_squared_distance
from tempera.operators.em import once
from tempera.sources.scratch import Written

FACING = 64  # centres in the list of a centre
LISTED = 8  # centres in the list of a point
GATHERED_SUMS = 1 << 16  # partial sums of at most so many rows are added on the driver, without a shuffle


def centers_of(points: DataFrame, label: str) -> DataFrame:
    """Means by label: ``cluster_id, y, n``. Places are summed on the map side."""
    rows = points.select(F.col(label).alias("cluster_id"), F.posexplode("x").alias("i", "v"))
    means = rows.groupBy("cluster_id", "i").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return means.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("y"), F.max("n").alias("n"))


def assign(points: DataFrame, centers: DataFrame) -> DataFrame:
    """``cluster_id`` and ``d2`` of the nearest centre; the least id of equals. The centres ride along
    as one broadcast row."""
    row = centers.agg(F.sort_array(F.collect_list(F.struct("cluster_id", "y"))).alias("cs"))
    near = F.array_min(F.transform("cs", lambda c: F.struct(array_squared_distance(F.col("x"), c["y"]).alias("d2"), c["cluster_id"].alias("cluster_id"))))
    rows = once(points.crossJoin(F.broadcast(row)).withColumn("_n", near), "_n")
    return rows.withColumns({"cluster_id": F.col("_n.cluster_id"), "d2": F.col("_n.d2")}).drop("cs", "_n")


def update(assigned: DataFrame, centers: DataFrame) -> DataFrame:
    """New centres with size, radius and width; an empty cluster keeps its centre, with radius 0."""
    new = centers_of(assigned.where("cluster_id is not null"), "cluster_id").select("cluster_id", F.col("y").alias("_y"), "n")
    own = assigned.join(F.broadcast(new), "cluster_id").withColumn("_d2", array_squared_distance(F.col("x"), F.col("_y")))
    spread = own.groupBy("cluster_id").agg(F.sqrt(F.max("_d2")).alias("radius"), F.sum("_d2").alias("width"))
    out = centers.select("cluster_id", "y").join(new, "cluster_id", "left").join(spread, "cluster_id", "left")
    return out.select("cluster_id", F.coalesce("_y", "y").alias("y"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("width", F.lit(0.0)).alias("width"))


@dataclass
class Facing:
    """For each centre its nearest others in ascending order, at most so many, and ``beyond``, below which no other one is.
    Centres that move widen all by ``slack``; a centre's list is made anew only when its own slack is a tenth of its ``beyond``.
    Distances are lower bounds, by what rounding may have added."""

    y: np.ndarray
    ids: np.ndarray
    apart: np.ndarray
    beyond: np.ndarray
    slack: np.ndarray
    rebuilt: int = 0  # lists made

    @staticmethod
    def of(y: np.ndarray, length: int = FACING) -> Facing:
        length = min(length, len(y) - 1)
        out = Facing(y.copy(), np.zeros((len(y), length), np.int32), np.zeros((len(y), length)), np.full(len(y), np.inf), np.zeros(len(y)))
        out._list(np.arange(len(y)))
        return out

    def _list(self, ks: np.ndarray) -> None:
        """Make the lists of some centres, a block of rows at a time."""
        y, length, norm = self.y, self.ids.shape[1], (self.y * self.y).sum(1)
        for part in np.array_split(ks, max(1, len(ks) * len(y) >> 21)):
            d2 = norm[part, None] + norm - 2 * (y[part] @ y.T)
            d2 = np.maximum(d2 - 1e-12 * (norm[part, None] + norm), 0.0)
            d2[np.arange(len(part)), part] = np.inf
            if length < len(y) - 1:
                near = np.argpartition(d2, length, 1)[:, : length + 1]
                near = np.take_along_axis(near, np.argsort(np.take_along_axis(d2, near, 1), 1, kind="stable"), 1)
                self.beyond[part] = np.sqrt(d2[np.arange(len(part)), near[:, length]])
            else:
                near = np.argsort(d2, 1, kind="stable")
            self.ids[part] = near[:, :length]
            self.apart[part] = np.sqrt(np.take_along_axis(d2, near[:, :length], 1))
        self.slack[ks] = 0.0
        self.rebuilt += len(ks)

    def moved_to(self, y: np.ndarray) -> Facing:
        """The same lists for centres that moved."""
        move = np.sqrt(((y - self.y) ** 2).sum(1)) * (1 + 1e-12)
        out = Facing(y.copy(), self.ids.copy(), self.apart.copy(), self.beyond.copy(), self.slack + move + move.max(initial=0), self.rebuilt)
        edge = np.where(np.isfinite(out.beyond), out.beyond, out.apart.max(1, initial=0))
        out._list(np.flatnonzero(out.slack > 0.1 * edge))
        return out

    @property
    def half(self) -> np.ndarray:
        """Half the way from each centre to the nearest other one, at most."""
        return np.maximum(self.apart.min(1, initial=np.inf) - self.slack, 0.0) / 2


def _blocks(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Square distances of rows to columns, some rows at a time."""
    for part in np.array_split(rows, max(1, len(rows) * len(cols) * x.shape[1] >> 20)):
        if len(part):
            yield part, ((x[part][:, None] - y[cols][None]) ** 2).sum(2)


def nearest(x: np.ndarray, y: np.ndarray, prune: bool = True, facing: Facing | None = None, guess: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centre of each row (the first of equals), its square distance, and how many distances
    were computed. From a guess (else the best of a few centres spread over the list) only the centres that face it within twice
    its distance can be nearer. Where its list ends before that, the best found is the next guess; a row whose
    guess doesn't change then meets all centres."""
    every = np.arange(len(y))
    best, d2, done = np.zeros(len(x), np.int64), np.full(len(x), np.inf), 0
    if not prune or len(y) < 2:
        for part, block in _blocks(x, y, np.arange(len(x)), every):
            best[part] = block.argmin(1)
            d2[part] = block[np.arange(len(part)), best[part]]
        return best, d2, len(x) * len(y)
    facing = facing or Facing.of(y)
    if guess is None:
        guesses = np.arange(0, len(y), max(1, int(len(y) ** 0.5)))
        for part, block in _blocks(x, y, np.arange(len(x)), guesses):
            at = block.argmin(1)
            best[part], d2[part] = guesses[at], block[np.arange(len(part)), at]
        done += len(x) * len(guesses)
    else:
        best = guess.astype(np.int64)
        d2 = ((x - y[best]) ** 2).sum(1)
        done += len(x)

    def better(part: np.ndarray, cols: np.ndarray, block: np.ndarray) -> None:
        low = block.min(1)
        at = np.where(block == low[:, None], cols, len(y)).min(1)
        wins = (low < d2[part]) | ((low == d2[part]) & (at < best[part]))
        best[part[wins]], d2[part[wins]] = at[wins], low[wins]

    todo = np.arange(len(x))
    while len(todo):
        reach, left = 2 * np.sqrt(d2[todo]) * (1 + 1e-12), []
        began = best[todo].copy()
        order = np.argsort(began, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(began[order])) + 1):
            c = began[rows[0]]
            apart = facing.apart[c] - facing.slack[c]
            n = np.searchsorted(apart, reach[rows], "right")
            size = np.where(n > 0, np.minimum(len(apart), 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(int)), 0)
            for k in np.unique(size[size > 0]):
                cols = facing.ids[c, :k]
                for part, block in _blocks(x, y, todo[rows[size == k]], cols):
                    better(part, cols, block)
                done += int((size == k).sum()) * int(k)
            left.append(rows[reach[rows] >= facing.beyond[c] - facing.slack[c]])
        left = np.concatenate(left)
        stuck = todo[left[best[todo[left]] == began[left]]]
        for part, block in _blocks(x, y, stuck, every):
            better(part, every, block)
        done += len(stuck) * len(y)
        todo = todo[left[best[todo[left]] != began[left]]]
        todo = np.setdiff1d(todo, stuck)
    return best, d2, done


def scan(points: DataFrame, centers: np.ndarray, length: int = LISTED) -> DataFrame:
    """``points`` (point_id, x) with ``cluster_id`` (the row of the nearest centre), ``upper``, their
    distance to it, ``ids`` and ``lows`` of the next nearest centres with bounds from below, ``rest``, such a bound for all others, and
    ``lower``, one for all but the nearest: the state of ``rescan``. ``work`` and ``useful`` count distances."""
    empty = F.array().cast("array<int>"), F.array().cast("array<double>")
    start = [F.lit(-1).cast("long").alias("cluster_id"), *[F.lit(0.0).alias(c) for c in ("upper", "lower", "rest")], empty[0].alias("ids"), empty[1].alias("lows")]
    return _scanned(points.select("point_id", "x", *start), np.array(centers, float), None, length)


def rescan(state: DataFrame, centers: np.ndarray, before: np.ndarray, facing: Facing | None = None, length: int = LISTED) -> DataFrame:
    """The state after the centres moved. Every bound moves with its centre; a point whose upper bound stays
    below all lower ones, or below half the way from its centre to the next, keeps its centre without
    a distance. Of the others the distance to their own centre is tried first, then those listed whose bound lies below
    it, each by its own centre's move, and all only if the bound of the rest does."""
    if not {"ids", "lows", "rest"} <= set(state.columns):
        state = state.select("point_id", "x", "cluster_id", "upper", "lower", F.col("lower").alias("rest"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<double>").alias("lows"))
    return _scanned(state, np.array(centers, float), np.array(before, float), length, facing)


_STATE = "point_id long, x array<double>, cluster_id long, upper double, lower double, rest double, ids array<int>, lows array<double>, work long, useful long"


def _scanned(state: DataFrame, y: np.ndarray, before: np.ndarray | None, length: int, facing: Facing | None = None) -> DataFrame:
    k, d = y.shape
    moved = np.sqrt(((y - before) ** 2).sum(1)) * (1 + 1e-12) if before is not None else None
    half = (facing or Facing.of(y, 1)).half if moved is not None and k > 1 else np.full(k, np.inf)
    length = min(length, k - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            n = len(x)
            at, upper, rest = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("cluster_id", "upper", "rest"))
            listed = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)
            full = n > 0 and length > 0 and (listed == length).all()
            ids = batch.column("ids").flatten().to_numpy(zero_copy_only=False).reshape(n, length).copy() if full else np.zeros((n, length), np.int32)
            lows = batch.column("lows").flatten().to_numpy(zero_copy_only=False).reshape(n, length).copy() if full else np.full((n, length), np.inf)
            work, useful = np.zeros(n, np.int64), np.zeros(n, np.int64)
            todo = every = np.arange(n)
            if moved is not None:
                held = upper + moved[at]
                lows, rest = np.maximum(lows - moved[ids], 0.0), np.maximum(rest - moved.max(initial=0), 0.0)
                if not full:
                    rest = np.minimum(rest, np.maximum(batch.column("lower").to_numpy(zero_copy_only=False) - moved.max(initial=0), 0.0))
                safe = np.maximum(np.minimum(lows.min(1, initial=np.inf), rest), half[at])
                upper = held.copy()
                todo = every[held * (1 + 1e-12) >= safe]
                upper[todo] = np.sqrt(((x[todo] - y[at[todo]]) ** 2).sum(1))
                work[todo] += 1
                useful[todo] += 1
                todo = todo[upper[todo] * (1 + 1e-12) >= safe[todo]]
                tried = np.zeros((n, length), bool)
                tried[todo] = lows[todo] <= upper[todo, None] * (1 + 1e-12)
                r, j = np.nonzero(tried)
                if len(r):
                    was = upper.copy()
                    dist = np.concatenate([np.sqrt(((x[r[p]] - y[ids[r[p], j[p]]]) ** 2).sum(1)) for p in np.array_split(np.arange(len(r)), max(1, len(r) * d >> 20))])
                    lows[r, j] = dist
                    work += np.bincount(r, minlength=n)
                    useful += np.bincount(r, dist <= was[r], n).astype(np.int64)
                    order = np.lexsort((ids[r, j], dist, r))
                    first = order[np.r_[True, np.diff(r[order]) > 0]]
                    row, slot, new = r[first], j[first], dist[first]
                    wins = (new < upper[row]) | ((new == upper[row]) & (ids[row, slot] < at[row]))
                    row, slot, new = row[wins], slot[wins], new[wins]
                    ids[row, slot], at[row], lows[row, slot], upper[row] = at[row], ids[row, slot].copy(), upper[row].copy(), new
                todo = todo[upper[todo] * (1 + 1e-12) >= rest[todo]]
            for part in np.array_split(todo, max(1, len(todo) * k * d >> 20)):
                if not len(part):
                    continue
                dist = np.sqrt(((x[part][:, None] - y[None]) ** 2).sum(2))
                useful[part] = (dist <= (upper[part] if moved is not None else dist.min(1))[:, None]).sum(1)
                work[part] = k  # those tried before are among them
                rows = np.arange(len(part))
                at[part] = dist.argmin(1)
                upper[part] = dist[rows, at[part]]
                dist[rows, at[part]] = np.inf
                if length < k - 1:
                    near = np.argpartition(dist, length, 1)
                    rest[part] = np.take_along_axis(dist, near[:, length : length + 1], 1)[:, 0]
                    near = near[:, :length]
                else:
                    near = np.argsort(dist, 1)[:, :length]
                    rest[part] = np.inf
                ids[part], lows[part] = near, np.take_along_axis(dist, near, 1)
            lower = np.minimum(lows.min(1, initial=np.inf), rest)
            lists = [pa.array(list(v), t) for v, t in ((ids, pa.list_(pa.int32())), (lows, pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([batch.column("point_id"), batch.column("x"), *[pa.array(v) for v in (at, upper, lower, rest)], *lists, pa.array(work), pa.array(useful)], [c.split()[0] for c in _STATE.split(", ")])

    return state.mapInArrow(run, _STATE)


def assign_pruned(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """``point_id, cluster_id`` (the row of the nearest centre) by the pruned kernel."""
    y = np.array(centers, float)

    facing = Facing.of(y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, _, _ = nearest(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, y.shape[1]), y, facing=facing)
            yield pa.RecordBatch.from_arrays([batch.column("point_id"), pa.array(best, pa.int64())], ["point_id", "cluster_id"])

    return points.select("point_id", "x").mapInArrow(run, "point_id long, cluster_id long")


_SUMS = "k long, n double, total array<double>, far double, width double, work long"


def _emitted(k: int, n: np.ndarray, total: np.ndarray, far: np.ndarray, width: np.ndarray, done: int) -> pa.RecordBatch:
    parts = [pa.array(np.arange(k)), pa.array(n), pa.array(list(total)), pa.array(far), pa.array(width), pa.array([done] + [0] * (k - 1), pa.int64())]
    return pa.RecordBatch.from_arrays(parts, [c.split()[0] for c in _SUMS.split(", ")])


def _collected(rows: DataFrame, k: int, d: int, parts: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Partial sums added up: on the driver if ``parts`` times the centres are few, else by Spark."""
    if parts and parts * k <= GATHERED_SUMS:
        found = rows.toArrow()
        at = found.column("k").to_numpy()
        n, far, width, total = np.zeros(k), np.zeros(k), np.zeros(k), np.zeros((k, d))
        np.add.at(n, at, found.column("n").to_numpy())
        np.add.at(width, at, found.column("width").to_numpy())
        np.maximum.at(far, at, found.column("far").to_numpy())
        np.add.at(total, at, found.column("total").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
        return n, total, far, width, int(found.column("work").to_numpy().sum())
    found = rows.groupBy("k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(d)]).alias("total"), F.max("far").alias("far"), F.sum("width").alias("width"), F.sum("work").alias("work")).orderBy("k").collect()
    return tuple(np.array([r[c] for r in found], float) for c in ("n", "total", "far", "width")) + (int(sum(r["work"] for r in found)),)


def _sums(points: DataFrame, y: np.ndarray, prune: bool, facing: Facing | None = None, search: Callable | None = None, parts: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    k, d = y.shape
    facing = (facing or Facing.of(y)) if prune and k > 1 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, far, width, done = np.zeros(k), np.zeros((k, d)), np.zeros(k), np.zeros(k), 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            best, d2, work = search(x, y) if search else nearest(x, y, prune, facing)
            n += np.bincount(best, minlength=k)
            np.add.at(total, best, x)
            np.maximum.at(far, best, d2)
            width += np.bincount(best, d2, k)
            done += work
        yield _emitted(k, n, total, far, width, done)

    return _collected(points.select("x").mapInArrow(run, _SUMS), k, d, parts)


def _state_sums(state: DataFrame, y: np.ndarray, parts: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Sums of a scanned state; points that kept their centre without a distance get it here."""
    k, d = y.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, far, width, done = np.zeros(k), np.zeros((k, d)), np.zeros(k), np.zeros(k), 0
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            at, work = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster_id", "work"))
            d2 = np.square(batch.column("upper").to_numpy(zero_copy_only=False))
            d2[work == 0] = ((x[work == 0] - y[at[work == 0]]) ** 2).sum(1)
            n += np.bincount(at, minlength=k)
            np.add.at(total, at, x)
            np.maximum.at(far, at, d2)
            width += np.bincount(at, d2, k)
            done += int(np.maximum(work, 1).sum())
        yield _emitted(k, n, total, far, width, done)

    return _collected(state.select("x", "cluster_id", "upper", "work").mapInArrow(run, _SUMS), k, d, parts)


def run(
    points: DataFrame, centers: np.ndarray, max_rounds: int = 100, cut: float = 1e-3, prune: bool = True, bounds: bool = False,
    search: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, int]] | None = None, center: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None, radius: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray] | None = None,
) -> tuple[np.ndarray, list[dict]]:
    """Iterate until eleven rounds after the mean change of the centres fell below ``cut`` of the mean
    radius. An empty cluster in the first round is an error; later it keeps its centre. Returns the
    centres and a trace with the share of distances that were computed; its last row says what ended the run
    (``reason``: settled, unchanged or round limit). Points in fewer partitions than there are cores are dealt to as many.

    With ``bounds`` each round reads the state of the round before and writes its own (``bytes`` in the trace): distances are
    computed only where a bound asks for them. Without, each round finds the nearest centres anew.

    Callables may take a step's place: ``search(x, y)`` finds in the tasks the centre, the square distance and how many distances
    that took (not with ``bounds``); ``center(y, n, total)`` makes the new centres of the old ones, the counts and the sums of their points;
    ``radius(n, far, width)`` makes the radii of the counts, the greatest square distances and their sums."""
    if bounds and search:
        raise ValueError("bounds come from the search of their own")
    y, trace, left, held = np.array(centers, float), [], None, None
    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = points.rdd.getNumPartitions()
    few, parts = parts < cores, max(parts, cores)
    points = points.select(*[c for c in ("point_id", "x") if c in points.columns])
    points = points.repartition(cores).persist() if few else points
    facing = Facing.of(y) if len(y) > 1 and (prune or bounds) else None
    for step in range(max_rounds):
        if bounds:
            state = Written(scan(points, y) if held is None else rescan(held.df.drop("work", "useful"), y, before, facing))
            if held is not None:
                held.drop()
            held = state
            n, total, far, width, work = _state_sums(state.df, y, parts)
        else:
            n, total, far, width, work = _sums(points, y, prune, facing, search, parts)
        if step == 0 and (n == 0).any():
            raise ValueError("a cluster is empty at the start")
        new = np.array(center(y, n, total), float) if center else np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], y)
        change, reach = np.sqrt(((new - y) ** 2).sum(1)).mean(), float(np.mean(radius(n, far, width) if radius else np.sqrt(far)))
        trace.append({"step": step, "change": change, "radius": reach, "width": width.sum() / n.sum(), "work": work / (n.sum() * len(y))} | ({"bytes": held.bytes} if bounds else {}))
        before, y = y, new
        facing = facing.moved_to(y) if facing is not None else None
        if left is None and change < cut * reach:
            left = 11
        if left is not None:
            left -= 1
            if left <= 0 or change == 0:
                trace[-1]["reason"] = "unchanged" if change == 0 else "settled"
                break
    if trace:
        trace[-1].setdefault("reason", "round limit")
    if held is not None:
        held.drop()
    if few:
        points.unpersist()
    return y, trace


def initial_labels(points: DataFrame, k: int, policy: int = -4, seed: int = 10101010) -> DataFrame:
    """``label`` by policy: -1 at random; -2 at random but one each to the first points; -3 at random
    but every (n/k)-th point starts a cluster; -4 in blocks. Points need a gapless ``idx`` from 0."""
    n = points.count()
    random, idx = F.floor(F.rand(seed) * k).cast("int"), F.col("idx")
    block = max(1, n // k)
    by = {-1: random, -2: F.when(idx < k, idx.cast("int")).otherwise(random), -3: F.when((idx % block == 0) & (idx / block < k), F.floor(idx / block).cast("int")).otherwise(random), -4: F.least(F.floor(idx / block), F.lit(k - 1)).cast("int")}
    return points.withColumn("label", by[policy])


def histograms(assigned: DataFrame, bins: int = 202) -> DataFrame:
    """``bin, n, percent`` of the points' distances to their centres (``d2`` squared), over 0 to ten times the root of the mean
    square width, in pretty bins; the first and last bin take what lies outside."""
    from tempera.functions.exprs import bin_clamped, pretty_range

    ends = assigned.agg(F.avg("d2").alias("_w"), F.count("*").alias("_n"))
    lo, hi = pretty_range(F.lit(0.0), 10 * F.sqrt("_w"), F.lit(bins - 2))
    rows = assigned.select("d2").crossJoin(F.broadcast(ends.select("_n", lo.alias("_lo"), hi.alias("_hi"))))
    counts = rows.groupBy(bin_clamped(F.sqrt("d2"), F.col("_lo"), F.col("_hi"), bins).alias("bin"), "_n").agg(F.count("*").alias("n"))
    return counts.select("bin", "n", (100.0 * F.col("n") / F.col("_n")).alias("percent"))
