"""Annealing passes with very many clusters: points are dealt once by ranges of the first dimension, and
each task gets only the clusters whose reach meets its box.

What a box can't reach is beyond the exponents' cut for all its points (``operators.boxes``), so sums equal
those of a pass that sends all clusters everywhere. The reach of a part is a bound on its points' distances to their nearest
cluster. A cheap pass finds it from the clusters around the part; as clusters move it grows by the longest move, until
it has doubled. Points travel once; a pass shuffles clusters only, to the parts that they reach."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempera.operators.boxes import ends, leaves
from tempera.plans.anneal import added_up, collected, sums_by_name, sums_width

PART_ROWS = 50_000  # points of a part, about
AROUND = 64  # clusters on either side of a part that bound its reach, besides those inside


def _state_columns(state: tuple) -> np.ndarray:
    y, s2, p, _, _ = state
    return np.c_[y, s2, p]


def _state_of(v: np.ndarray, d: int, state: tuple) -> tuple:
    return v[:, :d], v[:, d : 2 * d], v[:, 2 * d], state[3], state[4]


@dataclass
class Dealt:
    """``rows`` (part, x) lie together by part; ``lo, hi`` are the boxes of the parts."""

    rows: DataFrame
    lo: np.ndarray
    hi: np.ndarray
    known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = field(default=None)  # centres, scales and the reach of the parts there
    bound_passes: int = 0
    sent: int = 0  # clusters sent to parts by the last pass

    def unpersist(self) -> None:
        self.rows.unpersist()

    def reach(self, state: tuple) -> np.ndarray:
        """A bound on the scaled square distance of each part's points to their nearest cluster."""
        y, s2, _, _, sponge = state
        limit = np.inf if sponge is None else sponge * sponge
        if self.known is not None and self.known[0].shape == y.shape and np.array_equal(self.known[1], s2) and (s2[int(sponge is not None) :] == s2[-1]).all():
            skip = int(sponge is not None)
            move = np.sqrt(((y[skip:] - self.known[0][skip:]) ** 2 / s2[-1]).sum(1).max(initial=0))
            grown = (np.sqrt(self.known[2]) + move) ** 2
            if grown.max() <= 2 * max(self.known[2].max(), 1e-300):
                return np.minimum(grown, limit)
        self.known = (y.copy(), s2.copy(), self._bounded(state))
        return np.minimum(self.known[2], limit)

    def _bounded(self, state: tuple) -> np.ndarray:
        y, skip, d = state[0], int(state[4] is not None), self.lo.shape[1]
        order = np.argsort(y[skip:, 0], kind="stable") + skip
        at = y[order, 0]
        first, last = (np.searchsorted(at, v, side) for v, side in ((self.lo[:, 0], "left"), (self.hi[:, 0], "right")))
        parts, ks = zip(*[(np.full(len(mine), p), mine) for p, (a, b) in enumerate(zip(first, last, strict=True)) for mine in [order[max(0, a - AROUND) : b + AROUND]]], strict=True)

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            x, v = _matrix(left.column("x"), d), _matrix(right.column("v"), 2 * d + 1)
            scale, worst = np.sqrt(v[-1, d : 2 * d]), 0.0
            for rows in leaves(x, scale):
                worst = max(worst, ends(x[rows].min(0), x[rows].max(0), v[:, :d], v[:, d : 2 * d], None)[1].min())
            return pa.table({"part": left.column("part").slice(0, min(1, len(x))), "reach": pa.array([worst] * min(1, len(x)), pa.float64())})

        self.bound_passes += 1
        found = self._with_clusters(np.concatenate(parts), np.concatenate(ks), _state_columns(state)).applyInArrow(run, "part int, reach double").toArrow()
        out = np.zeros(len(self.lo))
        out[found.column("part").to_numpy()] = found.column("reach").to_numpy()
        return out

    def _with_clusters(self, parts: np.ndarray, ks: np.ndarray, v: np.ndarray):
        table = pa.table({"part": pa.array(parts, pa.int32()), "k": pa.array(ks, pa.int64()), "v": pa.FixedSizeListArray.from_arrays(pa.array(v[ks].ravel()), v.shape[1]).cast(pa.list_(pa.float64()))})
        clusters = self.rows.sparkSession.createDataFrame(table)
        return self.rows.groupBy("part").cogroup(clusters.groupBy("part"))

    def reached(self, state: tuple, cut: float) -> tuple[np.ndarray, np.ndarray]:
        """Parts and clusters that may have memberships between them, by part, then cluster."""
        y, s2, _, t, sponge = state
        skip, room = int(sponge is not None), self.reach(state) + 2 * cut * t
        order = np.argsort(y[skip:, 0], kind="stable") + skip
        at, width = y[order, 0], np.sqrt(room * s2[skip:, 0].max()) * (1 + 1e-9)
        first, last = np.searchsorted(at, self.lo[:, 0] - width, "left"), np.searchsorted(at, self.hi[:, 0] + width, "right")
        parts, ks = [], []
        for p, (a, b) in enumerate(zip(first, last, strict=True)):
            mine = order[a:b]
            low = ends(self.lo[p], self.hi[p], y[mine], s2[mine], None)[0]
            mine = np.sort(mine[low <= room[p] * (1 + 1e-9)])
            ks.append(np.r_[np.arange(skip), mine])
            parts.append(np.full(len(ks[-1]), p))
        return np.concatenate(parts), np.concatenate(ks)

    def sums(self, now: tuple, before: tuple | None, cut: float, most: int | None = None, sent_cut: float | None = None) -> dict[str, np.ndarray]:
        """As ``anneal.em_sums``. Clusters are sent as far as ``sent_cut`` of the exponents, at least to ``cut``."""
        sent_cut = max(cut, sent_cut or cut)
        k, d = now[0].shape
        if before is not None and before[0].shape != now[0].shape:
            before = None
        parts, ks = self.reached(now, sent_cut)
        if before is not None:
            parts0, ks0 = self.reached(before, sent_cut)
            both = np.unique(np.r_[parts * k + ks, parts0 * k + ks0])
            parts, ks = both // k, both % k
        self.sent, v = len(ks), np.c_[_state_columns(now), _state_columns(before)] if before is not None else _state_columns(now)
        size, lo, hi = 2 * d + 1, self.lo, self.hi
        few_now, few_before = (None, None, None, *now[3:]), (None, None, None, *before[3:]) if before is not None else None

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            x, ids = _matrix(left.column("x"), d), right.column("k").to_numpy()
            order = np.argsort(ids, kind="stable")
            mine, ids = _matrix(right.column("v"), v_size)[order], ids[order]
            total = np.zeros((len(ids), sums_width(d)))
            part = left.column("part")[0].as_py() if len(x) else 0
            if len(x):
                if (x < lo[part]).any() or (x > hi[part]).any():
                    raise RuntimeError("a part's points were dealt anew; deal the points again")
                added_up(x, _state_of(mine, d, few_now), _state_of(mine[:, size:], d, few_before) if few_before else None, cut, most, True, total)
            some = np.flatnonzero(total[:, 5])
            return pa.table({"part": pa.array([part] * len(some), pa.int64()), "block": pa.array([part >> 8] * len(some), pa.int64()), "k": pa.array(ids[some]), "v": pa.array(list(total[some]), pa.list_(pa.float64()))})

        v_size = v.shape[1]
        rows = self._with_clusters(parts, ks, v).applyInArrow(run, "part long, block long, k long, v array<double>")
        return sums_by_name(collected(rows, k, sums_width(d)), d)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def deal(points: DataFrame, d: int, parts: int | None = None) -> Dealt:
    """Deal ``points`` (x; of equal ones those with a ``point_id`` can be parted) by ranges of the first dimension."""
    spark = points.sparkSession
    parts = parts or max(spark.sparkContext.defaultParallelism, points.count() // PART_ROWS)
    salt = F.xxhash64("point_id") if "point_id" in points.columns else F.lit(0)
    rows = points.select("x", F.get("x", F.lit(0)).alias("_first"), salt.alias("_salt")).repartitionByRange(parts, "_first", "_salt")
    rows = rows.select(F.spark_partition_id().alias("part"), "x").repartition(parts, "part").persist()
    corner = lambda f, i: f(F.get("x", F.lit(i)))
    found = rows.groupBy("part").agg(F.array(*[corner(F.min, i) for i in range(d)]).alias("lo"), F.array(*[corner(F.max, i) for i in range(d)]).alias("hi")).collect()
    lo, hi = np.full((parts, d), np.inf), np.full((parts, d), -np.inf)
    for r in found:
        lo[r["part"]], hi[r["part"]] = r["lo"], r["hi"]
    full = np.isfinite(lo[:, 0])  # a part without points gets no clusters
    lo[~full] = hi[~full] = lo[full][0] if full.any() else 0.0
    return Dealt(rows, lo, hi)
