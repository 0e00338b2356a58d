"""Annealing passes over lists kept by point: most passes compute only the distances of the listed clusters.

Where only the nearest clusters of a point count, its list holds these and some more (``operators.associated``), with a bound
on the distance of all others. As clusters move, the bound falls by the longest move since the list was made. A point is certified
while the bound lies beyond its last cluster that counts, or beyond the exponents' cut; any other point meets the clusters that its box
reaches, so the sums are those of a full pass. When too many points miss, the lists are made anew. They are
written as a table, so a lost executor costs the reading of its part."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempera.operators.associated import lists
from tempera.plans.anneal import MIN_P, added_up, collected, sums_by_name, sums_width
from tempera.sources.scratch import Written

SPARE = 12  # clusters listed beyond those that count
MISSED = 0.05  # share of the points without a certificate, beyond which lists are made anew


class Listed:
    """``builds`` counts how often lists were made, ``missed`` the share of points that the last pass had to treat in full. Lists reach to ``list_cut`` of the exponents, so that they hold for a while."""

    def __init__(self, packed: DataFrame, d: int, cut: float, most: int, list_cut: float | None = None):
        self.packed, self.d, self.cut, self.most, self.list_cut = packed, d, cut, most, list_cut or 2 * cut
        self.table: Written | None = None
        self.rows: DataFrame | None = None
        self.at: tuple[np.ndarray, np.ndarray] | None = None
        self.builds, self.missed, self.bytes = 0, 1.0, 0

    def close(self) -> None:
        if self.table is not None:
            self.rows.unpersist()
            self.table.drop()
            self.table = None

    def _build(self, state: tuple) -> None:
        self.close()
        d, cut, cap = self.d, self.list_cut, self.most + SPARE

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for xs in batch.column(0):
                    x = np.frombuffer(xs.as_buffer(), np.float64).reshape(-1, d)
                    ids, _, rest, _ = lists(x, state, cut, cap, True)
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, ids, np.sqrt(rest))], ["xs", "ids", "rest"])

        self.table = Written(self.packed.mapInArrow(run, "xs binary, ids binary, rest binary"))
        self.rows, self.at, self.bytes = self.table.df.persist(), (state[0].copy(), state[1].copy()), self.table.bytes
        self.builds += 1

    def _moved(self, state: tuple) -> float:
        skip = int(state[4] is not None)
        return float(np.sqrt(((state[0][skip:] - self.at[0][skip:]) ** 2 / self.at[1][-1]).sum(1).max(initial=0))) * (1 + 1e-12)

    def sums(self, now: tuple, before: tuple | None, parts: int | None = None) -> dict[str, np.ndarray]:
        """As ``anneal.em_sums`` with ``most``, for scales that all clusters share."""
        k, d = now[0].shape
        if before is not None and before[0].shape != now[0].shape:
            before = None
        same = self.at is not None and self.at[0].shape == now[0].shape and np.array_equal(self.at[1], now[1])
        if not same or self.missed > MISSED:
            self._build(now)
        states = [(now, self._moved(now))] + ([(before, self._moved(before))] if before is not None else [])
        cut, most, cap, width = self.cut, self.most, self.most + SPARE, sums_width(d)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total = np.zeros((k, width + 1))
            for batch in batches:
                for xs, ids, rest in zip(*(batch.column(c) for c in ("xs", "ids", "rest")), strict=True):
                    x = np.frombuffer(xs.as_buffer(), np.float64).reshape(-1, d)
                    own = np.frombuffer(ids.as_buffer(), np.int32).reshape(-1, cap)
                    bound = np.frombuffer(rest.as_buffer(), np.float64)
                    good = listed_sums(x, own, bound, states, cut, most, total[:, :width])
                    if not good.all():
                        added_up(x[~good], now, before, cut, most, True, total[:, :width])
                        total[0, width] += (~good).sum()
            part, some = TaskContext.get().partitionId(), np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(some), pa.int64()), pa.array([part >> 8] * len(some), pa.int64()), pa.array(some), pa.array(list(total[some]), pa.list_(pa.float64()))], ["part", "block", "k", "v"])

        found = collected(self.rows.mapInArrow(run, "part long, block long, k long, v array<double>"), k, width + 1, (parts or 0) > 256, parts)
        out = sums_by_name(found[:, :width], d)
        self.missed = float(found[:, width].sum() / max(1.0, out["c"].sum()))
        return out


def listed_sums(x: np.ndarray, ids: np.ndarray, rest: np.ndarray, states: list[tuple[tuple, float]], cut: float, most: int, total: np.ndarray) -> np.ndarray:
    """Add the sums of the points whose list is certified for all states (now and, perhaps, before) to ``total``; which these are."""
    good, ms, k = np.ones(len(x), bool), [], len(total)
    listed = ids >= 0
    at = np.where(listed, ids, 0)
    for (y, s2, p, t, sponge), moved in states:
        skip = int(sponge is not None)
        d2 = sum((x[:, None, i] - y[at, i]) ** 2 / s2[-1, i] for i in range(x.shape[1]))
        d2[~listed] = np.inf
        least = d2.min(1)
        if skip:
            least = np.minimum(least, sponge * sponge)
        counts = max(1, most - skip)
        order = np.argsort(d2, 1, kind="stable")
        last = np.take_along_axis(d2, order[:, counts - 1 : counts], 1)[:, 0] if d2.shape[1] >= counts else np.full(len(x), np.inf)
        bound = np.square(np.maximum(rest - moved, 0.0))
        good &= (bound > last) | (bound >= (least + 2 * cut * t) * (1 + 1e-9))
        e = (d2 - least[:, None]) / t
        w = np.where(e < 2 * cut, np.maximum(MIN_P, p[at]) * np.exp(-0.5 * e), 0.0)
        np.put_along_axis(w, order[:, counts:], 0.0, 1)
        ws = np.zeros(len(x))
        if skip:
            es = (sponge * sponge - least) / t
            ws = np.where(es < 2 * cut, max(MIN_P, p[0]) * np.exp(-0.5 * es), 0.0)
        all_ = w.sum(1) + ws
        all_ = np.where(all_ > 0, all_, 1.0)
        ms.append((w / all_[:, None], ws / all_, d2))
    y, s2, _, t, sponge = states[0][0]
    (m, m_sponge, d2), d = ms[0], x.shape[1]
    sq = np.flatnonzero(good)
    if not len(sq):
        return good
    pairs = [(i, j) for i in range(d) for j in range(i, d)]

    def added(where: np.ndarray, of: np.ndarray, mine: np.ndarray, dist: np.ndarray, was: np.ndarray) -> None:
        """Sums over pairs of a point and a cluster."""
        off = [x[where, i] - y[of, i] for i in range(d)]
        half = mine / 2
        columns = [mine, mine * (1 - mine), mine * dist, np.abs(mine - was), None, None, (mine > 0) * 1.0]
        columns += [mine * x[where, i] for i in range(d)]
        columns += [half * (1 - half) * off[i] / (np.sqrt(s2[of, i]) * t) for i in range(d)]
        columns += [half * off[i] * off[j] / (t * np.sqrt(s2[of, i] * s2[of, j])) for i, j in pairs]
        for c, v in enumerate(columns):
            if v is not None:
                total[:, c] += np.bincount(of, v, k)

    was, was_sponge = (ms[1][0], ms[1][1]) if len(ms) > 1 else (m, m_sponge)
    r, j = np.nonzero((m[sq] > 0) | (was[sq] > 0))
    r = sq[r]
    added(r, at[r, j], m[r, j], d2[r, j], was[r, j])
    if sponge is not None:
        zero = np.zeros(len(sq), np.int64)
        added(sq, zero, m_sponge[sq], np.full(len(sq), float(sponge * sponge)), was_sponge[sq])
        total[0, 5] += len(sq)
    if len(ms) == 1:
        total[:, 3] = np.inf
    top = m[sq].argmax(1)
    best = at[sq, top]
    if sponge is not None:
        best = np.where(m_sponge[sq] >= m[sq, top], 0, best)
    total[:, 4] += np.bincount(best, minlength=k)
    total[:, 5] += np.bincount(ids[sq][listed[sq]], minlength=k)
    return good
