"""Associated clusters: for each point the list of those that may matter to it, with a certificate.

A list holds the nearest clusters within the exponents' cut of the nearest one, at most ``cap``. Its status says
why it ends: ``complete`` (there are no others), ``exponent`` (the others are beyond the cut) or ``cap`` (the next one is within
the cut, but the list is full). ``rest`` is a bound from below on the scaled square distance of every cluster that isn't
listed, so a later state can tell whether a list still holds without looking at the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tempera.operators.boxes import met, part_of

STATUS = ("complete", "exponent", "cap")


def lists(x: np.ndarray, state: tuple, cut: float, cap: int, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``ids`` (points by cap, ascending, -1 where a list is shorter), their square distances, ``rest`` and the status'
    number. The sponge isn't listed. State: (y, s2, p, t, sponge factor)."""
    t, skip, n = state[3], int(state[4] is not None), len(x)
    own = (*(v[skip:] for v in state[:3]), t, None)
    every = len(own[0])
    ids, near = np.full((n, cap), -1, np.int32), np.full((n, cap), np.inf)
    rest, status = np.full(n, np.inf), np.zeros(n, np.int8)
    for rows, cols in met(x, own, None, cut, ordered):
        y, s2, _, _, _ = part_of(own, cols)
        for part in np.array_split(rows, max(1, len(rows) * len(cols) >> 18)):
            d2 = sum((x[part][:, None, i] - y[None, :, i]) ** 2 / s2[None, :, i] for i in range(x.shape[1]))
            limit = d2.min(1) + 2 * cut * t
            inside = d2 <= limit[:, None]
            count = inside.sum(1)
            order = np.argsort(np.where(inside, d2, np.inf), 1, kind="stable")[:, : cap + 1]
            value = np.take_along_axis(np.where(inside, d2, np.inf), order, 1)
            full = count > cap
            rest[part] = np.where(full, value[:, cap] if value.shape[1] > cap else np.inf, np.where(count == every, np.inf, limit))
            status[part] = np.where(full, 2, np.where(count == every, 0, 1))
            order, value = order[:, :cap], value[:, :cap]
            found = np.where(np.isfinite(value), cols[order] + skip, np.iinfo(np.int32).max)
            again = np.argsort(found, 1, kind="stable")
            found, value = np.take_along_axis(found, again, 1), np.take_along_axis(value, again, 1)
            ids[part, : found.shape[1]] = np.where(np.isfinite(value), found, -1)
            near[part, : found.shape[1]] = value
    return ids, near, rest, status


def associated(points: DataFrame, state: tuple, cut: float, cap: int) -> DataFrame:
    """``point_id, clusters`` (array of struct<k, d2>, the nearest first), ``status`` and ``rest`` (null if complete) of points (point_id, x)."""
    d = state[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("k", pa.int32()), ("d2", pa.float64())]))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            ids, near, rest, status = lists(x, state, cut, cap)
            order = np.lexsort((ids, near), axis=1)
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            size = (ids >= 0).sum(1)
            flat = pa.StructArray.from_arrays([pa.array(ids[ids >= 0], pa.int32()), pa.array(near[ids >= 0])], ["k", "d2"])
            found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), flat).cast(kind)
            yield pa.RecordBatch.from_arrays([batch.column("point_id"), found, pa.array([STATUS[s] for s in status]), pa.array(rest, mask=~np.isfinite(rest))], ["point_id", "clusters", "status", "rest"])

    return points.select("point_id", "x").mapInArrow(run, "point_id long, clusters array<struct<k:int,d2:double>>, status string, rest double")
