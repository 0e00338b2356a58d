"""Widest directions of clusters without their matrices: power iteration whose products are Spark jobs.

The correlations of a cluster weigh the offsets of its points, in units of the scales, by half their membership. Their product with
a vector a cluster needs only the points' projections on it: a task holds points by clusters and clusters by dimensions, and
nothing by dimensions squared. All clusters asked for share the jobs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_ROUNDS, MOST_ROUNDS = 5, 200
VALUE_CHANGE, VECTOR_CHANGE = 1e-6, 1e-4


def products(points: DataFrame, state: tuple, cut: float, most: int | None, ks: np.ndarray, v: np.ndarray, parts: int | None = None) -> np.ndarray:
    """Correlations of the clusters ``ks`` of a state (y, s2, p, t, sponge factor) times their vectors ``v``. ``points`` have ``x`` or are packed."""
    from tempera.plans.anneal import collected, memberships, unpacked

    y, s2, _, t, _ = state
    d, packed, s = y.shape[1], points.columns == ["xs"], np.sqrt(s2[ks])
    scaled = v / s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((len(ks), d))
        step = max(1, (1 << 20) // len(y))
        for batch in batches:
            for xs in unpacked(batch.column(0), d) if packed else [batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)]:
                for at in range(0, len(xs), step):
                    x = xs[at : at + step]
                    half = memberships(x, *state, cut, most)[0][:, ks] / 2
                    middle = x.mean(0)
                    off = y[ks] - middle
                    q = half * ((x - middle) @ scaled.T - (off * scaled).sum(1))
                    total += (q.T @ (x - middle) - q.sum(0)[:, None] * off) / (t * s)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(ks), pa.int64()), pa.array([part >> 8] * len(ks), pa.int64()), pa.array(np.arange(len(ks))), pa.array(list(total), pa.list_(pa.float64()))], ["part", "block", "k", "v"])

    rows = (points if packed else points.select("x")).mapInArrow(run, "part long, block long, k long, v array<double>")
    return collected(rows, len(ks), d, (parts or 0) > 256, parts)


def widest(points: DataFrame, state: tuple, cut: float, most: int | None, ks: np.ndarray, parts: int | None = None, seed: int = 7, most_rounds: int = MOST_ROUNDS, value_change: float = VALUE_CHANGE, vector_change: float = VECTOR_CHANGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greatest eigenvalues of the correlations of clusters ``ks``, their unit vectors, and which of them settled. The vectors all
    start at one random direction; a cluster that has settled takes no further part."""
    d = state[0].shape[1]
    start = np.random.default_rng(seed).uniform(-0.5, 0.5, d)
    v, values, done = np.tile(start / np.linalg.norm(start), (len(ks), 1)), np.zeros(len(ks)), np.zeros(len(ks), bool)
    for step in range(most_rounds):
        todo = np.flatnonzero(~done)
        if not len(todo):
            break
        new = products(points, state, cut, most, np.asarray(ks)[todo], v[todo], parts)
        size = np.linalg.norm(new, axis=1)
        zero = size <= 1e-300
        new = np.where(zero[:, None], v[todo], new / np.where(zero, 1.0, size)[:, None])
        settled = (np.abs(size - values[todo]) <= value_change * np.maximum(size, 1e-300)) & (np.linalg.norm(new - v[todo], axis=1) <= vector_change)
        values[todo], v[todo] = size, new
        done[todo] = zero | (settled & (step + 1 >= LEAST_ROUNDS))
    return values, v, done
