"""Compact batches of points, and the clusters that can matter in a box.

A batch's box bounds all distances of its points: the nearest corner from below, the farthest from
above. So a box alone tells which clusters are beyond the exponents' cut for every point in it, whatever
the clusters' scales, and no distance between clusters is needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Points of a small batch.
LEAF = 32
#: What a batch costs besides its pairs of points and clusters, in pairs; at most a share of all pairs.
BATCH_COST, COST_SHARE = 1 << 14, 1 / 64
_SLACK = 1 + 1e-9


def halves(x: np.ndarray, rows: np.ndarray, scale: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Rows parted at the median of their widest dimension."""
    part = x[rows]
    half = len(rows) // 2
    order = np.argpartition(part[:, int(((part.max(0) - part.min(0)) / scale).argmax())], half)
    return rows[order[:half]], rows[order[half:]]


def leaves(x: np.ndarray, scale: np.ndarray | float = 1.0, size: int = LEAF) -> Iterator[np.ndarray]:
    """Rows in groups of at most ``size`` that lie close together."""
    todo = [np.arange(len(x))] if len(x) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            yield rows
        else:
            todo += halves(x, rows, scale)[::-1]


def ends(lo: np.ndarray, hi: np.ndarray, y: np.ndarray, s2: np.ndarray, sponge: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scaled square distance between a box and each cluster; ``sponge`` is the factor of the first."""
    below, above = lo - y, y - hi
    near = np.maximum(np.maximum(below, above), 0.0)
    far = np.maximum(np.abs(below), np.abs(above))
    low, high = (near * near / s2).sum(1), (far * far / s2).sum(1)
    if sponge is not None:
        low[0] = high[0] = sponge * sponge
    return low, high


def within(lo: np.ndarray, hi: np.ndarray, state: tuple, cut: float) -> np.ndarray:
    """Whether each cluster of a state (y, s2, p, t, sponge factor) can have a membership in a box. The sponge always can."""
    y, s2, _, t, sponge = state
    low, high = ends(lo, hi, y, s2, sponge)
    out = low <= (high.min() + 2 * cut * t) * _SLACK
    if sponge is not None:
        out[0] = True
    return out


def met(x: np.ndarray, now: tuple, before: tuple | None, cut: float, ordered: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows in batches with the clusters that can have a membership there, now or before. A batch is halved, and its
    clusters are tried again, where that costs less. ``ordered``: the rows are in the order of ``compact``."""
    scale = np.sqrt(now[1][-1])

    def tried(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        part = x[rows[0] : rows[-1] + 1] if ordered else x[rows]
        lo, hi = part.min(0), part.max(0)
        mask = within(lo, hi, part_of(now, cols), cut)
        if before is not None:
            mask |= within(lo, hi, part_of(before, cols), cut)
        return rows, cols[mask]

    fixed = min(BATCH_COST, COST_SHARE * len(x) * len(now[0]))

    def batches(rows: np.ndarray, cols: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray]]]:
        rows, cols = tried(rows, cols)
        cost = len(rows) * len(cols) + fixed
        if len(rows) > 1 and cost > 2 * fixed:
            both = [batches(half, cols) for half in ((rows[: len(rows) // 2], rows[len(rows) // 2 :]) if ordered else halves(x, rows, scale))]
            if both[0][0] + both[1][0] < cost:
                return both[0][0] + both[1][0], both[0][1] + both[1][1]
        return cost, [(rows, cols)]

    yield from batches(np.arange(len(x)), np.arange(len(now[0])))[1] if len(x) else ()


def compact(x: np.ndarray, scale: np.ndarray | float = 1.0) -> np.ndarray:
    """An order in which halves, quarters and so on lie close together."""
    levels = [np.arange(len(x))]
    while levels and len(levels[0]) > LEAF:
        levels = [half for rows in levels for half in (halves(x, rows, scale) if len(rows) > 1 else (rows,))]
    return np.concatenate(levels)


def part_of(state: tuple | None, cols: np.ndarray) -> tuple | None:
    """Some clusters of a state (y, s2, p, t, sponge factor)."""
    return (*(state[i][cols] for i in range(3)), state[3], state[4]) if state else None
