"""Exact searches for what is nearest among many items, in leaves of items that lie together.

Items have boxes (points have boxes without extent). Leaves follow a space-filling order,
and so do blocks of queries, so that a block needs few leaves. Memory is bounded by the
items and one block; the results are those of comparing all with all, ties included.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LEAF, BLOCK, BITS = 64, 256, 20


def _along_curve(p: np.ndarray) -> np.ndarray:
    """The order of points along a Z-shaped curve through a grid of 2^BITS cells a side."""
    low, span = p.min(0), np.ptp(p, axis=0)
    cell = ((p - low) / np.where(span > 0, span, 1) * (2**BITS - 1)).astype(np.int64)
    code = np.zeros(len(p), np.int64)
    for bit in range(BITS):
        for axis in range(3):
            code |= (cell[:, axis] >> bit & 1) << (3 * bit + axis)
    return np.argsort(code, kind="stable")


def _least(index: np.ndarray, apart: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` least of each row by distance, then index."""
    if k == 1:
        least = apart.min(1, keepdims=True)
        return np.where(apart == least, index, np.iinfo(np.int64).max).min(1, keepdims=True), least
    order = np.lexsort((index, apart), axis=-1)[:, :k]
    return np.take_along_axis(index, order, 1), np.take_along_axis(apart, order, 1)


def nearest(queries: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, measure: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances of the ``k`` items nearest to each query, nearest
    first, ties to the lower index. Items lie in the boxes ``low`` to ``high``;
    ``measure(q, items)`` gives the squared distances of some queries from some items.
    All numbers must be finite, and there must be at least ``k`` items."""
    order = _along_curve((low + high) / 2)
    starts = np.arange(0, len(order), LEAF)
    lo, hi = np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)
    items = [order[s : s + LEAF] for s in starts]
    need = min(len(items), -(-k // LEAF) + 1)
    index, apart = np.zeros((len(queries), k), np.int64), np.zeros((len(queries), k))
    slack = 1e-12 * max(np.abs(a).max(initial=0) for a in (queries, low, high))
    way = _along_curve(queries) if len(queries) else np.zeros(0, np.int64)
    for rows in np.array_split(way, max(1, -(-len(way) // BLOCK))):
        q = queries[rows]
        if not len(q):
            continue
        gap = (np.maximum(np.maximum(lo - q.max(0), q.min(0) - hi), 0) ** 2).sum(1)
        leaves = np.argsort(gap, kind="stable")
        first = np.concatenate([items[leaf] for leaf in leaves[:need]])
        i, d = _least(np.broadcast_to(first, (len(q), len(first))), measure(q, first), k)
        for leaf in leaves[need:]:
            bound = (np.sqrt(d[:, -1]) * (1 + 1e-9) + slack) ** 2  # what rounding may hide is looked at
            if gap[leaf] > bound.max():
                break
            near = np.flatnonzero((np.maximum(np.maximum(lo[leaf] - q, q - hi[leaf]), 0) ** 2).sum(1) <= bound)
            if len(near):
                more = np.broadcast_to(items[leaf], (len(near), len(items[leaf])))
                i[near], d[near] = _least(np.concatenate([i[near], more], 1), np.concatenate([d[near], measure(q[near], items[leaf])], 1), k)
        index[rows], apart[rows] = i, d
    return index, apart
