"""Spanning links of blocks of pairs and of lists of links, in numpy: what a task found, without all of its pairs."""

from __future__ import annotations

import numpy as np

_FAR = np.iinfo(np.int64).max


def spanning(rows: np.ndarray, cols: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the same nodes as the boolean matrix `linked` of rows against cols.

    Each node of a component of that matrix is linked to the smallest id in it,
    so there are at most as many links as nodes.
    """
    r, c = linked.any(axis=1), linked.any(axis=0)
    rows, cols, linked = rows[r], cols[c], linked[np.ix_(r, c)]
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = rows.copy(), cols.copy()
    while True:
        x2 = np.minimum(x, np.where(linked, y[None, :], _FAR).min(axis=1))
        y2 = np.minimum(y, np.where(linked, x2[:, None], _FAR).min(axis=0))
        if (x2 == x).all() and (y2 == y).all():
            break
        x, y = x2, y2
    a, b = np.concatenate([rows, cols]), np.concatenate([x, y])
    own = a != b
    return a[own], b[own]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links (a, b): each node to the smallest id that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, least = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while (apart := least[x] != least[y]).any():
        x, y = x[apart], y[apart]
        u, v = least[x], least[y]
        np.minimum.at(least, np.maximum(u, v), np.minimum(u, v))
        while (least[least] != least).any():
            least = least[least]
    own = least != np.arange(len(nodes))
    return nodes[own], nodes[least[own]]
