"""Approximate nearest neighbours: vantage-point trees per shard.

The nearest of a query are those of largest inner product. Within a shard the vectors get
one more component, sqrt(M^2 - |x|^2) with M the shard's longest norm, and queries a zero:
the largest inner product is then the smallest Euclidean distance, for which the triangle
inequality holds. A tree node keeps a vantage point and the range of distances from it to
the rows of either child. A child is skipped when ``factor`` times the distance that the
query has from this range exceeds the distance of the k-th best so far: a factor of 1 is
exact, larger ones skip more.

Defined results: a query with fewer candidates gets all of them; equal scores go to the
smaller id; a row is never its own neighbour, but other rows of its id may be; vectors that
are null, empty, zero or hold null or non-finite components take no part, nor do rows
without an id; of vectors of unequal lengths the shorter counts as filled with zeros; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame

from ._vectors import Best, exact_scores, nearest

LEAF = 256
FACTOR = 3.0


def lifted(x: np.ndarray, longest: float | None = None) -> np.ndarray:
    norms = (x * x).sum(1)
    top = norms.max(initial=0.0) if longest is None else longest
    return np.concatenate([x, np.sqrt(np.maximum(top - norms, 0))[:, None]], 1)


def build_tree(x: np.ndarray, leaf: int = LEAF, seed: int = 7) -> dict:
    """The tree over lifted vectors: nodes are (vantage, left, right, ranges) or (start, stop) of ``order``."""
    rng = np.random.default_rng(seed)
    order, nodes = np.arange(len(x)), []

    def split(lo: int, hi: int) -> int:
        at = len(nodes)
        nodes.append(None)
        own = order[lo:hi]
        if hi - lo <= leaf:
            nodes[at] = (lo, hi)
            return at
        tries = rng.choice(own, min(4, len(own)), replace=False)
        spread = [np.linalg.norm(x[own] - x[t], axis=1) for t in tries]
        best = int(np.argmax([d.std() for d in spread]))
        vantage, d = tries[best], spread[best]
        by = np.argsort(d, kind="stable")
        order[lo:hi], d = own[by], d[by]
        mid = (hi - lo) // 2
        ranges = (d[0], d[mid - 1], d[mid], d[-1])
        left = split(lo, lo + mid)
        right = split(lo + mid, hi)
        nodes[at] = (int(vantage), left, right, ranges)
        return at

    split(0, len(x))
    return {"nodes": nodes, "order": order}


def search_tree(tree: dict, x: np.ndarray, points: np.ndarray, uid: np.ndarray, ids: np.ndarray, q: np.ndarray, q_uid: np.ndarray, k: int, factor: float):
    """(query row, row of x, score) of the k nearest of each query; ``points`` are the lifted vectors."""
    longest = float((points[0] * points[0]).sum()) if len(points) else 0.0
    up, qs, q_up = (q * q).sum(1) + longest, Best(len(q), k), np.concatenate([q, np.zeros((len(q), 1))], 1)
    order = tree["order"]
    slack = 1e-9 * (1 + longest)  # what a matrix product may differ by from the score as defined

    def reach(rows: np.ndarray) -> np.ndarray:
        """The distance of the k-th best so far, a little enlarged against rounding."""
        return np.sqrt(np.maximum(up[rows] - 2 * qs.worst()[rows], 0)) * (1 + 1e-9) + 1e-9

    def visit(node: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        at = tree["nodes"][node]
        if len(at) == 2:
            own = order[at[0] : at[1]]
            rough = q[rows] @ x[own].T
            rough[q_uid[rows][:, None] == uid[own][None, :]] = -np.inf
            least = qs.worst()[rows]
            if len(own) > k:
                least = np.maximum(least, np.partition(rough, len(own) - k, axis=1)[:, len(own) - k])
            i, j = np.nonzero(rough >= np.maximum(least - slack, -1e300)[:, None])
            if len(i):
                qs.add(rows[i], exact_scores(q[rows[i]], x[own[j]]), ids[own[j]], own[j])
            return
        vantage, left, right, (l0, l1, r0, r1) = at
        d = np.linalg.norm(q_up[rows] - points[vantage], axis=1)
        near_left = np.maximum(np.maximum(l0 - d, d - l1), 0)
        near_right = np.maximum(np.maximum(r0 - d, d - r1), 0)
        first = near_left <= near_right
        for child, gap, some in ((left, near_left, first), (right, near_right, ~first), (right, near_right, first), (left, near_left, ~first)):
            pick = some & (factor * gap <= reach(rows))
            visit(child, rows[pick])

    visit(0, np.arange(len(q)))
    return qs.found()


def vp_search(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    *,
    k: int = 20,
    every: int = 20,
    factor: float = FACTOR,
    shard_rows: int = 4096,
    query_rows: int = 256,
) -> DataFrame:
    """The ``k`` nearest of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""

    def build(uid, ids, x):
        return pickle.dumps((build_tree(lifted(x)), x), protocol=5)

    def load(data):
        tree, x = pickle.loads(data)
        return tree, x, lifted(x)

    def search(q, q_uid, held, uid, ids):
        return search_tree(*held, uid, ids, q, q_uid, k, factor)

    return nearest(
        df, id_col, vec_col, k=k, every=every, shard_rows=shard_rows, query_rows=query_rows, zero_ok=False, score_type="double",
        prepare=lambda x: x, build=build, load=load, search=search,
    )
