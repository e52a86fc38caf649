"""Exact top-k search by multi-resolution segment statistics.

Components become the integers floor(scale * x). A vector is cut into 1, 4, 16, ... equal
segments, down to two components each; of each segment its mean and deviation are kept. For two vectors q and x the sum
over the segments of L * (mean_q * mean_x + dev_q * dev_x) is never below their inner
product (Cauchy-Schwarz on what is left after the means), and so bounds their distance
|q|^2 + |x|^2 - 2 q.x from below. Levels go from coarse to fine: each drops the candidates
that can no longer reach the k-th best exact score known, and exact scores are computed for
the survivors alone. Nothing is approximate; the bounds are widened against rounding.

Defined results: as for any exact search; equal scores go to the smaller id; fewer
candidates than k give all of them; a row is never its own neighbour, but other rows of its
id may be; zero vectors take part; vectors that are null, empty or hold null or non-finite
components don't, nor do rows without an id; of vectors of unequal lengths the shorter
counts as filled with zeros (after the scaling); an empty table gives an empty result;
further columns are ignored. Exact scores are sums of integers below 2^53; where components are
so large that sums could leave that range, the job fails.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame

from ._vectors import Best, nearest

SCALE = 64
#: So many times k candidates of the highest bounds are scored first.
PROMISING = 16


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of equal segments, times the root of the segment's length: their inner product is the bound."""
    n, dims = x.shape
    length = -(-dims // segments)
    y = np.zeros((n, segments * length))
    y[:, :dims] = x
    y = y.reshape(n, segments, length)
    mean = y.mean(2)
    dev = np.sqrt(np.maximum((y * y).mean(2) - mean * mean, 0))
    return np.concatenate([mean, dev], 1) * np.sqrt(length)


def levels(dims: int) -> list[int]:
    """Numbers of segments: four times as many each time, and at last two components a segment."""
    out = [1]
    while out[-1] * 8 <= dims:
        out.append(out[-1] * 4)
    return [*out, *([-(-dims // 2)] if dims // 2 > out[-1] else [])]


def exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (i, j), in slices; of integers whose sums a double holds."""
    out = np.empty(len(i))
    for lo in range(0, len(i), 1 << 15):
        out[lo : lo + (1 << 15)] = np.einsum("ij,ij->i", q[i[lo : lo + (1 << 15)]], x[j[lo : lo + (1 << 15)]])
    return out


def survivors(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``exact`` for pairs in order of i, query by query: a product of rows and one vector costs less than rows taken in pairs."""
    ends = np.searchsorted(i, np.arange(len(q) + 1))
    return np.concatenate([x[j[lo:hi]] @ v for v, lo, hi in zip(q, ends[:-1], ends[1:], strict=True)])


def search_segments(stats: list[np.ndarray], x: np.ndarray, uid: np.ndarray, ids: np.ndarray, q: np.ndarray, q_uid: np.ndarray, k: int):
    """(query row, row of x, exact score) of the k best of each query; and how many pairs had an exact score."""
    best, n, scored = Best(len(q), k), len(x), 0
    longest, tries = float(np.sqrt((x * x).sum(1).max(initial=0.0))), min(len(x), PROMISING * k)
    for lo in range(0, len(q), 128):
        some = q[lo : lo + 128]
        alive = uid[None, :] != q_uid[lo : lo + 128, None]
        floor = np.full(len(some), -np.inf)
        slack = (1e-9 * np.sqrt((some * some).sum(1)) * longest + 1e-6)[:, None]
        for level, s in zip(levels(x.shape[1]), stats, strict=True):
            own = statistics(some, level)
            if alive.sum() > alive.size // 64:
                bound = own @ s.T
                if n > k and level > 1:
                    bound[~alive] = -np.inf
                    # the k-th best exact score of the most promising is what the others must reach
                    top = np.argpartition(-bound, tries - 1, axis=1)[:, :tries]
                    rows = np.repeat(np.arange(len(some)), tries)
                    found = np.where(np.take_along_axis(alive, top, 1), exact(some, x, rows, top.ravel()).reshape(top.shape), -np.inf)
                    scored += top.size
                    floor = np.maximum(floor, np.partition(found, tries - k, axis=1)[:, tries - k])
                alive &= bound + slack >= floor[:, None]
            else:
                i, j = np.nonzero(alive)
                short = (own[i] * s[j]).sum(1) + slack[i, 0] < floor[i]
                alive[i[short], j[short]] = False
        i, j = np.nonzero(alive)
        if len(i):
            scored += len(i)
            score = survivors(some, x, i, j)
            high = score >= floor[i]
            best.add(i[high] + lo, score[high], ids[j[high]], j[high])
    row, at, score = best.found()
    return row, at, score.astype(np.int64), scored


def segment_topk(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    *,
    k: int = 20,
    every: int = 20,
    scale: int = SCALE,
    shard_rows: int = 4096,
    query_rows: int = 256,
) -> DataFrame:
    """The ``k`` highest integer inner products of every row whose id is divisible by ``every``: query_id, rank, vec_id, score."""

    def prepare(x):
        x = np.floor(x * scale)
        if x.size and x.shape[1] * float(np.abs(x).max()) ** 2 >= 2.0**53:
            raise ValueError("scaled components are too large for exact sums")
        return x

    def build(uid, ids, x):
        return pickle.dumps(([statistics(x, s) for s in levels(x.shape[1])], x), protocol=5)

    def search(q, q_uid, held, uid, ids):
        stats, x = held
        row, at, score, _ = search_segments(stats, x, uid, ids, q, q_uid, k)
        return row, at, score

    return nearest(
        df, id_col, vec_col, k=k, every=every, shard_rows=shard_rows, query_rows=query_rows, zero_ok=True, score_type="long",
        prepare=prepare, build=build, load=pickle.loads, search=search,
    )
