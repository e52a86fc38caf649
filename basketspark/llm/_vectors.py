"""Vectors in bounded blocks: the frame that both vector searches share.

The valid rows are dealt evenly over shards of about ``shard_rows`` vectors, one row with
packed arrays for each; the queries are dealt into blocks in the same way. All rows against
a stated set of queries is what is asked for, so every block meets every shard: a task reads
a shard once and then the query blocks one after the other, and holds no more than that.
Where shards are fewer than tasks, a shard is given to several tasks, each with its share of
the blocks. The nearest of all shards meet in a window with a partial limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import finite, materialize, small_batches

PACKED = "shard long, uids binary, ids binary, dims int, data binary"
HITS = "uid long, query_id long, vec_id long, score {kind}"


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, zero_ok: bool) -> DataFrame:
    """(vec_id, vec) of the rows that take part; a row without an id has none to report and is left out."""
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"))
    out = out.filter(F.col("vec_id").isNotNull() & finite("vec"))
    return out if zero_ok else out.filter(F.exists("vec", lambda v: v != 0))


def packed(df: DataFrame, parts: int, dims: int, build: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """One row for each of ``parts`` partitions: the rows' uids, ids and what ``build`` makes of their vectors.

    Vectors shorter than ``dims`` are filled with zeros, which changes no inner product.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uids, ids, rows = [], [], []
        for f in frames:
            uids.append(f["uid"].to_numpy(np.int64))
            ids.append(f["vec_id"].to_numpy(np.int64))
            block = np.zeros((len(f), dims))
            for i, v in enumerate(f["vec"]):
                block[i, : len(v)] = v
            rows.append(block)
        if rows:
            u, i, x = np.concatenate(uids), np.concatenate(ids), np.concatenate(rows)
            yield pd.DataFrame({"shard": [TaskContext.get().partitionId()], "uids": [u.tobytes()], "ids": [i.tobytes()], "dims": [dims], "data": [build(u, i, x)]})

    return df.repartition(parts).mapInPandas(pack, PACKED)


def nearest(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    *,
    k: int,
    every: int,
    shard_rows: int,
    query_rows: int,
    zero_ok: bool,
    score_type: str,
    prepare: Callable[[np.ndarray], np.ndarray],
    build: Callable[[np.ndarray, np.ndarray, np.ndarray], bytes],
    load: Callable[[bytes], object],
    search: Callable[[np.ndarray, np.ndarray, object, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]],
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of every query (ids divisible by ``every``)."""
    small_batches(df.sparkSession)
    rows = valid_vectors(df, id_col, vec_col, zero_ok).withColumn("uid", F.monotonically_increasing_id())
    rows = materialize(rows, "vectors")
    n, dims, n_queries = rows.agg(F.count("*"), F.max(F.size("vec")), F.count_if(F.col("vec_id") % every == 0)).first()
    dims = dims or 1
    shards = max(1, math.ceil(n / shard_rows))
    raw = lambda u, i, x: prepare(x).tobytes()
    blocks = max(1, math.ceil(n_queries / query_rows))
    lanes = min(blocks, max(1, math.ceil(2 * df.sparkSession.sparkContext.defaultParallelism / shards)))
    index = packed(rows, shards, dims, lambda u, i, x: build(u, i, prepare(x)))
    queries = packed(rows.filter(F.col("vec_id") % every == 0), blocks, dims, raw)
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    index = index.select("shard", upto(lanes).alias("lane"), F.lit(0).alias("kind"), "uids", "ids", "data")
    queries = queries.select(upto(shards).alias("shard"), (F.col("shard") % lanes).alias("lane"), F.lit(1).alias("kind"), "uids", "ids", "data")
    dealt = index.unionByName(queries).repartition(F.col("shard"), F.col("lane")).sortWithinPartitions("shard", "lane", "kind")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uid = ids = held = None
        for f in frames:
            for r in f.itertuples(index=False):
                own_uid, own_id = np.frombuffer(r.uids, np.int64), np.frombuffer(r.ids, np.int64)
                if r.kind == 0:
                    uid, ids, held = own_uid, own_id, load(r.data)
                    continue
                at, hit, score = search(np.frombuffer(r.data).reshape(len(own_id), dims), own_uid, held, uid, ids)
                yield pd.DataFrame({"uid": own_uid[at], "query_id": own_id[at], "vec_id": ids[hit], "score": score})

    hits = dealt.mapInPandas(run, HITS.format(kind=score_type))
    best = Window.partitionBy("uid").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        hits.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row, summed alike for every pair, so equal vectors get equal scores."""
    return (q * x).sum(-1)


class Best:
    """The ``k`` best (score, id, position) of each query so far; larger scores, then smaller ids, are better."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), -np.inf)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        self.at = np.full((queries, k), -1)

    def worst(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Take in candidates, each with its query's row."""
        own, of = np.unique(rows, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(own)), self.k), of])
        s = np.concatenate([self.score[own].ravel(), score])
        i = np.concatenate([self.id[own].ravel(), ids])
        a = np.concatenate([self.at[own].ravel(), at])
        order = np.lexsort((i, -s, of))
        first = np.searchsorted(of[order], np.arange(len(own)))
        order = order[np.arange(len(order)) - first[of[order]] < self.k]
        for held, x in ((self.score, s), (self.id, i), (self.at, a)):
            held[own] = x[order].reshape(len(own), self.k)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, col = np.nonzero((self.at >= 0) & (self.score > -np.inf))
        return row, self.at[row, col], self.score[row, col]
