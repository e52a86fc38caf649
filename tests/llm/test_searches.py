from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketspark.llm import segments, vptree


def brute(rows, k, every, scale=None):
    """query uid -> (score, id) of the k best, ties to smaller ids."""
    dims = max(len(v) for _, v in rows)
    x = np.array([[*v, *[0.0] * (dims - len(v))] for _, v in rows], float)
    if scale:
        x = np.floor(x * scale)
    out = {}
    for i, (q, _) in enumerate(rows):
        if q % every == 0:
            scores = sorted(((-(x[i] * x[j]).sum(), r[0]) for j, r in enumerate(rows) if j != i))[:k]
            out.setdefault(q, []).append([(-s, v) for s, v in scores])
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    x = (centres[rng.integers(0, 5, 700)] + 0.7 * rng.normal(size=(700, 16))).round(3)
    x[100:140] = x[100]  # a group of copies
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


SCHEMA = "vec_id long, embedding array<double>, vec string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)


def test_exact_at_factor_one(spark, vectors):
    got = found(vptree.vp_search(frame(spark, vectors), k=20, factor=1.0, shard_rows=300, query_rows=16))
    want = {q: v[0] for q, v in brute(vectors, 20, 20).items()}
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert all(s == pytest.approx(t, abs=1e-12) for q in got for (s, _), (t, _) in zip(got[q], want[q], strict=True))


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got, want = found(vptree.vp_search(df, shard_rows=1000)), brute(rows, 20, 20)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in v[0]}) for q, v in want.items())
    assert hits >= 0.95 * 20 * len(want)


def test_integer_scores_are_exact(spark, vectors):
    got = found(segments.segment_topk(frame(spark, vectors), k=20, shard_rows=300, query_rows=16))
    assert got == {q: [(int(s), i) for s, i in v[0]] for q, v in brute(vectors, 20, 20, 64).items()}


ODD = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [2.0]), (8, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0])]


def test_odd_vectors(spark):
    got = found(vptree.vp_search(frame(spark, ODD), k=20))
    assert got[0] == [(5.0, 8), (5.0, 20), (5.0, 20), (2.0, 7)]
    assert len(got[20]) == 2 * 4  # either row of id 20 finds the other
    scaled = found(segments.segment_topk(frame(spark, ODD), k=20))
    assert [i for _, i in scaled[0]] == [8, 20, 20, 7, 5]


@pytest.mark.parametrize("search", [vptree.vp_search, segments.segment_topk])
def test_empty(spark, search):
    assert search(spark.createDataFrame([], SCHEMA)).collect() == []
    assert search(frame(spark, [(20, [1.0])])).collect() == []
    assert search(frame(spark, [(20, [1.0]), (1, [1.0])]).filter(F.col("vec_id") > 0)).count() == 1


def test_bounds_leave_few_pairs():
    rng = np.random.default_rng(5)
    x = np.floor(64 * rng.normal(size=(6000, 64)))
    stats = [segments.statistics(x, s) for s in segments.levels(64)]
    at, hit, score, scored = segments.search_segments(stats, x, np.arange(6000), np.arange(6000), x[:100], np.arange(100), 20)
    want = x[:100] @ x.T
    want[np.arange(100), np.arange(100)] = -np.inf
    assert sorted(zip(at.tolist(), score.tolist(), strict=True)) == sorted((i, int(s)) for i, row in enumerate(want) for s in sorted(row)[-20:])
    assert scored < 0.75 * 600_000 and len(hit) == 2000


def test_components_too_large_for_exact_sums(spark):
    with pytest.raises(Exception, match="too large"):
        segments.segment_topk(frame(spark, [(0, [1e9, 1.0]), (1, [1.0, 1.0])])).collect()


def test_only_scores_that_can_count_are_ranked(monkeypatch):
    """Survivors of the bounds below the k-th best known score aren't sorted with the others."""
    rng = np.random.default_rng(3)
    x = np.floor(64 * rng.standard_normal((2000, 64)))
    ids, held = np.arange(2000), []
    add = segments.Best.add
    monkeypatch.setattr(segments.Best, "add", lambda self, rows, *a: (held.append(len(rows)), add(self, rows, *a)))
    at, hit, score, scored = segments.search_segments([segments.statistics(x, s) for s in segments.levels(64)], x, ids, ids, x[:100], ids[:100], 20)
    assert sum(held) < scored / 4
    full = x[:100] @ x.T
    full[ids[:100], ids[:100]] = -np.inf
    want = [sorted(range(2000), key=lambda c: (-row[c], c))[:20] for row in full]
    assert [list(hit[at == r]) for r in range(100)] == want and (score == full[at, hit]).all()
