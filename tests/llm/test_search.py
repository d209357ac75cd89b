"""Exact top-k search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm.topk import BallTree, search, top_k


def brute(rows, k=5):
    good = {
        i: np.floor(np.array(v, dtype=np.float32).astype(float) * 256).astype(np.int64)
        for i, v, _ in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    out = set()
    for q in good:
        if q % 50 == 0:
            best = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("shard_rows, block", [(100_000, 1000), (60, 3)])
def test_top_k(spark, shard_rows, block):
    rng = np.random.default_rng(1)
    rows = [(n, rng.standard_normal(12).tolist(), 0) for n in range(400)]
    rows += [(400 + n, rows[50][1], 0) for n in range(200)]  # ties
    rows += [(700, None, 0), (750, [float("nan")] * 12, 0), (None, [1.0] * 12, 0), (800, [None] * 12, 0)]
    got = top_k(frame(spark, rows), F.col("id") % 50 == 0, shard_rows=shard_rows, block_queries=block)
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_few_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [0.5, -1.0], 1), (50, [0.0, 0.0], 1)]
    assert {tuple(r) for r in top_k(frame(spark, rows), F.col("id") % 50 == 0).collect()} == brute(rows)
    empty = top_k(frame(spark, []), F.col("id") % 50 == 0)
    assert empty.collect() == [] and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_bound_holds_and_prunes():
    rng = np.random.default_rng(2)
    rows = (rng.standard_normal((3000, 4)) * 300).astype(np.int64)
    tree = BallTree.build(np.arange(3000), rows)
    queries = rows[:40]
    bound = tree.bounds(queries, np.arange(len(tree.child)))
    for node in range(0, len(tree.child), 7):
        inside = queries @ tree.rows[tree.begin[node] : tree.end[node]].T
        assert (inside.max(1) <= bound[:, node]).all()
    best = search(tree, np.arange(40), queries, 5, np.full(40, -np.inf), False)
    scores = queries @ rows.T
    scores[np.arange(40), np.arange(40)] = -(10**12)
    assert (np.sort(scores, axis=1)[:, ::-1][:, :5] == best.score).all()
