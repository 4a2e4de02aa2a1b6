import numpy as np
import pytest
from pyspark.sql import functions as F

from casemesh.llm import topk_segments as T


def slow(rows, k=10):
    known = {(i, tuple(int(np.floor(1024 * x)) for x in v)) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, q in known:
        if i % 100 == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in known if j != i and len(v) == len(q))
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def found(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score long" if len(rows and rows[0] or ()) > 2
                               else "vec_id long, embedding array<double>").repartition(3)
    return sorted(map(tuple, T.top_k(df, F.col("vec_id") % 100 == 0, k).collect()))


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(5, 24))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=24)).tolist()) for i in range(700)]
    rows += [(701, rows[100][1]), (702, rows[100][1]), (703, None), (704, [None] * 24), (705, [float("nan")] * 24),
             (706, [float("inf")] * 24), (None, rows[1][1]), (707, [0.0] * 24), rows[5], (708, [1.0, 2.0]), (800, [0.5, 1.5]),
             (900, []), (901, [])]
    assert found(spark, rows) == slow(rows)


def test_small_and_empty(spark):
    rows = [(0, [1.0, -2.0]), (1, [0.1, 0.1]), (2, [0.1, 0.1])]
    assert found(spark, rows) == slow(rows)
    assert found(spark, []) == []
    clash = [(0, [1.0], 9, 9), (5, [2.0], 9, 9)]
    assert found(spark, clash) == [(0, 1, 5, 1024 * 2048)]


@pytest.mark.parametrize("seed", range(5))
def test_bounds_hold_and_prune(seed):
    rng = np.random.default_rng(seed)
    waves = np.cumsum(rng.normal(size=(40, 64)), axis=1).repeat(50, axis=0)  # neighbouring parts go together
    v = np.floor(1024 * (waves + 0.05 * rng.normal(size=(2_000, 64))))
    q = v[::200] + 1
    for s in T.LEVELS:
        assert (T._summary(q, s) @ T._summary(v, s).T + 1e-6 * np.abs(q @ v.T).max() >= q @ v.T).all()
    rows, at, score, computed = T.block_top(np.full(len(q), -1), q, np.arange(len(v)), v, 10)
    exact = q @ v.T
    for r in range(len(q)):
        assert score[rows == r].tolist() == np.sort(exact[r])[::-1][:10].astype(int).tolist()
    assert computed < 0.7 * len(q) * len(v)


def test_huge_components_stay_exact():
    q, v = np.array([[2.0**40, 3.0]]), np.array([[2.0**14 + 1, 5.0], [-(2.0**40), 0.0]])
    assert T._exact(q, v).tolist() == [[2**54 + 2**40 + 15, -(2**63)]]
