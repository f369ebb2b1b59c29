"""The search of nearest rows makes no more pairs than it keeps, and misses none."""

import random

import numpy as np
import pytest

from lakeloom.operators import comparables


@pytest.mark.parametrize(("rounds", "spread"), [(64, 5), (64, 10_000), (1, 12), (0, 5)])
def test_closest_equals_a_plain_search(rounds, spread):
    rnd = random.Random(rounds + spread)
    rows = [(rnd.randrange(3), rnd.randrange(spread) / 8, rnd.randrange(40) / 8, i % 900) for i in range(1000)]
    queries = [(rnd.randrange(4), rnd.randrange(spread) / 8, rnd.randrange(40) / 8) for _ in range(200)]
    q, x = comparables._closest([np.array(c) for c in zip(*rows, strict=True)], [np.array(c) for c in zip(*queries, strict=True)], 5, 2.0, 0.25, rounds)
    got = {i: [] for i in range(200)}
    for i, j in zip(q.tolist(), x.tolist(), strict=True):
        got[i].append((abs(rows[j][1] - queries[i][1]), abs(rows[j][2] - queries[i][2]), rows[j][3]))
    for i, (g, m, a) in enumerate(queries):
        near = [(abs(y - m), abs(b - a), r) for h, y, b, r in rows if h == g and abs(y - m) <= 0.25 * m and abs(b - a) <= 2]
        assert sorted(got[i]) == sorted(near)[:5]


def test_sliced_cells_equal_a_plain_search(spark, monkeypatch):
    """One make whose rows are all alike: before, each query met each of them as a pair."""
    monkeypatch.setattr(comparables, "CELL", 100)
    index = spark.range(1000).selectExpr("id", "'a' AS make", "'x' AS model", "double(id % 2) AS age", "10.0D AS mileage")
    queries = [(1, None, 1.0, 10.0), (2, "x", None, 10.0), (3, "x", 0.0, None), (4, None, 3.0, 12.0), (5, "y", 1.0, 10.0), (6, "x", None, -1.0)]
    got = comparables.nearest(spark.createDataFrame([(q, "a", *r) for q, *r in queries], "query_id int, make string, model string, age double, mileage double"), index)
    want = {1: [1, 3, 5, 7, 9], 2: [0, 1, 2, 3, 4], 3: [0, 2, 4, 6, 8], 4: [1, 3, 5, 7, 9]}
    assert sorted(map(tuple, got.collect())) == [(q, r, i) for q, ids in want.items() for r, i in enumerate(ids, 1)]
