import math

import numpy as np
import pytest

from lakeloom.llm import queries, topk

TYPES = "vec_id long, embedding array<float>, label int, score long, rank string"


def plain(rows, k=10, every=100):
    """All products with every candidate, in Python integers."""
    ok = {(i, tuple(v)) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in ok]
    out = []
    for i, q in whole:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in whole if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, None, None, "x") for i, v in rows], TYPES)


@pytest.fixture
def small_parts(monkeypatch):
    for name, n in (("GROUP", 64), ("BUCKET", 16), ("QUERIES", 3), ("HEAD", 4)):
        monkeypatch.setattr(topk, name, n)


def test_equals_all_products_on_the_table(spark):
    t = queries.table(spark, "/root/testdata/sf0.01", "embeddings")
    assert found(topk.top_products(t)) == plain([tuple(r) for r in t.collect()])


@pytest.mark.parametrize("spread", [0.0, 1.0, 3.0])
def test_lengths_of_any_spread_in_many_groups(spark, small_parts, spread):
    rng = np.random.default_rng(int(spread * 10))
    centres = rng.normal(size=(12, 8))
    rows = [(i, [float(np.float32(x)) for x in (centres[i % 12] + 0.2 * rng.normal(size=8)) * math.exp(spread * rng.normal())]) for i in range(700)]
    assert found(topk.top_products(frame(spark, rows))) == plain(rows)


def test_one_vector_for_a_third_of_all_rows_and_ties(spark, small_parts):
    rng = np.random.default_rng(5)
    rows = [(i, [0.5, 0.5, -0.25] if i % 3 == 0 else [float(np.float32(x)) for x in rng.normal(size=3)]) for i in range(600)]
    assert found(topk.top_products(frame(spark, rows))) == plain(rows)


def test_nulls_repeats_sizes_zeros_and_negative_scores(spark, small_parts):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [-1.0, -1.0]), (200, None), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, [float("inf")]), (None, [9.0, 9.0]),
        (600, []), (700, [0.0, 0.0]), (1, [1.0]), (2, [3.0, 1.0, 5.0]), (2, [3.0, 1.0, 5.0]), (3, [2.0, 2.0]), (3, [1.0, 2.0]), (4, [1e-5, -1e-5]), (800, [7.0, -8.0]),
    ]
    want = plain(rows)
    assert found(topk.top_products(frame(spark, rows))) == want
    assert {q for q, *_ in want} == {0, 100, 600, 700, 800}


def test_components_too_large_for_doubles_stay_exact(spark, small_parts):
    rows = [(100, [3e5, 1.0]), (1, [2.5e5, 7.0]), (2, [2.5e5, 8.0]), (3, [-4e5, 1e30])]
    out = found(topk.top_products(frame(spark, rows)))
    assert out[0] == (100, 1, 3, topk.HIGHEST)
    assert [r[2] for r in out[1:]] == [2, 1] and out[1:] == [(100, n, j, 307200000 * 256000000 + 1024 * x * 1024) for n, j, x in ((2, 2, 8), (3, 1, 7))]


def test_empty_table_and_no_queries(spark):
    assert found(topk.top_products(frame(spark, []))) == []
    assert found(topk.top_products(frame(spark, [(1, [1.0]), (2, [1.0])]))) == []
    assert found(topk.top_products(frame(spark, [(100, [1.0])]))) == []


def test_both_ways_of_pruning_are_taken(small_parts):
    rng = np.random.default_rng(1)
    v = rng.integers(-1000, 1000, size=(64, 8))
    v[::4] = v[0] + rng.integers(-9, 9, size=(16, 8))
    lengths = np.sqrt((v.astype(float) ** 2).sum(1))
    order = np.argsort(-lengths)
    bucket = topk._Bucket(np.arange(64)[order], lengths[order], v[order])
    top = int((v @ v[0]).max())
    best = topk._Best(3, [int(0.97 * top), -topk.HIGHEST])
    topk._search(best, np.array([1000, 1001]), lengths[[0, 1]], v[[0, 1]], bucket)
    assert bucket.sorted, "the high bound goes by a coordinate"
    for q in (0, 1):
        want = sorted(((-int(s), i) for i, s in enumerate(v @ v[q])))[:3]
        assert [(-s, i) for s, i in zip(*map(list, best.rows[q]))] == want
