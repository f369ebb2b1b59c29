import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import boosting, statistics

ROW = "y double, a double, b double, c string, d int, _note string"


def rows(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b, c, d = rng.choice([None, *[rng.uniform(0, 10)] * 9]), float(rng.randrange(5)), rng.choice([None, "x", "y", "z"]), rng.randrange(3)
        y = 3 * (a or 0) + (10 if c == "y" else 0) - b * d + rng.expovariate(0.5) * (1 + d)
        out.append((y, a, b, c, d, "n"))
    return [*out, (None, 1.0, 1.0, "x", 1, "n")]


def plain_fit(bins, y, share, rounds, depth, rate, least):
    """Boosting over whole arrays: the same splits and leaves, one node at a time."""
    p = np.full(len(y), np.quantile(y, share))
    for _ in range(rounds):
        nodes, step = [(np.arange(len(y)), 0)], np.zeros(len(y))
        while nodes:
            at, level = nodes.pop()
            best = None
            if level < depth:
                g = share - (y[at] < p[at])
                for f in range(bins.shape[1]):
                    for edge in np.unique(bins[at, f])[:-1]:
                        left = bins[at, f] <= edge
                        if min(left.sum(), (~left).sum()) >= least:
                            gain = g[left].sum() ** 2 / left.sum() + g[~left].sum() ** 2 / (~left).sum() - g.sum() ** 2 / len(g)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                                best = gain, left
            if best:
                nodes += [(at[best[1]], level + 1), (at[~best[1]], level + 1)]
            elif level:
                step[at] = rate * np.quantile(y[at] - p[at], share)
        p = p + step
    return p


@pytest.fixture(scope="module")
def train(spark):
    return spark.createDataFrame(rows(600, 1), ROW)


@pytest.fixture(scope="module")
def model(train):
    return boosting.fit(train, "y", ["a", "b", "d"], ["c"], share=0.8, rounds=4, depth=3, rate=0.3, least=10, bins=8)


def test_equals_boosting_over_whole_arrays(train, model):
    t = boosting.binned(train.where("y is not null"), model.numbers, model.categories).toPandas()
    want = plain_fit(t[[f"_bin{i}" for i in range(4)]].to_numpy(), t["y"].to_numpy(), 0.8, 4, 3, 0.3, 10)
    got = boosting.predict(model, train.where("y is not null")).toPandas()
    assert np.allclose(sorted(got["predicted"]), sorted(want), atol=1e-9) and list(got.columns) == [*train.columns, "predicted"]
    assert len(model.trees) == 4 and max(n.cover for n in model.trees[0]) == 600


def test_pinball_loss_on_held_out_rows_beats_class_quantiles(spark, train, model):
    test = spark.createDataFrame(rows(500, 2), ROW).where("y is not null")
    classes = statistics.range_by_class(train.where("y is not null"), "y", ["c"], 0.6).select(F.coalesce("c", F.lit("-")).alias("k"), F.col("upper").alias("q"))
    loss = lambda df, p: df.agg(F.avg(boosting.pinball(F.col("y"), F.col(p), 0.8))).first()[0]
    by_class = test.withColumn("k", F.coalesce("c", F.lit("-"))).join(classes, "k")
    assert loss(boosting.predict(model, test), "predicted") < loss(by_class, "q")


def test_rounds_end_early_and_the_best_stay(spark, train):
    noise = spark.createDataFrame([(random.Random(i).random(), float(i % 7), 0.0, "x", 0, "n") for i in range(200)], ROW)
    m = boosting.fit(noise, "y", ["a", "b"], [], rounds=12, depth=2, rate=0.5, least=5, bins=4, validation=train.where("y < 5").withColumn("y", F.col("y") / 5), patience=2)
    assert len(m.losses) < 12 and len(m.trees) == m.losses.index(min(m.losses)) + 1
    assert boosting.fit(noise, "y", ["a"], [], rounds=1, validation=noise.limit(0)).trees


def test_contributions_and_base_equal_predictions(train, model):
    got = boosting.contributions(model, boosting.predict(model, train)).toPandas()
    parts = got[["base", *[f"contribution_{f}" for f in model.features]]].sum(axis=1)
    assert np.allclose(parts, got["predicted"], atol=1e-9)


def test_contributions_equal_all_subsets(model):
    rng = np.random.default_rng(0)
    for tree in model.trees:
        bins = rng.integers(0, 9, size=(20, 4))

        def expected(at, row, known):
            n = tree[at]
            if n.feature < 0:
                return n.value
            if n.feature in known:
                return expected(n.left if row[n.feature] <= n.edge else n.right, row, known)
            return sum(expected(c, row, known) * tree[c].cover for c in (n.left, n.right)) / n.cover

        base, got = boosting.tree_contributions(tree, bins)
        for row, own in zip(bins, got):
            assert math.isclose(base, expected(0, row, ()), abs_tol=1e-9)
            for f in range(4):
                others = [g for g in range(4) if g != f]
                want = sum(math.factorial(k) * math.factorial(3 - k) / 24 * (expected(0, row, (*s, f)) - expected(0, row, s)) for k in range(4) for s in itertools.combinations(others, k))
                assert math.isclose(own[f], want, abs_tol=1e-9)


def test_staged_predictions_equal_cut_models(train, model):
    got = boosting.staged(model, train, [0, 1, 3, 9]).groupBy("n_trees").agg(F.sum("predicted").alias("s")).collect()
    for r in got:
        cut = model._replace(trees=model.trees[: r["n_trees"]])
        assert math.isclose(r["s"], boosting.predict(cut, train).agg(F.sum("predicted")).first()[0], rel_tol=1e-12)
    assert {r["n_trees"] for r in got} == {0, 1, 3, 9}


def test_empty_table_and_one_value(spark, train):
    m = boosting.fit(train.limit(0), "y", ["a"], ["c"], rounds=2)
    assert m.base == 0.0 and not m.trees and boosting.predict(m, train.limit(3)).count() == 3 and boosting.contributions(m, train.limit(3)).count() == 3
    same = spark.createDataFrame([(2.0, 1.0, None, None, 1, "n")] * 50, ROW)
    m = boosting.fit(same, "y", ["a", "b"], ["c"], rounds=2)
    assert {r["predicted"] for r in boosting.predict(m, same).collect()} == {2.0}
