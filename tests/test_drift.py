import math
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.functions.probability import chi2_tail, kolmogorov_tail
from lakeloom.operators import drift

ROW = "run int, window int, x double, c string, feature string"


def drifts(spark, windows, reference):
    w, r = (spark.createDataFrame(x, ROW) for x in (windows, reference))
    return drift.window_drift(w, r, {"x": F.col("x"), "x2": F.col("x") * 2}, {"c": F.col("c")})


def plain(windows, reference):
    """Every test by itself, over all values of both sides."""
    out = {}
    for key in sorted({r[:2] for r in windows}):
        own = [r for r in windows if r[:2] == key]
        for name, f in (("x", 1), ("x2", 2)):
            a, b = ([f * r[2] for r in rows if r[2] is not None and not math.isnan(r[2])] for rows in (reference, own))
            d = 0.0
            if len(a) >= 2 and len(b) >= 2:
                d = max(abs(sum(v <= x for v in a) / len(a) - sum(v <= x for v in b) / len(b)) for x in {*a, *b})
            out[(*key, name)] = (len(b), round(d, 9), round(kolmogorov_tail(d, len(a), len(b)), 9))
        a, b = ([r[3] or drift.MISSING for r in rows] for rows in (reference, own))
        kinds = sorted({*a, *b})
        total = 0.0
        if len(kinds) > 1 and a:
            for k in kinds:
                for side in (a, b):
                    e = (a.count(k) + b.count(k)) * len(side) / (len(a) + len(b))
                    total += (side.count(k) - e) ** 2 / e
        out[(*key, "c")] = (len(b), round(total, 9), round(chi2_tail(total, len(kinds) - 1 if a else 0), 9))
    return out


def found(df):
    return {(r["run"], r["window"], r["feature"]): (r["n_values"], round(r["statistic"], 9), round(r["p"], 9)) for r in df.collect()}


def rows(n, seed, run=0):
    rng = random.Random(seed)
    return [(run, rng.randrange(3), rng.choice([None, math.nan, *[rng.gauss(run / 3, 1), float(rng.randrange(4))] * 5]), rng.choice([None, "a", "b", "c", f"only{seed}"]), "x") for _ in range(n)]


def test_every_window_and_feature_equals_its_own_test(spark):
    windows, reference = rows(300, 1) + rows(200, 2, 1), rows(400, 3)
    got = found(drifts(spark, windows, reference))
    assert got == plain(windows, reference) and len(got) == 18


@pytest.mark.parametrize("windows, reference", [
    ([(0, 0, None, None, None), (0, 0, None, "a", None)], [(0, 0, 1.0, "a", None), (0, 0, 2.0, "b", None)]),
    ([(0, 0, 1.0, "a", None)], [(0, 0, 1.0, "a", None)] * 5), ([(0, 0, 1.0, "a", None)] * 4, []), ([], [(0, 0, 1.0, "a", None)]),
    ([(0, 0, 1.0, "new", None)] * 9, [(0, 0, 1.0, "old", None)] * 9),
])
def test_missing_few_and_equal_values(spark, windows, reference):
    assert found(drifts(spark, windows, reference)) == plain(windows, reference)


def test_flags_are_bonferroni_over_the_features(spark):
    tests = spark.createDataFrame([(0, 0, 0.0024), (0, 0, 0.5), (0, 1, 0.0026), (0, 1, 0.9)], "run int, window int, p double")
    got = {r["window"]: (r["features"], r["threshold"], r["drifted_features"], r["flagged"]) for r in drift.window_flags(tests, 2).collect()}
    assert got == {0: (2, 0.0025, 1, True), 1: (2, 0.0025, 0, False)}
