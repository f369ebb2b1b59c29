import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.operators import statistics

EDGES = statistics.poisson_edges()


def weight(seed, key, draw):
    digest = hashlib.sha256(f"{seed}|{key}|{draw // 4}".encode()).hexdigest()
    u = int(digest[draw % 4 * 13 : draw % 4 * 13 + 13], 16) / (1 << 52)
    return sum(u >= e for e in EDGES)


def plain(rows, names, reference, draws, seed, confidence=0.95):
    rows = [r for r in rows if None not in r[1:]]
    v = np.array([r[1:] for r in rows])
    w = np.array([[weight(seed, "" if r[0] is None else r[0], d) for r in rows] for d in range(draws)])
    means = (w @ v) / w.sum(axis=1, keepdims=True)
    at = names.index(reference)
    others = [k for k in range(len(names)) if k != at]
    d, seen = means[:, others] - means[:, [at]], v.mean(axis=0)[others] - v.mean(axis=0)[at]
    spread = d.std(axis=0, ddof=1)
    z = np.divide(abs(d - seen), spread, out=np.zeros_like(d), where=spread > 0)
    m = np.percentile(z.max(axis=1), 100 * confidence)
    return {names[k]: (seen[i], *np.percentile(d[:, i], [2.5, 97.5]), (d[:, i] < 0).mean(), m, seen[i] - m * spread[i], seen[i] + m * spread[i]) for i, k in enumerate(others)}


def rows(n, seed):
    rng = np.random.default_rng(seed)
    return [(None if i % 11 == 0 else int(i % 40), float(x), float(x + rng.normal() - 1), float(x), None if i % 50 == 7 else float(x + rng.normal())) for i, x in enumerate(rng.normal(size=n))]


NAMES = ["r", "better", "same", "other"]


def compared(spark, data, names, draws=80):
    df = spark.createDataFrame(data, "g int, r double, better double, same double, other double")
    out = statistics.paired_comparisons(df, "g", {n: F.col(n) for n in names}, "r", draws, "s")
    return {r["candidate"]: r for r in out.collect()}


def test_equals_whole_arrays_with_nulls_and_equal_candidates(spark):
    data = rows(400, 1)
    got, want = compared(spark, data, NAMES), plain(data, NAMES, "r", 80, "s")
    for k, values in want.items():
        assert np.allclose([got[k][c] for c in ("difference", "lower", "upper", "share_better", "multiplier", "joint_lower", "joint_upper")], values, atol=1e-9), k
    assert got["better"]["better"] and not got["other"]["better"] and got["same"]["joint_lower"] == got["same"]["joint_upper"] == 0


def test_many_candidates_widen_the_joint_interval(spark):
    data = rows(400, 2)
    alone, many = compared(spark, data, ["r", "other"]), compared(spark, data, NAMES)
    assert alone["other"]["multiplier"] < many["other"]["multiplier"] or np.isclose(alone["other"]["multiplier"], many["other"]["multiplier"])
    assert 1.5 < alone["other"]["multiplier"] < 2.6


@pytest.mark.parametrize("data", [[], [(1, 1.0, 1.0, None, 1.0)]])
def test_no_whole_rows_and_no_candidates(spark, data):
    assert all(r["difference"] is None for r in compared(spark, data, NAMES).values())
    assert compared(spark, data, ["r"]) == {}
