import datetime
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import counters
from lakeloom.operators.carry import carried
from lakeloom.streaming.alerts import alert_states

T0 = datetime.datetime(2024, 1, 1)
MIN = datetime.timedelta(minutes=1)


def samples(n, seed):
    rng, out = random.Random(seed), []
    for s in ("a", "b", None):
        at, v = T0, 0
        for i in range(n):
            at += MIN * rng.choice([0, 1, 30, 200, 2000])
            v = 0 if rng.random() < 0.1 else v + rng.choice([0, 1, 5])
            out.append((s, at, i, None if rng.random() < 0.1 else v))
    return out


def test_deltas_go_on_after_resets_and_over_days(spark):
    rows = samples(60, 1)
    got = {(r["s"], r["i"]): (r["delta"], r["changed"], r["reset"]) for r in counters.deltas(spark.createDataFrame(rows, "s string, ts timestamp, i int, v long"), ["s"], "ts", "v", "i").collect()}
    want, before = {}, {}
    for s, _, i, v in sorted((r for r in rows if r[3] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        p = before.get(s)
        want[s, i] = (0 if p is None else v if v < p else v - p, p is not None and v != p, p is not None and v < p)
        before[s] = v
    assert got == want


def test_windows_add_up_to_all_increases(spark):
    df = spark.createDataFrame(samples(80, 2), "s string, ts timestamp, i int, v long")
    w = counters.increases(df, ["s"], "ts", "v", 90, "i")
    d = counters.deltas(df, ["s"], "ts", "v", "i").agg(F.sum("delta"), F.count("*"), F.sum(F.col("reset").cast("int"))).first()
    assert tuple(w.agg(F.sum("increase"), F.sum("samples"), F.sum("resets")).first()) == tuple(d)
    r = w.where("increase > 0").first()
    assert r["rate"] == pytest.approx(r["increase"] / 5400)
    assert counters.increases(df.limit(0), ["s"], "ts", "v", 90, "i").count() == 0


def plain_alerts(rows, hold):
    out, since = [], {}
    for s, at, on in sorted(rows, key=lambda r: r[:2]):
        since[s] = (since.get(s) or at) if on else None
        out.append((s, at, since[s], "inactive" if not on else "firing" if at - since[s] >= hold * MIN else "pending"))
    return sorted(out)


def evaluations(n, seed):
    rng = random.Random(seed)
    return [(s, T0 + k * 400 * MIN, rng.choice([None, False, True, True, True])) for s in ("x", "y") for k in range(n)]


def test_alerts_hold_over_days_and_in_a_stream(spark, tmp_path):
    rows = evaluations(40, 3)
    schema = "s string, at timestamp, on boolean"
    want = plain_alerts(rows, 900)
    df = spark.createDataFrame(rows, schema)
    batch = counters.alerts(df, ["s"], "at", F.col("on"), 900)
    assert sorted(tuple(r[c] for c in ("s", "at", "since", "state")) for r in batch.collect()) == want
    for part in (rows[:13] + rows[40:55], rows[13:40] + rows[55:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        q = alert_states(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), "s", "at", F.col("on"), 900).writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start(f"file://{tmp_path}/out")
        assert q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").select("series", "ts", "since", "state").collect()) == want


def test_series_are_silent_before_their_first_sample_and_after_the_limit(spark):
    df = spark.createDataFrame([("a", T0 + 90 * MIN), ("a", T0 + 90 * MIN), ("b", T0 - 60 * MIN)], "s string, ts timestamp")
    got = {(r["s"], int((r["at"] - T0) / MIN)): r["silent"] for r in counters.silences(df, ["s"], "ts", "2024-01-01 00:00:00", "2024-01-01 03:00:00", 30, 60).collect()}
    assert [got["a", m] for m in range(0, 181, 30)] == [True, True, True, False, False, False, True]
    assert [got["b", m] for m in range(0, 91, 30)] == [False, True, True, True]


def test_carried_values_skip_nulls_and_buckets(spark):
    rows = [(k, i, None if i % 3 else i) for k in (1, None) for i in range(20)]
    got = carried(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], ["i"], F.floor(F.col("i") / 4), {"before": F.col("v")}).collect()
    assert {(r["k"], r["i"]): r["before"] for r in got} == {(k, i): ((i - 1) // 3 * 3 if i else None) for k in (1, None) for i in range(20)}
