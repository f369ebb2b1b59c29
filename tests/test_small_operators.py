import pytest
from pyspark.sql import functions as F

from lakeloom.functions import expressions as X
from lakeloom.operators import ledger, monitoring, statistics


def test_power_rounds_halves_to_even_and_needs_digits(spark):
    rows = [("75 hp", 55), ("7 5", 55), ("none", 55), (None, 55), ("75", None), ("76", 55), ("0", 0)]
    got = spark.createDataFrame(rows, "t string, k int").select(X.same_power(F.col("t"), F.col("k"))).collect()
    assert [r[0] for r in got] == [True, True, None, None, None, False, True]


def test_cells_of_null_classes_and_weights(spark):
    df = spark.createDataFrame([("a", None, 2.0), ("a", None, None), ("a", "x", 6.0), (None, "x", 0.0)], "r string, c string, w double")
    got = {(r["r"], r["c"]): tuple(r)[2:] for r in statistics.histogram_2d(df, "r", "c", "w").collect()}
    assert got == {("a", None): (2, 2.0, 0.25, 0.25), ("a", "x"): (1, 6.0, 0.75, 0.75), (None, "x"): (1, 0.0, None, 0.0)}
    assert statistics.histogram_2d(df.limit(0), "r", "c", "w").count() == 0


@pytest.mark.parametrize("high, alert", [(1, False), (2, True)])
def test_quantile_needs_enough_events_and_over_the_share(spark, high, alert):
    rows = [("2024-01-01 00:10:00", 9.0 if i < high else 1.0) for i in range(20)] + [("2024-01-01 01:10:00", 9.0)] * 19 + [("2024-01-01 01:10:00", None)]
    df = spark.createDataFrame(rows, "ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert [tuple(r)[1:] for r in monitoring.quantile_over(df, "ts", "v", 60, 5.0).collect()] == [(20, high, alert)]


def test_latest_under_a_filter(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b"), (2, "a"), (None, "a")], "n int, k string")
    assert [r["n"] for r in ledger.latest_under(df, F.col("k") == "a", ["n"], 2).collect()] == [2, 1]
    assert ledger.latest_under(df, F.col("k") == "c", ["n"]).count() == 0
