import datetime

import pytest
from pyspark.sql import functions as F

from lakeloom.contract import Column, Contract
from lakeloom.operators.expectations import Expectation, QualityError, check_suite, require
from lakeloom.plans import suites

CONTRACT = Contract("c", (Column("id", "bigint", False), Column("registration_date", "timestamp"), Column("mileage_km_raw", "double"), Column("price", "double", False), Column("make", "string")))
P = suites.SuiteParameters("2025-11-08", 500.0, 2_000_000.0, 0.0, 1_000_000.0, 100, required=("make",))
DAY = datetime.datetime(2020, 1, 1)


def frame(spark, change=lambda i, row: row, n=1000):
    rows = [change(i, {"id": i, "registration_date": DAY, "mileage_km_raw": 5.0, "price": 1000.0, "make": "a"}) for i in range(n)]
    return spark.createDataFrame([tuple(r.values()) for r in rows], CONTRACT.schema())


def failed(df, suite):
    return {r["rule"]: (r["elements"], r["missing"], r["unexpected"], r["unexpected_percent"]) for r in check_suite(df, suite).where("not passed").collect()}


def test_suites_hold_every_rule_and_pass_on_good_frames(spark):
    raw, interim = suites.raw_suite(CONTRACT, P), suites.interim_suite(CONTRACT, P)
    assert len(raw) == 1 + 5 + 2 + 1 + 2 + 1 + 2 and len(interim) == len(raw) + 1
    for suite in (raw, interim):
        got = check_suite(frame(spark), suite).collect()
        assert [r["rule"] for r in got] == [e.name for e in suite] and all(r["passed"] for r in got)
    require(check_suite(frame(spark), raw))


def test_tolerances_differ_between_the_suites(spark):
    late = lambda share: frame(spark, lambda i, r: r | {"registration_date": datetime.datetime(2030, 1, 1)} if i < share else r)
    assert failed(late(10), suites.raw_suite(CONTRACT, P)) == {} and set(failed(late(11), suites.raw_suite(CONTRACT, P))) == {"registration_date by reference"}
    assert failed(late(1), suites.interim_suite(CONTRACT, P)) == {"registration_date by reference": (1000, 0, 1, 0.1)}
    cheap = frame(spark, lambda i, r: r | {"price": 499.0} if i == 0 else r)
    assert failed(cheap, suites.raw_suite(CONTRACT, P)) == {} and set(failed(cheap, suites.interim_suite(CONTRACT, P))) == {"price range"}
    with pytest.raises(QualityError, match="price range: 1 of 1000"):
        require(check_suite(cheap, suites.interim_suite(CONTRACT, P)))


def test_nothing_passes_emptily(spark):
    suite = suites.raw_suite(CONTRACT, P)
    assert failed(frame(spark, n=0), suite) == {"rows": (0, 0, 100, 0.0)}
    assert set(failed(frame(spark, lambda i, r: r | {"mileage_km_raw": None}), suite)) == {"mileage_km_raw filled"}
    assert set(failed(frame(spark, lambda i, r: r | {"make": None if i < 11 else "a"}), suite)) == {"make filled"}
    with pytest.raises(ValueError):
        check_suite(frame(spark), [])
    with pytest.raises(ValueError):
        check_suite(frame(spark), [Expectation("x", "id", "not_null")] * 2)


def test_columns_and_types_are_rules(spark):
    suite = suites.raw_suite(CONTRACT, P)
    df = frame(spark)
    assert set(failed(df.select("id", "registration_date", "price", "mileage_km_raw", "make"), suite)) == {"columns"}
    assert set(failed(df.withColumn("price", F.col("price").cast("string")), suite)) == {"price type"}
    assert failed(df.drop("make"), suite) == {"columns": (1000, 0, 0, 0.0), "make type": (1000, 0, 0, 0.0), "make filled": (1000, 0, 1000, 100.0)}
    more = df.withColumn("extra", F.lit(1))
    assert set(failed(more, suite)) == {"columns"}
