import hashlib
import json

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import fields, folds, positions
from lakeloom.operators.fields import FieldError, FieldMap

COLUMNS = ("make", "mileage", "age_years", "comfort_a", "comfort_b", "smoke")
OWN = FieldMap(COLUMNS, {"comfort": ("comfort_a", "comfort_b", "comfort_c")}, {"registered": "age_years"}, ("make", "registered"))


def test_fields_expand_in_order_and_claims_are_refused():
    assert OWN.expanded() == {"make": ("make",), "mileage": ("mileage",), "registered": ("age_years",), "comfort": ("comfort_a", "comfort_b"), "smoke": ("smoke",)}
    assert OWN.optional() == ["comfort", "mileage", "smoke"]
    for bad in (FieldMap(COLUMNS, {"x": ("smoke",), "y": ("smoke",)}, {}), FieldMap(COLUMNS, {"x": ("age_years",)}, {"registered": "age_years"}), FieldMap(COLUMNS, {}, {"make": "age_years"}), FieldMap(COLUMNS, {}, {}, ("model",))):
        with pytest.raises(FieldError):
            bad.expanded()


ROWS = [(1, "a", 5.0, 2.0, True, None, True), (2, None, None, None, None, False, False), (3, "b", 1.0, 1.0, True, True, None)]
TYPES = "id int, make string, mileage double, age_years double, comfort_a boolean, comfort_b boolean, smoke boolean"


def test_omission_follows_types_rows_and_flags(spark):
    df, own = spark.createDataFrame(ROWS, TYPES), OWN.expanded()
    whole = fields.omit(df, own, ["comfort", "mileage", "make"])
    assert [tuple(r) for r in whole.orderBy("id").collect()] == [(1, None, None, 2.0, False, False, True), (2, None, None, None, False, False, False), (3, None, None, 1.0, False, False, None)]
    flags = F.when(F.col("id") == 1, F.array(F.lit(True), F.lit(False), F.lit(False))).when(F.col("id") == 2, F.array(F.lit(None), F.lit(False), F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True), F.lit(True)))
    part = fields.omit(df, own, ["smoke", "make", "smoke"], flags)
    assert [tuple(r) for r in part.orderBy("id").collect()] == [(1, "a", 5.0, 2.0, True, None, False), (2, None, None, None, None, False, False), (3, None, 1.0, 1.0, True, True, False)]
    assert part.schema == df.schema and fields.omit(df.limit(0), own, ["make"]).count() == 0
    with pytest.raises(FieldError):
        fields.omit(df, own, ["colour"])
    with pytest.raises(Exception, match="must be 2 flags"):
        fields.omit(df, own, ["smoke", "make"], F.array(F.lit(True))).collect()


def test_random_flags_follow_the_digest(spark):
    names = ["x", "y", "z", "w"]
    got = spark.range(200).select("id", fields.random_flags([F.col("id")], names, "s").alias("f")).collect()
    place = lambda name, key: int(hashlib.sha256(f"s|{name}|{key}".encode()).hexdigest()[:13], 16)
    for r in got:
        n = place("", r["id"]) % 4 + 1
        ranks = [place(x, r["id"]) for x in names]
        assert r["f"] == [x <= sorted(ranks)[n - 1] for x in ranks] and sum(r["f"]) == n
    assert {sum(r["f"]) for r in got} == {1, 2, 3, 4}


def test_body_features_of_unsent_odd_and_malformed_fields(spark):
    bodies = [{"registered": "2020-01", "mileage": 12.5, "make": "a", "more": [1]}, {"registered": "2020", "mileage": "12", "make": None}, {"mileage": "x"}, {}]
    rows = [(i, json.dumps(b), "f") for i, b in enumerate(bodies)] + [(4, "{", "f"), (5, None, "f")]
    df = spark.createDataFrame(rows, "id int, body string, _fields_of_body string")
    out = fields.body_features(df, "body", F.lit("2021-01-01"), ["mileage"], ["make"], "registered", "age_years")
    got = [tuple(r[c] for c in ("age_years", "mileage", "make", "age_years__missing", "mileage__missing")) for r in out.orderBy("id").collect()]
    none = (None, None, fields.UNSENT, "missing", "missing")
    assert got == [(366 / 365.25, 12.5, "a", "present", "present"), (None, 12.0, fields.UNSENT, "missing", "present"), none, none, none, none]
    empty = fields.body_features(df.limit(0), "body", F.lit("2021-01-01"), ["mileage"], ["make"], "registered", "age_years")
    assert empty.columns == [*df.columns, "age_years", "mileage", "make", "age_years__missing", "mileage__missing"]


def test_positions_follow_the_input_and_zip_like_lists(spark):
    left = spark.range(1000, numPartitions=7).select((F.col("id") * 3).alias("a"))
    right = spark.range(1000, numPartitions=3).select((F.col("id") * 3).alias("b"), F.lit("x").alias("c"))
    got = positions.side_by_side(left, right, {"a": "b"}).orderBy("position").collect()
    assert [(r["position"], r["a"], r["b"]) for r in got] == [(i, 3 * i, 3 * i) for i in range(1000)]
    for other in (right.limit(999), right.withColumn("b", F.col("b") + (F.col("b") == 30).cast("long"))):
        with pytest.raises(positions.PositionError):
            positions.side_by_side(left, other, {"a": "b"})
    with pytest.raises(positions.PositionError):
        positions.side_by_side(left, left)
    assert positions.side_by_side(left.limit(0), right.limit(0)).count() == 0


def test_folds_hold_whole_groups_and_alike_classes(spark):
    import numpy as np

    rows = [(g if g else None, c) for g in range(60) for c in ["a"] * (g % 5) + ["b"] * (g % 3) + ["c", None] * (g % 2)]
    df = spark.createDataFrame(rows, "g int, c string")
    got = {r["g"]: r["fold"] for r in folds.stratified_group_folds(df, "g", "c", ["a", "b"], 4).collect()}
    sizes = {}
    for g, c in rows:
        own = sizes.setdefault(g, [0, 0, 0])
        own[0] += 1
        if c in ("a", "b"):
            own[1 + (c == "b")] += 1
    order = sorted(sizes, key=lambda g: (-sizes[g][0], g is not None, str(g)))
    held, total, want = np.zeros((4, 2)), np.array([sum(s[k] for s in sizes.values()) for k in (1, 2)]), {}
    for g in order:
        cost = [round(sum(((held[f, k] + sizes[g][k + 1]) / total[k] - 0.25) ** 2 - (held[f, k] / total[k] - 0.25) ** 2 for k in (0, 1)), 12) for f in range(4)]
        want[g] = cost.index(min(cost))
        held[want[g]] += sizes[g][1:]
    assert got == want and abs(held / total - 0.25).max() < 0.05
    many = folds.stratified_group_folds(df, "g", "c", ["a", "b"], 4, shard=10)
    assert many.count() == len(sizes) and folds.stratified_group_folds(df.limit(0), "g", "c", ["a"], 3).count() == 0
