import pytest
from pyspark.sql import functions as F

from lakeloom.contract import Column, Contract
from lakeloom.operators import reports, requests, simulation
from lakeloom.operators.requests import FieldCheck
from lakeloom.sources import sinks


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_every_fault_is_named(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, None, 50), (3, "zz", None)], "id int, level string, n int")
    out = requests.with_faults(df, [FieldCheck("n", low=1, high=10, required=True), FieldCheck("level", levels=("a", "b"), pattern="^.$")])
    assert {r["id"]: r["faults"] for r in out.collect()} == {1: [], 2: ["n: above 10"], 3: ["n: missing", "level: malformed", "level: not one of a, b"]}
    got = requests.accepted(df, df.where("id < 3"), "id", [FieldCheck("n", high=10)])
    assert values(got, "id", "class") == [(1, "accepted"), (2, "invalid_request"), (3, "unsupported_make")]
    assert values(requests.unseen_levels(df, {"level": ["a"]}), "id", "unseen") == [(1, []), (2, []), (3, ["level"])]


def test_bodies_are_cut_to_endpoints(spark):
    bodies = spark.createDataFrame([(1, {"make": "a", "age": "2", "x": None}), (2, {"age": "1"})], "id int, fields map<string,string>")
    endpoints = spark.createDataFrame([("p", ["make", "age"], ["make"]), ("q", ["age"], [])], "endpoint string, allowed array<string>, required array<string>")
    got = {(r["id"], r["endpoint"]): r["fields"] for r in requests.projected_bodies(bodies, endpoints).collect()}
    assert got == {(1, "p"): {"make": "a", "age": "2"}, (1, "q"): {"age": "2"}, (2, "q"): {"age": "1"}}
    back = requests.from_body(spark.createDataFrame([('{"a": 1}',), ("{broken",)], "body string"), "a int")
    assert values(back, "a") == [(1,), (None,)]


def test_effects_fold_into_the_rest(spark):
    df = spark.createDataFrame([(1, f, e) for f, e in (("a", 0.3), ("b", -0.2), ("c", 0.1), ("c", 0.05), ("d", 0.01))], "r int, f string, e double")
    got = {r["f"]: r["percent"] for r in requests.explained(df, "r", "f", "e", 2).collect()}
    assert set(got) == {"a", "b", "(other)"} and got["(other)"] == pytest.approx(17.3510871)
    assert requests.first_accepted(df, "f", "s", F.col("e") > 0, 2).count() == 2


def test_documents_are_compared_by_leaf(spark):
    a = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "path string, value string")
    b = spark.createDataFrame([("x", "2"), ("y", None), ("w", None)], "path string, value string")
    assert values(reports.leaf_difference(a, b), "path", "change") == [("w", "added"), ("x", "changed"), ("z", "removed")]
    j = spark.createDataFrame([('{"a": {"b": 1}, "c": [5]}',)], "doc string")
    assert values(reports.json_leaves(j, "doc", ["$.a.b", "$.c[0]", "$.q"]), "path", "value") == [("$.a.b", "1"), ("$.c[0]", "5"), ("$.q", None)]
    assert reports.joined_one_to_one(a, b.where("path in ('x', 'y')").union(a.where("path = 'z'")).withColumnRenamed("value", "v"), "path").count() == 3
    with pytest.raises(reports.IntegrityError):
        reports.joined_one_to_one(a, b, "path")


def test_open_conditions_block_promotion(spark):
    df = spark.createDataFrame([("a", True, True), ("b", True, None), ("c", False, None)], "v string, gate boolean, hash boolean")
    out = reports.promotion(df, {"gate": F.col("gate"), "hash": F.col("hash")})
    assert values(out, "v", "against", "promoted") == [("a", "", True), ("b", "hash", False), ("c", "gate,hash", False)]


def test_release_values_and_judgement(spark):
    v = spark.createDataFrame([("b", 1), ("b", 2), ("b", 3)], "variant string, version int")
    p = spark.createDataFrame([("b", 1, 0.1)], "variant string, version int, mdape double")
    r = spark.createDataFrame([("b", 2, 0.9)], "variant string, version int, coverage double")
    assert values(reports.release_values(v, p, r), "version") == [(1,), (2,)]
    w = spark.createDataFrame([(1, 1, 0), (2, 2, 1), (3, 3, 2)], "window int, version int, previous int")
    assert values(reports.judged_against(w, p), "window", "baseline_mdape") == [(1, 0.1), (2, 0.1), (3, None)]
    m = spark.createDataFrame([("up", {"b": 'q"x', "a": "1"}, 1.5), ("n", {}, 2.0)], "metric string, labels map<string,string>, value double")
    assert values(reports.exposition(m), "value") == [("n 2.0",), ('up{a="1",b="q\\"x"} 1.5',)]


def test_trials(spark):
    e = spark.range(4000).select(F.col("id").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("e"))
    n = simulation.trial_samples(e, "k", 20, 200, "s").groupBy("trial").count().agg(F.avg("count"), F.min("count")).first()
    assert 170 < n[0] < 230 and n[1] > 130
    r = simulation.power(e, "k", "e", 3.0, 1.5, 30, 300, "s").first()
    assert r["false_alarms"] == 0 and r["misses"] == 0
    assert 1 < simulation.median_ceiling(e, "k", "e", 60, 200, "s").first()["ceiling"] < 1.5
    kept = simulation.sparse_requests(e.select("k", F.lit("a").alias("a"), F.lit("b").alias("b")), ["k"], ["a", "b"], [0, 1, 2], "s")
    assert values(kept.groupBy("kept").agg(F.count("a") + F.count("b")).toDF("kept", "n"), "kept", "n") == [(0, 0), (1, 4000), (2, 8000)]
    assert simulation.family_confidence(5) == 0.99


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = f"file://{tmp_path}/t"
    assert sinks.append_new(df, path, ["k"], ["v"]) == 2
    assert sinks.append_new(df.union(spark.createDataFrame([(3, "z"), (3, "y")], df.schema)), path, ["k"], ["v"]) == 1
    assert values(spark.read.parquet(path), "k", "v") == [(1, "a"), (2, "b"), (3, "y")]
    out = sinks.write_conformed(df, f"file://{tmp_path}/c", Contract("c", (Column("v", "string"), Column("k", "bigint"))))
    assert out.columns == ["v", "k"] and dict(spark.read.parquet(f"file://{tmp_path}/c").dtypes)["k"] == "bigint"
    sinks.write_json_lines(df, f"file://{tmp_path}/j")
    assert spark.read.schema(df.schema).json(f"file://{tmp_path}/j").count() == 2
    sinks.write_table(df, f"file://{tmp_path}/h", ["v", "k"])
    assert spark.read.option("header", True).schema("v string, k int").csv(f"file://{tmp_path}/h").columns == ["v", "k"]
    with pytest.raises(ValueError):
        sinks.write_table(df, path, ["k"])
