import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as c
from lakeloom.llm import pii, quality
from lakeloom.llm.shared import counted, seen

SF = "/root/testdata/sf0.001"


def executions(spark) -> int:
    """SQL executions of this session so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store = spark._jsparkSession.sharedState().statusStore()
    return int(store.executionsCount())


def test_stages_start_few_queries(spark):
    """Each query leaves plans, threads and compiled code in the driver; before, quality started 58 and near_dedup 52."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for stage, most in ((c.quality_stage, 26), (c.near_dedup_stage, 34)):
        before = executions(spark)
        stage(spark, docs, SF)
        assert 0 < executions(spark) - before <= most


def test_the_surrogate_is_a_small_expression(spark):
    """Before, its plan held over 6000 expressions."""
    one = spark.createDataFrame([("given", "Ann", "f")], "kind string, value string, gender string").repartition(1)
    plan = one.select(pii.surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.lit(0), "k").alias("s"))._jdf.queryExecution().optimizedPlan()
    exprs = plan.expressions()
    assert sum(exprs.apply(i).treeString().count("\n") for i in range(exprs.size())) < 3000


def test_counted_tables_know_their_rows(spark):
    df = spark.range(100).withColumn("large", F.col("id") > 89)
    out = counted(df, "test-counted", large=F.col("large"))
    assert (seen(out), seen(out, "large"), out.count()) == (100, 10, 100)
    none = counted(df.where("id < 0"), "test-counted", large=F.col("large"))
    assert (seen(none), seen(none, "large"), none.count()) == (0, 0, 0)
    assert seen(df) == 100


def test_collected_tables_equal_the_models(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40").select("text", (F.col("doc_id") % quality.FOLDS).cast("int").alias("fold"))
    model = quality.build_model(quality.held_out_counts(quality.count_grams(docs)))
    got = quality._collected(model)
    assert set(got) == set(range(quality.FOLDS + 1))
    for fold, (tables, characters) in got.items():
        assert characters == model[1]["grams"].where(F.col("fold") == fold).count()
        for n, both in quality.of_fold(model, fold).items():
            for what, df in both.items():
                rows = sorted(map(tuple, df.collect()))
                assert [k for k, _ in rows] == tables[n][what][0].tolist() and np.array_equal([v for _, v in rows], tables[n][what][1])
