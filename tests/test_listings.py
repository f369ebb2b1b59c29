import pytest
from pyspark.sql import functions as F

from lakeloom.plans import listings as L
from lakeloom.sources.synthetic import generate_listings
from lakeloom.sources.tables import SOURCES, SourceChangedError, load, read_csv, read_exposition, read_latency_histograms


@pytest.fixture(scope="module")
def raw(spark):
    return generate_listings(spark, 2000).cache()


def test_generated_rows_do_not_depend_on_partitions(spark, raw):
    again = load(spark, "synthetic", rows=2000).repartition(7)
    assert raw.exceptAll(again).count() == 0 and raw.count() == 2000
    with pytest.raises(ValueError):
        generate_listings(spark, 29)
    with pytest.raises(NotImplementedError):
        load(spark, "nowhere")
    assert {"csv", "json", "synthetic"} <= set(SOURCES)


def test_edge_cases_go_where_they_should(raw):
    p = L.Parameters()
    clean, funnel = L.cleaned(raw, p)
    kept = {r["id"] for r in clean.where("id like 'Z%'").collect()}
    assert kept == {f"Z{i:09d}" for i in (1, 3, 4, 10, 11)}
    rows = [r["rows"] for r in funnel.orderBy("step").collect()]
    assert rows[0] == 2000 and rows == sorted(rows, reverse=True) and rows[-1] == clean.count()
    assert "seller_company_name" not in clean.columns


def test_splits_share_no_group_and_errors_come_out(raw):
    p = L.Parameters()
    clean, _ = L.cleaned(raw, p)
    parts = L.split(clean, p)
    assert parts.count() == clean.count()
    assert parts.where("split <> 'holdout'").groupBy("seller_group").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert parts.where("split = 'holdout' and country_code <> 'ES'").count() == 0
    out = L.evaluated(parts, p)
    assert out.where("counts").count() > 3 and out.agg(F.max("mdape")).first()[0] is not None


def test_readers(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_text('id,n\n"x ""q""",1.5\n,NaN\n')
    schema = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("id", T.StringType())])
    assert sorted(str((r["id"], r["n"])) for r in read_csv(spark, f"file://{tmp_path}/a.csv", schema).collect()) == sorted(["('x \"q\"', 1.5)", "(None, None)"])
    with pytest.raises(SourceChangedError):
        read_csv(spark, f"file://{tmp_path}/a.csv", T.StructType([T.StructField("z", T.StringType())]))
    with pytest.raises(SourceChangedError):
        read_csv(spark, f"file://{tmp_path}/a.csv", schema, md5="0")
    (tmp_path / "m.prom").write_text('# HELP x\nx_bucket{le="+Inf"} 3\nx_sum 1.5\n')
    assert sorted(tuple(r) for r in read_exposition(spark, f"file://{tmp_path}/m.prom").collect()) == [("x_bucket", '{le="+Inf"}', 3.0), ("x_sum", "", 1.5)]
    (tmp_path / "l.json").write_text('[{"name": "/p", "response_times": {"10": 2, "20": 1}}]')
    assert sorted(tuple(r) for r in read_latency_histograms(spark, f"file://{tmp_path}/l.json").collect()) == [("/p", 10.0, 2), ("/p", 20.0, 1)]
