"""Tables that are dealt out or written between steps."""

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import lineage, requests


def test_effects_are_summed_in_parts_of_a_fixed_size(spark, monkeypatch):
    monkeypatch.setattr(lineage, "DEALT", 50)
    df = spark.range(1000).select((F.col("id") % 200).alias("r"), (F.col("id") % 5).cast("string").alias("f"), F.lit(100.0).alias("e"))
    out = requests.explained(df, "r", "f", "e", 2, 1000.0)
    assert out.rdd.getNumPartitions() == 20
    assert [r["percent"] for r in out.collect()] == pytest.approx([64.8721270700] * 200)


@pytest.mark.parametrize("name", ["learning_curve", "quantile_trees", "tree_contributions", "paired_comparisons", "gate_verdict"])
def test_listings_are_joined_once(spark, monkeypatch, name):
    from lakeloom.plans import catalogue

    joined = []
    monkeypatch.setattr(catalogue, "listings", lambda t, of=catalogue.listings: joined.append(1) or of(t))
    written = []
    monkeypatch.setattr(catalogue, "cut", lambda df, n, of=catalogue.cut: written.append(n) or of(df, n))
    catalogue.queries()[name](spark, "/root/testdata/sf0.001")
    assert len(joined) == 1 and "listings" in written
