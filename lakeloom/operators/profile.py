"""Composition of columns: shares of levels, folded tails, quantiles, and vocabularies decided by training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.running import exact_quantiles


def composition(df: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """dimension, level, rows and share of all rows; null is a level. One pass over the table."""
    cube = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("(missing)")).alias("level")) for d in dimensions])).alias("e")).select("e.*")
    counts = cube.groupBy("dimension", "level").agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy("dimension")), 6))


def top_with_other(df: DataFrame, column: str, k: int, always: Sequence[str] = ()) -> DataFrame:
    """The k most frequent levels and those always shown; the rest as ``other``. Null is never shown."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "level"))  # one row for each level
    return counts.withColumn("r", rank).groupBy(F.when((F.col("r") <= k) | F.col("level").isin(list(always)), F.col("level")).otherwise("other").alias("level")).agg(F.sum("n").alias("n"))


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """column, share and exact value with linear interpolation."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])).alias("e")).select("e.*")
    wide = exact_quantiles(long, "x", shares, ["column"])
    rows = [F.struct(F.lit(float(s)).alias("share"), F.col(f"q{j}").alias("value")) for j, s in enumerate(shares)]
    return wide.select("column", F.explode(F.array(*rows)).alias("r")).select("column", "r.share", F.round("r.value", 6).alias("value"))


def frequent_items(df: DataFrame, items: str, share: float) -> DataFrame:
    """Items of more than ``share`` of all rows (strictly; rows with null lists count), each row once."""
    total = df.agg(F.count("*").alias("total"))
    counts = df.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).where(F.col("n") > share * F.col("total")).select("item", "n")


def frequent_levels(df: DataFrame, column: str, share: float) -> DataFrame:
    """Levels of more than ``share`` of all rows, null rows counting in the total."""
    return frequent_items(df.select(F.when(F.col(column).isNotNull(), F.array(column)).alias("_items")), "_items", share)


def vocabulary(train: DataFrame, categories: Sequence[str], items: dict[str, float]) -> dict:
    """What training rows decide: ordered levels of categories and frequent items of lists, as a small dictionary."""
    levels = train.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in categories]).first().asDict() if categories else {}
    return {"train_rows": train.count(), "categories": levels, "items": {c: [r["item"] for r in frequent_items(train, c, s).orderBy("item").collect()] for c, s in items.items()}}


def support_break_even(df: DataFrame, column: str, least: int) -> DataFrame:
    """For each level, the share of the table at which it falls under ``least`` rows."""
    n = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share_needed", F.round(F.lit(float(least)) / F.col("n"), 6)).withColumn("supported", F.col("n") >= least)
