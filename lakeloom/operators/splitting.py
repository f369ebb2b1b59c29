"""Grouped hash splits, and the gate that looks at what they realised."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.expressions import assign_split, hash_position


def split_by_group(df: DataFrame, key: str, seed: str, ratios: Sequence[tuple[str, float]], name: str = "split") -> DataFrame:
    """Every row with the set of its group: a function of the seed and the group alone."""
    return df.withColumn(name, assign_split(hash_position(seed, F.col(key)), ratios))


def split_report(df: DataFrame, key: str, ratios: Sequence[tuple[str, float]], floor: float = 0.75, most: float = 0.05, sigmas: float = 5.0, cap: float = 0.15, name: str = "split") -> DataFrame:
    """rows, share, deviation and the fired rules of each set (one row each).

    Groups are summed first; everything after has one row for each group or set.
    """
    groups = df.groupBy(name, key).agg(F.count("*").alias("n"))
    sets = groups.groupBy(name).agg(F.sum("n").alias("rows"), F.max("n").alias("largest"))
    whole = groups.agg(F.sum("n").alias("total"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("spread"))
    wanted = df.sparkSession.createDataFrame(list(ratios), f"{name} string, ratio double")
    out = F.broadcast(wanted).join(sets, name, "left").crossJoin(F.broadcast(whole))
    rows, share = F.coalesce("rows", F.lit(0)), F.coalesce(F.col("rows"), F.lit(0)) / F.col("total")
    bound = F.least(sigmas * F.col("spread") / F.col("total") * F.sqrt(F.col("ratio") * (1 - F.col("ratio"))), F.lit(cap))
    fired = F.concat_ws(
        ",", F.when(rows == 0, "empty"), F.when(share < floor * F.col("ratio"), "floor"), F.when(F.coalesce(F.col("largest"), F.lit(0)) > most * F.col("total"), "concentration"), F.when(F.abs(share - F.col("ratio")) > bound, "dispersion")
    )
    return out.select(name, rows.alias("rows"), F.round(share, 6).alias("share"), F.round(share - F.col("ratio"), 6).alias("deviation"), F.round(bound, 6).alias("bound"), fired.alias("fired"))


def lossless(parts: DataFrame, source: DataFrame, key: Sequence[str], name: str = "split") -> DataFrame:
    """Rows of source and parts, and keys that lie in two parts: a partition loses nothing and shares nothing."""
    shared = parts.groupBy(*key).agg(F.count_distinct(name).alias("sets")).where("sets > 1").agg(F.count("*").alias("keys_in_two"))
    return source.agg(F.count("*").alias("source_rows")).crossJoin(parts.agg(F.count("*").alias("part_rows"))).crossJoin(shared)


def levels_with_support(df: DataFrame, column: str, least: int) -> DataFrame:
    """Levels of at least so many rows; null is none."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def disjoint_samples(df: DataFrame, key: str, seed: str, sizes: Sequence[tuple[str, int]]) -> DataFrame:
    """Disjoint samples of given sizes in hash order: only the first ``sum(sizes)`` rows by hash are sorted into one list."""
    total = sum(n for _, n in sizes)
    h = F.sha2(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")), 256)
    first = df.withColumn("_h", h).orderBy("_h").limit(total)
    rank = F.row_number().over(Window.orderBy("_h"))
    name: Column | None = None
    edge = 0
    for label, n in sizes:
        edge += n
        name = F.when(F.col("_r") <= edge, label) if name is None else name.when(F.col("_r") <= edge, label)
    return first.withColumn("_r", rank).withColumn("sample", name).drop("_h", "_r")
