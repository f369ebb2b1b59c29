"""Append-only tables: first-wins and latest-wins writes, label outcomes, retention and reconciliation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.operators.running import in_slices, slice_edges

#: Slices that a log is cut into at most to find where to prune it.
SLICES = 500


def first_wins(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows to append: the first new row of each key that the table doesn't hold."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return new.withColumn("_n", n).where("_n = 1").drop("_n").join(existing.select(*keys).distinct(), list(keys), "left_anti").select(*new.columns)


def latest_wins(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The table after writing: for each key the row with the largest ``order``; of several, the one with the largest other columns."""
    both = existing.unionByName(new, allowMissingColumns=True)
    others = [F.desc(f.name) for f in both.schema.fields if f.name not in (*keys, order) and not isinstance(f.dataType, T.MapType | T.VariantType)]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *others))
    return both.withColumn("_n", n).where("_n = 1").drop("_n")


def label_outcomes(labels: DataFrame, log: DataFrame, held: DataFrame, key: str, value: str, priced: str) -> DataFrame:
    """What becomes of each label: unknown, unpriced, stored, repeated or conflict. Only the first of a key can be stored."""
    first = F.first(value).over(Window.partitionBy(key).orderBy("received"))
    n = F.row_number().over(Window.partitionBy(key).orderBy("received"))
    j = labels.withColumn("_first", first).withColumn("_n", n).join(log.select(key, F.col(priced).alias("_priced"), F.lit(True).alias("_known")), key, "left").join(held.select(key, F.col(value).alias("_held")), key, "left")
    before = F.coalesce(F.col("_held"), F.when(F.col("_n") > 1, F.col("_first")))
    outcome = F.when(F.col("_known").isNull(), "unknown").when(~F.col("_priced"), "unpriced").when(before.isNull(), "stored").when(before == F.col(value), "repeated").otherwise("conflict")
    return j.select(*labels.columns, outcome.alias("outcome"))


def prune(log: DataFrame, seq: str, cap: int, target: float = 0.9) -> DataFrame:
    """The rows that stay when a log over ``cap`` rows is cut to ``target`` of it from the old end; the newest always stays.

    The cut is found from counts of slices between approximate quantiles of ``seq``, which gaps and outliers don't widen, and
    inside one slice, not by ranking the log.
    """
    total = log.count()
    if total <= cap:
        return log
    keep = max(1, int(cap * target))
    edges = slice_edges(log, seq, SLICES)
    cut = in_slices(log, seq, edges, "s")
    slices = cut.groupBy("s").agg(F.count("*").alias("n")).orderBy(F.desc("s")).collect()  # at most SLICES rows
    held, last = 0, slices[0]["s"]
    for r in slices:
        last = r["s"]
        if held + r["n"] >= keep:
            break
        held += r["n"]
    inside = cut.where(F.col("s") == last).select(seq).orderBy(F.desc(seq)).limit(keep - held).agg(F.min(seq)).first()[0]
    return log.where(F.col(seq) >= inside)


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys match, lack on one side, or repeat on the right."""
    a, b = left.groupBy(key).agg(F.count("*").alias("a")), right.groupBy(key).agg(F.count("*").alias("b"))
    j = a.join(b, key, "full_outer")
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return j.agg(n(F.col("b").isNull()).alias("missing"), n(F.col("a").isNull()).alias("unexpected"), n(F.col("a").isNotNull() & (F.col("b") > 1)).alias("repeated"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"))


def level_difference(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Levels of one side only, both ways."""
    a, b = left.select(F.col(column).alias("level")).where("level is not null").distinct(), right.select(F.col(column).alias("level")).where("level is not null").distinct()
    return a.join(b, "level", "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, "level", "left_anti").withColumn("side", F.lit("right")))


def latest_under(df: DataFrame, keep: Column, order: Sequence[str], n: int = 1) -> DataFrame:
    """The last ``n`` rows in ``order`` (unique) among those that ``keep`` holds for; nulls come first."""
    return df.where(keep).orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(n)
