"""Drift of every feature of every full window against one fixed reference, all windows and features in one pass.

Both sides are melted to (feature, value) and counted. The reference's counts are summed along the values once; a window then
needs the reference only at its own values, as between two of them one distribution is flat and the other monotone. For categories
the part of the statistic that comes from levels a window doesn't have is a sum of reference counts, so those levels are not expanded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.probability import chi2_p, ks_p
from lakeloom.operators.running import running_sums

#: The level of a missing category.
MISSING = "(missing)"


def melted(df: DataFrame, by: Sequence[str], numbers: dict[str, Column], categories: dict[str, Column]) -> DataFrame:
    """``by``, feature, number and level, a row for each row and feature: numbers have a null level, categories a null number.

    Missing and NaN numbers stay null; missing categories are a level of their own.
    """
    value = lambda c: F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    rows = [F.struct(F.lit(n).alias("feature"), value(c).alias("number"), F.lit(None).cast("string").alias("level")) for n, c in numbers.items()]
    rows += [F.struct(F.lit(n).alias("feature"), F.lit(None).cast("double").alias("number"), F.coalesce(c.cast("string"), F.lit(MISSING)).alias("level")) for n, c in categories.items()]
    return df.select(*by, F.explode(F.array(*rows)).alias("_m")).select(*by, "_m.*")


def counted(df: DataFrame, by: Sequence[str], numbers: dict[str, Column], categories: dict[str, Column]) -> DataFrame:
    """``melted`` with equal rows counted in ``n``."""
    return melted(df, by, numbers, categories).groupBy(*by, "feature", "number", "level").agg(F.count("*").alias("n"))


def window_drift(windows: DataFrame, reference: DataFrame, numbers: dict[str, Column], categories: dict[str, Column], by: Sequence[str] = ("run", "window"), least: int = 2) -> DataFrame:
    """A row for each window and feature: test (``ks`` or ``chi2``), n_values, statistic, degrees (of chi2) and p.

    ``windows`` holds the rows of the windows to test, of bounded size each; ``numbers`` and ``categories`` name the features and what they are
    computed from. Fewer than ``least`` values of a number on either side, and one category in all, give p = 1. Empty tables on either side are such cases too;
    without windows there are no rows.
    """
    own = counted(windows, by, numbers, categories)
    fixed = counted(reference, (), numbers, categories)
    out = None
    if numbers:
        out = _numbers(own.where(F.col("feature").isin(list(numbers))), fixed.where("number is not null"), by, least)
    if categories:
        levels = _levels(own.where("level is not null"), fixed.where("level is not null"), by)
        out = levels if out is None else out.unionByName(levels)
    return out


def _numbers(own: DataFrame, fixed: DataFrame, by: Sequence[str], least: int) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov tests."""
    values = own.where("number is not null")
    points = fixed.select("feature", "number", "n").unionByName(values.select("feature", "number", F.lit(0).cast("long").alias("n"))).groupBy("feature", "number").agg(F.sum("n").alias("at"))
    # Reference rows up to each value that a window has; only a feature's slices meet in one task.
    along = running_sums(points, "number", {"upto": "at"}, ["feature"])
    sizes = fixed.groupBy("feature").agg(F.sum("n").alias("size"))  # one row for each feature
    inside = Window.partitionBy(*by, "feature")  # a window's rows
    ranked = values.withColumn("_upto", F.sum("n").over(inside.orderBy("number").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("n").over(inside))
    j = ranked.join(along, ["feature", "number"]).join(F.broadcast(sizes), "feature")
    behind = F.abs(F.col("_upto") / F.col("_n") - F.col("upto") / F.col("size"))
    before = F.abs((F.col("_upto") - F.col("n")) / F.col("_n") - (F.col("upto") - F.col("at")) / F.col("size"))
    most = j.groupBy(*by, "feature").agg(F.max(F.greatest(behind, before)).alias("_d"))
    held = own.groupBy(*by, "feature").agg(F.sum(F.when(F.col("number").isNotNull(), F.col("n")).otherwise(0)).alias("n_values"))
    out = held.join(most, [*by, "feature"], "left").join(F.broadcast(sizes), "feature", "left")
    tested = (F.col("n_values") >= least) & (F.coalesce("size", F.lit(0)) >= least)
    statistic = F.when(tested, F.col("_d")).otherwise(0.0)
    p = ks_p(statistic, F.when(tested, F.col("n_values")).otherwise(0), F.coalesce("size", F.lit(0)))
    return out.select(*by, "feature", F.lit("ks").alias("test"), "n_values", statistic.alias("statistic"), F.lit(None).cast("long").alias("degrees"), p.alias("p"))


def _levels(own: DataFrame, fixed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Chi-square tests of homogeneity. With n reference and m window rows, a level that only the reference has adds its count times m / n."""
    sizes = fixed.groupBy("feature").agg(F.sum("n").alias("size"), F.count("*").alias("kinds"))  # one row for each feature
    m, n = F.col("m"), F.col("size")
    j = own.withColumn("m", F.sum("n").over(Window.partitionBy(*by, "feature"))).join(fixed.select("feature", "level", F.col("n").alias("a")), ["feature", "level"], "left").join(F.broadcast(sizes), "feature", "left")
    a, b = F.coalesce("a", F.lit(0)), F.col("n")
    expected = lambda side: (a + b) * side / (n + m)
    part = (a - expected(n)) * (a - expected(n)) / expected(n) + (b - expected(m)) * (b - expected(m)) / expected(m)
    g = j.groupBy(*by, "feature").agg(F.max("m").alias("m"), F.max("size").alias("size"), F.max("kinds").alias("kinds"), F.sum(part).alias("_present"), F.sum(a).alias("_seen"), F.sum(F.col("a").isNull().cast("long")).alias("_new"))
    degrees = F.when(n.isNotNull(), F.col("kinds") + F.col("_new") - 1).otherwise(0)
    tested = degrees > 0
    statistic = F.when(tested, F.col("_present") + (n - F.col("_seen")) * m / n).otherwise(0.0)
    return g.select(*by, "feature", F.lit("chi2").alias("test"), m.alias("n_values"), statistic.alias("statistic"), degrees.alias("degrees"), chi2_p(statistic, F.greatest(degrees, F.lit(0))).alias("p"))


def window_flags(tests: DataFrame, features: int, by: Sequence[str] = ("run", "window"), alpha: float = 0.005) -> DataFrame:
    """A row for each window: features tested, threshold (Bonferroni over ``features``), drifted_features, and flagged if any drifted."""
    threshold = alpha / features
    out = tests.groupBy(*by).agg(F.count("*").alias("features"), F.sum((F.col("p") < threshold).cast("long")).alias("drifted_features"))
    return out.select(*by, "features", F.lit(threshold).alias("threshold"), "drifted_features", (F.col("drifted_features") > 0).alias("flagged"))
