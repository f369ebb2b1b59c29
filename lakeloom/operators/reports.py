"""Comparisons of result documents and the verdicts drawn from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.running import exact_quantiles


class IntegrityError(ValueError):
    """Two sides that must match one to one don't."""


def leaf_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Leaves (path, value) that were added, removed or changed."""
    j = left.select("path", F.col("value").alias("old"), F.lit(True).alias("_l")).join(right.select("path", F.col("value").alias("new"), F.lit(True).alias("_r")), "path", "full_outer")
    change = F.when(F.col("_l").isNull(), "added").when(F.col("_r").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return j.select("path", "old", "new", change.alias("change")).where("change is not null")


def json_leaves(df: DataFrame, column: str, paths: Sequence[str]) -> DataFrame:
    """Named leaves of JSON text as (path, value)."""
    rows = F.array(*[F.struct(F.lit(p).alias("path"), F.get_json_object(column, p).alias("value")) for p in paths])
    return df.select(F.explode(rows).alias("r")).select("r.*")


def joined_one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join that refuses keys on one side only or twice."""
    a, b = left.groupBy(key).agg(F.count("*").alias("_a")), right.groupBy(key).agg(F.count("*").alias("_b"))
    bad = a.join(b, key, "full_outer").where("_a is null or _b is null or _a > 1 or _b > 1").limit(5).collect()
    if bad:
        raise IntegrityError(f"{key} doesn't match one to one: {[r[key] for r in bad]}")
    return left.join(right, key)


def prefix_pairs(levels: DataFrame, column: str) -> DataFrame:
    """Pairs of levels of which one begins with the other at a word's end: an equi-join on the prefixes of each."""
    own = levels.select(column).where(F.col(column).isNotNull()).distinct()
    words = F.split(column, " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda n: F.array_join(F.slice(words, 1, n), " "))
    longer = own.where(F.size(words) > 1).select(F.col(column).alias("longer"), F.explode(prefixes).alias("shorter"))
    return longer.join(own.select(F.col(column).alias("shorter")), "shorter").select("shorter", "longer")


def coverage_matrix(required: DataFrame, specified: DataFrame, tests: DataFrame, key: str = "id") -> DataFrame:
    """Every id with where it stands and the tests that mark it."""
    a, b = required.select(key, F.lit(True).alias("required")), specified.select(key, F.lit(True).alias("specified"))
    marked = tests.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("test")), ",").alias("tests"))
    out = a.join(b, key, "full_outer").join(marked, key, "left")
    state = F.when(F.col("required").isNull(), "unrequired").when(F.col("specified").isNull(), "unspecified").when(F.col("tests").isNull(), "untested").otherwise("ok")
    return out.select(key, F.coalesce("tests", F.lit("")).alias("tests"), state.alias("state"))


def share_within(before: DataFrame, after: DataFrame, target: float) -> DataFrame:
    """Share of events between two scrapes of a cumulative histogram (le, n) that lie within the target."""
    d = after.join(before.select("le", F.col("n").alias("_b")), "le", "left").withColumn("d", F.col("n") - F.coalesce("_b", F.lit(0)))
    hit, total = F.max(F.when(F.col("le") == f"{target:g}", F.col("d"))), F.max(F.when(F.col("le") == "+Inf", F.col("d")))
    return d.agg(hit.alias("within"), total.alias("events")).withColumn("share", F.round(F.col("within") / F.nullif(F.col("events"), F.lit(0)), 6))


def promotion(candidates: DataFrame, reasons: dict[str, Column]) -> DataFrame:
    """Candidates with every reason against promotion, and whether there is none; an unknown condition counts against."""
    against = F.concat_ws(",", *[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in reasons.items()])
    return candidates.withColumn("against", against).withColumn("promoted", F.col("against") == "")


def flag_rates(trials: DataFrame, p: str, alphas: Sequence[float], features: int, least: int = 3) -> DataFrame:
    """For each level, the rate at which a feature's test is flagged and the share of trials with at least so many flags."""
    e = trials.withColumn("alpha", F.explode(F.array(*map(F.lit, alphas)))).withColumn("hit", (F.col(p) < F.col("alpha") / features).cast("int"))
    per = e.groupBy("alpha", "trial").agg(F.sum("hit").alias("hits"), F.count("*").alias("n"))
    return per.groupBy("alpha").agg(F.round(F.sum("hits") / F.sum("n"), 6).alias("feature_rate"), F.round(F.avg((F.col("hits") >= 1).cast("double")), 6).alias("window_rate"), F.round(F.avg((F.col("hits") >= least).cast("double")), 6).alias("several_rate"))


def runner_up(df: DataFrame, by: Sequence[str], value: str, name: str, bound: float) -> DataFrame:
    """The second largest value of each group that lies within the bound."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(value), name))
    return df.where(F.col(value) <= bound).withColumn("_n", n).where("_n = 2").drop("_n")


def pivoted(df: DataFrame, row: str, column: str, levels: Sequence[str], value: str) -> DataFrame:
    """Medians of a value, one column for each level."""
    medians = exact_quantiles(df.select(row, column, value), value, [0.5], [row, column])  # a row for each cell
    cells = medians.select(row, column, "q0").unionByName(df.select(row).distinct().select(row, F.lit(None).cast(df.schema[column].dataType).alias(column), F.lit(None).cast("double").alias("q0")))
    return cells.groupBy(row).pivot(column, list(levels)).agg(F.round(F.max("q0"), 6))


def release_values(versions: DataFrame, points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Recorded test values of each version; a version with neither is left out."""
    out = versions.join(points, ["variant", "version"], "left").join(ranges, ["variant", "version"], "left")
    return out.where(F.coalesce("mdape", "coverage").isNotNull())


def judged_against(windows: DataFrame, recorded: DataFrame, key: str = "version") -> DataFrame:
    """A window's own recorded value, else that of the version before, else none."""
    own = recorded.select(F.col(key).alias("_k"), F.col("mdape").alias("_own"))
    prior = recorded.select(F.col(key).alias("_p"), F.col("mdape").alias("_prior"))
    return windows.join(own, F.col(key) == F.col("_k"), "left").join(prior, F.col("previous") == F.col("_p"), "left").withColumn("baseline_mdape", F.coalesce("_own", "_prior")).drop("_k", "_own", "_p", "_prior")


def exposition(metrics: DataFrame) -> DataFrame:
    """(metric, labels: map, value) as lines of a Prometheus text file."""
    escaped = lambda v: F.regexp_replace(F.regexp_replace(F.regexp_replace(v, r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n")
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    return metrics.select(F.concat(F.col("metric"), F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("value"))


def in_declared_order(table: DataFrame, column: str, order: Sequence[str], then: str) -> DataFrame:
    """Rows by the declared order of a column's values (undeclared ones last), then by ``then`` from the largest, with their ``place`` inside the value."""
    place = F.row_number().over(Window.partitionBy(column).orderBy(F.desc(then)))
    at = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return table.withColumn("place", place).orderBy(F.when(at > 0, at).otherwise(len(order) + 1), "place")


def levels_by_error(table: DataFrame, group: str, name: str, error: str) -> DataFrame:
    """Each group's names from the largest error, ties by name, joined by commas, and its worst error. Tables hold one row for each level."""
    ranked = F.array_sort(F.collect_list(F.struct((-F.col(error)).alias("e"), F.col(name).alias("n"))))
    out = table.groupBy(group).agg(ranked.alias("r"), F.max(error).alias("worst"))
    return out.select(group, F.array_join(F.transform("r", lambda x: x["n"]), ",").alias("names"), "worst").orderBy(F.desc("worst"), group)


def required_only(metrics: DataFrame, field: str, value: str, every: str) -> DataFrame:
    """The value of the row that omits every optional field, or null where there is none."""
    return metrics.agg(F.max(F.when(F.col(field) == every, F.col(value))).alias(value))
