"""Error metrics, segments, range coverage, masking sweeps and the gate over them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.expressions import relative_error
from lakeloom.operators.lineage import cut
from lakeloom.operators.running import exact_quantiles


def error_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, n, median and mean relative error, shares within 10 and 20 percent (inclusive), and mean absolute error of each class (null keys are a class).

    Errors are written once; their medians are found by counting, so a class of any size has no task to itself.
    """
    e = relative_error(F.col(actual), F.col(predicted))
    rows = cut(df.select(*by, F.abs(F.col(predicted) - F.col(actual)).alias("_a"), e.alias("_e")), "errors")
    means = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("_e") <= 0.1).cast("double")), 6).alias("within_10pct"), F.round(F.avg((F.col("_e") <= 0.2).cast("double")), 6).alias("within_20pct"),
        F.round(F.avg("_a"), 4).alias("mae"), F.round(F.avg("_e"), 6).alias("mape"),
    )
    medians = exact_quantiles(rows, "_e", [0.5], by).select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.round("q0", 6).alias("mdape"))
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)]) if by else None
    joined = means.join(medians, on, "left") if by else means.join(F.broadcast(medians), how="left")  # without classes one row each
    return joined.select(*by, "n", "mdape", "within_10pct", "within_20pct", "mae", "mape")


def check_pairs(df: DataFrame, actual: str, predicted: str) -> None:
    """Refuse nulls on either side and zero actual values."""
    r = df.agg(F.sum(F.col(actual).isNull().cast("long")).alias("a"), F.sum(F.col(predicted).isNull().cast("long")).alias("p"), F.sum((F.col(actual) == 0).cast("long")).alias("z")).first()
    if any(r):
        raise ValueError(f"{r['a']} null actual, {r['p']} null predicted and {r['z']} zero actual values")


def segment_metrics(df: DataFrame, actual: str, predicted: str, segments: Sequence[str], least: int = 500, excluded: Sequence[str] = ("(missing)",)) -> DataFrame:
    """A row for each segment and level, and whether it counts: enough rows and no placeholder."""
    e = F.array(*[F.struct(F.lit(s).alias("segment"), F.coalesce(F.col(s).cast("string"), F.lit("(missing)")).alias("level")) for s in segments])
    rows = df.select(F.explode(e).alias("e"), actual, predicted).select("e.*", actual, predicted)
    out = error_metrics(rows, actual, predicted, ["segment", "level"])
    why = F.when(F.col("level").isin(list(excluded)), "placeholder").when(F.col("n") < least, "too few rows")
    return out.withColumn("counts", why.isNull()).withColumn("excluded_because", why)


def range_coverage(df: DataFrame, actual: str, lower: str, upper: str, typical: str, group: str, band: tuple[float, float] = (0.88, 0.92)) -> DataFrame:
    """Coverage and mean relative width of ranges, pooled (null group) and for each group, with the binomial error at the band's middle."""
    inside = F.col(actual).between(F.col(lower), F.col(upper)).cast("double")
    out = df.where(F.col(group).isNotNull()).rollup(group).agg(F.count("*").alias("n"), F.avg(inside).alias("c"), F.avg((F.col(upper) - F.col(lower)) / F.col(typical)).alias("w"))
    middle = sum(band) / 2
    judgement = F.when(F.col("c") < band[0], "too narrow").when(F.col("c") > band[1], "too wide").otherwise("in band")
    return out.select(F.coalesce(F.col(group), F.lit("(all)")).alias(group), "n", F.round("c", 6).alias("coverage"), F.round(F.sqrt(F.lit(middle * (1 - middle)) / F.col("n")), 6).alias("std_error"), F.round("w", 6).alias("mean_relative_width"), judgement.alias("judgement"))


def omission_scenarios(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Every row once for each omitted field and once with all (scenario ``(none)``): the field's column is blanked.

    The number of scenarios is that of the fields, so the table grows by that factor inside each task and isn't moved.
    """
    names = ["(none)", *fields]
    out = df.select("*", F.explode(F.array(*map(F.lit, names))).alias("scenario"))
    return out.select(*[F.when(F.col("scenario") == c, fields[c]).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns], "scenario")


def masking_sweep(scored: DataFrame, actual: str, predicted: str, limit: float = 1.5) -> DataFrame:
    """Median error of each scenario against that of ``(none)``."""
    errors = cut(scored.select("scenario", relative_error(F.col(actual), F.col(predicted)).alias("_e")), "errors")
    m = exact_quantiles(errors, "_e", [0.5], ["scenario"]).select("scenario", F.col("q0").alias("m"))
    base = F.max(F.when(F.col("scenario") == "(none)", F.col("m"))).over(Window.partitionBy(F.lit(1)))  # one row for each scenario
    return m.select("scenario", F.round("m", 6).alias("mdape"), F.round(F.col("m") / base, 6).alias("ratio"), (F.col("m") / base <= limit).alias("passed"))


def verdict(criteria: DataFrame, name: str = "criterion", passed: str = "passed", waived: Sequence[str] = ()) -> DataFrame:
    """Whether all criteria passed that aren't waived; an open one (null) blocks like a failed one."""
    counted = criteria.withColumn("_waived", F.col(name).isin(list(waived)))
    return counted.agg(
        F.count("*").alias("criteria"), F.sum(F.col("_waived").cast("long")).alias("waived"), F.sum((~F.col("_waived") & F.coalesce(F.col(passed), F.lit(False))).cast("long")).alias("passed"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("_waived") & ~F.coalesce(F.col(passed), F.lit(False)), F.col(name)))), ",").alias("blocking"),
        F.coalesce(F.every(F.col("_waived") | F.coalesce(F.col(passed), F.lit(False))), F.lit(False)).alias("deployable"),
    )


def worst(df: DataFrame, by: str, names: Sequence[str]) -> DataFrame:
    """The row with the largest value, ties to the smaller names."""
    return df.orderBy(F.desc(by), *names).limit(1)
