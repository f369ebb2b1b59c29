"""Row rules in order, the funnel of what each leaves, and keep-first deduplication."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RowRule:
    """A named predicate; a row whose predicate is null goes."""

    name: str
    keeps: Column


def apply_rules(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    return reduce(lambda d, r: d.where(r.keeps), rules, df)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order``; nulls in keys are equal to each other."""
    n = "_n"
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def funnel(df: DataFrame, rules: Sequence[RowRule], keys: Sequence[str]) -> DataFrame:
    """(step, name, rows, removed) after each rule and after deduplication by ``keys``.

    One aggregate counts all rules: a row passes a rule's step if it passes it and all before. The
    distinct keys of what passes are pre-aggregated on the map side.
    """
    passed, flags = F.lit(True), []
    for r in rules:
        passed = passed & F.coalesce(r.keeps, F.lit(False))
        flags.append(passed)
    counts = [F.count("*").alias("s0"), *[F.sum(f.cast("long")).alias(f"s{i}") for i, f in enumerate(flags, 1)]]
    last = len(rules) + 1
    unique = df.where(passed).select(*keys).distinct().agg(F.count("*").alias(f"s{last}"))
    wide = df.agg(*counts).crossJoin(unique)  # one row each
    names = ["raw", *[r.name for r in rules], "duplicates"]
    steps = wide.select(F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.coalesce(F.col(f"s{i}"), F.lit(0)).alias("rows")) for i, n in enumerate(names)])).alias("s")).select("s.*")
    return steps.withColumn("removed", F.coalesce(F.lag("rows").over(Window.partitionBy(F.lit(1)).orderBy("step")) - F.col("rows"), F.lit(0)))


def duplicate_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, and how many of them repeat the keys or a whole row."""
    return df.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct(F.struct(*keys))).alias("repeats_of_key"),
        (F.count("*") - F.count_distinct(F.struct(*df.columns))).alias("repeats_of_row"),
    )


def refuse_unparsed(df: DataFrame, text: str, parsed: Column, shown: int = 5) -> DataFrame:
    """``df`` itself; an error that names up to ``shown`` different values if a text that isn't null could not be read."""
    bad = df.where(F.col(text).isNotNull() & parsed.isNull()).select(text).distinct().orderBy(text).limit(shown).collect()
    if bad:
        raise ValueError(f"{text}: not understood: " + ", ".join(repr(r[0]) for r in bad))
    return df
