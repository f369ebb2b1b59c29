"""Data-quality expectations. All expectations of a suite are one aggregate over the table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Expectation:
    """A rule: ``kind`` is not_null, between (either bound may be missing) or in_set, on a column, with ``mostly``, the share that must meet it; or
    columns (the table has just these ``values`` in order), type (the column's type is one of ``values``, in DDL), or rows (at least ``low``)."""

    name: str
    column: str
    kind: str
    low: float | str | None = None
    high: float | str | None = None
    values: tuple = ()
    mostly: float = 1.0

    def unexpected(self) -> Column:
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "between":
            low = F.lit(False) if self.low is None else c < F.lit(self.low)
            high = F.lit(False) if self.high is None else c > F.lit(self.high)
            return c.isNotNull() & (low | high)
        if self.kind == "in_set":
            return c.isNotNull() & ~c.isin(list(self.values))
        raise ValueError(self.kind)


#: Kinds that look at the schema or the number of rows, not at values.
TABLE_KINDS = ("columns", "type", "rows")


def check_suite(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """A row for each expectation, in one aggregate over the table: rule, column, kind, elements, missing, unexpected, unexpected_percent (4 decimals) and passed.

    A rule on a column that the table doesn't have fails, with all rows unexpected. An empty suite, two rules of one name and a run
    that gives another number of results than the suite has rules are refused.
    """
    if not suite:
        raise ValueError("an empty suite proves nothing")
    if len({e.name for e in suite}) != len(suite):
        raise ValueError("two rules have one name")
    types, aggregates = dict(df.dtypes), [F.count("*").alias("rows")]
    on_values = [e.kind not in TABLE_KINDS and e.column in types for e in suite]
    for i, e in enumerate(suite):
        if on_values[i]:
            aggregates += [F.sum(F.col(e.column).isNull().cast("long")).alias(f"m{i}"), F.sum(e.unexpected().cast("long")).alias(f"u{i}")]
    rows, out = F.col("rows"), []
    none = F.lit(0).cast("long")
    for i, e in enumerate(suite):
        if on_values[i]:
            missing, bad = F.coalesce(F.col(f"m{i}"), none), F.coalesce(F.col(f"u{i}"), none)
            base = rows if e.kind == "not_null" else rows - missing
            share = F.when(base > 0, bad / base).otherwise(0.0)
            passed = 1 - share >= e.mostly
        else:
            good = tuple(df.columns) == e.values if e.kind == "columns" else e.kind == "type" and types.get(e.column) in [T.DataType.fromDDL(v).simpleString() for v in e.values]
            passed = rows >= e.low if e.kind == "rows" else F.lit(good)
            missing, bad = none, F.greatest(F.lit(e.low) - rows, none).cast("long") if e.kind == "rows" else none if good or e.kind in TABLE_KINDS else rows
            share = F.when((rows > 0) & ~passed & F.lit(e.kind not in TABLE_KINDS), 1.0).otherwise(0.0)
        out.append(F.struct(
            F.lit(e.name).alias("rule"), F.lit(e.column).alias("column"), F.lit(e.kind).alias("kind"), rows.alias("elements"), missing.alias("missing"), bad.alias("unexpected"), F.round(share * 100, 4).alias("unexpected_percent"), passed.alias("passed"),
        ))
    if len(out) != len(suite):
        raise ValueError(f"{len(out)} results for {len(suite)} rules")
    return df.agg(*aggregates).select(F.explode(F.array(*out)).alias("r")).select("r.*")


def run_suite(df: DataFrame, suite: Sequence[Expectation], min_rows: int = 0) -> DataFrame:
    """A row for each expectation: elements, missing, unexpected, unexpected percent (4 decimals) and passed.

    The percentage is of rows that aren't missing, for not_null of all rows. An empty suite is refused.
    The last row tells whether the table has ``min_rows``.
    """
    if not suite:
        raise ValueError("an empty suite proves nothing")
    aggregates = [F.count("*").alias("rows")]
    for i, e in enumerate(suite):
        aggregates += [F.sum(F.col(e.column).isNull().cast("long")).alias(f"m{i}"), F.sum(e.unexpected().cast("long")).alias(f"u{i}")]
    wide = df.agg(*aggregates)
    out = []
    for i, e in enumerate(suite):
        missing, bad = F.coalesce(F.col(f"m{i}"), F.lit(0)), F.coalesce(F.col(f"u{i}"), F.lit(0))
        base = F.col("rows") if e.kind == "not_null" else F.col("rows") - missing
        share = F.when(base > 0, bad / base).otherwise(0.0)
        out.append(F.struct(F.lit(e.name).alias("rule"), F.lit(e.column).alias("column"), F.col("rows").alias("elements"), missing.alias("missing"), bad.alias("unexpected"), F.round(share * 100, 4).alias("unexpected_percent"), (1 - share >= e.mostly).alias("passed")))
    out.append(F.struct(F.lit("row_count").alias("rule"), F.lit(None).cast("string").alias("column"), F.col("rows").alias("elements"), F.lit(0).cast("long").alias("missing"), F.greatest(F.lit(min_rows) - F.col("rows"), F.lit(0)).cast("long").alias("unexpected"), F.lit(0.0).alias("unexpected_percent"), (F.col("rows") >= min_rows).alias("passed")))
    return wide.select(F.explode(F.array(*out)).alias("r")).select("r.*")


class QualityError(ValueError):
    """Lists every failed expectation."""


def require(results: DataFrame) -> None:
    """Raise with all failures; call it after the results have been written."""
    if failed := [f"{r['rule']}: {r['unexpected']} of {r['elements']}" for r in results.where("not passed").collect()]:
        raise QualityError("; ".join(failed))


def fill_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, filled, rows and share of each column, from one aggregate."""
    wide = df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"f{i}") for i, c in enumerate(columns)])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"f{i}").alias("filled"), F.col("rows")) for i, c in enumerate(columns)])
    return wide.select(F.explode(rows).alias("r")).select("r.*").withColumn("share", F.round(F.col("filled") / F.col("rows"), 6))


def missing_histogram(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many rows lack how many of the columns."""
    n = sum((F.col(c).isNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNull().cast("int"))
    return df.groupBy(n.alias("missing")).agg(F.count("*").alias("rows"))


def functional_dependency(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that meet more than one value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias("values")).where("values > 1")


def card_checks(df: DataFrame, claims: dict[str, tuple[object, Column]]) -> DataFrame:
    """claim, expected, actual (as text) and whether they match."""
    wide = df.agg(*[c.cast("string").alias(f"c{i}") for i, (_, c) in enumerate(claims.values())])
    rows = [F.struct(F.lit(k).alias("claim"), F.lit(str(e)).alias("expected"), F.col(f"c{i}").alias("actual"), F.coalesce(F.col(f"c{i}") == str(e), F.lit(False)).alias("match")) for i, (k, (e, _)) in enumerate(claims.items())]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
