"""Writers: conformed Parquet, fixed-header CSV, gzip JSON lines, and keyed appends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from lakeloom.operators.ledger import first_wins


def write_conformed(df: DataFrame, path: str, contract, partition_by: Sequence[str] = ()) -> DataFrame:
    """Conform, write, and return what was written."""
    out = contract.conform(df)
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return out


def write_table(df: DataFrame, path: str, header: Sequence[str]) -> None:
    """A small result as one CSV file with exactly these columns in order."""
    if set(df.columns) != set(header):
        raise ValueError(f"the columns are {df.columns}, not {list(header)}")
    df.select(*header).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "gzip").json(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> int:
    """Append rows whose keys the table lacks; the first of a key wins. Returns how many were written."""
    spark = df.sparkSession
    try:
        existing = spark.read.schema(df.schema).parquet(path)
        fresh = first_wins(existing, df, keys, order)
    except Exception as e:  # the first write finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        fresh = first_wins(df.limit(0), df, keys, order)
    fresh = fresh.persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
