"""Row numbers in input order, and tables put side by side by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.lineage import cut


class PositionError(ValueError):
    """Two tables don't belong side by side."""


def with_positions(df: DataFrame, name: str = "position") -> DataFrame:
    """``df`` with the number of each row from 0, in the order of the input's partitions.

    The rows are written with their number inside their partition; only how many rows each partition has, a row for each, is added up. Nothing is moved.
    """
    rows = cut(df.select("*", F.monotonically_increasing_id().alias("_id")), "positions")
    part, inside = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    counts = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).orderBy("_part").collect()
    before, total = [], 0
    for r in counts:
        before.append((r["_part"], total))
        total += r["_n"]
    starts = df.sparkSession.createDataFrame(before, "_part long, _start long")
    return rows.withColumn("_own", part).join(F.broadcast(starts), F.col("_own") == F.col("_part")).select(*df.columns, (F.col("_start") + inside).alias(name))


def side_by_side(left: DataFrame, right: DataFrame, same: dict[str, str] | None = None, name: str = "position") -> DataFrame:
    """Row n of ``left`` with row n of ``right``, whose columns must have other names; ``same`` names pairs of columns that must agree.

    Unequal numbers of rows, and rows whose pairs differ (nulls agree with nulls), are refused.
    """
    if clash := sorted(set(left.columns) & set(right.columns)):
        raise PositionError(f"both sides have {clash}")
    a, b = with_positions(left, name), with_positions(right, "_position")
    j = a.join(b, a[name] == b["_position"], "full_outer")
    differs = F.lit(False)
    for x, y in (same or {}).items():
        differs = differs | ~F.col(x).eqNullSafe(F.col(y))
    both = F.col(name).isNotNull() & F.col("_position").isNotNull()
    r = j.agg(F.sum((~both).cast("long")).alias("alone"), F.sum((both & differs).cast("long")).alias("differ")).first()
    if r["alone"] or r["differ"]:
        raise PositionError(f"{r['alone'] or 0} rows have no partner and {r['differ'] or 0} pairs differ")
    return j.drop("_position")
