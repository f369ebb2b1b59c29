"""What earlier rows of a series hand on, without sorting a long series in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(df: DataFrame, by: Sequence[str], order: Sequence[str], bucket: Column, last: dict[str, Column]) -> DataFrame:
    """Add, for each ``name: expression``, the expression's last non-null value in the rows of ``by`` before this one in ``order`` (unique within ``by``).

    ``bucket`` cuts the order into stretches (it must rise with it), such as days. Each stretch looks back in itself; what it can't find there
    comes from stretches before, which have one row for each series and stretch. So a series of any length meets in one task as a row a stretch.
    """
    cut = df.withColumn("_bucket", bucket)
    for i, e in enumerate(last.values()):
        cut = cut.withColumn(f"_e{i}", e)
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    ends = cut.groupBy(*by, "_bucket").agg(*[F.max_by(f"_e{i}", F.when(F.col(f"_e{i}").isNotNull(), at)).alias(f"_l{i}") for i in range(len(last))])
    ends = ends.select(*[F.col(c).alias(f"_k{n}") for n, c in enumerate(by)], F.col("_bucket").alias("_b"), *[F.last(f"_l{i}", ignorenulls=True).over(earlier).alias(f"_l{i}") for i in range(len(last))])
    same = [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(by)] + [F.col("_bucket").eqNullSafe(F.col("_b"))]
    on = same[0]
    for x in same[1:]:
        on = on & x
    own = cut.withColumns({f"_i{i}": F.last(f"_e{i}", ignorenulls=True).over(inside) for i in range(len(last))})
    return own.join(ends, on).select(*df.columns, *[F.coalesce(f"_i{i}", f"_l{i}").alias(name) for i, name in enumerate(last)])
