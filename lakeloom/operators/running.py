"""Running sums over a long order, without one task seeing it all."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 256


def slice_edges(df: DataFrame, order: str, slices: int = SLICES) -> list[float]:
    """Approximate quantiles that cut an order into at most so many slices."""
    return sorted(set(df.approxQuantile(order, [i / slices for i in range(1, slices)], 0.5 / slices)))


def in_slices(df: DataFrame, order: str, edges: Sequence[float], name: str) -> DataFrame:
    """Add ``name``, the number of the slice that ``order`` lies in, by binary search."""
    if not edges:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol=order, outputCol=name, handleInvalid="keep")
    return cut.transform(df).withColumn(name, F.col(name).cast("int"))


def running_sums(df: DataFrame, order: str, sums: dict[str, str], by: Sequence[str] = (), edges: Sequence[float] | None = None) -> DataFrame:
    """Add, for each ``new: column`` of ``sums``, the sum of the column up to the row in order of ``order`` (unique within ``by``).

    The order is cut at approximate quantiles into at most SLICES slices; each slice is summed by itself,
    and what slices before it sum up to is added. ``edges`` found before may be given; they decide balance only. Only slice sums, a few for each group, meet in one task.
    """
    edges = slice_edges(df, order) if edges is None else edges
    cut = in_slices(df, order, edges, "_slice")
    inner = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*by, *([] if by else [F.lit(1)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = totals.select(*by, "_slice", *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_b_{n}") for n in sums])
    out = cut.join(before, [*by, "_slice"])
    return out.withColumns({n: F.sum(c).over(inner) + F.col(f"_b_{n}") for n, c in sums.items()}).drop("_slice", *[f"_b_{n}" for n in sums])


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), edges: Sequence[float] | None = None) -> DataFrame:
    """``by``, the rows ``n`` and ``q0``, ``q1``, ... of each class: quantiles with linear interpolation; nulls are left out.

    Rows are counted by class and slice of the value, which tells in which slice each wanted rank lies. Then only the values of
    those slices are counted one by one, so no task holds or sorts the values of a class. ``edges`` as in ``running_sums``.
    """
    # Null keys are a class like others, which an equi-join of the keys themselves wouldn't see.
    keys = [f"_key{i}" for i in range(len(by))]
    base = df.where(F.col(value).isNotNull()).select(*[F.struct(c).alias(k) for c, k in zip(by, keys, strict=True)], F.col(value).cast("double").alias("_v"))
    cut = in_slices(base, "_v", slice_edges(base, "_v") if edges is None else edges, "_slice")
    counts = cut.groupBy(*keys, "_slice").agg(F.count("*").alias("_c"))
    every = Window.partitionBy(*(keys or [F.lit(1)]))  # one row for each class and slice
    ranked = counts.withColumn("_upto", F.sum("_c").over(every.orderBy("_slice"))).withColumn("n", F.sum("_c").over(every))
    at = [(F.col("n") - 1) * F.lit(float(s)) for s in shares]
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), f(x).cast("long").alias("rank")) for i, x in enumerate(at) for f in (F.floor, F.ceil)]))
    needed = ranked.withColumn("_w", wanted).where((F.col("_w.rank") < F.col("_upto")) & (F.col("_w.rank") >= F.col("_upto") - F.col("_c")))
    needed = needed.groupBy(*keys, "_slice", "n").agg(F.min(F.col("_upto") - F.col("_c")).alias("_before"), F.collect_set("_w").alias("_ranks"))
    values = cut.join(needed, [*keys, "_slice"]).groupBy(*keys, "_slice", "n", "_before", "_ranks", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_slice").orderBy("_v"))
    found = values.withColumn("_upto", upto).withColumn("_w", F.explode("_ranks")).where((F.col("_w.rank") < F.col("_upto")) & (F.col("_w.rank") >= F.col("_upto") - F.col("_c")))
    out = found.groupBy(*keys, "n").agg(*[f(F.when(F.col("_w.i") == i, F.col("_v"))).alias(f"{k}{i}") for i in range(len(shares)) for k, f in (("_l", F.min), ("_h", F.max))])
    return out.select(
        *[F.col(k)[c].alias(c) for c, k in zip(by, keys, strict=True)], "n",
        *[(F.col(f"_l{i}") + (F.col(f"_h{i}") - F.col(f"_l{i}")) * (x - F.floor(x))).alias(f"q{i}") for i, x in enumerate(at)],
    )
