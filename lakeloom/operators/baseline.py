"""Hierarchical medians with fallback: the median of the finest class that has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.lineage import cut
from lakeloom.operators.running import exact_quantiles, slice_edges


def fit_medians(train: DataFrame, coarse: str, middle: str, fine: Column, value: str) -> DataFrame:
    """One table of three levels: (coarse, middle, fine), (coarse), (): level, keys, median and rows.

    Each level counts its rows by slices of the value and looks closer at the slice of the median. Rows whose keys are null don't form classes of their own.
    Keys and values are written once, so ``train`` is computed once, and so is the table.
    """
    keys = ["k1", "k2", "k3"]
    t = train.select(F.col(coarse).alias("k1"), F.col(middle).alias("k2"), fine.alias("k3"), F.col(value).cast("double").alias("v")).where("v is not null")
    t = cut(t, "median-rows")
    edges, out = slice_edges(t, "v"), None
    for level, by in (("bucket", keys), ("make", ["k1"]), ("all", [])):
        m = exact_quantiles(t.dropna(subset=by) if by else t, "v", [0.5], by, edges).withColumnRenamed("q0", "median")
        part = m.select(F.lit(level).alias("level"), *[F.col(k) if k in by else F.lit(None).cast(t.schema[k].dataType).alias(k) for k in keys], "median", "n")
        out = part if out is None else out.unionByName(part)
    return cut(out, "medians")


def predict_medians(df: DataFrame, medians: DataFrame, coarse: str, middle: str, fine: Column, name: str = "predicted") -> DataFrame:
    """Each row with the median of its class, else of its coarse class, else of all; null keys fall through.

    The classes' sizes depend on the data, so Spark chooses how to join; only the single row of the last level is broadcast.
    """
    df = df.withColumn("_k3", fine)
    b = medians.where("level = 'bucket'").select(F.col("k1").alias("_b1"), F.col("k2").alias("_b2"), F.col("k3").alias("_b3"), F.col("median").alias("_m3"))
    m = medians.where("level = 'make'").select(F.col("k1").alias("_c1"), F.col("median").alias("_m1"))
    a = medians.where("level = 'all'").select(F.col("median").alias("_m0"))
    out = df.join(b, (F.col(coarse) == F.col("_b1")) & (F.col(middle) == F.col("_b2")) & (F.col("_k3") == F.col("_b3")), "left").join(m, F.col(coarse) == F.col("_c1"), "left").join(F.broadcast(a), how="left")
    return out.withColumn(name, F.coalesce("_m3", "_m1", "_m0")).drop("_k3", "_b1", "_b2", "_b3", "_m3", "_c1", "_m1", "_m0")
