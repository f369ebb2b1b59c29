"""Folds of whole groups with alike class shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Groups that are dealt out together, about.
SHARD = 50_000


def assign(sizes, folds: int):
    """The fold of each group (a row of class counts, numpy), dealt out in the order given: to the fold where the classes' shares come closest to even, ties to the first."""
    import numpy as np

    total = np.maximum(sizes.sum(axis=0), 1)
    held, out = np.zeros((folds, sizes.shape[1])), np.zeros(len(sizes), dtype=np.int64)
    for i, own in enumerate(sizes):
        now, then = held / total - 1 / folds, (held + own) / total - 1 / folds
        out[i] = np.argmin(np.round((then * then - now * now).sum(axis=1), 12))
        held[out[i]] += own
    return out


def stratified_group_folds(df: DataFrame, group: str, label: str, classes: Sequence[str], folds: int, shard: int = SHARD) -> DataFrame:
    """group and fold: each group in one fold, largest groups first. Null groups are one group; labels that are null or not among ``classes`` count in the size alone.

    Only class counts of groups are dealt out, by hash in shards of about ``shard`` groups; a shard's folds are even by themselves, so all together are.
    """
    level = F.col(label).cast("string")
    counts = df.groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.array(*[F.sum((level == c).cast("long")) for c in classes]).alias("c"))
    counts = counts.withColumn("c", F.transform("c", lambda x: F.coalesce(x, F.lit(0))))
    groups = counts.count()
    kind = counts.schema["group"].dataType.simpleString()
    dealt = counts.withColumn("_shard", F.pmod(F.xxhash64("group"), F.lit(max(1, -(-groups // shard)))))
    ordered = F.row_number().over(Window.partitionBy("_shard").orderBy(F.desc("n"), F.col("group").cast("string").asc_nulls_first()))

    def run(frame):
        import numpy as np

        frame = frame.sort_values("place")
        frame["fold"] = assign(np.stack(frame["c"].to_list()).astype(float), folds)
        return frame[["group", "fold"]]

    return dealt.withColumn("place", ordered).groupBy("_shard").applyInPandas(run, f"group {kind}, fold long").withColumnRenamed("group", group)
