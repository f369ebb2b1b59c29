"""Trials by hashed draws: flag rates, ceilings, power, behaviour under changed inputs and sparse requests."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.functions.expressions import relative_error
from lakeloom.operators.lineage import cut
from lakeloom.operators.running import exact_quantiles


def trial_samples(df: DataFrame, key: str, trials: int, n: int, seed: str) -> DataFrame:
    """About ``n`` rows for each of ``trials``, without replacement: row r is in trial t if a hash of both is small.

    Every row is sent to the few trials that it is in; no trial sorts the table.
    """
    total = df.count()
    share = min(1.0, n / max(1, total))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("trial"), F.col(key)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return df.withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(trials)))).where(u < share)


def median_ceiling(errors: DataFrame, key: str, error: str, draws: int, n: int, seed: str, share: float = 0.99) -> DataFrame:
    """The ratio of a sample's median error to the whole median that a share of draws stays under."""
    whole = exact_quantiles(errors, error, [0.5]).select(F.col("q0").alias("_w"))
    per = trial_samples(errors, key, draws, n, seed).groupBy("trial").agg(F.median(error).alias("_m"))
    return per.join(F.broadcast(whole)).agg(F.count("*").alias("draws"), F.percentile(F.col("_m") / F.col("_w"), share).alias("ceiling"))


def power(errors: DataFrame, key: str, error: str, factor: float, ceiling: float, draws: int, n: int, seed: str) -> DataFrame:
    """False alarms of equal samples, and misses of samples whose errors are ``factor`` times as large."""
    whole = exact_quantiles(errors, error, [0.5]).select(F.col("q0").alias("_w"))
    per = trial_samples(errors, key, draws, n, seed).groupBy("trial").agg(F.median(error).alias("_m"))
    r = F.col("_m") / F.col("_w")
    return per.join(F.broadcast(whole)).agg(F.avg((r > ceiling).cast("double")).alias("false_alarms"), F.avg((r * factor <= ceiling).cast("double")).alias("misses"))


def moved(df: DataFrame, predict: Callable[[DataFrame], DataFrame], changes: dict[str, dict[str, Column]], key: Sequence[str], name: str = "predicted") -> DataFrame:
    """Share of rows whose prediction rises, falls or stays under each change of inputs."""
    base = predict(df).select(*key, F.col(name).alias("_p"))
    out = None
    for label, columns in changes.items():
        new = predict(df.withColumns(columns)).select(*key, F.col(name).alias("_q"))
        r = base.join(new, list(key)).agg(F.lit(label).alias("change"), F.count("*").alias("n"), F.round(F.avg((F.col("_q") > F.col("_p")).cast("double")), 6).alias("rises"), F.round(F.avg((F.col("_q") < F.col("_p")).cast("double")), 6).alias("falls"))
        out = r if out is None else out.unionByName(r)
    return out


def sparse_requests(df: DataFrame, key: Sequence[str], fields: Sequence[str], levels: Sequence[int], seed: str) -> DataFrame:
    """Each row once for each level k with k of the optional fields kept, chosen by hashes of the row's key."""
    rank = {f: F.xxhash64(F.lit(f"{seed}|{f}"), *key) for f in fields}
    order = F.array_sort(F.array(*rank.values()))
    out = df.withColumn("kept", F.explode(F.array(*map(F.lit, levels))))
    cut = F.when(F.col("kept") > 0, F.element_at(order, F.greatest(F.col("kept"), F.lit(1)).cast("int")))
    return out.select(*[F.when(F.coalesce(rank[c] <= cut, F.lit(False)), F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns], "kept")


def sweep(train: DataFrame, test: DataFrame, grid: dict[str, Sequence], score: Callable[..., DataFrame], reference: dict, actual: str, predicted: str = "predicted") -> DataFrame:
    """Median error of every point of a product grid (the reference is always among them) and whether it beats the reference's.

    Points are fitted one after another, as each is a Spark job of its own.
    """
    points = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
    points = points if reference in points else [reference, *points]
    out = None
    for p in points:
        errors = cut(score(train, test, **p).select(relative_error(F.col(actual), F.col(predicted)).alias("_e")), "errors")
        r = exact_quantiles(errors, "_e", [0.5]).select(F.lit(",".join(f"{k}={v}" for k, v in p.items())).alias("point"), F.lit(p == reference).alias("reference"), F.col("q0").alias("_e"))
        out = r if out is None else out.unionByName(r)
    base = F.max(F.when(F.col("reference"), F.col("_e"))).over(Window.partitionBy(F.lit(1)))  # one row for each point
    return out.select("point", "reference", F.round("_e", 6).alias("mdape"), (F.col("_e") < base).alias("better"))


def family_confidence(tests: int, level: float = 0.05) -> float:
    """The confidence of each of several tests that together err at ``level``."""
    return 1 - level / max(1, tests)
