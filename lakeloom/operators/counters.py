"""Counters that start again at zero, silent series, and alerts with a hold time, over rows of (series, time, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.operators.carry import carried


def _days(ts: str) -> Column:
    return F.date_trunc("day", F.col(ts))


def deltas(samples: DataFrame, series: Sequence[str], ts: str, value: str, tie: str | None = None) -> DataFrame:
    """The samples with ``delta``, ``changed`` and ``reset`` against the sample before in their series.

    A smaller value than before is a counter that started again: its delta is the value itself. The first sample of a series has delta zero.
    Samples at one time go by ``tie``. Null values are left out.
    """
    order = [ts] if tie is None else [ts, tie]
    out = carried(samples.where(F.col(value).isNotNull()), series, order, _days(ts), {"_before": F.col(value)})
    v, before = F.col(value), F.col("_before")
    delta = F.when(before.isNull(), v - v).when(v < before, v).otherwise(v - before)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({"delta": delta, "changed": flag(v != before), "reset": flag(v < before)}).drop("_before")


def increases(samples: DataFrame, series: Sequence[str], ts: str, value: str, minutes: int, tie: str | None = None) -> DataFrame:
    """series, start, samples, increase, rate (a second), changes and resets of tumbling windows; a delta counts in the window of its later sample."""
    w = deltas(samples, series, ts, value, tie).groupBy(*series, F.window(ts, f"{minutes} minutes").alias("_w"))
    n = lambda c: F.sum(F.col(c).cast("long"))
    out = w.agg(F.count("*").alias("samples"), F.sum("delta").alias("increase"), n("changed").alias("changes"), n("reset").alias("resets"))
    return out.select(*series, F.col("_w.start").alias("start"), "samples", "increase", (F.col("increase") / (60.0 * minutes)).alias("rate"), "changes", "resets")


def silences(samples: DataFrame, series: Sequence[str], ts: str, start: str, end: str, step_minutes: int, limit_minutes: int) -> DataFrame:
    """Each series at each step from ``start`` to ``end``: ``at``, ``last`` (its last sample up to then) and whether it is ``silent``.

    Silent is a series whose last sample is over the limit ago, or that had none yet. Only series of ``samples`` can be told.
    """
    steps = F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr(f"interval {step_minutes} minutes"))
    grid = samples.select(*series).distinct().withColumn("_t", F.explode(steps)).withColumn("_kind", F.lit(1))
    seen = samples.select(*series, F.col(ts).alias("_t"), F.lit(0).alias("_kind")).distinct()
    both = carried(seen.unionByName(grid), series, ["_t", "_kind"], _days("_t"), {"last": F.when(F.col("_kind") == 0, F.col("_t"))})
    late = F.col("last") < F.col("_t") - F.expr(f"interval {limit_minutes} minutes")
    return both.where("_kind = 1").select(*series, F.col("_t").alias("at"), "last", F.coalesce(late, F.lit(True)).alias("silent"))


def alerts(evaluations: DataFrame, series: Sequence[str], ts: str, active: Column, hold_minutes: int) -> DataFrame:
    """The evaluations with ``since`` (when the condition began to hold without a break) and ``state``: inactive, pending or firing.

    An alert fires at an evaluation at least the hold time after its first; a condition that isn't known (null) doesn't hold.
    """
    held = evaluations.withColumn("_on", F.coalesce(active, F.lit(False)))
    before = carried(held, series, [ts], _days(ts), {"_was": F.col("_on")})
    begun = before.withColumn("_start", F.when(F.col("_on") & ~F.coalesce(F.col("_was"), F.lit(False)), F.col(ts)))
    out = carried(begun, series, [ts], _days(ts), {"_since": F.col("_start")})
    since = F.when(F.col("_on"), F.coalesce("_start", "_since"))
    firing = F.col(ts) >= since + F.expr(f"interval {hold_minutes} minutes")
    return out.withColumn("since", since).withColumn("state", F.when(~F.col("_on"), "inactive").when(firing, "firing").otherwise("pending")).drop("_on", "_was", "_start", "_since")
