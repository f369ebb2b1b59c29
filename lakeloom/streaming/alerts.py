"""Alerts with a hold time over a stream of evaluations; the same states as ``counters.alerts`` gives for all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout


def alert_states(evaluations: DataFrame, series: str, ts: str, active: Column, hold_minutes: int) -> DataFrame:
    """series, ts, since and state of each evaluation. Evaluations of a series must come in order from batch to batch; inside a batch they are sorted.

    What is kept for a series is when its condition began to hold.
    """
    rows = evaluations.select(F.col(series).cast("string").alias("series"), F.col(ts).alias("ts"), F.coalesce(active, F.lit(False)).alias("active"))

    def run(key, frames, state):
        import pandas as pd

        since = pd.Timestamp(state.get[0]) if state.exists and state.get[0] is not None else None
        own, hold, out = pd.concat(list(frames)).sort_values("ts", kind="stable"), pd.Timedelta(minutes=hold_minutes), []
        for at, on in zip(own["ts"], own["active"], strict=True):
            since = (since if since is not None else at) if on else None
            out.append((key[0], at, since, "inactive" if since is None else "firing" if at >= since + hold else "pending"))
        state.update((None if since is None else since.to_pydatetime(),))
        yield pd.DataFrame(out, columns=["series", "ts", "since", "state"]).astype({"since": "datetime64[ns]"})

    return rows.groupBy("series").applyInPandasWithState(run, "series string, ts timestamp, since timestamp, state string", "since timestamp", "append", GroupStateTimeout.NoTimeout)
