"""A replay of a table as a stream: so many rows a batch, alternating endpoints, dates moved to the time of sending, labels after the answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.functions.expressions import shifted_month, whole_months
from lakeloom.operators.positions import with_positions


def replay(spark: SparkSession, rows: DataFrame, rate: int, start_ms: int, step_ms: int, endpoints: Sequence[str], month: str | None = None, reference: str | None = None) -> DataFrame:
    """A streaming frame of ``rows`` in their order, ``rate`` of them in each batch: seq (from 0), sent_at, endpoint, and the row's own columns.

    Offsets are row numbers of Spark's own micro-batch rate source, so a restart goes on where it was and a batch that runs again sends the same rows at the same times. The
    column ``month`` (``YYYY-MM``) moves by the whole months from ``reference`` to the time of sending. The stream has nothing more to send once all rows are through.
    """
    table = with_positions(rows, "seq")
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rate).option("numPartitions", 1).option("startTimestamp", start_ms).option("advanceMillisPerBatch", step_ms).load()
    names = F.array(*map(F.lit, endpoints))
    out = ticks.select(F.col("value").alias("_tick"), F.col("timestamp").alias("sent_at")).join(table, F.col("_tick") == F.col("seq")).drop("_tick")
    out = out.withColumn("endpoint", names[(F.col("seq") % len(endpoints)).cast("int")])
    if month is not None:
        out = out.withColumn(month, shifted_month(F.col(month), whole_months(F.col("sent_at"), reference)))
    return out.select("seq", "sent_at", "endpoint", *rows.columns)


def labels(sent: DataFrame, observed: str, priced: Column, delay_ms: int) -> DataFrame:
    """The observed value of each answered and priced row of a replay, some time after its answer: seq, observed and received_at."""
    at = F.timestamp_millis(F.unix_millis("sent_at") + delay_ms)
    return sent.where(priced & F.col(observed).isNotNull()).select("seq", F.col(observed).alias("observed"), at.alias("received_at"))
