"""The monitor as a stream: count windows with reset, late labels and drift, over a log that grows.

The log's order is its sequence number and a window depends on all rows of its run, so each micro-batch
re-reads the open remainder, closes what is full, and commits windows and remainder together. A batch that
was committed isn't run again, and one that failed left nothing that readers see, so a restart loses and doubles nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators.ledger import latest_wins
from lakeloom.operators.monitoring import count_windows, window_states
from lakeloom.sources.manifests import ManifestTables


class LogRestartError(RuntimeError):
    """The log ends before a window that was closed from it."""


@dataclass(frozen=True)
class Monitor:
    """Folders of a monitor and the columns of its log."""

    folder: str
    size: int = 1000
    seq: str = "seq"
    version: str = "model_version"

    @property
    def tables(self) -> ManifestTables:
        return ManifestTables(self.folder, {"windows": "first_seq long, last_seq long, rows long, state string", "open": "path string"})

    def windows(self, spark: SparkSession) -> DataFrame:
        """Closed windows: first_seq, last_seq, rows and state."""
        return self.tables.read(spark, "windows").drop("batch")

    def open_rows(self, spark: SparkSession) -> DataFrame | None:
        """What the last batch left unfinished, for the batch after."""
        last = self.tables.read(spark, "open").agg(F.max_by("path", "batch")).first()[0]
        return None if last is None else spark.read.parquet(last)

    def step(self, batch: DataFrame, number: int) -> None:
        """Add a batch to what is open, close windows, and keep the rest: windows and remainder are committed together, once for each batch number."""
        spark = batch.sparkSession
        if self.tables.committed(spark, number):
            return
        closed = self.windows(spark)
        last = closed.agg(F.max("last_seq")).first()[0]
        before = self.open_rows(spark)
        rows = batch if before is None else before.select(batch.columns).unionByName(batch)
        rows = rows.dropDuplicates([self.seq])
        if last is not None:
            top = rows.agg(F.max(self.seq)).first()[0]
            if top is not None and top < last:
                raise LogRestartError(f"the log ends at {top}, before the last closed window's {last}")
            rows = rows.where(F.col(self.seq) > last)
        windowed = count_windows(rows, self.seq, self.version, self.size)
        states = window_states(windowed, self.seq, self.size).persist()
        done = states.where("state <> 'open'").select("first_seq", "last_seq", "rows", "state")
        remainder = windowed.join(states.where("state = 'open'").select("run", "window"), ["run", "window"], "left_semi").select(batch.columns)
        path = f"{self.folder}/remainders/{number}-{uuid.uuid4().hex}"
        remainder.write.parquet(path)
        self.tables.write(number, {"windows": done, "open": spark.createDataFrame([(path,)], "path string")})
        states.unpersist()

    def start(self, log: DataFrame, available_now: bool = True) -> StreamingQuery:
        """Run over a streaming log; every 15 minutes unless only what is there is wanted."""
        writer = log.writeStream.foreachBatch(self.step).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="15 minutes")).start()


def score_windows(previous: DataFrame, current: DataFrame, now: str, horizon_days: int = 7) -> DataFrame:
    """Performance of windows after a pass: latest figures, final once the horizon after the last answer is over.

    ``previous`` and ``current``: window, last_answer, labels, mdape; previous also ``final``. Final rows stay as they are. A
    window whose requests are gone, or whose labels shrank, keeps its figures and becomes final.
    """
    p = previous.select("window", F.col("last_answer").alias("p_answer"), F.col("labels").alias("p_labels"), F.col("mdape").alias("p_mdape"), F.col("final").alias("p_final"))
    j = p.join(current, "window", "full_outer")
    lost = F.col("labels").isNull() | (F.col("labels") < F.col("p_labels"))
    keep = F.coalesce(F.col("p_final"), F.lit(False)) | F.coalesce(F.col("p_labels").isNotNull() & lost, F.lit(False))
    over = F.col("last_answer") + F.expr(f"interval {horizon_days} days") < F.to_timestamp(F.lit(now))
    return j.select(
        "window", F.when(keep, F.col("p_answer")).otherwise(F.col("last_answer")).alias("last_answer"), F.when(keep, F.col("p_labels")).otherwise(F.col("labels")).alias("labels"),
        F.when(keep, F.col("p_mdape")).otherwise(F.col("mdape")).alias("mdape"), (keep | over).alias("final"),
    )


def exported(windows: DataFrame) -> DataFrame:
    """The newest window's figures as (metric, value); what lacks labels is left out."""
    newest = windows.orderBy(F.desc("window")).limit(1)
    return newest.select(F.explode(F.array(F.struct(F.lit("labels").alias("metric"), F.col("labels").cast("double").alias("value")), F.struct(F.lit("mdape").alias("metric"), F.col("mdape").alias("value")))).alias("m")).select("m.*").where("value is not null")


def stale(runs: DataFrame, now: str, minutes: int = 40) -> DataFrame:
    """Whether the last good run is too long ago, or there was none."""
    last = runs.agg(F.max(F.when(F.col("status") == "ok", F.col("finished_at"))).alias("last_success"))
    return last.withColumn("stale", F.col("last_success").isNull() | (F.col("last_success") + F.expr(f"interval {minutes} minutes") < F.to_timestamp(F.lit(now))))


def event_counts(events: DataFrame, ts: str = "ts", lateness: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Event-time tumbling counts with a watermark, on a streaming or a static frame."""
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return events.withWatermark(ts, lateness).groupBy(F.window(ts, width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def unique_answers(answers: DataFrame, key: str = "request_id", ts: str = "answered_at", lateness: str = "7 days") -> DataFrame:
    """A stream with each request once: later repeats within the watermark are dropped."""
    return answers.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def compact(spark: SparkSession, path: str, keys: list[str], order: str, into: str) -> None:
    """Rewrite an append-only table with the latest row of each key."""
    df = spark.read.parquet(path)
    latest_wins(df.limit(0), df, keys, order).write.mode("overwrite").parquet(into)
