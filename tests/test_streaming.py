import pytest
from pyspark.sql import functions as F

from lakeloom.operators.monitoring import count_windows, window_states
from lakeloom.streaming import monitor as m


def rows_of(df):
    return sorted(tuple(r) for r in df.select("first_seq", "last_seq", "rows", "state").collect())


def test_stream_equals_batch_over_several_passes(spark, tmp_path):
    rows = [(i, "v1" if i < 230 else "v2" if i < 260 else "v3", float(i)) for i in range(1, 900)]
    log, schema = f"file://{tmp_path}/log", "seq long, model_version string, x double"
    own = m.Monitor(f"file://{tmp_path}/monitor", size=100)
    for a, b in ((0, 150), (150, 155), (155, 700), (700, 899)):
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(log)
        own.start(spark.readStream.schema(schema).parquet(log)).awaitTermination(120)
    whole = window_states(count_windows(spark.createDataFrame(rows, schema), "seq", "model_version", 100), "seq", 100)
    assert rows_of(own.windows(spark)) == rows_of(whole.where("state <> 'open'"))
    assert own.open_rows(spark).count() == whole.where("state = 'open'").first()["rows"]
    before = rows_of(own.windows(spark))
    own.step(spark.createDataFrame(rows[700:], schema), 99)
    assert rows_of(own.windows(spark)) == before
    with pytest.raises(m.LogRestartError):
        m.Monitor(f"file://{tmp_path}/monitor2", size=2).step(spark.createDataFrame(rows[5:9], schema), 0) or m.Monitor(f"file://{tmp_path}/monitor2", size=2).step(spark.createDataFrame(rows[0:2], schema), 1)


def test_scores_are_final_after_the_horizon_or_when_labels_go(spark):
    schema = "window int, last_answer timestamp, labels int, mdape double"
    day = lambda d: __import__("datetime").datetime(2025, 1, d)
    previous = spark.createDataFrame([(1, day(1), 10, 0.1, True), (2, day(1), 10, 0.1, False), (3, day(9), 10, 0.1, False), (4, day(9), 10, 0.1, False)], schema + ", final boolean")
    current = spark.createDataFrame([(1, day(1), 99, 0.9), (2, day(1), 12, 0.2), (3, day(9), 11, 0.3), (4, day(9), 5, 0.4), (5, day(9), 3, 0.5)], schema)
    got = {r["window"]: (r["labels"], r["mdape"], r["final"]) for r in m.score_windows(previous, current, "2025-01-10").collect()}
    assert got == {1: (10, 0.1, True), 2: (12, 0.2, True), 3: (11, 0.3, False), 4: (10, 0.1, True), 5: (3, 0.5, False)}
    out = m.exported(spark.createDataFrame([(1, 10, 0.1), (2, 4, None)], "window int, labels int, mdape double")).collect()
    assert [tuple(r) for r in out] == [("labels", 4.0)]
    runs = spark.createDataFrame([("ok", day(1)), ("failed", day(2))], "status string, finished_at timestamp")
    assert m.stale(runs, "2025-01-01 00:30:00").first()["stale"] is False and m.stale(runs, "2025-01-02").first()["stale"] is True


def test_event_time_counts_in_a_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(2).write.parquet(f"file://{tmp_path}/e")
    stream = m.event_counts(spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/e"))
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
