import time

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.monitoring import count_windows, window_states
from lakeloom.sources.manifests import ManifestTables
from lakeloom.streaming import monitor as m
from lakeloom.streaming.lease import Lease, trimmed
from lakeloom.streaming.replay import labels, replay


def tables(path):
    return ManifestTables(f"file://{path}/t", {"a": "x int", "b": "y int"})


def held(t, spark):
    return tuple(sorted(r[0] for r in t.read(spark, n).collect()) for n in ("a", "b"))


def test_readers_see_a_batch_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    t = tables(tmp_path)
    one, two = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "y int")
    assert held(t, spark) == ([], [])
    bad = two.select(F.raise_error(F.lit("lost")).cast("int").alias("y"))
    with pytest.raises(Exception, match="lost"):  # between the two tables
        t.write(0, {"a": one, "b": bad})
    assert held(t, spark) == ([], [])
    with monkeypatch.context() as patch:  # between tables and manifest
        patch.setattr(ManifestTables, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            t.write(0, {"a": one, "b": two})
    assert held(t, spark) == ([], [])
    assert t.write(0, {"a": one, "b": two}) and held(t, spark) == ([1], [2])
    assert not t.write(0, {"a": one, "b": two}) and held(t, spark) == ([1], [2])
    assert t.write(1, {"a": one}) and held(t, spark) == ([1, 1], [2])
    with pytest.raises(ValueError):
        t.write(2, {"c": one})


def test_monitor_that_fails_between_writes_starts_again_from_the_old_state(spark, tmp_path, monkeypatch):
    rows, schema = [(i, "v1", float(i)) for i in range(250)], "seq long, model_version string, x double"
    own = m.Monitor(f"file://{tmp_path}/m", size=100)
    own.step(spark.createDataFrame(rows[:120], schema), 0)
    with monkeypatch.context() as patch:
        patch.setattr(ManifestTables, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
        with pytest.raises(RuntimeError):
            own.step(spark.createDataFrame(rows[120:], schema), 1)
    assert own.windows(spark).count() == 1 and own.open_rows(spark).count() == 20
    for _ in range(2):
        own.step(spark.createDataFrame(rows[120:], schema), 1)
        assert own.windows(spark).count() == 2 and own.open_rows(spark).count() == 50


def test_one_pass_at_a_time_and_trimmed_state(spark, tmp_path):
    first, second = Lease(f"file://{tmp_path}/l"), Lease(f"file://{tmp_path}/l")
    assert first.run(spark, lambda: second.run(spark, lambda: "both") or "one") == "one"
    assert second.run(spark, lambda: "later") == "later"
    with pytest.raises(RuntimeError):
        first.run(spark, lambda: (_ for _ in ()).throw(RuntimeError("failed")))
    assert first.acquire(spark) and not second.acquire(spark)
    time.sleep(0.05)
    assert Lease(f"file://{tmp_path}/l", seconds=0).acquire(spark)
    stored = spark.createDataFrame([(i,) for i in range(10)], "seq long")
    assert trimmed(stored, stored.where("seq > 6")).count() == 3 and trimmed(stored, stored.limit(0)).count() == 10


def test_replay_through_the_monitor_equals_the_batch(spark, tmp_path):
    rows = [(100 + i, "v1" if i < 90 else "v2", "2020-01", None if i % 7 == 0 else float(i)) for i in range(150)]
    table = spark.createDataFrame(rows, "id int, model_version string, registered string, price double")
    stream = replay(spark, table, 40, 1_700_000_000_000, 86_400_000 * 20, ["one", "two", "three"], "registered", "2023-11-08")
    own = m.Monitor(f"file://{tmp_path}/m", size=30)
    kept = f"file://{tmp_path}/sent"

    def step(batch, number):
        own.step(batch.select("seq", "model_version"), number)
        batch.write.mode("overwrite").parquet(f"{kept}/batch={number}")

    q = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"file://{tmp_path}/c").start()
    end = time.time() + 100
    while q.isActive and (q.lastProgress or {}).get("batchId", -1) < 5 and time.time() < end:
        time.sleep(0.3)
    q.stop()
    sent = spark.read.parquet(kept)
    got = {r["seq"]: r for r in sent.collect()}
    assert sorted(got) == list(range(150)) and [got[i]["id"] for i in range(150)] == [100 + i for i in range(150)]
    assert [got[i]["endpoint"] for i in range(4)] == ["one", "two", "three", "one"]
    assert {got[i]["registered"] for i in range(40)} == {"2020-01"} and got[149]["registered"] == "2020-03"
    batch = window_states(count_windows(spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows)], "seq long, model_version string"), "seq", "model_version", 30), "seq", 30)
    closed = lambda df: sorted(tuple(r) for r in df.where("state <> 'open'").select("first_seq", "last_seq", "rows", "state").collect())
    assert closed(own.windows(spark)) == closed(batch)
    late = labels(sent, "price", F.col("seq") % 2 == 0, 1000).collect()
    assert sorted(r["seq"] for r in late) == [i for i in range(0, 150, 2) if i % 7] and all((r["received_at"] - got[r["seq"]]["sent_at"]).total_seconds() == 1 for r in late)
