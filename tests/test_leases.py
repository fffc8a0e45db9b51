"""The lease tracker on a stream of unordered beats, stopped and started again from its checkpoint, against the table form."""

import random
from datetime import datetime, timedelta

import pytest

from quillspark.streaming import events

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocksdb(spark):
    old = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, old)


def test_tracker_equals_the_table(spark, tmp_path, rocksdb):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    beats = sorted((start + timedelta(seconds=rng.randint(0, 4000)), rng.randint(1, 6)) for _ in range(260))
    late = 120
    # each file has beats that are up to two minutes out of order with those of its neighbours
    shuffled = sorted(beats, key=lambda b: b[0] + timedelta(seconds=rng.randint(0, late - 10)))
    parts = [shuffled[i : i + 20] for i in range(0, len(shuffled), 20)]
    schema = events.EVENT.replace("timestamp_ntz", "timestamp_ntz")

    def write(i, rows):
        rows = [(k, t, u, "beat", 1.0, "{}") for k, (t, u) in enumerate(rows)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        s = events.tracked_leases(events.read_events(spark, str(tmp_path / "in"), 1), 100, f"{late} seconds")
        q = s.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination(300)
        assert q.exception() is None

    for i, rows in enumerate(parts[:6]):
        write(i, rows)
    run()
    half = spark.read.parquet(str(tmp_path / "out")).count()
    for i, rows in enumerate(parts[6:]):
        write(i, rows)
    write(99, [(start + timedelta(seconds=9000), 7)])  # moves the watermark past all leases
    write(100, [(start + timedelta(seconds=9001), 7)])
    run()
    got = sorted((r.user_id, r.started, r.ended, r.beats) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    table = spark.createDataFrame(beats, "ts timestamp_ntz, user_id long")
    want = sorted((r.user_id, r.started, r.ended, r.beats) for r in events.lease_runs(table, 100).collect())
    assert got == want and 0 < half < len(got)
    assert any(b > 1 for *_, b in got)


def test_table_form(spark):
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [(1, t(0)), (1, t(59)), (1, t(119)), (1, t(119)), (2, t(5)), (None, t(1)), (3, None)]
    got = events.lease_runs(spark.createDataFrame(rows, "user_id long, ts timestamp_ntz"), 60).collect()
    assert sorted((r.user_id, r.beats) for r in got) == [(1, 2), (1, 2), (2, 1)]
    assert events.lease_runs(spark.createDataFrame([], "user_id long, ts timestamp_ntz"), 60).count() == 0
