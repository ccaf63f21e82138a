"""Admission meets state by blocks of keys, and a streamed part of few rows costs no job for each of its files."""

import random
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import Row
from pyspark.sql import functions as F
from test_state_calls import processor

from gazeloom.plans import serve_queries as Q
from gazeloom.streaming import streams as S


class Value:
    def __init__(self):
        self.calls, self.held = [], None

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, held):
        self.calls.append("update")
        self.held = held

    def clear(self):
        self.calls.append("clear")
        self.held = None


def blocks(idle_ms):
    made, held = S.Admissions(idle_ms), Value()
    made.init(SimpleNamespace(getValueState=lambda *_: held))
    return made, held.calls


def test_blocks_say_what_keys_say():
    """Batches of many keys, some without a name, device or moment, of which some free devices: answers are those of each key by itself, in two calls to Spark a batch."""
    some = random.Random(4)
    names = [None, *(f"k{n}" for n in range(30))]
    single, (block, calls) = {name: processor(S.Admission(None))[0] for name in names}, blocks(None)
    for batch in range(4):
        rows = [Row(key=some.choice(names), event_id=10**17 + 1000 * batch + n, device=some.choice([None, "", "#", "a", "b", "c", "d"]), ts=some.choice([None, 1, 2, 3]), is_active=some.choice([True, True, True, False, None]), max_devices=some.choice([None, 2, 3]), unbind=some.random() < 0.2) for n in range(400)]
        frame = pd.DataFrame([(r.ts is None, r.ts or 0, str(r.event_id), r.key, r.device, {True: 1, False: 0, None: 2}[r.is_active], r.max_devices or S.MAX_DEVICES, r.unbind) for r in rows], columns=S.Admissions.COLUMNS)
        calls.clear()
        got = pd.concat(block.handleInputRows((0,), iter([frame[:150], frame[150:]]), None))
        assert calls == ["get", "update"]
        want = [r for name in names for r in single[name].handleInputRows((name,), iter([r for r in rows if r.key == name]), None)]
        assert sorted(map(repr, zip(*(got[c].tolist() for c in S.ADMITTED.names), strict=True))) == sorted(map(repr, [tuple(r[c] for c in S.ADMITTED.names) for r in want]))


def test_idle_keys_of_a_block_go_alone():
    block, _ = blocks(100)
    timers = []
    block.handle = SimpleNamespace(listTimers=lambda: iter(timers), registerTimer=timers.append)
    at = lambda now: SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now)
    came = lambda key: iter([pd.DataFrame([(False, 1, "1", key, "a", 1, 1, False)], columns=S.Admissions.COLUMNS)])
    list(block.handleInputRows((0,), came("x"), at(1000)))
    list(block.handleInputRows((0,), came("y"), at(1050)))
    assert timers == [1100]
    timers.clear()
    list(block.handleExpiredTimer((0,), at(1110), None))
    assert list(block.read()) == ["y"] and timers == [1150]


def test_the_stream_keeps_a_value_a_block(spark, tmp_path):
    events = spark.range(2000).select((F.col("id") % 500).cast("string").alias("key"), F.col("id").alias("event_id"), (F.col("id") % 7).cast("string").alias("device"), F.col("id").alias("ts"), F.lit(True).alias("is_active"), F.lit(2).alias("max_devices"))
    events.write.parquet(f"{tmp_path}/in")
    with S.keyed_state(spark):
        stream = S.stream_admission(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), blocks=16)
        running = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        running.awaitTermination(120)
    assert running.lastProgress.stateOperators[0].numRowsTotal <= 16
    assert dict(spark.read.parquet(f"{tmp_path}/out").groupBy("outcome").count().collect()) == {"accepted": 1000, "device_limit": 1000}


def test_files_without_rows_cost_no_jobs(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(Q, "FILE_ROWS", 10)
    frame = spark.range(0, 600, 1, 4).withColumn("part", F.when(F.col("id") < 500, 0).otherwise(1))
    spark.sparkContext.setJobGroup("padded", "")
    try:
        source = Q.streamed(spark, sf_dir, frame, "padded", [F.col("part") == k for k in range(2)])
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("padded"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20
    got = Q.drain(source, "padded-out", "update").groupBy("batch", "part").count().collect()
    assert sorted(map(tuple, got)) == [(0, 0, 500), (1, 1, 100)]
