"""Sessions with timers: against the batch over one scan, and what happens while nothing is heard."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import agents
from tallyspark.streaming import passive

NOW = datetime(2024, 5, 1, 12)
ROWS = "source string, session_id string, ts timestamp, seq long, what string, kind string, tool string, attention string, is_subagent boolean, modified_at timestamp"


def hook(name, at, kind, seq=0, source="rollout", attention=None, sub=False):
    return (source, name, NOW + timedelta(seconds=at), seq, "hook", kind, None, attention, sub, None)


def scan(name, at, written, source="rollout"):
    return (source, name, NOW + timedelta(seconds=at), 10**6, "scan", None, None, None, False, NOW + timedelta(seconds=written))


@pytest.fixture
def run(spark, tmp_path):
    """Batches of rows through the stream, one after the other; the rows that come out, in order of time."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go(*batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = passive.sessions(spark.readStream.schema(ROWS).parquet(f"{tmp_path}/in"), "1 second")
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
            query.awaitTermination(180)
            assert query.exception() is None
        out = spark.read.schema(passive.OUT).parquet(f"{tmp_path}/out").withColumn("s", (F.unix_millis("at") - int(NOW.timestamp() * 1000)) / 1000)
        return [(r.session_id, r.s, r.state, r.approximate, r.from_scan) for r in out.orderBy("session_id", "at").collect()]

    yield go
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def test_timers(run):
    tick = [hook("clock", 10_000, "sessionStart")]
    found = run(
        [hook("a", 0, "promptSubmitted"), hook("a", 5, "stop"), hook("b", 0, "promptSubmitted"), hook("b", 10, "sessionEnd"), hook("d", 0, "stop", source="assistant"), scan("c", 20, 15)],
        [scan("a", 20, 9), scan("a", 40, 38), scan("b", 40, 39), scan("d", 40, 39, "assistant")],
        tick,
        [scan("b", 10_001, 10_000), scan("clock", 10_002, 10_001)],
    )
    of = lambda name: [r[1:] for r in found if r[0] == name]
    # 9 is not five seconds after 5; 38 is; quiet from 68 on; nothing heard for two hours
    assert of("a") == [(0.0, "working", False, False), (5.0, "done", False, False), (40.0, "working", False, True), (68.001, "done", False, False), (7238.001, "gone", False, False)]
    # ended: not brought back at 40, but half an hour later
    assert of("b") == [(0.0, "working", False, False), (10.0, "ended", False, False), (10_001.0, "working", True, False)]
    assert of("c") == [(20.0, "working", True, False), (45.001, "idle", True, False), (1815.001, "gone", False, False)]
    assert [r[1] for r in of("d")] == ["done", "gone"]  # hooks know better than the log's time


def test_one_scan_equals_the_batch(spark, run):
    rng = random.Random(5)
    kinds = ["sessionStart", "promptSubmitted", "toolStarted", "toolFinished", "stop", "notificationIdle", "permissionRequested", "sessionEnd", "unknown"]
    hooks = [hook(f"s{k}", -rng.randrange(60, 3000), rng.choice(kinds), seq, rng.choice(["rollout"]) if k % 2 else "assistant", rng.choice([None, None, "why"])) for k in range(40) for seq in range(rng.randrange(0, 6))]
    scans = [scan(f"s{k}", 0, -rng.choice([1, 10, 29, 31, 600, 1799]), "rollout" if k % 2 else "assistant") for k in range(60) if rng.random() < 0.7]
    last = {}
    for r in run(hooks, scans):
        last[r[0]] = r[2:]
    found = {k: v for k, v in last.items() if v[0] not in ("ended", "gone")}

    events = spark.createDataFrame(hooks, ROWS).select("source", "session_id", "seq", "kind", F.col("ts").cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("cwd"), "tool", F.lit(None).cast("string").alias("summary"), "attention", "is_subagent", F.lit(None).cast("long").alias("pid"), F.lit(None).cast("string").alias("tty"))
    runs = agents.runs(agents.timeline(events))
    live = agents.live(runs).select("source", "session_id", "state", "state_since", "last_event_at", F.lit(False).alias("approximate"), F.lit(False).alias("from_scan"), F.lit(None).cast("string").alias("before_scan"))
    ended = runs.filter("ended_at is not null").groupBy("source", "session_id").agg(F.max("ended_at").alias("ended_at"))
    seen = agents.scanned(spark.createDataFrame([(r[0], r[1], r[9]) for r in scans], "source string, session_id string, modified_at timestamp_ntz"), NOW)
    expected = {r.session_id: (r.state, r.approximate, r.from_scan) for r in agents.merged(live, seen, ended, NOW).collect()}
    assert found == expected and len(found) > 30
