"""Session state, merges with scans, alerts, and the streams against their batches."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import agents, alerts, services, status
from tallyspark.operators.dedup import later_readings
from tallyspark.plans import binding as b
from tallyspark.streaming import sessions as live
from tallyspark.streaming import turns as stream
from tallyspark.streaming.ledger import Ledger

NOW = datetime(2024, 1, 1, 12)


def ago(seconds):
    return NOW - timedelta(seconds=seconds)


@pytest.mark.parametrize(
    ("case", "state", "from_scan"),
    [
        # (source, state, state_since, last, approximate, from_scan, before), scan (state, at), ended at
        ((("rollout", "done", 100, 100, False, False, None), ("working", 90), None), "working", True),
        ((("rollout", "done", 100, 100, False, False, None), ("working", 97), None), "done", False),
        ((("assistant", "done", 100, 100, False, False, None), ("working", 10), None), "done", False),
        ((("rollout", "needsYou", 100, 100, False, False, None), ("working", 10), None), "needsYou", False),
        ((("rollout", "working", 100, 100, False, True, "done"), ("idle", 60), None), "done", False),
        ((("rollout", "working", 100, 100, False, True, None), None, None), "idle", False),
        ((("rollout", "working", 100, 100, True, False, None), ("idle", 60), None), "idle", False),
        ((("rollout", "working", 100, 100, True, False, None), None, None), None, None),
        ((None, ("working", 5), None), "working", False),
        ((None, ("working", 5), 600), None, None),
        ((None, ("working", 5), 2000), "working", False),
    ],
)
def test_merge_with_a_scan(spark, case, state, from_scan):
    known, seen, gone = case
    rows = [] if known is None else [(known[0], "x", known[1], ago(known[2]), ago(known[3]), *known[4:])]
    l = spark.createDataFrame(rows, "source string, session_id string, state string, state_since timestamp_ntz, last_event_at timestamp_ntz, approximate boolean, from_scan boolean, before_scan string")  # noqa: E741
    source = known[0] if known else "rollout"
    s = spark.createDataFrame([(source, "x", seen[0], ago(seen[1]))] if seen else [], "source string, session_id string, state string, last_event_at timestamp_ntz")
    e = spark.createDataFrame([(source, "x", ago(gone))] if gone else [], "source string, session_id string, ended_at timestamp_ntz")
    found = agents.merged(l, s, e, NOW).collect()
    assert [(r["state"], r["from_scan"]) for r in found] == ([] if state is None else [(state, from_scan)])


def test_stale_sessions(spark):
    rows = [("a", 7200, None, None, None, None), ("b", 7200, 5, True, None, None), ("c", 7200, 5, False, None, None), ("d", 300, None, None, "t", False), ("e", 299, None, None, "t", False), ("f", 7300, 5, True, "t", True), ("g", 7300, 5, True, "t", False)]
    df = spark.createDataFrame([(n, ago(q), p, pa, t, ta) for n, q, p, pa, t, ta in rows], "session_id string, last_event_at timestamp_ntz, pid int, pid_alive boolean, tty string, tty_alive boolean")
    kept, dropped = agents.pruned(df, NOW)
    assert {r["session_id"] for r in dropped.collect()} == {"a", "c", "d", "g"} and {r["session_id"] for r in kept.collect()} == {"b", "e", "f"}


def test_the_stream_of_sessions_equals_the_batch(spark, sf, tmp_path):
    rows = b.agent_events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):  # three files in order of time: three micro-batches
        rows.filter(F.floor(F.col("seq") * 3 / rows.count()) == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    q = live.timeline(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    found = {(r["seq"], r["state"], r["entered"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    batch = {(r["seq"], r["state"], r["entered"]) for r in agents.timeline(b.agent_events(spark, sf)).collect()}
    assert found == batch


def test_the_stream_of_turns_equals_the_batch(spark, sf, tmp_path):
    rows = b.replays(spark, sf)
    for i in range(3):
        rows.filter(F.crc32(F.concat_ws("-", "msg_id", "seq").cast("binary")) % 3 == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    kept = Ledger(spark, f"{tmp_path}/ledger", buckets=3)
    q = kept.follow(source, f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert q.exception() is None
    found = kept.turns()
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, later_readings(rows).select(found.columns).collect()), key=str)


def test_half_hours_with_a_watermark(spark, sf, tmp_path):
    rows = b.events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), F.lit("c").alias("chat_id"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stream.half_hours(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), "10 minutes").writeStream.format("memory").queryName("half_hours").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    final = {(r["bin"], r["turns"]) for r in spark.table("half_hours").collect()}
    batch = {(r["bin"], r["turns"]) for r in stream.half_hours(rows).collect()}
    assert final <= batch and len(batch - final) <= 2  # the last bins wait for the watermark


def test_threshold_outcomes():
    assert alerts.outcome(80, 0) == ("fire", 80) and alerts.outcome(96, 80) == ("fire", 95) and alerts.outcome(96, 95) == ("unchanged", 95)
    assert alerts.outcome(77, 80) == ("unchanged", 80) and alerts.outcome(76, 80) == ("rearm", 0) and alerts.outcome(91, 95) == ("rearm", 80)


@pytest.mark.parametrize(("mid", "high", "margin"), [(80, 95, 3), (90, 95, 3), (93, 95, 3), (80, 95, 0), (50, 51, 20)])
def test_thresholds_equal_a_walk(spark, mid, high, margin):
    """Long histories that oscillate around the lines, over several days, for levels near and far from one another."""
    rng = random.Random(mid + margin)
    near = [0, mid - margin - 1, mid - margin, mid - 1, mid, high - margin - 1, high - margin, high - 1, high, 100]
    rows = [("s", f"b{k}", NOW + timedelta(minutes=37 * i), float(rng.choice(near) if k else 50)) for k in range(5) for i in range(220)]
    df = spark.createDataFrame([*rows, ("s", "b1", NOW, None)], "service string, bucket string, ts timestamp_ntz, percent double").repartition(3)
    expected, last = [], {}
    for s, k, ts, v in rows:
        what, level = alerts.outcome(int(v), last.get(k, 0), mid, high, margin)
        if what != "unchanged":
            expected.append((s, k, ts, int(v), level, what))
        last[k] = level
    found = [tuple(r) for r in alerts.thresholds(df, mid, high, margin).orderBy("bucket", "ts").collect()]
    assert found == expected and len(found) > 100


def test_thresholds_walk_nothing(spark, sf):
    plan = alerts.thresholds(b.readings(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan


def test_alerts_fire_once_for_a_wandering_window(spark):
    rows = [("k", NOW, ago(0)), ("k", NOW + timedelta(minutes=1), ago(-1)), ("k", NOW + timedelta(minutes=2), ago(-500)), ("j", NOW, ago(0))]
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, window timestamp_ntz")
    assert sorted((r["key"], r["window"]) for r in alerts.once_per_window(df).collect()) == [("j", ago(0)), ("k", ago(0)), ("k", ago(-500))]


def test_pacing_prefers_the_reset(spark):
    rows = [("s", "a", 85.0, NOW + timedelta(minutes=10), "session"), ("s", "b", 60.0, NOW + timedelta(hours=3), "session"), ("s", "c", 60.0, NOW - timedelta(minutes=1), "session"), ("s", "d", 99.0, NOW + timedelta(hours=1), "weekly")]
    buckets = spark.createDataFrame(rows, "service string, bucket string, percent double, resets_at timestamp_ntz, kind string")
    burn = spark.createDataFrame([("s", x, 600.0, False) for x in "abcd"], "service string, bucket string, seconds_to_limit double, is_stale boolean")
    assert sorted((r["bucket"], r["advice"]) for r in alerts.pacing(buckets, burn, NOW).collect()) == [("a", "reset"), ("b", "pace")]
    assert [(r["bucket"], r["will_hit"]) for r in services.pace(buckets.withColumn("window_seconds", F.lit(None).cast("double")), burn, NOW).orderBy("bucket").collect()] == [("a", False), ("b", True), ("c", False), ("d", True)]


def test_quiet_hours_cross_midnight(spark):
    df = spark.range(24)
    quiet = {r[0] for r in df.filter(alerts.in_quiet_hours(F.col("id"), 22, 7)).collect()}
    assert quiet == {22, 23, *range(7)} and df.filter(alerts.in_quiet_hours(F.col("id"), 5, 5)).count() == 0


def test_statusline_merge(spark):
    buckets = spark.createDataFrame([("s", "five_hour", "x", 10.0, ago(-100), "session", None, None, None, 0, "poll", None)], "service string, bucket string, label string, percent double, resets_at timestamp_ntz, kind string, window_seconds double, credit_used double, credit_limit double, pos int, source string, as_of timestamp_ntz")
    w = "struct<percent: double, resets_at: timestamp_ntz>"
    winner = spark.createDataFrame([(ago(10), (55.0, ago(-900)), (7.0, ago(-9000)))], f"as_of timestamp_ntz, five_hour {w}, seven_day {w}")
    own = lambda t: spark.createDataFrame([("s", t)], "service string, fetched_at timestamp_ntz")
    found = {r["bucket"]: (r["percent"], r["source"]) for r in services.statusline_merged(buckets, own(ago(60)), winner, "s", NOW).collect()}
    assert found == {"five_hour": (55.0, "statusline"), "seven_day": (7.0, "statusline")}
    found = {r["bucket"]: r["percent"] for r in services.statusline_merged(buckets, own(ago(5)), winner, "s", NOW).collect()}
    assert found == {"five_hour": 10.0, "seven_day": 7.0}


@pytest.mark.parametrize(("asked", "n"), [(None, 10), ("7", 7), (0, 1), (99, 15), ("x", 10), (float("nan"), 10), (2.9, 2)])
def test_session_limits(asked, n):
    assert status.session_limit(asked) == n


def test_status_writes_are_throttled():
    assert status.changed({"a": 1}, {"a": 2}, 3.0) and not status.changed({"a": 1}, {"a": 2}, 1.0) and not status.changed({"a": 1}, {"a": 1}, 9.0)
