"""Busy services: no burst and no bucket's readings are gathered in one row or group."""

from __future__ import annotations

import random
from datetime import timedelta

from tallyspark.operators import limits, quota
from tests.test_limits import T0, past, readings


def test_throttle_equals_a_walk_and_collects_no_list(spark, monkeypatch):
    rng = random.Random(5)
    rows, at = [], {"a": 0, "b": 0}
    for _ in range(600):
        for s in at:
            at[s] += rng.choice([1, 5, 9, 10, 11, 29, 30, 31, 90]) if s == "b" else rng.randrange(0, 6)
            rows.append((s, T0 + timedelta(seconds=at[s])))
    expected = set()
    for s in at:
        last = None
        for t in sorted(t for name, t in rows if name == s):
            if last is None or (t - last).total_seconds() >= 30:
                expected.add((s, last := t))
    plans, write = [], quota.__dict__.get("written", lambda df: df)
    monkeypatch.setattr(quota, "written", lambda df: plans.append(df) or write(df), raising=False)
    found = quota.throttled(spark.createDataFrame(rows, "service string, ts timestamp_ntz"))
    assert {tuple(r) for r in found.collect()} == expected
    assert not any("collect_list" in p._jdf.queryExecution().toString() for p in [found, *plans])


def test_past_windows_walk_no_bucket(spark):
    rows = [(i, 1 + i / 20, None) for i in range(1, 401)] + [(410, 0, None), (420, 1, None), (550, 7, None), (600, 0, None), (601, 0, None)]
    assert past(spark, rows, 700) == [(400, 550, False)]
    current = spark.createDataFrame([("s", "five_hour", T0, 18_000.0)], "service string, bucket string, start timestamp_ntz, length double")
    plan = limits.past_windows(readings(spark, rows), current, T0)._jdf.queryExecution().optimizedPlan().toString()
    assert "Pandas" not in plan and "Arrow" not in plan
