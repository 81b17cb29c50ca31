"""Ordered limit operators against plain walks, and the invariants of seeded histories."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import limits, quota
from tallyspark.plans import limit_queries

T0 = datetime(2024, 1, 1)
READING = "service string, bucket string, ts timestamp_ntz, percent double, resets_at timestamp_ntz, window_seconds double"
CURRENT = "service string, bucket string, start timestamp_ntz, length double"


def minutes(n):
    return T0 + timedelta(minutes=n)


def readings(spark, rows, bucket="five_hour", length=18_000.0):
    return spark.createDataFrame([("s", bucket, minutes(t), float(p), None if r is None else minutes(r), length if r is not None else None) for t, p, r in rows], READING)


def past(spark, rows, current_start, horizon=-10_000, length=18_000.0):
    current = spark.createDataFrame([("s", "five_hour", minutes(current_start), length)], CURRENT)
    found = limits.past_windows(readings(spark, rows, length=length), current, minutes(horizon)).collect()
    return [((r["start"] - T0).total_seconds() / 60, (r["end"] - T0).total_seconds() / 60, r["reset_high"] is not None) for r in sorted(found, key=lambda r: r["start"], reverse=True)]


def test_windows_from_named_resets(spark):
    rows = [(10, 5, 300), (200, 40, 300), (310, 2, 600), (500, 3, 600), (610, 1, 900)]
    assert past(spark, rows, 600) == [(300, 600, True), (0, 300, True)]


def test_a_session_that_ended_low_is_seen_by_its_reset(spark):
    rows = [(10, 1, 300), (290, 2, 300), (301, 0, 601), (400, 1, 601), (700, 5, 1000)]
    assert past(spark, rows, 700) == [(301, 601, True), (0, 300, True)]


def test_a_restore_inside_a_window_does_not_split_it(spark):
    rows = [(10, 60, 300), (100, 99, 300), (110, 0, 300), (200, 20, 300), (310, 1, 600)]
    assert past(spark, rows, 300) == [(0, 300, True)]


def test_windows_from_held_drops_alone(spark):
    rows = [(10, 10, None), (200, 60, None), (210, 2, None), (220, 4, None), (400, 50, None), (410, 0, None), (420, 1, None), (550, 7, None)]
    assert past(spark, rows, 700) == [(400, 700, False), (200, 400, False)]


def test_idle_windows_and_old_ones_are_left_out(spark):
    rows = [(10, 10, 300), (310, 0, 600), (610, 4, 900)]
    assert past(spark, rows, 900) == [(600, 900, True), (0, 300, True)]
    assert past(spark, rows, 900, horizon=100) == [(600, 900, True)]


def test_no_reading_no_window(spark):
    assert past(spark, [], 300) == []


@pytest.mark.parametrize("seeds", [range(0, 40), range(40, 80)])
def test_seeded_histories_keep_the_invariants(spark, seeds):
    """2 to 9 sessions, some cut short, readings every 10 to 25 minutes, resets that wander by two seconds, idle gaps."""
    rows, sessions = [], {}
    for seed in seeds:
        rng = random.Random(seed)
        at, name, count = T0, f"s{seed}", rng.randint(2, 9)
        for i in range(count):
            reset = at + timedelta(hours=5)
            stop = reset if rng.random() > 0.35 else at + timedelta(minutes=rng.randint(60, 250))
            t, p = at + timedelta(minutes=rng.randint(1, 8)), 1.0
            while t < stop:
                p = min(100.0, p + rng.random() * 9)
                rows.append((name, "five_hour", t, p, reset + timedelta(seconds=rng.randint(-2, 2)), 18_000.0))
                t += timedelta(minutes=rng.randint(10, 25))
            if i < count - 1:
                at = reset + timedelta(minutes=rng.choice([0, 0, 40, 200]))
        sessions[name] = (count, at)
    current = spark.createDataFrame([(n, "five_hour", s, 18_000.0) for n, (_, s) in sessions.items()], CURRENT)
    found = limits.past_windows(spark.createDataFrame(rows, READING), current, T0 - timedelta(days=1)).collect()
    for name, (count, start) in sessions.items():
        own = sorted((r for r in found if r["service"] == name), key=lambda r: r["start"])
        assert len([r for r in own if r["reset_high"] is not None]) == count - 1
        assert all(r["start"] < r["end"] <= start for r in own)
        assert all(a["end"] <= b["start"] for a, b in zip(own, own[1:], strict=False))


def walk_past(part, horizon):
    """The finished windows of one bucket, from its runs of named resets and its held drops; `left_zero`: a named reading did."""
    drift, bin_ = pd.Timedelta(seconds=limits.RESET_DRIFT_S), pd.Timedelta(seconds=limits.BIN_S)
    current = part["current_start"].iloc[0]
    length = pd.Timedelta(seconds=float(part["current_length"].iloc[0]))
    runs = part[part["what"] == "run"].sort_values("run")
    named = [
        {"run": r.run, "low": r.low, "high": r.high, "start": r.high - (pd.Timedelta(seconds=float(r.length)) if pd.notna(r.length) else length), "zero": bool(r.left_zero), "first": r.first_ts, "last": r.last_ts}
        for r in runs.itertuples()
    ]
    open_now = lambda g: g["low"] - drift < current + length < g["high"] + drift
    starts, seen_early = [], None
    for d in part[part["what"] == "drop"].sort_values("last_ts").itertuples():
        if d.last_ts > current or any(g["first"] <= d.first_ts and g["last"] >= d.last_ts for g in named):
            continue  # in the open window, or a limit restored inside a window
        if d.last_ts > current - bin_:
            seen_early = d.first_ts if seen_early is None else min(seen_early, d.first_ts)
            continue
        starts.append(next((g["high"] for g in named if d.first_ts < g["high"] <= d.last_ts), d.first_ts))
    inside = lambda t: any(g["start"] - drift < t < g["high"] for g in named)
    plain = {s for s in starts if not any(abs(g["start"] - s) < drift for g in named)}
    plain |= {g["high"] for g in named if not open_now(g) and not inside(g["high"])}
    found = [(g["start"], g["high"], g["low"], g["high"], g["zero"]) for g in named if not open_now(g)] + [(s, None, None, None, False) for s in plain]
    marks = sorted([f[0] for f in found] + [current])
    out = []
    for start, own_end, low, high, zero in found:
        end = min([m for m in marks if m > start] + [current])
        if own_end is not None:
            end = min(end, own_end)
        elif seen_early is not None and seen_early > start:
            end = min(end, seen_early)
        if start >= horizon and start < end:
            out.append((part["service"].iloc[0], part["bucket"].iloc[0], start, end, low, high, zero))
    return pd.DataFrame(sorted(out, key=lambda r: r[2], reverse=True), columns=["service", "bucket", "start", "end", "reset_low", "reset_high", "left_zero"])


def runs_and_drops(rows, current, length, horizon):
    """Runs of named resets and held drops of one bucket's readings (ts, percent, resets_at, window_seconds), in order."""
    rows = [r for r in sorted(rows, key=lambda r: (r[0], r[1])) if r[0] >= horizon - timedelta(days=8)]
    out, named, run, runs = [], None, 0, {}
    for i, (ts, p, reset, window) in enumerate(rows):
        before = run
        if reset is not None:
            if named is None or abs((reset - named).total_seconds()) >= limits.RESET_DRIFT_S:
                run += 1
            g = runs.setdefault(run, {"run": run, "low": reset, "high": reset, "length": None, "left_zero": False, "first_ts": ts, "last_ts": ts})
            g |= {"low": min(g["low"], reset), "high": max(g["high"], reset), "left_zero": g["left_zero"] or p > 0, "last_ts": ts, "length": window if window is not None else g["length"]}
            named = reset
        if i and rows[i - 1][1] - p >= 5 and (i + 1 == len(rows) or rows[i - 1][1] - rows[i + 1][1] >= 5) and (rows[i - 1][2] is None or reset is None):
            out.append({"what": "drop", "run": before, "first_ts": rows[i - 1][0], "last_ts": ts})
    out += [g | {"what": "run"} for g in runs.values()]
    return pd.DataFrame([{"service": "s", "bucket": "b", "current_start": current, "current_length": length, "low": None, "high": None, "length": None, "left_zero": False} | r for r in out])


@pytest.mark.parametrize("seed", range(3))
def test_past_windows_equal_a_walk_of_wild_histories(spark, seed):
    """Readings that name another reset each time, or none, and resets that oscillate, repeat and lie far ahead or behind."""
    rng, rows, expected = random.Random(seed), [], []
    horizon, current, length = T0 + timedelta(days=1), T0 + timedelta(days=9), 5 * 3600.0
    for k in range(12):
        own, t, p = [], T0 - timedelta(days=2), 0.0
        while t < current + timedelta(hours=3):
            t += timedelta(minutes=rng.choice([1, 5, 30, 200, 900]), seconds=rng.randrange(3))
            p = rng.choice([p, min(100.0, p + rng.randrange(20)), max(0.0, p - rng.randrange(60)), 0.0])
            base = t.replace(minute=0, second=0, microsecond=0)
            reset = rng.choice([None, None, base + timedelta(hours=rng.choice([1, 2, 5]), seconds=rng.randrange(700)), current + timedelta(hours=5), t, base - timedelta(hours=1)]) if k % 3 else rng.choice([None, base + timedelta(hours=3), base + timedelta(hours=5, minutes=5)])
            own.append((t, p, reset, rng.choice([None, 18000.0, 7200.0])))
        rows += [(f"s{k}", "b", ts, v, r, w) for ts, v, r, w in own]
        spans = walk_past(runs_and_drops(own, current, length, horizon), pd.Timestamp(horizon))
        for r in spans.itertuples():
            used = r.left_zero or any(x is None and v > 0 and ts >= horizon and r.start < ts <= r.end for ts, v, x, _ in own)
            if used:
                expected.append((f"s{k}", r.start, r.end, None if pd.isna(r.reset_high) else r.reset_high))
    cur = spark.createDataFrame([(f"s{k}", "b", current, length) for k in range(12)], "service string, bucket string, start timestamp_ntz, length double")
    found = [(r["service"], r["start"], r["end"], r["reset_high"]) for r in limits.past_windows(spark.createDataFrame(rows, READING), cur, horizon).collect()]
    assert sorted(found, key=str) == sorted(((s_, a.to_pydatetime(), b.to_pydatetime(), h and h.to_pydatetime()) for s_, a, b, h in expected), key=str)
    assert len(found) > 20


def walk_restored(points):
    points = sorted(points)
    held = [i for i in range(1, len(points)) if points[i - 1][1] - points[i][1] >= 5 and (i + 1 == len(points) or points[i - 1][1] - points[i + 1][1] >= 5)]
    out = [p for _, p in points]
    for i in held:
        level = max(out[:i], default=0)
        if level > 0:
            out[:i] = [p * out[i] / level for p in out[:i]]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_restored_readings_equal_a_walk(spark, seed):
    rng = random.Random(seed)
    rows = []
    for w in range(12):
        p = 0.0
        for i in range(40):
            p = rng.choice([p + rng.random() * 12, p, max(0.0, p - 30), 0.0]) if rng.random() < 0.3 else p + rng.random() * 4
            rows.append((f"s{w}", "b", T0, T0 + timedelta(days=9), minutes(i * 90 + 1), min(100.0, p)))
    df = spark.createDataFrame(rows, "service string, bucket string, start timestamp_ntz, end timestamp_ntz, ts timestamp_ntz, percent double")
    found = limits.restored(df).collect()
    for w in range(12):
        got = [r["percent"] for r in sorted((r for r in found if r["service"] == f"s{w}"), key=lambda r: r["ts"])]
        expected = walk_restored([(r[4], r[5]) for r in rows if r[0] == f"s{w}"])
        assert got == pytest.approx(expected, abs=1e-9)


TURN = (
    "service string, chat_id string, ts timestamp_ntz, seq long, agent_id string, model string, project string, input long, output long, cache_read long, cache_write_5m long, cache_write_1h long, "
    "cost_nd long, cost_input long, cost_cache_write long, tokens long"
)


def turn(chat, at, seq, cost=100, cold=False, agent=None, model="m"):
    return ("s", chat, minutes(at), seq, agent, model, f"p{chat}", 100, 10, 0 if cold else 50_000, 20_000 if cold else 0, 0, cost, 7, 30, 1000)


def test_stretches(spark):
    turns = spark.createDataFrame(
        [
            turn("a", 5, 1, cold=True), turn("a", 8, 2, cold=True), turn("a", 20, 3, cold=True), turn("a", 24, 4, agent="x"), turn("a", 29, 5), turn("a", 100, 6), turn("a", 101, 7, agent="x", cold=True),
            turn("b", 50, 8, agent="x"), turn("a", 400, 9),
        ], TURN,
    )
    events = spark.createDataFrame(
        [("a", minutes(4), 1, "prompt", "first"), ("a", minutes(9), 2, "prompt", "second"), ("a", minutes(60), 3, "compaction", None), ("a", minutes(65), 4, "prompt", "third"), ("b", minutes(10), 5, "prompt", "too late")],
        "chat_id string, at timestamp_ntz, seq long, kind string, text string",
    )
    windows = spark.createDataFrame([("s", "five_hour", 1, minutes(0), minutes(300))], "service string, bucket string, window_id long, start timestamp_ntz, end timestamp_ntz")
    parts = spark.createDataFrame([("s", 1, 0, "a", 12.0), ("s", 1, 1, "a", 3.0), ("s", 1, 3, "a", 4.0)], "service string, window_id long, bin int, chat_id string, points double")
    found = {(r["chat_id"], r["stretch"]): r for r in limits.stretches(windows, turns, events, parts).collect()}
    assert set(found) == {("a", 1), ("a", 2), ("a", 3), ("b", 1)}
    a1, a2, a3 = (found[("a", i)] for i in (1, 2, 3))
    assert (a1["opening"], a2["opening"], a3["opening"]) == ("first", "cold", "compaction")
    # the cold start at minute 8 lies within ten minutes of the first turn; the chat's first main turn builds, it doesn't rebuild
    assert (a1["cold_nd"], a2["cold_nd"], a3["cold_nd"]) == (37, 37, 0)
    assert (a1["prompt"], a2["prompt"], a3["prompt"]) == ("first", "second", "third")
    # bin 0: 200 of 500 to the first stretch; bin 1 has no turn and takes the split of bin 0
    assert a1["points"] == pytest.approx(6.0) and a2["points"] == pytest.approx(9.0) and a3["points"] == pytest.approx(4.0)
    assert a3["last_at"] == minutes(101) and a3["cost_nd"] == 200
    assert found[("b", 1)]["prompt"] == "too late"


def test_stretches_add_up_to_the_chat(spark):
    rng = random.Random(11)
    rows = [turn(rng.choice("abc"), rng.randrange(0, 600), i, cost=rng.randrange(0, 500), cold=rng.random() < 0.2, agent=rng.choice([None, None, "x"])) for i in range(300)]
    turns = spark.createDataFrame(rows, TURN)
    windows = spark.createDataFrame([("s", "five_hour", 1, minutes(0), minutes(300)), ("s", "five_hour", 2, minutes(300), minutes(600))], "service string, bucket string, window_id long, start timestamp_ntz, end timestamp_ntz")
    level = readings(spark, [(t, min(100, t % 300 / 3), 300) for t in range(1, 600, 7)])
    events = spark.createDataFrame([], "chat_id string, at timestamp_ntz, seq long, kind string, text string")
    page = limits.load(windows, level, turns, events)
    chats = {(r["window_id"], r["chat_id"]): (r["points"], r["cost_nd"]) for r in page["chats"].collect()}
    sums = page["stretches"].groupBy("window_id", "chat_id").agg(F.sum("points").alias("p"), F.sum("cost_nd").alias("c")).collect()
    assert {(r["window_id"], r["chat_id"]) for r in sums} == set(chats)
    for r in sums:
        assert (r["p"], r["c"]) == pytest.approx(chats[(r["window_id"], r["chat_id"])])
    for r in page["totals"].collect():
        own = sum(p for (w, _), (p, _) in chats.items() if w == r["window_id"])
        assert own + r["outside"] == pytest.approx(r["percent"])


def test_stretches_shuffle_turns_by_window_and_chat_once(spark, sf, monkeypatch):
    plans, write = [], limits.written
    monkeypatch.setattr(limits, "written", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    limit_queries.stretches(spark, sf)
    plan = next(p for p in plans if "_starts" in p)
    # windows are broadcast to the turns, which are then dealt once, beside the lists of starts and points
    assert not [x for x in plan.splitlines() if "SortMergeJoin" in x and "_cell" in x]
    assert len(re.findall(r"Exchange hashpartitioning\(chat_id#\d+, service#\d+, window_id#\d+", plan)) == 2


def test_stretches_share_a_free_bin_evenly(spark):
    turns = spark.createDataFrame([("s", "a", minutes(m), m, None, "m", "p", 100, 10, 0 if m == 12 else 50_000, 20_000 if m == 12 else 0, 0, 0, 7, 30, 0) for m in (1, 2, 3, 12, 40)], TURN)
    windows = spark.createDataFrame([("s", "five_hour", 1, minutes(0), minutes(300))], "service string, bucket string, window_id long, start timestamp_ntz, end timestamp_ntz")
    events = spark.createDataFrame([], "chat_id string, at timestamp_ntz, seq long, kind string, text string")
    parts = spark.createDataFrame([("s", 1, 0, "a", 6.0), ("s", 1, 1, "a", 1.0), ("s", 1, 2, "a", 2.0)], "service string, window_id long, bin int, chat_id string, points double")
    found = {r["stretch"]: (r["opening"], r["points"], r["cold_nd"]) for r in limits.stretches(windows, turns, events, parts).collect()}
    # bin 0 holds both, whatever their turns; bin 1 the second alone, and the rise of bin 2 lags it
    assert found == {1: ("first", 3.0, 0), 2: ("cold", 6.0, 37)}


def test_change_signal_needs_a_cheaper_point(spark):
    schema = "service string, start timestamp_ntz, end timestamp_ntz, attributed double, point_nd double, model string, model_nd long"
    week = lambda i, price, points=20.0, model="A": ("s", T0 + timedelta(days=7 * i), T0 + timedelta(days=7 * (i + 1)), points, price, model, 5)
    before = spark.createDataFrame([week(0, 100.0), week(1, 120.0), week(2, 1.0, points=3.0)], schema)
    fired = limits.change_signal(spark.createDataFrame([week(3, 55.0, model="B")], schema), before, T0).collect()
    assert [(r["percent_less"], r["usual_weeks"], r["usual_model"]) for r in fired] == [(50, 2, "A")]
    assert limits.change_signal(spark.createDataFrame([week(3, 90.0)], schema), before, T0).count() == 0
    assert limits.change_signal(spark.createDataFrame([week(3, 50.0, points=9.0)], schema), before, T0).count() == 0


def test_burn_rate_cases(spark):
    now = minutes(30)
    rate = lambda rows: [tuple(r)[2:] for r in quota.burn_rate(readings(spark, rows), now).collect()]
    assert rate([(10, 10, None), (20, 30, None)]) == [(30.0, 2.0, 2100.0, False)]
    assert rate([(10, 90, None), (15, 5, None), (25, 15, None)]) == [(15.0, 1.0, 5100.0, False)]
    assert rate([(10, 10, None)]) == [] and rate([]) == []
    assert rate([(1, 10, None), (5, 10, None)]) == [(10.0, 0.0, None, True)]
    assert rate([(20, 90, None), (29, 100, None)])[0][2] is None


def test_throttle_keeps_from_the_last_kept(spark):
    rows = [(0, 1.0, None), (20, 2.0, None), (29, 3.0, None), (31, 4.0, None), (45, 5.0, None), (62, 6.0, None)]
    df = readings(spark, rows)
    kept = quota.throttled(df, 30 * 60).orderBy("ts").collect()
    assert [r["percent"] for r in kept] == [1.0, 4.0, 6.0]


def test_published_shares_expire(spark):
    s = spark.createDataFrame([("s", "session", minutes(300), 1.0), ("s", "week", minutes(900), 2.0), ("s", "budget", None, 3.0)], "service string, field string, resets_at timestamp_ntz, denominator double")
    w = spark.createDataFrame([("s", "session", minutes(305), 1.0), ("s", "week", minutes(930), 2.0), ("s", "budget", None, 3.0)], "service string, field string, resets_at timestamp_ntz, denominator double")
    assert {r["field"] for r in limits.still_current(s, w, minutes(10)).collect()} == {"session", "budget"}
    assert {r["field"] for r in limits.still_current(s, w, minutes(301)).collect()} == {"budget"}


def test_periods():
    now = datetime(2024, 3, 15, 12)
    assert limits.period("budget", "week", now) == (now - timedelta(days=7), now)
    assert limits.period("budget", "week", now, weeks_ago=1) == (now - timedelta(days=14), now - timedelta(days=7))
    assert limits.period("spend_limit", "month", now) == (datetime(2024, 3, 1), now)
    assert limits.period("spend_limit", "month", datetime(2024, 3, 1)) is None
    a = limits.period("budget", "week", now)
    assert limits.same_period(a, (a[0] + timedelta(minutes=9), a[1])) and not limits.same_period(a, (a[0] + timedelta(minutes=11), a[1]))
