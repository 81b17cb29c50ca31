"""Readers over small files, and cases that hang on order or on half-written input."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import functions as F

from tallyspark.operators.dedup import later_readings, without_synthetic
from tallyspark.sources import logs, payloads, rollouts, stores, ticks


def assistant(mid, output, ts="2024-01-02T03:04:05.678Z", **more):
    message = {"id": mid, "model": more.pop("model", "claude-opus-5"), "usage": {"input_tokens": 10, "output_tokens": output, **more.pop("usage", {})}}
    return json.dumps({"type": "assistant", "timestamp": ts, "sessionId": "c1", "message": message, **more})


def test_assistant_logs_from_files(spark, tmp_path):
    folder = tmp_path / "-home-user-app"
    folder.mkdir()
    lines = [
        assistant("m1", 5), assistant("m1", 50), assistant("m1", 20), assistant(None, 7), assistant(None, 7), assistant("m2", 3, ts="2024-01-02T03:04:05Z", usage={"cache_creation_input_tokens": 9}),
        assistant("m3", 3, usage={"cache_creation_input_tokens": 9, "cache_creation": {"ephemeral_1h_input_tokens": 4}}), assistant("m4", 1, ts="yesterday"), assistant("m5", 1, model="<synthetic>"),
        json.dumps({"type": "user", "timestamp": "2024-01-02T03:00:00Z", "sessionId": "c1", "origin": {"kind": "human"}, "message": {"content": [{"type": "text", "text": "hello"}, {"type": "image"}, {"type": "text", "text": "there"}]}}),
        json.dumps({"type": "user", "timestamp": "2024-01-02T03:00:00Z", "sessionId": "c1", "origin": {"kind": "human"}, "isSidechain": True, "message": {"content": "no"}}),
        json.dumps({"type": "ai-title", "sessionId": "c1", "aiTitle": "A  name"}), json.dumps({"type": "system", "subtype": "compact_boundary", "sessionId": "c1", "timestamp": "2024-01-02T04:00:00Z"}), '{"type":"assistant","timest',
    ]
    (folder / "a.jsonl").write_text("\n".join(lines))
    (folder / "notes.txt").write_text("{}")
    records, events = logs.read(spark, str(tmp_path), datetime(2030, 1, 1).replace(year=2024))
    found = {r["msg_id"]: r for r in without_synthetic(later_readings(records)).collect()}
    assert len(found) == 4 and found["m1"]["output"] == 50
    assert found["m2"]["cache_write_5m"] == 9 and (found["m3"]["cache_write_5m"], found["m3"]["cache_write_1h"]) == (0, 4)
    assert {r["project"] for r in found.values()} == {"-home-user-app"}
    assert found["m1"]["ts"] == datetime(2024, 1, 2, 3, 4, 5, 678_000)
    assert sorted((r["kind"], r["text"]) for r in events.collect() if r["text"]) == [("prompt", "hello there"), ("title", "A name")]
    assert events.filter("kind = 'compaction'").count() == 1


def rollout(spark, files):
    rows = [(f"/x/rollout-{i:08d}-0000-0000-0000-000000000000.jsonl", n, json.dumps(line)) for i, lines in files.items() for n, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, line long, value string")


def count(n, out, cached=0):
    return {"timestamp": "2024-01-01T00:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": cached, "output_tokens": out}}}}


def context(model, turn="t1", **more):
    return {"timestamp": "2024-01-01T00:00:00Z", "type": "turn_context", "payload": {"turn_id": turn, "model": model, **more}}


def record(response, n, out, turn=None):
    return {"timestamp": "2024-01-01T00:00:01Z", "type": "token_usage_record", "payload": {"thread_id": "th", "response_id": response, "turn_id": turn, "usage": {"input_tokens": n, "output_tokens": out, "cached_input_tokens": 4}}}


def test_rollout_counters_and_records(spark):
    meta = {"type": "session_meta", "payload": {"session_id": "parent", "id": "kid", "cwd": "/w/a b", "thread_source": "subagent", "agent_nickname": "scout"}}
    files = {
        1: [count(100, 10, 30), count(150, 20, 30), context("m1"), count(150, 20, 30), count(200, 30, 40), count(20, 5)],
        2: [meta, context("m1", "t1"), context("m2", "t2", effort="high"), count(10, 1), record("r1", 14, 2, "t1"), record("r1", 99, 9, "t1"), record("r2", 14, 3), count(500, 100)],
        3: [{"type": "compacted", "payload": {"latest_token_usage_record": {"usage": {"input_tokens": 5}}}}],
    }
    found = sorted((tuple(r) for r in rollouts.turns(rollout(spark, files)).select("chat_id", "seq", "model", "input", "output", "cache_read", "agent_id", "agent_kind", "effort", "project").collect()), key=str)
    one = [r[1:6] for r in found if "00000001" in r[0]]
    # both readings before the model belong to it; the repeat adds nothing; the last one restarted
    assert sorted(one) == [(2, "m1", 120, 20, 30), (4, "m1", 40, 10, 10), (5, "m1", 20, 5, 0)]
    two = sorted(r[1:] for r in found if r[0] == "parent")
    assert [r[:5] for r in two] == [(3, "m2", 10, 1, 0), (4, "m1", 10, 2, 4), (6, "m2", 10, 3, 4)]
    assert {r[5:7] for r in two} == {("kid", "scout")} and two[2][7] == "high" and two[0][8] == "%2Fw%2Fa%20b"
    assert len(found) == 6


def test_a_moved_rollout_file_counts_once(spark):
    lines = [context("m"), count(10, 1)]
    here = rollout(spark, {1: lines + [count(20, 2)]})
    moved = rollout(spark, {1: lines}).withColumn("file", F.regexp_replace("file", "/x/", "/archive/"))
    assert rollouts.turns(here.unionByName(moved)).agg(F.sum("output")).first()[0] == 2


def test_rollout_ids_stay_when_files_are_added_split_or_moved(spark, tmp_path):
    from tallyspark.sources import scan

    name = lambda i: f"rollout-{i:08d}-0000-0000-0000-000000000000.jsonl"
    put = lambda folder, i, lines: ((tmp_path / folder).mkdir(exist_ok=True), (tmp_path / folder / name(i)).write_text("".join(json.dumps(x) + "\n" for x in lines)))
    roots = [str(tmp_path / "live"), str(tmp_path / "archive")]
    ids = lambda: {(r.msg_id, r.model, r.output) for r in rollouts.read(spark, roots)[0].collect()}
    one, two = [context("m"), count(10, 1), count(20, 3)], [context("n"), record("r1", 30, 4), record("r2", 40, 5)]
    put("live", 7, one)
    put("live", 8, two)
    before = ids()
    assert len(before) == 4
    put("live", 1, [context("first by name"), count(50, 6)])
    put("live", 7, [*one, count(30, 7)])
    after = ids()
    assert before < after and len(after) == 6
    put("archive", 7, [*one, count(30, 7)])
    (tmp_path / "live" / name(7)).unlink()
    assert ids() == after
    lines = lambda size: scan.lines(spark, roots[0], range_=size)
    assert {r.msg_id for r in rollouts.turns(lines(50), 64).collect()} == {r.msg_id for r in rollouts.turns(lines(1 << 20), 1 << 20).collect()}


def test_rollout_prompts_and_compactions(spark):
    item = lambda text, **more: {"timestamp": "2024-01-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": text}], **more}}
    lines = [{"type": "session_meta", "payload": {"session_id": "s"}}, item("<context>"), item("# rules"), item("do it"), item("<kept>", kind="user.text"), {"timestamp": "2024-01-01T00:10:00Z", "type": "compacted", "payload": {}}]
    found = [(r["kind"], r["text"]) for r in rollouts.chat_events(rollout(spark, {1: lines})).orderBy("seq").collect()]
    assert found == [("prompt", "do it"), ("prompt", "<kept>"), ("compaction", None)]


def test_tick_lines_that_only_mention_the_marker(spark):
    line = lambda kind, eid, **usage: json.dumps({"timestamp": 1.7e9, "params": {"sessionId": "s", "update": {"sessionUpdate": kind, "note": "turn_completed", "usage": usage}, "_meta": {"eventId": eid}}})
    rows = [line("recap", "e0", totalTokens=9), line("turn_completed", "e1", totalTokens=9, costUsdTicks=5e9, modelUsage={}), line("turn_completed", "e1", totalTokens=99), "turn_completed noise"]
    df = spark.createDataFrame([(r, "p", i) for i, r in enumerate(rows)], "value string, project string, seq long")
    found = ticks.rows_of(df).collect()
    assert [(r["turn_id"], r["model"], r["turn_cost_nd"], r["row_tokens"]) for r in found] == [("e1", "unknown", 500_000_000, 9)]


def test_store_folders(spark, tmp_path):
    def put(name, value):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(value)

    point = lambda at, i, o: {"tokenUsage": {"inputTokens": i, "outputTokens": o}, "updatedAt": at}
    delta = lambda *points: json.dumps({"type": "projection_delta", "payload": {"delta": [{"op": "set_envelope", "state": {"session": p}} for p in points]}})
    put("a/CURRENT", json.dumps({"store_format": "v1"}))
    put("a/meta.json", json.dumps({"title": "T", "config": {"active_model": "big"}}))
    put("a/generations/0001/projection-state.json", json.dumps({"snapshot": {"session": point(2000, 100, 10)}}))
    put("a/journal/0001.jsonl", delta(point(1000, 50, 5), point(3000, 100, 10)) + "\n" + delta(point(4000, 20, 2), point(5000, 160, 8), {"updatedAt": 6000}) + "\nnoise set_envelope")
    put("b/CURRENT", json.dumps({"store_format": "v2"}))
    put("b/journal/0001.jsonl", delta(point(1000, 7, 7)))
    files = stores.known(stores.read(spark, str(tmp_path)), "v1")
    steps = [(r["input"], r["output"]) for r in stores.steps(stores.points(files)).orderBy("at").collect()]
    assert steps == [(50, 5), (50, 5), (60, 0)]
    assert stores.meta(files).first()["title"] == "T"
    rows = stores.turns(stores.steps(stores.points(files)), stores.meta(files))
    assert {(r["provider"], r["model"]) for r in rows.collect()} == {("ledger", "big")}


def test_near_bound_counters_do_not_overflow(spark):
    big = (1 << 63) - 1
    pts = spark.createDataFrame([("a", 1.0, big, 0, 5), ("a", 2.0, big, 0, 9)], "session string, at_ms double, input long, cached long, output long")
    assert [(r["input"], r["output"]) for r in stores.steps(pts).collect()] == [(big, 5)]
    tidy = stores.tidied(stores.steps(pts).unionByName(stores.steps(pts)), datetime(1970, 3, 1))
    assert [(r["input"], r["turns"], r["folded"]) for r in tidy.collect()] == [(big, 2, True)]


def test_hook_errors(spark):
    ok = {"v": 1, "source": "assistant", "payload": {"hook_event_name": "Stop", "session_id": "s"}}
    lines = ["x" * 70_000, "no", "[]", json.dumps({**ok, "v": None}), json.dumps({**ok, "v": 9}), json.dumps({**ok, "source": "who"}), json.dumps({**ok, "payload": {"session_id": "s"}}), json.dumps({**ok, "payload": {"hook_event_name": "Stop"}}), json.dumps(ok), json.dumps({"v": 1, "source": "rollout", "payload": {"type": "agent-turn-complete", "thread-id": "t"}})]
    found = [(r["error"], r["kind"]) for r in payloads.hook_events(spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, seq int")).orderBy("seq").collect()]
    assert [e for e, _ in found] == ["too_large", "not_json", "not_json", "missing:v", "version", "missing:source", "missing:hook_event_name", "missing:session_id", None, None]
    assert found[-2][1] == "stop" and found[-1][1] == "turnComplete"


def test_history_names_no_reset_in_the_far_year(spark):
    rows = [json.dumps({"timestamp": "2024-01-01T00:00:00Z", "bucketPercents": {"five_hour": 3}, "bucketWindows": {"five_hour": {"resetsAt": "4001-01-01T00:00:00Z"}}, "sevenDayPercent": 9}), "{oops"]
    df = spark.createDataFrame([(r,) for r in rows], "value string")
    found = {r["bucket"]: r for r in payloads.history(df).collect()}
    assert found["five_hour"]["resets_at"] is None and found["seven_day"]["percent"] == 9.0 and found["five_hour"]["service"] == "assistant"
    assert tuple(payloads.corrupt(df).first()) == (1, 2)


def test_empty_inputs(spark):
    lines = spark.createDataFrame([], "value string, seq long, project string, file string, line long")
    assert logs.turns(logs.parsed(lines)).count() == 0 and logs.chat_events(logs.parsed(lines)).count() == 0
    assert rollouts.turns(lines).count() == 0 and ticks.rows_of(lines).count() == 0 and payloads.hook_events(lines).count() == 0
