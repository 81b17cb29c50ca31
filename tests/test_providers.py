"""Providers by name: what they give, and one engine over several."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from tallyspark.engine import Engine
from tallyspark.schema import CHAT_EVENTS, TURNS
from tallyspark.sources import providers

NOW = datetime(2024, 1, 2, 12)


@pytest.fixture
def roots(tmp_path):
    def put(name, *lines):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(json.dumps(x) + "\n" for x in lines))

    usage = lambda n, out: {"input_tokens": n, "output_tokens": out}
    put("assistant/app/a.jsonl", {"type": "assistant", "timestamp": "2024-01-02T03:00:00Z", "sessionId": "c1", "message": {"id": "m1", "model": "claude-opus-5", "usage": usage(10, 5)}}, {"type": "ai-title", "sessionId": "c1", "aiTitle": "Name"})
    put("rollout/rollout-00000001-0000-0000-0000-000000000000.jsonl", {"timestamp": "2024-01-02T04:00:00Z", "type": "turn_context", "payload": {"model": "gpt-5"}}, {"timestamp": "2024-01-02T04:00:00Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"total_token_usage": usage(20, 6)}}})
    put("tick/w/t.jsonl", {"timestamp": 1704168000.0, "params": {"sessionId": "s", "update": {"sessionUpdate": "turn_completed", "usage": {"inputTokens": 30, "outputTokens": 7, "modelUsage": {"grok-4": {"inputTokens": 30, "outputTokens": 7, "costUsdTicks": 2e9}}}}, "_meta": {"eventId": "m1"}}})
    return {n: [str(tmp_path / n)] for n in ("assistant", "rollout", "tick")}


def test_each_gives_the_canonical_tables(spark, roots):
    for name, own in roots.items():
        found = providers.read(spark, name, own, NOW)
        assert [(f.name, f.dataType) for f in found.records.schema] == [(f.name, f.dataType) for f in TURNS]
        assert [(f.name, f.dataType) for f in found.events.schema] == [(f.name, f.dataType) for f in CHAT_EVENTS]
        assert [r.output for r in found.records.collect()] == [{"assistant": 5, "rollout": 6, "tick": 7}[name]]


def test_one_engine_over_named_providers(spark, roots):
    engine = Engine.of(spark, roots, NOW)
    found = {r.provider: (r.msg_id, r.output) for r in engine.turns().collect()}
    assert set(found) == set(roots) and found["assistant"] == ("assistant:m1", 5)
    assert engine.usage(datetime(2024, 1, 1), NOW).filter("part = 'all'").first()["turns"] == 3
    assert [r.title for r in engine.turn_costs(datetime(2024, 1, 1), NOW).filter("provider = 'assistant'").collect()] == ["Name"]
    one = Engine.of(spark, {"rollout": roots["rollout"]}, NOW)
    assert [r.provider for r in one.turns().collect()] == ["rollout"]


def test_names(spark):
    assert {"assistant", "rollout", "tick", "ledger"} <= set(providers.names())
    with pytest.raises(KeyError):
        providers.read(spark, "nobody", [])
    with pytest.raises(ValueError):
        providers.provider("tick")(lambda *a: None)


def test_a_provider_of_ones_own(spark, monkeypatch):
    monkeypatch.setattr(providers, "_PROVIDERS", dict(providers._PROVIDERS))

    @providers.provider("own")
    def own(spark, roots, now):
        row = ("x", "1", 1, NOW, "m", 1, 2, 0, 0, 0, 0, roots[0], "c", None, None, None, None)
        return providers.Tables(spark.createDataFrame([row], TURNS), spark.createDataFrame([], CHAT_EVENTS))

    assert [(r.provider, r.project) for r in Engine.of(spark, {"own": ["p"]}).turns().collect()] == [("own", "p")]
