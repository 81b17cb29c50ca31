"""The canonical tables. Every source yields one of them, every operator takes them."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()
_TS = T.TimestampNTZType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


#: One model response. `seq` is the order of ingest; counters never include `thinking` twice (it is part of `output`).
TURNS = _table(
    provider=_S, msg_id=_S, seq=_L, ts=_TS, model=_S, input=_L, output=_L, cache_read=_L, cache_write_5m=_L, cache_write_1h=_L,
    thinking=_L, project=_S, chat_id=_S, agent_id=_S, agent_kind=_S, effort=_S, reported_cost=_D,
)
#: Dollars per million tokens; `source` is live or offline.
PRICES = _table(model_norm=_S, in_per_m=_D, out_per_m=_D, cache_read_per_m=_D, cw5m_per_m=_D, cw1h_per_m=_D, source=_S)
#: One percent of one limit window at one time. A null `resets_at` names no reset.
READINGS = _table(service=_S, ts=_TS, bucket=_S, percent=_D, resets_at=_TS, window_seconds=_D, kind=_S, source=_S)
#: The windows that a service lists now, in its own order (`pos`).
BUCKETS = _table(
    service=_S, bucket=_S, label=_S, percent=_D, resets_at=_TS, kind=_S, window_seconds=_D,
    credit_used=_D, credit_limit=_D, pos=_I, source=_S, as_of=_TS,
)
SERVICES = _table(service=_S, name=_S, state=_S, fetched_at=_TS, week_cost=_D, extra_enabled=_B, extra_limit=_D, extra_used=_D, extra_percent=_D)
#: `kind` is prompt, compaction or title.
CHAT_EVENTS = _table(chat_id=_S, at=_TS, seq=_L, kind=_S, text=_S)
AGENT_EVENTS = _table(
    source=_S, session_id=_S, seq=_L, kind=_S, ts=_TS, cwd=_S, tool=_S, summary=_S, attention=_S, is_subagent=_B, pid=_L, tty=_S,
)
AGENT_RUNS = _table(source=_S, id=_S, project=_S, started_at=_TS, ended_at=_TS, turns=_L, needs_you=_L)

COUNTERS = ("input", "output", "cache_read", "cache_write_5m", "cache_write_1h", "thinking")
