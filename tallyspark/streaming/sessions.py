"""Live sessions as a stream: one state for each session, kept by the stream itself."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyspark.operators.agents import ANSWERS

OUT = "source string, session_id string, seq long, ts timestamp, state string, entered boolean"
STATE = "state string, open boolean, begun boolean"


def after(state: str, is_open: bool, begun: bool, kind: str, tool: str | None, asks: bool) -> tuple[str, bool, bool]:
    """State, open question and whether a run has begun, after one event."""
    if kind == "sessionEnd":
        return "ended", False, False
    if kind == "unknown":
        return state, is_open, begun
    if not begun:
        state, is_open = "idle", False
    if kind == "promptSubmitted":
        return "working", False, True
    if kind == "toolFinished" and tool in ANSWERS:
        return "working", False, True
    if kind == "toolStarted" and asks:
        return "needsYou", True, True
    if kind in ("toolStarted", "toolFinished"):
        return (state if is_open else "working"), is_open, True
    if kind in ("permissionRequested", "notificationPermission"):
        return "needsYou", is_open, True
    if kind == "notificationIdle":
        return (state if is_open else "idle"), is_open, True
    if kind in ("stop", "turnComplete"):
        return "done", False, True
    return "idle", is_open, True  # sessionStart


def _walk(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
    state, is_open, begun = held.get if held.exists else ("idle", False, False)
    rows = pd.concat(list(parts)).sort_values(["ts", "seq"])  # one session's events of one micro-batch
    out = []
    for r in rows.itertuples(index=False):
        if r.is_subagent or (not begun and r.kind in ("unknown", "sessionEnd")):
            continue
        was = state if begun else None
        state, is_open, begun = after(state, is_open, begun, r.kind, r.tool, isinstance(r.attention, str))
        out.append((*key, r.seq, r.ts, state, state != was))
    if begun:
        held.update((state, is_open, begun))
    elif held.exists:
        held.remove()  # a session that has ended, or not begun, is as a new one
    yield pd.DataFrame(out, columns=["source", "session_id", "seq", "ts", "state", "entered"])


def timeline(events: DataFrame) -> DataFrame:
    """The stream's twin of `operators.agents.timeline`: the state after each event, in order within each micro-batch."""
    return events.groupBy("source", "session_id").applyInPandasWithState(_walk, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
