"""Live sessions from hook events and from scans of the logs, as a stream with timers: the twin of `operators.agents.merged`.

A session is known by hooks, or by scans alone. Scans never rewrite what a hook said, with one exception: a rollout log
written five seconds or more after its session became done or idle lifts it to working; once the log has been quiet for 30 s
the session returns to what it was. A session known by scans alone follows them and goes half an hour after the last write. A
session that ended isn't brought back by a scan for half an hour. A session known by hooks of which nothing is heard for two
hours goes too, for a stream sees no processes.

What happens without an event happens by event-time timers, so it follows the watermark and not the clock: a replay gives
the same rows. Every session's state ends with a timer, so state is bounded by the sessions of the last two hours. Needs the
RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyspark.operators.agents import MARGIN_S, RECENT_S, STALE_S, TOMBSTONE_S, WORKING_S
from tallyspark.streaming.sessions import after

#: A row for each change: `state` is that of the session, or ended (by its hook), or gone.
OUT = "source string, session_id string, at timestamp, state string, approximate boolean, from_scan boolean"
_SESSION = "state string, since long, last long, approximate boolean, from_scan boolean, before string, is_open boolean, begun boolean, written long"
_S = 1000  # times are milliseconds


def _ms(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)


class Passive(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", _SESSION)
        self.ended = handle.getValueState("ended", "at long")

    def close(self) -> None:
        pass

    def _get(self) -> dict | None:
        names = [c.split()[0] for c in _SESSION.split(", ")]
        return dict(zip(names, self.session.get(), strict=True)) if self.session.exists() else None

    def _put(self, s: dict | None, at: int | None = None) -> None:
        """Keep the session, and come back when it may change by itself."""
        if s is None:
            self.session.clear()
            return
        self.session.update(tuple(s.values()))
        if s["approximate"] or s["from_scan"]:
            self.handle.registerTimer(s["written"] + WORKING_S * _S + 1)
        self.handle.registerTimer((s["written"] + RECENT_S * _S if s["approximate"] else s["last"] + STALE_S * _S) + 1)

    def _hook(self, s: dict | None, r, t: int) -> dict | None:
        if r.is_subagent or (r.kind in ("unknown", "sessionEnd") and (s is None or s["approximate"])):
            return s
        if r.kind == "sessionEnd":
            self.ended.update((t,))
            self.handle.registerTimer(t + TOMBSTONE_S * _S)
            return None
        own = s if s and not s["approximate"] else None
        was = own["state"] if own else "idle"
        state, is_open, begun = after(was, bool(own and own["is_open"]), bool(own and own["begun"]), r.kind, r.tool, isinstance(r.attention, str))
        self.ended.clear()
        return {"state": state, "since": own["since"] if own and state == was else t, "last": t, "approximate": False, "from_scan": False, "before": None, "is_open": is_open, "begun": begun, "written": own["written"] if own else 0}

    def _scan(self, s: dict | None, source: str, t: int, written: int) -> dict | None:
        if t - written > RECENT_S * _S:
            return s
        state = "working" if t - written <= WORKING_S * _S else "idle"
        if s is None:
            if self.ended.exists() and t - self.ended.get()[0] < TOMBSTONE_S * _S:
                return None
            return {"state": state, "since": written, "last": written, "approximate": True, "from_scan": False, "before": None, "is_open": False, "begun": False, "written": written}
        if s["approximate"]:
            return s | {"state": state, "since": s["since"] if state == s["state"] else written, "last": written, "written": written}
        s = s | {"written": written}
        if s["from_scan"] and s["state"] == "working" and state != "working":
            s = self._settled(s)
        if source == "rollout" and state == "working" and s["state"] in ("done", "idle") and written - s["since"] > MARGIN_S * _S:
            s = s | {"before": s["state"], "state": "working", "since": t, "last": max(s["last"], written), "from_scan": True}
        return s

    @staticmethod
    def _settled(s: dict) -> dict:
        return s | {"state": s["before"] or "idle", "since": s["written"], "from_scan": False, "before": None}

    @staticmethod
    def _row(key: tuple, s: dict | None, t: int, gone: str) -> tuple:
        return (*key, pd.Timestamp(t, unit="ms"), s["state"] if s else gone, bool(s and s["approximate"]), bool(s and s["from_scan"]))

    @staticmethod
    def _shown(s: dict | None) -> tuple | None:
        return s and (s["state"], s["approximate"], s["from_scan"])

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._get(), []
        for r in pd.concat(list(rows)).sort_values(["ts", "seq"]).itertuples(index=False):
            t, before = _ms(r.ts), self._shown(s)
            s = self._scan(s, key[0], t, _ms(r.modified_at)) if r.what == "scan" else self._hook(s, r, t)
            if self._shown(s) != before:
                out.append(self._row(key, s, t, "ended"))
        self._put(s)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t, s, out = expiredTimerInfo.getExpiryTimeInMs(), self._get(), []
        if self.ended.exists() and t - self.ended.get()[0] >= TOMBSTONE_S * _S:
            self.ended.clear()
        if s is not None:
            before, quiet = self._shown(s), t - s["written"]
            if s["approximate"]:
                s = None if quiet > RECENT_S * _S else s | {"state": "idle", "since": s["written"]} if quiet > WORKING_S * _S and s["state"] != "idle" else s
            else:
                if s["from_scan"] and quiet > WORKING_S * _S:
                    s = self._settled(s)
                if t - s["last"] > STALE_S * _S:
                    s = None
            if self._shown(s) != before:
                out.append(self._row(key, s, t, "gone"))
                self.session.update(tuple(s.values())) if s else self.session.clear()
        yield self._frame(out)


def sessions(rows: DataFrame, late: str = "1 minute") -> DataFrame:
    """Changes of sessions. Rows of the stream: source, session_id, ts (of the event or the scan), seq, what (hook or scan), kind,
    tool, attention, is_subagent (of hooks), modified_at (of scans: when the log was last written)."""
    keyed = rows.withWatermark("ts", late).groupBy("source", "session_id")
    return keyed.transformWithStateInPandas(statefulProcessor=Passive(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
