"""Live agent sessions from hook events, and their history.

The state machine is written as window functions: an event either sets the state outright, or sets it only while no question
is open, or leaves it. What is open follows from the last event that opened or closed a question; the state is that of the
last event that set one. So no session is walked row by row, and a hot session is cut into day slices.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.frames import running
from tallyspark.functions.moments import DAY, cell, moment, seconds

STALE_S, GHOST_S, TOMBSTONE_S, MARGIN_S = 7200, 300, 1800, 5
RECENT_S, WORKING_S = 1800, 30
ANSWERS = ("AskUserQuestion", "ExitPlanMode")
RANK = {"needsYou": 0, "working": 1, "done": 2, "idle": 3}
SESSION = ["source", "session_id"]


def timeline(events: DataFrame) -> DataFrame:
    """Every event of the main threads with the run it belongs to and the state after it.

    A run ends with sessionEnd; the next event begins another. Sub-agents' events are left out, and unknown ones before a run
    has begun. Columns added: run, state, open_attention (after the event), entered (the event brought this state).
    """
    rows = events.filter(~F.coalesce("is_subagent", F.lit(False)))
    kind, tool, slice_ = F.col("kind"), F.col("tool"), cell("ts", DAY)
    ended = F.when(kind == "sessionEnd", 1).otherwise(0)
    answered = F.coalesce((kind == "toolFinished") & tool.isin(*ANSWERS), F.lit(False))
    # a struct, so that "closed" is a value too; the end of a session closes what was open
    mark = F.when((kind == "toolStarted") & F.col("attention").isNotNull(), F.struct(F.col("attention").alias("a"))).when(
        kind.isin("promptSubmitted", "stop", "turnComplete", "sessionEnd") | answered, F.struct(F.lit(None).cast("string").alias("a"))
    )
    rows = running(rows, SESSION, ["ts", "seq"], slice_, total={"_ends": ended}, last={"_after": mark}, before={"_open": mark})
    free = F.col("_open.a").isNull()
    # the first known event of a run always sets a state, for nothing is open then
    sets = (
        F.when(kind == "sessionStart", "idle")
        .when(kind == "promptSubmitted", "working")
        .when(answered, "working")
        .when((kind == "toolStarted") & F.col("attention").isNotNull(), "needsYou")
        .when(kind.isin("toolStarted", "toolFinished") & free, "working")
        .when(kind.isin("permissionRequested", "notificationPermission"), "needsYou")
        .when((kind == "notificationIdle") & free, "idle")
        .when(kind.isin("stop", "turnComplete"), "done")
        .when(kind == "sessionEnd", "ended")
    )
    rows = running(rows.withColumn("_sets", sets), SESSION, ["ts", "seq"], slice_, last={"_state": F.col("_sets")}, before={"_was": F.col("_sets")})
    begun = F.col("_was").isNotNull() & (F.col("_was") != "ended")
    rows = rows.filter(begun | ~kind.isin("unknown", "sessionEnd"))
    return rows.select(
        *events.columns, (F.col("_ends") - ended).cast("long").alias("run"), F.col("_state").alias("state"), F.col("_after.a").alias("open_attention"),
        (~begun | (F.col("_state") != F.col("_was"))).alias("entered"),
    )


def runs(tl: DataFrame) -> DataFrame:
    """One row for each run: state, activity, counters and times. `ended_at` is null while it lives."""
    at = F.struct("ts", "seq")
    keys = [*SESSION, "run"]
    said = F.col("summary").isNotNull() & F.col("kind").isin("toolStarted", "permissionRequested", "notificationPermission", "toolFinished")
    live = F.col("kind") != "sessionEnd"
    out = tl.groupBy(*keys).agg(
        F.max_by(F.when(live, F.col("state")), F.when(live, at)).alias("state"), F.max_by("open_attention", at).alias("attention"),
        F.max(F.when(F.col("entered"), F.col("ts"))).alias("state_since"), F.min("ts").alias("started_at"), F.max(F.when(live, F.col("ts"))).alias("last_event_at"),
        F.max(F.when(~live, F.col("ts"))).alias("ended_at"), F.count_if(F.col("kind") == "promptSubmitted").alias("turns"),
        F.count_if(F.col("entered") & (F.col("state") == "needsYou")).alias("needs_you"),
        F.max_by("cwd", F.when(F.coalesce("cwd", F.lit("")) != "", at)).alias("cwd"), F.max_by("pid", F.when(F.col("pid").isNotNull() | F.col("tty").isNotNull(), at)).alias("pid"),
        F.max_by("tty", F.when(F.col("pid").isNotNull() | F.col("tty").isNotNull(), at)).alias("tty"),
        F.max(F.when(F.col("kind") == "promptSubmitted", at)).alias("_prompted"), F.max(F.when(said, F.struct("ts", "seq", "summary"))).alias("_said"),
    )
    activity = F.when(F.col("_prompted").isNull() | (F.struct("_said.ts", "_said.seq") > F.col("_prompted")), F.col("_said.summary"))
    return out.withColumn("activity", activity).drop("_prompted", "_said").filter("last_event_at is not null")


def live(run_rows: DataFrame) -> DataFrame:
    """Running sessions in the order of their list: who needs you, who works, who is done, who is idle; then the latest."""
    rank = F.coalesce(*(F.when(F.col("state") == s, F.lit(r)) for s, r in RANK.items()))
    return run_rows.filter("ended_at is null").withColumn("rank", rank)


def counts(live_rows: DataFrame) -> DataFrame:
    return live_rows.agg(F.count_if(F.col("state") == "needsYou").alias("needs_you"), F.count_if(F.col("state") == "working").alias("working"), F.count("*").alias("sessions"))


def stale(now: datetime) -> Column:
    """Quiet for two hours and its process gone or unknown, or quiet for five minutes and its terminal gone.

    Whether they live is told by columns `pid_alive` and `tty_alive`.
    """
    quiet = seconds("last_event_at", moment(now))
    return ((quiet >= STALE_S) & ~F.coalesce(F.col("pid").isNotNull() & F.col("pid_alive"), F.lit(False))) | (
        (quiet >= GHOST_S) & (F.coalesce("tty", F.lit("")) != "") & ~F.coalesce("tty_alive", F.lit(True))
    )


def pruned(live_rows: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped); dropped ones are archived as ended with their last event."""
    gone = stale(now)
    return live_rows.filter(~gone), live_rows.filter(gone).withColumn("ended_at", F.col("last_event_at"))


def archive(ended: DataFrame, now: datetime, days: int = 90) -> DataFrame:
    """Ended runs as history rows, those of the last 90 days."""
    return ended.filter(F.col("ended_at") >= moment(now - timedelta(days=days))).select(
        "source", F.concat_ws(":", "source", "session_id").alias("id"), F.col("cwd").alias("project"), "started_at", "ended_at", "turns", "needs_you"
    )


def history_summary(agent_runs: DataFrame, now: datetime, days: int) -> DataFrame:
    """One row for each source: sessions, their time, approvals, and the busiest project (the first seen of equal ones)."""
    rows = agent_runs.filter(F.col("ended_at") >= moment(now - timedelta(days=days)))
    spent = F.greatest(F.lit(0.0), seconds("started_at", "ended_at"))
    total = rows.groupBy("source").agg(F.count("*").alias("sessions"), F.sum(spent).alias("agent_seconds"), F.sum("needs_you").alias("approvals"))
    each = rows.groupBy("source", "project").agg(F.count("*").alias("n"), F.min(F.struct("ended_at", "id")).alias("_first"))
    best = each.groupBy("source").agg(F.min_by(F.struct("project", "n"), F.struct(-F.col("n"), F.col("_first"))).alias("_b"))
    return total.join(best, "source").select("source", "sessions", "agent_seconds", "approvals", F.col("_b.project").alias("busiest_project"), F.col("_b.n").alias("busiest_sessions"))


def scanned(files: DataFrame, now: datetime) -> DataFrame:
    """Sessions from recently written logs (source, session_id, modified_at): working if written within 30 s, else idle."""
    quiet = seconds("modified_at", moment(now))
    return files.filter(quiet <= RECENT_S).select(*SESSION, F.when(quiet <= WORKING_S, "working").otherwise("idle").alias("state"), F.col("modified_at").alias("last_event_at"))


def merged(live_rows: DataFrame, scan: DataFrame, ended: DataFrame, now: datetime) -> DataFrame:
    """Live sessions beside what a scan of the logs saw.

    Columns of `live_rows`: source, session_id, state, state_since, last_event_at, approximate, from_scan, before_scan. A session
    known by hooks is only promoted: done or idle to working, if the scan saw it write five seconds or more after its state
    began (rollout logs only); when the scan goes quiet it returns to its earlier state. One known by scans alone follows the
    scan and goes with it. A session ended within 30 minutes isn't brought back.
    """
    s = scan.select(*SESSION, F.col("state").alias("_s"), F.col("last_event_at").alias("_at"), F.lit(True).alias("_seen"))
    gone = ended.filter(seconds("ended_at", moment(now)) < TOMBSTONE_S).select(*SESSION, F.lit(True).alias("_gone")).distinct()
    rows = live_rows.withColumn("_known", F.lit(True)).join(s, SESSION, "full").join(gone, SESSION, "left")
    known, seen = F.coalesce("_known", F.lit(False)), F.coalesce("_seen", F.lit(False))
    approximate = F.coalesce("approximate", F.lit(True))
    rows = rows.filter((known & (~approximate | seen)) | (~known & F.col("_gone").isNull()))
    works = F.coalesce(F.col("_s") == "working", F.lit(False))
    settle = known & ~approximate & F.coalesce("from_scan", F.lit(False)) & (F.col("state") == "working") & ~works
    base = F.when(settle, F.coalesce("before_scan", F.lit("idle"))).otherwise(F.col("state"))
    since = F.when(settle, F.coalesce("_at", moment(now))).otherwise(F.col("state_since"))
    promote = known & ~approximate & (F.col("source") == "rollout") & works & base.isin("done", "idle") & (seconds(since, "_at") > MARGIN_S)
    follow = approximate
    return rows.select(
        *SESSION,
        F.when(follow, F.col("_s")).when(promote, "working").otherwise(base).alias("state"),
        F.when(follow & (F.col("_s") == F.col("state")), F.col("state_since")).when(follow, F.col("_at")).when(promote, moment(now)).otherwise(since).alias("state_since"),
        F.when(follow, F.col("_at")).when(promote, F.greatest("last_event_at", "_at")).otherwise(F.col("last_event_at")).alias("last_event_at"),
        approximate.alias("approximate"),
        F.when(promote, True).when(settle, False).otherwise(F.coalesce("from_scan", F.lit(False))).alias("from_scan"),
        F.when(promote, base).when(~settle, F.col("before_scan")).alias("before_scan"),
    )
