"""Agent sessions and alerts over the events seen as hooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import agents, alerts
from tallyspark.plans import binding as b
from tallyspark.plans.binding import flat
from tallyspark.plans.catalog import query

_P = "PARTITION BY source, session_id ORDER BY ts, seq"
MACHINE = f"""WITH {b.AGENT_EVENTS_CTE},
m AS (SELECT *, CASE WHEN kind = 'toolStarted' AND attention IS NOT NULL THEN 'open' WHEN kind IN ('promptSubmitted', 'stop', 'sessionEnd') OR kind = 'toolFinished' AND tool IN ('AskUserQuestion', 'ExitPlanMode') THEN 'shut' END AS mark FROM agent_events),
o AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'shut') AS was_open, count(*) FILTER (kind = 'sessionEnd') OVER ({_P} ROWS UNBOUNDED PRECEDING) - CASE WHEN kind = 'sessionEnd' THEN 1 ELSE 0 END AS run FROM m),
s AS (SELECT *, CASE WHEN kind = 'sessionStart' THEN 'idle' WHEN kind = 'promptSubmitted' THEN 'working' WHEN kind = 'toolFinished' AND tool IN ('AskUserQuestion', 'ExitPlanMode') THEN 'working' WHEN kind = 'toolStarted' AND attention IS NOT NULL THEN 'needsYou'
  WHEN kind IN ('toolStarted', 'toolFinished') AND was_open = 'shut' THEN 'working' WHEN kind = 'permissionRequested' THEN 'needsYou' WHEN kind = 'notificationIdle' AND was_open = 'shut' THEN 'idle' WHEN kind = 'stop' THEN 'done' WHEN kind = 'sessionEnd' THEN 'ended' END AS sets FROM o),
t AS (SELECT *, last_value(sets IGNORE NULLS) OVER ({_P} ROWS UNBOUNDED PRECEDING) AS state, last_value(sets IGNORE NULLS) OVER ({_P} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM s),
timeline AS (SELECT *, was IS NULL OR was = 'ended' OR state <> was AS entered FROM t WHERE (was IS NOT NULL AND was <> 'ended') OR kind NOT IN ('unknown', 'sessionEnd')),
runs AS (SELECT source, session_id, run, arg_max(state, (ts, seq)) FILTER (kind <> 'sessionEnd') AS state, min(ts) AS started_at, max(ts) FILTER (kind <> 'sessionEnd') AS last_event_at, max(ts) FILTER (kind = 'sessionEnd') AS ended_at, max(ts) FILTER (entered) AS state_since,
  count(*) FILTER (kind = 'promptSubmitted') AS turns, count(*) FILTER (entered AND state = 'needsYou') AS needs_you, any_value(cwd) AS cwd FROM timeline GROUP BY 1, 2, 3 HAVING max(ts) FILTER (kind <> 'sessionEnd') IS NOT NULL)
"""


@query(f"{MACHINE} SELECT seq, state, entered, run FROM timeline")
def agent_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-2, STM-3: every event's state after it."""
    return agents.timeline(b.agent_events(spark, sf_dir)).select("seq", "state", "entered", "run")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agents.runs(agents.timeline(b.agent_events(spark, sf_dir)))


@query(f"{MACHINE} SELECT source, session_id, run, state, epoch_us(started_at) AS started_at, epoch_us(last_event_at) AS last_event_at, coalesce(epoch_us(ended_at), -1) AS ended_at, epoch_us(state_since) AS state_since, turns, needs_you FROM runs")
def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-2: one row for each run."""
    rows = flat(_runs(spark, sf_dir).select("source", "session_id", "run", "state", "started_at", "last_event_at", "ended_at", "state_since", "turns", "needs_you"))
    return rows.withColumn("ended_at", F.coalesce("ended_at", F.lit(-1)))


@query(f"{MACHINE} SELECT source, session_id, state, CASE state WHEN 'needsYou' THEN 0 WHEN 'working' THEN 1 WHEN 'done' THEN 2 ELSE 3 END AS rank FROM runs WHERE ended_at IS NULL")
def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-13: running sessions and their place by state."""
    return agents.live(_runs(spark, sf_dir)).select("source", "session_id", "state", "rank")


@query(f"{MACHINE} SELECT count(*) FILTER (state = 'needsYou') AS needs_you, count(*) FILTER (state = 'working') AS working, count(*) AS sessions FROM runs WHERE ended_at IS NULL")
def agent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-27."""
    return agents.counts(agents.live(_runs(spark, sf_dir)))


@query(f"""{MACHINE}, l AS (SELECT *, CAST(substr(session_id, 2) AS INTEGER) AS u, (SELECT max(ts) FROM events) AS now FROM runs WHERE ended_at IS NULL), q AS (SELECT *, (epoch_us(now) - epoch_us(last_event_at)) / 1e6 AS quiet FROM l)
SELECT source, session_id, (quiet >= 7200 AND NOT (u % 3 = 0 AND u % 2 = 0)) OR (quiet >= 300 AND u % 5 = 0) AS gone FROM q""")
def stale_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-4: liveness comes with the row."""
    u = F.substring("session_id", 2, 9).cast("int")
    rows = agents.live(_runs(spark, sf_dir)).withColumns({"pid": F.when(u % 3 == 0, 1), "pid_alive": u % 2 == 0, "tty": F.when(u % 5 == 0, "t"), "tty_alive": F.lit(False)})
    kept, dropped = agents.pruned(rows, b.now(spark, sf_dir))
    return kept.select("source", "session_id", F.lit(False).alias("gone")).unionByName(dropped.select("source", "session_id", F.lit(True).alias("gone")))


@query(f"""{MACHINE}, a AS (SELECT source, source || ':' || session_id AS id, cwd AS project, started_at, ended_at, turns, needs_you FROM runs, (SELECT max(ts) AS now FROM events) WHERE ended_at >= now - INTERVAL 10 DAY),
p AS (SELECT source, project, count(*) AS n, min((ended_at, id)) AS f FROM a GROUP BY 1, 2), best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, f) = 1)
SELECT a.source, count(*) AS sessions, sum(greatest(0, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6)) AS agent_seconds, CAST(sum(needs_you) AS BIGINT) AS approvals, any_value(best.project) AS busiest_project, any_value(best.n) AS busiest_sessions FROM a JOIN best ON best.source = a.source GROUP BY 1""")
def agent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-26, SNK-6: ended sessions of the last ten days."""
    at = b.now(spark, sf_dir)
    ended = _runs(spark, sf_dir).filter("ended_at is not null")
    out = agents.history_summary(agents.archive(ended, at), at, 10)
    return out


@query("""WITH f AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'assistant' ELSE 'rollout' END AS source, 'u' || user_id AS session_id, max(ts) AS m FROM events GROUP BY 1, 2), n AS (SELECT max(ts) AS now FROM events)
SELECT source, session_id, CASE WHEN (epoch_us(now) - epoch_us(m)) / 1e6 <= 30 THEN 'working' ELSE 'idle' END AS state FROM f, n WHERE (epoch_us(now) - epoch_us(m)) / 1e6 <= 1800""")
def scanned_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-24."""
    files = b.agent_events(spark, sf_dir).groupBy("source", "session_id").agg(F.max("ts").alias("modified_at"))
    return agents.scanned(files, b.now(spark, sf_dir)).select("source", "session_id", "state")


@query()
def merged_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-5, STM-17, JON-12: live sessions beside a scan; tested case by case."""
    at = b.now(spark, sf_dir)
    runs = _runs(spark, sf_dir)
    live = agents.live(runs).select("source", "session_id", "state", "state_since", "last_event_at", (F.crc32(F.col("session_id").cast("binary")) % 3 == 0).alias("approximate"), F.lit(False).alias("from_scan"), F.lit(None).cast("string").alias("before_scan"))
    files = b.agent_events(spark, sf_dir).groupBy("source", "session_id").agg(F.max("ts").alias("modified_at"))
    scan = agents.scanned(files, at)
    ended = runs.filter("ended_at is not null").groupBy("source", "session_id").agg(F.max("ended_at").alias("ended_at"))
    return flat(agents.merged(live, scan, ended, at).select("source", "session_id", "state", "approximate", "from_scan"))


@query(f"""WITH RECURSIVE {b.READINGS_CTE}, r AS (SELECT service, bucket, ts, CAST(round(percent) AS INTEGER) AS p, row_number() OVER (PARTITION BY service, bucket ORDER BY ts, percent) AS k FROM readings),
w AS (SELECT service, bucket, ts, p, k, CASE WHEN p >= 95 THEN 95 WHEN p >= 80 THEN 80 ELSE 0 END AS level, CASE WHEN p >= 80 THEN 'fire' ELSE 'unchanged' END AS outcome FROM r WHERE k = 1
UNION ALL SELECT r.service, r.bucket, r.ts, r.p, r.k, CASE WHEN n.l > w.level OR (w.level > 0 AND r.p < w.level - 3) THEN n.l ELSE w.level END, CASE WHEN n.l > w.level THEN 'fire' WHEN w.level > 0 AND r.p < w.level - 3 THEN 'rearm' ELSE 'unchanged' END
  FROM w JOIN r ON r.service = w.service AND r.bucket = w.bucket AND r.k = w.k + 1, LATERAL (SELECT CASE WHEN r.p >= 95 THEN 95 WHEN r.p >= 80 THEN 80 ELSE 0 END AS l) n)
SELECT service, bucket, epoch_us(ts) AS ts, p AS percent, level, outcome FROM w WHERE outcome <> 'unchanged'""")
def threshold_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-6: alerts that fire and re-arm."""
    return flat(alerts.thresholds(b.readings(spark, sf_dir)))


@query(f"""WITH {b.READINGS_CTE}, c AS (SELECT service || ':' || bucket AS key, resets_at AS win, min(ts) AS ts FROM readings WHERE percent >= 40 AND resets_at IS NOT NULL GROUP BY 1, 2)
SELECT key, epoch_us(ts) AS ts, epoch_us(win) AS "window" FROM c""")
def once_per_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-8: one alert for each window (resets wander by a second here)."""
    rows = b.readings(spark, sf_dir).filter("percent >= 40 and resets_at is not null")
    wander = rows.select(F.concat_ws(":", "service", "bucket").alias("key"), "ts", F.expr("case when percent = 100 then timestampadd(SECOND, 1, resets_at) else resets_at end").alias("window"), "resets_at")
    fired = alerts.once_per_window(wander.select("key", "ts", F.col("resets_at").alias("window")).unionByName(wander.filter("window <> resets_at").select("key", "ts", "window")))
    return flat(fired)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, epoch_us(min(ts)) AS ts FROM events WHERE hour(ts) >= 9 AND hour(ts) < 22 GROUP BY 1")
def daily_summaries_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-9."""
    return flat(alerts.summary_due(b.events(spark, sf_dir).select("ts"), 9, (22, 7)))


@query("SELECT event_id FROM events WHERE user_id % 4 <> 0 AND (NOT (hour(ts) >= 22 OR hour(ts) < 7) OR event_type = 'error') AND event_id % 6 <> 0")
def shown_notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-15."""
    rows = b.events(spark, sf_dir).withColumns({"enabled": F.col("user_id") % 4 != 0, "urgent": F.col("event_type") == "error", "pending": F.col("event_id") % 6 == 0})
    return alerts.gate(rows, (22, 7)).select("event_id")


@query("SELECT epoch_us(make_timestamp(epoch_us(ts) // 1800000000 * 1800000000)) AS bin, 'c' || user_id AS chat_id, count(*) AS turns FROM events GROUP BY 1, 2")
def tumbling_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-13: half-hour event-time windows, as the stream counts them."""
    from tallyspark.streaming.turns import half_hours

    rows = b.events(spark, sf_dir).select("ts", F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("chat_id"))
    return flat(half_hours(rows).select("bin", "chat_id", "turns"))


