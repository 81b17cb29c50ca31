"""Chats: summaries, agents, models, lists."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.frames import ranked
from tallyspark.operators import dedup, rollup, sessions
from tallyspark.plans import binding as b
from tallyspark.plans.binding import flat
from tallyspark.plans.catalog import query

_IN = "CAST(ts AS DATE) BETWEEN day - 6 AND day"
_TITLES = """titles AS (SELECT chat_id, coalesce(title, prompt) AS title FROM (SELECT chat_id, arg_max(text, seq) AS title FROM chat_events WHERE kind = 'title' GROUP BY 1) FULL JOIN (SELECT chat_id, arg_min(text, seq) AS prompt FROM chat_events WHERE kind = 'prompt' GROUP BY 1) USING (chat_id))"""
SUMMARY = f"""{b.TURNS}, {b.CHAT_EVENTS_CTE}, {_TITLES},
chats AS (SELECT chat_id, count(*) FILTER ({_IN}) AS turns, CAST(coalesce(sum(tokens) FILTER ({_IN}), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(cost_nd) FILTER ({_IN}), 0) AS BIGINT) AS cost_nd,
  CAST(coalesce(sum(tokens) FILTER ({_IN} AND agent_id IS NULL), 0) AS BIGINT) AS main_tokens, count(*) FILTER ({_IN} AND agent_id IS NULL) AS main_turns, count(DISTINCT CAST(ts AS DATE)) FILTER ({_IN}) AS days,
  min(ts) AS first_at, max(ts) AS last_at, arg_max(project, (ts, seq)) AS project FROM turns, clock GROUP BY 1),
summary AS (SELECT c.*, t.title FROM chats c LEFT JOIN titles t USING (chat_id) WHERE c.days > 0)
"""


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = b.now(spark, sf_dir).date()
    names = dedup.titles(b.chat_events(spark, sf_dir))
    return sessions.summaries(b.turns(spark, sf_dir), F.lit(last - timedelta(days=6)), F.lit(last), names)


_COLS = ("chat_id", "turns", "tokens", "cost_nd", "main_tokens", "main_turns", "days", "first_at", "last_at", "project", "title")


@query(f"{SUMMARY} SELECT chat_id, turns, tokens, cost_nd, main_tokens, main_turns, days, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at, project, title FROM summary")
def chat_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7, AGG-10, AGG-11, AGG-12, JON-2: chats with a turn in the last week."""
    return flat(_summary(spark, sf_dir).select(*_COLS))


@query(f"{b.TURNS} SELECT chat_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(coalesce(sum(cost_nd) FILTER (agent_id IS NULL), 0) AS BIGINT) AS main_cost_nd FROM turns GROUP BY 1, 2")
def chat_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-7: a chat's days."""
    return flat(sessions.chat_days(b.turns(spark, sf_dir)).select("chat_id", "day", "turns", "tokens", "main_cost_nd"))


_AGENTS = """agents AS (SELECT chat_id, agent_id, arg_max(agent_kind, (ts, seq)) AS kind, arg_max(model, (ts, seq)) AS model, arg_max(nullif(trim(effort), ''), (ts, seq)) FILTER (nullif(trim(effort), '') IS NOT NULL) AS effort,
  min(ts) AS first_at, max(ts) AS last_at, count(*) AS turns, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nd) AS BIGINT) AS cost_nd FROM turns WHERE agent_id IS NOT NULL GROUP BY 1, 2)"""


@query(f"{b.TURNS}, {_AGENTS} SELECT chat_id, agent_id, kind, model, coalesce(effort, '') AS effort, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at, turns, tokens, cost_nd FROM agents, clock WHERE CAST(last_at AS DATE) >= day - 6 AND CAST(first_at AS DATE) <= day")
def chat_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8: agents that ran in the last week, whole."""
    last = b.now(spark, sf_dir).date()
    rows = sessions.agents_in_range(sessions.chat_agents(b.turns(spark, sf_dir)), F.lit(last - timedelta(days=6)), F.lit(last))
    return flat(rows.withColumn("effort", F.coalesce("effort", F.lit(""))))


@query(f"{b.TURNS} SELECT chat_id, agent_id, coalesce(e.effort, '') AS effort FROM (SELECT chat_id, agent_id, nullif(trim(effort), '') AS effort FROM turns WHERE agent_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chat_id, agent_id ORDER BY ts DESC, seq DESC) = 1) e")
def agent_last_effort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-8, rollout logs: the latest turn's effort, blank or not."""
    rows = sessions.chat_agents(b.turns(spark, sf_dir), last_effort_even_null=True)
    # max_by keeps the row of the latest turn, a null effort included
    return rows.select("chat_id", "agent_id", F.coalesce("effort", F.lit("")).alias("effort"))


@query(f"{b.TURNS} SELECT chat_id, model, coalesce(nullif(trim(effort), ''), '') AS effort, count(*) AS turns, CAST(sum(cost_nd) AS BIGINT) AS cost_nd FROM turns GROUP BY 1, 2, 3")
def chat_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-9."""
    return sessions.chat_models(b.turns(spark, sf_dir)).select("chat_id", "model", F.coalesce("effort", F.lit("")).alias("effort"), "turns", "cost_nd")


@query(f"{b.TURNS} SELECT chat_id, arg_max(project, (agent_id IS NULL, ts, seq)) AS project FROM turns GROUP BY 1")
def chat_main_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: the project of a chat's latest main-thread turn."""
    return b.turns(spark, sf_dir).groupBy("chat_id").agg(sessions.chat_project(newest_main_first=True).alias("project"))


@query(f"""{b.TURNS}, t AS (SELECT *, 'p' || (seq % 9) AS folder, ts + to_minutes(CAST(CASE WHEN seq % 7 = 0 THEN 900 ELSE 0 END AS INTEGER)) AS at_ FROM turns),
r AS (SELECT *, max(at_) OVER (PARTITION BY chat_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, row_number() OVER (PARTITION BY chat_id, agent_id IS NULL ORDER BY seq) AS k, count(*) FILTER (agent_id IS NULL) OVER (PARTITION BY chat_id) AS mains FROM t),
m AS (SELECT chat_id, arg_max(folder, seq) AS project FROM r WHERE agent_id IS NULL AND (k = 1 OR seen IS NULL OR at_ >= seen) GROUP BY 1)
SELECT chat_id, coalesce(m.project, f.folder) AS project FROM (SELECT chat_id, arg_min(folder, seq) AS folder FROM r GROUP BY 1) f LEFT JOIN m USING (chat_id)""")
def rollout_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-10, rollout logs: a newer sub-agent turn keeps an older main turn from renaming its chat."""
    rows = b.turns(spark, sf_dir)
    late = F.when(F.col("seq") % 7 == 0, F.expr("ts + interval 900 minutes")).otherwise(F.col("ts"))
    return sessions.rollout_project(rows.withColumns({"project": F.concat(F.lit("p"), (F.col("seq") % 9).cast("string")), "ts": late}))


_LIST = f"""{SUMMARY}, r AS (SELECT *, row_number() OVER (ORDER BY last_at DESC, chat_id) AS rec FROM summary), c AS (SELECT *, row_number() OVER (PARTITION BY rec <= 10 ORDER BY cost_nd DESC, chat_id) AS k FROM r)"""


@query(f"{_LIST} SELECT chat_id, epoch_us(last_at) AS last_at, cost_nd, rec > 10 AS is_top FROM c WHERE rec <= 10 OR k <= 5")
def chat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-1: the latest chats and the dearest of the others."""
    return flat(sessions.chat_list(_summary(spark, sf_dir)).select("chat_id", "last_at", "cost_nd", "is_top"))


@query(f"{SUMMARY} SELECT chat_id, row_number() OVER (ORDER BY last_at DESC, chat_id) AS recent, row_number() OVER (ORDER BY cost_nd DESC, chat_id) AS dear FROM summary")
def chat_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-2: places by recency and by cost. The places of a whole list need one order over all of it; the list itself is sorted
    by range and never gathered."""
    rows = _summary(spark, sf_dir).select("chat_id", "last_at", "cost_nd").withColumn("_all", F.lit(1))
    out = ranked(rows, ["_all"], [F.desc("last_at"), F.col("chat_id")], name="recent")
    return ranked(out, ["_all"], [F.desc("cost_nd"), F.col("chat_id")], name="dear").select("chat_id", "recent", "dear")


@query(f"""{SUMMARY}, {_AGENTS}, d AS (SELECT * FROM (SELECT chat_id, CAST(ts AS DATE) AS d, CAST(sum(cost_nd) AS BIGINT) AS cost_nd FROM turns GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY d DESC) <= 14),
a AS (SELECT * FROM agents QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY cost_nd DESC, agent_id) <= 8), m AS (SELECT * FROM (SELECT chat_id, model, nullif(trim(effort), '') AS effort, CAST(sum(cost_nd) AS BIGINT) AS cost_nd FROM turns GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY cost_nd DESC, model, effort NULLS FIRST) <= 6)
SELECT s.chat_id, part, item, cost_nd FROM (SELECT chat_id, 'day' AS part, CAST(d AS VARCHAR) AS item, cost_nd FROM d UNION ALL SELECT chat_id, 'agent', agent_id, cost_nd FROM a UNION ALL SELECT chat_id, 'model', model || '/' || coalesce(effort, ''), cost_nd FROM m) x JOIN (SELECT chat_id FROM summary) s ON s.chat_id = x.chat_id""")
def chat_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-3: a chat's last days, dearest agents and models."""
    rows = b.turns(spark, sf_dir)
    one = sessions.nested(_summary(spark, sf_dir).select("chat_id"), sessions.chat_days(rows), sessions.chat_agents(rows), sessions.chat_models(rows))
    days = one.select("chat_id", F.lit("day").alias("part"), F.explode("days_list").alias("x")).select("chat_id", "part", F.col("x.day").cast("string").alias("item"), F.col("x.cost_nd").alias("cost_nd"))
    agents = one.select("chat_id", F.lit("agent").alias("part"), F.explode("agents").alias("x")).select("chat_id", "part", F.col("x.agent_id").alias("item"), F.col("x.cost_nd").alias("cost_nd"))
    models = one.select("chat_id", F.lit("model").alias("part"), F.explode("models").alias("x")).select("chat_id", "part", F.concat_ws("/", "x.model", F.coalesce("x.effort", F.lit(""))).alias("item"), F.col("x.cost_nd").alias("cost_nd"))
    return days.unionByName(agents).unionByName(models)


@query(f"{SUMMARY} SELECT chat_id, epoch_us(last_at) AS last_at FROM summary, clock WHERE CAST(last_at AS DATE) BETWEEN day - 1 AND day")
def chats_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-8."""
    last = b.now(spark, sf_dir).date()
    return flat(sessions.in_day_range(_summary(spark, sf_dir), F.lit(last - timedelta(days=1)), F.lit(last)).select("chat_id", "last_at"))


@query(f"{b.TURNS} SELECT chat_id, input - least(input, thinking) AS net, tokens, cost_nd FROM (SELECT chat_id, CAST(sum(input) AS BIGINT) AS input, CAST(sum(thinking) AS BIGINT) AS thinking, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_nd) AS BIGINT) AS cost_nd FROM turns GROUP BY 1)")
def ledger_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-38, AGG-39: whole-chat figures of the ledger source, input net of what was cached."""
    rows = b.turns(spark, sf_dir).groupBy("chat_id").agg(*rollup.sums("input", "thinking", "tokens", "cost_nd"))
    return rows.select("chat_id", (F.col("input") - F.least("input", "thinking")).alias("net"), "tokens", "cost_nd")
