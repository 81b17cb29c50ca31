"""The published status document and the answers of its tools."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.frames import ranked

VERSION, CHATS, AGENTS = 2, 15, 20
DEFAULT_LIMIT, MOST_LIMIT = 10, 15


def document(services: DataFrame, buckets: DataFrame, costs: DataFrame, chats: DataFrame, live_agents: DataFrame, now: datetime) -> DataFrame:
    """One JSON document (`value`): each service's windows, costs and latest chats (15 at most), and the agents (20 at most).

    Chats (service, chat_id, …) and agents are cut before they are collected; the services are the document's own size.
    """
    windows = buckets.groupBy("service").agg(F.array_sort(F.collect_list(F.struct("pos", "bucket", "label", "percent", "kind", "resets_at"))).alias("windows"))
    latest = ranked(chats, ["service"], [F.desc("last_at"), F.col("chat_id")], CHATS)
    listed = latest.groupBy("service").agg(F.array_sort(F.collect_list(F.struct("rank", "chat_id", "project", "last_at", "turns", "tokens", "cost_nd"))).alias("sessions"))
    rows = services.select("service", "name", "state", "fetched_at").join(windows, "service", "left").join(costs, "service", "left").join(listed, "service", "left")
    order = F.struct("service", "name", "state", "fetched_at", "windows", "today_nd", "week_nd", "today_tokens", "sessions")
    body = rows.agg(F.array_sort(F.collect_list(order)).alias("services"))
    top = live_agents.orderBy("rank", F.desc("last_event_at"), "session_id").limit(AGENTS)
    place = F.struct(F.col("rank").alias("_r"), (-F.unix_micros(F.col("last_event_at").cast("timestamp"))).alias("_t"), F.col("session_id").alias("_s"), F.struct("rank", "source", "session_id", "state", "activity", "last_event_at").alias("agent"))
    agents = top.agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["agent"]).alias("agents"))
    n = live_agents.agg(F.count_if(F.col("state") == "needsYou").alias("needs_you"), F.count_if(F.col("state") == "working").alias("working"))
    one = body.join(F.broadcast(agents), F.lit(True)).join(F.broadcast(n), F.lit(True))  # one row each
    return one.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(now.isoformat()).alias("updated_at"), "services", F.struct("needs_you", "working", F.col("agents").alias("sessions")).alias("agents"))).alias("value"))


def parsed(documents: DataFrame) -> DataFrame:
    """One row for each window of status documents (`value`)."""
    schema = "version int, updated_at string, services array<struct<service: string, name: string, state: string, windows: array<struct<bucket: string, percent: double, kind: string>>>>"
    rows = documents.select(F.from_json("value", schema).alias("d")).select("d.version", F.explode("d.services").alias("s"))
    return rows.select("version", "s.service", "s.state", F.explode_outer("s.windows").alias("w")).select("version", "service", "state", "w.bucket", "w.percent", "w.kind")


def parsed_agents(documents: DataFrame) -> DataFrame:
    """One row for each agent of status documents, in their order (`pos` from 0), with the counts of all."""
    one = "struct<rank: int, source: string, session_id: string, state: string>"
    rows = documents.select(F.from_json("value", f"agents struct<needs_you: bigint, working: bigint, sessions: array<{one}>>").alias("d"))
    listed = rows.select("d.agents.needs_you", "d.agents.working", F.posexplode_outer("d.agents.sessions").alias("pos", "s"))
    return listed.select("needs_you", "working", "pos", "s.source", "s.session_id", "s.state")


def widget(services: DataFrame, buckets: DataFrame) -> DataFrame:
    """What the widget shows of each window."""
    return buckets.join(services.select("service", "name", "state"), "service").select("service", "name", "state", "bucket", "label", "percent", "resets_at", "pos")


def session_limit(asked: object) -> int:
    """1 to 15, 10 where nothing sensible is asked."""
    try:
        n = float(asked)  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return DEFAULT_LIMIT
    return DEFAULT_LIMIT if n != n or n in (float("inf"), float("-inf")) else int(min(max(1.0, n), MOST_LIMIT))


def get_sessions(chats: DataFrame, provider: str | None = None, limit: object = None) -> DataFrame:
    """The latest chats of one or all providers."""
    rows = chats if provider is None else chats.filter(F.col("service") == provider)
    return rows.orderBy(F.desc("last_at"), "chat_id").limit(session_limit(limit))


def get_agents(live_agents: DataFrame) -> DataFrame:
    return live_agents.orderBy("rank", F.desc("last_event_at"), "session_id").limit(AGENTS)


def get_usage(services: DataFrame, buckets: DataFrame) -> DataFrame:
    return widget(services, buckets).orderBy("service", "pos")


def changed(before: dict, now: dict, seconds_since: float, least: float = 2.0) -> bool:
    """Whether a document is written again: it differs, and the last write is two seconds old."""
    return before != now and seconds_since >= least


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "value string")
