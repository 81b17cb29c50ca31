"""Tick logs: session updates, of which completed turns carry usage priced in ticks (ten billion to the dollar)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.operators.pricing import costed, live_only, reported_nano, residual_costs

_USAGE = "inputTokens: bigint, outputTokens: bigint, totalTokens: bigint, cachedReadTokens: bigint, cacheCreationTokens: bigint, reasoningTokens: bigint, costUsdTicks: double"
LINE = f"""
timestamp double, params struct<sessionId: string,
  update: struct<sessionUpdate: string, usage: struct<{_USAGE}, modelUsage: map<string, struct<{_USAGE}>>>>,
  _meta: struct<eventId: string, agentTimestampMs: double>>
"""
MARKER = "turn_completed"
UNKNOWN = "unknown"


def rows_of(lines: DataFrame) -> DataFrame:
    """One row for each model of each completed turn, first event of each id only: lines (value, project, seq).

    The marker is looked for before anything is parsed; the parsed update then decides, for a line can merely mention it.
    """
    p = "r.params"
    rows = lines.filter(F.col("value").contains(MARKER)).withColumn("r", F.from_json("value", LINE)).filter(f"{p}.update.sessionUpdate = '{MARKER}' and {p}.update.usage is not null")
    at = F.coalesce("r.timestamp", F.col(f"{p}._meta.agentTimestampMs") / 1000)
    made = F.concat_ws("|", F.coalesce(F.col(f"{p}.sessionId"), F.col("project")), at.cast("long").cast("string"), F.coalesce(F.col(f"{p}.update.usage.totalTokens"), F.lit(0)).cast("string"))
    rows = rows.withColumns({"_at": at, "turn_id": F.coalesce(F.col(f"{p}._meta.eventId"), made)}).filter("_at is not null")
    first = rows.groupBy("turn_id").agg(F.min_by(F.struct("_at", "project", "seq", F.col(f"{p}.sessionId").alias("session"), F.col(f"{p}.update.usage").alias("u")), "seq").alias("_x")).select("turn_id", "_x.*")
    own = F.struct(*(F.col(f"u.{c}") for c in ("inputTokens", "outputTokens", "totalTokens", "cachedReadTokens", "cacheCreationTokens", "reasoningTokens", "costUsdTicks")))
    entries = F.when(F.coalesce(F.size("u.modelUsage"), F.lit(0)) > 0, F.array_sort(F.map_entries("u.modelUsage"), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)))
    each = first.select("turn_id", "_at", "project", "seq", "session", F.col("u.costUsdTicks").alias("_ticks"), F.greatest(F.lit(0), F.coalesce("u.totalTokens", F.lit(0))).alias("turn_tokens"), F.posexplode(F.coalesce(entries, F.array(F.struct(F.lit(UNKNOWN).alias("key"), own.alias("value"))))).alias("pos", "m"))
    n = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(f"m.value.{c}"), F.lit(0))).cast("long")
    tokens = F.when(n("totalTokens") > 0, n("totalTokens")).otherwise(n("inputTokens") + n("outputTokens"))
    cached = n("cachedReadTokens")
    return each.select(
        "turn_id", "seq", F.timestamp_micros((F.col("_at") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("ts"), "project", F.coalesce("session", F.lit("")).alias("chat_id"), "pos", F.col("m.key").alias("model"),
        F.greatest(F.lit(0), n("inputTokens") - cached).cast("long").alias("input"), n("outputTokens").alias("output"), cached.alias("cache_read"), n("cacheCreationTokens").alias("cache_write_5m"), n("reasoningTokens").alias("thinking"),
        tokens.alias("row_tokens"), reported_nano(F.col("m.value.costUsdTicks")).alias("row_cost_nd"), reported_nano(F.col("_ticks")).alias("turn_cost_nd"), "turn_tokens",
    )


def priced(rows: DataFrame, live: DataFrame) -> DataFrame:
    """Rows with `cost_nd`: reported, shared out of the turn's rest, or from the live table (0 where it knows no price)."""
    table = costed(live_only(rows.withColumn("cache_write_1h", F.lit(0).cast("long")), live)).withColumn("table_cost_nd", F.coalesce("cost_nd", F.lit(0)))
    return residual_costs(table.select(*rows.columns, F.col("row_tokens").alias("tokens"), "table_cost_nd"))


def turns(rows: DataFrame) -> DataFrame:
    """One row for each turn: cost, tokens (the turn's own total where it says one) and models."""
    return rows.groupBy("turn_id").agg(
        F.first("ts").alias("ts"), F.first("project").alias("project"), F.sum("cost_nd").alias("cost_nd"), F.count("*").alias("models"),
        F.when(F.first("turn_tokens") > 0, F.first("turn_tokens")).otherwise(F.sum("row_tokens")).alias("tokens"),
    )
