"""Chats: one row each over a range of days, with their days, agents and models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.frames import ranked, running
from tallyspark.functions.moments import day

#: The most agents, days and models that a chat's row lists, and the length of the two parts of the chat list.
AGENT_ROWS, DAY_ROWS, MODEL_ROWS = 8, 14, 6
RECENT, TOP = 10, 5
#: Records of a chat to a slice of its running functions.
ROLLOUT_SLICE = 1_000_000


def of_chats(turns: DataFrame) -> DataFrame:
    """Turns without a chat count in day figures but belong to no chat."""
    return turns.filter("chat_id is not null and chat_id <> ''")


def chat_project(newest_main_first: bool = False) -> Column:
    """The project of a chat: that of its latest turn (the later record of equal times).

    With `newest_main_first`, the latest turn of the main thread names it, and a sub-agent's only where there is none.
    """
    order = F.struct(F.col("agent_id").isNull().alias("_main"), "ts", "seq") if newest_main_first else F.struct("ts", "seq")
    return F.max_by("project", order)


def rollout_project(turns: DataFrame) -> DataFrame:
    """chat_id and the project of a rollout chat, in the order of ingest: a main-thread turn names it if it is the main thread's
    first, or no earlier turn has a later time; a chat of sub-agents alone takes its first turn's."""
    rows = of_chats(turns).select("chat_id", "seq", "ts", "project", F.col("agent_id").isNull().alias("_main"))
    rows = running(rows, ["chat_id"], ["seq"], F.floor(F.col("seq") / ROLLOUT_SLICE), peak={"_seen": F.col("ts")}, total={"_mains": F.col("_main").cast("int")})
    names = F.col("_main") & ((F.col("_mains") == 1) | F.col("_seen").isNull() | (F.col("ts") >= F.col("_seen")))
    found = rows.groupBy("chat_id").agg(F.max_by("project", F.when(names, F.col("seq"))).alias("_named"), F.min_by("project", "seq").alias("_first"))
    return found.select("chat_id", F.coalesce("_named", "_first").alias("project"))


def chat_days(turns: DataFrame) -> DataFrame:
    """Turns, tokens and cost by chat and day, the main thread's apart."""
    main = F.col("agent_id").isNull()
    return of_chats(turns).groupBy("chat_id", day("ts").alias("day")).agg(
        F.count("*").alias("turns"), F.sum("tokens").alias("tokens"), F.sum("cost_nd").alias("cost_nd"),
        F.sum(F.when(main, F.col("tokens")).otherwise(0)).alias("main_tokens"), F.sum(F.when(main, F.col("cost_nd")).otherwise(0)).alias("main_cost_nd"),
    )


def chat_agents(turns: DataFrame, last_effort_even_null: bool = False) -> DataFrame:
    """Whole totals of each chat's agents, with their latest model and effort.

    The effort is the latest that isn't blank; with `last_effort_even_null` it is the latest turn's, blank or not.
    """
    rows = of_chats(turns).filter("agent_id is not null").withColumn("effort", F.nullif(F.trim("effort"), F.lit("")))
    at = F.struct("ts", "seq")
    effort = F.max_by("effort", at) if last_effort_even_null else F.max_by("effort", F.when(F.col("effort").isNotNull(), at))
    return rows.groupBy("chat_id", "agent_id").agg(
        F.max_by("agent_kind", at).alias("kind"), F.max_by("model", at).alias("model"), effort.alias("effort"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.count("*").alias("turns"), F.sum("tokens").alias("tokens"), F.sum("cost_nd").alias("cost_nd"),
    )


def chat_models(turns: DataFrame) -> DataFrame:
    """Whole totals by chat, model and effort; a blank effort is none."""
    return of_chats(turns).groupBy("chat_id", "model", F.nullif(F.trim("effort"), F.lit("")).alias("effort")).agg(
        F.count("*").alias("turns"), F.sum("tokens").alias("tokens"), F.sum("cost_nd").alias("cost_nd")
    )


def summaries(turns: DataFrame, first: Column, last: Column, names: DataFrame | None = None) -> DataFrame:
    """Chats with a turn on the days from `first` to `last`: figures of these days; first and last activity, project and
    title of the whole chat. One shuffle by chat and day, one by chat of what that leaves."""
    rows = of_chats(turns)
    each = rows.groupBy("chat_id", day("ts").alias("day")).agg(
        F.count("*").alias("turns"), F.sum("tokens").alias("tokens"), F.sum("cost_nd").alias("cost_nd"),
        F.sum(F.when(F.col("agent_id").isNull(), F.col("tokens")).otherwise(0)).alias("main_tokens"),
        F.count_if(F.col("agent_id").isNotNull()).alias("agent_turns"),
        F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max_by("project", F.struct("ts", "seq")).alias("project"),
    )
    inside = (F.col("day") >= first) & (F.col("day") <= last)
    figure = lambda c: F.sum(F.when(inside, F.col(c)).otherwise(0)).alias(c)
    out = each.groupBy("chat_id").agg(
        *(figure(c) for c in ("turns", "tokens", "cost_nd", "main_tokens", "agent_turns")), F.count_if(inside).alias("days"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.max_by("project", "day").alias("project"),
    )
    out = out.filter("days > 0").withColumn("main_turns", F.greatest(F.lit(0), F.col("turns") - F.col("agent_turns")))
    return out if names is None else out.join(names, "chat_id", "left")


def agents_in_range(agents: DataFrame, first: Column, last: Column) -> DataFrame:
    """Agents that ran on any of the days, whole."""
    return agents.filter((F.to_date("last_at") >= first) & (F.to_date("first_at") <= last))


def nested(summary: DataFrame, days: DataFrame, agents: DataFrame, models: DataFrame) -> DataFrame:
    """Chat rows with their lists, each cut to its length before it is collected: no chat gathers more than a few rows."""
    top = lambda df, key, n: ranked(df, ["chat_id"], [F.desc("cost_nd"), key], n)
    listed = lambda df, name, *cols: df.groupBy("chat_id").agg(F.array_sort(F.collect_list(F.struct("rank", *cols))).alias(name))
    d = listed(ranked(days, ["chat_id"], [F.desc("day")], DAY_ROWS), "days_list", "day", "turns", "tokens", "cost_nd")
    a = listed(top(agents, F.col("agent_id"), AGENT_ROWS), "agents", "agent_id", "kind", "model", "effort", "turns", "tokens", "cost_nd")
    m = listed(top(models, F.struct("model", "effort"), MODEL_ROWS), "models", "model", "effort", "turns", "tokens", "cost_nd")
    d = d.withColumn("days_list", F.reverse("days_list"))  # the last days, oldest first
    return summary.join(d, "chat_id", "left").join(a, "chat_id", "left").join(m, "chat_id", "left")


def chat_list(summary: DataFrame, recent: int = RECENT, top: int = TOP) -> DataFrame:
    """The `recent` latest chats and the `top` dearest of the others (`is_top`), in order of recency.

    Both parts are limits with an order, so each task sends a few rows.
    """
    newest = summary.orderBy(F.desc("last_at"), "chat_id").limit(recent)
    # the dearest of the others are among the `recent` + `top` dearest of all
    dearest = summary.orderBy(F.desc("cost_nd"), "chat_id").limit(recent + top)
    others = dearest.join(F.broadcast(newest.select("chat_id")), "chat_id", "left_anti").orderBy(F.desc("cost_nd"), "chat_id").limit(top)
    return newest.withColumn("is_top", F.lit(False)).unionByName(others.withColumn("is_top", F.lit(True))).orderBy(F.desc("last_at"), "chat_id")


def ordered(summary: DataFrame, by: str) -> DataFrame:
    """All chats, by recency or cost."""
    return summary.orderBy(F.desc("last_at" if by == "recent" else "cost_nd"), "chat_id")


def in_day_range(summary: DataFrame, first: Column, last: Column) -> DataFrame:
    """Chats whose last day is in the range."""
    return summary.filter((F.to_date("last_at") >= first) & (F.to_date("last_at") <= last))
