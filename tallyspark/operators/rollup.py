"""Roll-ups of costed turns: days, rolling spans, models, projects, families."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.models import display_name, family
from tallyspark.functions.moments import day, last_days, moment

#: Days that turns stay in detail, day totals stay, chats stay.
DETAIL_DAYS, DAY_DAYS, CHAT_DAYS = 31, 366, 92

SUMS = ("cost_nd", "tokens", "input", "output", "cache_read", "cache_write_5m", "cache_write_1h", "thinking")


def sums(*columns: str) -> list[Column]:
    return [F.sum(c).alias(c) for c in columns]


def zero_if_null(df: DataFrame) -> DataFrame:
    return df.na.fill(0)


def today(turns: DataFrame, now: datetime) -> DataFrame:
    """One row: what the day of `now` has cost so far."""
    start = datetime(now.year, now.month, now.day)
    return zero_if_null(turns.filter(F.col("ts") >= moment(start)).agg(*sums(*SUMS), F.count("*").alias("turns")))


def rolling(turns: DataFrame, now: datetime, days: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row: cost of the last 7 and 30 times 24 hours. The lower bound counts; there is no upper one."""
    since = [F.col("ts") >= moment(now - timedelta(days=d)) for d in days]
    recent = turns.filter(F.col("ts") >= moment(now - timedelta(days=max(days))))
    return zero_if_null(recent.agg(*(F.sum(F.when(s, F.col("cost_nd")).otherwise(0)).alias(f"cost_{d}d_nd") for d, s in zip(days, since, strict=True))))


def by_model(turns: DataFrame) -> DataFrame:
    """Cost and tokens by display name; ids without one leave the list."""
    named = turns.withColumn("name", display_name("model")).filter("name is not null")
    return named.groupBy("name").agg(*sums(*SUMS), F.count("*").alias("turns"))


def by_model_today(turns: DataFrame, now: datetime) -> DataFrame:
    return by_model(turns.filter(F.col("ts") >= moment(datetime(now.year, now.month, now.day))))


def daily(turns: DataFrame) -> DataFrame:
    """One row for each day with turns."""
    return turns.groupBy(day("ts").alias("day")).agg(*sums(*SUMS), F.count("*").alias("turns"))


def daily_families(turns: DataFrame) -> DataFrame:
    """Cost by day and model family, one row for each."""
    return turns.groupBy(day("ts").alias("day"), family("model").alias("family")).agg(*sums("cost_nd", "tokens"), F.count("*").alias("turns"))


def daily_with_families(turns: DataFrame) -> DataFrame:
    """As `daily`, with the families' costs as a map; the turns are shuffled once, by day and family."""
    each = turns.groupBy(day("ts").alias("day"), family("model").alias("family")).agg(*sums(*SUMS), F.count("*").alias("turns"))
    return each.groupBy("day").agg(*sums(*SUMS, "turns"), F.map_from_entries(F.collect_list(F.struct("family", "cost_nd"))).alias("families"))


def projects(turns: DataFrame, now: datetime, days: int) -> DataFrame:
    """Cost, tokens, turns and last activity of each project within `days` times 24 hours."""
    recent = turns.filter(F.col("ts") >= moment(now - timedelta(days=days)))
    return recent.groupBy("project").agg(*sums("cost_nd", "tokens"), F.count("*").alias("turns"), F.max("ts").alias("last_at"))


def window_usage(turns: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Usage from `start` to `end`, both included: one row for the whole, each project and each model (`part`, `name`).

    Grouping sets over one pass; ids without a display name count in the whole and their project.
    """
    rows = turns.filter((F.col("ts") >= moment(start)) & (F.col("ts") <= moment(end))).withColumn("model_name", display_name("model"))
    sets = rows.groupingSets([[], [F.col("project")], [F.col("model_name")]], "project", "model_name")
    out = sets.agg(F.grouping_id("project", "model_name").alias("_set"), *sums("cost_nd", "tokens"), F.count("*").alias("turns"), F.max("ts").alias("last_at"))
    part = F.when(F.col("_set") == 3, "all").when(F.col("_set") == 1, "project").otherwise("model")
    out = out.withColumns({"part": part, "name": F.when(F.col("_set") == 1, F.col("project")).when(F.col("_set") == 2, F.col("model_name")).otherwise("")})
    return out.filter("not (part = 'model' and name is null)").select("part", "name", "cost_nd", "tokens", "turns", "last_at")


def folded(turns: DataFrame, stored_days: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(recent turns, day totals): turns older than the detail horizon become day totals, added to those stored.

    Days beyond the retention go. Rows of one day, as after a move between zones, add up.
    """
    edge = moment(now - timedelta(days=DETAIL_DAYS))
    old = daily(turns.filter(F.col("ts") < edge))
    kept = F.col("day") >= F.date_sub(F.lit(now.date()), DAY_DAYS)
    return turns.filter(F.col("ts") >= edge), merged_days(stored_days, old).filter(kept)


def merged_days(*days: DataFrame) -> DataFrame:
    """Day totals of several tables (or of one with repeated days) as one."""
    out = days[0]
    for d in days[1:]:
        out = out.unionByName(d)
    return out.groupBy("day").agg(*sums(*SUMS, "turns"))


def merged_families(*days: DataFrame) -> DataFrame:
    """Family costs of several tables with a map column, by day and family."""
    parts = [d.select("day", F.explode("families").alias("family", "cost_nd")) for d in days]
    out = parts[0]
    for d in parts[1:]:
        out = out.unionByName(d)
    return out.groupBy("day", "family").agg(F.sum("cost_nd").alias("cost_nd"))


def without_old_chats(chats: DataFrame, now: datetime) -> DataFrame:
    return chats.filter(F.col("last_at") >= moment(now - timedelta(days=CHAT_DAYS)))


def days_between(days: DataFrame, first: Column, last: Column) -> DataFrame:
    """Day totals within the days, both included."""
    return merged_days(days.filter((F.col("day") >= first) & (F.col("day") <= last)))


def range_summary(days: DataFrame) -> DataFrame:
    """One row: number of days, their cost, and days with any."""
    return zero_if_null(days.agg(F.count("*").alias("days"), F.sum("cost_nd").alias("cost_nd"), F.count_if(F.col("cost_nd") > 0).alias("active_days")))


def calendar_cost(days: DataFrame, now: datetime, n: int) -> DataFrame:
    """Cost of the `n` calendar days that end today."""
    return zero_if_null(days.filter(last_days("day", now, n)).agg(F.sum("cost_nd").alias("cost_nd")))


def whole_days_spend(days: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """Cost of the days that begin within [start, end)."""
    begin = F.col("day").cast("timestamp_ntz")
    return zero_if_null(days.filter((begin >= moment(start)) & (begin < moment(end))).agg(F.sum("cost_nd").alias("cost_nd")))


def by_provider(turns: DataFrame, now: datetime) -> DataFrame:
    """Today's and this week's cost and today's tokens of each provider: the status document's cost entry."""
    day_start = moment(datetime(now.year, now.month, now.day))
    in_day, in_week = F.col("ts") >= day_start, F.col("ts") >= moment(now - timedelta(days=7))
    recent = turns.filter(in_week | in_day)
    return recent.groupBy("provider").agg(
        F.sum(F.when(in_day, F.col("cost_nd")).otherwise(0)).alias("today_nd"),
        F.sum(F.when(in_week, F.col("cost_nd")).otherwise(0)).alias("week_nd"),
        F.sum(F.when(in_day, F.col("tokens")).otherwise(0)).alias("today_tokens"),
    )


def costliest(turns: DataFrame, keys: list[str]) -> DataFrame:
    """The dearest model of each key, by display name or id; of equal ones the smaller name."""
    each = turns.groupBy(*keys, F.coalesce(display_name("model"), F.col("model")).alias("name")).agg(F.sum("cost_nd").alias("cost_nd"))
    return each.groupBy(*keys).agg(F.min_by(F.struct("name", "cost_nd"), F.struct(-F.col("cost_nd"), F.col("name"))).alias("_x")).select(*keys, "_x.*")


def share_of_whole(df: DataFrame, value: str, keys: list[str], name: str = "fraction") -> DataFrame:
    whole = F.sum(value).over(Window.partitionBy(*keys)) if keys else F.sum(value).over(Window.partitionBy(F.lit(0)))
    return df.withColumn(name, F.coalesce(F.try_divide(F.col(value).cast("double"), whole.cast("double")), F.lit(0.0)))


#: Versions of a stored snapshot: the one written now, the one that converts to it, the ones whose day totals are kept.
SNAPSHOT, CONVERTIBLE, DAYS_ONLY = 8, (7,), (6,)


def restored(snapshot: DataFrame) -> DataFrame:
    """Rows of a stored snapshot (version, part: turn | day | chat) that still count: all of the current and the convertible
    version, days and chats of the one before, nothing of others."""
    whole = F.col("version").isin(SNAPSHOT, *CONVERTIBLE)
    return snapshot.filter(whole | (F.col("version").isin(*DAYS_ONLY) & F.col("part").isin("day", "chat"))).withColumn("version", F.lit(SNAPSHOT))
