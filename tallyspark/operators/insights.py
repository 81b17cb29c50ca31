"""Figures over day totals: weeks compared, averages, dearest day, shares."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.moments import last_days

PROJECT_ROWS, LEAST_BAR, MODEL_PARTS, MODEL_ROWS = 5, 0.01, 3, 5


def week_over_week(days: DataFrame, now: datetime) -> DataFrame:
    """One row: cost of the last 7 calendar days and of the 7 before, and the change in percent (null without a last week)."""
    this, both = last_days("day", now, 7), last_days("day", now, 14)
    out = days.filter(both).agg(
        F.coalesce(F.sum(F.when(this, F.col("cost_nd")).otherwise(0)), F.lit(0)).alias("this_week_nd"),
        F.coalesce(F.sum(F.when(~this, F.col("cost_nd")).otherwise(0)), F.lit(0)).alias("last_week_nd"),
    )
    change = F.try_divide((F.col("this_week_nd") - F.col("last_week_nd")).cast("double") * 100, F.nullif(F.col("last_week_nd"), F.lit(0)).cast("double"))
    return out.withColumn("change_percent", change)


def daily_average(days: DataFrame, now: datetime, span: int = 30) -> DataFrame:
    """One row: active days of the last `span`, and their mean cost (null without any)."""
    active = days.filter(last_days("day", now, span) & (F.col("cost_nd") > 0))
    return active.agg(F.count("*").alias("active_days"), F.try_divide(F.sum("cost_nd").cast("double"), F.count("*").cast("double")).alias("average_nd"))


def dearest_day(days: DataFrame, now: datetime, span: int = 90) -> DataFrame:
    """The dearest of the last `span` days, the earliest of equal ones; no row if nothing was spent."""
    spent = days.filter(last_days("day", now, span) & (F.col("cost_nd") > 0))
    return spent.orderBy(F.desc("cost_nd"), "day").limit(1).select("day", "cost_nd")


def activity(days: DataFrame, now: datetime, spans: tuple[int, ...] = (30, 90, 365)) -> DataFrame:
    """One row: cost of the last 30, 90 and 365 calendar days, and active days of the longest span."""
    longest = days.filter(last_days("day", now, max(spans)))
    return longest.agg(
        *(F.coalesce(F.sum(F.when(last_days("day", now, n), F.col("cost_nd")).otherwise(0)), F.lit(0)).alias(f"cost_{n}d_nd") for n in spans),
        F.count_if(F.col("cost_nd") > 0).alias("active_days"),
    )


def most_used_model(models: DataFrame) -> DataFrame:
    """The dearest model, by name if equal."""
    return models.orderBy(F.desc("cost_nd"), "name").limit(1).select("name", "cost_nd")


def model_split(models: DataFrame, parts: int = MODEL_PARTS) -> DataFrame:
    """Models with a cost and their share; more than `parts` become `parts` - 1 and the rest (`is_other`)."""
    w = Window.partitionBy(F.lit(0))
    paid = models.filter("cost_nd > 0").select("name", "cost_nd")  # one row for each model name
    rows = paid.withColumns({"_rank": F.row_number().over(w.orderBy(F.desc("cost_nd"), "name")), "_n": F.count("*").over(w), "_all": F.sum("cost_nd").over(w)})
    other = (F.col("_n") > parts) & (F.col("_rank") >= parts)
    out = rows.groupBy(F.when(other, "other").otherwise(F.col("name")).alias("name"), other.alias("is_other")).agg(F.sum("cost_nd").alias("cost_nd"), F.max("_all").alias("_all"))
    return out.select("name", "is_other", "cost_nd", (F.col("cost_nd") / F.col("_all")).alias("fraction"))


def top_models(models: DataFrame, most: int = MODEL_ROWS) -> DataFrame:
    return models.filter("cost_nd > 0").orderBy(F.desc("cost_nd"), "name").limit(most)


def project_rows(projects: DataFrame, most: int = PROJECT_ROWS) -> DataFrame:
    """The dearest projects with a bar's length against the dearest, at least 1 %; 0 where none has a cost."""
    shown = projects.orderBy(F.desc("cost_nd"), "project").limit(most)
    top = F.max("cost_nd").over(Window.partitionBy(F.lit(0)))  # over `most` rows
    return shown.withColumn("fraction", F.when(top > 0, F.greatest(F.lit(LEAST_BAR), F.col("cost_nd") / top)).otherwise(0.0))


def summary(days: DataFrame, models_today: DataFrame, at_limit: DataFrame, now: datetime) -> DataFrame:
    """The five figures in one row."""
    best = dearest_day(days, now).select(F.col("day").alias("dearest_day"), F.col("cost_nd").alias("dearest_nd"))
    used = most_used_model(models_today).select(F.col("name").alias("model_today"), F.col("cost_nd").alias("model_today_nd"))
    out = week_over_week(days, now)
    for side in (daily_average(days, now), best, used, at_limit):  # one row at most each
        out = out.join(F.broadcast(side), F.lit(True), "left")
    return out
