"""Calendar spines: grids, bars, day keys."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.percents import level


def spine(spark: SparkSession, first: date, last: date) -> DataFrame:
    """One row for each day from `first` to `last`."""
    days = F.sequence(F.lit(first), F.lit(last), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias("day")) if first <= last else spark.createDataFrame([], "day date")


def week_start(day: date, first_weekday: int = 1) -> date:
    """`first_weekday`: 1 is Sunday, 2 Monday."""
    return day - timedelta(days=(day.isoweekday() % 7 + 1 - first_weekday) % 7)


def grid(days: DataFrame, start: date, now: datetime, first_weekday: int = 1, value: str = "cost_nd") -> DataFrame:
    """Weeks by 7 days from the week of `start` to that of `now`: column, row, value and level of each square.

    Squares before `start` or after today are blank (`shown` false). `month_marker` is set where a week's first day is one of
    its month's first seven.
    """
    first, end = week_start(start, first_weekday), week_start(now.date(), first_weekday) + timedelta(days=6)
    cells = spine(days.sparkSession, first, end).join(days.select("day", F.col(value).alias("value")), "day", "left")
    shown = (F.col("day") >= F.lit(start)) & (F.col("day") <= F.lit(now.date()))
    n = F.datediff("day", F.lit(first))
    cells = cells.withColumns({"week": F.floor(n / 7).cast("int"), "weekday": (n % 7).cast("int"), "shown": shown, "value": F.when(shown, F.coalesce("value", F.lit(0)))})
    most = F.max("value").over(Window.partitionBy(F.lit(0)))  # over the grid's days
    marker = (F.col("weekday") == 0) & (F.dayofmonth("day") <= 7)
    return cells.withColumns({"level": F.when(F.col("shown"), level("value", most)), "month_marker": marker})


def bars(days: DataFrame, now: datetime, n: int = 30) -> DataFrame:
    """The last `n` days, zero where nothing was spent, toned today, week or older."""
    today = now.date()
    rows = spine(days.sparkSession, today - timedelta(days=n - 1), today).join(days.select("day", "cost_nd"), "day", "left")
    tone = F.when(F.col("day") == F.lit(today), "today").when(F.col("day") > F.lit(today - timedelta(days=7)), "week").otherwise("older")
    return rows.select("day", F.coalesce("cost_nd", F.lit(0)).alias("cost_nd"), tone.alias("tone"))


def domain(now: datetime, n: int) -> tuple[datetime, datetime]:
    """The chart's bounds for `n` calendar days: midnight of the first, midnight after today."""
    today = datetime(now.year, now.month, now.day)
    return today - timedelta(days=n - 1), today + timedelta(days=1)
