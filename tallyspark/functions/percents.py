"""Percents, bars and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.moments import col


def clamped(percent: str | Column) -> Column:
    """0 to 100; null stays null."""
    p = col(percent)
    return F.when(p < 0, F.lit(0.0)).when(p > 100, F.lit(100.0)).otherwise(p)


def shown(percent: str | Column, remaining: bool) -> Column:
    return F.lit(100.0) - clamped(percent) if remaining else clamped(percent)


def level(value: str | Column, most: str | Column) -> Column:
    """0 to 4: how dark a day's square is."""
    share = F.coalesce(F.try_divide(col(value).cast("double"), col(most).cast("double")), F.lit(0.0))
    return F.least(F.lit(4), F.greatest(F.lit(0), F.ceil(F.lit(4.0) * share).cast("int")))


def band(percent: str | Column) -> Column:
    return F.when(col(percent) >= 90, "red").when(col(percent) >= 70, "orange").otherwise("green")


def advice(percent: str | Column) -> Column:
    """What to do about a window this full, by its whole percent."""
    p = F.round(col(percent))
    return F.when(p >= 90, "wait").when(p >= 75, "plan").otherwise("room")


def one_decimal(points: str | Column) -> Column:
    return F.round(col(points) * 10) / 10
