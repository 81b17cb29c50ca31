"""One engine for all sources: a provider hands over its turns and chat events, and the five questions are the same for all."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.moments import moment
from tallyspark.operators import dedup, pricing, rollup, sessions
from tallyspark.sources import providers


@dataclass(frozen=True)
class Engine:
    """Answers over turn records (`schema.TURNS`) and chat events (`schema.CHAT_EVENTS`) of any provider.

    `Engine.of` reads them by the providers' names. `live` is the price table of the day, if there is one. Nothing is computed before an answer is used.
    """

    records: DataFrame
    events: DataFrame
    live: DataFrame | None = None

    @classmethod
    def of(cls, spark: SparkSession, sources: dict[str, Sequence[str]], now: datetime | None = None, live: DataFrame | None = None) -> Engine:
        """An engine over providers by name (`sources.providers`), each with the folders of its logs."""
        found = providers.read_all(spark, sources, now)
        return cls(found.records, found.events, live)

    def turns(self) -> DataFrame:
        """Each response once, of real models, priced and costed."""
        return pricing.costed(pricing.priced(dedup.without_synthetic(dedup.later_readings(self.records)), self.live))

    def breakdown(self, now: datetime) -> dict[str, DataFrame]:
        rows = self.turns()
        return {
            "today": rollup.today(rows, now),
            "rolling": rollup.rolling(rows, now),
            "models_today": rollup.by_model_today(rows, now),
            "daily": rollup.daily_with_families(rows),
            "projects_week": rollup.projects(rows, now, 7),
            "projects_month": rollup.projects(rows, now, 30),
        }

    def usage(self, start: datetime, end: datetime) -> DataFrame:
        return rollup.window_usage(self.turns(), start, end)

    def sessions(self, first: Column, last: Column) -> DataFrame:
        return sessions.summaries(self.turns(), first, last, dedup.titles(self.events))

    def turn_costs(self, start: datetime, end: datetime) -> DataFrame:
        """The turns of chats from `start` to `end`, both included, with their chat's title."""
        rows = sessions.of_chats(self.turns()).filter((F.col("ts") >= moment(start)) & (F.col("ts") <= moment(end)))
        return rows.join(dedup.titles(self.events), "chat_id", "left")
