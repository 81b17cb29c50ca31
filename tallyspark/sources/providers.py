"""Providers by name: each reads its logs from folders and gives the canonical tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.schema import CHAT_EVENTS, TURNS
from tallyspark.sources import logs, rollouts, scan, stores, ticks


@dataclass(frozen=True)
class Tables:
    """Turn records (`schema.TURNS`) and chat events (`schema.CHAT_EVENTS`)."""

    records: DataFrame
    events: DataFrame

    def canonical(self) -> Tables:
        """The same with the canonical columns and types; an error names a column that is missing."""
        cast = lambda df, schema: df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        return Tables(cast(self.records, TURNS), cast(self.events, CHAT_EVENTS))


#: (session, roots, now) -> tables. Files untouched for a year before `now` may be left out.
Provider = Callable[[SparkSession, Sequence[str], datetime | None], Tables]
_PROVIDERS: dict[str, Provider] = {}


def provider(name: str) -> Callable[[Provider], Provider]:
    """Register a provider; a name is given once."""

    def add(read: Provider) -> Provider:
        if name in _PROVIDERS:
            raise ValueError(f"there is a provider {name!r} already")
        _PROVIDERS[name] = read
        return read

    return add


def names() -> list[str]:
    return sorted(_PROVIDERS)


def read(spark: SparkSession, name: str, roots: Sequence[str], now: datetime | None = None) -> Tables:
    """The tables of one provider's logs under the roots."""
    if name not in _PROVIDERS:
        raise KeyError(f"no provider {name!r}; there are {', '.join(names())}")
    return _PROVIDERS[name](spark, roots, now).canonical()


def read_all(spark: SparkSession, sources: dict[str, Sequence[str]], now: datetime | None = None) -> Tables:
    """The tables of several providers (name -> roots) together; ids are told apart by provider."""
    found = {n: read(spark, n, roots, now) for n, roots in sources.items()}
    own = lambda n: F.when(F.col("msg_id") != "", F.concat(F.lit(f"{n}:"), "msg_id"))
    named = [t.records.withColumns({"msg_id": own(n), "provider": F.lit(n)}) for n, t in found.items()]
    return Tables(reduce(DataFrame.unionByName, named), reduce(DataFrame.unionByName, (t.events for t in found.values())))


def _no_events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CHAT_EVENTS)


@provider("assistant")
def _assistant(spark: SparkSession, roots: Sequence[str], now: datetime | None) -> Tables:
    found = [logs.read(spark, root, now) for root in roots]
    return Tables(*(reduce(DataFrame.unionByName, part) for part in zip(*found, strict=True)))


@provider("rollout")
def _rollout(spark: SparkSession, roots: Sequence[str], now: datetime | None) -> Tables:
    return Tables(*rollouts.read(spark, list(roots), now))


@provider("tick")
def _tick(spark: SparkSession, roots: Sequence[str], now: datetime | None) -> Tables:
    """One record for each model of a turn; what the log says it cost is kept as `reported_cost`."""
    lines = [scan.lines(spark, root, now).withColumns({"project": logs.project_of("file", root), "seq": logs.ingest_order()}) for root in roots]
    rows = ticks.rows_of(reduce(DataFrame.unionByName, lines))
    none = lambda c: F.lit(None).cast("string").alias(c)
    records = rows.select(
        F.lit("tick").alias("provider"), F.concat_ws("#", "turn_id", "pos").alias("msg_id"), "seq", "ts", "model", "input", "output", "cache_read", "cache_write_5m", F.lit(0).alias("cache_write_1h"), "thinking", "project", "chat_id",
        none("agent_id"), none("agent_kind"), none("effort"), (F.col("row_cost_nd") / 1e9).alias("reported_cost"),
    )
    return Tables(records, _no_events(spark))


@provider("ledger")
def _ledger(spark: SparkSession, roots: Sequence[str], now: datetime | None) -> Tables:
    files = [stores.known(stores.read(spark, root), "v1") for root in roots]
    turns = [stores.turns(stores.steps(stores.points(f)), stores.meta(f)) for f in files]
    return Tables(reduce(DataFrame.unionByName, turns), _no_events(spark))
