"""One row for each response, whatever was logged twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.frames import first_of
from tallyspark.functions.models import is_synthetic
from tallyspark.functions.moments import col
from tallyspark.functions.text import title
from tallyspark.schema import COUNTERS


def composite_id() -> Column:
    """The id of a record; a record without one is known by its time, model and counters."""
    made = F.concat_ws("|", F.col("ts").cast("string"), "model", *(F.col(c).cast("string") for c in COUNTERS))
    return F.coalesce(F.nullif(F.col("msg_id"), F.lit("")), made)


def later_readings(records: DataFrame, counters: tuple[str, ...] = COUNTERS) -> DataFrame:
    """One row for each msg_id: all that its first record says but the counters, which are those of the record with the
    largest output (the earliest of these).

    Both halves are order-free aggregates, combined before the one shuffle: the same rows whatever the order of ingest, and
    an id that was replayed a million times is a handful of rows by then.
    """
    own = [c for c in records.columns if c not in counters and c != "msg_id"]
    rows = records.withColumn("msg_id", composite_id())
    found = rows.groupBy("msg_id").agg(
        F.min_by(F.struct(*own), "seq").alias("_first"),
        F.max_by(F.struct(*counters), F.struct(F.col("output"), -F.col("seq"))).alias("_most"),
    )
    return found.select("msg_id", "_first.*", "_most.*").select(*records.columns)


def first_events(records: DataFrame, key: str = "event_id") -> DataFrame:
    """The first record of each event id."""
    return first_of(records, [key], [F.col("seq")]).select(*records.columns)


def without_synthetic(turns: DataFrame) -> DataFrame:
    """Only real models; after the dedup, so that a synthetic record still claims its id."""
    return turns.filter(~is_synthetic("model"))


def distinct_events(events: DataFrame) -> DataFrame:
    """Chat events by whole seconds, each once."""
    return events.select("chat_id", F.date_trunc("SECOND", "at").cast("timestamp_ntz").alias("at"), "kind", "text").distinct()


def ordered_times(events: DataFrame) -> DataFrame:
    """Each chat's event times, sorted, each once. A chat's events are people's prompts and compactions within 31 days."""
    return distinct_events(events).groupBy("chat_id", "kind").agg(F.array_sort(F.collect_set("at")).alias("times"))


def titles(events: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """chat_id and title: a name from the index, else the last title, else the first prompt; chats with none are absent."""
    said = events.filter(F.col("kind").isin("title", "prompt")).withColumn("text", title("text")).filter("text is not null and chat_id <> ''")
    found = said.groupBy("chat_id").agg(
        F.max_by(F.when(F.col("kind") == "title", F.col("text")), F.when(F.col("kind") == "title", F.col("seq"))).alias("_title"),
        F.min_by(F.when(F.col("kind") == "prompt", F.col("text")), F.when(F.col("kind") == "prompt", F.col("seq"))).alias("_prompt"),
    )
    if names is None:
        return found.select("chat_id", F.coalesce("_title", "_prompt").alias("title"))
    both = found.join(names.select("chat_id", "name"), "chat_id", "full")
    return both.select("chat_id", F.coalesce("name", "_title", "_prompt").alias("title"))


def newest_names(index: DataFrame) -> DataFrame:
    """The name of each chat in an index of (chat_id, name, updated_at, seq): the newest; of equal ones the later line."""
    return index.filter("chat_id <> '' and name is not null").groupBy("chat_id").agg(F.max_by("name", F.struct("updated_at", "seq")).alias("name"))


def stable_hash(c: str | Column) -> Column:
    return F.xxhash64(col(c))
