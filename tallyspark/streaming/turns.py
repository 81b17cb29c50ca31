"""Turns as a stream: windows with a watermark. What keeps a table of them is `streaming.ledger`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def half_hours(turns: DataFrame, late: str = "1 day") -> DataFrame:
    """Turns by half hour and chat. On a stream, a bin is final once the watermark has passed it; a batch counts all at once."""
    rows = turns.withWatermark("ts", late) if turns.isStreaming else turns
    return rows.groupBy(F.window("ts", "30 minutes"), "chat_id").agg(F.count("*").alias("turns")).select(F.col("window.start").alias("bin"), "chat_id", "turns")
