"""Threshold, pacing and once-per-window alerts, and when they are quiet."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.frames import running, written
from tallyspark.functions.moments import DAY, cell, moment, seconds
from tallyspark.functions.percents import clamped

MID, HIGH, REARM = 80, 95, 3
RESET_LEAD_S = 900.0
KEYS = ["service", "bucket"]

def level_of(percent: Column, mid: int = MID, high: int = HIGH) -> Column:
    return F.when(percent >= high, high).when(percent >= mid, mid).otherwise(0)


def outcome(percent: int, last: int, mid: int = MID, high: int = HIGH, margin: int = REARM) -> tuple[str, int]:
    """What a whole percent does after the level `last` fired: ("fire" | "rearm" | "unchanged", the level held then)."""
    level = high if percent >= high else mid if percent >= mid else 0
    if level > last:
        return "fire", level
    if last > 0 and percent < last - margin:
        return "rearm", level
    return "unchanged", last


def thresholds(readings: DataFrame, mid: int = MID, high: int = HIGH, margin: int = REARM) -> DataFrame:
    """The readings that fire or re-arm an alert: service, bucket, ts, percent, level (held from then on), outcome.

    What a reading does hangs on the level that fired last, but only in part: most readings set the level whatever it was (at
    `high` or above; in the middle, below the margin of `high`; below the margin of `mid`). The others only raise it from
    nothing to `mid` (within the margin of `high`), or only drop `high` to nothing (within the margin of `mid`). So the level
    after a reading follows from the last one that set it and from which of the two others came since, and in which order:
    counts and carried-forward values over slices, no walk. A bucket that oscillates around a line is spread like any other.
    """
    whole = F.round(clamped("percent")).cast("int")
    p, order, slice_ = F.col("percent"), ["ts", "percent"], cell("ts", DAY)
    rows = readings.filter("percent is not null").select(*KEYS, "ts", whole.alias("percent"))
    sets = F.when(p >= high, high).when((p >= mid) & (p < high - margin), mid).when((p < mid) & (p < mid - margin), 0)
    kind = F.when(sets.isNotNull(), F.concat(F.lit("set "), sets)).when(p >= mid, "raises").when(p < high - margin, "drops")
    rows = rows.withColumn("_kind", kind).filter("_kind is not null")  # the rest does nothing
    # a reading that does what the one before it did changes nothing
    rows = written(running(rows, KEYS, order, slice_, lag={"_before": "_kind"}).filter("_before is null or _before <> _kind").drop("_before"))
    is_ = lambda k: (F.col("_kind") == k).cast("long")
    rows = rows.withColumns({"_sets": sets, "_d": is_("drops"), "_r": is_("raises"), "_s": F.col("_kind").startswith("set").cast("long")})
    rows = running(rows, KEYS, order, slice_, total={"_drops": F.col("_d"), "_raises": F.col("_r"), "_seen": F.col("_s")})
    base = F.when(F.col("_sets").isNotNull(), F.struct(F.col("_sets").alias("level"), F.col("_drops").alias("drops"), F.col("_raises").alias("raises")))
    rows = written(running(rows, KEYS, order, slice_, last={"_base": base}))
    level, drops, raises = F.coalesce("_base.level", F.lit(0)), F.col("_drops") - F.coalesce("_base.drops", F.lit(0)), F.col("_raises") - F.coalesce("_base.raises", F.lit(0))
    # from `high`, only what raises after the first drop counts
    first_drop = F.when((F.col("_kind") == "drops") & (drops == 1), F.struct(F.col("_seen").alias("base"), F.col("_raises").alias("raises")))
    rows = running(rows.withColumns({"_level": level, "_dropped": drops, "_raised": raises}), KEYS, order, slice_, last={"_drop": first_drop})
    again = F.coalesce((F.col("_drop.base") == F.col("_seen")) & (F.col("_raises") > F.col("_drop.raises")), F.lit(False))
    after = (
        F.when(F.col("_level") == mid, mid)
        .when((F.col("_level") == high) & (F.col("_dropped") == 0), high)
        .when(F.col("_level") == high, F.when(again, mid).otherwise(0))
        .otherwise(F.when(F.col("_raised") > 0, mid).otherwise(0))
    )
    rows = running(written(rows.select(*KEYS, *order, after.cast("int").alias("level"))), KEYS, order, slice_, lag={"_last": "level"})
    last = F.coalesce("_last", F.lit(0))
    what = F.when(level_of(p, mid, high) > last, "fire").when((last > 0) & (p < last - margin), "rearm")
    return rows.select(*KEYS, "ts", "percent", "level", what.alias("outcome")).filter("outcome is not null")


def pacing(buckets: DataFrame, burn: DataFrame, now: datetime, lead_s: float = 1800.0, high_water: float = float(MID), wants_pace: bool = True, wants_reset: bool = True) -> DataFrame:
    """Advice on session windows: `reset` if it starts over within 15 minutes and is fairly full, which outranks `pace`, where
    it is going to be full within the lead and before it resets."""
    rows = buckets.filter("kind = 'session' and resets_at is not null").join(burn.select(*KEYS, "seconds_to_limit", "is_stale"), KEYS, "left")
    left, p = seconds(moment(now), "resets_at"), clamped("percent")
    soon = F.lit(wants_reset) & (left <= RESET_LEAD_S) & (p >= high_water)
    fast = F.lit(wants_pace) & (p < 100) & ~F.coalesce("is_stale", F.lit(True)) & F.coalesce((F.col("seconds_to_limit") <= lead_s) & (F.col("seconds_to_limit") < left), F.lit(False))
    out = rows.withColumn("advice", F.when(left > 0, F.when(soon, "reset").when(fast, "pace"))).filter("advice is not null")
    return out.select(*KEYS, "percent", "advice", F.when(F.col("advice") == "pace", F.col("seconds_to_limit")).alias("seconds_to_limit"), "resets_at")


def once_per_window(candidates: DataFrame, tolerance_s: float = 2.0) -> DataFrame:
    """Alerts (key, ts, window) that fire: not those whose window lies within two seconds of the one that fired last for the key.

    Named windows wander by less than the tolerance, so an alert fires where its window moved by as much from the one before:
    the walk is a lag over the distinct windows of a key, each by its first alert.
    """
    seen = candidates.groupBy("key", "window").agg(F.min("ts").alias("ts"))
    rows = running(seen, ["key"], ["ts", "window"], cell("ts", DAY), lag={"_before": "window"})
    return rows.filter(F.col("_before").isNull() | (F.abs(seconds("_before", "window")) >= tolerance_s)).select("key", "ts", "window")


def in_quiet_hours(hour: Column, start: int, end: int) -> Column:
    if start == end:
        return F.lit(False)
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def summary_due(polls: DataFrame, hour: int, quiet: tuple[int, int] = (0, 0)) -> DataFrame:
    """The polls (ts) that send the daily summary: each day's first at or after `hour` and outside the quiet hours."""
    ok = (F.hour("ts") >= hour) & ~in_quiet_hours(F.hour("ts"), *quiet)
    return polls.filter(ok).groupBy(F.to_date("ts").alias("day")).agg(F.min("ts").alias("ts"))


def gate(rows: DataFrame, quiet: tuple[int, int], enabled: str = "enabled", urgent: str = "urgent", pending: str = "pending") -> DataFrame:
    """Notifications that are shown: enabled, and outside the quiet hours unless urgent; one that waits for a permission has
    its own banner."""
    still = in_quiet_hours(F.hour("ts"), *quiet)
    return rows.filter(F.col(enabled) & (~still | F.col(urgent)) & ~F.col(pending))
