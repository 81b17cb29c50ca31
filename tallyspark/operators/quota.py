"""Quota readings over time: burn rate, resets, consumption, peaks, series."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.frames import ranked, running, written
from tallyspark.functions.moments import cell, day, last_days, micros, moment, seconds
from tallyspark.functions.percents import clamped

KEYS = ["service", "bucket"]
#: A fall of more than this starts burn rate anew; a fall of at least `RESET_DROP` that holds is a limit window's reset.
BURN_DROP, RESET_DROP = 10.0, 5.0
STALE_S, LOOKBACK_MIN, CAPACITY = 600, 30.0, 95.0
_DAY = 86_400


def since_last_reset(readings: DataFrame, drop: float = BURN_DROP) -> DataFrame:
    """Each bucket's readings from its last fall of more than `drop` on."""
    rows = running(readings, KEYS, ["ts", "percent"], cell("ts", _DAY), lag={"_before": "percent"})
    ends = rows.groupBy(*KEYS).agg(F.max(F.when(F.col("_before") - F.col("percent") > drop, F.struct("ts", "percent"))).alias("_reset"))
    kept = rows.drop("_before").join(ends, KEYS)
    return kept.filter(F.col("_reset").isNull() | (F.struct("ts", "percent") >= F.col("_reset"))).select(*readings.columns)


def burn_rate(readings: DataFrame, now: datetime, lookback_min: float = LOOKBACK_MIN) -> DataFrame:
    """Percent a minute of each bucket since its last reset within the lookback, and seconds to the limit at that pace.

    Buckets with fewer than two readings, or less than half a minute between the first and last, have no row. There are no
    seconds to the limit at 0.05 a minute or less, or at the limit. `is_stale`: the newest reading is over ten minutes old.
    """
    recent = readings.filter(F.col("ts") >= moment(now - timedelta(minutes=lookback_min))).filter("percent is not null")
    at = F.struct("ts", "percent")
    ends = since_last_reset(recent).groupBy(*KEYS).agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    minutes = seconds("a.ts", "b.ts") / 60
    ends = ends.filter("n >= 2").withColumn("minutes", minutes).filter("minutes >= 0.5")
    rate = (F.col("b.percent") - F.col("a.percent")) / F.col("minutes")
    left = F.lit(100.0) - F.col("b.percent")
    return ends.select(
        *KEYS, F.col("b.percent").alias("percent"), F.greatest(F.lit(0.0), rate).alias("percent_per_minute"),
        F.when((rate > 0.05) & (left > 0), left / rate * 60).alias("seconds_to_limit"), (seconds("b.ts", moment(now)) > STALE_S).alias("is_stale"),
    )


def resets(readings: DataFrame, drop: float = RESET_DROP) -> DataFrame:
    """Falls of at least `drop` that hold: the next reading, if there is one, is as far below too.

    One row for each: `last_before` and `first_after`, the readings it lies between.
    """
    rows = running(readings.filter("percent is not null").withColumn("percent", clamped("percent")), KEYS, ["ts", "percent"], cell("ts", _DAY), lag={"_p": "percent", "_t": "ts"}, lead={"_q": "percent"})
    held = (F.col("_p") - F.col("percent") >= drop) & (F.col("_q").isNull() | (F.col("_p") - F.col("_q") >= drop))
    return rows.filter(held).select(*KEYS, F.col("_t").alias("last_before"), F.col("ts").alias("first_after"), F.col("_p").alias("level"), F.col("percent").alias("landed"))


def consumption(readings: DataFrame) -> DataFrame:
    """What each bucket consumed by hour of the day: rises only, a fall is a window that starts over."""
    rows = running(readings.filter("percent is not null").withColumn("percent", clamped("percent")), KEYS, ["ts", "percent"], cell("ts", _DAY), lag={"_p": "percent"})
    rise = F.greatest(F.lit(0.0), F.col("percent") - F.col("_p"))
    return rows.filter("percent > _p").groupBy(*KEYS, F.hour("ts").alias("hour")).agg(F.sum(rise).alias("consumed"))


def most_consumed(consumed: DataFrame) -> DataFrame:
    """Each service's largest bucket (never the sum: a session and its week move on the same work) and busiest hour (the
    first of equal ones)."""
    buckets = consumed.groupBy(*KEYS).agg(F.sum("consumed").alias("consumed")).groupBy("service").agg(F.max("consumed").alias("consumed"))
    hours = consumed.groupBy("service", "hour").agg(F.sum("consumed").alias("c")).groupBy("service").agg(F.min_by("hour", F.struct(-F.col("c"), F.col("hour"))).alias("busiest_hour"))
    return buckets.join(hours, "service")


def series(readings: DataFrame, start: datetime, end: datetime, most: int = 500) -> DataFrame:
    """Each bucket's readings from `start` to `end`, at most `most`: the highest of each of as many equal spans, at its own
    time (the earliest of equal ones). One aggregate; a bucket's points are bounded."""
    length = (end - start).total_seconds()
    inside = readings.filter((F.col("ts") >= moment(start)) & (F.col("ts") <= moment(end)) & F.col("percent").isNotNull())
    at = F.least(F.lit(most - 1), F.floor(seconds(moment(start), "ts") / F.lit(length / most)).cast("int")) if length > 0 else F.lit(0)
    rows = inside.withColumns({"percent": clamped("percent"), "bin": at})
    best = rows.groupBy(*KEYS, "bin").agg(F.min(F.struct((-F.col("percent")).alias("p"), "ts")).alias("_x"))
    return best.select(*KEYS, "bin", F.col("_x.ts").alias("ts"), (-F.col("_x.p")).alias("percent"))


def daily_peaks(readings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each service's highest percent of each day and the bucket that made it; of equal ones the earliest reading's, then the
    first listed bucket's (`pos`, if there is one, else its id). Days without a reading are absent."""
    keys = keys or ["service"]
    pos = F.col("pos") if "pos" in readings.columns else F.col("bucket")
    rows = readings.filter("percent is not null").withColumn("percent", clamped("percent"))
    best = rows.groupBy(*keys, day("ts").alias("day")).agg(F.min_by(F.struct("percent", "bucket"), F.struct(-F.col("percent"), F.col("ts"), pos)).alias("_x"))
    return best.select(*keys, "day", F.col("_x.percent").alias("peak"), F.col("_x.bucket").alias("peak_bucket"))


def days_at_capacity(readings: DataFrame, now: datetime, n: int = 7, capacity: float = CAPACITY) -> DataFrame:
    """Of the last `n` days, how many peaked at the limit and how many were observed, by service."""
    peaks = daily_peaks(readings.filter(last_days(day("ts"), now, n)))
    return peaks.groupBy("service").agg(F.count_if(F.col("peak") >= capacity).alias("at_capacity"), F.count("*").alias("observed"))


def calendar_summary(readings: DataFrame, start: datetime, now: datetime, capacity: float = CAPACITY) -> DataFrame:
    """Days at the limit and observed from `start` to the end of today, by service."""
    tomorrow = datetime(now.year, now.month, now.day) + timedelta(days=1)
    peaks = daily_peaks(in_calendar(readings, start, tomorrow))
    return peaks.groupBy("service").agg(F.count_if(F.col("peak") >= capacity).alias("days_at_limit"), F.count("*").alias("days_observed"))


def in_calendar(readings: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return readings.filter((F.col("ts") >= moment(start)) & (F.col("ts") < moment(end)))


def insights(readings: DataFrame, now: datetime, capacity: float = CAPACITY) -> DataFrame:
    """The quota figures of each service."""
    peaks = daily_peaks(readings)
    out = peaks.groupBy("service").agg(
        F.count_if(F.col("peak") >= capacity).alias("days_at_capacity"), F.count("*").alias("days_observed"), F.avg("peak").alias("average_daily_peak"),
        F.min_by(F.struct("day", "peak", "peak_bucket"), F.struct(-F.col("peak"), F.col("day"))).alias("_b"),
        F.max(F.when(F.col("day") == F.lit(now.date()), F.col("peak"))).alias("today_peak"),
    )
    used = most_consumed(consumption(readings))
    out = out.join(used, "service", "left")
    return out.select(
        "service", "days_at_capacity", "days_observed", "average_daily_peak", F.col("_b.day").alias("busiest_day"), F.col("_b.peak").alias("busiest_peak"),
        F.col("_b.peak_bucket").alias("busiest_bucket"), "today_peak", F.when(F.col("consumed") > 0, F.col("consumed") / F.col("days_observed")).alias("average_daily_consumption"), "busiest_hour",
    )


def nearest(points: DataFrame, at: datetime, start: datetime, end: datetime, share: float = 0.01) -> DataFrame:
    """Each bucket's point nearest to `at`, within a hundredth of the range; of equally near ones the earlier."""
    reach = (end - start).total_seconds() * share
    off = F.abs(seconds("ts", moment(at)))
    close = points.withColumn("_off", off).filter(F.col("_off") <= reach)
    return close.groupBy(*KEYS).agg(F.min_by(F.struct("ts", "percent"), F.struct("_off", "ts")).alias("_x")).select(*KEYS, "_x.*")


def hover(points: DataFrame, at: datetime, start: datetime, end: datetime, most: int = 3) -> DataFrame:
    """The `most` fullest of the nearest points of a service's buckets."""
    return ranked(nearest(points, at, start, end), ["service"], [F.desc("percent"), F.col("bucket")], most)


def with_live(readings: DataFrame, live: DataFrame) -> DataFrame:
    """`readings` and each bucket's live percent (service, bucket, ts, percent), where it is newer or higher than the last."""
    last = readings.groupBy(*KEYS).agg(F.max(F.struct("ts", "percent")).alias("_last"))
    new = live.join(last, KEYS, "left").filter(F.col("_last").isNull() | (F.col("ts") > F.col("_last.ts")) | (F.col("percent") > F.col("_last.percent")))
    return readings.unionByName(new.drop("_last"), allowMissingColumns=True)


def throttled(readings: DataFrame, gap_s: int = 30) -> DataFrame:
    """The snapshots (service, ts, …) that the history keeps: each service's first, then each at least `gap_s` after the last
    kept one.

    Each time's successor is the first time at least `gap_s` later. A time that is `gap_s` or more after its neighbour is kept
    whatever came before; from these on, the kept times are found by pointer doubling: each round marks what the marked times
    jump to and doubles the jumps. The rounds grow with the logarithm of the longest burst, and no burst is collected.
    """
    times = readings.select("service", "ts").distinct()
    cut = running(times, ["service"], ["ts"], cell("ts", _DAY), lag={"_p": "ts"})
    cut = written(cut.select("service", micros("ts").alias("t"), (F.col("_p").isNull() | (seconds("_p", "ts") >= gap_s)).alias("first")))
    # from the latest on, the last time met before a wanted one (t + gap) is its successor; a time comes before an equal wanted one
    met = cut.select("service", F.col("t").alias("at"), F.lit(0).alias("wanted"), F.col("t").alias("time"), F.lit(None).cast("long").alias("from"))
    wanted = F.col("t") + gap_s * 1_000_000
    line = met.union(cut.select("service", wanted.alias("at"), F.lit(1), F.lit(None).cast("long"), F.col("t")))
    line = line.withColumn("back", -F.col("at"))
    jumps = running(line, ["service"], ["back", "wanted"], F.floor(F.col("back") / F.lit(_DAY * 1_000_000)).cast("long"), last={"to": F.col("time")})
    jumps = written(jumps.filter("wanted = 1 and to is not null").select("service", F.col("from").alias("t"), "to"))
    kept = written(cut.filter("first").select("service", "t"))
    n, before = kept.count(), -1
    while n != before:
        kept = written(kept.union(kept.join(jumps, ["service", "t"]).select("service", F.col("to").alias("t"))).distinct())
        n, before = kept.count(), n
        jumps = written(jumps.join(jumps.select("service", F.col("t").alias("to"), F.col("to").alias("_next")), ["service", "to"]).select("service", "t", F.col("_next").alias("to")))
    kept = kept.select("service", F.timestamp_micros("t").cast("timestamp_ntz").alias("ts"))
    return readings.join(kept, ["service", "ts"], "left_semi")


def bucket_ids(readings: DataFrame) -> DataFrame:
    return readings.select("service", "bucket").distinct()


def records_since(readings: DataFrame, cutoff: datetime) -> DataFrame:
    return readings.filter(F.col("ts") >= moment(cutoff))


def by_service(readings: DataFrame) -> DataFrame:
    return readings.groupBy("service").agg(F.count("*").alias("readings"), F.countDistinct("bucket").alias("buckets"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


def named_resets(readings: DataFrame, moved_s: float = 60.0) -> DataFrame:
    """Resets that a window's readings tell by themselves: the named reset moved by at least `moved_s`, and the old one had
    passed at that reading. Once for each old reset."""
    rows = running(readings.filter("resets_at is not null"), KEYS, ["ts", "percent"], cell("ts", _DAY), lag={"_old": "resets_at"})
    fresh = rows.filter((F.abs(seconds("_old", "resets_at")) >= moved_s) & (F.col("_old") <= F.col("ts")))
    return fresh.groupBy(*KEYS, F.col("_old").alias("old_reset")).agg(F.min(F.struct("ts", "resets_at")).alias("_x")).select(*KEYS, "old_reset", F.col("_x.ts").alias("seen_at"), F.col("_x.resets_at").alias("new_reset"))


def ranked_within(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
