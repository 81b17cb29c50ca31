"""Quota readings over time."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import quota
from tallyspark.plans import binding as b
from tallyspark.plans.binding import flat
from tallyspark.plans.catalog import query

_LAG = "lag(percent) OVER (PARTITION BY service, bucket ORDER BY ts, percent)"
_LEAD = "lead(percent) OVER (PARTITION BY service, bucket ORDER BY ts, percent)"
RESETS = f"""resets AS (SELECT service, bucket, lag_ts AS last_before, ts AS first_after, p AS level, percent AS landed FROM (SELECT *, {_LAG} AS p, {_LEAD} AS q, lag(ts) OVER (PARTITION BY service, bucket ORDER BY ts, percent) AS lag_ts FROM readings)
WHERE p - percent >= 5 AND (q IS NULL OR p - q >= 5))"""


@query(f"""{b.READINGS}, r AS (SELECT *, {_LAG} - percent > 10 AS fell FROM readings, clock WHERE ts >= now - INTERVAL 300 MINUTE), z AS (SELECT service, bucket, max(ts) FILTER (fell) AS reset FROM r GROUP BY 1, 2),
k AS (SELECT r.*, (SELECT now FROM clock) AS at_ FROM r JOIN z USING (service, bucket) WHERE z.reset IS NULL OR r.ts >= z.reset), e AS (SELECT service, bucket, min(at_) AS at_, count(*) AS n, min(ts) AS a, max(ts) AS z, arg_min(percent, ts) AS pa, arg_max(percent, ts) AS pz FROM k GROUP BY 1, 2),
f AS (SELECT *, (pz - pa) / ((epoch_us(z) - epoch_us(a)) / 1e6 / 60) AS rate FROM e WHERE n >= 2 AND (epoch_us(z) - epoch_us(a)) / 1e6 >= 30)
SELECT service, bucket, pz AS percent, round(greatest(0.0, rate), 6) AS percent_per_minute, round(CASE WHEN rate > 0.05 AND pz < 100 THEN (100 - pz) / rate * 60 END, 3) AS seconds_to_limit, (epoch_us(at_) - epoch_us(z)) / 1e6 > 600 AS is_stale FROM f""")
def burn_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-1, WIN-2 (over five hours, as the readings are sparse)."""
    out = quota.burn_rate(b.readings(spark, sf_dir), b.now(spark, sf_dir), 300)
    return out.withColumns({"percent_per_minute": F.round("percent_per_minute", 6), "seconds_to_limit": F.round("seconds_to_limit", 3)})


@query(f"{b.READINGS}, r AS (SELECT *, {_LAG} AS p FROM readings) SELECT service, bucket, CAST(hour(ts) AS INTEGER) AS hour, sum(percent - p) AS consumed FROM r WHERE percent > p GROUP BY 1, 2, 3")
def consumption_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-3."""
    return quota.consumption(b.readings(spark, sf_dir))


@query(f"""{b.READINGS}, s AS (SELECT now - INTERVAL 2 DAY AS a, now AS z FROM clock), r AS (SELECT service, bucket, ts, percent, least(199, CAST(floor((epoch_us(ts) - epoch_us(a)) / 1e6 / (172800.0::DOUBLE / 200)) AS INTEGER)) AS bin FROM readings, s WHERE ts BETWEEN a AND z)
SELECT service, bucket, bin, epoch_us(ts) AS ts, percent FROM r QUALIFY row_number() OVER (PARTITION BY service, bucket, bin ORDER BY percent DESC, ts) = 1""")
def downsampled_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-4, WIN-32: the highest reading of each of 200 spans."""
    at = b.now(spark, sf_dir)
    return flat(quota.series(b.readings(spark, sf_dir), at - timedelta(days=2), at, 200))


@query(f"{b.READINGS}, {RESETS} SELECT service, bucket, epoch_us(last_before) AS last_before, epoch_us(first_after) AS first_after, level, landed FROM resets")
def held_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-5."""
    return flat(quota.resets(b.readings(spark, sf_dir)))


@query(f"{b.READINGS} SELECT service, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, percent AS peak, bucket AS peak_bucket FROM readings QUALIFY row_number() OVER (PARTITION BY service, CAST(ts AS DATE) ORDER BY percent DESC, ts, bucket) = 1")
def daily_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21."""
    return flat(quota.daily_peaks(b.readings(spark, sf_dir)))


_PEAKS = f"{b.READINGS}, peaks AS (SELECT service, CAST(ts AS DATE) AS d, max(percent) AS peak, arg_min(bucket, (-percent, ts, bucket)) AS peak_bucket FROM readings GROUP BY 1, 2), r AS (SELECT *, {_LAG} AS p FROM readings), c AS (SELECT service, bucket, hour(ts) AS h, percent - p AS d FROM r WHERE percent > p)"


@query(f"""{_PEAKS}, u AS (SELECT service, max(s) AS consumed FROM (SELECT service, bucket, sum(d) AS s FROM c GROUP BY 1, 2) GROUP BY 1), hh AS (SELECT service, arg_min(h, (-s, h)) AS busiest_hour FROM (SELECT service, h, sum(d) AS s FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT service, count(*) FILTER (peak >= 95) AS days_at_capacity, count(*) AS days_observed, round(avg(peak), 6) AS average_daily_peak, CAST(arg_min(d, (-peak, d)) AS VARCHAR) AS busiest_day, max(peak) AS busiest_peak, arg_min(peak_bucket, (-peak, d)) AS busiest_bucket,
max(peak) FILTER (d = day) AS today_peak, round(min(consumed) / count(*), 6) AS average_daily_consumption, CAST(min(busiest_hour) AS INTEGER) AS busiest_hour FROM peaks JOIN u USING (service) JOIN hh USING (service), clock GROUP BY 1""")
def quota_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-22."""
    out = quota.insights(b.readings(spark, sf_dir), b.now(spark, sf_dir))
    return flat(out.withColumns({"average_daily_peak": F.round("average_daily_peak", 6), "average_daily_consumption": F.round("average_daily_consumption", 6)}))


@query(f"{_PEAKS} SELECT service, count(*) FILTER (peak >= 95) AS at_capacity, count(*) AS observed FROM peaks, clock WHERE d > day - 7 GROUP BY 1")
def days_at_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-23."""
    return quota.days_at_capacity(b.readings(spark, sf_dir), b.now(spark, sf_dir))


@query(f"{_PEAKS} SELECT service, count(*) FILTER (peak >= 95) AS days_at_limit, count(*) AS days_observed FROM peaks WHERE d >= DATE '2024-01-12' GROUP BY 1")
def quota_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-35, FLT-9."""
    return quota.calendar_summary(b.readings(spark, sf_dir), datetime(2024, 1, 12), b.now(spark, sf_dir))


@query(f"""{b.READINGS}, t AS (SELECT now - INTERVAL 1 DAY AS at_ FROM clock), n AS (SELECT service, bucket, ts, percent FROM readings, t WHERE abs(epoch_us(ts) - epoch_us(at_)) / 1e6 <= 20 * 864 QUALIFY row_number() OVER (PARTITION BY service, bucket ORDER BY abs(epoch_us(ts) - epoch_us(at_)), ts) = 1)
SELECT service, bucket, epoch_us(ts) AS ts, percent, row_number() OVER (PARTITION BY service ORDER BY percent DESC, bucket) AS rank FROM n""")
def hover_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-29, WIN-33: the nearest point of each window, the fullest first."""
    at = b.now(spark, sf_dir)
    return flat(quota.hover(b.readings(spark, sf_dir), at - timedelta(days=1), at - timedelta(days=20), at))


@query(f"{b.READINGS}, l AS (SELECT service, bucket, arg_max(percent, (ts, percent)) AS p FROM readings GROUP BY 1, 2) SELECT service, bucket, count(*) AS n, max(percent) AS top FROM (SELECT service, bucket, percent FROM readings UNION ALL SELECT service, bucket, 98.5 FROM l WHERE 98.5 > p) GROUP BY 1, 2")
def with_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-14: the live reading counts where it is higher than the last."""
    rows = b.readings(spark, sf_dir)
    live = rows.groupBy("service", "bucket").agg(F.max("ts").alias("ts")).withColumn("percent", F.lit(98.5))
    return quota.with_live(rows, live).groupBy("service", "bucket").agg(F.count("*").alias("n"), F.max("percent").alias("top"))


@query("""WITH RECURSIVE t AS (SELECT service, ts, row_number() OVER (PARTITION BY service ORDER BY ts) AS k FROM (SELECT DISTINCT 's' || (user_id % 3) AS service, ts FROM events)),
kept AS (SELECT service, ts, k FROM t WHERE k = 1 UNION ALL SELECT n.service, n.ts, n.k FROM kept p, LATERAL (SELECT t.service, t.ts, t.k FROM t WHERE t.service = p.service AND epoch_us(t.ts) - epoch_us(p.ts) >= 1800000000 ORDER BY t.ts LIMIT 1) n)
SELECT service, epoch_us(ts) AS ts FROM kept""")
def throttled_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-1 (half an hour, as the readings are sparse)."""
    rows = b.events(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("service"), "ts").distinct()
    return flat(quota.throttled(rows, 1800))


@query(f"{b.READINGS} SELECT service, count(*) AS readings, count(DISTINCT bucket) AS buckets, epoch_us(min(ts)) AS first_at, epoch_us(max(ts)) AS last_at FROM readings, clock WHERE ts >= now - INTERVAL 3 DAY GROUP BY 1")
def recent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-10, AGG-32."""
    return flat(quota.by_service(quota.records_since(b.readings(spark, sf_dir), b.now(spark, sf_dir) - timedelta(days=3))))


@query(f"""{b.READINGS}, r AS (SELECT *, lag(resets_at) OVER (PARTITION BY service, bucket ORDER BY ts, percent) AS old FROM readings WHERE resets_at IS NOT NULL)
SELECT service, bucket, epoch_us(old) AS old_reset, epoch_us(min(ts)) AS seen_at, epoch_us(arg_min(resets_at, ts)) AS new_reset FROM r WHERE abs(epoch_us(resets_at) - epoch_us(old)) >= 60000000 AND old <= ts GROUP BY service, bucket, old""")
def named_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-30: a window's reset moved on after it had passed."""
    return flat(quota.named_resets(b.readings(spark, sf_dir)))
