"""Services and their windows: customers seen as windows, nations as services."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions import text
from tallyspark.functions.moments import moment
from tallyspark.operators import agents, alerts, quota, services, status
from tallyspark.plans import binding as b
from tallyspark.plans import agent_queries, chat_queries
from tallyspark.plans.binding import flat
from tallyspark.plans.catalog import query

NOW = datetime(2024, 1, 30, 12)
_NOW = "TIMESTAMP '2024-01-30 12:00:00'"
_WORST = "row_number() OVER (PARTITION BY service ORDER BY p DESC, pos) = 1"


@query(f"{b.SERVICES} SELECT service, pos, promo AS is_promotional, pool AS is_credit_pool, bonus AS is_bonus FROM b")
def bucket_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-2."""
    return b.buckets(spark, sf_dir).select("service", "pos", services.is_promotional().alias("is_promotional"), services.is_credit_pool().alias("is_credit_pool"), services.is_bonus().alias("is_bonus"))


@query(f"{b.SERVICES} SELECT service, pos FROM tiers WHERE NOT pool QUALIFY tier = min(tier) OVER (PARTITION BY service)")
def core_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-3: with two fallbacks."""
    return services.core_buckets(b.buckets(spark, sf_dir)).select("service", "pos")


@query(f"{b.SERVICES} SELECT service, pos, bucket FROM b WHERE kind = 'weekly' AND NOT bonus QUALIFY row_number() OVER (PARTITION BY service ORDER BY pos) = 1")
def first_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-4."""
    return services.first_of_kind(b.buckets(spark, sf_dir), "weekly").select("service", "pos", "bucket")


@query(f"""{b.SERVICES}, m AS (SELECT service, max(p) FILTER (tier = 0) AS core, max(p) FILTER (tier <= 1) AS real_, max(p) AS any_ FROM tiers GROUP BY 1)
SELECT s.service, coalesce(CASE WHEN core IS NOT NULL OR extra_enabled THEN greatest(core, CASE WHEN extra_enabled THEN least(100.0, extra_percent) END) END, real_, any_, 0.0) AS percent FROM services s LEFT JOIN m USING (service)""")
def headline_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-28."""
    return services.headline(b.buckets(spark, sf_dir), b.services(spark, sf_dir))


_HERO = f"""{b.SERVICES}, cand AS (SELECT service, bucket, p, kind, pos, tier FROM tiers UNION ALL SELECT service, service || '_extra_usage', least(100.0, extra_percent), 'other', 1073741824, 0 FROM services WHERE extra_enabled),
worst AS (SELECT * FROM (SELECT * FROM cand QUALIFY tier = min(tier) OVER (PARTITION BY service)) QUALIFY {_WORST}), sess AS (SELECT service, bucket, p, kind, pos FROM tiers WHERE kind = 'session' AND NOT promo QUALIFY row_number() OVER (PARTITION BY service ORDER BY pos) = 1),
detail AS (SELECT service, bucket, p, pos FROM sess UNION ALL SELECT service, bucket, p, pos FROM worst WHERE service NOT IN (SELECT service FROM sess))"""


@query(f"{_HERO} SELECT service, bucket, CAST(pos AS INTEGER) AS pos, p AS percent FROM worst")
def hero_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-9."""
    from tallyspark.functions.percents import clamped

    return services.hero(b.buckets(spark, sf_dir), b.services(spark, sf_dir)).select("service", "bucket", "pos", clamped("percent").alias("percent"))


@query(f"{_HERO} SELECT service, bucket, CAST(pos AS INTEGER) AS pos FROM detail")
def lead_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-9: the window a detail page leads with."""
    return services.detail_hero(b.buckets(spark, sf_dir), b.services(spark, sf_dir)).select("service", "bucket", "pos")


@query(f"""{_HERO}, wk AS (SELECT t.service, t.bucket, t.pos FROM tiers t JOIN detail d ON d.service = t.service WHERE t.bucket = 'seven_day' AND d.bucket <> 'seven_day' QUALIFY row_number() OVER (PARTITION BY t.service ORDER BY t.pos) = 1),
rest AS (SELECT c.* FROM cand c JOIN detail d ON d.service = c.service WHERE c.tier = 0 AND c.bucket <> d.bucket QUALIFY row_number() OVER (PARTITION BY c.service ORDER BY c.p DESC, c.pos) = 1)
SELECT service, bucket, CAST(pos AS INTEGER) AS pos FROM wk UNION ALL SELECT service, bucket, CAST(pos AS INTEGER) FROM rest WHERE service NOT IN (SELECT service FROM wk)""")
def secondary_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-10."""
    from tallyspark.functions.frames import ranked

    rows = services.secondary(b.buckets(spark, sf_dir), b.services(spark, sf_dir))
    return ranked(rows, ["service"], [F.col("pos")], 1).select("service", "bucket", "pos")


@query(f"""{b.SERVICES} SELECT t.service, bucket, CAST(pos AS INTEGER) AS pos, percent FROM tiers t JOIN services s ON s.service = t.service WHERE s.state = 'ok' OR resets_at IS NULL OR resets_at > {_NOW} ORDER BY s.state <> 'ok', tier, percent DESC, t.service, pos LIMIT 1""")
def fullest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-11."""
    return services.fullest(b.buckets(spark, sf_dir), b.services(spark, sf_dir), NOW).select("service", "bucket", "pos", "percent")


@query(f"""{b.SERVICES}, r AS (SELECT t.*, bool_or(kind <> 'modelSpecific') OVER (PARTITION BY t.service) AS core FROM tiers t JOIN services s ON s.service = t.service WHERE s.state = 'ok' AND NOT bonus)
SELECT service, bucket, p AS percent, CAST(pos AS INTEGER) AS pos FROM r WHERE (kind <> 'modelSpecific' OR NOT core) AND p >= 90 ORDER BY p DESC, service, window_seconds NULLS LAST, pos LIMIT 1""")
def most_urgent_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-14."""
    return services.most_urgent(b.buckets(spark, sf_dir), b.services(spark, sf_dir)).select("service", "bucket", "percent", "pos")


@query(f"""{b.SERVICES}, s AS (SELECT service, bucket, pos FROM tiers WHERE kind = 'session' AND NOT promo QUALIFY row_number() OVER (PARTITION BY service ORDER BY pos) = 1), o AS (SELECT service, bucket, pos FROM tiers WHERE NOT bonus QUALIFY {_WORST})
SELECT service, bucket, CAST(pos AS INTEGER) AS pos FROM s UNION ALL SELECT service, bucket, CAST(pos AS INTEGER) FROM o WHERE service NOT IN (SELECT service FROM s)""")
def burn_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-17."""
    return services.burn_bucket(b.buckets(spark, sf_dir)).select("service", "bucket", "pos")


@query(f"""{b.SERVICES}, worst AS (SELECT * FROM (SELECT * FROM tiers QUALIFY tier = min(tier) OVER (PARTITION BY service)) QUALIFY {_WORST}), sess AS (SELECT service, bucket, pos FROM tiers WHERE kind = 'session' AND NOT promo QUALIFY row_number() OVER (PARTITION BY service ORDER BY pos) = 1),
lead_ AS (SELECT service, bucket FROM sess UNION ALL SELECT service, bucket FROM worst WHERE service NOT IN (SELECT service FROM sess)) SELECT t.service, CAST(t.pos AS INTEGER) AS pos, CAST(row_number() OVER (PARTITION BY t.service ORDER BY CASE WHEN t.bucket = l.bucket THEN 0 WHEN NOT promo THEN 1 ELSE 2 END, t.pos) AS INTEGER) AS ring FROM tiers t JOIN lead_ l ON l.service = t.service""")
def ring_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-16."""
    return services.ring_order(b.buckets(spark, sf_dir)).select("service", "pos", "ring")


@query(f"{b.SERVICES} SELECT service, CASE WHEN service = 'n7' AND state = 'ok' THEN -1 WHEN service = 'n3' THEN 0 WHEN service = 'n7' THEN 1 ELSE 2 END AS place FROM services")
def display_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-15."""
    return services.display_order(b.services(spark, sf_dir), ["n3", "n7"], "n7", True).select("service", "place")


@query(f"{b.SERVICES} SELECT service, bucket, CAST(credit_used AS DOUBLE) AS used, CAST(credit_limit AS DOUBLE) AS \"limit\" FROM buckets WHERE credit_limit IS NOT NULL UNION ALL SELECT service, 'extra_usage', extra_used, CAST(extra_limit AS DOUBLE) FROM services WHERE extra_enabled")
def dollar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-18."""
    return services.dollar_rows(b.buckets(spark, sf_dir), b.services(spark, sf_dir))


@query(f"{b.SERVICES}, t AS (SELECT service, extra_used / 20 AS earlier, extra_used / 250 AS outside FROM services) SELECT service, part, points FROM (SELECT service, 'earlier' AS part, earlier AS points FROM t UNION ALL SELECT service, 'outside', outside FROM t) WHERE points + 1e-9 >= 0.1")
def tail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-19."""
    return services.tail_rows(b.services(spark, sf_dir).select("service", (F.col("extra_used") / 20).alias("earlier"), (F.col("extra_used") / 250).alias("outside")))


@query(f"""{b.SERVICES}, r AS (SELECT t.* FROM tiers t JOIN services s ON s.service = t.service WHERE s.state = 'ok' AND NOT bonus QUALIFY tier = min(tier) OVER (PARTITION BY t.service))
SELECT service, bucket, count(*) AS n, max(percent) AS percent FROM r GROUP BY 1, 2 UNION ALL SELECT service, 'extra_usage', 1, extra_percent FROM services WHERE state = 'ok' AND extra_enabled""")
def watchable_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-6."""
    return services.watchable(b.buckets(spark, sf_dir), b.services(spark, sf_dir)).groupBy("service", "bucket").agg(F.count("*").alias("n"), F.max("percent").alias("percent"))


@query(f"{b.SERVICES} SELECT service, 'weekly_budget' AS bucket, 'weekly' AS kind, week_cost / 40.0 * 100 AS percent FROM services WHERE week_cost > 0")
def budget_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-31."""
    return services.budget_bucket(b.services(spark, sf_dir), 40.0)


@query("SELECT 's' || (user_id % 9) AS service, arg_max(value, (ts, event_id)) AS value, epoch_us(max(ts)) AS fetched_at FROM events WHERE event_type <> 'error' GROUP BY 1")
def last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-8: each service's newest good snapshot."""
    rows = b.events(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("user_id") % 9).cast("string")).alias("service"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("state"), F.struct("ts", "event_id").alias("fetched_at"), "value")
    return flat(services.last_known(rows).select("service", "value", F.col("fetched_at.ts").alias("fetched_at")))


_SNAP = """WITH n AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS service, CASE WHEN n_nationkey % 2 = 0 THEN 'error' ELSE 'ok' END AS state, n_nationkey % 3 = 0 AS has_now, n_nationkey % 5 < 2 AS has_before, n_nationkey % 7 < 4 AS has_stored FROM nation)"""


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = F.col("n_nationkey")
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet")
    make = lambda has, label: rows.select(
        F.concat(F.lit("n"), n.cast("string")).alias("service"), F.when(n % 2 == 0, "error").otherwise("ok").alias("state"), F.lit(label).alias("fetched_at"), F.when(has, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")).alias("buckets")
    )
    return make(n % 3 == 0, "now"), make(n % 5 < 2, "before"), make(n % 7 < 4, "stored")


@query(f"""{_SNAP} SELECT service, state, CASE WHEN state = 'ok' OR has_now THEN 'now' WHEN has_before THEN 'before' WHEN has_stored THEN 'stored' ELSE 'now' END AS fetched_at,
CASE WHEN has_now THEN 'now' WHEN state = 'ok' THEN '' WHEN has_before THEN 'before' WHEN has_stored THEN 'stored' ELSE '' END AS content, state <> 'ok' AND NOT has_now AND (has_before OR has_stored) AS retained FROM n""")
def retained_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-8: failed and empty snapshots take the earlier content."""
    return services.retained(*_snapshots(spark, sf_dir)).select("service", "state", "fetched_at", F.array_join("buckets", "").alias("content"), "retained")


@query(f"{_SNAP} SELECT false AS is_stale, max(CASE WHEN state <> 'ok' AND NOT has_now AND (has_before OR has_stored) THEN CASE WHEN has_before THEN 'before' ELSE 'stored' END END) AS retained_at FROM n")
def poll_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-13."""
    return services.poll_state(services.retained(*_snapshots(spark, sf_dir)))


@query(f"{_SNAP} SELECT service, CASE WHEN state = 'ok' AND NOT has_now AND has_before THEN 'error' ELSE state END AS state, CASE WHEN has_now THEN 1 ELSE 0 END AS n_buckets FROM n")
def missing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-29."""
    now_, before, _ = _snapshots(spark, sf_dir)
    count = lambda df: df.select("service", "state", F.size("buckets").alias("n_buckets"))
    return services.missing_windows(count(now_), count(before))


_INFO = f"{b.SERVICES}, core AS (SELECT service, bucket FROM tiers WHERE NOT pool QUALIFY tier = min(tier) OVER (PARTITION BY service)), h AS (SELECT DISTINCT 'n' || (s_nationkey + 3) AS service, 'old_pool_' || (s_suppkey % 4) AS bucket FROM supplier)"


@query(f"""{_INFO} SELECT DISTINCT service, bucket, is_core, is_live, CASE WHEN is_live THEN '' ELSE 'Old Pool ' || right(bucket, 1) END AS label FROM (SELECT service, bucket, (service, bucket) IN (SELECT (service, bucket) FROM core) AS is_core, true AS is_live FROM buckets
UNION ALL SELECT service, bucket, service NOT IN (SELECT service FROM buckets), false FROM h)""")
def bucket_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-10, SET-2: live windows, then those seen only in history."""
    seen = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("n"), (F.col("s_nationkey") + 3).cast("string")).alias("service"), F.concat(F.lit("old_pool_"), (F.col("s_suppkey") % 4).cast("string")).alias("bucket"))
    rows = services.bucket_infos(b.buckets(spark, sf_dir), seen)
    return rows.select("service", "bucket", "is_core", "is_live", F.when(F.col("is_live"), "").otherwise(F.col("label")).alias("label")).distinct()


@query("SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def alerts_to_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET-4: ids of one table that another lacks."""
    return services.to_clear(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id")), spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id")))


@query("SELECT p_partkey AS id, CASE WHEN count(*) OVER (PARTITION BY p_brand) > 1 THEN p_name ELSE p_brand END AS label FROM part")
def pool_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-19: the short label, unless others share it."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet")
    return services.pool_labels(rows.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("short"), F.col("p_name").alias("full")))


@query("SELECT o_orderkey, CAST(date_diff('second', CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS DOUBLE) AS seconds FROM orders")
def month_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-12."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", services.monthly_window("o_orderdate").alias("seconds"))


@query("""SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 5 = 0 OR l <= 0 THEN 'cold' WHEN l < CASE WHEN event_id % 2 = 0 THEN 300 ELSE 60 END THEN 'closing' ELSE 'warm' END AS state
FROM (SELECT *, event_id % 700 - 100 AS l FROM events)""")
def cache_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-14."""
    e = F.col("event_id")
    rows = b.events(spark, sf_dir).select("event_id", (e % 6 != 0).alias("observed"), (e % 5 != 0).alias("warm"), F.expr("timestampadd(SECOND, cast(event_id % 700 - 100 as int), TIMESTAMP_NTZ '2024-01-30 12:00:00')").alias("expires_at"), F.when(e % 2 == 0, "1h").otherwise("5m").alias("ttl"))
    return rows.select("event_id", services.cache_life(NOW).alias("state"))


@query(f"SELECT event_id, event_id % 3 <> 0 AND (epoch_us({_NOW}) - epoch_us(ts)) / 1e6 < 600 AS fresh FROM events")
def fresh_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-7."""
    rows = b.events(spark, sf_dir).withColumn("version", F.when(F.col("event_id") % 3 == 0, 1).otherwise(2))
    return rows.select("event_id", services.is_fresh("ts", NOW).alias("fresh"))


_SL = """WITH r AS (SELECT 'u' || user_id AS session_id, ts AS written_at, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id // 4 AS DOUBLE) END AS api_ms, CASE WHEN user_id % 2 = 0 THEN 'home' ELSE 'else' END AS dir, event_id % 100 AS pct FROM events),
c AS (SELECT *, lag(api_ms) OVER w AS p, CASE WHEN api_ms IS NULL OR lag(api_ms) OVER w IS NULL OR api_ms < lag(api_ms) OVER w THEN 'none' WHEN api_ms > lag(api_ms) OVER w THEN 'dated' ELSE 'same' END AS what FROM r WINDOW w AS (PARTITION BY session_id ORDER BY written_at)),
g AS (SELECT *, count(*) FILTER (what <> 'same') OVER (PARTITION BY session_id ORDER BY written_at) AS grp FROM c), d AS (SELECT *, max(CASE WHEN what = 'dated' THEN written_at END) OVER (PARTITION BY session_id, grp) AS as_of FROM g),
clock AS (SELECT max(ts) AS now FROM events), newest AS (SELECT d.* FROM d, clock WHERE epoch_us(now) - epoch_us(written_at) <= 864000000000 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY written_at DESC) = 1)
"""


def _statusline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = b.events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").alias("written_at"), F.when(e % 11 != 0, F.floor(e / 4).cast("double")).alias("api_ms"), F.when(F.col("user_id") % 2 == 0, "home").otherwise("else").alias("config_dir"),
        F.struct((e % 100).cast("double").alias("percent"), F.expr("TIMESTAMP_NTZ '2024-02-20 00:00:00'").alias("resets_at")).alias("five_hour"), F.struct(F.lit(None).cast("double").alias("percent"), F.lit(None).cast("timestamp_ntz").alias("resets_at")).alias("seven_day"),
    )
    return services.statusline_sessions(rows, b.now(spark, sf_dir), 864_000)


@query(f"{_SL} SELECT session_id, epoch_us(written_at) AS written_at, coalesce(epoch_us(as_of), -1) AS as_of FROM newest")
def statusline_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-11, STM-16, SRC-30: when a session's numbers were fresh (ten days, as the events are sparse)."""
    return flat(_statusline(spark, sf_dir).select("session_id", "written_at", "as_of")).withColumn("as_of", F.coalesce("as_of", F.lit(-1)))


@query(f"{_SL} SELECT session_id, epoch_us(as_of) AS as_of, CAST(pct AS DOUBLE) AS percent FROM newest, clock WHERE dir = 'home' AND as_of IS NOT NULL AND abs(epoch_us(now) - epoch_us(as_of)) <= 864000000000 ORDER BY newest.as_of DESC, session_id LIMIT 1")
def statusline_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-9: the session whose numbers count."""
    out = services.statusline_winner(_statusline(spark, sf_dir), "home", b.now(spark, sf_dir), 864_000)
    return flat(out.select("session_id", "as_of", F.col("five_hour.percent").alias("percent")))


@query()
def statusline_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-9: all windows, one service's with the winner's percents; tested by hand."""
    at = b.now(spark, sf_dir)
    winner = services.statusline_winner(_statusline(spark, sf_dir), "home", at, 864_000)
    rows = services.statusline_merged(b.buckets(spark, sf_dir), b.services(spark, sf_dir), winner, "n1", at)
    return flat(rows.select("service", "bucket", "percent", "pos", "source"))


@query(f"{b.SERVICES} SELECT service, name, state, bucket, label, percent, coalesce(epoch_us(resets_at), -1) AS resets_at, CAST(pos AS INTEGER) AS pos FROM buckets JOIN services USING (service)")
def widget_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-7."""
    return flat(status.widget(b.services(spark, sf_dir), b.buckets(spark, sf_dir))).withColumn("resets_at", F.coalesce("resets_at", F.lit(-1)))


@query(f"{b.SERVICES} SELECT 2 AS version, s.service, s.state, bucket, percent, kind FROM services s LEFT JOIN buckets USING (service)")
def status_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3: the document written and read back, one row for each window."""
    return status.parsed(_document(spark, sf_dir))


def _document(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat_queries._summary(spark, sf_dir).withColumn("service", F.concat(F.lit("n"), (F.substring("chat_id", 2, 9).cast("int") % 25).cast("string")))
    costs = b.services(spark, sf_dir).select("service", F.lit(1).alias("today_nd"), F.lit(2).alias("week_nd"), F.lit(3).alias("today_tokens"))
    return status.document(b.services(spark, sf_dir), b.buckets(spark, sf_dir), costs, chats, agents.live(agent_queries._runs(spark, sf_dir)), NOW)


@query(f"""{agent_queries.MACHINE}, l AS (SELECT *, CASE state WHEN 'needsYou' THEN 0 WHEN 'working' THEN 1 WHEN 'done' THEN 2 ELSE 3 END AS rank FROM runs WHERE ended_at IS NULL), n AS (SELECT count(*) FILTER (state = 'needsYou') AS needs_you, count(*) FILTER (state = 'working') AS working FROM l),
placed AS (SELECT source, session_id, state, row_number() OVER (ORDER BY rank, last_event_at DESC, session_id) - 1 AS pos FROM l)
SELECT needs_you, working, CAST(pos AS INTEGER) AS pos, source, session_id, state FROM placed, n WHERE pos < 20""")
def status_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-3: the document's agents, the 20 first, and how many there are of either kind."""
    return status.parsed_agents(_document(spark, sf_dir))


@query(f"{chat_queries.SUMMARY} SELECT chat_id, epoch_us(last_at) AS last_at FROM summary ORDER BY summary.last_at DESC, chat_id LIMIT 7")
def recent_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-12, SNK-5."""
    rows = chat_queries._summary(spark, sf_dir).withColumn("service", F.lit("assistant"))
    return flat(status.get_sessions(rows, None, 7).select("chat_id", "last_at"))


_BURN = f"""{b.READINGS}, r AS (SELECT *, lag(percent) OVER (PARTITION BY service, bucket ORDER BY ts, percent) - percent > 10 AS fell FROM readings, clock WHERE ts >= now - INTERVAL 300 MINUTE), z AS (SELECT service, bucket, max(ts) FILTER (fell) AS reset FROM r GROUP BY 1, 2),
e AS (SELECT service, bucket, count(*) AS n, min(ts) AS a, max(ts) AS z, arg_min(percent, ts) AS pa, arg_max(percent, ts) AS pz FROM r JOIN z USING (service, bucket) WHERE reset IS NULL OR ts >= reset GROUP BY 1, 2),
burn AS (SELECT service, bucket, (pz - pa) / ((epoch_us(z) - epoch_us(a)) / 6e7) AS rate, pz, z FROM e WHERE n >= 2 AND epoch_us(z) - epoch_us(a) >= 30000000)"""


@query(f"""{_BURN}, cur AS (SELECT service, bucket, arg_max(percent, ts) AS percent, make_timestamp((epoch_us(max(ts)) // 18000000000 + 1) * 18000000000) AS resets_at FROM readings WHERE bucket = 'five_hour' GROUP BY 1, 2),
a AS (SELECT c.*, (epoch_us(resets_at) - epoch_us(now)) / 1e6 AS left_, CASE WHEN rate > 0.05 AND pz < 100 THEN (100 - pz) / rate * 60 END AS secs, coalesce((epoch_us(now) - epoch_us(z)) / 1e6 > 600, true) AS stale FROM cur c LEFT JOIN burn USING (service, bucket), clock)
SELECT service, bucket, advice, round(CASE WHEN advice = 'pace' THEN secs END, 3) AS seconds_to_limit FROM (SELECT *, CASE WHEN left_ > 0 THEN CASE WHEN left_ <= 900 AND percent >= 20 THEN 'reset' WHEN percent < 100 AND NOT stale AND secs <= 86400 AND secs < left_ * 10 THEN 'pace' END END AS advice FROM a) WHERE advice IS NOT NULL""")
def pacing_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM-7: a reset within the quarter outranks a fast burn (the reset is taken ten times as far off, so that some show)."""
    at = b.now(spark, sf_dir)
    rows = b.readings(spark, sf_dir)
    burn = quota.burn_rate(rows, at, 300)
    cur = rows.filter("bucket = 'five_hour'").groupBy("service", "bucket").agg(F.max_by("percent", F.struct("ts", "percent")).alias("percent"), F.max("ts").alias("ts"))
    from tallyspark.functions.moments import cell, cell_start, moment, seconds, shifted

    cur = cur.withColumn("resets_at", cell_start(cell("ts", 18_000) + 1, 18_000)).withColumn("kind", F.lit("session"))
    near = alerts.pacing(cur, burn, at, 86_400.0, 20.0, wants_pace=False)
    far = cur.withColumn("resets_at", shifted(moment(at), seconds(moment(at), "resets_at") * 10))
    fast = alerts.pacing(far, burn, at, 86_400.0, 20.0, wants_reset=False).join(near.select("service", "bucket"), ["service", "bucket"], "left_anti")
    return near.unionByName(fast).select("service", "bucket", "advice", F.round("seconds_to_limit", 3).alias("seconds_to_limit"))


@query()
def pace_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-27: whether a window is full before it resets; tested by hand."""
    at = b.now(spark, sf_dir)
    rows = b.readings(spark, sf_dir)
    # the largest of a text sorts all rows, so the kinds, which are few, are told apart first
    each = rows.groupBy("service", "bucket", "kind").agg(F.max("resets_at").alias("resets_at"), F.max("window_seconds").alias("window_seconds"))
    cur = each.groupBy("service", "bucket").agg(F.max("resets_at").alias("resets_at"), F.max("kind").alias("kind"), F.max("window_seconds").alias("window_seconds"))
    return services.pace(cur, quota.burn_rate(rows, at, 300), at).withColumn("elapsed", F.round("elapsed", 6))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_custkey % 3 = 0 AND c_custkey % 7 <> 0)")
def restored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-14: stored windows without pools whose credit is gone."""
    k = F.col("c_custkey")
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", (k % 3 == 0).alias("is_pool"), F.when(k % 7 == 0, 5.0).alias("credit_limit"))
    return services.restore_last_known(rows).select("c_custkey", "c_nationkey")


@query(f"""{b.SERVICES}, l AS (SELECT service, pos, resets_at, date_diff('second', {_NOW}, resets_at) AS s, date_diff('day', CAST({_NOW} AS DATE), CAST(resets_at AS DATE)) AS d FROM buckets),
t AS (SELECT *, CASE WHEN s <= 0 THEN 'now' WHEN s >= 90000 THEN 'in ' || (s // 86400) || 'd ' || (s // 3600 % 24) || 'h' WHEN s >= 3600 THEN 'in ' || (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE 'in ' || (s // 60) || 'm' END AS relative,
  CASE WHEN d = 0 THEN strftime(resets_at, '%H:%M') WHEN d BETWEEN 1 AND 6 THEN strftime(resets_at, '%a %H:%M') ELSE strftime(resets_at, '%b %-d, %H:%M') END AS absolute FROM l WHERE resets_at IS NOT NULL)
SELECT service, CAST(pos AS INTEGER) AS pos, relative, absolute, CASE WHEN s <= 0 THEN 'resets now' WHEN s <= 3600 THEN 'resets ' || relative ELSE 'resets ' || relative || ' (' || absolute || ')' END AS "both" FROM t""")
def reset_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN-9: when each window resets, in words."""
    rows = b.buckets(spark, sf_dir).filter("resets_at is not null")
    return rows.select("service", "pos", *(c.alias(n) for n, c in text.reset_texts("resets_at", moment(NOW)).items()))
