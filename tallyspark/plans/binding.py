"""The driver's tables seen as canonical tables: `events` as turns, readings, chat and agent events, `customer` as windows.

Each binding is given twice: as a DataFrame, and as the SQL that the oracles begin with.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.frames import running
from tallyspark.functions.moments import cell, cell_start, micros
from tallyspark.operators.pricing import DEFAULT, DEFAULT_PRICE, OFFLINE, STAND_IN, costed, priced

HOURS5, WEEK = 18_000, 604_800


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def now(spark: SparkSession, sf_dir: str) -> datetime:
    """The time that queries are asked at: that of the last event."""
    return events(spark, sf_dir).agg(F.max("ts")).first()[0] or datetime(2024, 1, 30)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn for each event."""
    e = F.col("event_id")
    cents = F.round(F.col("value") * 100).cast("long")
    k = F.get_json_object("props", "$.k").cast("long")
    model = (
        F.when(e % 97 == 0, "<synthetic>").when(e % 11 == 0, "claude-opus-9").when(F.col("event_type") == "purchase", "claude-opus-4-8-20260101").when(F.col("event_type") == "click", "claude-sonnet-4-6[1m]")
        .when(F.col("event_type") == "view", "claude-fable-5").when(F.col("event_type") == "signup", "claude-haiku-4-5-20251001").otherwise("grok-4.6-build")
    )
    out = (cents * 7) % 997
    zero = F.lit(0).cast("long")
    return events(spark, sf_dir).select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("provider"), e.cast("string").alias("msg_id"), e.alias("seq"), "ts", model.alias("model"),
        cents.alias("input"), out.alias("output"), (k * 100).alias("cache_read"), F.when(e % 10 == 0, k * 500).otherwise(zero).alias("cache_write_5m"), F.when(e % 20 == 10, k * 30).otherwise(zero).alias("cache_write_1h"),
        F.floor(out / 3).cast("long").alias("thinking"), F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("chat_id"),
        F.when(e % 5 == 0, F.concat(F.lit("a"), (e % 3).cast("string"))).alias("agent_id"), F.when(e % 5 == 0, F.col("event_type")).alias("agent_kind"), F.when(e % 4 == 0, "high").when(e % 4 == 1, " ").alias("effort"),
        F.lit(None).cast("double").alias("reported_cost"),
    )


RECORDS = """
recs AS (
  SELECT 's' || (user_id % 3) AS provider, CAST(event_id AS VARCHAR) AS msg_id, event_id AS seq, ts,
    CASE WHEN event_id % 97 = 0 THEN '<synthetic>' WHEN event_id % 11 = 0 THEN 'claude-opus-9' WHEN event_type = 'purchase' THEN 'claude-opus-4-8-20260101'
      WHEN event_type = 'click' THEN 'claude-sonnet-4-6[1m]' WHEN event_type = 'view' THEN 'claude-fable-5' WHEN event_type = 'signup' THEN 'claude-haiku-4-5-20251001' ELSE 'grok-4.6-build' END AS model,
    CAST(round(value * 100) AS BIGINT) AS input, (CAST(round(value * 100) AS BIGINT) * 7) % 997 AS output, k * 100 AS cache_read,
    CASE WHEN event_id % 10 = 0 THEN k * 500 ELSE 0 END AS cache_write_5m, CASE WHEN event_id % 20 = 10 THEN k * 30 ELSE 0 END AS cache_write_1h,
    ((CAST(round(value * 100) AS BIGINT) * 7) % 997) // 3 AS thinking, 'p' || (user_id % 7) AS project, 'c' || user_id AS chat_id,
    CASE WHEN event_id % 5 = 0 THEN 'a' || (event_id % 3) END AS agent_id, CASE WHEN event_id % 5 = 0 THEN event_type END AS agent_kind,
    CASE WHEN event_id % 4 = 0 THEN 'high' WHEN event_id % 4 = 1 THEN ' ' END AS effort
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
"""
_VALUES = ", ".join(f"('{m}', {', '.join(map(repr, r))})" for m, *r in [*OFFLINE, (DEFAULT, *DEFAULT_PRICE)])
PRICES = f"prices AS (SELECT * FROM (VALUES {_VALUES}) t(model_norm, in_per_m, out_per_m, cache_read_per_m, cw5m_per_m, cw1h_per_m))"
_NORM = "regexp_replace(split_part(lower(model), '[', 1), '-[0-9]{8}$', '')"
_GUESS = " ".join(f"WHEN {_NORM} LIKE '%{f}%' THEN '{STAND_IN[f]}'" for f in ("fable", "mythos", "opus", "haiku", "sonnet"))
#: Display name and family of the ids that the binding uses; the patterns without look-ahead suffice for these.
_NAMED = "regexp_matches(lower(model), 'claude-[a-z]+-[0-9]')"
_VERSION = "regexp_extract(lower(model), 'claude-[a-z]+-([0-9]{1,2})', 1) || CASE WHEN regexp_extract(lower(model), 'claude-[a-z]+-[0-9]{1,2}-([0-9]{1,2})(?:-[0-9]{8})?(?:\\[|$)', 1) <> '' THEN '.' || regexp_extract(lower(model), 'claude-[a-z]+-[0-9]{1,2}-([0-9]{1,2})(?:-[0-9]{8})?(?:\\[|$)', 1) ELSE '' END"
NAME = f"CASE WHEN model LIKE '<%' THEN NULL WHEN {_NAMED} THEN upper(regexp_extract(lower(model), 'claude-([a-z])', 1)) || regexp_extract(lower(model), 'claude-[a-z]([a-z]+)', 1) || ' ' || {_VERSION} ELSE 'Grok ' || regexp_extract(model, 'grok-([0-9.]+)', 1) END"
FAMILY = "CASE WHEN model LIKE '%fable%' THEN 'fable' WHEN model LIKE '%opus%' THEN 'opus' WHEN model LIKE '%sonnet%' THEN 'sonnet' WHEN model LIKE '%haiku%' THEN 'haiku' WHEN model LIKE 'grok%' THEN regexp_extract(model, '^grok-[0-9]+[.-][0-9]+', 0) ELSE 'other' END"
TURNS = f"""
WITH {RECORDS}, {PRICES},
rated AS (SELECT r.*, p.in_per_m, p.out_per_m, p.cache_read_per_m, p.cw5m_per_m, p.cw1h_per_m, x.exact,
    CASE WHEN x.exact THEN 'table' WHEN x.id = '{DEFAULT}' THEN 'default' ELSE 'family' END AS priced_by
  FROM recs r JOIN (SELECT m.model, m.norm IN (SELECT model_norm FROM prices) AS exact, CASE WHEN m.norm IN (SELECT model_norm FROM prices) THEN m.norm ELSE m.guess END AS id
    FROM (SELECT DISTINCT model, {_NORM} AS norm, CASE {_GUESS} ELSE '{DEFAULT}' END AS guess FROM recs) m) x ON x.model = r.model JOIN prices p ON p.model_norm = x.id),
cost_parts AS (SELECT *, CAST(round(in_per_m * 1000 * input) AS BIGINT) AS cost_input, CAST(round(out_per_m * 1000 * output) AS BIGINT) AS cost_output, CAST(round(cache_read_per_m * 1000 * cache_read) AS BIGINT) AS cost_cache_read,
    CAST(round(cw5m_per_m * 1000 * cache_write_5m) AS BIGINT) + CAST(round(cw1h_per_m * 1000 * cache_write_1h) AS BIGINT) AS cost_cache_write, input + output + cache_read + cache_write_5m + cache_write_1h AS tokens FROM rated),
all_turns AS (SELECT *, cost_input + cost_output + cost_cache_read + cost_cache_write AS cost_nd, {NAME} AS name, {FAMILY} AS family FROM cost_parts),
turns AS (SELECT * FROM all_turns WHERE model NOT LIKE '<%'),
clock AS (SELECT max(ts) AS now, date_trunc('day', max(ts)) AS today, CAST(max(ts) AS DATE) AS day FROM events)
"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced and costed turns of real models; a turn's service is its provider."""
    rows = records(spark, sf_dir).filter(~F.col("model").startswith("<"))
    return costed(priced(rows)).withColumn("service", F.col("provider"))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyspark.operators.rollup import daily

    return daily(turns(spark, sf_dir))


DAYS = f"{TURNS}, days AS (SELECT CAST(ts AS DATE) AS day, CAST(sum(cost_nd) AS BIGINT) AS cost_nd, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS turns FROM turns GROUP BY 1)"


def replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turn records with repeats: every fourth is logged again with a larger output under another project, every sixth a third
    time with a smaller one."""
    rows = records(spark, sf_dir)
    e = F.col("seq")
    grown = rows.filter(e % 4 == 0).withColumns({"seq": e + 10**9, "output": F.col("output") + 10, "project": F.lit("replayed")})
    less = rows.filter(e % 6 == 0).withColumns({"seq": e + 2 * 10**9, "output": F.col("output") - 5})
    return rows.unionByName(grown).unionByName(less)


REPLAYS = f"""
WITH {RECORDS},
logged AS (SELECT * FROM recs UNION ALL BY NAME SELECT * REPLACE (seq + 1000000000 AS seq, output + 10 AS output, 'replayed' AS project) FROM recs WHERE seq % 4 = 0
  UNION ALL BY NAME SELECT * REPLACE (seq + 2000000000 AS seq, output - 5 AS output) FROM recs WHERE seq % 6 = 0)
"""


def _numbered(rows: DataFrame, length: int) -> DataFrame:
    """Number of an event within its service's window of `length` seconds."""
    keyed = rows.withColumn("_w", cell("ts", length))
    return running(keyed, ["service", "_w"], ["ts", "event_id"], cell("ts", 3600), total={"_n": F.lit(1)})


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two windows for each service: five hours that fill by 4 points an event, a week that fills by 3/8 for every third.

    Every 40th reading dips by 7 points. Resets are named but for services s2's.
    """
    e = events(spark, sf_dir).select("event_id", "ts", F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("service"))
    dip = F.when(F.col("event_id") % 40 == 0, 7.0).otherwise(0.0)

    def window(rows: DataFrame, bucket: str, kind: str, length: int, step: float) -> DataFrame:
        level = F.least(F.lit(100.0), F.col("_n") * F.lit(step))
        named = F.when(F.col("service") != "s2", cell_start(F.col("_w") + 1, length))
        return _numbered(rows, length).select(
            "service", "ts", F.lit(bucket).alias("bucket"), F.greatest(F.lit(0.0), level - dip).alias("percent"), named.alias("resets_at"), F.lit(float(length)).alias("window_seconds"), F.lit(kind).alias("kind"), F.lit("poll").alias("source"),
            F.col("_w").alias("window_id"),
        )

    return window(e, "five_hour", "session", HOURS5, 4.0).unionByName(window(e.filter("event_id % 3 = 0"), "seven_day", "weekly", WEEK, 0.375))


def _reading_sql(bucket: str, kind: str, length: int, step: float, where: str) -> str:
    n = f"count(*) OVER (PARTITION BY user_id % 3, epoch_us(ts) // {length * 10**6} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
    return (
        f"SELECT 's' || (user_id % 3) AS service, ts, '{bucket}' AS bucket, greatest(0.0, least(100.0, {n} * CAST({step} AS DOUBLE)) - CASE WHEN event_id % 40 = 0 THEN 7.0 ELSE 0.0 END)::DOUBLE AS percent, "
        f"CASE WHEN user_id % 3 <> 2 THEN make_timestamp((epoch_us(ts) // {length * 10**6} + 1) * {length * 10**6}) END AS resets_at, CAST({length} AS DOUBLE) AS window_seconds, '{kind}' AS kind, epoch_us(ts) // {length * 10**6} AS window_id "
        f"FROM events WHERE {where}"
    )


READINGS_CTE = f"readings AS ({_reading_sql('five_hour', 'session', HOURS5, 4.0, 'true')} UNION ALL {_reading_sql('seven_day', 'weekly', WEEK, 0.375, 'event_id % 3 = 0')})"
READINGS = f"WITH {READINGS_CTE}, clock AS (SELECT max(ts) AS now, date_trunc('day', max(ts)) AS today, CAST(max(ts) AS DATE) AS day FROM events)"


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of `readings` that the last event doesn't lie in, and those it does, up to it."""
    at = now(spark, sf_dir)
    rows = []
    for bucket, length, step in (("five_hour", HOURS5, 1), ("seven_day", WEEK, 1)):
        last = int((at - datetime(1970, 1, 1)).total_seconds() // length)
        first = int((at - timedelta(days=31) - datetime(1970, 1, 1)).total_seconds() // length)
        for w in range(first, last + 1, step):
            start = datetime(1970, 1, 1) + timedelta(seconds=w * length)
            rows += [(f"s{s}", bucket, w if bucket == "five_hour" else -w, start, min(at, start + timedelta(seconds=length))) for s in range(3)]
    out = spark.createDataFrame(rows, "service string, bucket string, window_id long, start timestamp_ntz, end timestamp_ntz")
    return out


WINDOWS_CTE = f"""
windows AS (SELECT s.service, w.bucket, w.window_id, w.s AS start, least(w.e, (SELECT max(ts) FROM events)) AS "end"
  FROM (SELECT 's' || i AS service FROM range(3) t(i)) s, (
    SELECT 'five_hour' AS bucket, i AS window_id, make_timestamp(i * {HOURS5} * 1000000) AS s, make_timestamp((i + 1) * {HOURS5} * 1000000) AS e
      FROM (SELECT unnest(range((epoch_us(max(ts)) - 2678400000000) // {HOURS5 * 10**6}, epoch_us(max(ts)) // {HOURS5 * 10**6} + 1)) AS i FROM events)
    UNION ALL SELECT 'seven_day', -i, make_timestamp(i * {WEEK} * 1000000), make_timestamp((i + 1) * {WEEK} * 1000000)
      FROM (SELECT unnest(range((epoch_us(max(ts)) - 2678400000000) // {WEEK * 10**6}, epoch_us(max(ts)) // {WEEK * 10**6} + 1)) AS i FROM events)) w)
"""


def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts (clicks, every third), compactions (every 29th event) and titles (purchases, every 50th) of the chats."""
    e = F.col("event_id")
    kind = F.when(e % 50 == 49, "title").when(e % 29 == 7, "compaction").when((F.col("event_type") == "click") & (e % 3 == 0), "prompt")
    return events(spark, sf_dir).select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("chat_id"), F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("at"), e.alias("seq"), kind.alias("kind"),
        F.concat(F.col("event_type"), F.lit("  about\n"), e.cast("string")).alias("text"),
    ).filter("kind is not null")


CHAT_EVENTS_CTE = """
chat_events AS (SELECT * FROM (SELECT 'c' || user_id AS chat_id, date_trunc('second', ts) AS "at", event_id AS seq,
  CASE WHEN event_id % 50 = 49 THEN 'title' WHEN event_id % 29 = 7 THEN 'compaction' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'prompt' END AS kind,
  event_type || ' about ' || event_id AS text FROM events) WHERE kind IS NOT NULL)
"""


def agent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hook events: a user is a session."""
    e = F.col("event_id")
    kind = (
        F.when(e % 50 == 49, "sessionEnd").when(e % 50 == 25, "notificationIdle").when(e % 13 == 5, "toolFinished").when(F.col("event_type") == "view", "toolStarted").when(F.col("event_type") == "click", "promptSubmitted")
        .when(F.col("event_type") == "purchase", "stop").when(F.col("event_type") == "signup", "sessionStart").when(e % 3 == 0, "unknown").otherwise("permissionRequested")
    )
    tool = F.when(e % 4 == 0, "AskUserQuestion").otherwise("Bash")
    return events(spark, sf_dir).select(
        F.when(F.col("user_id") % 2 == 0, "assistant").otherwise("rollout").alias("source"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), e.alias("seq"), kind.alias("kind"), "ts",
        F.concat(F.lit("/w/p"), (F.col("user_id") % 7).cast("string")).alias("cwd"), tool.alias("tool"), F.concat(F.lit("run "), e.cast("string")).alias("summary"),
        F.when((e % 4 == 0) & (kind == "toolStarted"), "question").alias("attention"), (e % 19 == 0).alias("is_subagent"), F.lit(None).cast("long").alias("pid"), F.lit(None).cast("string").alias("tty"),
    )


AGENT_EVENTS_CTE = """
agent_events AS (SELECT *, CASE WHEN event_id % 4 = 0 AND kind = 'toolStarted' THEN 'question' END AS attention FROM (
  SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'assistant' ELSE 'rollout' END AS source, 'u' || user_id AS session_id, event_id AS seq, ts, 'run ' || event_id AS summary, '/w/p' || (user_id % 7) AS cwd,
    CASE WHEN event_id % 50 = 49 THEN 'sessionEnd' WHEN event_id % 50 = 25 THEN 'notificationIdle' WHEN event_id % 13 = 5 THEN 'toolFinished' WHEN event_type = 'view' THEN 'toolStarted' WHEN event_type = 'click' THEN 'promptSubmitted'
      WHEN event_type = 'purchase' THEN 'stop' WHEN event_type = 'signup' THEN 'sessionStart' WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'permissionRequested' END AS kind,
    CASE WHEN event_id % 4 = 0 THEN 'AskUserQuestion' ELSE 'Bash' END AS tool FROM events WHERE event_id % 19 <> 0))
"""


def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that services list: a customer is a window, its nation the service."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    kind = F.when(F.col("c_mktsegment") == "AUTOMOBILE", "session").when(F.col("c_mktsegment") == "BUILDING", "weekly").when(F.col("c_mktsegment") == "FURNITURE", "modelSpecific").when(F.col("c_mktsegment") == "HOUSEHOLD", "other").otherwise("session")
    bucket = F.when(k % 10 == 3, "seven_day").when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("promo_"), k.cast("string"))).otherwise(F.concat(F.lit("w_"), k.cast("string")))
    return c.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("service"), bucket.alias("bucket"), F.col("c_name").alias("label"), (F.floor((F.col("c_acctbal") + 1000) / 100)).cast("double").alias("percent"),
        F.when(k % 5 != 0, F.expr("timestampadd(HOUR, cast(c_custkey % 200 as int), TIMESTAMP_NTZ '2024-01-28 00:00:00')")).alias("resets_at"), kind.alias("kind"), F.when(k % 4 == 0, 36_000.0).alias("window_seconds"),
        F.when(k % 7 == 0, F.lit(5.0)).alias("credit_used"), F.when(k % 7 == 0, F.lit(20.0)).alias("credit_limit"), k.cast("int").alias("pos"), F.lit("poll").alias("source"), F.lit(None).cast("timestamp_ntz").alias("as_of"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        F.concat(F.lit("n"), n.cast("string")).alias("service"), F.col("n_name").alias("name"), F.when(n % 6 == 5, "error").otherwise("ok").alias("state"), F.expr("timestampadd(MINUTE, n_nationkey, TIMESTAMP_NTZ '2024-01-30 00:00:00')").alias("fetched_at"),
        F.when(n % 3 == 0, n.cast("double") * 1.5).alias("week_cost"), (n % 4 == 0).alias("extra_enabled"), F.lit(50.0).alias("extra_limit"), n.cast("double").alias("extra_used"), (n * 5).cast("double").alias("extra_percent"),
    )


SERVICES = """
WITH buckets AS (SELECT 'n' || c_nationkey AS service, CASE WHEN c_custkey % 10 = 3 THEN 'seven_day' WHEN c_mktsegment = 'MACHINERY' THEN 'promo_' || c_custkey ELSE 'w_' || c_custkey END AS bucket, c_name AS label,
  CAST(floor((c_acctbal + 1000) / 100) AS DOUBLE) AS percent, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2024-01-28 00:00:00' + to_hours(CAST(c_custkey % 200 AS INTEGER)) END AS resets_at,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'session' WHEN 'BUILDING' THEN 'weekly' WHEN 'FURNITURE' THEN 'modelSpecific' WHEN 'HOUSEHOLD' THEN 'other' ELSE 'session' END AS kind,
  CASE WHEN c_custkey % 4 = 0 THEN 36000.0 END AS window_seconds, CASE WHEN c_custkey % 7 = 0 THEN 5.0 END AS credit_used, CASE WHEN c_custkey % 7 = 0 THEN 20.0 END AS credit_limit, c_custkey AS pos FROM customer),
services AS (SELECT 'n' || n_nationkey AS service, n_name AS name, CASE WHEN n_nationkey % 6 = 5 THEN 'error' ELSE 'ok' END AS state, TIMESTAMP '2024-01-30 00:00:00' + to_minutes(n_nationkey) AS fetched_at,
  CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 1.5 END AS week_cost, n_nationkey % 4 = 0 AS extra_enabled, 50.0 AS extra_limit, CAST(n_nationkey AS DOUBLE) AS extra_used, CAST(n_nationkey * 5 AS DOUBLE) AS extra_percent FROM nation),
b AS (SELECT *, least(100.0, greatest(0.0, percent)) AS p, lower(bucket) LIKE '%promo%' OR lower(label) LIKE '%promo%' AS promo, credit_limit IS NOT NULL AS pool,
  lower(bucket) LIKE '%promo%' OR lower(label) LIKE '%promo%' OR credit_limit IS NOT NULL AS bonus FROM buckets),
tiers AS (SELECT *, CASE WHEN NOT bonus AND kind <> 'modelSpecific' THEN 0 WHEN NOT bonus THEN 1 ELSE 2 END AS tier FROM b)
"""


def flat(df: DataFrame) -> DataFrame:
    """Times as microseconds, days as text: outputs that compare alike everywhere."""
    out: list[Column] = []
    for name, kind in df.dtypes:
        out.append(micros(name).alias(name) if kind.startswith("timestamp") else F.col(name).cast("string").alias(name) if kind == "date" else F.col(name))
    return df.select(*out)
