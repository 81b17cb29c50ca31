"""Sources: the events are written as the raw lines of each format, and read back by its reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.operators import pricing
from tallyspark.plans import binding as b
from tallyspark.plans.binding import flat
from tallyspark.plans.catalog import query
from tallyspark.sources import logs, payloads, rollouts, stores, ticks


def _e() -> Column:
    return F.col("event_id")


def _iso(ts: str = "ts") -> Column:
    return F.concat(F.replace(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), F.lit("T")), F.lit("Z"))


def _assistant_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event is a turn with a whole cache figure, every seventh a prompt, every eleventh a title, every thirteenth a
    compaction, the others turns with split cache figures; every 17th turn has no id, every 19th line is cut off."""
    k = F.get_json_object("props", "$.k").cast("long")
    usage = F.struct(
        F.round(F.col("value") * 100).cast("long").alias("input_tokens"), k.alias("output_tokens"), F.when(_e() % 3 != 0, k * 2).alias("cache_read_input_tokens"), F.when(_e() % 5 == 0, k * 3).alias("cache_creation_input_tokens"),
        F.when(_e() % 5 != 0, F.struct((k * 4).alias("ephemeral_5m_input_tokens"), F.when(_e() % 2 == 0, k * 5).alias("ephemeral_1h_input_tokens"))).alias("cache_creation"),
    )
    kind = F.when(_e() % 7 == 0, "user").when(_e() % 11 == 0, "ai-title").when(_e() % 13 == 0, "system").otherwise("assistant")
    rows = b.events(spark, sf_dir).withColumn("_kind", kind)
    message = F.when(F.col("_kind") == "assistant", F.struct(F.when(_e() % 17 != 0, F.concat(F.lit("m"), _e().cast("string"))).alias("id"), F.lit("claude-opus-5").alias("model"), usage.alias("usage"), F.lit(None).cast("string").alias("content"))).when(
        F.col("_kind") == "user", F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("model"), F.when(F.lit(False), usage).alias("usage"), F.concat(F.lit("  do\n "), F.col("event_type")).alias("content"))
    )
    line = F.to_json(
        F.struct(
            F.col("_kind").alias("type"), _iso().alias("timestamp"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("sessionId"), F.when(F.col("_kind") == "user", F.struct(F.when(_e() % 2 == 0, "human").otherwise("tool").alias("kind"))).alias("origin"),
            F.when(F.col("_kind") == "ai-title", F.concat(F.lit("Title "), _e().cast("string"))).alias("aiTitle"), F.when(F.col("_kind") == "system", "compact_boundary").alias("subtype"), message.alias("message"),
        )
    )
    return rows.select(F.when(_e() % 19 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value"), _e().alias("seq"), F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project"))


_KIND = "CASE WHEN event_id % 7 = 0 THEN 'user' WHEN event_id % 11 = 0 THEN 'ai-title' WHEN event_id % 13 = 0 THEN 'system' ELSE 'assistant' END"
_LOG = f"WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS cents, {_KIND} AS kind FROM events WHERE event_id % 19 <> 0)"


@query(f"""{_LOG} SELECT event_id AS seq, epoch_us(ts) AS ts, event_id % 17 <> 0 AS has_id, cents AS input, k AS output, CASE WHEN event_id % 3 <> 0 THEN k * 2 ELSE 0 END AS cache_read, CASE WHEN event_id % 5 = 0 THEN k * 3 ELSE k * 4 END AS cache_write_5m,
CASE WHEN event_id % 5 <> 0 AND event_id % 2 = 0 THEN k * 5 ELSE 0 END AS cache_write_1h, 'c' || user_id AS chat_id, 'p' || (user_id % 7) AS project FROM e WHERE kind = 'assistant'""")
def assistant_log_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2, SRC-3, SRC-4: turns of assistant log lines."""
    rows = logs.turns(logs.parsed(_assistant_lines(spark, sf_dir)))
    return flat(rows.select("seq", "ts", F.col("msg_id").startswith("m").alias("has_id"), "input", "output", "cache_read", "cache_write_5m", "cache_write_1h", "chat_id", "project"))


@query(f"""{_LOG} SELECT 'c' || user_id AS chat_id, epoch_us(ts) AS "at", CASE kind WHEN 'user' THEN 'prompt' WHEN 'ai-title' THEN 'title' ELSE 'compaction' END AS kind, CASE kind WHEN 'user' THEN 'do ' || event_type WHEN 'ai-title' THEN 'Title ' || event_id ELSE '' END AS text
FROM e WHERE kind <> 'assistant' AND (kind <> 'user' OR event_id % 2 = 0)""")
def assistant_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-5, SRC-6, SRC-26: prompts, titles and compactions."""
    rows = logs.chat_events(logs.parsed(_assistant_lines(spark, sf_dir)))
    return flat(rows.select("chat_id", "at", "kind", F.coalesce("text", F.lit("")).alias("text")))


@query("SELECT count(*) AS lines, count(*) FILTER (event_id % 19 = 0) AS incomplete FROM events")
def incomplete_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-2: half-written lines are set aside."""
    lines = _assistant_lines(spark, sf_dir)
    bad = logs.incomplete(lines).agg(F.count("*").alias("incomplete"))
    return lines.agg(F.count("*").alias("lines")).join(F.broadcast(bad), F.lit(True))


def _rollout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a file: its first events come before any context, every 6th event is a context, every 5th user bills by
    records from the 20th event on, the others by counters that restart every 40th reading."""
    from tallyspark.functions.frames import ranked

    rows = ranked(b.events(spark, sf_dir).withColumn("file", F.concat(F.lit("/logs/rollout-"), F.lpad(F.col("user_id").cast("string"), 8, "0"), F.lit("-0000-0000-0000-000000000000.jsonl"))), ["file"], [F.col("ts"), _e()], name="line")
    n = F.col("line")
    total = F.struct((n % 40 * 100).alias("input_tokens"), (n % 40 * 10).alias("cached_input_tokens"), F.lit(0).cast("long").alias("cache_write_input_tokens"), (n % 40 * 7).alias("output_tokens"), (n % 40).alias("reasoning_output_tokens"))
    one = F.struct(F.lit(500).cast("long").alias("input_tokens"), F.lit(100).cast("long").alias("cached_input_tokens"), F.lit(50).cast("long").alias("cache_write_input_tokens"), F.lit(70).cast("long").alias("output_tokens"), F.lit(5).cast("long").alias("reasoning_output_tokens"))
    context = n % 6 == 5
    record = (F.col("user_id") % 5 == 0) & (n >= 20) & (n % 6 == 0)
    none = F.lit(None).cast("string")
    payload = (
        F.when(context, F.struct(F.lit("x").alias("type"), F.when(n % 12 == 5, "m-one").otherwise("m-two").alias("model"), none.alias("thread_id"), none.alias("response_id"), F.when(F.lit(False), one).alias("usage"), F.when(F.lit(False), F.struct(total.alias("total_token_usage"))).alias("info")))
        .when(record, F.struct(F.lit("r").alias("type"), none.alias("model"), F.lit("t").alias("thread_id"), F.concat(F.lit("r"), F.floor(n / 12).cast("string")).alias("response_id"), one.alias("usage"), F.when(F.lit(False), F.struct(total.alias("total_token_usage"))).alias("info")))
        .otherwise(F.struct(F.lit("token_count").alias("type"), none.alias("model"), none.alias("thread_id"), none.alias("response_id"), F.when(F.lit(False), one).alias("usage"), F.struct(total.alias("total_token_usage")).alias("info")))
    )
    kind = F.when(context, "turn_context").when(record, "token_usage_record").otherwise("event_msg")
    return rows.select("file", n.cast("long").alias("line"), F.to_json(F.struct(_iso().alias("timestamp"), kind.alias("type"), payload.alias("payload"))).alias("value"))


_ROLL = """WITH l AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT *, CASE WHEN n % 6 = 5 THEN 'ctx' WHEN user_id % 5 = 0 AND n >= 20 AND n % 6 = 0 THEN 'rec' ELSE 'cnt' END AS kind, n % 40 AS v FROM l),
s AS (SELECT *, last_value(CASE WHEN kind = 'ctx' THEN CASE WHEN n % 12 = 5 THEN 'm-one' ELSE 'm-two' END END IGNORE NULLS) OVER w AS model, count(*) FILTER (kind = 'rec') OVER w AS recs, coalesce(last_value(CASE WHEN kind = 'cnt' THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev FROM k WINDOW w AS (PARTITION BY user_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
u AS (SELECT user_id, n, ts, model, CASE WHEN kind = 'rec' THEN 350 WHEN v < prev THEN v * 90 ELSE (v - prev) * 90 END AS input, CASE WHEN kind = 'rec' THEN 70 WHEN v < prev THEN v * 7 ELSE (v - prev) * 7 END AS output, kind FROM s
  WHERE (kind = 'cnt' AND recs = 0 AND v <> prev AND NOT (v < prev AND v = 0)) OR (kind = 'rec' AND NOT EXISTS (SELECT 1 FROM k o WHERE o.user_id = s.user_id AND o.kind = 'rec' AND o.n < s.n AND o.n // 12 = s.n // 12))),
p AS (SELECT user_id, min(n) AS n, arg_min(ts, n) AS ts, sum(input) AS input, sum(output) AS output FROM u WHERE model IS NULL GROUP BY 1), c AS (SELECT user_id, arg_min(CASE WHEN n % 12 = 5 THEN 'm-one' ELSE 'm-two' END, n) AS model FROM k WHERE kind = 'ctx' GROUP BY 1)
"""


@query(f"""{_ROLL} SELECT chat_id, model, count(*) AS n, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, epoch_us(min(ts)) AS first_at FROM (SELECT user_id, ts, model, input, output FROM u WHERE model IS NOT NULL UNION ALL SELECT p.user_id, p.ts, c.model, p.input, p.output FROM p JOIN c USING (user_id)),
LATERAL (SELECT lpad(CAST(user_id AS VARCHAR), 8, '0') || '-0000-0000-0000-000000000000' AS chat_id) GROUP BY 1, 2""")
def rollout_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-7, SRC-8, SRC-9, SRC-10, SRC-11, JON-7: counters, records, contexts and what came before them."""
    rows = rollouts.turns(_rollout_lines(spark, sf_dir))
    return flat(rows.groupBy("chat_id", "model").agg(F.count("*").alias("n"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.min("ts").alias("first_at")))


def _rollout_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a file; users 3, 13, … are sub-agents. Every third event is a prompt (every ninth a rule block), every 20th a
    compaction."""
    from tallyspark.functions.frames import ranked

    rows = ranked(b.events(spark, sf_dir).withColumn("file", F.concat(F.lit("/logs/"), F.col("user_id").cast("string"), F.lit(".jsonl"))), ["file"], [F.col("ts"), _e()], name="line")
    text = F.when(_e() % 9 == 0, "# rules").otherwise(F.concat(F.lit("do   "), _e().cast("string")))
    item = F.struct(F.lit("message").alias("type"), F.lit("user").alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), text.alias("text"))).alias("content"))
    kind = F.when(_e() % 3 == 0, "response_item").when(_e() % 20 == 1, "compacted").otherwise("event_msg")
    lines = rows.select("file", F.col("line").cast("long").alias("line"), F.to_json(F.struct(_iso().alias("timestamp"), kind.alias("type"), F.when(kind == "response_item", item).alias("payload"))).alias("value"))
    meta = rows.select("file", "user_id").distinct().select("file", F.lit(0).cast("long").alias("line"), F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("session_id"), F.when(F.col("user_id") % 10 == 3, "subagent").alias("thread_source")).alias("payload"))).alias("value"))
    return lines.unionByName(meta)


@query("""SELECT 'c' || user_id AS chat_id, epoch_us(ts) AS "at", CASE WHEN event_id % 3 = 0 THEN 'prompt' ELSE 'compaction' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'do ' || event_id ELSE '' END AS text
FROM events WHERE user_id % 10 <> 3 AND ((event_id % 3 = 0 AND event_id % 9 <> 0) OR (event_id % 3 <> 0 AND event_id % 20 = 1))""")
def rollout_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-31, SRC-32: prompts and compactions of main threads."""
    return flat(rollouts.chat_events(_rollout_items(spark, sf_dir)).select("chat_id", "at", "kind", F.coalesce("text", F.lit("")).alias("text")))


def _tick_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third event completes a turn of two models (one unpriced for every second, none priced for every fifth); each is
    logged twice, and others mention the marker."""
    k = F.get_json_object("props", "$.k").cast("long")
    rows = b.events(spark, sf_dir).withColumn("k", k)
    none = F.lit(None).cast("double")
    usage = lambda tokens, ticks, models: F.struct(
        tokens.alias("inputTokens"), F.lit(0).cast("long").alias("outputTokens"), tokens.alias("totalTokens"), ticks.alias("costUsdTicks"), *([models.alias("modelUsage")] if models is not None else [])
    )
    first, second = F.when(_e() % 5 == 0, none).otherwise((F.col("k") * 1e6).cast("double")), F.when((_e() % 2 == 0) | (_e() % 5 == 0), none).otherwise((F.col("k") * 2e6).cast("double"))
    models = F.map_from_arrays(F.array(F.lit("grok-4.6-build"), F.lit("other-x")), F.array(usage(F.col("k") * 3, first, None), usage(F.col("k"), second, None)))
    turn = usage(F.col("k") * 4, F.when(_e() % 7 == 0, none).otherwise((F.col("k") * 1e7).cast("double")), models)
    done = _e() % 3 == 0
    update = F.struct(F.when(done, ticks.MARKER).otherwise("recap of turn_completed").alias("sessionUpdate"), turn.alias("usage"))
    line = F.to_json(F.struct((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"), F.struct(F.lit("s").alias("sessionId"), update.alias("update"), F.struct(_e().cast("string").alias("eventId")).alias("_meta")).alias("params")))
    out = rows.select(line.alias("value"), F.concat(F.lit("p"), (F.col("user_id") % 7).cast("string")).alias("project"), _e().alias("seq"))
    return out.unionByName(out.withColumn("seq", F.col("seq") + 10**9))


_TICK = """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 = 0),
r AS (SELECT event_id, 0 AS pos, 'grok-4.6-build' AS model, 3 * k AS tok, CASE WHEN event_id % 5 <> 0 THEN k * 100000 END AS rc, CAST(round(2000.0::DOUBLE * 3 * k) AS BIGINT) AS tc, CASE WHEN event_id % 7 <> 0 THEN k * 1000000 END AS turn FROM e
  UNION ALL SELECT event_id, 1, 'other-x', k, CASE WHEN event_id % 2 <> 0 AND event_id % 5 <> 0 THEN k * 200000 END, 0, CASE WHEN event_id % 7 <> 0 THEN k * 1000000 END FROM e),
s AS (SELECT *, coalesce(sum(rc) OVER w, 0) AS paid, count(*) FILTER (rc IS NULL) OVER w AS open_, coalesce(sum(tok) FILTER (rc IS NULL) OVER w, 0) AS otok, row_number() OVER (PARTITION BY event_id ORDER BY rc DESC NULLS LAST, pos) AS dear, row_number() OVER (PARTITION BY event_id ORDER BY rc IS NULL DESC, pos) AS nth FROM r WINDOW w AS (PARTITION BY event_id)),
p AS (SELECT *, CASE WHEN rc IS NULL AND turn > paid THEN CAST(floor((turn - paid) * (CASE WHEN otok > 0 THEN tok::DOUBLE / otok::DOUBLE ELSE 1.0::DOUBLE / open_ END)) AS BIGINT) ELSE 0 END AS part FROM s),
q AS (SELECT *, CASE WHEN turn > paid THEN turn - paid - sum(part) OVER (PARTITION BY event_id) ELSE 0 END AS slack FROM p)"""


@query(f"""{_TICK} SELECT CAST(event_id AS VARCHAR) AS turn_id, model, CAST(CASE WHEN open_ = 0 AND turn > paid AND dear = 1 THEN rc + turn - paid WHEN rc IS NOT NULL THEN rc WHEN turn > paid THEN part + CASE WHEN nth = open_ THEN slack ELSE 0 END ELSE tc END AS BIGINT) AS cost_nd, tok AS tokens FROM q""")
def tick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13, SRC-14, DED-3, PRC-9, PRC-10: rows of tick turns, priced."""
    live = spark.createDataFrame([("grok-4.6", 2.0, 8.0, 0.2, 0.0, 0.0)], "model_norm string, in_per_m double, out_per_m double, cache_read_per_m double, cw5m_per_m double, cw1h_per_m double")
    rows = ticks.priced(ticks.rows_of(_tick_lines(spark, sf_dir)), live)
    return rows.select("turn_id", "model", "cost_nd", "tokens")


@query("""WITH e AS (SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'p' || (user_id % 7) AS project FROM events WHERE event_id % 3 = 0) SELECT project, count(*) AS n, CAST(sum(4 * k) AS BIGINT) AS tokens FROM e GROUP BY 1""")
def tick_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14: one row for each turn, by project."""
    rows = ticks.rows_of(_tick_lines(spark, sf_dir)).withColumn("cost_nd", F.coalesce("row_cost_nd", F.lit(0)))
    return ticks.turns(rows).groupBy("project").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


def _store_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a session of a store: counters from journals, every tenth from a snapshot; users 3, 13, … have another format."""
    rows = b.events(spark, sf_dir).select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session"), "event_id", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("updatedAt"), ((_e() % 101) * 50 + F.floor(_e() / 4)).cast("long").alias("i"), F.col("user_id").alias("u")
    )
    point = F.struct(F.struct(F.col("i").alias("inputTokens"), F.when(_e() % 3 != 0, F.floor(F.col("i") / 2)).alias("cachedInputTokens"), F.floor(F.col("i") / 5).alias("outputTokens")).alias("tokenUsage"), "updatedAt")
    shot = F.to_json(F.struct(F.struct(point.alias("session")).alias("snapshot")))
    line = F.to_json(F.struct(F.lit("projection_delta").alias("type"), F.struct(F.array(F.struct(F.lit(stores.MARKER).alias("op"), F.struct(point.alias("session")).alias("state"))).alias("delta")).alias("payload")))
    name = F.when(_e() % 10 == 0, F.concat(F.lit("generations/"), _e().cast("string"), F.lit("/projection-state.json"))).otherwise(F.concat(F.lit("journal/"), _e().cast("string"), F.lit(".jsonl")))
    files = rows.select("session", name.alias("name"), F.when(_e() % 10 == 0, shot).otherwise(line).alias("value"))
    users = rows.select("session", "u").distinct()
    current = users.select("session", F.lit("CURRENT").alias("name"), F.to_json(F.struct(F.when(F.col("u") % 10 == 3, "v9").otherwise("v1").alias("store_format"))).alias("value"))
    meta = users.select("session", F.lit("meta.json").alias("name"), F.to_json(F.struct(F.concat(F.lit("t"), "session").alias("title"), F.struct(F.lit("/w").alias("working_directory")).alias("environment"), F.struct(F.lit("big").alias("active_model")).alias("config"))).alias("value"))
    return files.unionByName(current).unionByName(meta)


@query("""WITH p AS (SELECT user_id, 'u' || user_id AS session, round(epoch_us(ts) / 1000.0::DOUBLE) AS ms, event_id % 101 * 50 + event_id // 4 AS i, CASE WHEN event_id % 3 <> 0 THEN (event_id % 101 * 50 + event_id // 4) // 2 ELSE 0 END AS c, (event_id % 101 * 50 + event_id // 4) // 5 AS o FROM events WHERE user_id % 10 <> 3),
t AS (SELECT *, coalesce(max(i + o) OVER (PARTITION BY session ORDER BY ms, i + o, i, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM p), k AS (SELECT * FROM t WHERE i + o > top)
SELECT session, epoch_us(make_timestamp(CAST(ms AS BIGINT) * 1000)) AS "at", greatest(0, i - coalesce(lag(i) OVER w, 0)) AS input, greatest(0, c - coalesce(lag(c) OVER w, 0)) AS cached, greatest(0, o - coalesce(lag(o) OVER w, 0)) AS output FROM k WINDOW w AS (PARTITION BY session ORDER BY ms, i + o, i, c)""")
def store_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15, SRC-16: rises of a store's counters."""
    return flat(stores.steps(stores.points(stores.known(_store_files(spark, sf_dir), "v1"))))


@query("SELECT DISTINCT 'u' || user_id AS session, 'tu' || user_id AS title, '/w' AS cwd, 'big' AS active_model FROM events WHERE user_id % 10 <> 3")
def store_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-15, SRC-33: what a session says of itself."""
    return stores.meta(stores.known(_store_files(spark, sf_dir), "v1")).select("session", "title", "cwd", "active_model")


@query("""SELECT CASE WHEN user_id % 2 = 0 THEN 'x' ELSE 'assistant' END AS service, epoch_us(ts) AS ts, bucket, CAST(percent AS DOUBLE) AS percent, named FROM (SELECT *, event_id % 100 AS p FROM events WHERE event_id % 23 <> 0),
LATERAL (VALUES ('seven_day_x', p, event_id % 3 = 0), ('five_hour', CASE WHEN event_id % 4 = 0 THEN p + 1 WHEN event_id % 5 = 0 THEN p END, event_id % 4 <> 0)) w(bucket, percent, named) WHERE percent IS NOT NULL""")
def quota_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-17, FN-17: readings of history lines, old fields included; corrupt lines go."""
    p = (_e() % 100).cast("double")
    line = F.to_json(
        F.struct(
            _e().cast("string").alias("id"), _iso().alias("timestamp"), F.when(F.col("user_id") % 2 == 0, "x").alias("serviceID"),
            F.when(_e() % 4 == 0, F.create_map(F.lit("seven_day_x"), p, F.lit("five_hour"), p + 1)).otherwise(F.create_map(F.lit("seven_day_x"), p)).alias("bucketPercents"),
            F.create_map(F.lit("seven_day_x"), F.struct(F.when(_e() % 3 == 0, "2024-02-02T00:00:00Z").otherwise("4001-01-01T00:00:00Z").alias("resetsAt"), F.lit(5.0).alias("length"))).alias("bucketWindows"),
            F.when(_e() % 5 == 0, p).alias("fiveHourPercent"), F.when(_e() % 5 == 0, "2024-01-01T05:00:00Z").alias("fiveHourResetsAt"),
        )
    )
    lines = b.events(spark, sf_dir).select(F.when(_e() % 23 == 0, "{broken").otherwise(line).alias("value"))
    return flat(payloads.history(lines).select("service", "ts", "bucket", "percent", F.col("resets_at").isNotNull().alias("named")))


@query("""WITH s AS (SELECT n_nationkey AS k, 'n' || n_nationkey AS service FROM nation)
SELECT service, bucket, label, percent, kind FROM s, LATERAL (VALUES (true, 'five_hour', 'Current session', CAST(k AS DOUBLE), 'session'), (k % 2 = 0, 'seven_day_opus', 'opus only', 5.0, 'modelSpecific'), (true, 'seven_day', 'All models', 7.0, 'weekly'), (k % 2 = 1, 'seven_day_opus', 'Opus only', 8.0, 'modelSpecific'),
(true, 'seven_day_cedar', 'Cedar only', 9.0, 'modelSpecific'), (k % 3 = 0, 'pool_hour', 'Included credits', 10.0, 'other')) w(ok, bucket, label, percent, kind) WHERE ok""")
def quota_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-18, SRC-19: limits first, then keyed windows that they lack."""
    n = F.col("n_nationkey")
    limit = lambda kind, percent, scope: F.struct(F.lit(kind).alias("kind"), percent.cast("double").alias("percent"), scope.alias("scope"))
    none = F.lit(None).cast("string")
    limits = F.filter(F.array(limit("session", n, none), limit("session", n + 1, none), F.when(n % 2 == 0, limit("weekly_scoped", F.lit(5), F.lit("opus")))), lambda x: x.isNotNull())
    w = lambda p: F.struct(F.lit(p).alias("utilization"), F.lit("2024-02-01T00:00:00Z").alias("resets_at"))
    pool = F.when(n % 3 == 0, F.struct(F.lit(10.0).alias("utilization"), F.lit(20.0).alias("limit_dollars"), F.lit(2.0).alias("used_dollars")))
    value = F.to_json(F.struct(limits.alias("limits"), w(6.0).alias("five_hour"), w(7.0).alias("seven_day"), w(8.0).alias("seven_day_opus"), w(9.0).alias("seven_day_cedar"), pool.alias("pool_hour")))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), n.cast("string")).alias("service"), value.alias("value"))
    return payloads.quota_windows(rows).select("service", "bucket", "label", "percent", "kind")


@query("SELECT 'n' || n_nationkey AS service, n_nationkey % 2 = 0 AS extra_enabled, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE 20 END AS DOUBLE) AS extra_limit, n_nationkey::DOUBLE AS extra_used, CASE WHEN n_nationkey % 3 <> 0 THEN least(100.0, n_nationkey / 20.0::DOUBLE * 100) WHEN n_nationkey % 2 = 0 THEN 50.0 ELSE 60.0 END AS extra_percent FROM nation")
def extra_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-34."""
    n = F.col("n_nationkey")
    e = F.struct((n % 2 == 0).alias("is_enabled"), F.when(n % 3 != 0, 2000.0).alias("monthly_limit"), (n * 100).cast("double").alias("used_credits"), F.when(n % 2 == 0, 0.5).otherwise(60.0).alias("utilization"))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("n"), n.cast("string")).alias("service"), F.to_json(F.struct(e.alias("extra_usage"))).alias("value"))
    return payloads.extra_usage(rows)


@query("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)) FILTER (o_orderkey % 10 <> 0), 0) AS DOUBLE) / 100 AS dollars, count(*) FILTER (o_orderkey % 10 = 0) AS skipped FROM orders GROUP BY 1")
def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20: cents as text, summed exactly."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.to_date("o_orderdate").alias("day"), F.when(F.col("o_orderkey") % 10 == 0, "n/a").otherwise(F.round(F.col("o_totalprice") * 100).cast("long").cast("string")).alias("amount"))
    return flat(payloads.cost_report(rows))


@query("""SELECT bucket, label, percent, kind, CASE WHEN s_suppkey % 3 = 0 THEN 50.0 * greatest(0.0, raw) / 100 END AS allowance_used, place, date_diff('second', r - INTERVAL 1 MONTH, r)::DOUBLE AS window_seconds FROM (SELECT *, CASE WHEN s_suppkey = 4 THEN 'vibe_usage' ELSE 'model_' || s_suppkey || '_usage' END AS bucket,
CASE WHEN s_suppkey = 4 THEN 'Vibe' ELSE 'Model ' || s_suppkey END AS label, CAST(floor(s_acctbal / 50) AS DOUBLE) AS raw, least(100.0, greatest(0.0, floor(s_acctbal / 50))) AS percent, CASE WHEN s_suppkey = 4 THEN 'weekly' ELSE 'modelSpecific' END AS kind, CASE WHEN s_suppkey = 4 THEN 0 ELSE 2 END AS place, TIMESTAMP '2024-03-01 00:00:00' AS r FROM supplier) WHERE s_suppkey % 5 <> 0""")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-21."""
    k = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.when(k % 5 == 0, "other").when(k == 4, "vibe_usage").otherwise(F.concat(F.lit("model_"), k.cast("string"), F.lit("_usage"))).alias("key"), F.floor(F.col("s_acctbal") / 50).cast("double").alias("percent"),
        F.expr("TIMESTAMP_NTZ '2024-03-01 00:00:00'").alias("reset_at"), F.lit(50.0).alias("budget"), F.when(k % 3 == 0, "usd").otherwise("EUR").alias("currency"),
    )
    return payloads.budgets(rows, "_usage", ("vibe_usage", "api_usage")).select("bucket", "label", "percent", "kind", "allowance_used", "place", "window_seconds")


#: A feed of the parts: a quarter of them for each provider (the last one unknown), numbered alike in each.
_FEED = """
WITH f AS (SELECT p_partkey % 4 AS place, (p_partkey // 4 % 2 = 0)::BOOLEAN AS newer, CASE WHEN p_partkey // 4 % 2 = 0 THEN 'gpt-6-' ELSE 'm-' END || (p_partkey // 4) AS id, p_partkey, p_size,
  CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS i, CASE WHEN p_size % 11 <> 0 THEN CAST(p_size * 4 AS DOUBLE) END AS o, CASE WHEN p_size % 3 = 0 THEN p_size / 8.0 END AS r, CASE WHEN p_size % 5 = 0 THEN p_size * 2.0 END AS w FROM part),
g AS (SELECT *, coalesce(w, CASE WHEN place = 0 OR place = 1 AND newer THEN i * 1.25 ELSE 0.0 END) AS cw FROM f WHERE place < 3 AND i IS NOT NULL AND o IS NOT NULL)
SELECT id AS model_norm, i AS in_per_m, o AS out_per_m, round(coalesce(r, i * 0.1), 9)::DOUBLE AS cache_read_per_m, cw::DOUBLE AS cw5m_per_m, round(cw * 1.6, 9)::DOUBLE AS cw1h_per_m FROM g QUALIFY row_number() OVER (PARTITION BY id ORDER BY place DESC) = 1"""


@query(_FEED)
def price_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-22: a feed's rates with their defaults; models without a price, unknown providers, ids that several have."""
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.element_at(F.array(*map(F.lit, ("anthropic", "openai", "xai", "nobody"))), (k % 4 + 1).cast("int")).alias("provider"),
        F.concat(F.when(F.floor(k / 4) % 2 == 0, "gpt-6-").otherwise("m-"), F.floor(k / 4).cast("string")).alias("id"),
        F.struct(F.when(size % 7 != 0, size.cast("double")).alias("input"), F.when(size % 11 != 0, (size * 4).cast("double")).alias("output"), F.when(size % 3 == 0, size / 8).alias("cache_read"), F.when(size % 5 == 0, size * 2.0).alias("cache_write")).alias("cost"),
    )
    feed = rows.select(F.to_json(F.create_map("provider", F.struct(F.create_map("id", F.struct("cost")).alias("models")))).alias("value"))
    out = payloads.price_feed(feed)
    return out.select("model_norm", "in_per_m", "out_per_m", F.round("cache_read_per_m", 9).alias("cache_read_per_m"), "cw5m_per_m", F.round("cw1h_per_m", 9).alias("cw1h_per_m"))


@query("""SELECT event_id AS seq, CASE WHEN event_id % 31 = 0 THEN 'not_json' WHEN event_id % 29 = 0 THEN 'version' WHEN event_id % 23 = 0 THEN 'missing:session_id' ELSE '' END AS error,
CASE WHEN event_id % 31 = 0 OR event_id % 29 = 0 OR event_id % 23 = 0 THEN '' WHEN event_type = 'view' THEN 'toolStarted' WHEN event_type = 'click' THEN 'promptSubmitted' WHEN event_type = 'purchase' THEN 'stop' WHEN event_type = 'signup' THEN 'notificationPermission' ELSE 'unknown' END AS kind,
CASE WHEN event_id % 31 = 0 OR event_id % 29 = 0 OR event_id % 23 = 0 OR event_type <> 'view' THEN '' ELSE 'ls ' || event_id END AS summary FROM events""")
def hook_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-23: hook lines, good and bad."""
    name = F.when(F.col("event_type") == "view", "PreToolUse").when(F.col("event_type") == "click", "UserPromptSubmit").when(F.col("event_type") == "purchase", "Stop").when(F.col("event_type") == "signup", "Notification").otherwise("Weird")
    payload = F.struct(
        name.alias("hook_event_name"), F.when(_e() % 23 == 0, "").otherwise("s").alias("session_id"), F.when(F.col("event_type") == "view", "Bash").alias("tool_name"),
        F.when(F.col("event_type") == "view", F.struct(F.concat(F.lit("ls   "), _e().cast("string")).alias("command"))).alias("tool_input"), F.when(F.col("event_type") == "signup", "permission_prompt").alias("notification_type"),
    )
    line = F.to_json(F.struct(F.when(_e() % 29 == 0, 7).otherwise(1).alias("v"), F.lit("assistant").alias("source"), F.lit(1.5).alias("received_at"), payload.alias("payload")))
    rows = payloads.hook_events(b.events(spark, sf_dir).select(F.when(_e() % 31 == 0, "hello").otherwise(line).alias("value"), _e().alias("seq")))
    return rows.select("seq", F.coalesce("error", F.lit("")).alias("error"), F.when(F.col("error").isNull(), F.col("kind")).otherwise("").alias("kind"), F.when(F.col("error").isNull(), F.coalesce("summary", F.lit(""))).otherwise("").alias("summary"))


@query("SELECT 'u' || user_id AS session_id, epoch_us(ts) AS written_at, (event_id * 10)::DOUBLE AS api_ms, (event_id % 90)::DOUBLE AS percent FROM events")
def statusline_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-25, SRC-30."""
    line = F.to_json(F.struct(F.struct((_e() * 10).cast("double").alias("total_api_duration_ms")).alias("cost"), F.struct(F.struct((_e() % 90).cast("double").alias("used_percentage"), F.lit(1.7e9).alias("resets_at")).alias("five_hour")).alias("rate_limits")))
    rows = b.events(spark, sf_dir).select(line.alias("value"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("session_id"), F.col("ts").alias("written_at"), F.lit("home").alias("config_dir"))
    return flat(payloads.statusline(rows).select("session_id", "written_at", "api_ms", F.col("five_hour.percent").alias("percent")))


@query("""SELECT n_nationkey AS id, 'pool a' AS "group", bucket, name, remaining FROM nation, LATERAL (VALUES ('b1', 'b1', 0.5::DOUBLE), ('b2', 'Two', n_nationkey / 100.0::DOUBLE)) b(bucket, name, remaining) WHERE n_nationkey % 4 <> 0""")
def quota_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-27: a report amid noise; failed ones are left out."""
    n = F.col("n_nationkey")
    bucket = lambda i, name, rem: F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), rem.cast("double").alias("remaining_fraction"))
    groups = F.array(F.struct(F.lit(" pool a ").alias("name"), F.array(bucket("b1", " ", F.lit(0.5)), bucket(" ", "x", F.lit(0.1)), bucket("b2", "Two", n / 100)).alias("buckets")), F.struct(F.lit("empty").alias("name"), F.array(bucket("", "", F.lit(0.0))).alias("buckets")))
    body = F.to_json(F.struct(F.when(n % 4 == 0, "FAILED").otherwise("SUCCESS").alias("status"), F.struct(F.struct(groups.alias("groups")).alias("data")).alias("command")))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(n.alias("id"), F.concat(F.lit("warming up\n"), body, F.lit("\nbye")).alias("value"))
    return payloads.report_buckets(rows).select("id", "group", "bucket", "name", "remaining")


@query("SELECT p_size AS id, arg_min(p_name, p_partkey) AS label, max(p_retailprice) AS percent, min(p_partkey) AS pos FROM part GROUP BY 1")
def merged_model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-28: rows of one id merged: the highest percent, the first label."""
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("id"), F.col("p_name").alias("label"), F.col("p_retailprice").alias("percent"), F.lit("x").alias("resets_at"), F.col("p_partkey").alias("pos"))
    return payloads.model_rows(rows).select("id", "label", "percent", "pos")


@query("SELECT DISTINCT 'ledger' AS provider, CAST(0 AS BIGINT) AS priced FROM events WHERE user_id % 10 <> 3")
def no_live_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRC-8: a table without a model prices nothing: no turn of a store has a cost there."""
    files = stores.known(_store_files(spark, sf_dir), "v1")
    rows = stores.turns(stores.steps(stores.points(files)), stores.meta(files))
    live = spark.createDataFrame([("nothing", 2.0, 8.0, 0.2, 0.0, 0.0)], "model_norm string, in_per_m double, out_per_m double, cache_read_per_m double, cw5m_per_m double, cw1h_per_m double")
    return pricing.costed(pricing.live_only(rows, live)).groupBy("provider").agg(F.count("cost_nd").alias("priced"))
