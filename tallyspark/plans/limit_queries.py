"""Limit windows: bins, shares, prices, past windows, stretches."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.frames import small, within, written
from tallyspark.operators import limits
from tallyspark.plans import binding as b
from tallyspark.plans.binding import flat
from tallyspark.plans.catalog import query
from tallyspark.plans.quota_queries import RESETS

_W = "service, window_id"
BINS = f"""{b.TURNS}, {b.READINGS_CTE.replace("window_id", "cell_id")}, {b.WINDOWS_CTE},
frame AS (SELECT service, window_id, start, "end", CAST(greatest(1, ceil((epoch_us("end") - epoch_us(start)) / 1.8e9)) AS INTEGER) AS n FROM windows),
most AS (SELECT w.service, w.window_id, CAST(least(greatest(ceil((epoch_us(r.ts) - epoch_us(w.start)) / 1.8e9) - 1, 0), f.n - 1) AS INTEGER) AS bin, max(r.percent) AS percent FROM readings r JOIN windows w ON r.service = w.service AND r.bucket = w.bucket AND r.ts > w.start AND r.ts <= w."end" JOIN frame f ON f.service = w.service AND f.window_id = w.window_id GROUP BY 1, 2, 3),
reach AS (SELECT *, coalesce(max(percent) OVER (PARTITION BY {_W} ORDER BY bin), 0) AS reached FROM (SELECT f.service, f.window_id, f.start, f."end", f.bin, m.percent FROM (SELECT *, unnest(range(n)) AS bin FROM frame) f LEFT JOIN most m ON m.service = f.service AND m.window_id = f.window_id AND m.bin = f.bin)),
bins AS (SELECT {_W}, start, "end", bin, reached, reached - coalesce(lag(reached) OVER (PARTITION BY {_W} ORDER BY bin), 0) AS delta FROM reach),
inside AS (SELECT t.*, w.window_id, w.start, w."end", CAST(least(floor((epoch_us(t.ts) - epoch_us(w.start)) / 1.8e9), w.n - 1) AS INTEGER) AS bin FROM (SELECT *, provider AS service FROM turns) t JOIN frame w ON t.service = w.service AND t.ts >= w.start AND t.ts < w."end"),
use AS (SELECT {_W}, bin, chat_id, CAST(sum(cost_nd) AS BIGINT) AS cost_nd, CAST(sum(tokens) AS BIGINT) AS tokens FROM inside GROUP BY ALL),
whole AS (SELECT {_W}, bin, sum(cost_nd) AS c, sum(tokens) AS t, count(*) AS n FROM use GROUP BY ALL),
placed AS (SELECT b.*, CASE WHEN o.n IS NOT NULL THEN b.bin WHEN p.n IS NOT NULL THEN b.bin - 1 END AS src FROM bins b LEFT JOIN whole o ON o.service = b.service AND o.window_id = b.window_id AND o.bin = b.bin LEFT JOIN whole p ON p.service = b.service AND p.window_id = b.window_id AND p.bin = b.bin - 1 WHERE delta > 0),
parts AS (SELECT p.service, p.window_id, p.bin, u.chat_id, CASE WHEN u.chat_id IS NULL THEN delta WHEN w.c > 0 THEN delta * u.cost_nd::DOUBLE / w.c::DOUBLE WHEN w.t > 0 THEN delta * u.tokens::DOUBLE / w.t::DOUBLE ELSE delta / w.n END AS points
  FROM placed p LEFT JOIN use u ON u.service = p.service AND u.window_id = p.window_id AND u.bin = p.src LEFT JOIN whole w ON w.service = p.service AND w.window_id = p.window_id AND w.bin = p.src),
shares AS (SELECT c.*, coalesce(p.points, 0) AS points FROM (SELECT {_W}, chat_id, CAST(sum(cost_nd) AS BIGINT) AS cost_nd, CAST(sum(tokens) AS BIGINT) AS tokens, max(ts) AS last_at, arg_max(project, (agent_id IS NULL, ts, seq)) AS project FROM inside GROUP BY ALL) c
  LEFT JOIN (SELECT {_W}, chat_id, sum(points) AS points FROM parts WHERE chat_id IS NOT NULL GROUP BY ALL) p USING (service, window_id, chat_id)),
folded_projects AS (SELECT {_W}, project, sum(points) AS points, CAST(sum(cost_nd) AS BIGINT) AS cost_nd, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS chats FROM shares GROUP BY ALL),
totals AS (SELECT b.service, b.window_id, b.percent, b.start, b."end", coalesce(o.outside, 0) AS outside, b.percent - coalesce(o.outside, 0) AS attributed, coalesce(s.cost_nd, 0) AS cost_nd, coalesce(s.tokens, 0) AS tokens
  FROM (SELECT {_W}, max(reached) AS percent, min(start) AS start, min("end") AS "end" FROM bins GROUP BY ALL) b LEFT JOIN (SELECT {_W}, sum(points) FILTER (chat_id IS NULL) AS outside FROM parts GROUP BY ALL) o USING (service, window_id) LEFT JOIN (SELECT {_W}, CAST(sum(cost_nd) AS BIGINT) AS cost_nd, CAST(sum(tokens) AS BIGINT) AS tokens FROM shares GROUP BY ALL) s USING (service, window_id))
"""


def _page(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(windows, bins, parts, chats)"""
    windows, turns = b.windows(spark, sf_dir), b.turns(spark, sf_dir)
    cut = limits.bins(windows, b.readings(spark, sf_dir).drop("window_id"))
    parts = limits.attribution(cut, limits.bin_use(windows, turns))
    return windows, cut, parts, limits.chat_shares(windows, turns, parts)


@query(f"{BINS} SELECT {_W}, bin, delta, reached FROM bins")
def limit_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-9, WIN-10, JON-4, FLT-1: how far each half hour raised the percent."""
    return _page(spark, sf_dir)[1].select("service", "window_id", "bin", "delta", "reached")


@query(f"{BINS} SELECT {_W}, bin, chat_id, cost_nd, tokens FROM use")
def bin_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-11: cost by half hour and chat."""
    return limits.bin_use(b.windows(spark, sf_dir), b.turns(spark, sf_dir))


@query(f"{BINS} SELECT {_W}, bin, coalesce(chat_id, '') AS chat_id, round(points, 6) AS points FROM parts")
def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-12, JON-3."""
    return _page(spark, sf_dir)[2].select("service", "window_id", "bin", F.coalesce("chat_id", F.lit("")).alias("chat_id"), F.round("points", 6).alias("points"))


@query(f"{BINS} SELECT {_W}, chat_id, project, cost_nd, tokens, epoch_us(last_at) AS last_at, round(points, 6) AS points FROM shares")
def chat_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: chats of each window."""
    return flat(_page(spark, sf_dir)[3].select("service", "window_id", "chat_id", "project", "cost_nd", "tokens", "last_at", F.round("points", 6).alias("points")))


@query(f"{BINS} SELECT {_W}, project, round(points, 6) AS points, cost_nd, tokens, chats FROM folded_projects")
def project_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-25: projects of each window."""
    return limits.project_shares(_page(spark, sf_dir)[3]).withColumn("points", F.round("points", 6))


@query(f"""{BINS} SELECT {_W}, percent, round(outside, 6) AS outside, cost_nd, tokens, round(CASE WHEN attributed + 1e-9 >= 1 THEN cost_nd / attributed END, 2) AS point_nd, round(CASE WHEN attributed + 1e-9 >= 1 THEN tokens / attributed END, 4) AS point_tokens FROM totals""")
def window_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-15: the price of a percent."""
    _, cut, parts, chats = _page(spark, sf_dir)
    out = limits.window_totals(cut, parts, chats)
    return out.select("service", "window_id", "percent", F.round("outside", 6).alias("outside"), "cost_nd", "tokens", F.round("point_nd", 2).alias("point_nd"), F.round("point_tokens", 4).alias("point_tokens"))


@query(f"""{BINS}, priced AS (SELECT *, CASE WHEN attributed + 1e-9 >= 1 THEN cost_nd / attributed END AS point_nd FROM totals WHERE window_id < 0),
models AS (SELECT {_W}, coalesce(name, model) AS name, sum(cost_nd) AS nd FROM inside WHERE window_id < 0 GROUP BY ALL), top AS (SELECT {_W}, arg_min(name, (-nd, name)) AS model, max(nd) AS model_nd FROM models GROUP BY ALL),
rows_ AS (SELECT p.*, t.model, t.model_nd FROM priced p JOIN top t USING (service, window_id) WHERE attributed + 1e-9 >= 10 AND point_nd IS NOT NULL),
cur AS (SELECT * REPLACE (point_nd * 0.6 AS point_nd) FROM rows_ QUALIFY row_number() OVER (PARTITION BY service ORDER BY start DESC) = 1),
side AS (SELECT c.service, c.start AS at_, c.point_nd AS price, c.model AS model, r.point_nd AS was, r.model AS was_model, r.model_nd FROM cur c JOIN rows_ r ON r.service = c.service AND r."end" <= c.start AND r.start >= (SELECT now - INTERVAL 31 DAY FROM clock)),
mean AS (SELECT service, any_value(price) AS price, any_value(model) AS model, avg(was) AS usual_price, count(*) AS usual_weeks FROM side GROUP BY 1), um AS (SELECT service, arg_min(was_model, (-nd, was_model)) AS usual FROM (SELECT service, was_model, sum(model_nd) AS nd FROM side GROUP BY 1, 2) GROUP BY 1)
SELECT service, round(price, 2) AS price, round(usual_price, 2) AS usual_price, CAST(round((1 - price / usual_price) * 100) AS INTEGER) AS percent_less, usual_weeks, CASE WHEN usual <> model THEN usual END AS usual_model, model FROM mean JOIN um USING (service) WHERE usual_price > 0 AND price < 0.75 * usual_price""")
def change_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-16: a point of this week (made to cost 0.6 of what it did) against the weeks before."""
    windows, cut, parts, chats = _page(spark, sf_dir)
    weeks = windows.filter("bucket = 'seven_day'")
    rows = limits.window_totals(cut, parts, chats).join(limits.window_models(weeks, b.turns(spark, sf_dir)), limits.WINDOW)
    rows = rows.filter((F.col("attributed") + 1e-9 >= 10) & F.col("point_nd").isNotNull())
    newest = rows.groupBy("service").agg(F.max("start").alias("start"))
    current = rows.join(newest, ["service", "start"], "left_semi").withColumn("point_nd", F.col("point_nd") * 0.6)
    out = limits.change_signal(current, rows, b.now(spark, sf_dir) - timedelta(days=31))
    return out.withColumns({"price": F.round("price", 2), "usual_price": F.round("usual_price", 2)})


@query(f"""{b.TURNS}, p AS (SELECT now - INTERVAL 7 DAY AS a, now AS z FROM clock), i AS (SELECT chat_id, CAST(floor((epoch_us(ts) - epoch_us(a)) / 1.8e9) AS INTEGER) AS bin, cost_nd FROM turns, p WHERE ts >= a AND ts < z)
SELECT 'chat' AS part, chat_id, bin, round(sum(cost_nd) * 100 / 5e9::DOUBLE, 6) AS points FROM i GROUP BY ALL UNION ALL SELECT 'outside', '', -1, 20.0 UNION ALL SELECT 'earlier', '', -1, 5.0""")
def spend_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-17, WIN-34: a budget of five dollars, a dollar spent elsewhere, a quarter earlier."""
    at = b.now(spark, sf_dir)
    rows = limits.spend_share(b.turns(spark, sf_dir), at - timedelta(days=7), at, 5e9, 1e9, 2.5e8)
    return rows.select("part", F.coalesce("chat_id", F.lit("")).alias("chat_id"), F.coalesce("bin", F.lit(-1)).alias("bin"), F.round("points", 6).alias("points"))


@query(f"""{BINS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {_W} ORDER BY points DESC, cost_nd DESC, project) AS k FROM folded_projects), s AS (SELECT p.service, p.window_id, p.bin, p.points, CASE WHEN p.chat_id IS NULL THEN 'outside' WHEN r.k <= 3 THEN r.project ELSE 'other' END AS series, CASE WHEN p.chat_id IS NULL THEN 5 WHEN r.k <= 3 THEN r.k ELSE 4 END AS place
  FROM parts p LEFT JOIN shares c ON c.service = p.service AND c.window_id = p.window_id AND c.chat_id = p.chat_id LEFT JOIN ranked r ON r.service = p.service AND r.window_id = p.window_id AND r.project = c.project),
g AS (SELECT {_W}, bin, series, place, sum(points) AS points FROM s GROUP BY ALL) SELECT {_W}, bin, series, CAST(place AS INTEGER) AS place, round(points, 5) AS points, round(coalesce(sum(points) OVER (PARTITION BY {_W}, bin ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 5) AS base FROM g""")
def timeline_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-31: the windows' bars by their three largest projects."""
    _, _, parts, chats = _page(spark, sf_dir)
    out = limits.timeline(parts, chats, 3)
    return out.select("service", "window_id", "bin", "series", "place", F.round("points", 5).alias("points"), F.round("base", 5).alias("base"))


@query(f"""{BINS}, f AS (SELECT * FROM (VALUES ('p1', 'p0'), ('p2', 'p0'), ('p3', 'p4')) t(project, main)) SELECT {_W}, coalesce(main, project) AS project, count(*) AS chats, CAST(sum(cost_nd) AS BIGINT) AS cost_nd FROM shares LEFT JOIN f USING (project) GROUP BY ALL""")
def folded_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-5, JON-15: worktrees count under their repository; ambiguous ones stay."""
    links = spark.createDataFrame([("p1", "p0", "2024-01-05"), ("p2", "p9", "2024-01-01"), ("p2", "p0", "2024-01-09"), ("p3", "p4", "2024-01-02")], "path_slug string, main_slug string, seen string")
    newest = limits.newest_links(links.withColumn("seen_at", F.col("seen").cast("timestamp_ntz")), b.now(spark, sf_dir))
    both = newest.select("path_slug", "main_slug").unionByName(spark.createDataFrame([("p5", "p0"), ("p5", "p6")], "path_slug string, main_slug string"))
    chats = limits.folded_projects(_page(spark, sf_dir)[3], limits.worktree_folds(both))
    return limits.project_shares(chats).select("service", "window_id", "project", "chats", "cost_nd")


@query(f"""{BINS}, n AS (SELECT service, max(window_id) FILTER (window_id >= 0) AS s, min(window_id) AS w FROM windows GROUP BY 1)
SELECT x.service, x.chat_id, max(round(x.points * 10) / 10) FILTER (x.window_id = n.s) AS session_share, max(round(x.points * 10) / 10) FILTER (x.window_id = n.w) AS week_share, CAST(NULL AS DOUBLE) AS budget_share
FROM shares x JOIN n USING (service) WHERE x.window_id IN (n.s, n.w) GROUP BY 1, 2""")
def published_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-6, WIN-38: a chat's share of the open session and week."""
    windows, _, _, chats = _page(spark, sf_dir)
    last = windows.groupBy("service").agg(F.max(F.when(F.col("window_id") >= 0, F.col("window_id"))).alias("s"), F.min("window_id").alias("w"))
    rows = chats.join(small(last, last.count()), "service").withColumn("field", F.when(F.col("window_id") == F.col("s"), "session").when(F.col("window_id") == F.col("w"), "week"))
    return limits.published(rows.filter("field is not null"))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open window of each bucket of `readings`."""
    rows = b.windows(spark, sf_dir).groupBy("service", "bucket").agg(F.max(F.struct("start", "end")).alias("x")).select("service", "bucket", "x.start")
    return rows.withColumn("length", F.when(F.col("bucket") == "five_hour", float(b.HOURS5)).otherwise(float(b.WEEK)))


_CUR = 'cur AS (SELECT service, bucket, max(start) AS cur FROM windows GROUP BY 1, 2)'


@query(f"""{b.READINGS}, {b.WINDOWS_CTE}, {_CUR}, {RESETS}, d AS (SELECT r.service, r.bucket, last_before AS start, coalesce(lead(last_before) OVER (PARTITION BY r.service, r.bucket ORDER BY last_before), cur) AS fin FROM resets r JOIN cur c ON c.service = r.service AND c.bucket = r.bucket WHERE first_after < cur - INTERVAL 30 MINUTE)
SELECT service, bucket, epoch_us(start) AS start, epoch_us(fin) AS "end" FROM d, clock WHERE start >= now - INTERVAL 31 DAY AND start < fin AND EXISTS (SELECT 1 FROM readings x WHERE x.service = d.service AND x.bucket = d.bucket AND x.ts > d.start AND x.ts <= d.fin AND x.percent > 0)""")
def past_windows_by_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-6, JON-11."""
    return flat(limits.past_windows_by_drops(b.readings(spark, sf_dir), _current(spark, sf_dir), b.now(spark, sf_dir) - timedelta(days=31)))


_PASS = "PARTITION BY service, bucket ORDER BY ts, percent"


@query(f"""{b.READINGS}, {b.WINDOWS_CTE}, cur AS (SELECT service, bucket, max(start) AS cur, CASE WHEN bucket = 'five_hour' THEN {b.HOURS5} ELSE {b.WEEK} END AS len FROM windows GROUP BY 1, 2),
l AS (SELECT *, lag(percent) OVER w AS p, lag(ts) OVER w AS pt, lag(resets_at) OVER w AS pr, lead(percent) OVER w AS q, last_value(resets_at IGNORE NULLS) OVER ({_PASS} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS named FROM readings, clock WHERE ts >= now - INTERVAL 39 DAY WINDOW w AS ({_PASS})),
r AS (SELECT *, sum(CASE WHEN resets_at IS NOT NULL AND (named IS NULL OR abs(epoch_us(resets_at) - epoch_us(named)) >= 600000000) THEN 1 ELSE 0 END) OVER ({_PASS} ROWS UNBOUNDED PRECEDING) AS run FROM l),
g AS (SELECT service, bucket, run, min(resets_at) AS low, max(resets_at) AS high, arg_max(window_seconds, (ts, percent)) AS secs, bool_or(percent > 0) AS zero, min(ts) AS first_ts, max(ts) AS last_ts FROM r WHERE resets_at IS NOT NULL GROUP BY 1, 2, 3),
named AS (SELECT g.*, cur, high - to_microseconds(CAST(coalesce(secs, len) * 1e6 AS BIGINT)) AS start, low - INTERVAL 10 MINUTE < cur + to_seconds(len) AND cur + to_seconds(len) < high + INTERVAL 10 MINUTE AS open FROM g JOIN cur USING (service, bucket)),
d AS (SELECT service, bucket, pt AS a, ts AS z, cur FROM r JOIN cur USING (service, bucket) WHERE p - percent >= 5 AND (q IS NULL OR p - q >= 5) AND (pr IS NULL OR resets_at IS NULL) AND ts <= cur AND NOT EXISTS (SELECT 1 FROM g WHERE g.service = r.service AND g.bucket = r.bucket AND g.first_ts <= r.pt AND g.last_ts >= r.ts)),
early AS (SELECT service, bucket, min(a) AS seen FROM d WHERE z > cur - INTERVAL 30 MINUTE GROUP BY 1, 2),
s AS (SELECT DISTINCT service, bucket, coalesce((SELECT arg_min(high, run) FROM g WHERE g.service = d.service AND g.bucket = d.bucket AND d.a < high AND high <= d.z), a) AS t0 FROM d WHERE z <= cur - INTERVAL 30 MINUTE),
plain AS (SELECT service, bucket, t0 FROM s WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.service = s.service AND n.bucket = s.bucket AND abs(epoch_us(n.start) - epoch_us(s.t0)) < 600000000)
  UNION SELECT service, bucket, high FROM named n WHERE NOT open AND NOT EXISTS (SELECT 1 FROM named o WHERE o.service = n.service AND o.bucket = n.bucket AND o.start - INTERVAL 10 MINUTE < n.high AND n.high < o.high)),
found AS (SELECT service, bucket, start, high AS own_end, high AS reset_high, zero FROM named WHERE NOT open UNION ALL SELECT service, bucket, t0, NULL, NULL, false FROM plain),
e AS (SELECT f.*, least((SELECT min(start) FROM found o WHERE o.service = f.service AND o.bucket = f.bucket AND o.start > f.start), cur, CASE WHEN own_end IS NOT NULL THEN own_end WHEN seen > f.start THEN seen END) AS fin FROM found f JOIN cur USING (service, bucket) LEFT JOIN early USING (service, bucket))
SELECT service, bucket, epoch_us(start) AS start, epoch_us(fin) AS "end", coalesce(epoch_us(reset_high), -1) AS reset_high FROM e, clock WHERE start >= now - INTERVAL 31 DAY AND start < fin AND (zero OR EXISTS (SELECT 1 FROM readings x WHERE x.service = e.service AND x.bucket = e.bucket AND x.resets_at IS NULL AND x.percent > 0 AND x.ts >= now - INTERVAL 31 DAY AND x.ts > e.start AND x.ts <= e.fin))""")
def past_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-7: from named resets and held drops; also tested against a walk of wild histories."""
    out = flat(limits.past_windows(b.readings(spark, sf_dir), _current(spark, sf_dir), b.now(spark, sf_dir) - timedelta(days=31)))
    return out.select("service", "bucket", "start", "end", F.coalesce("reset_high", F.lit(-1)).alias("reset_high"))


@query(f"""{b.READINGS}, {b.WINDOWS_CTE}, {_CUR}, o AS (SELECT r.* FROM readings r JOIN cur c USING (service, bucket) WHERE resets_at IS NULL OR resets_at > cur + INTERVAL 10 MINUTE) SELECT service, bucket, count(*) AS n, max(percent) AS percent FROM o GROUP BY 1, 2""")
def open_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-8: the readings of the open windows."""
    return limits.open_readings(b.readings(spark, sf_dir), _current(spark, sf_dir)).groupBy("service", "bucket").agg(F.count("*").alias("n"), F.max("percent").alias("percent"))


@query()
def restored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-13: readings before a restore scaled; tested against a walk."""
    windows = b.windows(spark, sf_dir).select("service", "bucket", "start", "end")
    rows = within(b.readings(spark, sf_dir).drop("window_id"), "ts", windows, ["service", "bucket"], (F.col("ts") > F.col("start")) & (F.col("ts") <= F.col("end")), b.HOURS5)
    rows = rows.select("service", "bucket", "start", "end", "ts", "percent")
    return flat(limits.restored(rows).withColumn("percent", F.round("percent", 6)))


@query()
def stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-18, WIN-19, WIN-20, WIN-21, WIN-37: chats of the windows cut at compactions and cold starts; tested against a walk."""
    windows, turns = b.windows(spark, sf_dir), limits.kept_turns(b.turns(spark, sf_dir))
    cut = written(limits.bins(windows, b.readings(spark, sf_dir).drop("window_id")))
    out = limits.stretches(windows, turns, b.chat_events(spark, sf_dir), limits.attribution(cut, limits.bin_use(windows, turns, cut)))
    return flat(out.withColumn("points", F.round("points", 6)))


@query(f"""{b.TURNS}, c AS (SELECT chat_id, seq, cost_input + cost_cache_write AS rebuild, input + cache_read + cache_write_5m + cache_write_1h AS prompt, cache_read, cache_write_5m + cache_write_1h AS w, agent_id FROM (SELECT * REPLACE (seq % 50 AS cache_read, cache_read * 3 AS cache_write_5m) FROM turns))
SELECT chat_id, count(*) AS cold_starts, CAST(sum(rebuild) AS BIGINT) AS rebuild_nd FROM c WHERE agent_id IS NULL AND prompt > 0 AND cache_read < prompt * 0.05 AND w >= 10000 GROUP BY 1""")
def cold_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-19: main-thread turns that rebuilt their context."""
    rows = b.turns(spark, sf_dir).withColumns({"cache_read": F.col("seq") % 50, "cache_write_5m": F.col("cache_read") * 3})
    cold = rows.filter(limits.is_cold_start())
    return cold.groupBy("chat_id").agg(F.count("*").alias("cold_starts"), F.sum(F.col("cost_input") + F.col("cost_cache_write")).alias("rebuild_nd"))


@query(f"""{b.SERVICES}, l AS (SELECT *, CASE WHEN window_seconds > 0 THEN window_seconds WHEN kind = 'session' THEN 18000.0 WHEN bucket LIKE 'seven_day%' OR kind IN ('weekly', 'modelSpecific') THEN 604800.0 END AS len, TIMESTAMP '2024-01-30 12:00:00' AS now FROM buckets),
w AS (SELECT *, epoch_us(resets_at) - CAST(len * 1e6 AS BIGINT) AS s, least(epoch_us(now), epoch_us(resets_at)) AS e FROM l WHERE resets_at IS NOT NULL AND len IS NOT NULL) SELECT service, pos, s AS start, e AS "end", CAST(len AS DOUBLE) AS length FROM w WHERE s < e""")
def current_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-28."""
    rows = b.buckets(spark, sf_dir)
    out = limits.current_windows(rows.withColumn("bucket", F.concat_ws("#", "bucket", "pos")), datetime(2024, 1, 30, 12))
    return flat(out.select("service", F.element_at(F.split("bucket", "#"), -1).cast("int").alias("pos"), "start", "end", "length"))


@query(f"""{b.SERVICES}, l AS (SELECT *, CASE WHEN window_seconds > 0 THEN window_seconds WHEN kind = 'session' THEN 18000.0 WHEN bucket LIKE 'seven_day%' OR kind IN ('weekly', 'modelSpecific') THEN 604800.0 END AS len, (epoch_us(resets_at) - epoch_us(TIMESTAMP '2024-01-30 12:00:00')) / 1e6 AS left_ FROM buckets)
SELECT service, pos, round(CASE WHEN left_ > 0 AND left_ <= len THEN 1 - left_ / len END, 9) AS elapsed FROM l""")
def elapsed_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-27."""
    return limits.elapsed(b.buckets(spark, sf_dir), datetime(2024, 1, 30, 12)).select("service", "pos", F.round("elapsed", 9).alias("elapsed"))


@query(f"""{b.SERVICES} SELECT service, CASE WHEN n_nationkey % 5 = 0 THEN 'subscription' WHEN extra_enabled AND extra_limit > 0 THEN 'spend_limit' WHEN n_nationkey % 2 = 0 THEN 'budget' END AS mode FROM services JOIN nation ON n_name = name""")
def account_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-5."""
    n = F.substring("service", 2, 9).cast("int")
    rows = b.services(spark, sf_dir).withColumns({"has_windows": n % 5 == 0, "pay_as_you_go": n % 2 == 0})
    return rows.select("service", limits.account_mode().alias("mode"))


@query()
def limit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-36: one page's parts (bins, chats, projects, totals, stretches) counted; each has a query of its own."""
    page = limits.load(b.windows(spark, sf_dir), b.readings(spark, sf_dir).drop("window_id"), b.turns(spark, sf_dir), b.chat_events(spark, sf_dir))
    out = None
    for name, rows in page.items():
        one = rows.groupBy("service").agg(F.count("*").alias("rows")).withColumn("part", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""{BINS} SELECT {_W}, chat_id, CAST(row_number() OVER w AS INTEGER) AS rank, count(*) OVER (PARTITION BY {_W}) AS total FROM shares WINDOW w AS (PARTITION BY {_W} ORDER BY round(points, 6) DESC, cost_nd DESC, chat_id) QUALIFY row_number() OVER w <= 8""")
def ranked_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RNK-8: the first eight chats of each window, and how many there are."""
    chats = _page(spark, sf_dir)[3].withColumn("points", F.round("points", 6))
    return limits.ranked_rows(chats, "chat_id").select("service", "window_id", "chat_id", "rank", "total")
