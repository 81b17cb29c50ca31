"""Generational session stores: a folder for each session, with snapshots and journals of cumulative counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.moments import moment
from tallyspark.operators.pricing import MOST, saturating_sum

_SESSION = "struct<tokenUsage: struct<inputTokens: bigint, cachedInputTokens: bigint, outputTokens: bigint>, updatedAt: double>"
MARKER = "set_envelope"


def read(spark: SparkSession, root: str) -> DataFrame:
    """Whole files under `root`: session (the folder), name (within it), value."""
    rows = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root).select("value", F.col("_metadata.file_path").alias("file"))
    base = root.rstrip("/") + "/"
    inner = F.regexp_extract("file", "^.*?" + base + "(.*)$", 1)
    return rows.select(F.substring_index(inner, "/", 1).alias("session"), F.regexp_replace(inner, "^[^/]*/", "").alias("name"), "value")


def known(files: DataFrame, store_format: str) -> DataFrame:
    """The files of sessions whose CURRENT names the known format; other folders are skipped whole."""
    ok = files.filter("name = 'CURRENT'").filter(F.get_json_object("value", "$.store_format") == store_format).select("session")
    return files.join(ok, "session", "left_semi")


def meta(files: DataFrame) -> DataFrame:
    j = lambda p: F.get_json_object("value", p)
    return files.filter("name = 'meta.json'").select("session", j("$.title").alias("title"), j("$.environment.working_directory").alias("cwd"), j("$.config.active_model").alias("active_model"), j("$.config.model_name").alias("model_name"))


def points(files: DataFrame) -> DataFrame:
    """Counters (session, at_ms, input, cached, output) of every snapshot and journal envelope; those without input, output or
    time are dropped."""
    shots = files.filter(F.col("name").rlike("^generations/[^/]+/projection-state.json$")).select("session", F.from_json("value", f"snapshot struct<session: {_SESSION}>").alias("r")).select("session", F.col("r.snapshot.session").alias("s"))
    lines = files.filter(F.col("name").rlike(r"^journal/[^/]+\.jsonl$")).select("session", F.explode(F.split("value", "\n")).alias("line")).filter(F.col("line").contains(MARKER))
    delta = f"type string, payload struct<delta: array<struct<op: string, state: struct<session: {_SESSION}>>>>"
    moved = lines.select("session", F.from_json("line", delta).alias("r")).filter("r.type = 'projection_delta'").select("session", F.explode("r.payload.delta").alias("d")).filter(f"d.op = '{MARKER}'").select("session", F.col("d.state.session").alias("s"))
    u = "s.tokenUsage"
    rows = shots.unionByName(moved).filter(f"{u}.inputTokens is not null and {u}.outputTokens is not null and s.updatedAt is not null")
    zero = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))).cast("long")
    return rows.select("session", F.col("s.updatedAt").alias("at_ms"), zero(f"{u}.inputTokens").alias("input"), zero(f"{u}.cachedInputTokens").alias("cached"), zero(f"{u}.outputTokens").alias("output"))


def _saturated(a: str, b: str):
    return F.least(F.lit(MOST).cast("decimal(38,0)"), F.col(a).cast("decimal(38,0)") + F.col(b)).cast("long")


def steps(points_: DataFrame) -> DataFrame:
    """The rises of each session's counters: points in order of time and total, each whose total is above all before it; its
    rises are against the last such point, component by component, never below 0. Repeats and falls yield nothing."""
    rows = points_.withColumn("total", _saturated("input", "output"))
    w = Window.partitionBy("session").orderBy("at_ms", "total", "input", "cached")  # one session's points: a few for each turn
    top = F.coalesce(F.max("total").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("_top", top).filter("total > _top")
    rise = lambda c: F.greatest(F.lit(0), F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))).alias(c)
    return kept.select("session", F.timestamp_millis(F.col("at_ms").cast("long")).cast("timestamp_ntz").alias("at"), rise("input"), rise("cached"), rise("output"))


def tidied(steps_: DataFrame, now) -> DataFrame:
    """Steps with those older than 31 days summed up by session and day, none older than 366 days (`turns` counts steps)."""
    from datetime import timedelta

    kept = steps_.filter(F.col("at") >= moment(now - timedelta(days=366)))
    old = F.col("at") < moment(now - timedelta(days=31))
    return kept.groupBy("session", F.when(old, F.to_date("at").cast("timestamp_ntz")).otherwise(F.col("at")).alias("_day"), old.alias("folded")).agg(
        F.max("at").alias("at"), *(saturating_sum(c).alias(c) for c in ("input", "cached", "output")), F.count("*").alias("turns")
    ).drop("_day")


def turns(steps_: DataFrame, meta_: DataFrame) -> DataFrame:
    """Steps as turns (provider ledger): input net of cache, the chat's model and folder."""
    rows = steps_.join(meta_, "session", "left")
    return rows.select(
        F.lit("ledger").alias("provider"), F.concat_ws("|", "session", F.col("at").cast("string")).alias("msg_id"), F.unix_micros(F.col("at").cast("timestamp")).alias("seq"), F.col("at").alias("ts"),
        F.coalesce("active_model", "model_name", F.lit("unknown")).alias("model"), F.greatest(F.lit(0), F.col("input") - F.col("cached")).cast("long").alias("input"), "output", F.col("cached").alias("cache_read"),
        F.lit(0).cast("long").alias("cache_write_5m"), F.lit(0).cast("long").alias("cache_write_1h"), F.lit(0).cast("long").alias("thinking"), F.coalesce("cwd", F.lit("")).alias("project"), F.col("session").alias("chat_id"),
        F.lit(None).cast("string").alias("agent_id"), F.lit(None).cast("string").alias("agent_kind"), F.lit(None).cast("string").alias("effort"), F.lit(None).cast("double").alias("reported_cost"),
    )
