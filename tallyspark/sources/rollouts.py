"""Rollout logs: JSON lines whose meaning hangs on their order within a file.

What the order carries (the model of the last context, the counters of the last reading, whether a billing record was seen) is
carried by running functions over file and line, never by a walk. Input lines: file, line, value. A line's number is a row
number or, from `read`, the offset of its first byte: either way a turn keeps its id when files are added or moved.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.frames import running, written
from tallyspark.functions.text import percent_slug, prompt_title
from tallyspark.sources import scan
from tallyspark.sources.logs import iso_time

_COUNTS = "struct<input_tokens: bigint, cached_input_tokens: bigint, cache_write_input_tokens: bigint, output_tokens: bigint, reasoning_output_tokens: bigint>"
LINE = f"""
timestamp string, type string, payload struct<
  type: string, session_id: string, id: string, cwd: string, originator: string, thread_source: string, agent_nickname: string, agent_path: string,
  turn_id: string, model: string, effort: string, thread_id: string, response_id: string, usage: {_COUNTS}, info: struct<total_token_usage: {_COUNTS}>,
  role: string, kind: string, content: array<struct<type: string, text: string>>>
"""
#: Lines of a file to a slice of its running functions, and bytes where lines are numbered by their first byte.
SLICE, SLICE_BYTES = 100_000, 64 << 20
COUNTERS = {"input": "input_tokens", "cached": "cached_input_tokens", "write": "cache_write_input_tokens", "output": "output_tokens", "reasoning": "reasoning_output_tokens"}


def file_key(file: str | Column) -> Column:
    """The id at the end of a file's name, so that a file moved to the archive is the same one."""
    c = F.col(file) if isinstance(file, str) else file
    found = F.regexp_extract(c, r"([0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\.jsonl$", 1)
    return F.when(found != "", found).otherwise(c)


def parsed(lines: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """Lines as structs (`r`), each file once; only lines that name one of the types are parsed. They are parsed once and
    written, as several aggregates read them."""
    wanted = F.col("value").rlike(f'"({"|".join(types)})"')
    rows = lines.filter(wanted).withColumn("r", F.from_json("value", LINE)).filter(F.col("r.type").isin(*types))
    more = [c for c in lines.columns if c not in ("value", "file", "line")]
    return once_each(written(rows.select(file_key("file").alias("key"), "file", "line", *more, "r")))


def once_each(rows: DataFrame) -> DataFrame:
    """Rows (key, file, line) of files known by their key; of two files with one key the one that goes further (then the smaller
    path)."""
    best = rows.groupBy("key", "file").agg(F.max("line").alias("n")).groupBy("key").agg(F.min_by("file", F.struct(-F.col("n"), "file")).alias("file"))
    return rows.join(best, ["key", "file"], "left_semi")


def turns(lines: DataFrame, slice_: int = SLICE) -> DataFrame:
    """Turns (provider rollout) of rollout lines (file, line, value), with key and fallback project `project`, if there is one.

    A billing record counts by itself, once for each thread and response. Without records, the rises of the cumulative counters
    count; a counter that fell has restarted and counts whole. Readings after a file's first record never count. Usage before
    any model is known is summed up and belongs to the first context, at the time of its first reading. Input is net of cache.
    """
    all_rows = parsed(lines, ("session_meta", "turn_context", "token_usage_record", "event_msg"))
    p = "r.payload"
    total = F.col(f"{p}.info.total_token_usage")
    is_record = (F.col("r.type") == "token_usage_record") & F.col(f"{p}.usage").isNotNull()
    is_count = (F.col("r.type") == "event_msg") & (F.col(f"{p}.type") == "token_count") & total.isNotNull()
    is_context = F.col("r.type") == "turn_context"
    number = lambda s, c: F.coalesce(s[c], F.lit(0))
    reading = F.when(is_count, F.struct(*(number(total, c).alias(k) for k, c in COUNTERS.items())))
    context = F.when(is_context & (F.col(f"{p}.model").isNotNull() | F.col(f"{p}.effort").isNotNull()), F.struct(F.col(f"{p}.model").alias("model"), F.col(f"{p}.effort").alias("effort")))
    rows = running(
        all_rows.withColumns({"_rec": is_record, "_cnt": is_count}), ["key"], ["line"], F.floor(F.col("line") / slice_),
        last={"_model": F.when(is_context, F.col(f"{p}.model")), "_effort": F.when(is_context, F.col(f"{p}.effort")), "_context": context},
        before={"_prev": reading}, total={"_records": is_record.cast("int")},
    )
    # what a file says of itself: its first session_meta, the first folder, and its contexts by turn
    meta = F.struct(F.col(f"{p}.session_id").alias("session_id"), F.col(f"{p}.id").alias("thread_id"), F.col(f"{p}.cwd").alias("cwd"), (F.col(f"{p}.thread_source") == "subagent").alias("sub"), F.coalesce(F.col(f"{p}.agent_nickname"), F.col(f"{p}.agent_path")).alias("kind"))
    is_meta = F.col("r.type") == "session_meta"
    said = all_rows.groupBy("key").agg(F.min_by(F.when(is_meta, meta), F.when(is_meta, F.col("line"))).alias("_meta"), F.min_by(F.when(is_context, F.col(f"{p}.cwd")), F.when(is_context & F.col(f"{p}.cwd").isNotNull(), F.col("line"))).alias("_cwd"))
    contexts = all_rows.filter(is_context).select("key", "line", F.col(f"{p}.turn_id").alias("turn_id"), F.col(f"{p}.model").alias("model"), F.col(f"{p}.effort").alias("effort"))
    exact = contexts.filter("turn_id is not null and (model is not null or effort is not null)")
    exact = exact.groupBy("key", "turn_id").agg(F.max_by(F.struct("model", "effort", "line"), "line").alias("_exact"))

    used = rows.filter("_rec or _cnt").withColumn("turn_id", F.col(f"{p}.turn_id"))
    usage = F.col(f"{p}.usage")
    now_ = {k: number(total, c) for k, c in COUNTERS.items()}
    rise = {k: v - F.coalesce(F.col("_prev")[k], F.lit(0)) for k, v in now_.items()}
    restarted = (rise["input"] < 0) | (rise["output"] < 0)
    delta = {k: F.when(F.col("_rec"), number(usage, COUNTERS[k])).when(restarted, now_[k]).otherwise(rise[k]) for k in COUNTERS}
    used = used.filter("_rec or _records = 0").select(
        "key", "line", "turn_id", "_rec", "_model", "_effort", "_context", F.col("r.timestamp").alias("_time"), F.coalesce(F.col(f"{p}.thread_id"), F.lit("")).alias("_thread"),
        F.coalesce(F.col(f"{p}.response_id"), F.lit("")).alias("_response"), *(d.alias(f"_{k}") for k, d in delta.items()), *([F.col("project")] if "project" in lines.columns else []),
    )
    used = used.filter("_input > 0 or _output > 0")
    # a record repeated in its file counts once; records without a response id always count
    first = used.filter("_rec and _response <> ''").groupBy("key", "_thread", "_response").agg(F.min("line").alias("line")).withColumn("_once", F.lit(True))
    used = used.join(first, ["key", "_thread", "_response", "line"], "left").filter("not _rec or _response = '' or _once")
    used = used.join(exact, ["key", "turn_id"], "left")
    hit = F.when(F.col("_rec") & F.col("_exact").isNotNull() & (F.col("_exact.line") < F.col("line")), F.struct(F.col("_exact.model").alias("model"), F.col("_exact.effort").alias("effort"))).when(F.col("_rec"), F.col("_context"))
    used = used.withColumns({"model": F.coalesce(hit["model"], "_model"), "effort": F.coalesce(hit["effort"], "_effort"), "ts": iso_time("_time")})
    cached, written = F.greatest(F.lit(0), F.col("_cached")), F.greatest(F.lit(0), F.col("_write"))
    counted = used.withColumns({
        "input": F.greatest(F.lit(0), F.col("_input") - cached - written), "output": F.greatest(F.lit(0), F.col("_output")), "cache_read": cached, "cache_write_5m": written,
        "thinking": F.greatest(F.lit(0), F.col("_reasoning")), "project": F.col("project") if "project" in lines.columns else F.lit(""),
    })
    names = ("input", "output", "cache_read", "cache_write_5m", "thinking")
    known = counted.filter("model is not null").select("key", "line", "ts", "model", "effort", "project", *names)
    # pending usage goes to the file's first context with a model
    opened = contexts.filter("model is not null").groupBy("key").agg(F.min(F.struct("line", "model")).alias("_open"))
    effort = F.max_by("effort", F.when(F.col("effort").isNotNull() & (F.col("line") <= F.col("_open.line")), F.col("line")))
    opened = contexts.join(opened, "key").groupBy("key").agg(F.first("_open").alias("_open"), effort.alias("_said"))
    pending = counted.filter("model is null").groupBy("key").agg(F.min("line").alias("_line"), F.min_by("ts", "line").alias("ts"), F.first("project").alias("project"), *(F.sum(n).alias(n) for n in names))
    flushed = pending.join(opened, "key").select("key", F.col("_open.line").alias("line"), "ts", F.col("_open.model").alias("model"), F.col("_said").alias("effort"), "project", *names)
    rows_ = known.unionByName(flushed).join(said, "key", "left")
    sub = F.coalesce("_meta.sub", F.lit(False))
    return rows_.select(
        F.lit("rollout").alias("provider"), F.concat_ws("#", "key", F.col("line").cast("string")).alias("msg_id"), F.col("line").cast("long").alias("seq"), "ts", "model", *(F.col(n).cast("long").alias(n) for n in names[:4]),
        F.lit(0).cast("long").alias("cache_write_1h"), F.col("thinking").cast("long").alias("thinking"), F.coalesce(percent_slug("_meta.cwd"), percent_slug("_cwd"), "project").alias("project"),
        F.coalesce("_meta.session_id", "key").alias("chat_id"), F.when(sub, F.coalesce("_meta.thread_id", "key")).alias("agent_id"), F.when(sub, F.col("_meta.kind")).alias("agent_kind"), "effort",
        F.lit(None).cast("double").alias("reported_cost"),
    )


def chat_events(lines: DataFrame) -> DataFrame:
    """Prompts and compactions of the main threads: a user's first input text that is no instruction block, and `compacted`."""
    rows = parsed(lines, ("session_meta", "response_item", "compacted"))
    p = "r.payload"
    meta = F.struct(F.col(f"{p}.session_id").alias("session_id"), (F.col(f"{p}.thread_source") == "subagent").alias("sub"))
    is_meta = F.col("r.type") == "session_meta"
    said = rows.groupBy("key").agg(F.min_by(F.when(is_meta, meta), F.when(is_meta, F.col("line"))).alias("_meta"))
    first = F.element_at(F.filter(F.col(f"{p}.content"), lambda c: c["type"] == "input_text"), 1)["text"]
    plain = F.when(F.col(f"{p}.kind").isNotNull(), F.col(f"{p}.kind") == "user.text").otherwise(~first.startswith("<") & ~first.startswith("#"))
    typed = (F.col("r.type") == "response_item") & (F.col(f"{p}.type") == "message") & (F.col(f"{p}.role") == "user") & plain
    kind = F.when(typed, "prompt").when(F.col("r.type") == "compacted", "compaction")
    rows = rows.withColumns({"kind": kind, "text": F.when(typed, prompt_title(first))}).filter("kind is not null and (kind = 'compaction' or text is not null)").join(said, "key", "left")
    rows = rows.filter(~F.coalesce("_meta.sub", F.lit(False)))
    return rows.select(F.coalesce("_meta.session_id", "key").alias("chat_id"), iso_time("r.timestamp").alias("at"), F.col("line").cast("long").alias("seq"), "kind", "text").filter("at is not null")


def names(lines: DataFrame) -> DataFrame:
    """The name index (id, thread_name, updated_at): one row for each line, in order."""
    rows = lines.select(F.from_json("value", "id string, thread_name string, updated_at string").alias("r"), "line")
    return rows.filter("r.id is not null").select(F.col("r.id").alias("chat_id"), F.nullif(F.trim("r.thread_name"), F.lit("")).alias("name"), F.col("r.updated_at").alias("updated_at"), F.col("line").alias("seq"))


def read(spark: SparkSession, roots: list[str], now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, chat events) of all rollout logs under the roots, live and archived. A turn's id is its file's key and the first
    byte of its line, so a file that moves or grows, or is read in other ranges, gives the same turns."""
    lines = reduce(DataFrame.unionByName, (scan.lines(spark, root, now) for root in roots))
    lines = lines.select("value", "file", "line", F.regexp_extract("file", r"([^/]*)\.jsonl$", 1).alias("project"))
    return turns(lines, SLICE_BYTES), chat_events(lines)
