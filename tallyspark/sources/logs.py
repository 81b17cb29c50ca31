"""Assistant logs: JSON lines of turns, titles, prompts and compactions, one file for each session."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.text import title
from tallyspark.operators.dedup import composite_id
from tallyspark.sources import scan

LINE = """
type string, timestamp string, sessionId string, agentId string, attributionAgent string, effort string, isSidechain boolean,
subtype string, aiTitle string, origin struct<kind: string>,
message struct<id: string, model: string, content: string, usage: struct<
  input_tokens: bigint, output_tokens: bigint, cache_read_input_tokens: bigint, cache_creation_input_tokens: bigint,
  cache_creation: struct<ephemeral_5m_input_tokens: bigint, ephemeral_1h_input_tokens: bigint>,
  output_tokens_details: struct<thinking_tokens: bigint>>>
"""


def ingest_order() -> Column:
    """The order of ingest of lines (file, line): along each file, files by a hash of their path. It is the same however files
    are split and whatever files are added."""
    return F.shiftleft(F.pmod(F.xxhash64("file"), F.lit(1 << 22)), 40) + F.col("line")


def incomplete(lines: DataFrame) -> DataFrame:
    """Lines that are no JSON object: a file's half-written last one, or noise."""
    return lines.filter(~F.coalesce(F.try_parse_json("value").isNotNull(), F.lit(False)))


def iso_time(text: str | Column) -> Column:
    """ISO 8601 with or without a fraction; null if it is neither."""
    c = F.col(text) if isinstance(text, str) else text
    good = c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(good, F.try_to_timestamp(c).cast("timestamp_ntz"))


def project_of(file: str | Column, root: str) -> Column:
    """The folder below the root that holds the file."""
    c = F.col(file) if isinstance(file, str) else file
    return F.element_at(F.split(F.regexp_extract(c, "^.*?" + root.rstrip("/") + "/(.*)$", 1), "/"), 1)


def parsed(lines: DataFrame) -> DataFrame:
    """Lines as structs (`rec`); what is no JSON object is dropped. Only four kinds of lines can matter, so only lines that
    name one are parsed."""
    wanted = F.col("value").rlike('"(assistant|ai-title|user|system)"')
    rows = lines.filter(wanted).withColumn("rec", F.from_json("value", LINE))
    return rows.filter("rec.type is not null")


def turns(records: DataFrame, provider: str = "assistant") -> DataFrame:
    """Turn records of parsed lines (rec, project, seq); still with later readings of one id. Rows without a usable time go."""
    m, u = "rec.message", "rec.message.usage"
    n = lambda c: F.coalesce(F.col(f"{u}.{c}"), F.lit(0)).cast("long")
    split = F.col(f"{u}.cache_creation").isNotNull()
    whole = F.greatest(F.lit(0), F.coalesce(F.col(f"{u}.cache_creation_input_tokens"), F.lit(0)))
    rows = records.filter(f"rec.type = 'assistant' and {u} is not null").select(
        F.lit(provider).alias("provider"), F.coalesce(F.col(f"{m}.id"), F.lit("")).alias("msg_id"), F.col("seq").cast("long").alias("seq"), iso_time("rec.timestamp").alias("ts"),
        F.coalesce(F.col(f"{m}.model"), F.lit("unknown")).alias("model"), n("input_tokens").alias("input"), n("output_tokens").alias("output"), n("cache_read_input_tokens").alias("cache_read"),
        F.when(split, n("cache_creation.ephemeral_5m_input_tokens")).otherwise(whole).cast("long").alias("cache_write_5m"),
        F.when(split, n("cache_creation.ephemeral_1h_input_tokens")).otherwise(F.lit(0)).cast("long").alias("cache_write_1h"),
        n("output_tokens_details.thinking_tokens").alias("thinking"), "project", F.coalesce("rec.sessionId", F.lit("")).alias("chat_id"), F.col("rec.agentId").alias("agent_id"),
        F.col("rec.attributionAgent").alias("agent_kind"), F.col("rec.effort").alias("effort"), F.lit(None).cast("double").alias("reported_cost"),
    )
    return rows.filter("ts is not null").withColumn("msg_id", composite_id())


def chat_events(records: DataFrame) -> DataFrame:
    """Titles, human prompts and compactions of the main threads (chat_id, at, seq, kind, text)."""
    session = F.col("rec.sessionId")
    main = ~F.coalesce("rec.isSidechain", F.lit(False))
    content = F.col("rec.message.content")
    parts = F.from_json(content, "array<struct<type: string, text: string>>")
    said = F.when(content.startswith("["), F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"]), " ")).otherwise(content)
    kind = (
        F.when(F.col("rec.type") == "ai-title", "title")
        .when((F.col("rec.type") == "user") & (F.col("rec.origin.kind") == "human") & main, "prompt")
        .when((F.col("rec.type") == "system") & (F.col("rec.subtype") == "compact_boundary") & main, "compaction")
    )
    rows = records.select(session.alias("chat_id"), iso_time("rec.timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), kind.alias("kind"), F.when(F.col("rec.type") == "ai-title", title("rec.aiTitle")).when(F.col("rec.type") == "user", title(said)).alias("text"))
    rows = rows.filter("kind is not null and chat_id is not null and chat_id <> ''")
    return rows.filter("(kind = 'compaction' and at is not null) or (kind <> 'compaction' and text is not null)")


def read(spark: SparkSession, root: str, now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """(turn records, chat events) of all assistant logs under `root`."""
    return of_lines(scan.lines(spark, root, now), root)


def of_lines(lines: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The same of lines (value, file, line) that a scan gives, whole or as a stream."""
    records = parsed(lines.withColumns({"project": project_of("file", root), "seq": ingest_order()}))
    return turns(records), chat_events(records)
