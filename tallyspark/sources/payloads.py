"""Provider payloads: quota answers, budgets, cost reports, price feeds, hook events, status-line readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.frames import first_of
from tallyspark.functions.models import normalized
from tallyspark.functions.moments import seconds
from tallyspark.functions.text import tool_summary, window_kind, window_label
from tallyspark.schema import PRICES
from tallyspark.sources.logs import iso_time

# The windows that a quota answer is known to name, in order: id, label, kind.
KNOWN = (
    ("five_hour", "Current session", "session"),
    ("seven_day", "All models", "weekly"),
    ("seven_day_opus", "Opus only", "modelSpecific"),
    ("seven_day_sonnet", "Sonnet only", "modelSpecific"),
    ("seven_day_fable", "Fable only", "modelSpecific"),
    ("seven_day_cowork", "Cowork", "modelSpecific"),
    ("seven_day_oauth_apps", "OAuth apps", "modelSpecific"),
)
# Families of a price feed, in the order in which they are read.
FAMILIES = ("anthropic", "openai", "xai", "google")
# Hook names and the kinds of event they are.
HOOKS = {
    "SessionStart": "sessionStart",
    "UserPromptSubmit": "promptSubmitted",
    "PreToolUse": "toolStarted",
    "PostToolUse": "toolFinished",
    "PermissionRequest": "permissionRequested",
    "Stop": "stop",
    "SessionEnd": "sessionEnd",
}
HOOK_BYTES, HOOK_VERSIONS = 65_536, (1,)

_DTO = "struct<utilization: double, resets_at: string, limit_dollars: double, used_dollars: double>"
_LIMIT = "struct<kind: string, `group`: string, percent: double, resets_at: string, scope: string>"


def quota_windows(payloads: DataFrame) -> DataFrame:
    """Windows (service, bucket, label, percent, resets_at, kind, credit_used, credit_limit, pos) of quota answers (service, value).

    The answer's list of limits leads; its keyed windows add what the list lacks: known ones first, unknown ones by key, named
    and classed by their key. Of two limits with one identity the first counts.
    """
    rows = payloads.select("service", "value", F.from_json("value", f"limits array<{_LIMIT}>").alias("r"))
    listed = rows.select("service", F.posexplode("r.limits").alias("pos", "l")).filter("l.percent is not null")
    kind, scope = F.col("l.kind"), F.col("l.scope")
    slug = F.replace(F.lower(scope), F.lit(" "), F.lit("_"))
    other = F.coalesce(kind, F.lit("limit"))
    words = F.array_join(F.transform(F.filter(F.split(other, "_"), lambda w: w != ""), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))), " ")
    only = F.concat(scope, F.lit(" only"))
    identity = (
        F.when(kind == "session", F.struct(F.lit("five_hour").alias("bucket"), F.lit("Current session").alias("label"), F.lit("session").alias("kind")))
        .when(kind == "weekly_all", F.struct(F.lit("seven_day").alias("bucket"), F.lit("All models").alias("label"), F.lit("weekly").alias("kind")))
        .when((kind == "weekly_scoped") & scope.isNull(), F.struct(F.lit("seven_day_scoped").alias("bucket"), F.lit("Model-specific").alias("label"), F.lit("modelSpecific").alias("kind")))
        .when(kind == "weekly_scoped", F.struct(F.concat(F.lit("seven_day_"), slug).alias("bucket"), only.alias("label"), F.lit("modelSpecific").alias("kind")))
        .otherwise(
            F.struct(
                F.when(scope.isNotNull(), F.concat(other, F.lit("_"), slug)).otherwise(other).alias("bucket"), F.coalesce(only, words).alias("label"),
                F.when(F.col("l.group") == "session", "session").when(F.col("l.group") == "weekly", F.when(scope.isNull(), "weekly").otherwise("modelSpecific")).otherwise(window_kind(other)).alias("kind"),
            )
        )
    )
    cols = ["bucket", "label", "percent", "resets_at", "kind", "credit_used", "credit_limit"]
    none = F.lit(None).cast("double")
    limits = listed.withColumn("_i", identity).select("service", "pos", F.col("_i.bucket").alias("bucket"), F.col("_i.label").alias("label"), F.col("l.percent").alias("percent"), iso_time("l.resets_at").alias("resets_at"), F.col("_i.kind").alias("kind"), none.alias("credit_used"), none.alias("credit_limit"))
    limits = first_of(limits, ["service", "bucket"], [F.col("pos")])
    keyed = payloads.select("service", F.explode(F.from_json("value", "map<string, string>")).alias("bucket", "_v")).filter(F.col("_v").startswith("{") & (F.col("bucket") != "extra_usage"))
    keyed = keyed.select("service", "bucket", F.from_json("_v", _DTO).alias("d")).filter("d.utilization is not null")
    place = F.coalesce(*(F.when(F.col("bucket") == k, F.lit(i)) for i, (k, _, _) in enumerate(KNOWN)), F.lit(len(KNOWN)))
    known_label = F.coalesce(*(F.when(F.col("bucket") == k, F.lit(label)) for k, label, _ in KNOWN))
    known_kind = F.coalesce(*(F.when(F.col("bucket") == k, F.lit(kind_)) for k, _, kind_ in KNOWN))
    credit = F.col("d.limit_dollars").isNotNull()
    windows = keyed.select(
        "service", "bucket", F.coalesce(known_label, F.when(credit, "Included credits"), window_label("bucket")).alias("label"), F.col("d.utilization").alias("percent"), iso_time("d.resets_at").alias("resets_at"),
        F.when(credit, "other").otherwise(F.coalesce(known_kind, window_kind("bucket"))).alias("kind"), F.when(credit, F.col("d.used_dollars")).alias("credit_used"), F.col("d.limit_dollars").alias("credit_limit"), place.alias("_place"),
    )
    extra = windows.join(limits.select("service", "bucket"), ["service", "bucket"], "left_anti")
    both = limits.select("service", F.struct(F.lit(0).alias("_a"), F.col("pos").alias("_b"), F.lit("").alias("_c")).alias("_o"), *cols).unionByName(
        extra.select("service", F.struct(F.lit(1).alias("_a"), F.col("_place").alias("_b"), F.col("bucket").alias("_c")).alias("_o"), *cols)
    )
    from pyspark.sql import Window

    return both.withColumn("pos", F.row_number().over(Window.partitionBy("service").orderBy("_o")) - 1).drop("_o")  # one answer's windows


def extra_usage(payloads: DataFrame) -> DataFrame:
    """Extra usage of quota answers in dollars; its percent is used of limit, else the answer's own (a fraction up to 1)."""
    e = "r.extra_usage"
    rows = payloads.select("service", F.from_json("value", "extra_usage struct<is_enabled: boolean, monthly_limit: double, used_credits: double, utilization: double>").alias("r")).filter(f"{e} is not null")
    limit, used = F.coalesce(F.col(f"{e}.monthly_limit"), F.lit(0.0)) / 100, F.coalesce(F.col(f"{e}.used_credits"), F.lit(0.0)) / 100
    said = F.coalesce(F.col(f"{e}.utilization"), F.lit(0.0))
    percent = F.when(limit > 0, F.least(F.lit(100.0), used / F.nullif(limit, F.lit(0.0)) * 100)).when(said <= 1, said * 100).otherwise(said)
    return rows.select("service", F.coalesce(F.col(f"{e}.is_enabled"), F.lit(False)).alias("extra_enabled"), limit.alias("extra_limit"), used.alias("extra_used"), percent.alias("extra_percent"))


def history(lines: DataFrame) -> DataFrame:
    """Readings of history lines (value), long: one row for each window of a record.

    A record without a service is the first one's. A reset in the year 4001 names none. Fixed fields of old records stand for
    windows that the map lacks. Corrupt lines are dropped; `corrupt` counts them.
    """
    schema = (
        "id string, timestamp string, serviceID string, bucketPercents map<string, double>, bucketWindows map<string, struct<resetsAt: string, length: double>>, bucketSources map<string, string>, "
        "fiveHourPercent double, fiveHourResetsAt string, sevenDayPercent double, sevenDayResetsAt string"
    )
    rows = lines.select(F.from_json("value", schema).alias("r")).filter("r.timestamp is not null")
    old = F.filter(
        F.array(
            F.struct(F.lit("five_hour").alias("key"), F.col("r.fiveHourPercent").alias("value"), F.col("r.fiveHourResetsAt").alias("reset")),
            F.struct(F.lit("seven_day").alias("key"), F.col("r.sevenDayPercent").alias("value"), F.col("r.sevenDayResetsAt").alias("reset")),
        ),
        lambda x: x["value"].isNotNull() & ~F.coalesce(F.map_contains_key("r.bucketPercents", x["key"]), F.lit(False)),
    )
    new = F.transform(F.coalesce(F.map_entries("r.bucketPercents"), F.array().cast("array<struct<key: string, value: double>>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"), F.lit(None).cast("string").alias("reset")))
    each = rows.select("r", F.explode(F.concat(new, old)).alias("e"))
    reset = iso_time(F.coalesce(F.col("r.bucketWindows")[F.col("e.key")]["resetsAt"], F.col("e.reset")))
    return each.select(
        F.coalesce("r.serviceID", F.lit("assistant")).alias("service"), iso_time("r.timestamp").alias("ts"), F.col("e.key").alias("bucket"), F.col("e.value").alias("percent"),
        F.when(F.year(reset) < 4001, reset).alias("resets_at"), F.col("r.bucketWindows")[F.col("e.key")]["length"].alias("window_seconds"), window_kind("e.key").alias("kind"), F.col("r.bucketSources")[F.col("e.key")].alias("source"),
    ).filter("ts is not null and percent is not null")


def corrupt(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count_if(F.get_json_object("value", "$.timestamp").isNull()).alias("corrupt"), F.count("*").alias("lines"))


def cost_report(rows: DataFrame) -> DataFrame:
    """Dollars of a report's amounts (day, amount: cents as text): summed exactly, converted once; no number, no amount."""
    return rows.groupBy("day").agg((F.coalesce(F.sum(F.col("amount").try_cast("decimal(38,9)")), F.lit(0).cast("decimal(38,9)")) / 100).cast("double").alias("dollars"), F.count_if(F.col("amount").try_cast("decimal(38,9)").isNull()).alias("skipped"))


def budgets(entries: DataFrame, suffix: str, first: tuple[str, ...]) -> DataFrame:
    """Windows of monthly budgets (key, percent, reset_at, budget, currency): keys with the suffix, the named ones first.

    The window is the calendar month that ends at the reset; a budget in dollars is an allowance.
    """
    rows = entries.filter(F.col("key").endswith(suffix))
    place = F.coalesce(*(F.when(F.col("key") == k, F.lit(i)) for i, k in enumerate(first)), F.lit(len(first)))
    ok = (F.col("budget") > 0) & (F.upper("currency") == "USD")
    label = F.initcap(F.lower(F.replace(F.regexp_replace("key", suffix + "$", ""), F.lit("_"), F.lit(" "))))
    length = seconds(F.col("reset_at") - F.expr("interval 1 month"), "reset_at")
    return rows.select(
        F.col("key").alias("bucket"), label.alias("label"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("percent"))).alias("percent"), F.col("reset_at").alias("resets_at"),
        F.when(place == 0, "weekly").otherwise("modelSpecific").alias("kind"), length.alias("window_seconds"), F.when(ok, F.col("budget") * F.greatest(F.lit(0.0), F.col("percent")) / 100).alias("allowance_used"),
        F.when(ok, F.col("budget")).alias("allowance_limit"), place.alias("place"),
    )


def price_feed(feed: DataFrame) -> DataFrame:
    """Live prices of a feed (value: providers to models to cost); models without an input and output price are skipped.

    Cache reads default to a tenth of input; 5-minute cache writes to 1.25 of it where the provider bills them; the hour's are
    1.6 of the 5-minute ones. Of equal ids the last provider in order counts.
    """
    model = "struct<name: string, cost: struct<input: double, output: double, cache_read: double, cache_write: double>>"
    rows = feed.select(F.explode(F.from_json("value", f"map<string, struct<models: map<string, {model}>>>")).alias("provider", "p")).filter(F.col("provider").isin(*FAMILIES))
    each = rows.select("provider", F.explode("p.models").alias("id", "m")).filter("m.cost.input is not null and m.cost.output is not null")
    cost, norm = F.col("m.cost"), normalized("id")
    bills = (F.col("provider") == "anthropic") | ((F.col("provider") == "openai") & (norm.startswith("gpt-5.6") | norm.startswith("gpt-6")))
    cw = F.coalesce(cost["cache_write"], F.when(bills, cost["input"] * 1.25).otherwise(0.0))
    place = F.coalesce(*(F.when(F.col("provider") == p, F.lit(i)) for i, p in enumerate(FAMILIES)))
    out = each.select(
        norm.alias("model_norm"), cost["input"].alias("in_per_m"), cost["output"].alias("out_per_m"), F.coalesce(cost["cache_read"], cost["input"] * 0.1).alias("cache_read_per_m"), cw.alias("cw5m_per_m"),
        (cw * 1.6).alias("cw1h_per_m"), F.lit("live").alias("source"), place.alias("_place"), F.col("id").alias("_id"),
    )
    return first_of(out, ["model_norm"], [-F.col("_place"), F.col("_id")]).select(*PRICES.names)


def model_names(feed: DataFrame, family: str) -> DataFrame:
    """Names and prices (null where the feed gives none) of one family's models, for lookups by name."""
    model = "struct<name: string, cost: struct<input: double, output: double, cache_read: double, cache_write: double>>"
    rows = feed.select(F.explode(F.from_json("value", f"map<string, struct<models: map<string, {model}>>>")).alias("provider", "p")).filter(F.col("provider") == family)
    each = rows.select(F.explode("p.models").alias("id", "m"))
    cost = F.col("m.cost")
    ok = cost["input"].isNotNull() & cost["output"].isNotNull()
    cw = F.coalesce(cost["cache_write"], F.lit(0.0))
    rate = lambda c: F.when(ok, c)
    return each.select(
        normalized("id").alias("model_norm"), F.col("m.name").alias("name"), rate(cost["input"]).alias("in_per_m"), rate(cost["output"]).alias("out_per_m"), rate(F.coalesce(cost["cache_read"], cost["input"] * 0.1)).alias("cache_read_per_m"),
        rate(cw).alias("cw5m_per_m"), rate(cw * 1.6).alias("cw1h_per_m"),
    )


def hook_events(lines: DataFrame) -> DataFrame:
    """Hook lines (value, seq) as agent events, with `error` where a line can't be one: too_large, not_json, missing:<field>,
    version."""
    schema = (
        "v int, source string, received_at double, transport string, host struct<pid: bigint, tty: string>, payload struct<hook_event_name: string, session_id: string, cwd: string, tool_name: string, "
        "tool_input: string, notification_type: string, agent_id: string, type: string, `thread-id`: string>"
    )
    rows = lines.withColumns({"r": F.from_json("value", schema), "_big": F.octet_length("value") > HOOK_BYTES, "_json": F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")})
    p, notify = "r.payload", (F.col("r.source") == "rollout") & ~F.coalesce(F.col("r.transport") == "hook", F.lit(False))
    sid = F.when(notify, F.col(f"{p}.`thread-id`")).otherwise(F.col(f"{p}.session_id"))
    name = F.when(notify, F.col(f"{p}.type")).otherwise(F.col(f"{p}.hook_event_name"))
    error = (
        F.when(F.col("_big"), "too_large").when(~F.coalesce("_json", F.lit(False)), "not_json").when(F.col("r.v").isNull(), "missing:v").when(~F.col("r.v").isin(*HOOK_VERSIONS), "version")
        .when(~F.coalesce(F.col("r.source").isin("assistant", "rollout"), F.lit(False)), "missing:source").when(F.col(p).isNull(), "missing:payload")
        .when(name.isNull(), F.when(notify, "missing:type").otherwise("missing:hook_event_name")).when(F.coalesce(sid, F.lit("")) == "", F.when(notify, "missing:thread-id").otherwise("missing:session_id"))
    )
    hooks = F.create_map(*(F.lit(x) for pair in HOOKS.items() for x in pair))
    kind = (
        F.when(notify, F.when(name == "agent-turn-complete", "turnComplete").otherwise("unknown"))
        .when((name == "Notification") & (F.col("r.source") == "assistant"), F.when(F.col(f"{p}.notification_type") == "permission_prompt", "notificationPermission").when(F.col(f"{p}.notification_type") == "idle_prompt", "notificationIdle").otherwise("unknown"))
        .otherwise(F.coalesce(hooks[name], F.lit("unknown")))
    )
    tool = F.when(~notify, F.col(f"{p}.tool_name"))
    attention = F.when(tool == "AskUserQuestion", "question").when(tool == "ExitPlanMode", "plan")
    return rows.select(
        "seq", error.alias("error"), F.col("r.source").alias("source"), sid.alias("session_id"), kind.alias("kind"), F.timestamp_micros((F.col("r.received_at") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("ts"),
        F.col(f"{p}.cwd").alias("cwd"), tool.alias("tool"), F.when(~notify, tool_summary(tool, F.col(f"{p}.tool_input"))).alias("summary"), F.when(F.col(f"{p}.tool_input").isNotNull(), attention).alias("attention"),
        (F.coalesce(F.col(f"{p}.agent_id"), F.lit("")) != "").alias("is_subagent"), F.col("r.host.pid").alias("pid"), F.col("r.host.tty").alias("tty"),
    )


def statusline(lines: DataFrame) -> DataFrame:
    """Status-line readings (value, session_id, written_at, config_dir) with API time, model, context and rate limits."""
    schema = "model struct<display_name: string>, cost struct<total_api_duration_ms: double>, context_window struct<used_percentage: double>, rate_limits struct<five_hour: struct<used_percentage: double, resets_at: double>, seven_day: struct<used_percentage: double, resets_at: double>>"
    rows = lines.withColumn("r", F.from_json("value", schema)).filter("r is not null")
    window = lambda w: F.when(F.col(f"r.rate_limits.{w}.used_percentage").isNotNull(), F.struct(F.col(f"r.rate_limits.{w}.used_percentage").alias("percent"), F.timestamp_micros((F.col(f"r.rate_limits.{w}.resets_at") * 1_000_000).cast("long")).cast("timestamp_ntz").alias("resets_at"))).alias(w)
    return rows.filter(F.col("session_id").rlike("^[A-Za-z0-9_-]+$")).select("session_id", "written_at", "config_dir", F.col("r.cost.total_api_duration_ms").alias("api_ms"), F.col("r.model.display_name").alias("model"), F.col("r.context_window.used_percentage").alias("context_percent"), window("five_hour"), window("seven_day"))


def report_buckets(outputs: DataFrame) -> DataFrame:
    """Buckets of a tool's quota report (id, value): the whole output, or its outermost object amid noise.

    Only a report of success with a group counts; blank ids go, and groups without a bucket.
    """
    schema = "status string, command struct<data: struct<groups: array<struct<name: string, buckets: array<struct<id: string, name: string, `window`: string, remaining_fraction: double, reset_time: string, disabled: boolean>>>>>>"
    inner = F.regexp_extract("value", r"(?s)(\{.*\})", 1)
    rows = outputs.withColumn("r", F.from_json(inner, schema)).filter("r.status = 'SUCCESS'")
    each = rows.select("id", F.posexplode("r.command.data.groups").alias("group_pos", "g")).select("id", "group_pos", F.trim("g.name").alias("group"), F.posexplode("g.buckets").alias("pos", "b"))
    name = F.trim(F.coalesce("b.name", F.lit("")))
    ident = F.trim(F.coalesce("b.id", F.lit("")))
    return each.filter(ident != "").select(
        "id", "group_pos", "group", "pos", ident.alias("bucket"), F.when(name == "", ident).otherwise(name).alias("name"), F.lower(F.trim("b.window")).alias("window"), F.col("b.remaining_fraction").alias("remaining"),
        iso_time("b.reset_time").alias("resets_at"), F.coalesce("b.disabled", F.lit(False)).alias("disabled"),
    )


def model_rows(windows: DataFrame) -> DataFrame:
    """Quota rows (id, label, percent, resets_at, pos) merged by id: the highest percent with its reset, the first label."""
    return windows.groupBy("id").agg(
        F.min_by(F.struct("percent", "resets_at"), F.struct(-F.col("percent"), F.col("pos"))).alias("_x"), F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos")
    ).select("id", "label", "_x.*", "pos")


def legacy_percent(percents: str, bucket: str, fixed: str) -> Column:
    """A window's percent from a record's map, else from its fixed field."""
    return F.coalesce(F.col(percents)[F.lit(bucket)], F.col(fixed))
