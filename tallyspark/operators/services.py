"""Services and the windows they list: which counts, which is worst, what is retained, what needs a look."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.frames import ranked
from tallyspark.functions.moments import DAY, moment, seconds
from tallyspark.functions.percents import clamped

ALERT_PERCENT = 90.0
#: Ids of windows that the engine itself makes up (a pay-as-you-go account's weekly budget).
SYNTHETIC = ("weekly_budget",)


def is_promotional() -> Column:
    return F.lower("bucket").contains("promo") | F.lower("label").contains("promo")


def is_credit_pool() -> Column:
    return F.col("credit_limit").isNotNull()


def is_bonus() -> Column:
    return is_promotional() | is_credit_pool()


def tiered(buckets: DataFrame) -> DataFrame:
    """The windows that stand for each service: real limits that aren't one model's, else any that is no bonus, else all."""
    tier = F.when(~is_bonus() & (F.col("kind") != "modelSpecific"), 0).when(~is_bonus(), 1).otherwise(2)
    rows = buckets.withColumn("_tier", tier)
    best = rows.groupBy("service").agg(F.min("_tier").alias("_best"))
    return rows.join(best, "service").filter("_tier = _best").drop("_tier", "_best")


def core_buckets(buckets: DataFrame) -> DataFrame:
    """As `tiered`, but a credit pool never stands in: its percent is money spent."""
    return tiered(buckets.filter(~is_credit_pool()))


def extra_buckets(services: DataFrame) -> DataFrame:
    """Enabled extra usage as a window of its own, after all others."""
    rows = services.filter("extra_enabled")
    return rows.select("service", F.concat("service", F.lit("_extra_usage")).alias("bucket"), F.lit("Extra usage").alias("label"), F.col("extra_percent").alias("percent"), F.lit("other").alias("kind"), F.lit(1 << 30).alias("pos"))


def headline(buckets: DataFrame, services: DataFrame) -> DataFrame:
    """Each service's highest percent of its core windows and extra usage; of its other windows where it has neither; else 0."""
    p, extra = clamped("percent"), clamped("extra_percent")
    most = buckets.groupBy("service").agg(
        F.max(F.when(~is_bonus() & (F.col("kind") != "modelSpecific"), p)).alias("_core"), F.max(F.when(~is_bonus(), p)).alias("_real"), F.max(p).alias("_all")
    )
    rows = services.join(most, "service", "left")
    own = F.when(F.col("_core").isNotNull() | F.coalesce("extra_enabled", F.lit(False)), F.greatest("_core", F.when(F.col("extra_enabled"), extra)))
    return rows.select("service", F.coalesce(own, "_real", "_all", F.lit(0.0)).alias("percent"))


def _worst(rows: DataFrame) -> DataFrame:
    """Each service's fullest window, the first listed of equal ones."""
    cols = [c for c in rows.columns if c != "service"]
    return rows.groupBy("service").agg(F.min_by(F.struct(*cols), F.struct(-clamped("percent"), F.col("pos"))).alias("_x")).select("service", "_x.*")


def hero(buckets: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """Each service's worst window: of its core ones and extra usage, else of the ones that are no bonus, else of all."""
    cols = ["service", "bucket", "label", "percent", "kind", "pos"]
    tier = F.when(~is_bonus() & (F.col("kind") != "modelSpecific"), 0).when(~is_bonus(), 1).otherwise(2)
    rows = buckets.withColumn("_tier", tier).select(*cols, "_tier")
    if services is not None:
        rows = rows.unionByName(extra_buckets(services).select(*cols, F.lit(0).alias("_tier")))
    best = rows.groupBy("service").agg(F.min("_tier").alias("_best"))
    return _worst(rows.join(best, "service").filter("_tier = _best").select(*cols))


def detail_hero(buckets: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """The first session window that is no promotion, else the worst window."""
    sessions = buckets.filter((F.col("kind") == "session") & ~is_promotional())
    first = sessions.groupBy("service").agg(F.min_by(F.struct("bucket", "label", "percent", "kind", "pos"), "pos").alias("_x")).select("service", "_x.*")
    others = hero(buckets, services).join(first.select("service"), "service", "left_anti")
    return first.unionByName(others.select(*first.columns))


def secondary(buckets: DataFrame, services: DataFrame | None = None) -> DataFrame:
    """The weekly window unless it is the hero; else the worst of the other core windows."""
    cols = ["service", "bucket", "label", "percent", "kind", "pos"]
    lead = detail_hero(buckets, services).select("service", F.col("bucket").alias("_hero"))
    weekly = buckets.filter("bucket = 'seven_day'").join(lead, "service").filter("_hero <> 'seven_day'").select(*cols)
    core = buckets.filter(~is_bonus() & (F.col("kind") != "modelSpecific")).select(*cols)
    if services is not None:
        core = core.unionByName(extra_buckets(services).select(*cols))
    rest = _worst(core.join(lead, "service").filter("bucket <> _hero").select(*cols))
    return weekly.unionByName(rest.join(weekly.select("service"), "service", "left_anti").select(*cols))


def fullest(buckets: DataFrame, services: DataFrame, now: datetime) -> DataFrame:
    """The fullest window of all: live services first, then retained ones whose window hasn't reset. One row at most.

    Within either, core windows, else no-bonus ones, else all; of equal ones the first by service and position.
    """
    rows = buckets.join(services.select("service", (F.col("state") != "ok").alias("retained")), "service")
    rows = rows.filter(~F.col("retained") | F.col("resets_at").isNull() | (F.col("resets_at") > moment(now)))
    tier = F.when(~is_bonus() & (F.col("kind") != "modelSpecific"), 0).when(~is_bonus(), 1).otherwise(2)
    return rows.withColumn("_tier", tier).orderBy("retained", "_tier", F.desc("percent"), "service", "pos").limit(1).drop("_tier")


def most_urgent(buckets: DataFrame, services: DataFrame, enabled: list[str] | None = None) -> DataFrame:
    """The window to warn about: services that are ok and enabled, windows that are no bonus and at least 90 % full (one model's
    only if its service has no core window); the fullest, then by service, the shorter window, position."""
    ok = services.filter("state = 'ok'").select("service")
    ok = ok if enabled is None else ok.filter(F.col("service").isin(enabled))
    rows = buckets.join(ok, "service").filter(~is_bonus())
    core = rows.groupBy("service").agg(F.max(F.col("kind") != "modelSpecific").alias("_core"))
    rows = rows.join(core, "service").filter("kind <> 'modelSpecific' or not _core").withColumn("percent", clamped("percent")).filter(F.col("percent") >= ALERT_PERCENT)
    return rows.orderBy(F.desc("percent"), "service", F.asc_nulls_last("window_seconds"), "pos").limit(1).drop("_core")


def burn_bucket(buckets: DataFrame) -> DataFrame:
    """The window whose burn rate is shown: the first session window that is no promotion, else the fullest that is no bonus."""
    cols = ["service", "bucket", "label", "percent", "kind", "pos"]
    sessions = buckets.filter((F.col("kind") == "session") & ~is_promotional())
    first = ranked(sessions, ["service"], [F.col("pos")], 1).select(*cols)
    rest = _worst(buckets.filter(~is_bonus()).select(*cols)).join(first.select("service"), "service", "left_anti")
    return first.unionByName(rest.select(*cols))


def ring_order(buckets: DataFrame) -> DataFrame:
    """Rings: the lead window, then those that are no promotion, then promotions."""
    lead = detail_hero(buckets).select("service", F.col("bucket").alias("_lead"))
    place = F.when(F.col("bucket") == F.col("_lead"), 0).when(~is_promotional(), 1).otherwise(2)
    rows = buckets.join(lead, "service").withColumn("_place", place)
    return rows.withColumn("ring", F.row_number().over(Window.partitionBy("service").orderBy("_place", "pos"))).drop("_place", "_lead")


def display_order(services: DataFrame, fixed: list[str], admin: str, prefer_admin: bool) -> DataFrame:
    """Services in their fixed order; the admin one leads only if it is preferred and ok."""
    place = F.coalesce(*(F.when(F.col("service") == s, F.lit(i)) for i, s in enumerate(fixed)), F.lit(len(fixed)))
    if prefer_admin:
        place = F.when((F.col("service") == admin) & (F.col("state") == "ok"), -1).otherwise(place)
    return services.withColumn("place", place.cast("int"))


def dollar_rows(buckets: DataFrame, services: DataFrame) -> DataFrame:
    """Credit pools and enabled extra usage: used and limit in dollars."""
    pools = buckets.filter(is_credit_pool()).select("service", "bucket", F.col("credit_used").alias("used"), F.col("credit_limit").alias("limit"))
    extra = services.filter("extra_enabled").select("service", F.lit("extra_usage").alias("bucket"), F.col("extra_used").alias("used"), F.col("extra_limit").alias("limit"))
    return pools.unionByName(extra)


def tail_rows(totals: DataFrame, whole_points: bool = False, least: float = 0.1) -> DataFrame:
    """The rows below a ranked list (service, outside, earlier): those at least `least` (whole points where the provider
    counts so)."""
    rows = totals.select("service", F.expr("stack(2, 'earlier', earlier, 'outside', outside) as (part, points)"))
    shown = F.round("points") >= 1 if whole_points else F.col("points") + 1e-9 >= least
    return rows.filter(shown).withColumn("points", F.round("points") if whole_points else F.col("points"))


def watchable(buckets: DataFrame, services: DataFrame) -> DataFrame:
    """The windows that alerts watch: of ok services, core ones (else no-bonus ones) and enabled extra usage."""
    ok = services.filter("state = 'ok'")
    real = buckets.filter(~is_bonus()).join(ok.select("service"), "service", "left_semi")
    core = tiered(real).select("service", "bucket", "label", "percent", "resets_at")
    extra = ok.filter("extra_enabled").select("service", F.lit("extra_usage").alias("bucket"), F.lit("Extra usage").alias("label"), F.col("extra_percent").alias("percent"))
    return core.unionByName(extra, allowMissingColumns=True)


def first_of_kind(buckets: DataFrame, kind: str) -> DataFrame:
    """Each service's first real limit of a kind."""
    rows = buckets.filter((F.col("kind") == kind) & ~is_bonus() & ~F.col("bucket").isin(*SYNTHETIC))
    return ranked(rows, ["service"], [F.col("pos")], 1).drop("rank")


def budget_bucket(services: DataFrame, budget: float) -> DataFrame:
    """A pay-as-you-go account's week as a window of its own: cost as a percent of the budget."""
    return services.filter("week_cost > 0").select("service", F.lit(SYNTHETIC[0]).alias("bucket"), F.lit("weekly").alias("kind"), (F.col("week_cost") / F.lit(budget) * 100).alias("percent"))


def last_known(snapshots: DataFrame) -> DataFrame:
    """Each service's newest good reading."""
    cols = [c for c in snapshots.columns if c != "service"]
    return snapshots.filter("state = 'ok'").groupBy("service").agg(F.max_by(F.struct(*cols), "fetched_at").alias("_x")).select("service", "_x.*")


def retained(now_: DataFrame, before: DataFrame, stored: DataFrame) -> DataFrame:
    """Snapshots (service, state, fetched_at, buckets: array) where a failed and empty one takes the content and time of the
    one before, else of the stored one; `retained` marks them."""
    empty = (F.col("state") != "ok") & (F.coalesce(F.size("buckets"), F.lit(0)) < 1)
    prior = before.filter("size(buckets) > 0").select("service", F.col("buckets").alias("_b"), F.col("fetched_at").alias("_bt"))
    kept = stored.filter("size(buckets) > 0").select("service", F.col("buckets").alias("_s"), F.col("fetched_at").alias("_st"))
    rows = now_.join(prior, "service", "left").join(kept, "service", "left").withColumn("_empty", empty)
    return rows.select(
        "service", "state",
        F.when(F.col("_empty"), F.coalesce("_bt", "_st", "fetched_at")).otherwise(F.col("fetched_at")).alias("fetched_at"),
        F.when(F.col("_empty"), F.coalesce("_b", "_s", "buckets")).otherwise(F.col("buckets")).alias("buckets"),
        (F.col("_empty") & (F.col("_b").isNotNull() | F.col("_s").isNotNull())).alias("retained"),
    )


def poll_state(services: DataFrame) -> DataFrame:
    """One row: whether all services failed, and the newest time of a retained one."""
    return services.agg(F.coalesce(F.bool_and(F.col("state") != "ok"), F.lit(False)).alias("is_stale"), F.max(F.when(F.col("retained"), F.col("fetched_at"))).alias("retained_at"))


def missing_windows(now_: DataFrame, had: DataFrame) -> DataFrame:
    """Snapshots (service, state, n_buckets) with an ok service that lists no window but had some before turned into an error."""
    known = had.filter("n_buckets > 0").select("service", F.lit(True).alias("_had")).distinct()
    lost = (F.col("state") == "ok") & (F.col("n_buckets") == 0) & F.coalesce("_had", F.lit(False))
    return now_.join(known, "service", "left").select("service", F.when(lost, "error").otherwise(F.col("state")).alias("state"), "n_buckets")


def bucket_infos(buckets: DataFrame, seen: DataFrame) -> DataFrame:
    """The windows that charts offer: live ones (`is_core` as ranked), then those only seen in history, labelled by their id.

    A history-only window counts as core only where the service lists nothing now and the window is no promotion. Credit pools
    that survive in history alone (`credit_only` in `seen`) are left out.
    """
    from tallyspark.functions.text import words_label

    core = core_buckets(buckets).select("service", "bucket", F.lit(True).alias("_core"))
    live = buckets.join(core, ["service", "bucket"], "left").select("service", "bucket", "label", F.coalesce("_core", F.lit(False)).alias("is_core"), F.lit(True).alias("is_live"))
    past = seen.select("service", "bucket").distinct().join(buckets.select("service", "bucket"), ["service", "bucket"], "left_anti")
    listed = buckets.select("service").distinct().withColumn("_listed", F.lit(True))
    past = past.join(listed, "service", "left")
    only = F.col("_listed").isNull() & ~F.lower("bucket").contains("promo")
    return live.unionByName(past.select("service", "bucket", words_label("bucket").alias("label"), only.alias("is_core"), F.lit(False).alias("is_live")))


def known_ids(live: DataFrame, taken: DataFrame, key: str = "id") -> DataFrame:
    """Ids that aren't taken, in their own order."""
    return live.join(taken.select(key).distinct(), key, "left_anti")


def to_clear(notified: DataFrame, waiting: DataFrame) -> DataFrame:
    """Alerts whose session no longer waits."""
    return notified.select("id").subtract(waiting.select("id"))


def pace(buckets: DataFrame, burn: DataFrame, now: datetime) -> DataFrame:
    """Each window's elapsed fraction and whether it hits its limit before it resets."""
    from tallyspark.operators.limits import elapsed

    rows = elapsed(buckets, now).join(burn.select("service", "bucket", "seconds_to_limit", "is_stale"), ["service", "bucket"], "left")
    hits = F.coalesce(~F.col("is_stale") & (F.col("seconds_to_limit") < seconds(moment(now), "resets_at")), F.lit(False))
    return rows.select("service", "bucket", "elapsed", hits.alias("will_hit"))


def monthly_window(resets_at: str) -> Column:
    """Length in seconds of the calendar month that ends at a reset."""
    return F.when(F.col(resets_at).isNotNull(), seconds(F.add_months(F.to_date(resets_at), -1).cast("timestamp_ntz"), F.to_date(resets_at).cast("timestamp_ntz")))


def pool_labels(stems: DataFrame) -> DataFrame:
    """Short labels of pools (id, short, full); every id that shares a short label gets its full one."""
    n = F.count("*").over(Window.partitionBy("short"))
    return stems.withColumn("label", F.when(n > 1, F.col("full")).otherwise(F.col("short"))).select("id", "label")


def is_fresh(updated_at: str, now: datetime, version: str = "version", known: int = 2) -> Column:
    """Whether a status document can be trusted: its version is known and it is younger than ten minutes."""
    return (F.col(version) == known) & (seconds(updated_at, moment(now)) < 600)


def cache_life(now: datetime) -> Column:
    """cold, closing or warm, of a prompt cache (observed, warm, expires_at, ttl); null where caching was never observed.

    A cache of one hour is closing in its last five minutes, another one in its last minute.
    """
    left = seconds(moment(now), "expires_at")
    closing = F.when(F.col("ttl") == "1h", 300.0).otherwise(60.0)
    cold = ~F.coalesce("warm", F.lit(False)) | F.col("expires_at").isNull() | (left <= 0)
    return F.when(F.coalesce("observed", F.lit(False)), F.when(cold, "cold").when(left < closing, "closing").otherwise("warm"))


def statusline_sessions(readings: DataFrame, now: datetime, evict_s: int = 600) -> DataFrame:
    """Each status-line session's newest row with `as_of`: when its numbers were fresh.

    An increase of the cumulative API time dates the reading; equal time inherits; a decrease or no time leaves it undated.
    Readings (session_id, written_at, api_ms, config_dir, five_hour, seven_day); those quiet for ten minutes are evicted.
    """
    w = Window.partitionBy("session_id").orderBy("written_at")
    prev = F.lag("api_ms").over(w)
    change = F.when(F.col("api_ms").isNull() | prev.isNull() | (F.col("api_ms") < prev), "none").when(F.col("api_ms") > prev, "dated").otherwise("same")
    rows = readings.withColumn("_c", change)
    mark = F.when(F.col("_c") == "dated", F.struct(F.col("written_at").alias("t"))).when(F.col("_c") == "none", F.struct(F.lit(None).cast("timestamp_ntz").alias("t")))
    rows = rows.withColumn("as_of", F.last(mark, ignorenulls=True).over(w)["t"])
    cols = [c for c in rows.columns if c not in ("session_id", "_c")]
    newest = rows.groupBy("session_id").agg(F.max_by(F.struct(*cols), "written_at").alias("_x")).select("session_id", "_x.*")
    return newest.filter(seconds("written_at", moment(now)) <= evict_s)


def statusline_winner(sessions: DataFrame, config_dir: str, now: datetime, fresh_s: int = 300) -> DataFrame:
    """The session whose numbers count: of the default folder, dated within five minutes, the newest (then the smaller id)."""
    rows = sessions.filter((F.col("config_dir") == config_dir) & F.col("as_of").isNotNull() & (F.abs(seconds("as_of", moment(now))) <= fresh_s))
    return rows.orderBy(F.desc("as_of"), "session_id").limit(1)


def statusline_merged(buckets: DataFrame, services: DataFrame, winner: DataFrame, service: str, now: datetime) -> DataFrame:
    """Windows with the winner's percents (five_hour, seven_day: struct<percent, resets_at>) where these are newer than the
    service's own and not yet reset; a window it lacks is added at the front."""
    fed = winner.select(F.col("as_of").alias("_as_of"), F.expr("stack(2, 'five_hour', five_hour.percent, five_hour.resets_at, 'seven_day', seven_day.percent, seven_day.resets_at) as (bucket, _p, _r)"))
    fed = fed.filter(F.col("_p").isNotNull() & (F.col("_r") > moment(now))).withColumn("service", F.lit(service))
    rows = buckets.join(services.select("service", "fetched_at"), "service", "left").join(F.broadcast(fed), ["service", "bucket"], "left")  # two rows at most
    use = F.col("_p").isNotNull() & (F.col("_as_of") > F.col("fetched_at"))
    old = rows.withColumns({
        "percent": F.when(use, F.col("_p")).otherwise(F.col("percent")), "resets_at": F.when(use, F.col("_r")).otherwise(F.col("resets_at")),
        "source": F.when(use, "statusline").otherwise(F.col("source")), "as_of": F.when(use, F.col("_as_of")).otherwise(F.col("as_of")),
    }).select(*buckets.columns)
    new = fed.join(buckets.select("service", "bucket"), ["service", "bucket"], "left_anti").select(
        "service", "bucket", F.when(F.col("bucket") == "five_hour", "Current session").otherwise("All models").alias("label"), F.col("_p").alias("percent"), F.col("_r").alias("resets_at"),
        F.when(F.col("bucket") == "five_hour", "session").otherwise("weekly").alias("kind"), F.when(F.col("bucket") == "five_hour", -2).otherwise(-1).alias("pos"), F.lit("statusline").alias("source"), F.col("_as_of").alias("as_of"),
    )
    return old.unionByName(new, allowMissingColumns=True)


def restore_last_known(entries: DataFrame) -> DataFrame:
    """Stored windows without credit pools whose credit is gone (`is_pool` by id, no `credit_limit`)."""
    return entries.filter("not (is_pool and credit_limit is null)")


def month_seconds_default() -> float:
    return 30.0 * DAY
