"""Which work filled a limit window: half-hour bins, attribution to chats, price of a percent, past windows, stretches.

A window is a row (service, bucket, window_id, start, end). Readings belong to (start, end], turns to [start, end).
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.frames import TASK_ROWS, dealt, running, small, within, written
from tallyspark.functions.models import display_name
from tallyspark.functions.moments import DAY, HOUR, WEEK, cell, micros, moment, seconds, shifted
from tallyspark.functions.percents import clamped, one_decimal
from tallyspark.operators.quota import KEYS, resets

BIN_S = 1800
TURN_HORIZON_DAYS = 31
RESET_DRIFT_S = 600.0
SLACK = 1e-9
LEAST_POINTS, CHANGE_POINTS, CHANGE_SHARE, LONGEST_WEEK_DAYS = 1.0, 10.0, 0.75, 8
COLD_SHARE, COLD_TOKENS, SHORTEST_S, PROMPT_LEAD_S = 0.05, 10_000, 600, 3600
WINDOW = ["service", "window_id"]
_NEVER = -(2**62)


def window_seconds() -> Column:
    """A bucket's window: its own length, else five hours for a session, seven days for a week or a model's cap."""
    by_kind = F.when((F.col("bucket") == "five_hour") | (F.col("kind") == "session"), 5.0 * HOUR).when(
        F.col("bucket").startswith("seven_day") | F.col("kind").isin("weekly", "modelSpecific"), 7.0 * DAY
    )
    return F.coalesce(F.when(F.col("window_seconds") > 0, F.col("window_seconds")), by_kind)


def current_windows(buckets: DataFrame, now: datetime) -> DataFrame:
    """The window of each bucket that is open now: from its reset less its length to now, or to the reset if that has passed.
    Buckets without a reset or a length, and windows that have not begun, have none."""
    length = window_seconds()
    rows = buckets.withColumn("_len", length).filter("resets_at is not null and _len is not null")
    rows = rows.withColumns({"start": shifted("resets_at", -F.col("_len")), "end": F.least(moment(now), F.col("resets_at"))})
    return rows.filter(F.col("start") < F.col("end")).select("service", "bucket", "start", "end", F.col("_len").alias("length"))


def elapsed(buckets: DataFrame, now: datetime) -> DataFrame:
    """The elapsed fraction of each bucket's window; null outside it."""
    length, left = window_seconds(), seconds(moment(now), "resets_at")
    return buckets.withColumn("elapsed", F.when((left > 0) & (left <= length), 1 - left / length))


def bin_count(start: str = "start", end: str = "end") -> Column:
    return F.greatest(F.lit(1), F.ceil(seconds(start, end) / BIN_S)).cast("int")


def reading_bin(ts: str = "ts") -> Column:
    """Readings close the bin (lo, hi]."""
    return F.least(F.greatest(F.ceil(seconds("start", ts) / BIN_S) - 1, F.lit(0)), bin_count() - 1).cast("int")


def turn_bin(ts: str = "ts") -> Column:
    """Turns fall in the bin [lo, hi)."""
    return F.least(F.greatest(F.floor(seconds("start", ts) / BIN_S), F.lit(0)), bin_count() - 1).cast("int")


def bins(windows: DataFrame, readings: DataFrame) -> DataFrame:
    """All bins of all windows with `delta`, how far the running maximum rose in it, and `reached`, the maximum at its end.

    The maximum of each bin is an aggregate; the running one goes over a window's bins only (336 for a week).
    """
    points = readings.filter("percent is not null").withColumn("percent", clamped("percent")).select(*KEYS, "ts", "percent")
    inside = within(points, "ts", windows.select(*KEYS, "window_id", "start", "end"), KEYS, (F.col("ts") > F.col("start")) & (F.col("ts") <= F.col("end")), HOUR, counted=True)
    most = inside.groupBy(*WINDOW, reading_bin().alias("bin")).agg(F.max("percent").alias("percent"))
    frame = windows.select(*WINDOW, "start", "end", F.explode(F.sequence(F.lit(0), bin_count() - 1)).alias("bin"))
    rows = frame.join(most, [*WINDOW, "bin"], "left")
    w = Window.partitionBy(*WINDOW).orderBy("bin")
    reached = F.coalesce(F.max("percent").over(w), F.lit(0.0))
    rows = rows.withColumn("reached", reached)
    return rows.withColumn("delta", F.col("reached") - F.coalesce(F.lag("reached").over(w), F.lit(0.0))).select(*WINDOW, "start", "end", "bin", "delta", "reached")


def bin_use(windows: DataFrame, turns: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """Cost and tokens by window, bin and chat; with `cut`, of the bins alone that `attribution` asks for: those that rise in it,
    and those before them."""
    mine = turns.select("service", "ts", "chat_id", "cost_nd", "tokens")
    inside = within(mine, "ts", windows.select("service", "window_id", "start", "end"), ["service"], (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")), HOUR, counted=True)
    inside = inside.withColumn("bin", turn_bin())
    if cut is not None:
        asked = cut.filter("delta > 0").select(*WINDOW, F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin")).distinct()
        inside = inside.join(small(asked, asked.count()), [*WINDOW, "bin"], "left_semi")
    return inside.groupBy(*WINDOW, "bin", "chat_id").agg(F.sum("cost_nd").alias("cost_nd"), F.sum("tokens").alias("tokens"))


def _split(points: Column, cost: Column, tokens: Column, all_cost: Column, all_tokens: Column, n: Column) -> Column:
    """Points by cost; by tokens if nothing cost anything; evenly if there are none either."""
    return F.when(all_cost > 0, points * cost / all_cost).when(all_tokens > 0, points * tokens / all_tokens).otherwise(points / n)


def attribution(cut: DataFrame, use: DataFrame) -> DataFrame:
    """Each bin's rise by chat (`chat_id`, `points`): to the bin's own chats, else to those of the bin before, which the
    percent lags, else to none (a null chat: work done elsewhere)."""
    whole = use.groupBy(*WINDOW, "bin").agg(F.sum("cost_nd").alias("all_cost"), F.sum("tokens").alias("all_tokens"), F.count("*").alias("n"))
    rises = cut.filter("delta > 0").select(*WINDOW, "bin", "delta")
    own = whole.select(*WINDOW, "bin", F.lit(True).alias("_own"))
    prior = whole.select(*WINDOW, (F.col("bin") + 1).alias("bin"), F.lit(True).alias("_prior"))
    source = F.when(F.col("_own"), F.col("bin")).when(F.col("_prior"), F.col("bin") - 1)
    placed = rises.join(own, [*WINDOW, "bin"], "left").join(prior, [*WINDOW, "bin"], "left").select(*WINDOW, "bin", "delta", source.alias("_from"))
    parts = use.join(whole, [*WINDOW, "bin"]).withColumnRenamed("bin", "_from")
    got = placed.join(parts, [*WINDOW, "_from"], "left")
    points = F.when(F.col("chat_id").isNull(), F.col("delta")).otherwise(_split(F.col("delta"), F.col("cost_nd"), F.col("tokens"), F.col("all_cost"), F.col("all_tokens"), F.col("n")))
    return got.select(*WINDOW, "bin", "chat_id", points.alias("points"))


def chat_shares(windows: DataFrame, turns: DataFrame, parts: DataFrame) -> DataFrame:
    """One row for each chat with a turn in a window: its points, cost, tokens, last turn and project (that of its latest
    main-thread turn, else of its latest)."""
    mine = turns.select("service", "ts", "seq", "chat_id", "agent_id", "project", "cost_nd", "tokens")
    inside = within(mine, "ts", windows.select("service", "window_id", "start", "end"), ["service"], (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")), HOUR, counted=True)
    rows = inside.groupBy(*WINDOW, "chat_id").agg(
        F.sum("cost_nd").alias("cost_nd"), F.sum("tokens").alias("tokens"), F.max("ts").alias("last_at"),
        F.max_by("project", F.struct(F.col("agent_id").isNull().alias("_m"), "ts", "seq")).alias("project"),
    )
    points = parts.filter("chat_id is not null").groupBy(*WINDOW, "chat_id").agg(F.sum("points").alias("points"))
    return rows.join(points, [*WINDOW, "chat_id"], "left").withColumn("points", F.coalesce("points", F.lit(0.0)))


def project_shares(chats: DataFrame) -> DataFrame:
    return chats.groupBy(*WINDOW, "project").agg(F.sum("points").alias("points"), F.sum("cost_nd").alias("cost_nd"), F.sum("tokens").alias("tokens"), F.count("*").alias("chats"))


def ranked_rows(shares: DataFrame, key: str, most: int = 8) -> DataFrame:
    """The first rows of each window's list by points, cost and name, with the number of all (`total`)."""
    order = Window.partitionBy(*WINDOW).orderBy(F.desc("points"), F.desc("cost_nd"), key)
    n = shares.groupBy(*WINDOW).agg(F.count("*").alias("total"))
    return shares.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).join(n, WINDOW)


def window_totals(cut: DataFrame, parts: DataFrame, chats: DataFrame) -> DataFrame:
    """One row for each window: percent, outside, attributed points, cost, tokens, and the price of a point (null below one)."""
    percent = cut.groupBy(*WINDOW).agg(F.max("reached").alias("percent"), F.min("start").alias("start"), F.max("end").alias("end"))
    outside = parts.groupBy(*WINDOW).agg(F.sum(F.when(F.col("chat_id").isNull(), F.col("points")).otherwise(0.0)).alias("outside"))
    spent = chats.groupBy(*WINDOW).agg(F.sum("cost_nd").alias("cost_nd"), F.sum("tokens").alias("tokens"))
    rows = percent.join(outside, WINDOW, "left").join(spent, WINDOW, "left").na.fill(0, ["outside", "cost_nd", "tokens"])
    return with_price(rows.withColumn("attributed", F.col("percent") - F.col("outside")))


def with_price(rows: DataFrame) -> DataFrame:
    """Dollars (nano) and tokens for one attributed point."""
    enough = F.col("attributed") + SLACK >= LEAST_POINTS
    return rows.withColumns({"point_nd": F.when(enough, F.col("cost_nd") / F.col("attributed")), "point_tokens": F.when(enough, F.col("tokens") / F.col("attributed"))})


def change_signal(current: DataFrame, previous: DataFrame, horizon: datetime) -> DataFrame:
    """Weeks whose point buys less than three quarters of the usual: current totals (service, start, end, attributed,
    point_nd, model) against the mean of the earlier weeks' prices.

    Only windows of at most eight days with ten attributed points are compared. `percent_less` is rounded; `usual_model` is set
    where another model was the dearest before.
    """
    week = (seconds("start", "end") <= LONGEST_WEEK_DAYS * DAY) & (F.col("attributed") + SLACK >= CHANGE_POINTS) & F.col("point_nd").isNotNull()
    now = current.filter(week).select("service", F.col("start").alias("_now"), F.col("point_nd").alias("price"), F.col("model").alias("model"))
    usual = previous.filter(week & (F.col("start") >= moment(horizon)))
    side = usual.join(now.select("service", "_now"), "service").filter(F.col("end") <= F.col("_now"))
    mean = side.groupBy("service", "_now").agg(F.avg("point_nd").alias("usual_price"), F.count("*").alias("usual_weeks"))
    models = side.groupBy("service", "_now", "model").agg(F.sum("model_nd").alias("nd")).groupBy("service", "_now").agg(F.min_by("model", F.struct(-F.col("nd"), F.col("model"))).alias("_usual"))
    out = now.join(mean, ["service", "_now"]).join(models, ["service", "_now"])
    out = out.filter((F.col("usual_price") > 0) & (F.col("price") < CHANGE_SHARE * F.col("usual_price")))
    less = F.round((1 - F.col("price") / F.col("usual_price")) * 100).cast("int")
    return out.select("service", "price", "usual_price", less.alias("percent_less"), "usual_weeks", F.when(F.col("_usual") != F.col("model"), F.col("_usual")).alias("usual_model"), "model")


def window_models(windows: DataFrame, turns: DataFrame) -> DataFrame:
    """The dearest model of each window (`model`, `model_nd`)."""
    named = turns.select("service", "ts", F.coalesce(display_name("model"), F.col("model")).alias("name"), "cost_nd")
    inside = within(named, "ts", windows.select("service", "window_id", "start", "end"), ["service"], (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")), HOUR)
    each = inside.groupBy(*WINDOW, "name").agg(F.sum("cost_nd").alias("nd"))
    return each.groupBy(*WINDOW).agg(F.min_by(F.struct(F.col("name").alias("model"), F.col("nd").alias("model_nd")), F.struct(-F.col("nd"), F.col("name"))).alias("_x")).select(*WINDOW, "_x.*")


def spend_share(turns: DataFrame, start: datetime, end: datetime, denominator_nd: float, outside_nd: float = 0.0, earlier_nd: float = 0.0) -> DataFrame:
    """Points of a budget or spend limit by part (`chat`, `outside`, `earlier`), chat and bin: cost as a percent of the
    denominator. Outside and earlier have no bin; earlier shows from one cent."""
    inside = turns.filter((F.col("ts") >= moment(start)) & (F.col("ts") < moment(end)))
    rows = inside.withColumns({"start": moment(start), "end": moment(end)})
    points = lambda nd: nd * 100 / F.lit(denominator_nd) if denominator_nd > 0 else F.lit(0.0)
    chats = rows.groupBy(F.lit("chat").alias("part"), "chat_id", turn_bin().alias("bin")).agg(F.sum("cost_nd").alias("nd"))
    chats = chats.select("part", "chat_id", "bin", points(F.col("nd")).alias("points"))
    tail = [("outside", outside_nd)] * (outside_nd > 0) + [("earlier", earlier_nd)] * (earlier_nd >= 1e7)
    if not tail:
        return chats
    more = turns.sparkSession.createDataFrame([(p, float(n)) for p, n in tail], "part string, nd double")
    return chats.unionByName(more.select("part", points(F.col("nd")).alias("points")), allowMissingColumns=True)


def spend_outside(used: str | Column, local: str | Column) -> Column:
    """What a spend limit counts beyond the local cost."""
    return F.greatest(F.lit(0.0), F.col(used) - F.col(local)) if isinstance(used, str) and isinstance(local, str) else F.greatest(F.lit(0.0), used - local)


def timeline(parts: DataFrame, chats: DataFrame, most: int = 5) -> DataFrame:
    """Stacked bars: each bin's points by the window's `most` largest projects, the other ones, and outside, each with the
    height it starts at."""
    order = F.struct(-F.col("points"), -F.col("cost_nd"), F.col("project"))
    top = project_shares(chats).withColumn("_rank", F.row_number().over(Window.partitionBy(*WINDOW).orderBy(order))).select(*WINDOW, "project", "_rank")
    of_chat = chats.select(*WINDOW, "chat_id", "project").join(top, [*WINDOW, "project"])
    rows = parts.join(of_chat, [*WINDOW, "chat_id"], "left")
    series = F.when(F.col("chat_id").isNull(), "outside").when(F.col("_rank") <= most, F.col("project")).otherwise("other")
    place = F.when(F.col("chat_id").isNull(), most + 2).when(F.col("_rank") <= most, F.col("_rank")).otherwise(most + 1)
    bars = rows.groupBy(*WINDOW, "bin", series.alias("series"), place.alias("place")).agg(F.sum("points").alias("points"))
    below = Window.partitionBy(*WINDOW, "bin").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return bars.withColumn("base", F.coalesce(F.sum("points").over(below), F.lit(0.0)))


def worktree_folds(links: DataFrame) -> DataFrame:
    """slug -> project, for slugs of worktrees that lead to one main repository only. `links`: path_slug, main_slug."""
    return links.groupBy("path_slug").agg(F.count_distinct("main_slug").alias("_n"), F.min("main_slug").alias("folds_to")).filter("_n = 1").select(F.col("path_slug").alias("project"), "folds_to")


def newest_links(links: DataFrame, now: datetime, days: int = 366) -> DataFrame:
    """The newest link of each path within the retention."""
    kept = links.filter(F.col("seen_at") >= moment(now - timedelta(days=days)))
    return kept.groupBy("path_slug").agg(F.max_by("main_slug", F.struct("seen_at", "main_slug")).alias("main_slug"), F.max("seen_at").alias("seen_at"))


def folded_projects(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """`rows` with worktrees' projects replaced by their repository's."""
    out = rows.join(small(folds, folds.count()), "project", "left")
    return out.withColumn("project", F.coalesce("folds_to", "project")).select(*rows.columns)


def published(chats: DataFrame) -> DataFrame:
    """One row for each chat: its points in the session, week and budget window (`field`), to one decimal."""
    out = chats.groupBy("service", "chat_id").pivot("field", ["session", "week", "budget"]).agg(F.max(one_decimal("points")))
    return out.select("service", "chat_id", *(F.col(f).alias(f"{f}_share") for f in ("session", "week", "budget")))


def still_current(shares: DataFrame, windows: DataFrame, now: datetime) -> DataFrame:
    """Shares (service, field, resets_at, denominator) of the windows that are named now: reset within ten minutes, same
    denominator, not passed."""
    named = windows.select("service", "field", F.col("resets_at").alias("_r"), F.col("denominator").alias("_d"))
    same = (F.col("resets_at").isNull() & F.col("_r").isNull()) | (F.abs(seconds("resets_at", "_r")) < RESET_DRIFT_S)
    live = F.col("resets_at").isNull() | (F.col("resets_at") > moment(now))
    return shares.join(named, ["service", "field"]).filter(same & live & F.col("denominator").eqNullSafe(F.col("_d"))).select(*shares.columns)


def past_windows_by_drops(readings: DataFrame, current: DataFrame, horizon: datetime) -> DataFrame:
    """Finished windows between held drops; `current` (service, bucket, start) ends the newest.

    A drop from one bin before the current start on opens none. A window ends where the next one began. Windows from before the
    horizon, and those that never left 0, are left out. Each reading takes the number of drops before it, so no range join is
    needed.
    """
    drops = resets(readings).join(current.select(*KEYS, F.col("start").alias("_current")), KEYS)
    drops = drops.filter(F.col("first_after") < shifted("_current", -BIN_S))
    w = Window.partitionBy(*KEYS).orderBy("last_before")  # a bucket's resets, a few a day
    spans = drops.select(*KEYS, F.col("last_before").alias("start"), F.coalesce(F.lead("last_before").over(w), F.col("_current")).alias("end"))
    spans = spans.filter((F.col("start") >= moment(horizon)) & (F.col("start") < F.col("end")))
    used = within(readings.filter("percent > 0").select(*KEYS, "ts"), "ts", spans, KEYS, (F.col("ts") > F.col("start")) & (F.col("ts") <= F.col("end")), HOUR)
    return spans.join(used.select(*KEYS, "start").distinct(), [*KEYS, "start"], "left_semi")


def past_windows(readings: DataFrame, current: DataFrame, horizon: datetime) -> DataFrame:
    """Finished windows of each bucket from the resets that readings named, and from held drops among those that named none.

    `current`: service, bucket, start and length of the open window. Readings in a row whose resets lie within ten minutes name
    one window, from its highest reset less its last length to that reset. A held drop between readings of which one named no
    reset is a start too, unless one window's readings lie on both sides of it. After a window's reset another began even if
    no reading named it. Each window ends where the next begins, at its own reset, or at the current start.

    Nothing sees a bucket's runs together, as a service may name another reset with every reading. Whether a run or a window
    holds a moment follows from values carried along time: the last run before it, the furthest end before it. Whether a window
    begins near a moment follows from the least and largest beginning in three cells; and a window's end is the next beginning.
    Whether an unnamed reading left zero inside a window is told by a join.
    """
    rows = readings.filter(F.col("percent").isNotNull() & (F.col("ts") >= shifted(moment(horizon), -8.0 * DAY))).withColumn("percent", clamped("percent"))
    rows = rows.withColumn("_nts", F.struct("ts", "percent"))
    day_ = cell("ts", DAY)
    rows = running(rows, KEYS, ["ts", "percent"], day_, lag={"_p": "percent", "_pt": "ts", "_pr": "resets_at"}, lead={"_q": "percent"}, before={"_named": F.col("resets_at")})
    fresh = F.col("resets_at").isNotNull() & (F.col("_named").isNull() | (F.abs(seconds("_named", "resets_at")) >= RESET_DRIFT_S))
    drop = (F.col("_p") - F.col("percent") >= 5) & (F.col("_q").isNull() | (F.col("_p") - F.col("_q") >= 5)) & (F.col("_pr").isNull() | F.col("resets_at").isNull())
    rows = rows.withColumns({"_fresh": fresh.cast("long"), "_drop": drop}).select(*KEYS, "ts", "percent", "resets_at", "window_seconds", "_nts", "_pt", "_fresh", "_drop")
    rows = written(running(written(rows), KEYS, ["ts", "percent"], day_, total={"run": F.col("_fresh")}).filter("resets_at is not null or _drop"))
    runs = rows.filter("resets_at is not null").groupBy(*KEYS, "run").agg(
        F.min("resets_at").alias("low"), F.max("resets_at").alias("high"), F.max_by("window_seconds", F.when(F.col("window_seconds").isNotNull(), F.col("_nts"))).alias("length"),
        F.max(F.col("percent") > 0).alias("left_zero"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
    drops = rows.filter("_drop").select(*KEYS, F.col("_pt").alias("first_ts"), F.col("ts").alias("last_ts"))
    cur = current.select(*KEYS, F.col("start").alias("current_start"), F.col("length").alias("current_length"))
    cur = small(cur, cur.count())
    length = F.coalesce("length", "current_length")
    runs = runs.join(cur, KEYS).withColumns({"start": shifted("high", -length), "_reset": shifted("current_start", F.col("current_length"))})
    runs = runs.withColumn("is_open", (shifted("low", -RESET_DRIFT_S) < F.col("_reset")) & (F.col("_reset") < shifted("high", RESET_DRIFT_S)))
    runs = written(runs)
    drops = drops.join(cur, KEYS).filter(F.col("last_ts") <= F.col("current_start"))
    # a limit restored inside a window: the last run that began by then goes on beyond
    both = runs.select(*KEYS, F.col("first_ts").alias("at"), F.lit(0).alias("what"), F.col("last_ts").alias("until"), F.lit(None).cast("timestamp_ntz").alias("first_ts"))
    both = both.unionByName(drops.select(*KEYS, F.col("first_ts").alias("at"), F.lit(1).alias("what"), F.col("last_ts").alias("until"), "first_ts"))
    both = running(written(both), KEYS, ["at", "what", "until"], cell("at", DAY), peak={"_until": F.when(F.col("what") == 0, F.col("until"))})
    real = both.filter("what = 1 and (_until is null or _until < until)").select(*KEYS, "first_ts", F.col("until").alias("last_ts")).join(cur, KEYS)
    real = written(real)
    late = F.col("last_ts") > shifted("current_start", -float(BIN_S))
    early = real.filter(late).groupBy(*KEYS).agg(F.min("first_ts").alias("seen_early"))
    # a drop begins at the reset that a run named between its readings (of several, the first run's), else at its first reading
    opening = real.filter(~late).select(*KEYS, F.col("first_ts").alias("start"), F.col("last_ts").alias("end"))
    at_reset = within(runs.select(*KEYS, "high", "run"), "high", opening, KEYS, (F.col("high") > F.col("start")) & (F.col("high") <= F.col("end")), HOUR)
    at_reset = at_reset.groupBy(*KEYS, "start").agg(F.min_by("high", "run").alias("_reset"))
    begun = opening.join(at_reset, [*KEYS, "start"], "left").select(*KEYS, F.coalesce("_reset", "start").alias("at"))
    # not where a window's named beginning is near
    grain = int(RESET_DRIFT_S)
    here = cell("at", grain)
    ends_of = runs.select(*KEYS, F.col("start").alias("at")).groupBy(*KEYS, here.alias("_cell")).agg(F.min("at").alias("_least"), F.max("at").alias("_most"))
    spread = begun.distinct().select(*KEYS, "at", F.explode(F.array(here - 1, here, here + 1)).alias("_cell")).join(ends_of, [*KEYS, "_cell"], "left")
    near = lambda c: F.coalesce(F.abs(seconds("at", c)) < RESET_DRIFT_S, F.lit(False))
    plain = spread.groupBy(*KEYS, "at").agg(F.bool_or(near("_least") | near("_most")).alias("_near")).filter("not _near").select(*KEYS, "at")
    # and after a named reset, if no named window holds it
    closed = runs.filter("not is_open")
    points = closed.select(*KEYS, F.col("high").alias("at"), F.lit(0).alias("what"), F.lit(None).cast("timestamp_ntz").alias("high")).distinct()
    points = points.unionByName(runs.select(*KEYS, shifted("start", -RESET_DRIFT_S).alias("at"), F.lit(1).alias("what"), "high"))
    points = running(points, KEYS, ["at", "what", "high"], cell("at", DAY), peak={"_high": F.col("high")})
    plain = plain.unionByName(points.filter("what = 0 and (_high is null or _high <= at)").select(*KEYS, "at")).distinct()
    found = closed.select(*KEYS, "start", F.col("high").alias("own_end"), F.col("low").alias("reset_low"), F.col("high").alias("reset_high"), F.coalesce("left_zero", F.lit(False)).alias("left_zero"))
    found = found.unionByName(plain.select(*KEYS, F.col("at").alias("start"), F.lit(False).alias("left_zero")), allowMissingColumns=True)
    found = written(found)
    marks = running(found.select(*KEYS, "start").distinct(), KEYS, ["start"], cell("start", DAY), lead={"_next": "start"})
    found = found.join(marks, [*KEYS, "start"]).join(cur, KEYS).join(early, KEYS, "left")
    sooner = F.when(F.col("own_end").isNotNull(), F.col("own_end")).when(F.col("seen_early") > F.col("start"), F.col("seen_early"))
    following = F.when(F.col("_next") > F.col("start"), F.col("_next"))
    spans = found.withColumn("end", F.least(following, "current_start", sooner)).filter((F.col("start") >= moment(horizon)) & (F.col("start") < F.col("end")))
    spans = written(spans.select(*KEYS, "start", "end", "reset_low", "reset_high", "left_zero"))
    left = readings.filter(F.col("resets_at").isNull() & (F.col("percent") > 0) & (F.col("ts") >= moment(horizon))).select(*KEYS, "ts")
    used = within(left, "ts", spans.filter("not left_zero").select(*KEYS, "start", "end"), KEYS, (F.col("ts") > F.col("start")) & (F.col("ts") <= F.col("end")), HOUR)
    used = used.select(*KEYS, "start", "end", F.lit(True).alias("_used")).distinct()
    return spans.join(used, [*KEYS, "start", "end"], "left").filter(F.col("left_zero") | F.col("_used")).select(*KEYS, "start", "end", "reset_low", "reset_high")


def own_readings(readings: DataFrame, past: DataFrame) -> DataFrame:
    """The readings of past windows: those that named a reset of the window, held inside it, and those that named none, by time.

    Windows found by drops alone (no named reset) take the unnamed readings only.
    """
    spans = past.select(*KEYS, "start", "end", "reset_low", "reset_high")
    named = readings.filter("resets_at is not null").select(*KEYS, "ts", "percent", "resets_at")
    by_reset = spans.filter("reset_low is not null").select(*KEYS, F.col("reset_low").alias("start"), F.col("reset_high").alias("end"), F.struct("start", "end").alias("_span"))
    held = within(named, "resets_at", by_reset, KEYS, (F.col("resets_at") >= F.col("start")) & (F.col("resets_at") <= F.col("end")), HOUR)
    held = held.withColumns({"start": F.col("_span.start"), "end": F.col("_span.end")})
    held = held.withColumn("ts", F.least(F.greatest(F.col("ts"), shifted("start", 1.0)), F.col("end")))
    plain = within(readings.filter("resets_at is null").select(*KEYS, "ts", "percent"), "ts", spans, KEYS, (F.col("ts") > F.col("start")) & (F.col("ts") <= F.col("end")), HOUR)
    cols = [*KEYS, "start", "end", "ts", "percent"]
    return held.select(*cols).unionByName(plain.select(*cols))


def open_readings(readings: DataFrame, current: DataFrame) -> DataFrame:
    """The readings of the open windows: all but those that reported a reset at or before the start and ten minutes, which are
    the window before's."""
    begun = current.select(*KEYS, F.col("start").alias("_s"))
    rows = readings.join(small(begun, begun.count()), KEYS)
    return rows.filter(F.col("resets_at").isNull() | (F.col("resets_at") > shifted("_s", RESET_DRIFT_S))).select(*readings.columns)


def restored(readings: DataFrame) -> DataFrame:
    """Readings of windows (service, bucket, start, end, ts, percent) with those before a held drop inside the window scaled
    to where it landed, so that a restored limit isn't counted twice.

    A window's few held drops are folded in order; each reading is then scaled by the factors of the drops after it.
    """
    keys = [*KEYS, "start"]
    rows = readings.withColumn("percent", clamped("percent"))
    rows = running(rows, keys, ["ts", "percent"], cell("ts", DAY), lag={"_p": "percent"}, lead={"_q": "percent"})
    held = (F.col("_p") - F.col("percent") >= 5) & (F.col("_q").isNull() | (F.col("_p") - F.col("_q") >= 5))
    rows = rows.withColumn("_drop", held)
    rows = running(rows.withColumn("_d", F.col("_drop").cast("long")), keys, ["ts", "percent"], cell("ts", DAY), total={"_part": F.coalesce(F.col("_d"), F.lit(0))})
    # the highest reading of each part between drops, and where the drop that ends it landed
    parts = rows.groupBy(*keys, "_part").agg(F.max("percent").alias("_top"), F.min_by("percent", F.struct("ts", "percent")).alias("_landed"))
    each = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_part", "_top", "_landed"))).alias("_parts"))
    # folds (scaled maximum so far, factors): at drop k the level is the scaled maximum before it
    state = F.struct(F.col("_parts")[0]["_top"].alias("level"), F.array().cast("array<double>").alias("factors"))

    def step(acc: Column, part: Column) -> Column:
        factor = F.when(acc["level"] > 0, part["_landed"] / acc["level"]).otherwise(F.lit(1.0))
        return F.struct(F.greatest(acc["level"] * factor, part["_top"]).alias("level"), F.concat(acc["factors"], F.array(factor)).alias("factors"))

    folded = F.aggregate(F.slice("_parts", 2, F.greatest(F.lit(1), F.size("_parts"))), state, step)["factors"]
    factors = each.select(*keys, folded.alias("_f"))
    out = rows.join(factors, keys)
    later = F.expr("slice(_f, cast(_part as int) + 1, greatest(0, size(_f) - cast(_part as int)))")
    scale = F.aggregate(later, F.lit(1.0).cast("double"), lambda acc, f: acc * f)
    return out.withColumn("percent", F.col("percent") * scale).select(*readings.columns)


def is_cold_start(whole_prompt: bool = False) -> Column:
    """A main-thread turn that read under 5 % of its prompt from cache and wrote at least 10,000 tokens of it (or, for a log
    without cache writes, had a prompt of as many)."""
    prompt = F.expr("input + cache_read + cache_write_5m + cache_write_1h")
    rebuilt = prompt if whole_prompt else F.expr("cache_write_5m + cache_write_1h")
    return F.col("agent_id").isNull() & (prompt > 0) & (F.col("cache_read") < prompt * COLD_SHARE) & (rebuilt >= COLD_TOKENS)


def _since(turns: DataFrame) -> DataFrame:
    """Turns of a chat (service, chat_id) with `_before` and `_prior`, when its latest turn and its latest main turn strictly
    before this one were, and `_builds`: whether this is its first main turn.

    A chat's rows are spread over the weeks; a row for each week is handed on, as `frames.running` does.
    """
    chat = ["chat_id", "service"]  # chats first: sorts tell them apart by their first column
    rows = turns.withColumns({"_slice": cell("ts", WEEK), "_main_at": F.when(F.col("agent_id").isNull(), F.col("ts"))})
    past = Window.partitionBy(*chat).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    each = rows.groupBy(*chat, "_slice").agg(F.max("ts").alias("_end"), F.max("_main_at").alias("_main_end"))
    carried = each.select(*chat, "_slice", F.max("_end").over(past).alias("_end"), F.max("_main_end").over(past).alias("_main_end"))
    own = Window.partitionBy(*chat, "_slice").orderBy(micros("ts"))
    ahead, whole = own.rangeBetween(Window.unboundedPreceding, -1), own.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_before": F.max("ts").over(ahead), "_prior": F.max("_main_at").over(ahead), "_build": F.min(F.when(F.col("agent_id").isNull(), F.struct("ts", "seq"))).over(whole)})
    rows = rows.join(carried, [*chat, "_slice"])
    builds = F.col("_main_end").isNull() & (F.col("ts") == F.col("_build.ts")) & (F.col("seq") == F.col("_build.seq"))
    return rows.select(*turns.columns, F.coalesce("_before", "_end").alias("_before"), F.coalesce("_prior", "_main_end").alias("_prior"), F.coalesce(builds, F.lit(False)).alias("_builds"))


def stretches(windows: DataFrame, turns: DataFrame, events: DataFrame, parts: DataFrame, whole_prompt: bool = False) -> DataFrame:
    """Each chat of a window cut at its compactions and cold starts, at least ten minutes apart.

    One row for each stretch with a turn: opening (first, compaction, cold), first and last turn, points of the chat's bins (by
    cost, tokens or evenly among the stretches there), cost, what rebuilding the context cost, and the first prompt typed for
    it. A chat's starts are whole seconds of a window; they are thinned in order, each kept start deciding the next.

    Turns are shuffled by window and chat once and sorted once: starts and points are lists handed to a chat's first turn, and
    what follows groups by more than these keys. Stretches meet the prompts in one running function over both, whatever their number.
    """
    keys = ["chat_id", *WINDOW]  # chats first: sorts tell them apart by their first column
    spans = windows.select("service", "window_id", "start", "end")
    mine = turns.select(
        "service", "chat_id", "ts", "seq", "agent_id", "cost_nd", "tokens", is_cold_start(whole_prompt).alias("_cold"), (F.col("cost_input") + F.col("cost_cache_write")).alias("_rebuild"),
    )
    held = (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))
    inside = within(_since(mine), "ts", spans, ["service"], held, HOUR, counted=True)
    cold = within(mine.filter("_cold").select("service", "chat_id", "ts"), "ts", spans, ["service"], held, HOUR, counted=True)
    compact = within(events.filter("kind = 'compaction'").select("chat_id", "at"), "at", spans, [], (F.col("at") > F.col("start")) & (F.col("at") < F.col("end")), HOUR, counted=True)
    mark = lambda at, o: F.struct(F.col(at).alias("at"), F.lit(o).alias("_o"))
    none = F.lit(None).cast("struct<at: timestamp_ntz, _o: int>")
    marks = cold.select(*keys, mark("ts", 1).alias("_mark")).unionByName(compact.select(*keys, mark("at", 0).alias("_mark")))
    given = parts.filter("chat_id is not null and points > 0").select(*keys, none.alias("_mark"), F.struct("bin", "points").alias("_part"))
    side = marks.withColumn("_part", F.lit(None).cast(given.schema["_part"].dataType)).unionByName(given)
    n = turns.count()
    deal = lambda df: dealt(df, keys, n, TASK_ROWS // 4)  # noqa: E731  # alike on both sides, so that the join shuffles neither again
    side = deal(side).groupBy(*keys).agg(F.array_sort(F.collect_set("_mark")).alias("_marks"), F.array_sort(F.collect_list("_part")).alias("_parts"))

    # the turn that no other of its chat and window precedes walks the starts; the chat's other turns are told what it found
    rows = deal(inside.withColumn("bin", turn_bin())).join(side.hint("shuffle_hash"), keys, "left")
    seed = F.array(F.struct(F.col("ts").alias("at"), F.lit(2).alias("_o")))
    far = lambda kept, m: (F.unix_micros(m["at"].cast("timestamp")) - F.unix_micros(F.element_at(kept, -1)["at"].cast("timestamp"))) >= SHORTEST_S * 1_000_000
    later = F.filter(F.coalesce("_marks", F.slice(seed, 1, 0)), lambda m: m["at"] > F.col("ts"))
    walked = F.aggregate(later, seed, lambda kept, m: F.when(far(kept, m), F.concat(kept, F.array(m))).otherwise(kept))
    first = F.col("_before").isNull() | (F.col("_before") < F.col("start"))
    rows = rows.withColumns({"_walked": F.when(first, walked), "_parts": F.when(first, F.col("_parts"))}).drop("_marks")
    chat = Window.partitionBy(*keys).orderBy("bin", "ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({"_starts": F.first("_walked", ignorenulls=True).over(chat), "_parts": F.first("_parts", ignorenulls=True).over(chat), "_bins": F.collect_set("bin").over(chat)})
    nth = F.when(F.size("_starts") == 1, 1).otherwise(F.size(F.filter("_starts", lambda s: s["at"] <= F.col("ts"))))
    # points: a bin's points of the chat go to its stretches there, or in the bin before if it has none
    of = lambda bin_: F.coalesce(F.aggregate(F.filter("_parts", lambda p: p["bin"] == bin_), F.lit(0.0), lambda acc, p: acc + p["points"]), F.lit(0.0))
    lagging = F.when(F.array_contains("_bins", F.col("bin") + 1), 0.0).otherwise(of(F.col("bin") + 1))
    got = F.when(F.col("_parts").isNull(), 0.0).otherwise(of(F.col("bin")) + lagging)
    rows = rows.withColumns({"stretch": nth, "_points": got}).withColumn("_opening", F.element_at("_starts", F.col("stretch")))
    rebuilt = F.when(F.col("_cold") & ~F.col("_builds"), F.col("_rebuild")).otherwise(0)
    rows = rows.select(*keys, "stretch", "bin", "_opening.at", "_opening._o", "ts", "agent_id", "_prior", "cost_nd", "tokens", rebuilt.alias("_rebuilt"), "_points")
    # a turn's share of its bin: by cost, by tokens, or evenly among the stretches, each one's first turn there standing for it
    there = Window.partitionBy(*keys, "bin").orderBy("ts")
    whole = there.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_cost": F.sum("cost_nd").over(whole), "_tokens": F.sum("tokens").over(whole), "_n": F.size(F.collect_set("stretch").over(whole)), "_same": F.coalesce(F.lag("stretch").over(there) == F.col("stretch"), F.lit(False)),
    })
    weighed = (F.col("_cost") > 0) | (F.col("_tokens") > 0)
    share = F.when((F.col("_points") > 0) & (weighed | ~F.col("_same")), _split(F.col("_points"), F.col("cost_nd"), F.col("tokens"), F.col("_cost"), F.col("_tokens"), F.col("_n"))).otherwise(0.0)
    # a later turn has no earlier main turn before it, so the least is that of the stretch's first (none: the least of all)
    main, prior = F.col("agent_id").isNull(), F.coalesce(micros("_prior"), F.lit(_NEVER))
    out = rows.groupBy(*keys, "stretch").agg(
        F.min("at").alias("_start"), F.min("_o").alias("_o"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.sum(share).alias("points"), F.sum("cost_nd").alias("cost_nd"), F.sum("_rebuilt").alias("cold_nd"),
        F.coalesce(F.min(F.when(main, F.col("ts"))), F.min("ts")).alias("_main"), F.nullif(F.coalesce(F.min(F.when(main, prior)), F.min(prior)), F.lit(_NEVER)).alias("_prior"),
    )

    # the first prompt after the chat's previous main turn (of the whole log), up to the stretch's last turn. Backwards in time,
    # a stretch comes before the prompts of its moment if they must be later, else after them
    compaction = F.col("_o") == 0
    since = F.when(compaction, micros("_start")).otherwise(F.coalesce("_prior", micros(shifted("_main", -float(PROMPT_LEAD_S)))))
    opening = F.when(compaction, "compaction").when(F.col("_o") == 1, "cold").otherwise("first")
    asking = written(out.select(*keys, "stretch", opening.alias("opening"), "first_at", "last_at", "points", "cost_nd", "cold_nd", since.alias("_at"), F.when(~compaction & F.col("_prior").isNotNull(), 0).otherwise(2).alias("_tie")))
    typed = events.filter("kind = 'prompt'").groupBy("chat_id", micros("at").alias("_at")).agg(F.min(F.struct("text")).alias("_typed")).withColumn("_tie", F.lit(1))
    both = asking.unionByName(typed, allowMissingColumns=True).withColumn("_back", -F.col("_at"))
    both = running(both, ["chat_id"], ["_back", "_tie"], F.floor(F.col("_back") / F.lit(WEEK * 1_000_000)), last={"_next": F.when(F.col("_tie") == 1, F.struct("_at", "_typed.text"))})
    prompt = F.when(F.col("_next._at") <= micros("last_at"), F.col("_next.text"))
    return both.filter("_tie <> 1").select(*WINDOW, "chat_id", "stretch", "opening", "first_at", "last_at", "points", "cost_nd", "cold_nd", prompt.alias("prompt"))


def kept_turns(turns: DataFrame) -> DataFrame:
    """What a page needs of its turns, written once for its parts."""
    return written(turns.select(
        "service", "chat_id", "ts", "seq", "agent_id", "project", "input", "cache_read", "cache_write_5m", "cache_write_1h", "cost_nd", "cost_input", "cost_cache_write", "tokens"
    ))


def load(windows: DataFrame, readings: DataFrame, turns: DataFrame, events: DataFrame, folds: DataFrame | None = None) -> dict[str, DataFrame]:
    """All that a page about windows shows: bins, parts, chats, projects, totals, stretches."""
    turns = kept_turns(turns)
    cut = written(bins(windows, readings))
    parts = written(attribution(cut, bin_use(windows, turns, cut)))
    chats = chat_shares(windows, turns, parts)
    if folds is not None:
        chats = folded_projects(chats, folds)
    return {"bins": cut, "parts": parts, "chats": chats, "projects": project_shares(chats), "totals": window_totals(cut, parts, chats), "stretches": stretches(windows, turns, events, parts)}


def account_mode() -> Column:
    """How an account (`has_windows`, extra usage, `pay_as_you_go`) is limited."""
    return (
        F.when(F.col("has_windows"), "subscription")
        .when(F.coalesce(F.col("extra_enabled") & (F.col("extra_limit") > 0), F.lit(False)), "spend_limit")
        .when(F.col("pay_as_you_go"), "budget")
    )


def period(mode: str, span: str, now: datetime, weeks_ago: int = 0, window: tuple[datetime, datetime] | None = None) -> tuple[datetime, datetime] | None:
    """The period that a share is asked for: the window given, `weeks_ago` weeks of seven days, or the calendar month of a
    spend limit."""
    if mode == "subscription":
        return window
    if mode == "budget":
        end = now - timedelta(days=7 * weeks_ago)
        return end - timedelta(days=7), end
    start = datetime(now.year, now.month, 1)
    return (start, now) if start < now else None


def same_period(a: tuple[datetime, datetime], b: tuple[datetime, datetime]) -> bool:
    """Two requests ask for one period if its bounds lie within ten minutes."""
    return all(abs((x - y).total_seconds()) < RESET_DRIFT_S for x, y in zip(a, b, strict=True))
