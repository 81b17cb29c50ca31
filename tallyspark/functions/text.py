"""Titles, names, labels and figures as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.moments import col

# Folders that say nothing about a project.
NOISE = ("Desktop/", "Documents/", "Developer/", "Projects/", "Code/", "Workspace/")
TITLE_LENGTH = 80


def title(raw: str | Column, limit: int = TITLE_LENGTH) -> Column:
    """White space collapsed, cut to `limit` characters of which the last is an ellipsis; null if nothing is left."""
    flat = F.trim(F.regexp_replace(col(raw), r"\s+", " "))
    cut = F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…"))
    return F.when(flat == "", F.lit(None).cast("string")).when(F.length(flat) > limit, cut).otherwise(flat)


def prompt_title(raw: str | Column, limit: int = TITLE_LENGTH) -> Column:
    """As `title`, but `limit` characters stay before the ellipsis."""
    flat = F.trim(F.regexp_replace(col(raw), r"\s+", " "))
    return F.when(flat == "", F.lit(None).cast("string")).when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat)


def path_name(path: str | Column, home: str = "/home/user") -> Column:
    """The last two parts of a path, without the home folder and one noise folder."""
    p = col(path)
    clean = F.when(p.startswith(home + "/"), F.substring(p, len(home) + 2, 100_000)).otherwise(F.regexp_replace(p, "^/", ""))
    clean = F.regexp_replace(clean, "^(?:" + "|".join(NOISE) + ")", "")
    parts = F.filter(F.split(clean, "/"), lambda x: x != "")
    n = F.size(parts)
    return F.when(n == 0, p).when(n == 1, F.element_at(parts, 1)).otherwise(F.concat_ws(" / ", F.element_at(parts, -2), F.element_at(parts, -1)))


def project_name(slug: str | Column, home: str = "/home/user") -> Column:
    """A project's name from its slug: each run of dashes is taken for a folder's end (no disk is asked)."""
    tokens = F.filter(F.split(col(slug), "-"), lambda x: x != "")
    return F.when(F.size(tokens) == 0, col(slug)).otherwise(path_name(F.concat(F.lit("/"), F.array_join(tokens, "/")), home))


def project_name_of_path(slug: str | Column, home: str = "/home/user") -> Column:
    """A project's name from a percent-encoded path; other slugs stay."""
    path = F.try_url_decode(F.replace(col(slug), F.lit("+"), F.lit("%2B")))
    return F.when(path.startswith("/"), path_name(path, home)).otherwise(col(slug))


def dash_slug(path: str | Column) -> Column:
    """A path with a dash for each UTF-16 unit that is no letter or digit of ASCII."""
    wide = F.regexp_replace(col(path), r"[\x{10000}-\x{10FFFF}]", "--")
    return F.regexp_replace(wide, "[^0-9A-Za-z]", "-")


def percent_slug(path: str | Column) -> Column:
    """A percent-encoded path, blanks as %20."""
    return F.replace(F.url_encode(col(path)), F.lit("+"), F.lit("%20"))


def words_label(name: str | Column) -> Column:
    """`seven_day_x` as `Seven Day X`."""
    words = F.filter(F.split(col(name), "[_-]"), lambda w: w != "")
    cased = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 10_000)))
    return F.when(F.size(words) == 0, col(name)).otherwise(F.array_join(cased, " "))


def window_kind(name: str | Column) -> Column:
    """What kind of limit an unknown window is, by its key."""
    c = col(name)
    return (
        F.when(c.startswith("seven_day_"), "modelSpecific")
        .when(c.contains("day") | c.contains("week"), "weekly")
        .when(c.contains("hour") | c.contains("session"), "session")
        .otherwise("other")
    )


def window_label(name: str | Column) -> Column:
    """`seven_day_x` as `X only`, other keys word by word."""
    c = col(name)
    stem = F.regexp_replace(c, "^seven_day_", "")
    words = F.filter(F.split(stem, "_"), lambda w: w != "")
    cased = F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000))))
    return F.when(c.startswith("seven_day_") & (F.size(words) == 1), F.concat(F.element_at(cased, 1), F.lit(" only"))).otherwise(F.array_join(cased, " "))


def token_count(n: str | Column) -> Column:
    """12.3k, 4.0M, 1.2B."""
    c = col(n)
    steps = F.when(c >= 10**9, F.format_string("%.1fB", c / 1e9)).when(c >= 10**6, F.format_string("%.1fM", c / 1e6))
    return steps.when(c >= 10**3, F.format_string("%.1fk", c / 1e3)).otherwise(c.cast("string"))


def spaced_tokens(n: str | Column, largest: str = "B") -> Column:
    """`130 M`, `9.5 M`, `84 k`: whole from ten of a unit, one decimal below; what rounds to a thousand steps up a unit, as far
    as the `largest` (k, M or B), which takes all beyond."""
    c = col(n).cast("double")
    out = F.when(F.round(c) < 1000, F.format_string("%.0f", F.round(c)))
    units = ((1e3, "k"), (1e6, "M"), (1e9, "B"))
    units = units[: [name for _, name in units].index(largest) + 1]
    for i, (scale, name) in enumerate(units):
        tenths = F.round(c / scale * 10) / 10
        whole = tenths >= 10
        figure = F.when(whole, F.round(c / scale)).otherwise(tenths)
        text = F.concat(F.when(whole, F.format_string("%.0f", figure)).otherwise(F.format_string("%.1f", figure)), F.lit(f" {name}"))
        out = out.when(figure < 1000, text) if i < len(units) - 1 else out.otherwise(text)
    return out


def share_text(points: str | Column) -> Column:
    """`≈ 4.2 %`; below a tenth of a point `< 0.1 %`."""
    p = col(points)
    return F.when(p + F.lit(1e-9) < 0.1, "< 0.1 %").otherwise(F.format_string("≈ %.1f %%", F.round(p * 10) / 10))


def dollars_text(amount: str | Column) -> Column:
    """Whole dollars from $10, cents below."""
    a = col(amount)
    return F.concat(F.lit("$"), F.when(F.abs(a) >= 10, F.format_number(F.round(a), 0)).otherwise(F.format_number(F.round(a, 2), 2)))


def duration_text(seconds: str | Column) -> Column:
    """`<1m`, `5m`, `2h05m`, `3d4h`."""
    s = F.greatest(F.lit(0), F.floor(col(seconds))).cast("long")
    minutes, hours, days = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86_400)
    return (
        F.when(s < 60, "<1m")
        .when(s < 3600, F.format_string("%dm", minutes))
        .when(s < 86_400, F.format_string("%dh%02dm", hours, minutes % 60))
        .otherwise(F.format_string("%dd%dh", days, hours % 24))
    )


def short_url(raw: str | Column) -> Column:
    """Host and path; a bare host where the path is empty or `/`; other text stays."""
    flat = F.trim(F.regexp_replace(col(raw), r"\s+", " "))
    host, path = F.try_parse_url(flat, F.lit("HOST")), F.coalesce(F.try_parse_url(flat, F.lit("PATH")), F.lit(""))
    bare = F.regexp_extract(flat, r"^([A-Za-z0-9.-]+\.[A-Za-z]{2,})(?:[/?#]|$)", 1)
    bare_path = F.regexp_extract(flat, r"^[A-Za-z0-9.-]+(/[^?#]*)", 1)
    joined = lambda h, p: F.concat(h, F.when((p == "") | (p == "/"), "").otherwise(p))
    return F.when(host.isNotNull() & (host != ""), joined(host, path)).when(bare != "", joined(bare, bare_path)).otherwise(flat)


def tool_summary(tool: str | Column, tool_input: str | Column) -> Column:
    """One line about a tool call, from the tool's name and its input as JSON; null where there is nothing to say."""
    t, j = col(tool), col(tool_input)
    field = lambda name: F.get_json_object(j, f"$.{name}")
    base = lambda path: F.element_at(F.filter(F.split(path, "/"), lambda x: x != ""), -1)
    said = lambda name: F.coalesce(title(field(name), 100_000), F.lit(""))
    named = lambda path: F.when(F.trim(path) != "", F.concat(t, F.lit(" "), F.coalesce(F.when(path != "/", base(path)), path)))
    n = F.coalesce(F.json_array_length(field("questions")), F.lit(0))
    first = F.coalesce(title(F.get_json_object(j, "$.questions[0].question"), 100_000), F.lit(""))
    questions = (
        F.when((n > 1) & (first == ""), F.concat(n.cast("string"), F.lit(" questions for you")))
        .when(n > 1, F.concat(n.cast("string"), F.lit(" questions: "), first))
        .when(first == "", "Question for you")
        .otherwise(F.concat(F.lit("Question: "), first))
    )
    heading = F.regexp_replace(F.regexp_extract(F.coalesce(field("plan"), F.lit("")), r"(?m)^[#\s*>-]*(\S[^\n]*)$", 1), r"\s+", " ")
    plan = F.when(heading == "", "Plan ready for review").otherwise(F.concat(F.lit("Plan ready for review: "), F.trim(heading)))
    head = (
        F.when(t == "Bash", F.when(said("description") != "", said("description")).otherwise(said("command")))
        .when(t.isin("Edit", "Write", "MultiEdit", "Read"), named(field("file_path")))
        .when(t == "NotebookEdit", named(field("notebook_path")))
        .when(t.isin("Grep", "Glob"), F.when(said("pattern") != "", F.concat(t, F.lit(" "), said("pattern"))))
        .when(t.isin("WebFetch", "WebSearch"), F.when(said("url") != "", short_url(field("url"))).otherwise(said("query")))
        .when(t == "AskUserQuestion", questions)
        .when(t == "ExitPlanMode", plan)
        .otherwise(said("description"))
    )
    return F.when(t.isNotNull() & (t != "") & j.isNotNull() & (head != ""), title(head))


def countdown_text(seconds: str | Column) -> Column:
    """"2d 4h" beyond a day, "1h 10m", "45m"; nothing below zero."""
    s = F.greatest(F.lit(0), F.floor(col(seconds))).cast("long")
    h, m = F.floor(s / 3600).cast("string"), F.floor(s % 3600 / 60).cast("string")
    days = F.concat(F.floor(s / 86_400).cast("string"), F.lit("d "), (F.floor(s / 3600) % 24).cast("string"), F.lit("h"))
    return F.when(s >= 25 * 3600, days).when(s >= 3600, F.concat(h, F.lit("h "), m, F.lit("m"))).otherwise(F.concat(m, F.lit("m")))


def reset_texts(resets_at: str, now: Column) -> dict[str, Column]:
    """When a window resets, in English and on a 24-hour clock; null where no reset is named.

    relative: "in 1h 10m" or "now". absolute: "13:00" today, "Thu 14:15" within six days, "Sep 14, 14:15" beyond. both: "resets
    in 1h 10m (13:00)", without the time within the hour, "resets now" past it.
    """
    at = F.col(resets_at)
    left = (F.unix_micros(at.cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / F.lit(1e6)
    relative = F.when(left <= 0, "now").when(left > 0, F.concat(F.lit("in "), countdown_text(left)))
    days = F.datediff(F.to_date(at), F.to_date(now))
    absolute = F.when(days == 0, F.date_format(at, "HH:mm")).when((days > 0) & (days <= 6), F.date_format(at, "EEE HH:mm")).otherwise(F.date_format(at, "MMM d, HH:mm"))
    both = F.when(left <= 0, "resets now").when(left <= 3600, F.concat(F.lit("resets "), relative)).otherwise(F.concat(F.lit("resets "), relative, F.lit(" ("), absolute, F.lit(")")))
    return {"relative": relative, "absolute": absolute, "both": both}
