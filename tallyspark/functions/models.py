"""Model ids: normal form, family, display name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.functions.moments import col

# Families by their word, in the order in which they are tried.
FAMILIES = ("fable", "mythos", "opus", "sonnet", "haiku")
# Words of an id that are written in capitals.
ACRONYMS = {"gpt": "GPT", "tts": "TTS", "ai": "AI"}
# The patterns of known ids.
_NAMED = r"claude-([a-z]+)-(\d{1,2})(?:-(\d{1,2}))?(?!\d)"
_GROK = r"^grok-(\d{1,2})(?:[.-](\d{1,2}))?(?![\d.])"
_GPT = r"^gpt-(\d{1,2})(?:[.-](\d{1,2}))?([a-z])?(?![\d.])(-codex)?"
_O_SERIES = r"^o(\d{1,2})(?![\d.])"
_DATE = r"-\d{8}$"


def normalized(model: str | Column) -> Column:
    """Lower case, without a context tag in brackets and a date at the end."""
    return F.regexp_replace(F.substring_index(F.lower(col(model)), "[", 1), _DATE, "")


def is_synthetic(model: str | Column) -> Column:
    m = F.coalesce(col(model), F.lit(""))
    return (m == "") | (m == "unknown") | m.startswith("<") | m.contains("synthetic")


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def _line(prefix: str, text: Column, pattern: str) -> Column:
    """prefix + major[.minor], null where the pattern doesn't match."""
    major, minor = _group(text, pattern, 1), _group(text, pattern, 2)
    return F.when(major != "", F.concat(F.lit(prefix), major, F.when(minor != "", F.concat(F.lit("."), minor)).otherwise("")))


def family(model: str | Column) -> Column:
    low = F.lower(col(model))
    gpt = F.concat(_line("gpt-", normalized(model), _GPT), _group(normalized(model), _GPT, 3), _group(normalized(model), _GPT, 4))
    o = _group(normalized(model), _O_SERIES, 1)
    word = F.coalesce(*(F.when(low.contains(f), F.lit(f)) for f in FAMILIES))
    return F.coalesce(word, F.when(low.startswith("grok"), F.coalesce(_line("grok-", low, _GROK), F.lit("grok"))), gpt, F.when(o != "", F.concat(F.lit("o"), o)), F.lit("other"))


def display_name(model: str | Column) -> Column:
    """A readable name; null for synthetic ids."""
    low = F.lower(col(model))
    named = F.concat(F.initcap(_group(low, _NAMED, 1)), F.lit(" "), _line("", low, _NAMED.replace(r"([a-z]+)", r"[a-z]+", 1)))
    word = F.coalesce(*(F.when(low.contains(f), F.lit(f.capitalize())) for f in FAMILIES))
    parts = F.filter(F.split(F.regexp_replace(F.element_at(F.split(col(model), "/"), -1), _DATE, ""), "[-_]"), lambda p: p != "")
    acronyms = F.create_map(*(F.lit(x) for pair in ACRONYMS.items() for x in pair))
    plain = F.array_join(F.transform(parts, lambda p: F.coalesce(acronyms[F.lower(p)], F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10_000)))), " ")
    pretty = F.when(plain == "", col(model)).otherwise(plain)
    return F.when(~is_synthetic(model), F.coalesce(named, _line("Grok ", low, _GROK), word, pretty))
