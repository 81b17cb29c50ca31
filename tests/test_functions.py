"""Scalar functions, case by case."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import frames, models, moments, percents, text
from tallyspark.operators import pricing


def values(spark, rows, kind, expr):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.select(expr.alias("y"), "i").orderBy("i").collect()]


def test_model_ids(spark):
    ids = ["Claude-Haiku-4-5-20251001", "claude-fable-5[1m]", "claude-sonnet-4-20250514", "gpt-5.1-codex-max", "gpt-4o-mini", "o4-mini", "grok-4.6-build", "grok-build-0.1", "opus", "mistral/gemini-3.1-pro-preview", "gpt-image-1", "<synthetic>", "", "unknown", "x-synthetic", None]
    norm = values(spark, ids, "string", models.normalized("x"))
    assert norm[:3] == ["claude-haiku-4-5", "claude-fable-5", "claude-sonnet-4"]
    assert values(spark, ids, "string", models.family("x"))[:11] == ["haiku", "fable", "sonnet", "gpt-5.1-codex", "gpt-4o", "o4", "grok-4.6", "grok", "opus", "other", "other"]
    names = values(spark, ids, "string", models.display_name("x"))
    assert names[:3] == ["Haiku 4.5", "Fable 5", "Sonnet 4"]
    assert names[6] == "Grok 4.6" and names[8] == "Opus"
    assert names[9] == "Gemini 3.1 Pro Preview" and names[10] == "GPT Image 1" and names[7] == "Grok Build 0.1"
    assert names[11:] == [None] * 5


def test_titles(spark):
    long = "word " * 30
    rows = ["  a\n b\t c ", "", "   ", long, None]
    assert values(spark, rows, "string", text.title("x")) == ["a b c", None, None, ("word " * 16)[:79].rstrip() + "…", None]
    assert values(spark, [long], "string", text.prompt_title("x")) == [("word " * 30).strip()[:80] + "…"]


def test_project_names(spark):
    assert values(spark, ["/home/user/Desktop/work/repo", "/home/user/one", "/a/b/c", "/", "plain"], "string", text.path_name("x")) == ["work / repo", "one", "b / c", "/", "plain"]
    assert values(spark, ["-home-user-Code-app", "---", ""], "string", text.project_name("x")) == ["app", "---", ""]
    assert values(spark, ["%2Fhome%2Fuser%2Fmy%20app", "100%", "slug", "%2Fa+b"], "string", text.project_name_of_path("x")) == ["my app", "100%", "slug", "a+b"]
    assert values(spark, ["/a b.c", "é😀x"], "string", text.dash_slug("x")) == ["-a-b-c", "---x"]
    assert values(spark, ["/a b"], "string", text.percent_slug("x")) == ["%2Fa%20b"]


@pytest.mark.parametrize(("n", "shown"), [(999, "999"), (1000, "1.0k"), (12_345, "12.3k"), (4_000_000, "4.0M"), (1_200_000_000, "1.2B")])
def test_token_counts(spark, n, shown):
    assert values(spark, [n], "long", text.token_count("x")) == [shown]


@pytest.mark.parametrize(("n", "shown"), [(999.4, "999"), (999.6, "1.0 k"), (9_999.0, "10 k"), (999_950.0, "1.0 M"), (9_500_000.0, "9.5 M"), (130e6, "130 M"), (2.5e9, "2.5 B")])
def test_spaced_tokens_step_up(spark, n, shown):
    assert values(spark, [n], "double", text.spaced_tokens("x")) == [shown]


@pytest.mark.parametrize(("n", "shown"), [(999_600_000.0, "1000 M"), (1e9, "1000 M"), (14_400e6, "14400 M"), (999_950.0, "1.0 M"), (999.6, "1.0 k")])
def test_spaced_tokens_stay_in_their_largest_unit(spark, n, shown):
    assert values(spark, [n], "double", text.spaced_tokens("x", "M")) == [shown]


def test_figure_texts_of_large_keys(spark, tmp_path):
    import duckdb

    from tallyspark.plans.registry import ORACLE_SQL, QUERIES

    keys = [31_606, 31_607, 31_615, 31_616, 31_623, 99_999, 119_999, 1_199_999, 7_199_999]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    expected = con.execute(f"select p_partkey, share, dollars, tokens from ({ORACLE_SQL['figure_texts']}) order by 1").fetchall()
    assert [tuple(r) for r in QUERIES["figure_texts"](spark, str(tmp_path)).orderBy("p_partkey").collect()] == expected


def test_shares_and_dollars(spark):
    assert values(spark, [0.04, 0.1, 4.25, 12.0], "double", text.share_text("x")) == ["< 0.1 %", "≈ 0.1 %", "≈ 4.3 %", "≈ 12.0 %"]
    assert values(spark, [6.2, 62.4, 1358.0, 0.0], "double", text.dollars_text("x")) == ["$6.20", "$62", "$1,358", "$0.00"]


def test_durations(spark):
    assert values(spark, [5.0, 61.0, 3660.0, 86_400.0 + 7200, -3.0], "double", text.duration_text("x")) == ["<1m", "1m", "1h01m", "1d2h", "<1m"]


def test_tool_summaries(spark):
    rows = [
        ("Bash", '{"command": "ls  -l", "description": ""}', "ls -l"), ("Bash", '{"command": "x", "description": "List files"}', "List files"), ("Edit", '{"file_path": "/a/b.txt"}', "Edit b.txt"), ("Read", '{"file_path": "  "}', None),
        ("Grep", '{"pattern": "a b"}', "Grep a b"), ("WebFetch", '{"url": "https://x.org/a?b=1"}', "x.org/a"), ("WebFetch", '{"url": "https://x.org/"}', "x.org"), ("WebSearch", '{"query": "spark  sql"}', "spark sql"),
        ("AskUserQuestion", '{"questions": [{"question": "Why?"}]}', "Question: Why?"), ("AskUserQuestion", '{"questions": [{"question": "A"}, {"question": "B"}]}', "2 questions: A"), ("AskUserQuestion", "{}", "Question for you"),
        ("ExitPlanMode", '{"plan": "# Do it\\nmore"}', "Plan ready for review: Do it"), ("ExitPlanMode", "{}", "Plan ready for review"), ("Other", '{"description": "does"}', "does"), ("Other", "{}", None), (None, "{}", None), ("Bash", None, None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, t string, j string")
    assert [r[0] for r in df.select(text.tool_summary("t", "j"), "i").orderBy("i").collect()] == [e for *_, e in rows]


def test_percents(spark):
    assert values(spark, [-5.0, 50.0, 130.0, None], "double", percents.clamped("x")) == [0.0, 50.0, 100.0, None]
    assert values(spark, [0.0, 0.1, 25.0, 26.0, 100.0], "double", percents.level("x", F.lit(100.0))) == [0, 1, 1, 2, 4]
    assert values(spark, [0.0], "double", percents.level("x", F.lit(0.0))) == [0]


def test_days_and_cells(spark):
    at = datetime(2024, 1, 30, 23, 30)
    assert values(spark, [at], "timestamp_ntz", moments.repaired_day("x")) == [date(2024, 1, 31)]
    assert values(spark, [at], "timestamp_ntz", moments.cell_start(moments.cell("x", 3600), 3600)) == [datetime(2024, 1, 30, 23)]
    assert values(spark, [at], "timestamp_ntz", moments.shifted("x", -1800.0)) == [datetime(2024, 1, 30, 23)]


def test_saturating_sums(spark):
    df = spark.createDataFrame([(1, pricing.MOST, None), (1, 5, 3), (2, 1, 2), (2, 0, None), (3, 4, None)], "k int, n long, c long")
    rows = {r["k"]: (r["n"], r["c"]) for r in df.groupBy("k").agg(pricing.saturating_sum("n").alias("n"), pricing.optional_cost("c", "n").alias("c")).collect()}
    assert rows == {1: (pricing.MOST, None), 2: (1, 2), 3: (4, None)}


def test_name_keys(spark):
    assert values(spark, ["  Big   Model 3.5! ", "Élan"], "string", pricing.name_key("x")) == ["big-model-3.5", "élan"]


def test_residuals_in_three_branches(spark):
    rows = [("a", 0, 60, 100, 0, 9), ("a", 1, 20, 100, 0, 9), ("b", 0, 60, 100, 1, 9), ("b", 1, None, 100, 3, 9), ("b", 2, None, 100, 0, 9), ("c", 0, None, 10, 0, 9), ("c", 1, None, 10, 0, 9), ("c", 2, None, 10, 0, 9), ("d", 0, None, None, 5, 9), ("d", 1, 4, None, 5, 9), ("e", 0, 60, 50, 1, 9)]
    df = spark.createDataFrame(rows, "turn_id string, pos int, row_cost_nd long, turn_cost_nd long, tokens long, table_cost_nd long")
    found = {(r["turn_id"], r["pos"]): (r["cost_nd"], r["by_table"]) for r in pricing.residual_costs(df).collect()}
    assert found[("a", 0)] == (80, False) and found[("a", 1)] == (20, False)
    assert found[("b", 0)][0] == 60 and found[("b", 1)][0] == 40 and found[("b", 2)][0] == 0
    assert sorted(found[("c", i)][0] for i in range(3)) == [3, 3, 4]
    assert found[("d", 0)] == (9, True) and found[("d", 1)] == (4, False) and found[("e", 0)] == (60, False)


def test_residuals_sort_a_turns_rows_once(spark):
    rows = [("a", 0, 60, 200, 0, 9), ("a", 1, 60, 200, 0, 9), ("a", 2, 20, 200, 0, 9), ("b", 2, None, 101, 1, 9), ("b", 1, None, 101, 1, 9), ("b", 0, 1, 101, 1, 9)]
    df = spark.createDataFrame(rows, "turn_id string, pos int, row_cost_nd long, turn_cost_nd long, tokens long, table_cost_nd long")
    out = pricing.residual_costs(df)
    assert {(r["turn_id"], r["pos"]): r["cost_nd"] for r in out.collect()} == {("a", 0): 120, ("a", 1): 60, ("a", 2): 20, ("b", 0): 1, ("b", 1): 50, ("b", 2): 50}
    plan = out._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Sort [") == 1 and plan.count("Exchange ") == 1


def test_dealt_rows_bound_a_task(spark):
    few, many = (frames.dealt(spark.range(n).withColumn("k", F.col("id") % 997), ["k"], rows=1000) for n in (2_000, 20_000))
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (4, 20) and many.count() == 20_000
    plan = many.groupBy("k", "id").agg(F.min_by(F.struct("id"), "id"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_engine_answers_for_any_provider(spark, sf):
    from tallyspark.engine import Engine
    from tallyspark.plans import binding as b
    from tallyspark.plans.registry import QUERIES

    records = b.records(spark, sf)
    engine = Engine(records.unionByName(records.withColumn("seq", F.col("seq") + 10**9)), b.chat_events(spark, sf))
    now = b.now(spark, sf)
    found = engine.breakdown(now)
    assert found["today"].first()["cost_nd"] == QUERIES["today"](spark, sf).first()["cost_nd"]
    assert found["projects_week"].count() == 7 and found["daily"].count() == 30
    assert engine.usage(datetime(2024, 1, 1), now).filter("part = 'all'").first()["turns"] == b.turns(spark, sf).count()
    chats = engine.sessions(F.lit(date(2024, 1, 24)), F.lit(date(2024, 1, 30)))
    assert chats.count() == QUERIES["chat_summaries"](spark, sf).count()
    assert engine.turn_costs(now, now).count() == 1


def test_reset_texts(spark):
    from tallyspark.functions.moments import moment
    from tallyspark.functions.text import countdown_text, reset_texts

    now = datetime(2024, 9, 4, 10, 0)  # a Wednesday
    cases = [(now, "now", "resets now"), (datetime(2024, 9, 4, 10, 45), "in 45m", "resets in 45m"), (datetime(2024, 9, 4, 11, 0), "in 1h 0m", "resets in 1h 0m"), (datetime(2024, 9, 4, 11, 10), "in 1h 10m", "resets in 1h 10m (11:10)"),
             (datetime(2024, 9, 5, 14, 15), "in 1d 4h", "resets in 1d 4h (Thu 14:15)"), (datetime(2024, 9, 14, 14, 15), "in 10d 4h", "resets in 10d 4h (Sep 14, 14:15)"), (None, None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, at timestamp_ntz")
    found = df.select("i", *(c.alias(n) for n, c in reset_texts("at", moment(now)).items())).orderBy("i").collect()
    assert [(r["relative"], r["both"]) for r in found] == [c[1:] for c in cases]
    assert [r[0] for r in spark.createDataFrame([(-5.0,), (59.9,), (86_400.0,), (89_999.0,), (90_000.0,)], "s double").select(countdown_text("s")).collect()] == ["0m", "0m", "24h 0m", "24h 59m", "1d 1h"]
