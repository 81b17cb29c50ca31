"""The ledger against full recounts: batches in any order, failures between commits, folded days."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from tallyspark.operators.dedup import later_readings
from tallyspark.schema import TURNS
from tallyspark.streaming import ledger
from tallyspark.streaming.ledger import Ledger

START = datetime(2024, 3, 1)


def record(i, seq, output, day=0, chat="c1", agent=None, model="m"):
    return ("p", i, seq, START + timedelta(days=day, seconds=seq), model, 10, output, 1, None, 3, 0, "proj", chat, agent, None, None, None)


def table(spark, rows):
    return spark.createDataFrame(rows, TURNS)


def recount(spark, rows):
    turns = later_readings(table(spark, rows))
    return sums(ledger._sums(turns.selectExpr("*", "1 as turns")))


def sums(df):
    return sorted((tuple(r) for r in df.select(ledger._TOTAL.names).collect()), key=str)


def history(n, seed=1):
    """Records whose ids come again: later with more or less output, earlier with another chat, on another day."""
    rng = random.Random(seed)
    return [record(f"id{rng.randrange(n // 3)}" if rng.random() < 0.9 else None, s, rng.randrange(1, 60), rng.randrange(5), f"c{rng.randrange(4)}", rng.choice([None, "a"]), rng.choice(["m", "n"])) for s in range(n)]


def test_ten_batches_equal_a_recount(spark, tmp_path):
    rows = history(120)
    random.Random(2).shuffle(rows)
    kept = Ledger(spark, str(tmp_path), buckets=4)
    for i in range(10):
        kept.apply(table(spark, rows[12 * i : 12 * i + 12]), "s", i)
        if i in (0, 4, 9):
            assert sums(kept.totals()) == recount(spark, rows[: 12 * i + 12])
    turns = later_readings(table(spark, rows))
    assert sorted(map(tuple, kept.turns().select(turns.columns).collect()), key=str) == sorted(map(tuple, turns.collect()), key=str)


def test_a_batch_touches_its_parts_only(spark, tmp_path):
    kept = Ledger(spark, str(tmp_path), buckets=16)
    kept.apply(table(spark, [record(f"id{i}", i, 5, i % 3) for i in range(60)]), "s", 0)
    before = kept.manifest()
    assert set(before["parts"]["totals"]) == {"2024-03-01", "2024-03-02", "2024-03-03"} and len(before["parts"]["turns"]) > 8
    kept.apply(table(spark, [record("id4", 100, 50, 0)]), "s", 1)
    after = kept.manifest()
    changed = {t: [p for p, g in parts.items() if before["parts"][t].get(p) != g] for t, parts in after["parts"].items()}
    assert changed["totals"] == ["2024-03-02"] and len(changed["turns"]) == 1  # the later reading counts on the first one's day
    assert {r.output for r in kept.turns().filter("msg_id = 'id4'").collect()} == {50}
    # what was replaced goes with the commit after the next reader's
    old = tmp_path / "totals" / "generation=1" / "part=2024-03-02"
    assert old.exists()
    kept.apply(table(spark, [record("id5", 101, 50, 0)]), "s", 2)
    assert not old.exists() and sorted(f.name for f in (tmp_path / "manifests").iterdir() if not f.name.startswith(".")) == ["2", "3"]


def test_failures_and_replays(spark, tmp_path, monkeypatch):
    rows = history(60, seed=3)
    kept = Ledger(spark, str(tmp_path), buckets=3)
    kept.apply(table(spark, rows[:30]), "s", 0)
    # fails after its files are written, before its manifest is
    with monkeypatch.context() as broken:
        broken.setattr(ledger.files, "put_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            kept.apply(table(spark, rows[30:45]), "s", 1)
    assert sums(kept.totals()) == recount(spark, rows[:30])
    kept.apply(table(spark, rows[30:]), "s", 1)
    kept.apply(table(spark, rows[30:]), "s", 1)  # its end was lost on the stream
    assert sums(kept.totals()) == recount(spark, rows)
    # another stream begins at batch 0 and adds
    more = history(20, seed=4)
    kept.apply(table(spark, more), "t", 0)
    both = [*rows, *more]
    assert sums(kept.totals()) == recount(spark, both) and kept.manifest()["applied"] == {"s": 1, "t": 0}
    kept.apply(table(spark, []), "t", 1)
    assert sums(kept.totals()) == recount(spark, both) and kept.manifest()["applied"]["t"] == 1


def test_folded_days_keep_their_totals(spark, tmp_path):
    rows = [record(f"id{i}", i, 5 + i, i % 4, f"c{i % 2}") for i in range(40)]
    kept = Ledger(spark, str(tmp_path), buckets=3)
    kept.apply(table(spark, rows), "s", 0)
    whole = sums(kept.totals())
    kept.fold(date(2024, 3, 3))
    assert sums(kept.totals()) == whole and {r.ts.day for r in kept.turns().collect()} == {3, 4}
    kept.fold(date(2024, 3, 2))  # earlier than what is folded: nothing to do
    assert kept.manifest()["folded"] == "2024-03-03"
    # a replay of folded records changes nothing, a later reading of a day that is kept does
    kept.apply(table(spark, [rows[0], rows[1], record("id2", 90, 500, 2)]), "s", 1)
    changed = [r for r in sums(kept.totals()) if r not in whole]
    assert [(r[0].day, r[3]) for r in changed] == [(3, "c0")]
    # a folded day read again replaces its own totals; a day with detail replaces both
    before = kept.manifest()["parts"]
    kept.replace_day(date(2024, 3, 1), table(spark, [*rows, record("new", 91, 7, 0, "c9")]))
    assert sums(kept.totals().filter("day = '2024-03-01'")) == recount(spark, [r for r in [*rows, record("new", 91, 7, 0, "c9")] if r[3].day == 1])
    assert {p: g for p, g in kept.manifest()["parts"]["totals"].items() if p != "2024-03-01"} == {p: g for p, g in before["totals"].items() if p != "2024-03-01"}
    assert kept.manifest()["parts"]["turns"] == before["turns"]
    kept.replace_day(date(2024, 3, 4), table(spark, [record("id3", 3, 1, 3)]))
    assert sums(kept.totals().filter("day = '2024-03-04'")) == recount(spark, [record("id3", 3, 1, 3)]) and {r.msg_id for r in kept.turns().filter("ts >= '2024-03-04'").collect()} == {"id3"}
    kept.replace_day(date(2024, 3, 4), table(spark, []))
    assert kept.totals().filter("day = '2024-03-04'").count() == 0 == kept.turns().filter("ts >= '2024-03-04'").count()


def test_an_empty_ledger(spark, tmp_path):
    kept = Ledger(spark, str(tmp_path))
    assert kept.turns().columns == TURNS.names and kept.turns().count() == kept.totals().count() == 0
    kept.fold(date(2024, 1, 1))
    kept.replace_day(date(2024, 1, 2), table(spark, []))
    assert kept.totals().count() == 0


def test_a_merge_shuffles_and_sorts_once(spark, sf):
    from tallyspark.plans import binding as b
    from tallyspark.streaming import ledger

    fresh = ledger._records(b.replays(spark, sf))
    plan = ledger._merged(spark.createDataFrame([], ledger._TURN), fresh)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
