from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import mixing
from tests.llm.fixtures import awkward, docs_table, with_clashes


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Each source's target, by a plain loop."""
    names = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] >= most * sizes[s] * whole]
        if not full:
            return out | {s: left * weight[s] / whole for s in open_}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def found_targets(spark, sizes):
    rows = spark.createDataFrame([(s, x, 1) for s, x in sizes.items()], "source string, source_size long, n long").repartition(3)
    return {r["source"]: r["target"] for r in mixing.source_targets(rows).collect()}


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = {"a": 100, "b": 1000, "c": 10, None: 500}
    found = found_targets(spark, sizes)
    assert sum(found.values()) == pytest.approx(1.5 * 1610)
    assert all(found[s] <= 2 * sizes[s] + 1e-9 for s in sizes) and found["a"] == 200 and found["c"] == 20
    # what is open shares the rest by weight: b weighs 2, the null source is the last one and weighs 5
    assert found[None] == 1000 and found["b"] == pytest.approx(1.5 * 1610 - 1220)
    assert found_targets(spark, {}) == {} and found_targets(spark, {"z": 0}) == {"z": 0.0}
    rng = np.random.default_rng(8)
    many = {f"h{i:03d}é"[: rng.integers(2, 6)] + str(i): int(rng.pareto(1) * 100) for i in range(300)} | {None: 77, "": 5, "Z": 9, "\U0001f600": 1000, "\uffee": 900}
    assert found_targets(spark, many) == pytest.approx(targets(many))


def test_landing_keeps_the_probabilities():
    rng = np.random.default_rng(4)
    for q in (1, 2, 5, 9):
        p, size = rng.random(q), rng.integers(1, 2000, q).astype(float)
        choice = (np.arange(1 << q)[:, None] >> np.arange(q)) & 1
        cost = np.abs((choice - p) @ size)
        found = mixing.design(p, cost)
        assert found @ choice == pytest.approx(p) and found.sum() == pytest.approx(1) and (found >= 0).all()
        assert (found > 0).sum() <= q + 1
        alone = np.prod(np.where(choice, p, 1 - p), axis=1)  # each document by itself
        assert found @ cost <= alone @ cost + 1e-9
    taken = np.zeros(8)
    p, size = np.full(8, 0.3), rng.integers(1, 500, 8).astype(float)
    for i in range(600):
        own = p.copy()
        mixing.land(own, size, np.random.default_rng(i))
        taken += own
    assert taken / 600 == pytest.approx(p, abs=0.07)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(1)
    p, size = rng.random(400), rng.integers(1, 5000, 400).astype(float)
    before = (p.sum(), p @ size)
    mixing.flight(p, size, rng)
    assert (p.sum(), p @ size) == pytest.approx(before) and ((p > 0) & (p < 1)).sum() <= 2
    q = np.full(50, 0.3)
    mixing.flight(q, np.full(50, 7.0), rng)
    assert q.sum() == pytest.approx(15.0)


@pytest.mark.parametrize("block", [1024, 16])
def test_mix_meets_its_targets(spark, sf, block):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    found = mixing.mix(df, block=block).collect()
    rows = df.collect()
    assert len(found) == len(rows)
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows}
    sources = {}
    for r in found:
        assert r["size"] == size[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        sources.setdefault(r["source"], []).append(r)
    goal = targets({s: sum(r["size"] for r in rs) for s, rs in sources.items()})
    for s, rs in sources.items():
        assert {r["target"] for r in rs} == {goal[s]} and {r["source_size"] for r in rs} == {sum(r["size"] for r in rs)}
        assert sum(r["taken"] for r in rs) == pytest.approx(goal[s], rel=0.02, abs=30)
    again = mixing.mix(df.repartition(7), block=block).collect()
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in found}


def test_awkward_rows(spark):
    rows = awkward()
    found = mixing.mix(with_clashes(docs_table(spark, rows))).collect()
    assert len(found) == len(rows)
    assert all(r["taken"] == 0 for r in found if r["size"] == 0) and {r["source"] for r in found} == {"a", "b", None}
    for s in ("a", "b", None):
        own = [r for r in found if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.05)
    assert mixing.mix(docs_table(spark, [])).count() == 0


def test_a_row_repeated_often_is_dealt_out(spark):
    df = docs_table(spark, [(1, "a b c", "en", "x")]).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(9000)))).drop("k")
    found = mixing.mix(df.union(docs_table(spark, [(2, "a b", "en", "y"), (3, "c", "en", "z")])))
    one = found.filter("doc_id = 1").agg(F.count("*"), F.sum("taken"), F.first("target")).first()
    assert one[0] == 9000 and one[1] == pytest.approx(one[2], rel=0.001)
