from __future__ import annotations

import random

import pytest

from tallyspark.llm import decontam
from tests.llm.fixtures import WORDS, awkward, docs_table, with_clashes


def words(text):
    import regex

    return regex.sub(r"[^\p{L}\p{N}\p{M}]+", " ", (text or "").lower()).split()


def shingles(text, n=5):
    w = words(text)
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {" ".join(w)} if w else set()


def brute(docs, items):
    by_doc, by_item = {}, {}
    for d, t in docs:
        if d is not None and t is not None:
            by_doc.setdefault(d, set()).update(*({" ".join(words(t)[i : i + k]) for i in range(len(words(t)) - k + 1)} for k in range(1, 6)))
    for i, t in items:
        if i is not None:
            by_item.setdefault(i, set()).update(shingles(t))
    out = set()
    for d, s in by_doc.items():
        for i, x in by_item.items():
            shared = len(s & x)
            if x and shared >= -(-len(x) * 4 // 5) and shared:
                out.add((d, i, len(x), shared))
    return out


def test_equals_brute_force_on_planted_passages(spark):
    rng = random.Random(3)
    text = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    items = [(i, text(rng.randrange(1, 90))) for i in range(40)] + [(41, ""), (42, None), (None, text(20)), (43, "one two"), (44, "É! à-b C;d e"), (45, "lonely"), (46, "stock words that all items share"), (47, "stock words that all items share")]
    docs = [(i, text(rng.randrange(1, 200))) for i in range(60)]
    for j in range(120):  # items whole, cut short, or with changed words, within other text
        w = (rng.choice(items[:40])[1]).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = rng.choice([*WORDS, "Changed,"])
        w = w[: rng.randrange(max(1, len(w) * 3 // 4), len(w) + 1)]
        docs.append((1000 + j, f"{text(rng.randrange(0, 60))}. {' '.join(w).upper()}\n{text(rng.randrange(0, 60))}"))
    docs += [(2000, "One, TWO"), (2001, "xx é à b c d e yy"), (2002, text(90) + " one: two " + text(90)), (2003, text(20) + " lonely"), (2004, "so stock words that all items share end")]
    docs += [(r[0], r[1]) for r in awkward()]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.contained(with_clashes(docs_table(spark, docs)), benchmark.withColumn("words", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("kept"))).collect()
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in found} == brute(docs, items)
    assert len(found) > 30 and all(r["containment"] == pytest.approx(r["n_shared"] / r["n_item"]) for r in found)
    assert {2002, 2003, 2004} <= {r["doc_id"] for r in found}
    # each row by its own text, whatever its id
    kept = [(r["doc_id"], r["text"]) for r in decontam.clean(docs_table(spark, docs), benchmark).collect()]
    bad = {i for i, *_ in brute(list(enumerate(t for _, t in docs)), items)}
    assert sorted(kept, key=str) == sorted((r for i, r in enumerate(docs) if i not in bad), key=str)
    nameless = docs_table(spark, [(None, f"{text(9)} {items[3][1]}"), (None, text(4)), (5, text(4)), (5, f"ah one two {text(3)}")])
    assert decontam.clean(with_clashes(nameless), benchmark.filter("item_id in (3, 43)")).count() == 2


def test_corpus_equals_its_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    found = decontam.contained(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert sorted(tuple(r)[:4] for r in found.collect()) == sorted(r[:4] for r in con.execute(decontam.ORACLE).fetchall())


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contained(docs_table(spark, awkward()), items).count() == 0
    assert decontam.contained(docs_table(spark, []), items).count() == 0
    assert decontam.clean(docs_table(spark, awkward()), items).count() == len(awkward())


def test_plan_has_no_python(spark, sf):
    plan = decontam.contained(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
