from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import language, registry
from tallyspark.llm.base import bounded_sample, fold, passes
from tests.llm.fixtures import CLASHING, awkward, docs_table, with_clashes


def test_held_out_accuracy(spark, sf):
    found = registry.op4_language(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found.count() == docs.count()
    rows = found.join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found.collect())


def test_predictions_read_the_text_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs, fold("doc_id", 4) != 2)
    held = docs.filter(fold("doc_id", 4) == 2)
    plain = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(held, model).collect()}
    other = held.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")}).select("source", "lang", "text", "doc_id", "n_chars")
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(other, model).collect()} == plain


def test_passes_do_not_matter(monkeypatch, spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = __import__("pyarrow").array([r["text"] for r in docs.limit(40).collect()])
    model = language.train(docs, F.lit(True))
    whole = language.predict(model, texts)
    monkeypatch.setattr(language, "passes", lambda o: passes(o, 50))
    cut = language.predict(model, texts)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1])


def test_awkward_rows(spark):
    rows = awkward()
    df = with_clashes(docs_table(spark, rows))
    model = language.train(df, F.lit(True))
    found = language.identify(df, model).collect()
    assert len(found) == len(rows) and {r["lang_pred"] for r in found} <= {"en", "de", "und"}
    und = {r["doc_id"]: r for r in found if r["lang_pred"] == "und"}
    assert set(und) == {2000, 2001, 2002, 2003, None} and all(r["score"] == 0 and r["rejected"] for r in und.values())
    kept = language.keep_known(df, model)
    assert kept.columns == df.columns and kept.filter("doc_id = 2000").count() == 0 and kept.filter(" or ".join(f"{c} <> 'kept'" for c in CLASHING)).count() == 0
    empty = docs_table(spark, [])
    assert language.identify(empty, model).count() == 0
    none = language.train(empty, F.lit(True))
    assert {r["lang_pred"] for r in language.identify(df, none).collect()} == {"und"}


def test_a_doubtful_text_is_rejected(spark):
    rows = [(i, "der die das und ein " * 5, "de") for i in range(40)] + [(100 + i, "the and of to in a " * 5, "en") for i in range(40)]
    model = language.train(docs_table(spark, rows), F.lit(True))
    found = {r["doc_id"]: r for r in language.identify(docs_table(spark, [(1, "und der das"), (2, "zzqx")]), model, reject_below=0.9).collect()}
    assert found[1]["lang_pred"] == "de" and found[2]["rejected"]


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    one = {r[0] for r in bounded_sample(df, "doc_id", 1000).collect()}
    assert 850 < len(one) < 1150 and one == {r[0] for r in bounded_sample(df.repartition(7), "doc_id", 1000).collect()}
    assert bounded_sample(df, "doc_id", 50_000).count() == 20_000
