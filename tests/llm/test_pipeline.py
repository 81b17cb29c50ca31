"""The pipeline's stages: what each keeps, and what all of them give on planted documents."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.fixtures import SCHEMA, awkward, docs_table


def test_stages_on_the_corpus(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for i, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        assert out.columns == columns or i == len(cp.STAGES) - 1, name
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        counts.append(docs.count())
    assert len(cp.STAGES) == 5 and all(a >= b for a, b in zip(counts, counts[1:], strict=False)) and counts[-1] > 0.7 * counts[0]
    run = cp.run(spark, sf)
    assert sorted(map(tuple, run.select("doc_id", "copies", "taken").collect())) == sorted(map(tuple, docs.select("doc_id", "copies", "taken").collect()))


def planted(spark, tmp_path):
    rng = random.Random(9)
    corpus = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars between 300 and 3000").orderBy("doc_id").limit(60).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], len(r["text"])) for r in corpus]
    line = "The very same boilerplate sentence stands at the end of all of these pages."
    fresh = lambda k: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(k))
    base, item = fresh(200), fresh(40)
    rows += [(10_000 + i, base, "en", "x", len(base)) for i in range(3)]
    rows += [(10_010, fresh(50) + " " + item + " " + fresh(50), "en", "x", 9), (10_020, "12345 67890", "en", "x", 11), (10_021, None, "en", "x", None)]
    rows += [(10_030 + i, fresh(60) + "\n" + line, "en", "x", 9) for i in range(6)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, fresh(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return {r[0] for r in rows}, line


def test_planted_documents(spark, tmp_path):
    ids, line = planted(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    known = cp.identify_language(spark, docs, str(tmp_path))
    assert ids - {r[0] for r in known.select("doc_id").collect()} >= {10_020, 10_021}
    lines = cp.drop_repeated_lines(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in lines.filter(F.col("text").contains(line)).collect()} == {10_035}
    assert lines.filter("doc_id = 10030 and n_chars = length(text)").count() == 1
    one = cp.keep_one_of_near_copies(spark, docs, str(tmp_path))
    left = {r[0] for r in one.select("doc_id").collect()}
    assert 10_000 in left and not {10_001, 10_002} & left
    clean = cp.decontaminate(spark, docs, str(tmp_path))
    assert ids - {r[0] for r in clean.select("doc_id").collect()} == {10_010}
    final = {r["doc_id"]: r for r in cp.run(spark, str(tmp_path)).collect()}
    assert {10_000} | {10_030 + i for i in range(6)} <= set(final) and not {10_001, 10_002, 10_010, 10_020, 10_021} & set(final)


def test_awkward_and_empty_tables(spark, tmp_path):
    docs_table(spark, awkward()).write.parquet(f"{tmp_path}/a/documents.parquet")
    docs_table(spark, []).write.parquet(f"{tmp_path}/b/documents.parquet")
    for d in "ab":
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{d}/benchmark.parquet")
    assert cp.run(spark, f"{tmp_path}/b").count() == 0
    found = cp.run(spark, f"{tmp_path}/a")
    assert found.filter("doc_id is null").count() == 1 and found.filter("doc_id = 1000").count() == 1 and found.filter("doc_id = 1001").count() == 0


def test_rows_are_told_apart_by_id_and_text(spark, tmp_path):
    rng = random.Random(3)
    a, b, c, d = (" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)) for _ in range(4))
    rows = [(7, a), (8, a), (3, b), (7, b), (None, c), (None, c), (9, d), (9, d), (10, a + " more")]
    docs = docs_table(spark, rows).withColumns({x: F.lit("kept") for x in ("n_lines", "n_dropped", "_key", "component_id")})
    one = cp.keep_one_of_near_copies(spark, docs, str(tmp_path))
    assert sorted(((r["doc_id"], r["text"]) for r in one.collect()), key=str) == sorted([(7, a), (3, b), (None, c), (9, d)], key=str)
    lines = cp.drop_repeated_lines(spark, docs, str(tmp_path))
    for out in (one, lines):
        assert out.columns == docs.columns and out.filter("n_lines <> 'kept' or n_dropped <> 'kept' or _key <> 'kept' or component_id <> 'kept'").count() == 0
