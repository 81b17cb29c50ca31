"""Quality and toxicity: held-out accuracy, exact neighbours, awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import quality, registry, toxicity
from tallyspark.llm.tokens import hashed_tokens
from tests.llm.fixtures import awkward, docs_table, with_clashes

MORE = "/root/testdata/sf0.01"


def auc(rows):
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


@pytest.mark.parametrize(("name", "column", "least"), [("op7_quality", "quality", 0.9), ("op10_toxicity", "toxic", 0.85)])
def test_held_out_ranking(spark, name, column, least):
    found = registry.QUERIES[name](spark, MORE)
    labels = spark.read.parquet(f"{MORE}/labels.parquet")
    assert found.count() == spark.read.parquet(f"{MORE}/documents.parquet").count()
    rows = found.join(labels, "doc_id").filter(f"held_out and {column} is not null").select("score", column, "predicted").collect()
    assert auc([(r[0], r[1]) for r in rows]) > least
    assert np.mean([r[1] == r[2] for r in rows]) > 0.9


def test_hashed_tokens_know_their_texts():
    texts = [b"Ab, cd", b"", b"ab", b"  ", b"x" * 100]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    bucket, first = hashed_tokens(data, offsets, 12)
    assert np.diff(first).tolist() == [3, 0, 1, 0, 1] and bucket[0] == bucket[3]


def test_context_vectors_equal_a_direct_count(spark):
    rows = [(1, "a b c a"), (2, "b, c"), (3, None), (4, "")]
    index = quality.index_vectors().astype(float)
    expected = np.zeros((1 << quality.BITS, quality.DIM))
    for _, t in rows:
        data = (t or "").encode()
        bucket, _ = hashed_tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]), quality.BITS)
        for i, x in enumerate(bucket):
            for j in range(max(0, i - quality.REACH), min(len(bucket), i + quality.REACH + 1)):
                if i != j:
                    expected[x] += index[bucket[j]]
    assert (quality.context_vectors(docs_table(spark, rows)) == expected).all()


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_awkward_rows(spark):
    rows = awkward()
    df = with_clashes(docs_table(spark, rows))
    marks = labels(spark, [(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(1, 0, 1), (2, None, None), (None, 1, 1), (3, 7, 9)]).withColumn("score", F.lit("kept"))
    for score in (quality.quality, toxicity.toxicity):
        found = score(df, marks, F.lit(True)).collect()
        assert len(found) == len(rows) and all(0 <= r["score"] <= 1 for r in found)
        assert score(docs_table(spark, []), marks, F.lit(True)).count() == 0
        assert len({r["score"] for r in score(df, marks.limit(0), F.lit(True)).collect()}) == 1


def test_nearest_examples_equal_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 32)
    monkeypatch.setattr(toxicity, "COMMON", 8)
    rng = np.random.default_rng(2)
    idf = rng.random(40) * 5 + 1
    rows = []
    for i in range(700):
        terms = np.sort(rng.choice(40, rng.integers(0, 6), replace=False))
        rows.append((i, float(rng.random() < 0.3), *toxicity.unit(terms, rng.integers(1, 9, len(terms)), idf)))
    index = toxicity.Index.build(rows, idf, np.arange(40) < 5)
    dense = {}
    for i, _, t, w in rows:
        if len(t):
            dense[i] = np.zeros(40)
            dense[i][t] = w
    for i in list(dense)[:150]:
        (cosine, place), = index.nearest([rows[i][2:]], without=np.flatnonzero(index.ids == i))
        every = sorted((-round(float(v @ dense[i]), 9), j) for j, v in dense.items() if j != i and v @ dense[i] > 0)[: toxicity.NEIGHBOURS]
        assert index.ids[place].tolist() == [j for _, j in every] and cosine == pytest.approx([-c for c, _ in every], abs=1e-8)


def test_cosines_are_those_of_the_whole_texts(spark):
    """Cosines against TF-IDF vectors written out in Python: no term is left out, whether or not an example has it."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(300)], rng.integers(1, 60))) for _ in range(80)] + ["only here", "", None]
    texts += ["w1 w2 " + " ".join(f"new{i}" for i in range(100)), "w1 w2"]
    rows = list(enumerate(texts))
    marks = labels(spark, [(i, 1, int(i % 5 == 0)) for i in range(60)])
    scorer, telling = toxicity.learn(docs_table(spark, rows), marks, F.lit(True))
    words = [toxicity.words_of(t) for t in texts]
    df = {w: sum(w in x for x in map(set, words)) for x in words for w in x}
    known = {w for x in words[:60] for w in x}
    assert len(scorer.vocabulary) == len(known) and not telling
    n = len(rows)
    vector = lambda x: {w: (1 + np.log(x.count(w))) * (np.log((n + 1) / ((df[w] if w in known else 1) + 1)) + 1) for w in set(x)}
    cosine = lambda a, b: sum(v * b.get(w, 0) for w, v in a.items()) / max(1e-9, np.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())))
    count = toxicity.term_counter(telling)
    for i in range(n):
        every = sorted((-round(cosine(vector(words[i]), vector(words[j])), 6), j) for j in range(60))[:15]
        terms, counts = count(texts[i])
        at, there = toxicity.placed(terms, scorer.vocabulary)
        ((found, place),) = scorer.index.nearest([toxicity.unit(at[there], counts[there], scorer.idf, counts[~there], scorer.largest)])
        assert found == pytest.approx([-c for c, _ in every if c < 0], abs=2e-6)
        _, evidence = scorer([(terms, counts)])[0]
        assert evidence == scorer.index.ids[place].tolist()
        assert evidence == [j for c, j in every if c < 0] or [round(cosine(vector(words[i]), vector(words[j])), 5) for j in evidence] == [round(-c, 5) for c, j in every if c < 0]


def test_calibration_sees_examples_as_other_texts_are_seen(spark):
    """An example's terms that no other example has are unknown where it is scored without itself."""
    rows = [(i, f"shared common own{i} mine{i} " + ("vile" if i % 2 else "fine")) for i in range(40)]
    marks = labels(spark, [(i, 1, i % 2) for i in range(30)])
    scorer, telling = toxicity.learn(docs_table(spark, rows), marks, F.lit(True))
    seen = []
    keep = toxicity.Scorer.seen
    toxicity.Scorer.seen = lambda self, cosine, place: seen.append(cosine[0]) or keep(self, cosine, place)
    try:
        count = toxicity.term_counter(telling)
        rows_ = toxicity.example_terms(toxicity.examples_of(docs_table(spark, rows), spark.createDataFrame([(i, float(i % 2)) for i in range(30)], "doc_id long, y double")), telling)
        toxicity.fit(rows_, scorer.vocabulary, scorer.idf, np.isin(scorer.vocabulary, [toxicity.digest_of(t) for t in telling]), scorer.largest)
        fitted, seen[:] = list(seen), []
        scorer([count(t) for _, t in rows[30:]])
    finally:
        toxicity.Scorer.seen = keep
    assert len(fitted) == 30 and max(fitted) == pytest.approx(max(seen), abs=0.02) and min(fitted) == pytest.approx(min(seen), abs=0.02)


def test_terms_found_densely_count(spark):
    """A stem that long clean texts hold once marks the short texts that are full of it."""
    rng = np.random.default_rng(4)
    clean = [f"w{i}" for i in range(400)]
    text = lambda n, extra: " ".join(rng.permutation([*rng.choice(clean, n), *extra]))
    rows, marks = [], []
    for i in range(240):
        toxic = i % 4 == 0
        rows.append((i, text(120, [f"vile{rng.integers(900)}" for _ in range(5)]) if toxic else text(900, ["vilenice"] if i % 3 else [])))
        marks.append((i, 1, int(toxic)))
    found = toxicity.toxicity(docs_table(spark, rows), labels(spark, marks), F.col("doc_id") % 3 != 1).collect()
    held = [r for r in found if r["doc_id"] % 3 == 1]
    assert np.mean([(r["score"] >= 0.7) == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(r["evidence"] for r in held if r["doc_id"] % 4 == 0)
