"""Near copies against all pairs in Python, and through the pipeline's stage."""

from __future__ import annotations

import random

import corpus_pipeline as cp
from tallyspark.llm import nearcopies
from tests.llm.fixtures import awkward, docs_table


def shingle_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least doc_id of each row's component, of rows (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(rows))]


def planted(seed=4):
    """Families of near copies, around a similarity of 0.8 and chained, and texts with one long passage in common."""
    rng = random.Random(seed)
    fresh = lambda k: ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8))) for _ in range(k)]
    texts = []
    for _ in range(30):
        words = fresh(rng.randrange(3, 150))
        for _ in range(rng.randrange(1, 7)):
            texts.append(" ".join(words))
            for _ in range(rng.randrange(0, 4)):
                words = [*words]
                words[rng.randrange(len(words))] = fresh(1)[0]
    passage = fresh(60)
    texts += [" ".join(fresh(rng.randrange(1, 60)) + passage) for _ in range(150)]
    hot = fresh(100)
    texts += [" ".join(hot[:i] + fresh(1) + hot[i + 1 :]) for i in range(100)]
    rng.shuffle(texts)
    return [*enumerate(texts)]


def test_components_equal_all_pairs(spark, monkeypatch):
    for one_in in (1, 16):
        monkeypatch.setattr(nearcopies, "ONE_IN", one_in)
        for rows in (planted(), [(r[0], r[1]) for r in awkward()]):
            expected = sorted(((d, c) for (d, _), c in zip(rows, brute(rows), strict=True) if d is not None), key=str)
            found = nearcopies.near_copies(docs_table(spark, rows)).filter("doc_id is not null").collect()
            assert sorted(((r["doc_id"], r["component_id"]) for r in found), key=str) == expected


def test_stage_leaves_no_near_copy(spark, tmp_path):
    rows = planted(7)
    left = {r["doc_id"] for r in cp.keep_one_of_near_copies(spark, docs_table(spark, rows), str(tmp_path)).collect()}
    assert left == set(brute(rows))
    kept = [shingle_set(t) for d, t in rows if d in left]
    assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(kept) for b in kept[:i])


def test_empty_table(spark):
    assert nearcopies.near_copies(docs_table(spark, [])).count() == 0
    assert nearcopies.near_copies(docs_table(spark, [(None, None), (4, "")])).filter("component_id = 4").count() == 2
