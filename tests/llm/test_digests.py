from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import digests
from tests.llm.fixtures import awkward, docs_table, with_clashes

FLAT = np.arange(digests.LEVELS)


def brute_levels(data: bytes) -> list[int]:
    out = []
    for i in range(len(data) - digests.WINDOW + 1):
        counts = np.bincount(np.frombuffer(data[i : i + digests.WINDOW], np.uint8))
        total = sum(int(round(c * np.log2(c) * digests._SCALE)) for c in counts if c)
        out.append((digests._TOP - total) * (digests.LEVELS - 1) // digests._TOP)
    return out


def test_entropy_levels_equal_a_direct_count():
    rng = random.Random(4)
    data = bytes(rng.choice(b"abcdefgh \n") for _ in range(300)) + b"z" * 80 + bytes(range(200))
    found = digests.levels(np.frombuffer(data, np.uint8))
    assert np.abs(found - np.array(brute_levels(data))).max() <= 1  # rounding of the steps


def test_segments_do_not_matter(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcdefgh ijklmn\n") for _ in range(n)) for n in (0, 10, 64, 500, 5000, 20_000)]
    rank = digests.ranks(digests.histogram(texts))
    whole = digests.digests(texts, rank)
    monkeypatch.setattr(digests, "PASS_BYTES", 777)
    assert (digests.histogram(texts) == digests.histogram(texts)).all()
    cut = digests.digests(texts, rank)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_likeness_orders_edits():
    rng = random.Random(6)
    make = lambda n: bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    a, other = make(9000), make(9000)
    edits = [a, a[:-3000] + other[:3000], a[:-6000] + other[:6000], other]
    rank = digests.ranks(digests.histogram([a, other]))
    filters, chain = digests.digests([a, *edits], rank)
    found = digests.likeness(filters, chain, np.zeros(4, np.int64), np.arange(1, 5))
    assert found[0] == 1.0 and found[3] < 0.1 and list(found) == sorted(found, reverse=True) and found[1] > 0.3
    assert ((found >= 0) & (found <= 1)).all()


def test_edit_study_follows_the_ring(spark):
    rows = [r for r in awkward() if r[0] is None or r[0] < 3000] + [(3002, "é 😀 ß Ünïcode " * 30, "de", "b")]
    df = with_clashes(docs_table(spark, rows))
    found = digests.edit_study(df).collect()
    assert len(found) == len(rows)
    ring = sorted(((i, t or "") for i, t, *_ in rows if i is not None), key=lambda r: -r[0])  # ids are unique here
    expected = {}
    for k, (i, t) in enumerate(ring):
        cut = len(t) // 3
        nxt = ring[(k + 1) % len(ring)][1]
        expected[i] = (len(t), hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest())
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"]) for r in found if r["doc_id"] is not None} == expected
    prints = {}
    for r in found:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    texts = {i: t or "" for i, t, *_ in rows if i is not None}
    for r in found:
        if r["doc_id"] is not None:
            prints.setdefault(texts[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    sole = {r["doc_id"]: r["fingerprint"] for r in digests.fingerprints(df).collect() if r["doc_id"] is not None}
    assert all(sole[r["doc_id"]] == r["fingerprint"] for r in found if r["doc_id"] is not None)


@pytest.mark.parametrize(("parts", "sample"), [(1, 1000), (3, 1000), (40, 1000), (5, 20)])
def test_crowded_ids_and_copies(spark, parts, sample, monkeypatch):
    """Rows of one id follow one another by hash; each row is followed by the next one of the ring, copies by themselves. Ids
    beyond 2^53 that doubles don't tell apart are apart."""
    monkeypatch.setattr(digests, "SAMPLE", sample)
    big = 1 << 60
    rows = [(i, f"text of {i}", "en") for i in range(8)] + [(3, f"other {i}") for i in range(40)] + [(3, "alike")] * 30 + [(6, "alike")] * 9 + [(None, "n")] * 20
    rows += [(big + k % 2, f"big {k}") for k in range(16)] + [(-big - k % 3, f"low {k}") for k in range(9)] + [(2, None), (2, "")]
    df = docs_table(spark, rows)
    inner, lasts = digests.ring(df, parts)
    got = [tuple(r) for r in lasts.collect()]
    for part in inner.rdd.glom().collect():
        got += [(a["doc_id"], a["text"], b["text"]) for a, b in zip(part, part[1:]) if a["part"] == b["part"]]
    hashes = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    ring = sorted(((i, t or "") for i, t, *_ in rows if i is not None), key=lambda r: (-r[0], hashes[r[1]]))
    expected = [(i, t, ring[(k + 1) % len(ring)][1]) for k, (i, t) in enumerate(ring)]
    assert sorted(got) == sorted(expected)
    found = digests.edit_study(df)
    assert found.count() == len(rows) and found.filter("doc_id is null").count() == 20


def plain_digest(text: bytes, rank):
    """The filters of a text's features, in order, as sets of bits."""
    if not text:
        return []
    order = list(digests.features([text], rank)[1])
    filters = []
    for i in range(0, len(order), digests.FEATURES):
        filters.append({(int(h) >> (11 * k)) & (digests.BITS - 1) for h in order[i : i + digests.FEATURES] for k in range(5)})
    return filters


def plain_likeness(f, g):
    """Best normalised overlaps of the digest with fewer filters, weighted by bits; both ways for equally long ones."""
    if not f or not g:
        return float(len(f) == len(g))

    def way(f, g):
        total = 0.0
        for x in f:
            best = 0.0
            for y in g:
                most, chance = min(len(x), len(y)), len(x) * len(y) / digests.BITS
                floor = chance + 0.3 * (most - chance)
                best = max(best, (len(x & y) - floor) / max(most - floor, 1e-9) if most > floor else float(len(x & y) >= most))
            total += best * len(x)
        return min(1.0, total / sum(map(len, f)))

    if len(f) > len(g):
        f, g = g, f
    return (way(f, g) + way(g, f)) / 2 if len(f) == len(g) > 1 else way(f, g)


def test_filters_and_likeness_equal_a_plain_computation():
    rng = random.Random(8)
    make = lambda n: bytes(rng.choice(b"abcdefghijklmnopqrstuvwxyz    \n") for _ in range(n))
    a = make(30_000)
    texts = [b"", b"short", a, a[:20_000] + make(5000), make(30_000), a[:3000], b"z" * 500, a[10_000:] + a[:10_000]]
    rank = digests.ranks(digests.histogram(texts))
    filters, chain = digests.digests(texts, rank)
    plain = [plain_digest(t, rank) for t in texts]
    for i, own in enumerate(plain):
        rows = np.unpackbits(filters[chain[i] : chain[i + 1]], axis=1)
        assert [set(np.flatnonzero(r).tolist()) for r in rows] == own
    left, right = np.array([(i, j) for i in range(8) for j in range(8)]).T
    assert digests.likeness(filters, chain, left, right) == pytest.approx([plain_likeness(plain[i], plain[j]) for i, j in zip(left, right, strict=True)])


def test_one_document_follows_itself(spark):
    text = "alpha beta gamma delta " * 20
    r = digests.edit_study(docs_table(spark, [(7, text)])).first()
    cut = len(text) // 3
    assert r["edited_sha256"] == hashlib.sha256((text[: len(text) - cut] + text[:cut]).encode()).hexdigest() and r["near_next"] == 1.0


def test_empty_table(spark):
    assert digests.edit_study(docs_table(spark, [])).count() == 0 and digests.fingerprints(docs_table(spark, [])).count() == 0


def test_unrelated_and_edited_texts_of_the_corpus(spark, sf):
    found = digests.edit_study(spark.read.parquet(f"{sf}/documents.parquet").filter("n_chars > 800"))
    got = found.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert got[0] > 0.4 and got[0] > got[1] + 0.3


@pytest.mark.parametrize("text", ["", "short", "x" * 63, "x" * 64, "x" * 65])
def test_short_texts(text):
    filters, chain = digests.digests([text.encode(), text.encode()], FLAT)
    assert digests.likeness(filters, chain, np.array([0]), np.array([1]))[0] == 1.0
