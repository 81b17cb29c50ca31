from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyspark.llm import simhash
from tallyspark.llm.components import components
from tests.llm.fixtures import awkward, docs_table, with_clashes


def brute_print(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    """prints: list of (doc_id, fingerprint)."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_fingerprints_and_components_equal_brute_force(spark, sf):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), with_clashes(docs_table(spark, awkward()))):
        rows = df.select("doc_id", "text").collect()
        prints = [(r["doc_id"], brute_print(r["text"])) for r in rows]
        expected = sorted((d, f"{p:016x}", c) for (d, p), c in zip(prints, brute_components(prints), strict=True) if d is not None)
        found = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.digest(simhash.near_duplicates(df)).collect() if r["doc_id"] is not None)
        assert found == expected


@pytest.mark.parametrize("at_point", [0, 2, simhash.AT_POINT])
def test_planted_neighbours_are_all_linked(spark, at_point):
    """Chains of one- and two-bit steps around random fingerprints, copies among them."""
    rng = random.Random(2)
    prints = []
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            prints.append(p)
            for _ in range(rng.randrange(0, 4)):
                p ^= 1 << rng.randrange(64)
    prints += [0, 0, 1, (1 << 64) - 1]
    prints += [sum((1 + (i >> k & 1)) << 2 * k for k in range(32)) for i in range(200)]  # many in one cell
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in set(signed)], "fingerprint long").withColumn("cell", simhash.cell("fingerprint"))
    found = {r["node"]: r["root"] for r in components(simhash.links(df, at_point)).collect()}
    distinct = sorted(set(signed))
    groups = brute_components([(i, p % (1 << 64)) for i, p in enumerate(distinct)])
    pairs = {(a, b) for a in range(len(distinct)) for b in range(a) if groups[a] == groups[b]}
    got = {(a, b) for a in range(len(distinct)) for b in range(a) if found.get(distinct[a], ("x", a)) == found.get(distinct[b], ("x", b))}
    assert got == pairs


def test_links_come_from_the_grid(spark, monkeypatch):
    df = spark.createDataFrame([(p,) for p in (0, 1, 3, 7, 5, 1 << 40)], "fingerprint long").withColumn("cell", simhash.cell("fingerprint"))
    assert simhash.links(df).count() > 0
    monkeypatch.setattr(simhash, "around", lambda point: F.array(F.lit(-1).cast("long") - F.col(point)))
    assert simhash.links(df).count() == 0


def test_distance_is_a_lower_bound(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randrange(0, 5)):
            b ^= 1 << rng.randrange(64)
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", simhash.cell("a").alias("x"), simhash.cell("b").alias("y"))
    for r in df.collect():
        counts = lambda c: [(c % (1 << 64)) >> (2 * i) & 3 for i in range(32)]
        bits = lambda p: [((p % (1 << 64)) >> (2 * i) & 3).bit_count() for i in range(32)]
        assert counts(r["x"]) == bits(r["a"])
        assert sum(abs(i - j) for i, j in zip(counts(r["x"]), counts(r["y"]), strict=True)) <= ((r["a"] ^ r["b"]) % (1 << 64)).bit_count()


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(5, 5), (7, None)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {found[i] for i in range(201)} == {0} and {found[i] for i in range(1000, 1300)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_table(spark, [])).count() == 0
    assert simhash.near_duplicates(docs_table(spark, [(None, None), (4, "")])).filter(F.col("component_id") == 4).count() == 2
