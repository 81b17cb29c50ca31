from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import linededup
from tallyspark.llm.base import free
from tallyspark.llm.linededup import Cuckoo, LineIndex
from tests.llm.fixtures import CLASHING, awkward, docs_table, with_clashes

SPACE = " \t\n\v\f\r"


def brute(rows, min_chars=40, min_docs=5):
    """rows: (doc_id, text) -> list of (doc_id, n_lines, n_dropped, kept)."""
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda line: lower(line.strip(SPACE))
    holders = {}
    for d, t in rows:
        if d is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    holders.setdefault(key(line), set()).add(d)
    gone = {k: max(ds) for k, ds in holders.items() if len(ds) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or not (key(x) in gone and gone[key(x)] != d)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lined(seed=7):
    rng = random.Random(seed)
    common = [f"This line number {i} is said again and again in many places" for i in range(8)] + ["é" * 40, "short line", "x" * 39, "y" * 40]
    rows = []
    for d in range(60):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"only here {d} {i} " + "w" * rng.randrange(60) for i in range(rng.randrange(1, 12))]
        lines = [rng.choice(["", " ", "\t"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "  \r", "\v"]) for x in lines]
        rows.append((d, "\n".join(lines)))
    return rows + [(None, common[0]), (61, None), (62, ""), (63, "\n\n"), (3, common[1]), (3, common[1] + "\n" + common[1])]


def check(spark, df, **options):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    index = LineIndex.build(df, **options)
    cleaned = index.clean(df)
    counts = [free(c, df.columns) for c in ("n_lines", "n_dropped")]
    own = cleaned.select("doc_id", "text", *(F.col(c).alias(n) for c, n in zip(counts, ("n_lines", "n_dropped"), strict=True)))
    found = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.digest(own).collect()), key=str)
    expected = sorted(((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows)), key=str)
    assert found == expected
    return cleaned


def test_equals_brute_force(spark, sf):
    check(spark, spark.read.parquet(f"{sf}/documents.parquet"))
    df = docs_table(spark, lined())
    check(spark, df)
    check(spark, df, shards=1)


def test_sql_equals_brute_force(sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rows = con.execute("select doc_id, text from documents").fetchall()
    expected = sorted((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(rows))
    assert sorted(con.execute(linededup.ORACLE).fetchall()) == expected
    con.execute("drop view documents")
    con.execute("create table documents as select * from (values " + ", ".join("(?, ?)" for _ in lined()[:60]) + ") t(doc_id, text)", [x for r in lined()[:60] for x in r])
    expected = sorted((d, n, g, hashlib.sha256(k.encode()).hexdigest()) for d, n, g, k in brute(lined()[:60]))
    assert sorted(con.execute(linededup.ORACLE).fetchall()) == expected


def test_awkward_rows_and_clashing_columns(spark):
    df = with_clashes(docs_table(spark, [*awkward(), *lined()]))
    cleaned = check(spark, df)
    assert cleaned.filter(" or ".join(f"{c} <> 'kept'" for c in CLASHING)).count() == 0
    assert LineIndex.build(docs_table(spark, [])).clean(docs_table(spark, [])).count() == 0


def test_insertions_and_deletions_are_reversible(spark):
    rows = [r for r in lined() if r[0] is not None]
    half = docs_table(spark, [r for r in rows if r[0] % 2])
    rest = docs_table(spark, [r for r in rows if not r[0] % 2])
    whole = docs_table(spark, rows)

    def state(index):
        """Postings, counts, and what the filters pass."""
        filters = {r["shard"]: Cuckoo(0, np.frombuffer(r["slots"], np.uint16)) for r in index.filters_by_shard().collect()}
        postings = linededup._held(index.postings)
        keys = {(r["h1"], r["h2"]) for r in postings.collect()}
        passed = {k for k in keys if (f := filters.get(k[1] % index.shards)) and f.contains(np.array([k[0]], np.int64).view(np.uint64))[0]}
        slots = {s: int((f.slots > 0).sum()) for s, f in filters.items() if f.slots.any()}
        return sorted(map(tuple, postings.collect())), sorted(map(tuple, index.frequent().collect())), passed, slots

    one = LineIndex.build(half, shards=8)
    both = one.insert(rest)
    assert state(both) == state(LineIndex.build(whole, shards=8))
    assert state(both.delete(rest)) == state(one)
    assert state(both.delete(rest.select("doc_id"))) == state(one)
    assert state(both.delete(half).insert(half)) == state(both)
    assert sorted(map(tuple, both.lost().collect())) == sorted(map(tuple, LineIndex.build(whole).lost().collect()))


def test_a_deletion_takes_out_what_its_insertion_put_in(spark):
    """Rows of one doc_id that hold the same line: each is counted, and lines that others hold stay."""
    a, b, c = (f"line {x} that is long enough to be counted as a key" for x in "abc")
    docs = lambda *rows: docs_table(spark, list(rows))
    state = lambda index: (sorted(map(tuple, linededup._held(index.postings).collect())), sorted(map(tuple, index.frequent().collect())))
    index = LineIndex.build(docs(*((d, a) for d in range(1, 6))), shards=2)
    more = docs((5, f"{a}\n{b}"), (6, a), (6, f"{a}\n{a}"), (None, a), (7, None))
    grown = index.insert(more)
    assert state(grown.delete(more)) == state(index)
    # in parts, in another order, with other insertions between
    parts = [docs((6, f"{a}\n{a}")), docs((5, f"{a}\n{b}")), docs((6, a))]
    shrunk = grown.insert(docs((8, c)))
    for part in parts:
        shrunk = shrunk.delete(part)
    assert state(shrunk.delete(docs((8, c)))) == state(index)
    # what isn't there takes nothing out, now or later
    assert state(index.delete(docs((5, b), (99, a)))) == state(index)
    assert state(index.delete(docs((5, b))).insert(docs((5, b))).delete(docs((5, b)))) == state(index)
    assert state(grown.delete(docs((5, None)).select("doc_id"))) == state(LineIndex.build(docs(*((d, a) for d in range(1, 5)), (6, a), (6, f"{a}\n{a}")), shards=2))


def test_segments_are_put_together(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SEGMENTS", 3)
    line = "one line that is long enough to be counted as a key"
    index = LineIndex.build(docs_table(spark, [(0, line)]), shards=1)
    for d in range(1, 7):
        index = index.insert(docs_table(spark, [(d, line), (0, line)]))
        assert len(index.postings.folders[next(iter(index.postings.folders))]) < 3
    assert sorted((r.doc_id, r.n) for r in linededup._held(index.postings).collect()) == [(0, 7), *((d, 1) for d in range(1, 7))]
    assert [(r.refs, r.holder) for r in index.frequent().collect()] == [(7, 6)]


def test_pairs_are_found_where_halves_agree():
    a, b = np.array([5, 3, 5, 9, 5]), np.array([1, 1, 2, 1, 3])
    x, y = np.array([5, 5, 5, 5, 3, 9, 1, 10]), np.array([3, 1, 2, 4, 1, 2, 1, 1])
    assert linededup._found(a, b, x, y).to_pylist() == [4, 0, 2, None, 1, None, None, None]


def test_an_update_leaves_other_shards_alone(spark):
    rows = [r for r in lined() if r[0] is not None]
    index = LineIndex.build(docs_table(spark, rows), shards=32)
    some = docs_table(spark, [(900 + i, "a new line that is long enough to be counted as a key") for i in range(6)])
    read = []
    plain = linededup.Table.read

    def spied(self, shards=None):
        read.append(shards)
        return plain(self, shards)

    linededup.Table.read = spied
    try:
        grown = index.insert(some)
        shrunk = grown.delete(some)
    finally:
        linededup.Table.read = plain
    (touched,) = set(grown.postings.folders) & {s for s in range(32) if grown.postings.folders.get(s) != index.postings.folders.get(s)}
    for before, after in ((index, grown), (grown, shrunk)):
        for name in ("postings", "counts", "filters"):
            a, b = getattr(before, name).folders, getattr(after, name).folders
            assert {s for s in set(a) | set(b) if a.get(s) != b.get(s)} <= {touched}
    assert all(s is None or s <= {touched} for s in read) and sum(s is None for s in read) <= 4  # the deltas themselves
    assert grown.frequent().count() == index.frequent().count() + 1 and shrunk.frequent().count() == index.frequent().count()


def test_a_full_filter_is_built_anew(spark):
    rng = np.random.default_rng(3)
    hashes = rng.integers(-(1 << 63), 1 << 63, 400)
    rows = lambda part, move: [(0, int(h), move) for h in part]
    keys = lambda rows: spark.createDataFrame(rows, "shard long, h1 long, move int")
    small = linededup.build_filters(keys(rows(hashes[:10], 0)))
    grown = linededup.update_filters(small, keys(rows(hashes[5:10], 0) + rows(hashes[10:], 1) + rows(hashes[:5], -1)))
    made = Cuckoo(0, np.frombuffer(grown.first()["slots"], np.uint16))
    assert made.contains(hashes[5:].view(np.uint64)).all() and int((made.slots > 0).sum()) == 395


def test_cuckoo_holds_what_was_inserted_and_forgets_what_was_deleted():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    f = linededup._built(hashes)
    assert f.contains(hashes).all()
    others = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert f.contains(others).mean() < 0.002
    f.delete(hashes[:2500])
    assert f.contains(hashes[2500:]).all() and f.contains(hashes[:2500]).mean() < 0.01


@pytest.mark.parametrize("n", [4, 5])
def test_the_threshold_counts_documents(spark, n):
    line = "a line that is certainly long enough to count as one"
    rows = [(i, f"{line}\n{line}\nown {i}") for i in range(n)]
    found = LineIndex.build(docs_table(spark, rows)).clean(docs_table(spark, rows))
    assert found.agg(F.sum("n_dropped")).first()[0] == (0 if n == 4 else 8)
