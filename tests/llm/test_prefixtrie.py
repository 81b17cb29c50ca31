import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tallyspark.llm import prefixtrie
from tallyspark.llm.registry import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """Every conversation rebuilt as a list of turns; every prefix walked to its root."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * len(node[-1][1]) if node else 0
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(node)))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), kids[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations():
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 12), *range(100, 140), 205, 1_000_000_007, 300, *(1 << 60 | i for i in range(8))]:
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "yes", "é😀", ""])) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, "user", f"long {t % 5}") for t in range(20, 75)]  # a long one, head of a family
    rows += [(102, None, "user", "first"), (103, 3, None, "x"), (104, 2, "user", None), (105, 2, "a", "tie"), (105, 2, "b", "tie"), (106, 1, "a", "b"), (106, 1, "a", "b"), (106, 1, "a", "b")]
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("slice_", "chunk"), [(4, 8), (4096, 1 << 20)])
def test_against_walks(spark, slice_, chunk):
    rows = conversations()
    df = spark.createDataFrame([(*r, "kept", 1) for r in rows], SCHEMA + ", p1 string, depth int").repartition(3)
    found = prefixtrie.trie(*prefixtrie.rebuilt(df), slice_=slice_, chunk=chunk)
    assert sorted((tuple(r) for r in found.select(COLUMNS).collect()), key=lambda r: r[:2]) == plain(rows)


def test_many_turnless_and_equal_conversations(spark):
    rows = [(100 * k + i, 0, "user", "same") for k in range(3) for i in range(60)]
    found = prefixtrie.trie(*prefixtrie.rebuilt(spark.createDataFrame(rows, SCHEMA)), chunk=16)
    assert sorted((tuple(r) for r in found.select(COLUMNS).collect()), key=lambda r: r[:2]) == plain(rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.trie(*prefixtrie.rebuilt(empty)).collect() == []
    assert prefixtrie.trie(*prefixtrie.rebuilt(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))).collect() == []


def test_rounds_follow_the_logarithm_of_the_depth(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(prefixtrie, "discard", lambda *tables: rounds.append(tables))
    nodes = spark.createDataFrame([(1, d, 1 if d else None, int(d == 300), 1) for d in range(301)], "conv_id long, depth long, parent long, n_leaves long, saved_tokens long")
    found = {r.depth: (r.n_leaves, r.saved_tokens) for r in prefixtrie.gathered(nodes, 300, ["n_leaves", "saved_tokens"]).collect()}
    assert found == {d: (1, 301 - d) for d in range(301)} and len(rounds) == 9


def test_query_equals_its_sql(spark, sf):
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    expected = [tuple(r) for r in db.execute(f"select {', '.join(COLUMNS)} from ({prefixtrie.ORACLE}) order by 1, 2").fetchall()]
    assert [tuple(r) for r in op12_prefix_trie(spark, sf).orderBy("conv_id", "depth").select(COLUMNS).collect()] == expected
