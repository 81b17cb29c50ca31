import hashlib
import random
from collections import Counter

import pytest

from tallyspark.llm import alignment
from tests.llm.fixtures import awkward, docs_table, with_clashes

ODD = ["a", "b", " ", "  ", "\n", "\t", "\r\n", "\r", ";\r", " the", "'s", "é", "中", "\xa0", "　", "\x1c", "\x85", "​", "﻿", "!", "x1", "<s>", "<|endoftext|>", "\0", "😀", "12", " stone"]


@pytest.fixture(scope="module")
def words():
    with open(alignment.VOCABULARY_A, encoding="utf-8") as a, open(alignment.VOCABULARY_B, "rb") as b:
        return alignment.Vocabularies(a.read(), b.read())


def owners(ids, sizes):
    """For each byte, which token (by place) has it."""
    return [k for k, i in enumerate(ids) for _ in range(len(sizes[i]))]


def plain(words, texts):
    """Every text tokenised whole; links and groups byte by byte; counts over all texts."""
    tokens = []
    for text in texts:
        a = words.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = words.b.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if b"".join(words.bytes_a[i] for i in a) != raw or b"".join(words.bytes_b[i] for i in b) != raw:
            a, b = [], []
        places = sorted(set(zip(owners(a, words.bytes_a), owners(b, words.bytes_b), strict=True)))
        tokens.append((a, b, [(a[x], b[y]) for x, y in places], places))
    count = Counter(link for _, _, links, _ in tokens for link in links)
    most = Counter()
    for (_, y), n in count.items():
        most[y] = max(most[y], n)
    out = []
    for a, b, links, places in tokens:
        groups, last_a, last_b = [], set(), set()
        for x, y in places:  # in order; a place that shares neither token with those before it begins a group
            if x not in last_a and y not in last_b:
                groups.append(([], []))
            for side, k, seen in ((0, x, last_a), (1, y, last_b)):
                if k not in seen:
                    groups[-1][side].append((a, b)[side][k])
                    seen.add(k)
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == most[p[1]] for p in links), sum(count[p] for p in links), text))
    return out


def result(df):
    return [tuple(r) for r in df.select("doc_id", *alignment._SUMS, "groups").collect()]


def key(row):
    return tuple((x is not None, x) for x in row)


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_against_whole_texts(spark, words, block):
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in awkward(4)] + [(5000 + i, "".join(rng.choice(ODD) for _ in range(rng.randrange(1, 30)))) for i in range(150)]
    rows += [(6000, "mark ▁ inside"), (6001, " "), (6002, "\n"), (6003, "x" * 5000), (6004, "tail  \r\n"), (6004, "tail  \r\n"), (6005, "stone " * 4000)]
    docs = with_clashes(docs_table(spark, rows).repartition(3))
    expected = [(i, *p) for (i, _), p in zip(rows, plain(words, [t for _, t in rows]), strict=True)]
    assert sorted(result(alignment.align(docs, block=block)), key=key) == sorted(expected, key=key)


def test_cuts_change_no_token(words):
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(1, 25)))
        segments = words.segments(text)
        assert "".join(segments) == " " + text
        a, b = words.tokens(segments)
        assert [i for x in a for i in x] == words.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for x in b for i in x] == words.b.encode(text)


def test_counts_join_beyond_a_broadcast(spark, words, monkeypatch):
    monkeypatch.setattr(alignment, "LOOKED_UP", 0)
    rows = [(i, f"the house {i} walks under the tree {i % 3}") for i in range(40)]
    expected = [(i, *p) for (i, _), p in zip(rows, plain(words, [t for _, t in rows]), strict=True)]
    assert sorted(result(alignment.align(docs_table(spark, rows)))) == expected


def test_digest_and_empty_table(spark):
    docs = docs_table(spark, [(1, "a b"), (2, ""), (3, None)])
    found = {r.doc_id: r for r in alignment.digest(alignment.align(docs)).collect()}
    whole = {r.doc_id: r.groups for r in alignment.align(docs).collect()}
    assert found[1].groups_sha256 == hashlib.sha256(whole[1].encode()).hexdigest() and found[2].groups_sha256 == found[3].groups_sha256 == ""
    assert alignment.digest(alignment.align(docs.limit(0))).collect() == []


def test_vocabularies_must_fit(words):
    with open(alignment.VOCABULARY_A, encoding="utf-8") as a, open(alignment.VOCABULARY_B, "rb") as b:
        with pytest.raises(ValueError):
            alignment.Vocabularies(a.read().replace('"use_regex":true', '"use_regex":false').replace('"use_regex": true', '"use_regex": false'), b.read())
