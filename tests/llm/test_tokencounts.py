import random

import pytest
from tokenizers import Tokenizer

from tallyspark.llm import tokencounts
from tests.llm.fixtures import awkward, docs_table, with_clashes

ODD = [*"abstrveldm  \n\té0١²ΣΑİß.!", "'s", "'re", "'LL", "''", "<|startoftext|>", "<|endoftext|>", "aaaa", "the ", "Ing", "中文", "한", "‍", "\x1c", "\x85", "　", "é", "😀"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokencounts.VOCABULARY)


@pytest.fixture(scope="module")
def counter():
    with open(tokencounts.VOCABULARY, encoding="utf-8") as f:
        return tokencounts.Counter(f.read())


def test_counts_of_odd_texts(library, counter):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0x3000), rng.randrange(0x3000, 0xD7FF), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += ["a" * k for k in range(70)] + ["".join(rng.choice("abc") for _ in range(5000)), "word " * 5000]
    assert counter.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_all_code_points(library, counter):
    texts = ["".join(f"a{chr(c)}b{chr(c)}{chr(c)} " for c in range(base, base + 256) if not 0xD800 <= c < 0xE000) for base in range(0, 0x110000, 256)]
    assert counter.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_memory_of_counts_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokencounts, "_KNOWN", 10)
    with open(tokencounts.VOCABULARY, encoding="utf-8") as f:
        counter = tokencounts.Counter(f.read())
    texts = [" ".join(f"w{i}{k}" for k in range(30)) for i in range(20)]
    assert [int(counter.count([t])[0]) for t in texts] == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert len(counter.known) <= 10 + 31


def test_table(spark, library):
    docs = with_clashes(docs_table(spark, awkward(2)))
    docs = docs.withColumn("n_tokens", docs.doc_id)
    found = tokencounts.token_counts(docs, limit=100).collect()
    assert len(found) == docs.count() and found[0].asDict().keys() >= {*docs.columns, "n_bytes", "_n_tokens", "over_limit"}
    for r in found:
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_bytes, r["_n_tokens"], r.over_limit, r.n_tokens) == (len((r.text or "").encode()), n, n > 100, r.doc_id)
    assert tokencounts.digest(docs.limit(0)).collect() == []
    assert tokencounts.digest(docs).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


def test_merges_that_rounds_cannot_apply():
    model = {"vocab": {s: i for i, s in enumerate([*tokencounts.byte_symbols(), "ab", "abc", "bc"])}, "merges": [["a", "b"], ["ab", "c"], ["b", "c"], ["a", "bc"]]}
    with pytest.raises(ValueError):
        tokencounts.Merges.of(model)
