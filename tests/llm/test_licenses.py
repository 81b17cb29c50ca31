from __future__ import annotations

import re

import pytest

from tallyspark.llm import licenses
from tests.llm.fixtures import awkward, docs_table, with_clashes

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


CASES = [
    "MIT License mit-license MIT\nLICENSE", "GNU General Public License, or the Apache License", "cc by cc by-sa CC-BY", "summit license", "mit licenses", "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0 WITH Classpath", "", "apache license", "permission is hereby granted, free of charge",
    "SPDX-License-Identifier: AND OR", "spdx license identifier", "gnu lesser general public license", "é MIT License é",
]


def test_base_places_equal_brute_force(spark, sf):
    df = docs_table(spark, [*awkward(), *[(5000 + i, t) for i, t in enumerate(CASES)], (6000, "mit license " * 20_000), (6001, "(" * 50_000)])
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), with_clashes(df)):
        rows = sorted(((r["doc_id"], *brute(r["text"])) for r in docs.collect()), key=str)
        found = licenses.license_scan(docs).collect()
        assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in found), key=str) == rows
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in found)
    assert licenses.license_scan(docs_table(spark, [])).count() == 0


def alternatives(tokens):
    """All choices of an expression, as lists of ids that hold together."""
    stack = []
    for token in tokens:
        if token in ("or", "and", "with"):
            right, left = stack.pop(), stack.pop()
            stack.append(left + right if token == "or" else [a | b for a in left for b in right] if token == "and" else [{f"{x} with {y}"} for a in left for b in right for x in a for y in b])
        else:
            stack.append([{token.lower()}])
    return stack[-1] if stack else []


@pytest.mark.parametrize(
    ("expression", "postfix"),
    [
        ("MIT", ["MIT"]),
        ("MIT OR Apache-2.0 AND BSD-3-Clause", ["MIT", "Apache-2.0", "BSD-3-Clause", "and", "or"]),
        ("(MIT OR Apache-2.0) AND BSD-3-Clause", ["MIT", "Apache-2.0", "or", "BSD-3-Clause", "and"]),
        ("GPL-2.0 WITH Classpath-exception OR MIT", ["GPL-2.0", "Classpath-exception", "with", "MIT", "or"]),
        ("(MIT AND x) OR (x AND y WITH z)", ["MIT", "x", "and", "x", "y", "z", "with", "and", "or"]),
        ("MIT OR", ["MIT"]),
        ("AND MIT", []),
        ("(MIT", ["MIT"]),
        ("MIT) and x", ["MIT"]),
        ("", []),
    ],
)
def test_expressions(expression, postfix):
    assert licenses.postfix(expression) == postfix
    found, _ = licenses.evaluate(postfix)
    every = alternatives(postfix)
    assert found.choices == len(every) and found.needed == (set.intersection(*every) if every else set())


@pytest.mark.parametrize("clauses", [30, 1000, 50_000])
def test_long_expressions_are_not_expanded(clauses):
    import time

    began = time.perf_counter()
    text = "SPDX-License-Identifier: " + " AND ".join(f"(MIT OR b{i})" for i in range(clauses))
    found = licenses.scan_text(text, licenses._automaton())
    assert found["n_choices"] == min(2**clauses, (1 << 63) - 1) and "mit" in found["labels"] and found["needed"] == []
    nested = licenses.scan_text("SPDX-License-Identifier: " + "(" * clauses + "MIT" + " WITH x)" * clauses, licenses._automaton())
    assert nested["n_choices"] == 1
    assert time.perf_counter() - began < (0.5 if clauses <= 1000 else 10)


def test_labels_of_identifiers():
    assert [licenses.label_of(x) for x in ("mit", "gpl-3.0-only", "lgpl-2.1", "apache-2.0", "cc-by-4.0", "mitre", "zlib")] == ["mit", "gpl", "lgpl", "apache", "cc-by", None, None]
