"""Licence scans: Aho-Corasick over words finds notice phrases and identifier tags; a shunting-yard parser reads the tags' expressions.

A text is seen as its lower-cased words (letters, digits and everything beyond ASCII), joined by single spaces, so a phrase
matches across any punctuation and line breaks. After an identifier tag the rest of its line is read as a licence expression:
`or` binds less than `and`, `and` less than `with`; parentheses group. An expression is evaluated in one pass over its postfix
form, without listing the alternatives: each part says how many choices it leaves and which ids all of them need.

Null and empty texts have no word, no place and score 0. Rows are judged one by one: repeated rows repeat, a null doc_id
stays null, extra columns are ignored, an empty table gives an empty result. Texts are scanned whole in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.base import tidy

# Notice phrases and their labels. The base ones count as places; the others only add labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MORE = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "creative commons zero": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}
TAG = "spdx license identifier"
#: Identifiers that a tag may name, as prefixes of lower-cased ids, and their labels.
IDENTIFIERS = {"agpl-": "agpl", "lgpl-": "lgpl", "gpl-": "gpl", "apache-": "apache", "mit": "mit", "bsd-": "bsd", "mpl-": "mpl", "isc": "isc", "cc0-": "cc0", "cc-by": "cc-by", "epl-": "epl", "bsl-": "bsl", "unlicense": "public-domain"}

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TAGGED = re.compile(r"spdx[^a-z0-9\x80-\U0010ffff]+license[^a-z0-9\x80-\U0010ffff]+identifier[^a-z0-9\x80-\U0010ffff(\n]*([^\n]*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_BINDS = {"or": 1, "and": 2, "with": 3}
_MOST = (1 << 63) - 1


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in [*BASE, *MORE, TAG]:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def postfix(expression: str) -> list[str]:
    """Shunting-yard: the expression's ids and operators in postfix order, up to the first token that doesn't fit."""
    out: list[str] = []
    held: list[str] = []
    operand = True  # an id or "(" comes next
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if operand and token == "(":
            held.append(token)
        elif operand and low not in _BINDS and token != ")":
            out.append(token)
            operand = False
        elif not operand and low in _BINDS:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[low]:
                out.append(held.pop())
            held.append(low)
            operand = True
        elif not operand and token == ")" and "(" in held:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
        else:
            break
    if operand and held and held[-1] in _BINDS:
        held.pop()  # an operator without its right side
    return out + [x for x in reversed(held) if x != "("]


@dataclass
class Terms:
    """What an expression comes to: the number of choices that it leaves and the ids that every one of them needs."""

    choices: int
    needed: set[str]
    simple: str | None = None  # the id, if the expression is one


def evaluate(tokens: list[str]) -> tuple[Terms, list[str]]:
    """The terms of an expression in postfix order, and its ids in order.

    `or` offers the choices of both sides and needs what both need; `and` combines every choice of one side with every one of
    the other and needs what either needs; `with` ties an exception to its licence and is like `and` between anything else.
    Choices are counted as written, up to the largest long. Sets are merged into the larger one, so long expressions take
    about linear time.
    """
    stack: list[Terms] = []
    ids: list[str] = []
    for token in tokens:
        if token not in _BINDS:
            ids.append(token.lower())
            stack.append(Terms(1, {ids[-1]}, ids[-1]))
        elif len(stack) >= 2:
            right, left = stack.pop(), stack.pop()
            less, more = sorted((left.needed, right.needed), key=len)
            if token == "or":
                stack.append(Terms(min(left.choices + right.choices, _MOST), {x for x in less if x in more}))
            elif token == "with" and left.simple and right.simple:
                stack.append(Terms(1, {f"{left.simple} with {right.simple}"}))
            else:
                more |= less
                stack.append(Terms(min(left.choices * right.choices, _MOST), more))
    return (stack[-1] if stack else Terms(0, set())), ids


def label_of(identifier: str) -> str | None:
    return next((label for prefix, label in IDENTIFIERS.items() if identifier == prefix.rstrip("-") or identifier.startswith(prefix) and prefix.endswith("-") or identifier.startswith(prefix + "-")), None)


def scan_text(text: str, automaton: ahocorasick.Automaton) -> dict:
    words = text.encode().translate(_WORDS).split()
    norm = f" {b' '.join(words).decode('latin-1')} " if words else ""
    places: list[int] = []
    base, more, tagged = set(), set(), False
    seen, at = 0, 0  # spaces before position `at`; as many words begin there
    for start, phrase in sorted((end - len(phrase) - 1, phrase) for end, phrase in automaton.iter(norm)):
        if phrase in BASE:
            seen, at = seen + norm.count(" ", at, start), start
            places.append(seen)
            base.add(BASE[phrase])
        elif phrase == TAG:
            tagged = True
        else:
            more.add(MORE[phrase])
    expressions = [m.group(1).strip() for m in _TAGGED.finditer(text)] if tagged else []
    written = [postfix(e) for e in expressions]
    parsed = [evaluate(w) for w in written]
    more |= {label for _, ids in parsed for i in ids if (label := label_of(i))}
    found = len(places) + len(more - base) + 2 * sum(bool(ids) for _, ids in parsed)
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | more)),
        "score": 1 - 0.5**found,
        "expressions": [" ".join(w) for w in written],
        "n_choices": min(sum(t.choices for t, _ in parsed), _MOST),
        "needed": sorted(set().union(*(t.needed for t, _ in parsed))),
    }


_OUT = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("n_choices", pa.int64()), ("needed", pa.list_(pa.string()))])


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, word and place counts, labels, a score, and the tags' expressions (postfix) with the number of choices
    they leave and the ids that they need whatever is chosen.

    The score is 1 - 1/2^k for k places, further labels, and twice the tags that parse.
    """

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for batch in batches:
            rows = [scan_text(t.as_py() or "", automaton) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[f.name] for r in rows], f.type) for f in _OUT)], names=["doc_id", *_OUT.names])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, n_choices long, needed array<string>")
