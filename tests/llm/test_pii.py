from __future__ import annotations

import hashlib
import random
import re

from tallyspark.llm import pii
from tests.llm.fixtures import awkward, docs_table, with_clashes

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rows = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    rows += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    rows += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    rows += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return sorted(rows)


CASES = [
    "a@b.c", "x a.b+c@d-e.f.g, y@z @q.r a@@b.c", "a@b", "a@b.c@d.e", "1.2.3.4", "1.2.3.4.5.6.7.8 999.1.1.1 01.02.003.0255", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123.456-78 9", "+1 2", "++12 3456789012 +",
    "4111 1111 1111 1111 4111 1111 1111 1111", "00000000000000", "é😀a@b.cz 1.1.1.1", "", "+123456789012345678", "12 34 56 78 90 12 34 5", "a%b@c..d a@b.c- .@-.-",
]


def test_base_spans_equal_the_patterns():
    for text in CASES:
        assert sorted(pii.base_spans(text)[0]) == brute(text), text


def test_corpus_equals_the_patterns(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r["doc_id"]: r for r in pii.digest(pii.personal_data(df)).collect()}
    kinds = pii.KINDS
    for r in df.collect():
        spans = brute(r["text"] or "")
        got = found[r["doc_id"]]
        said = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        assert got["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert [got[f"n_{k}"] for k in kinds[:4]] == [sum(x[1] == i for x in spans) for i in range(4)]
        assert set(filter(None, said.split(","))) <= set(got["spans"].split(","))


def test_expectation_maximisation_trusts_the_better_labelers():
    good, bad = "411" + "++0+0+", "411" + "---0--"
    truth = pii.reliabilities({good: 50, bad: 50, "411" + "+-0+0+": 3})
    assert truth[good] > 0.9 and truth[bad] < 0.1
    assert not pii.train([], []).any()


def planted(seed=5):
    """Texts with spans beyond the base patterns (text, its spans) and texts with look-alikes."""
    rng = random.Random(seed)
    words = lambda k: " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randrange(3, 9))) for _ in range(k))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))

    def iban():
        body = "".join(rng.choice("0123456789") for _ in range(18))
        return f"DE{98 - int(body + '131400') % 97:02d}{body}"

    makers = [
        lambda: ("secret", f'token = "{hexes(40)}"'[9:-1], 'token = "', '"'),
        lambda: ("secret", "sk-" + hexes(32), "api key: ", ""),
        lambda: ("iban", iban(), "IBAN ", ""),
        lambda: ("email", f"{words(1)} (at) {words(1)} (dot) com", "mail ", ""),
        lambda: ("name", f"Dr {rng.choice(['Anna', 'Peter', 'Maria'])}", "from ", ""),
    ]
    decoys = [lambda: "".join(rng.choice("0123456789") for _ in range(11)), lambda: "a" * 15 + "1", lambda: "GB00AAAA1111BBBB22", lambda: f"id{rng.randrange(10)}" * 8, lambda: words(3)]
    rows, truth = [], {}
    for i in range(1500):
        before, after = words(rng.randrange(2, 20)), words(rng.randrange(2, 20))
        if i % 2:
            kind, span, lead, end = rng.choice(makers)()
            text = f"{before} {lead}{span}{end} {after}"
            truth[i] = (kind, len(before) + 1 + len(lead), len(before) + 1 + len(lead) + len(span))
        else:
            text = f"{before} {rng.choice(decoys)()} {after}"
        rows.append((i, text))
    return rows, truth


def test_recall_of_spans_beyond_the_base_patterns(spark):
    rows, truth = planted()
    found = {r["doc_id"]: {(s["kind"], s["start"], s["end"]) for s in r["found"]} for r in pii.personal_data(docs_table(spark, rows)).collect()}
    assert sum(t in found[i] for i, t in truth.items()) >= 0.9 * len(truth)
    assert sum(bool(found[i]) for i, _ in rows if i not in truth) <= 0.1 * (len(rows) - len(truth))


def test_the_classifier_sees_no_vote():
    text = 'and so token = "40d78a45c418324758e099eb7cb89bc0f5fa9f62" it is'
    start, end = text.index("40d7"), text.index('" it')
    assert pii.features(text, 6, start, end) != pii.features(text.replace("token", "other"), 6, start, end)
    assert pii.features(text, 6, start, end) == pii.features("x " * 50 + text, 6, start + 100, end + 100)


def test_awkward_rows(spark):
    rows = [*awkward(), *[(5000 + i, t) for i, t in enumerate(CASES)], (6000, "7" * 200_000), (6001, "a" * 200_000 + "@"), (6002, "+1" + "(" * 100_000), (6003, "1 " * 500_000), (6004, "DE12" + "A1 " * 100_000), (6005, "x1" * 300_000)]
    found = pii.personal_data(with_clashes(docs_table(spark, rows)))
    assert found.count() == len(rows) and pii.digest(found).filter("doc_id = 2000 and spans = '' and n_email = 0").count() == 1
    assert pii.digest(pii.personal_data(docs_table(spark, []))).count() == 0
