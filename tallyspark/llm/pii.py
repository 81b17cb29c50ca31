"""Personal data by weak supervision.

Four base detectors (email, ip, card, phone) fix spans that always stay. Wider candidates (plain digit groups, spelled-out
addresses, titled names, long mixed tokens, account numbers) are judged by labelers that vote yes, no or abstain: a format
regex, a checksum or range validator, gazetteers, cue words to the left, grouping and isolation. Expectation-maximisation over
the counts of vote patterns of the whole corpus estimates each labeler's reliability, and so how likely each pattern is right;
vote patterns are a small closed set, so only their counts reach the driver. These soft labels train the span classifier, a
logistic regression over hashed features of the span and its context (shape, length, neighbouring signs and words) that are no
votes; it decides the candidates. It learns from about `train_spans` spans at most, chosen by a hash of doc_id and place.

Null and empty texts have no span. Rows are judged one by one: repeated rows and ties give repeated results, a null
doc_id stays null, extra columns are ignored, an empty table gives an empty result. Texts are scanned whole, by patterns
that take linear time; offsets are code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.base import bounded_sample, materialize, tidy

KINDS = ("email", "ip", "card", "phone", "id", "name", "secret", "iban")
#: Spans that train the classifier, about; its hashed features.
TRAIN_SPANS, BUCKETS = 20_000, 1 << 12
LABELERS = ("format", "validator", "gazetteer", "cue", "grouping", "isolation")

#: Kinds whose validator says much, and the weight of its vote before reliabilities are known.
CHECKED = {"card": 4, "secret": 3, "iban": 4}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SPELLED = re.compile(r"\b[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?[(\[]dot[)\]] ?[A-Za-z0-9-]{1,63}){1,8}", re.I)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

# Titles, gazetteers and cue words.
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
GIVEN = frozenset("anna james john maria mary michael peter robert thomas juan jose luis carlos pierre jean marie claire hans karl sofia elena paul".split())
SECRET_BEGINNINGS = ("sk-", "sk_", "pk_", "AKIA", "ASIA", "ghp_", "gho_", "xoxb-", "xoxp-", "AIza", "eyJ")
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk eu info".split())
CUES = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile"),
    "id": ("ssn", "id", "passport", "social", "tax"),
    "name": ("from", "by", "dear", "contact"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "api"),
    "iban": ("iban", "account", "konto", "bank"),
}
_NAMED = re.compile(r"\b(?:" + "|".join(TITLES) + r")\.? ([^\W\d_]\w{1,40})")
_RUN, _WORDS = re.compile(r"(.)\1+"), re.compile(r"[^\W\d_]+")
_CUE = {k: re.compile(r"(?<![^\W\d_])(?:" + "|".join(v) + r")(?:s|no|nr|number)?\b", re.I) for k, v in CUES.items()}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Local part, @, dotted domain. Each @ is tried once, so long runs of letters cost nothing."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and (c := text[start - 1]) < "\x80" and (c.isalnum() or c in "._%+-"):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return found


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]]]:
    """(start, kind number, end) of the four base kinds, and every digit group (start, end, digits)."""
    spans = [(s, 0, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return spans, []
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and (not p or int(p) <= 255) for g in m.groups()):
            spans.append((m.start(), 1, m.end()))
    groups = []
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        groups.append((m.start(), m.end(), digits))
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    return spans, groups


def votes(text: str, kind: int, start: int, end: int) -> str:
    """One character per labeler (+ yes, - no, 0 abstains), after the kind and a bucket of the number of digits."""
    span = text[start:end]
    digits = _NOT_DIGIT.sub("", span)
    n, name = len(digits), KINDS[kind]
    said = ["0"] * len(LABELERS)
    separated = len(span) > n
    if name == "email":
        said[0] = "+" if "@" in span else "0"
        said[1] = "+" if span.count("@") <= 1 and ".." not in span else "-"
        said[2] = "+" if re.split(r"[^A-Za-z]+", span.lower())[-1] in TOP_DOMAINS else "0"
    elif name == "ip":
        said[0], said[1] = "+", "+" if not span.startswith(("0.", "255.")) else "-"
    elif name == "card":
        said[0] = "+" if 13 <= n <= 19 else "-"
        said[1] = "+" if luhn(digits) else "-"
        said[2] = "+" if digits[:1] in "3456" else "-"
    elif name == "phone":
        said[0] = "+" if span.startswith("+") or span.startswith("(") else "-"
        said[1] = "+" if 9 <= n <= 15 else "-"
        said[4] = "+" if separated else "-"
    elif name == "id":
        said[0] = "+" if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}", span) else "0"
        said[1] = "-" if digits[:3] in ("000", "666") or digits[3:5] == "00" else "+"
        said[4] = "+" if separated else "0"
    elif name == "secret":
        said[0] = "+" if _HEX.fullmatch(span) and len(span) in (32, 40, 64) else "0"
        said[1] = "+" if entropy(span) >= 3 else "-"
        said[2] = "+" if span.startswith(SECRET_BEGINNINGS) else "0"
        said[4] = "+" if text[max(0, start - 3) : start].rstrip("\"'` ").endswith(("=", ":")) or start and text[start - 1] in "=:" else "-"
    elif name == "iban":
        plain = span.replace(" ", "")
        said[0] = "+" if 15 <= len(plain) <= 34 else "-"
        said[1] = "+" if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 else "-"
        said[4] = "+" if len(plain) == len(span) or all(len(p) == 4 for p in span.split(" ")[:-1]) else "-"
    else:
        word = span.rsplit(" ", 1)[-1]
        said[0] = "+" if word[:1].isupper() else "-"
        said[2] = "+" if word.lower() in GIVEN else "0"
    if _CUE[name].search(text, max(0, start - 30), start):
        said[3] = "+"
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    said[5] = "-" if any(c.isalnum() for c in around) else "+"
    return f"{kind}{min(n, 19):02d}{''.join(said)}"


def entropy(span: str) -> float:
    """Bits a character."""
    n = np.array(list(Counter(span).values()))
    return float(-(n / len(span) * np.log2(n / len(span))).sum())


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashed features of a span and its context, without a labeler's vote."""
    span = text[start:end]
    head = span[:64]
    shape = _RUN.sub(lambda m: f"{m.group()[0]}{len(m.group())}", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in head))
    sign = lambda c: "w" if c.isalnum() else c or "end"
    said = ["", f"shape {shape}", f"signs {''.join(sorted({sign(c) for c in head}))}", f"length {min(len(span), 80) // 4}", f"digits {min(sum(map(str.isdigit, head)), 32) // 2}", f"before {sign(text[max(0, start - 1) : start])}", f"after {sign(text[end : end + 1])}"]
    said += [f"left {w.lower()}" for w in _WORDS.findall(text[max(0, start - 40) : start])[-3:]]
    said += [f"right {w.lower()}" for w in _WORDS.findall(text[end : end + 24])[:1]]
    return sorted({zlib.crc32(f"{KINDS[kind]} {x}".encode()) % BUCKETS for x in said})


def candidates(text: str) -> list[tuple[int, int, int, bool, str, list[int]]]:
    """(start, kind, end, base, votes, features) by start and kind; the wider ones don't touch a base span or one another."""
    base, groups = base_spans(text)
    rows = [(s, k, e, True) for s, k, e in base]
    taken = sorted((s, e) for s, _, e in base)
    wide = [(s, 4 if len(d) == 9 else 2 if len(d) >= 13 else 3, e) for s, e, d in groups if 7 <= len(d) <= 19]
    if _DIGIT.search(text):
        accounts = {m.span() for m in _IBAN.finditer(text)}
        wide += [(s, 7, e) for s, e in accounts]
        wide += [(m.start(), 6, m.end()) for m in _TOKEN.finditer(text) if m.span() not in accounts and _DIGIT.search(m.group()) and _LETTER.search(m.group())]
    if "at)" in text or "at]" in text or "AT)" in text:
        wide += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text)]
    if any(f"{t} " in text or f"{t}. " in text for t in TITLES):
        wide += [(m.start(), 5, m.end()) for m in _NAMED.finditer(text)]
    i, free = 0, 0
    for s, k, e in sorted(wide):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if s >= free and (i == len(taken) or taken[i][0] >= e):
            rows.append((s, k, e, False))
            free = e
    return [(s, k, e, b, votes(text, k, s, e), features(text, k, s, e)) for s, k, e, b in sorted(rows)]


SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("votes", T.StringType()), T.StructField("features", T.ArrayType(T.IntegerType()))])
_ARROW_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))])


def find_candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidate spans, one row for each row of `docs`."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[dict(zip(SPAN.names, c, strict=True)) for c in candidates(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_ARROW_SPAN))], names=["doc_id", "found"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(scan, T.StructType([rows.schema["doc_id"], T.StructField("found", T.ArrayType(SPAN))]))


def reliabilities(patterns: dict[str, int], rounds: int = 50) -> dict[str, float]:
    """Expectation-maximisation over counted vote patterns: the chance that a candidate with that pattern is personal data.

    One latent class per kind; each labeler has a chance of yes, no and abstain for either class, smoothed by one count (and a
    checksum's or entropy's validator by the belief that it is mostly right).
    """
    truth: dict[str, float] = {}
    for kind in {p[0] for p in patterns}:
        own = sorted(p for p in patterns if p[0] == kind)
        n = np.array([patterns[p] for p in own], float)
        said = np.array([["-0+".index(c) for c in p[3:]] for p in own])
        one_hot = np.eye(3)[said]
        # starts from a clear majority of the votes; a checksum's or an entropy's vote outweighs the others
        weight = np.where(np.array(LABELERS) == "validator", CHECKED.get(KINDS[int(kind)], 1), 1)
        q = 1 / (1 + np.exp(1 - (one_hot[:, :, 2] - one_hot[:, :, 0]) @ weight))
        for _ in range(rounds):
            chance = []
            for w, vote in ((q * n, 2), ((1 - q) * n, 0)):
                got = np.einsum("p,plv->lv", w, one_hot) + 1
                if KINDS[int(kind)] in CHECKED:  # as much belief in the check as all spans of the kind could take away
                    got[LABELERS.index("validator"), vote] += n.sum()
                chance.append((np.log(got / got.sum(1, keepdims=True)), np.log(w.sum() + 1)))
            score = [np.einsum("plv,lv->p", one_hot, c) + prior for c, prior in chance]
            q = 1 / (1 + np.exp(np.clip(score[1] - score[0], -50, 50)))
        truth |= dict(zip(own, q.tolist(), strict=True))
    return truth


def train(rows: list[list[int]], soft: list[float], rounds: int = 200) -> np.ndarray:
    """The span classifier's weights: logistic regression on soft labels over each span's features (AdaGrad, a small ridge)."""
    w, power = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
    if not rows:
        return w
    at, y = np.concatenate([np.array(r, np.int64) for r in rows]), np.array(soft)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(row, w[at], len(rows))))
        grad = np.bincount(at, (p - y)[row], BUCKETS) / len(rows) + 1e-5 * w
        power += grad * grad
        w -= 0.5 * grad / np.sqrt(power)
    return w


def learn(found: DataFrame, train_spans: int = TRAIN_SPANS) -> np.ndarray:
    """The classifier's weights from the candidates of `find_candidates`."""
    counted = found.select(F.explode("found.votes").alias("votes")).groupBy("votes").count().collect()  # a closed set
    truth = reliabilities({r["votes"]: r["count"] for r in counted})
    spans = found.select("doc_id", F.explode("found").alias("s")).select(F.xxhash64("doc_id", "s.start", "s.end", "s.kind").alias("key"), "s.votes", "s.features")
    sample = bounded_sample(spans, "key", train_spans).collect()
    sample.sort(key=lambda r: (r["key"], r["votes"]))
    return train([r["features"] for r in sample], [truth[r["votes"]] for r in sample])


def personal_data(docs: DataFrame, threshold: float = 0.5, train_spans: int = TRAIN_SPANS) -> DataFrame:
    """doc_id and `found`, its spans with the classifier's probability: base ones, and candidates of `threshold` or more."""
    found = materialize(find_candidates(docs))
    weights = learn(found, train_spans)
    kept = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()), T.StructField("probability", T.DoubleType())])
    arrow = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_()), ("probability", pa.float64())])

    @tidy
    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans in batch.column(1).to_pylist():
                judged = [(s, round(float(1 / (1 + np.exp(-weights[s["features"]].sum()))), 6)) for s in spans]
                rows.append([{"start": s["start"], "kind": KINDS[s["kind"]], "end": s["end"], "base": s["base"], "probability": p} for s, p in judged if s["base"] or p >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(arrow))], names=["doc_id", "found"])

    return found.mapInArrow(classify, T.StructType([found.schema["doc_id"], T.StructField("found", T.ArrayType(kept))]))


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from the spans of `personal_data`."""
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"])
    n = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(k) for k in KINDS[:4]), F.sha2(said(base), 256).alias("base_sha256"), said("found").alias("spans"))
