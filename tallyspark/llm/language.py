"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text's features are its 3- and 4-byte subwords (letters only, a space marks a word's edge), hashed to buckets. Each bucket
has an embedding; a text is the mean of its subwords' embeddings, and a linear layer with softmax names the language. After
training the two linear maps are one table of logits for each bucket, so scoring is a lookup and a mean over whole texts.
A temperature fitted on a part of the training rows calibrates the probabilities; a text is rejected if it has no letter or
its calibrated probability stays below `reject_below`.

Training takes at most about `train_rows` labelled rows, chosen by a hash of doc_id; an id with several rows trains with its
smallest text. Null or letterless texts are `und` with
score 0. Without any labelled row all texts are. Rows with a null language or doc_id train nothing. Repeated rows repeat,
extra columns are kept only by `keep_known`, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.base import bounded_sample, packed, passes, sums, tidy, utf8

UNKNOWN = "und"
BUCKETS, DIM = 1 << 15, 16
TRAIN_ROWS = 3000

_LETTER = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)


def subwords(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the 3- and then the 4-byte subwords at each position, with whether there is one."""
    low = _LETTER[data]
    space = low == 32
    wide = low.astype(np.uint32)
    for n in (3, 4):
        k = len(low) - n + 1
        if k <= 0:
            yield np.zeros(len(low), np.int64), np.zeros(len(low), bool)
            continue
        word = wide[:k].copy()
        inside = np.ones(k, bool)
        for i in range(1, n):
            word |= wide[i : i + k] << np.uint32(8 * i)
            if i < n - 1:
                inside &= ~space[i : i + k]
        for end in offsets[1:-1]:  # none crosses from one text to the next
            inside[max(0, end - n + 1) : end] = False
        word *= np.uint32(2654435761 + 2 * n)
        word >>= np.uint32(32 - 15)
        yield np.concatenate([word, np.zeros(n - 1, np.uint32)]).astype(np.int32), np.concatenate([inside, np.zeros(n - 1, bool)])


def counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's subwords and their share."""
    data = np.frombuffer(text, np.uint8)
    found = [b[ok] for b, ok in subwords(data, np.array([0, len(data)]))]
    buckets, n = np.unique(np.concatenate(found), return_counts=True)
    return buckets, n / max(1, n.sum())


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # of each bucket, float32
    bias: np.ndarray
    temperature: float

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 1.0, seed: int = 1) -> Model:
    """SGD on (language, buckets, shares), every fifth row held back for the temperature."""
    languages = sorted({r[0] for r in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    rng = np.random.default_rng(seed)
    of = {x: i for i, x in enumerate(languages)}
    embedding = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    weight, bias = rng.normal(0, 0.3, (len(languages), DIM)).astype(np.float32), np.zeros(len(languages), np.float32)
    back, train = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(train)):
            language, buckets, share = train[i]
            if not len(buckets):
                continue
            mean = share @ embedding[buckets]
            z = weight @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[of[language]] -= 1
            pull = weight.T @ p
            weight -= step * np.outer(p, mean)
            bias -= 0.1 * step * p
            # a bucket's share is small: its step is scaled by the number of buckets
            embedding[buckets] -= (step * len(buckets) * 0.05) * np.outer(share, pull)
    seen = np.zeros(BUCKETS, bool)
    for _, buckets, _ in train:
        seen[buckets] = True
    embedding[~seen] = 0  # what was never learnt says nothing: a text of nothing else is rejected
    model = Model(languages, (embedding @ weight.T).astype(np.float32), bias, 1.0)
    means = np.array([share @ model.logits[buckets] if len(buckets) else np.zeros(len(languages)) for _, buckets, share in back])
    right = np.array([of[r[0]] for r in back])
    loss = lambda t: -np.log(Model(languages, model.logits, bias, t).probabilities(means)[np.arange(len(right)), right] + 1e-12).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))
    return model


def train(docs: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS) -> Model:
    """A model of the rows where `usable` holds and lang isn't null."""
    rows = bounded_sample(docs.filter(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"), "doc_id", train_rows)
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("row")).select("doc_id", "row.text", "row.lang")  # one for each id

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [packed(*counts((t.as_py() or "").encode())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["lang", "bucket", "share"])

    got = rows.mapInArrow(scan, "lang string, bucket binary, share binary").collect()
    return fit(sorted(((r["lang"], np.frombuffer(r["bucket"], "<i4"), np.frombuffer(r["share"], "<f4")) for r in got), key=lambda r: (hash_of(r[1]), r[0])))


def hash_of(a: np.ndarray) -> int:
    """An order of the training rows that doesn't depend on how Spark returns them."""
    import zlib

    return zlib.crc32(a.tobytes())


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and calibrated probability of each text."""
    data, offsets = utf8(texts)
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, scores
    for a, b in passes(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        total, n = np.zeros((b - a, len(model.languages))), np.zeros(b - a)
        for bucket, ok in subwords(part, at):
            n += sums(ok, at[:-1], at[1:])
            for j in range(len(model.languages)):
                total[:, j] += sums(model.logits[:, j][bucket] * ok, at[:-1], at[1:])
        p = model.probabilities(total / np.maximum(n, 1)[:, None])
        plain = sums((part | 32 >= 97) & (part | 32 <= 122), at[:-1], at[1:]) > 0
        for i in range(b - a):
            if plain[i] or at[i + 1] > at[i] and has_letter(texts[a + i].as_py()):
                names[a + i], scores[a + i] = model.languages[int(p[i].argmax())], p[i].max()
    return names, scores


def _share(df: DataFrame, model: Model):
    return df.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: Model, reject_below: float = 0.4) -> DataFrame:
    """doc_id, lang_pred, score, rejected, one row for each row of `docs`."""
    held = _share(docs, model)

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(held.value, batch.column(1))
            rejected = [n == UNKNOWN or s < reject_below for n, s in zip(names, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(scan, T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))


def keep_known(docs: DataFrame, model: Model, reject_below: float = 0.4) -> DataFrame:
    """The rows of `docs`, all columns, whose text isn't rejected."""
    held = _share(docs, model)
    at = docs.columns.index("text")

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(held.value, batch.column(at))
            yield batch.filter(pa.array([n != UNKNOWN and s >= reject_below for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)
