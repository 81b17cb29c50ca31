"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated probabilities.

Words (runs of word characters or of signs, lower-cased) are hashed to buckets. A bucket has a sparse random index vector;
its context vector is the sum of the index vectors of the words up to two places away, over all documents. A document is the
mean of its words' index vectors beside the mean of their unit context vectors. The network learns from at most about
`train_rows` labelled documents, and a temperature fitted on a fifth of them calibrates its probabilities.

An id with several rows trains with its smallest vector. Null and empty texts are the zero vector and get the network's score for it. Several labels of a doc_id are averaged; null
labels and labels of other values are ignored; without any label every score is 0.5. A null doc_id is scored but trains
nothing. Repeated rows repeat, extra columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.base import bounded_sample, materialize, passes, sums, tidy, utf8
from tallyspark.llm.tokens import hashed_tokens

BITS, DIM, REACH = 12, 32, 2
TRAIN_ROWS = 20_000


def index_vectors(seed: int = 3) -> np.ndarray:
    """A sparse vector of two +1 and two -1 for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((1 << BITS, DIM), np.int8)
    for row in out:
        at = rng.choice(DIM, 4, replace=False)
        row[at[:2]], row[at[2:]] = 1, -1
    return out


def context_vectors(docs: DataFrame) -> np.ndarray:
    """Each bucket's sum of index vectors of neighbouring words, over all documents. A closed table: buckets by dimensions."""
    names = [f"c{i}" for i in range(DIM)]

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        total = np.zeros((1 << BITS, DIM))
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in passes(offsets):
                bucket, first = hashed_tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BITS)
                text = np.repeat(np.arange(b - a), np.diff(first))
                same = [text[d:] == text[:-d] for d in range(1, REACH + 1)]
                for i in range(DIM):
                    own = index[:, i][bucket]
                    near = np.zeros(len(bucket), np.int16)
                    for d, ok in enumerate(same, 1):
                        near[d:] += own[:-d] * ok
                        near[:-d] += own[d:] * ok
                    total[:, i] += np.bincount(bucket, near, 1 << BITS)
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(total[seen, i].astype(np.int64)) for i in range(DIM))], names=["bucket", *names])

    parts = docs.select("text").mapInArrow(scan, "bucket long, " + ", ".join(f"{n} long" for n in names))
    out = np.zeros((1 << BITS, DIM))
    for r in parts.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).collect():
        out[r[0]] = r[1:]
    return out


def document_vectors(docs: DataFrame, context: np.ndarray) -> DataFrame:
    """doc_id and `vector` (binary float32), one row for each row of `docs`."""
    centred = context - context.sum(0) / max(1, (context != 0).any(axis=1).sum())
    unit = centred / np.maximum(np.linalg.norm(centred, axis=1), 1e-9)[:, None] * (context != 0).any(axis=1)[:, None]
    both = docs.sparkSession.sparkContext.broadcast(np.hstack([index_vectors(), unit]).astype(np.float32))

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            out = np.zeros((len(batch), 2 * DIM), np.float32)
            for a, b in passes(offsets):
                bucket, first = hashed_tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BITS)
                n = np.maximum(np.diff(first), 1)
                for i in range(2 * DIM):
                    out[a:b, i] = sums(both.value[:, i][bucket], first[:-1], first[1:]) / n
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in out], pa.binary())], names=["doc_id", "vector"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(scan, T.StructType([rows.schema["doc_id"], T.StructField("vector", T.BinaryType())]))


class Network:
    """vector -> tanh layer -> logit; inputs are standardised, the logit is divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.temperature = 1.0
        back = np.arange(len(x)) % 5 == 0
        train = np.flatnonzero(~back) if (~back).any() else np.arange(len(x))
        x = (x - self.mean) / self.scale
        m, v, t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0
        for epoch in range(epochs):
            order = rng.permutation(train)
            for i in range(0, len(order), 64):
                at = order[i : i + 64]
                h = np.tanh(x[at] @ self.p[0] + self.p[1])
                g = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y[at]) / len(at)
                gh = np.outer(g, self.p[2]) * (1 - h * h)
                t += 1
                for k, grad in enumerate((x[at].T @ gh + 1e-4 * self.p[0], gh.sum(0), h.T @ g + 1e-4 * self.p[2], g.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] -= 0.005 / (1 + epoch / 20) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        logits = np.tanh(x[back] @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]
        loss = lambda s: np.mean(np.logaddexp(0, logits / s) - y[back] * logits / s)
        if back.any():
            self.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        h = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1])
        return 1 / (1 + np.exp(-np.clip((h @ self.p[2] + self.p[3]) / self.temperature, -50, 50)))


def labelled(labels: DataFrame, column: str, usable: Column, most: int) -> DataFrame:
    """doc_id and label `y` of at most about `most` usable labels, one row for each doc_id."""
    rows = labels.filter(usable & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.avg(column).alias("y"))
    return bounded_sample(rows, "doc_id", most)


def quality(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id and score of every row of `docs`, learnt from `labels` (doc_id, quality) where `usable` holds."""
    vectors = materialize(document_vectors(docs, context_vectors(docs)))
    known = labelled(labels, "quality", usable, train_rows)
    examples = vectors.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("vector").alias("vector"), F.first("y").alias("y"))
    rows = sorted(examples.collect(), key=lambda r: r["doc_id"])  # one for each id, bounded by train_rows
    network = Network(np.array([np.frombuffer(r["vector"], np.float32) for r in rows], float), np.array([r["y"] for r in rows])) if rows else None

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, 2 * DIM).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network(x) if network else np.full(len(x), 0.5), pa.float64())], names=["doc_id", "score"])

    return vectors.mapInArrow(score, T.StructType([vectors.schema["doc_id"], T.StructField("score", T.DoubleType())]))
