"""Toxicity: nearest labelled examples by exact TF-IDF cosine over a block-max inverted index, with calibrated votes.

A text's terms are its words, and those word beginnings (of 3 to 6 characters, for languages that inflect or compound) that
the labelled rows show to tell of a label: a term's likelihood ratio must pass a Bonferroni bound over all terms seen in three
or more independent texts (of near copies, which share a MinHash value of their shingles, one counts), and a term that goes with
label 1 must have it in at least half of the texts that have the term, or have it densely. A term weighs (1 + log tf) times its
idf, with document frequencies counted over all documents; a telling term weighs `TELLING` times as much. Every term of every
example is in the index. A text's terms that no example has are in its norm, with the idf of a term that one document has (the
largest there is): they make it less like any example, whatever else it shares with one.

The labelled examples lie in blocks of examples that share their most common word and their telling terms. The postings of the
commonest terms are kept by block, with each term's largest weight in the block, those of all other terms in one list. A query
sums up the listed terms, which few examples have, bounds each block's cosines by its largest sum and the common terms'
maxima, and reads only the blocks whose bound reaches the k-th cosine found: the k nearest are exact, ties going to the
smaller doc_id. Neighbours vote with their cosines; Platt scaling over the examples' own
leave-one-out votes makes the score a probability. There an example's terms that no other one has are as unknown as those of
any other text, and weigh as much. The evidence is the neighbours' ids.

Training uses at most about `train_rows` labelled documents, chosen by a hash of doc_id; an id with several rows trains with its
smallest text. Null and empty texts and texts without a term of an example have no neighbour and score the share of toxic
examples among such ones. Several labels of a doc_id are averaged; other values and nulls are ignored; without labels every
score is 0. A null doc_id is scored but trains nothing. Repeated rows repeat, extra columns are ignored, an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.base import discard, materialize, pieces, tidy
from tallyspark.llm.quality import labelled

TRAIN_ROWS = 6000
NEIGHBOURS, BLOCK = 15, 256
#: Terms whose postings are tables; queries that are looked up together.
COMMON, BATCH = 256, 64
BEGINNINGS = (3, 4, 5, 6)
#: How much more a term weighs that tells of a label.
TELLING = 1.5
#: A text has a term densely if the term's words are at least this share of its words.
DENSE = 0.005

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, marked by a star."""
    return [word, *(f"{word[:n]}*" for n in BEGINNINGS if len(word) > n)]


def copies_key(words: list[str]) -> int:
    """MinHash of the three-word shingles: near copies mostly share it, other texts hardly ever."""
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def digest_of(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term.encode())


def examples_of(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text, y and `copies` (`copies_key`) of the rows of `docs` with a label in `known` (doc_id, y), one for each doc_id."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([copies_key(words_of(t.as_py())) for t in batch.column(1)], pa.int64())], names=["doc_id", "text", "y", "copies"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return rows.mapInArrow(scan, "doc_id long, text string, y double, copies long")


def telling_terms(examples: DataFrame) -> list[str]:
    """The words and word beginnings that go with a label in `examples`: by the texts that have them at all, or by those that
    have them densely (which finds word beginnings that ordinary long texts also hold now and then)."""
    own = examples.groupBy("copies", (F.col("y") >= 0.5).alias("side")).agg(F.min("doc_id").alias("doc_id"))  # one of each group of near copies
    texts = examples.join(F.broadcast(own.select("doc_id")), "doc_id").select("text", "y")  # bounded by the examples

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kinds = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            for text, y in zip(batch.column(0), batch.column(1), strict=True):
                words = words_of(text.as_py())
                found: Counter[str] = Counter()
                for w, n in Counter(words).items():
                    for t in terms_of(w):
                        found[t] += n
                # 0 to 3: label 0 or 1, and whether the text has the term densely
                hashes.append(np.fromiter(map(digest_of, found), np.uint64, len(found)))
                kinds.append(2 * int(y.as_py() >= 0.5) + (np.fromiter(found.values(), np.int64, len(found)) >= DENSE * len(words)))
        term, at = np.unique(np.concatenate(hashes), return_inverse=True)
        kind = np.concatenate(kinds)
        counts = [np.bincount(at[kind == k], minlength=len(term)) for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), *(pa.array(c.astype(np.int32)) for c in (counts[2] + counts[3], counts[0] + counts[1], counts[3], counts[1]))], names=["term", *"abcd"])

    counted = texts.mapInArrow(scan, "term long, a int, b int, c int, d int").groupBy("term").agg(*(F.sum(x).cast("double").alias(x) for x in "abcd"))
    sides = own.agg(F.count_if("side"), F.count_if(~F.col("side"))).first()
    na, nb = float(sides[0] or 0), float(sides[1] or 0)
    if not na or not nb:
        return []
    part = lambda k, n, p: k * F.log(F.greatest(p, F.lit(1e-300))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-300)))

    def ratio(a: Column, b: Column) -> Column:
        """Likelihood ratio of a term's two shares against one share for both."""
        both = (a + b) / (na + nb)
        return 2 * (part(a, F.lit(na), a / na) + part(b, F.lit(nb), b / nb) - part(a, F.lit(na), both) - part(b, F.lit(nb), both))

    a, b, c, d = (F.col(x) for x in "abcd")
    either = F.greatest(F.when((a >= b) | (a / na < b / nb), ratio(a, b)), F.when(c >= d, ratio(c, d)))
    judged = materialize(counted.filter("a + b >= 3").select("term", either.alias("ratio")))
    bound = 2 * math.log(max(1, 2 * judged.count()) / 0.05)  # two tests a term
    told = {r["term"] & _ALL for r in judged.filter(F.col("ratio") >= bound).select("term").collect()}  # bounded by the examples

    @tidy
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {t for batch in batches for text in batch.column(0) for w in set(words_of(text.as_py())) for t in terms_of(w) if digest_of(t) in told}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], names=["term"])

    discard(judged)
    return sorted(r[0] for r in texts.select("text").mapInArrow(spell, "term string").distinct().collect()) if told else []


_ALL = (1 << 64) - 1


def term_counter(telling: list[str]) -> Callable[[str | None], tuple[np.ndarray, np.ndarray]]:
    """A function that gives a text's terms, as 64-bit hashes, and their counts."""
    known, firsts = frozenset(telling), frozenset(t[: BEGINNINGS[0]] for t in telling if t.endswith("*"))

    def count(text: str | None) -> tuple[np.ndarray, np.ndarray]:
        found = Counter(words_of(text))
        begun: Counter[str] = Counter()
        for w, n in found.items():
            if w[: BEGINNINGS[0]] in firsts:
                for t in terms_of(w)[1:]:
                    if t in known:
                        begun[t] += n
        found.update(begun)
        return np.fromiter(map(digest_of, found), np.uint64, len(found)), np.fromiter(found.values(), np.int32, len(found))

    return count


def example_terms(examples: DataFrame, telling: list[str]) -> list[tuple[int, float, np.ndarray, np.ndarray]]:
    """(doc_id, y, terms, counts) of each row of `examples` (doc_id, text, y), by doc_id. They are bounded."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = term_counter(telling)
        for batch in batches:
            cells = [tuple(a.tobytes() for a in count(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([c[i] for c in cells], pa.binary()) for i in (0, 1))], names=["doc_id", "y", "terms", "counts"])

    rows = examples.select("doc_id", "text", "y").mapInArrow(scan, "doc_id long, y double, terms binary, counts binary").collect()
    return sorted(((r["doc_id"], r["y"], np.frombuffer(r["terms"], np.uint64), np.frombuffer(r["counts"], np.int32)) for r in rows), key=lambda r: r[0])


def placed(terms: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the terms in the sorted `vocabulary`, and which of them are there."""
    at = np.searchsorted(vocabulary, terms)
    at[at == len(vocabulary)] = 0
    return at, vocabulary[at] == terms if len(vocabulary) else np.zeros(len(terms), bool)


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray, telling: list[str]) -> tuple[np.ndarray, int]:
    """In how many rows of `docs` each term of the vocabulary is, and the number of rows."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, rows = term_counter(telling), np.zeros(len(held.value), np.int64), 0
        for batch in batches:
            rows += len(batch)
            for text in batch.column(0):
                at, there = placed(count(text.as_py())[0], held.value)
                total[at[there]] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], rows))], names=["term", "n"])

    found = docs.select("text").mapInArrow(scan, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # bounded by the examples' terms
    df, own = np.zeros(len(vocabulary), np.int64), found["term"].to_numpy() >= 0
    df[found["term"].to_numpy()[own]] = found["n"].to_numpy()[own]
    return df, int(found["n"].to_numpy()[~own].sum())


def unit(terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, unknown: np.ndarray | None = None, largest: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The unit vector of a text's terms (their numbers) and counts, where it also has terms outside (`unknown`: their counts),
    which weigh `largest` and count for its length alone."""
    w = (1 + np.log(counts)) * idf[terms]
    outside = (1 + np.log(unknown)) * largest if unknown is not None else np.zeros(0)
    return terms, w / max(np.sqrt((w * w).sum() + (outside * outside).sum()), 1e-300)


def _spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(begin - (end - size), size)


@dataclass
class Index:
    """Labelled examples with a vector, in blocks of `BLOCK`.

    The postings of the `COMMON` terms that most examples have are laid out as a table for each block, with each term's
    maximum in the block; those of all other terms lie in one list by term.
    """

    ids: np.ndarray
    y: np.ndarray
    column: np.ndarray  # of each term: its column among the common ones, or -1
    table: np.ndarray  # examples by common terms
    top: np.ndarray  # blocks by common terms: the maxima
    begin: np.ndarray  # of each term: where its postings begin in the list, and the end
    place: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, rows: list[tuple[int, float, np.ndarray, np.ndarray]], idf: np.ndarray, told: np.ndarray) -> Index:
        """Rows (id, y, terms, weights); `told` marks the telling terms. Like examples share blocks, which tightens the bounds."""
        alike = lambda r: (int(r[2][np.argmin(idf[r[2]])]), tuple(r[2][told[r[2]]].tolist()), r[0])
        rows = sorted((r for r in rows if len(r[2])), key=alike)
        term = np.concatenate([np.zeros(0, np.int64), *(r[2] for r in rows)])
        weight = np.concatenate([np.zeros(0), *(r[3] for r in rows)])
        place = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
        n = np.bincount(term, minlength=len(idf))
        common = np.argsort(-n, kind="stable")[:COMMON]
        column = np.full(len(idf), -1, np.int64)
        column[common] = np.arange(len(common))
        often = column[term] >= 0
        table = np.zeros((len(rows), len(common)))
        table[place[often], column[term[often]]] = weight[often]
        order = np.flatnonzero(~often)[np.argsort(term[~often], kind="stable")]
        begin = np.concatenate([[0], np.cumsum(np.bincount(term[order], minlength=len(idf)))])
        top = np.maximum.reduceat(table, np.arange(0, len(rows), BLOCK)) if len(rows) else table
        return cls(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float), column, table, top, begin, place[order].astype(np.int32), weight[order])

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query (terms, weights): cosines and places of the k nearest examples with a positive cosine, by cosine and
        then id; `without` names an example (a place, or -1) that each query leaves out."""
        n = len(self.ids)
        if not n:
            return [(np.zeros(0), np.zeros(0, np.int64))] * len(queries)
        part, asked = np.zeros((len(queries), n)), np.zeros((len(queries), self.table.shape[1]))
        for i, (terms, weights) in enumerate(queries):
            at = self.column[terms]
            asked[i, at[at >= 0]] = weights[at >= 0]
            terms, weights = terms[at < 0], weights[at < 0]
            size = self.begin[terms + 1] - self.begin[terms]
            entry = _spans(self.begin[terms], size)
            part[i] = np.bincount(self.place[entry], np.repeat(weights, size) * self.weight[entry], minlength=n)
        # a block's bound: its largest sum over the listed terms, and the common terms' maxima
        starts = np.arange(0, n, BLOCK)
        bound = np.maximum.reduceat(part, starts, axis=1) + asked @ self.top.T
        cosine, kth = np.full((len(queries), n), -1.0), np.zeros(len(queries))
        for b in np.argsort(-bound.mean(0), kind="stable"):
            rows, own = np.flatnonzero((bound[:, b] > 0) & (bound[:, b] >= kth - 1e-8)), slice(starts[b], starts[b] + BLOCK)
            if not len(rows):
                continue
            found = np.round(part[rows, own] + asked[rows] @ self.table[own].T, 9)
            if without is not None:
                hit = np.flatnonzero(without[rows] // BLOCK == b)
                found[hit, without[rows[hit]] - starts[b]] = -1
            cosine[rows, own] = found
            if found.shape[1] > k:
                kth[rows] = np.maximum(kth[rows], np.partition(found, -k, axis=1)[:, -k])
        if n > k:
            kth = np.partition(cosine, -k, axis=1)[:, -k]
        out = []
        for i in range(len(queries)):
            near = np.flatnonzero((cosine[i] > 0) & (cosine[i] >= kth[i]))
            near = near[np.lexsort((self.ids[near], -cosine[i, near]))[:k]]
            out.append((cosine[i, near], near))
        return out


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Weights of a logistic regression (Newton steps, a small ridge)."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Scorer:
    index: Index
    vocabulary: np.ndarray
    idf: np.ndarray
    calibration: np.ndarray
    alone: float
    largest: float  # idf of a term that no example has

    def seen(self, cosine: np.ndarray, place: np.ndarray) -> np.ndarray:
        """What the calibration sees: the neighbours' vote, weighted by their cosines, and the nearest one's cosine."""
        return np.array([1.0, float(cosine @ self.index.y[place] / cosine.sum()), cosine[0]])

    def __call__(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """Score and evidence of each text's terms and counts."""
        queries = []
        for terms, counts in texts:
            at, there = placed(terms, self.vocabulary)
            queries.append(unit(at[there], counts[there], self.idf, counts[~there], self.largest))
        out = []
        for cosine, place in self.index.nearest(queries):
            p = float(1 / (1 + np.exp(-np.clip(self.seen(cosine, place) @ self.calibration, -30, 30)))) if len(cosine) else self.alone
            out.append((p, self.index.ids[place].tolist()))
        return out


def fit(rows: list[tuple[int, float, np.ndarray, np.ndarray]], vocabulary: np.ndarray, idf: np.ndarray, told: np.ndarray, largest: float) -> Scorer:
    """A scorer from the examples (doc_id, y, terms, counts), calibrated on their votes without themselves."""
    numbers = [np.searchsorted(vocabulary, t) for _, _, t, _ in rows]
    index = Index.build([(i, y, *unit(t, c, idf)) for (i, y, _, c), t in zip(rows, numbers, strict=True)], idf, told)
    scorer = Scorer(index, vocabulary, idf, np.zeros(3), 0.0, largest)
    shared = np.bincount(np.concatenate([np.zeros(0, np.int64), *numbers]), minlength=len(vocabulary)) > 1
    x, y, alone = [], [], []
    where = dict(zip(index.ids.tolist(), range(len(index.ids)), strict=True))
    for b in range(0, len(rows), BATCH):
        own = rows[b : b + BATCH]
        queries = [unit(t[shared[t]], c[shared[t]], idf, c[~shared[t]], largest) for (_, _, _, c), t in zip(own, numbers[b : b + BATCH], strict=True)]
        found = index.nearest(queries, without=np.array([where.get(i, -1) for i, *_ in own], np.int64))
        for (_, label, *_), near in zip(own, found, strict=True):
            if len(near[0]):
                x.append(scorer.seen(*near))
                y.append(label)
            else:
                alone.append(label)
    scorer.alone = float(np.mean(alone)) if alone else 0.0
    if x:
        scorer.calibration = platt(np.array(x), np.array(y))
    return scorer


def learn(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS) -> tuple[Scorer, list[str]]:
    """A scorer and the telling terms, from the labelled rows of `docs` and the document frequencies of all."""
    known = materialize(labelled(labels, "toxic", usable, train_rows))
    examples = materialize(examples_of(docs, known))
    telling = telling_terms(examples)
    rows = example_terms(examples, telling)
    discard(known, examples)
    vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *(r[2] for r in rows)]))
    df, n = document_frequencies(docs, vocabulary, telling)
    told = np.zeros(len(vocabulary), bool)
    at, there = placed(np.array([digest_of(t) for t in telling], np.uint64), vocabulary)
    told[at[there]] = True
    idf = (np.log((n + 1) / (df + 1)) + 1) * np.where(told, TELLING, 1.0)
    return fit(rows, vocabulary, idf, told, math.log((n + 1) / 2) + 1), telling


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, score and `evidence` (ids of the nearest examples, nearest first) of every row of `docs`."""
    scorer, telling = learn(docs, labels, usable, train_rows)
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = term_counter(telling)
        for batch in pieces(batches):
            terms = [count(t.as_py()) for t in batch.column(1)]
            rows = [r for i in range(0, len(terms), BATCH) for r in held.value(terms[i : i + BATCH])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["doc_id", "score", "evidence"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(score, T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.LongType()))]))
