"""Token counts by rank-synchronous array merging.

A vocabulary file names the merges of symbol pairs by rank. The normalised texts of a pass are cut into pre-tokens; the
distinct ones lie in ragged numpy arrays, one symbol for each byte. In each round every sequence finds its lowest-ranked pair
and merges all places of it at once, left to right; sequences without a pair leave the arrays. What survives is counted. As
each merge makes a symbol that only later merges use (checked when the file is read), this gives what merging one pair after
the other gives.

The library that reads the file serves for what stands before the merges: its own normaliser for texts beyond ASCII, and
its own classes of letters, numbers and white space, asked once for all code points. Strings of special tokens in a text count
as one token each and cut it, as is its default. A null text counts as empty: no bytes, no tokens. Repeated and tied rows are
counted alike, each row by itself; extra columns stay; an empty table gives an empty result. Texts are counted whole: a text
that is longer than a pass is a pass of its own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tallyspark.llm.base import free, passes, tidy, utf8

#: The default vocabulary, and the most tokens of a text that isn't over the limit.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048
#: A rank that no merge has.
_NONE = np.iinfo(np.int32).max
#: Bytes of text whose pre-tokens are merged together.
_PASS = 2 << 20


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next one from U+0100 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in itself else chr(next(others)) for b in range(256)]


@dataclass(frozen=True)
class Merges:
    """Merges as arrays: `keys` (left * size + right, ascending) with their `ranks`; `made` has each rank's symbol. `inner` and
    `final` have the symbols of bytes inside a pre-token and at its end."""

    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    inner: np.ndarray
    final: np.ndarray
    size: int

    @classmethod
    def of(cls, model: dict) -> Merges:
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        size = max(ids.values()) + 1
        joined = ["".join(p) for p in pairs]
        first = {s: i for i, s in reversed(list(enumerate(joined)))}
        if len(first) < len(joined) or any(first.get(s, -1) >= i for i, p in enumerate(pairs) for s in p):
            raise ValueError("merges that don't make one new symbol each, of earlier ones, can't be applied by rounds")
        keys = np.array([ids[a] * size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        symbols = byte_symbols()
        return cls(keys[order], order.astype(np.int32), np.array([ids[s] for s in joined], np.int32), np.array([ids[s] for s in symbols], np.int32), np.array([ids[s + end] for s in symbols], np.int32), size)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def survivors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, merges: Merges) -> np.ndarray:
    """How many symbols are left of each byte range (none is empty) when no pair can be merged."""
    length = ends - starts
    left = length.copy()  # ranges of one byte are done
    open_ = np.flatnonzero(length > 1)
    size = length[open_]
    first = np.concatenate([[0], np.cumsum(size)])
    row = np.repeat(np.arange(len(open_)), size)
    at = np.arange(first[-1]) - first[row] + starts[open_][row]
    symbol = merges.inner[data[at]]
    symbol[first[1:] - 1] = merges.final[data[ends[open_] - 1]]
    last = np.zeros(len(symbol), bool)
    last[first[1:] - 1] = True

    def ranked(places: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at `places`."""
        found = merges.rank_of(symbol[places], symbol[np.minimum(places + 1, len(symbol) - 1)])
        found[last[places]] = _NONE
        return found

    rank = ranked(np.arange(len(symbol)))
    while len(open_):
        begins = np.flatnonzero(np.concatenate([[True], last[:-1]]))
        least = np.minimum.reduceat(rank, begins)
        size = np.diff(np.append(begins, len(symbol)))
        if (done := least == _NONE).any():
            left[open_[done]] = size[done]
            stay = np.repeat(~done, size)
            open_, least, size = open_[~done], least[~done], size[~done]
            symbol, last, rank = symbol[stay], last[stay], rank[stay]
            if not len(open_):
                break
        hit = rank == np.repeat(least, size)
        # of places that overlap (a run of one symbol) every second one merges, from the left
        after = np.concatenate([[False], hit[:-1]])
        if (hit & after).any():
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~after, place, 0))
            hit &= (place - run) % 2 == 0
        into = np.flatnonzero(hit)
        symbol[into] = merges.made[rank[into]]
        last[into] |= last[into + 1]
        stay = np.ones(len(symbol), bool)
        stay[into + 1] = False
        at = np.cumsum(stay)[into] - 1
        symbol, last, rank = symbol[stay], last[stay], rank[stay]
        near = np.zeros(len(symbol), bool)
        near[at] = near[np.maximum(at - 1, 0)] = True
        touched = np.flatnonzero(near)
        rank[touched] = ranked(touched)
    return left


_LETTER, _NUMBER, _SPACE, _SIGN = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point as the library's patterns have it."""
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    all_ = "".join(map(chr, points))
    kind = np.full(0x110000, _SIGN, np.uint8)
    for what, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
        for _, (a, b) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(all_):
            kind[points[a:b]] = what
    return kind


def pre_tokens(points: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens in texts given as code points, lower-cased; texts start at `begins`.

    Runs of letters, single numbers and runs of other signs, without white space between them. An apostrophe that stands alone
    before s, t, m, d, re, ve or ll takes these letters, and the letters behind them are a pre-token of their own.
    """
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _classes()[points]
    cut = np.empty(len(points), bool)
    cut[0] = True
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    cut[begins[begins < len(points)]] = True
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(points))
    alone = np.flatnonzero((points[starts] == ord("'")) & (ends - starts == 1))
    alone = alone[alone + 1 < len(starts)]
    alone = alone[(kind[starts[alone + 1]] == _LETTER) & ~np.isin(starts[alone + 1], begins)]
    if len(alone):
        run = starts[alone + 1]
        a = points[run]
        b = np.where(ends[alone + 1] - run > 1, points[np.minimum(run + 1, len(points) - 1)], 0)
        takes = np.where(np.isin(a, [ord(c) for c in "stmd"]), 1, 0)
        for x, y in ("re", "ve", "ll"):
            takes[(a == ord(x)) & (b == ord(y))] = 2
        alone, takes = alone[takes > 0], takes[takes > 0]
        ends[alone] += takes
        starts[alone + 1] += takes
    good = (kind[np.minimum(starts, len(points) - 1)] != _SPACE) & (starts < ends)
    return starts[good], ends[good]


#: Code points from here on are normalised and lower-cased by the library itself; below, Python does the same.
_FAR = re.compile("[\u0370-\U0010ffff]")
#: Pre-tokens whose counts a task remembers; with more it starts afresh.
_KNOWN = 200_000


@lru_cache(maxsize=2)
def _opened(file: str) -> tuple[Merges, Tokenizer, re.Pattern]:
    held = json.loads(file)
    special = sorted((t["content"] for t in held["added_tokens"]), key=len, reverse=True)
    return Merges.of(held["model"]), Tokenizer.from_str(file), re.compile("|".join(map(re.escape, special)) or r"(?!)")


class Counter:
    """Counts tokens of many texts at once by the vocabulary that `file` (the file's text) holds."""

    def __init__(self, file: str) -> None:
        self.merges, self.library, self.special = _opened(file)
        self.known: dict[str, int] = {}

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return self.library.normalizer.normalize_str(text) if _FAR.search(text) else unicodedata.normalize("NFC", text).lower()

    def learn(self, words: list[str]) -> None:
        """Counts the symbols of pre-tokens that aren't known yet, all at once."""
        if len(self.known) > _KNOWN:
            self.known.clear()
        if new := sorted(set(words).difference(self.known)):
            encoded = [w.encode() for w in new]
            edges = np.cumsum([0, *map(len, encoded)])
            found = survivors(np.frombuffer(b"".join(encoded), np.uint8), edges[:-1], edges[1:], self.merges)
            self.known.update(zip(new, found.tolist(), strict=True))

    def count(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = [text]
            if found := len(self.special.findall(text)):
                total[i] += found
                pieces = self.special.split(text)
            for piece in pieces:
                if piece:
                    parts.append(self.normal(piece))
                    owner.append(i)
        joined = "".join(parts)
        begins = np.cumsum([0, *map(len, parts)])[:-1]
        starts, ends = pre_tokens(np.frombuffer(joined.encode("utf-32-le"), np.uint32), begins)
        if not len(starts):
            return total
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        self.learn(words)
        left = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        of = np.array(owner)[np.searchsorted(begins, starts, side="right") - 1]
        return total + np.bincount(of, left, len(texts)).astype(np.int64)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """`docs` with n_bytes, n_tokens and over_limit; under other names (underscores before them) where `docs` has these."""
    file = Path(vocabulary).read_text(encoding="utf-8")
    names = [free(n, docs.columns) for n in ("n_bytes", "n_tokens", "over_limit")]
    text = docs.columns.index("text")

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(file)
        for batch in batches:
            for first, last in passes(utf8(batch.column(text))[1], _PASS):
                part = batch.slice(first, last - first)
                n = counter.count([t or "" for t in part.column(text).to_pylist()])
                size = np.diff(utf8(part.column(text))[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=[*part.schema.names, *names])

    return docs.mapInArrow(scan, T.StructType([*docs.schema, *(T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.LongType(), T.BooleanType()), strict=True))]))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row."""
    return token_counts(docs.select("doc_id", F.col("text"))).drop("text")
