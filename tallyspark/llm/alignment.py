"""Cross-tokenizer alignment by distinct segments.

A text with a space before it is tokenised by a byte-level vocabulary (A) and a piece vocabulary (B), which puts that space
there itself. Texts are cut into segments before runs of white space, at characters across which neither can merge: A's
pre-tokens never hold white space after anything else (its pre-tokenizer is checked), and no piece of B holds the run's first
character after another one (all pieces are checked; spaces may follow spaces). So the tokens of a text are those of its
segments, in order, and segments recur.

1. Tasks cut texts into blocks of some megabytes. A text becomes the numbers of its segments in its block's dictionary; both
   are written once.
2. The dictionaries are shuffled by segment, and each distinct one is tokenised and aligned once, beside the places that it
   goes back to. The ends of its tokens in both vocabularies, merged, cut its bytes into pieces that lie in one token of each:
   one piece for each link. Common ends cut groups.
3. Links are counted over the corpus by segment frequencies, and a segment's links get these counts: from a broadcast table
   up to `LOOKED_UP` counts, by a join beyond.
4. Alignments go back to their blocks, packed by block, and a block's texts are composed of them.

A frequent segment has one row in each block, whatever its occurrences, and its places are written in lists of a batch at most;
a frequent link is counted in parts before it is shuffled. A block is bounded but for a single text that is longer.

Null and empty texts have no tokens, nor have texts that B's normaliser changes or whose bytes B can't give back (U+2581 reads
as a space): zeros and no groups, and they count for no link. Repeated rows and ids are composed each by itself and count each
time. Extra columns are ignored. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.base import held, materialize, passes, release, tidy, trim, utf8
from tallyspark.llm.tokencounts import byte_symbols

VOCABULARY_A = public_tokenizers.path("byte_bpe_50k.json")
VOCABULARY_B = public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text in a block.
BLOCK = 20 << 20
#: Counts of links up to which they are broadcast (17 bytes each).
LOOKED_UP = 2_000_000
#: What stands for a space in B's pieces.
_MARK = "▁"
#: White space in any sense, for what must stand on neither side of a cut unnoticed.
_SPACES = r"\s᠎​﻿"


class Vocabularies:
    """Both tokenizers, their tokens' bytes, and the cut of texts into segments."""

    def __init__(self, a: str, b: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        held_a = json.loads(a)
        before = held_a["pre_tokenizer"] or {}
        if held_a["normalizer"] or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
            raise ValueError("the first vocabulary must be byte-level, cut by its own pattern and not normalised")
        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        byte = {s: i for i, s in enumerate(byte_symbols())}
        size_a = max(max(held_a["model"]["vocab"].values()), *(t["id"] for t in held_a["added_tokens"])) + 1
        self.bytes_a = [b""] * size_a
        for symbols, i in held_a["model"]["vocab"].items():
            if all(s in byte for s in symbols):
                self.bytes_a[i] = bytes(byte[s] for s in symbols)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(_MARK)
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = "".join(c for c, s in ((" ", _MARK), ("\n", "\n"), ("\t", "\t")) if not any(s in (p.lstrip(s) if c == " " else p[1:]) for p in plain))
        # white space, then what isn't, with any white space within that can't be cut before
        kept = rf"(?![{self.cuts}])[{_SPACES}]" if self.cuts else rf"[{_SPACES}]"
        self.segment = re.compile(rf"[{_SPACES}]*[^{_SPACES}]+(?:{kept}[{_SPACES}]*(?:[^{_SPACES}]+|\Z))*|[{_SPACES}]+")

    def segments(self, text: str) -> list[str]:
        """The segments of a text with a space before it; none if the text has no tokens."""
        if not text or _MARK in text or self.b.normalize(text) != _MARK + text.replace(" ", _MARK):
            return []
        return self.segment.findall(" " + text)

    def tokens(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B. B's own space stands for a segment's first one; before other white space it is a token to drop."""
        a = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        b = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        b = [ids[1:] if s[0] != " " else ids or [self.mark] for s, ids in zip(segments, b, strict=True)]
        for s, x, y in zip(segments, a, b, strict=True):
            raw = s.encode()
            if b"".join([self.bytes_a[i] for i in x]) != raw or b"".join([self.bytes_b[i] for i in y]) != raw:
                raise ValueError(f"the tokens of {s[:100]!r} don't give back its bytes")
        return a, b


@lru_cache(maxsize=1)
def _opened(a: str, b: bytes) -> Vocabularies:
    return Vocabularies(a, b)


def aligned(a: list[list[int]], b: list[list[int]], size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of many segments at once: ids of A, ids of B, and each segment's number of links.

    The segments' bytes are laid end to end. A merged end of tokens closes one link: that of the tokens which hold the byte
    before it.
    """
    flat_a, flat_b = np.concatenate([np.array(x, np.int64) for x in a]), np.concatenate([np.array(x, np.int64) for x in b])
    ends_a, ends_b = np.cumsum(size_a[flat_a]), np.cumsum(size_b[flat_b])
    ends = np.union1d(ends_a, ends_b)
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    last = ends_a[np.cumsum([len(x) for x in a]) - 1]
    n = np.diff(np.searchsorted(ends, last, side="right"), prepend=0)
    return flat_a[at_a], flat_b[at_b], n


def group_text(a: list[int], b: list[int], size_a: list[int], size_b: list[int]) -> str:
    """A segment's groups, as `a1,a2|b1;a3|b2,b3`."""
    if len(a) == 1 or len(b) == 1:
        return f"{','.join(map(str, a))}|{','.join(map(str, b))}"
    groups, i, j, first_i, first_j, at_a, at_b = [], 0, 0, 0, 0, 0, 0
    while i < len(a):
        if at_a <= at_b:
            at_a += size_a[a[i]]
            i += 1
        while at_b < at_a and j < len(b):
            at_b += size_b[b[j]]
            j += 1
        if at_a == at_b:
            groups.append(f"{','.join(map(str, a[first_i:i]))}|{','.join(map(str, b[first_j:j]))}")
            first_i, first_j = i, j
    return ";".join(groups)


def _pack(codes: np.ndarray) -> bytes:
    return zstandard.compress(codes.astype("<i4").tobytes(), 1) if len(codes) else b""


def _unpack(cell: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(cell) if cell else b"", "<i4")


def encode(docs: DataFrame, a: str, b: bytes, block: int = BLOCK) -> DataFrame:
    """Texts as numbers of segments. Rows of a text: number of its block, doc_id, codes (32-bit numbers, compressed); rows of a
    block's dictionary: block, code, segment, n (its occurrences)."""
    rows = docs.select("doc_id", "text")
    id_field = rows.schema["doc_id"]
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_id", id_field.dataType), T.StructField("codes", T.BinaryType()), T.StructField("code", T.IntegerType()), T.StructField("segment", T.StringType()), T.StructField("n", T.LongType())])

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _opened(a, b)
        number = TaskContext.get().partitionId() << 32
        code: dict[str, int] = {}
        used: list[np.ndarray] = []
        size = 0

        def dictionary() -> Iterator[pa.RecordBatch]:
            n = np.bincount(np.concatenate(used), minlength=len(code)) if code else np.zeros(0, np.int64)
            for i, batch in enumerate(pa.table({"segment": pa.array(list(code), pa.string()), "n": pa.array(n, pa.int64())}).to_batches(50_000)):
                k = len(batch)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), pa.nulls(k, kind), pa.nulls(k, pa.binary()), pa.array(np.arange(k, dtype=np.int32) + 50_000 * i), batch.column(0), batch.column(1)], names=schema.names)

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for first, last in passes(utf8(batch.column(1))[1]):
                part = batch.slice(first, last - first)
                coded = []
                for text in part.column(1).to_pylist():
                    found = words.segments(text) if text else []
                    for s in set(found).difference(code):
                        code[s] = len(code)
                    coded.append(np.fromiter(map(code.__getitem__, found), np.int32, len(found)))
                used += coded
                k = len(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), part.column(0), pa.array([_pack(c) for c in coded], pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names=schema.names)
                size += int(np.diff(utf8(part.column(1))[1]).sum())
                if size >= block:
                    yield from dictionary()
                    code, used, size, number = {}, [], 0, number + 1
        if code:
            yield from dictionary()

    return rows.mapInArrow(scan, schema)


_ALIGNED = "sid long, n long, groups string, n_a int, links array<long>, blocks array<long>, codes array<int>"


def align_segments(words: DataFrame, a: str, b: bytes) -> DataFrame:
    """The distinct segments of dictionaries (segment, block, code, n), each with a number, its occurrences, groups, number of
    A's tokens, links (A's id times 2^32 plus B's) and places. A segment of very many blocks gets several rows."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabularies = _opened(a, b)
        list_a, list_b = [len(x) for x in vocabularies.bytes_a], [len(x) for x in vocabularies.bytes_b]
        size_a, size_b = np.array(list_a), np.array(list_b)
        sid = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(0).to_pylist()
            begins = [i for i, t in enumerate(texts) if not i or t != texts[i - 1]]
            ids_a, ids_b = vocabularies.tokens([texts[i] for i in begins])
            from_a, from_b, n = aligned(ids_a, ids_b, size_a, size_b)
            places = pa.array(np.append(begins, len(texts)), pa.int32())
            links = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array((from_a << 32) + from_b))
            groups = [group_text(x, y, list_a, list_b) for x, y in zip(ids_a, ids_b, strict=True)]
            columns = [pa.array(np.arange(len(begins)) + sid), pa.array(np.add.reduceat(batch.column(3).to_numpy(), begins)), pa.array(groups, pa.string()), pa.array([len(x) for x in ids_a], pa.int32()), links]
            columns += [pa.ListArray.from_arrays(places, batch.column(1)), pa.ListArray.from_arrays(places, batch.column(2))]
            yield pa.RecordBatch.from_arrays(columns, names=["sid", "n", "groups", "n_a", "links", "blocks", "codes"])
            sid += len(begins)

    dealt = words.select("segment", "block", "code", "n").repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(scan, _ALIGNED)


def link_counts(found: DataFrame) -> DataFrame:
    """link, its count over the corpus, and best: 1 if no other link of its B id has more."""
    counted = found.select("n", F.explode("links").alias("link")).groupBy("link").agg(F.sum("n").alias("count"))
    counted = held(counted.withColumn("id_b", F.col("link").bitwiseAND(F.lit(0xFFFFFFFF))))
    most = counted.groupBy("id_b").agg(F.max("count").alias("most"))
    return counted.join(most, "id_b").select("link", "count", (F.col("count") == F.col("most")).cast("int").alias("best"))


_BACK = "block long, packed binary"
_FACTS = ("n_a", "n_links", "n_best", "count_sum", "groups")
#: Places that are packed together.
_TOGETHER = 500_000


def _by_block(blocks: np.ndarray, codes: np.ndarray, facts: pa.Array, row: np.ndarray) -> pa.RecordBatch:
    """One row for each block: its codes and their facts (of `row`), compressed. A place alone takes little more than itself."""
    order = np.argsort(blocks, kind="stable")
    begins = np.flatnonzero(np.diff(blocks[order], prepend=-1))
    packed = []
    for at in np.split(order, begins[1:]):
        text = "\n".join(facts.take(pa.array(row[at])).to_pylist()).encode()
        packed.append(zstandard.compress(np.array([len(at)], "<i4").tobytes() + codes[at].astype("<i4").tobytes() + text, 1))
    return pa.RecordBatch.from_arrays([pa.array(blocks[order][begins]), pa.array(packed, pa.binary())], names=["block", "packed"])


def _unpacked(cells: list[bytes]) -> tuple[np.ndarray, list[str]]:
    codes, facts = [np.zeros(0, "<i4")], []
    for cell in map(zstandard.decompress, cells):
        n = int(np.frombuffer(cell, "<i4", 1)[0])
        codes.append(np.frombuffer(cell, "<i4", n, 4))
        facts += cell[4 + 4 * n :].decode().split("\n")
    return np.concatenate(codes), facts


def looked_up(found: DataFrame, counts: DataFrame) -> DataFrame:
    """What goes back to the blocks: codes with their facts (`n_a:n_links:n_best:count_sum:groups`), packed; sums over links come
    from a broadcast table of all counts."""
    table = counts.orderBy("link").toArrow()
    table = found.sparkSession.sparkContext.broadcast(tuple(table[c].to_numpy() for c in ("link", "count", "best")))

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, count, best = table.value
        kept: list[tuple] = []
        size = rows = 0

        def flush() -> pa.RecordBatch:
            return _by_block(np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept]), pa.concat_arrays([k[2] for k in kept]), np.concatenate([k[3] for k in kept]))

        for batch in batches:
            groups, n_a, links, blocks, codes = batch.columns
            ends = np.cumsum(links.value_lengths().to_numpy())
            at = np.searchsorted(link, links.flatten().to_numpy())
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)[ends - 1]])) for v in (count[at], best[at].astype(np.int64))]
            told = pc.binary_join_element_wise(*(pa.array(v).cast(pa.string()) for v in (n_a, links.value_lengths(), sums[1], sums[0])), groups, ":")
            kept.append((blocks.flatten().to_numpy(), codes.flatten().to_numpy(), told, np.repeat(np.arange(len(batch)), blocks.value_lengths().to_numpy()) + rows))
            size, rows = size + len(kept[-1][0]), rows + len(batch)
            if size >= _TOGETHER:
                yield flush()
                kept, size, rows = [], 0, 0
        if kept:
            yield flush()

    return found.select("groups", "n_a", "links", "blocks", "codes").mapInArrow(scan, _BACK)


def joined(found: DataFrame, counts: DataFrame) -> DataFrame:
    """The same by joins, whatever the number of counts."""
    of_links = found.select("sid", F.explode("links").alias("link")).join(counts, "link")
    sums = of_links.groupBy("sid").agg(F.count("*").cast("int").alias("n_links"), F.sum("best").cast("int").alias("n_best"), F.sum("count").alias("count_sum"))

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, codes, facts = batch.columns
            row = np.repeat(np.arange(len(batch)), blocks.value_lengths().to_numpy())
            if len(row):
                yield _by_block(blocks.flatten().to_numpy(), codes.flatten().to_numpy(), facts, row)

    rows = found.select("sid", "groups", "n_a", "blocks", "codes").join(sums, "sid")
    return rows.select("blocks", "codes", F.concat_ws(":", *_FACTS).alias("facts")).mapInArrow(scan, _BACK)


_SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _composed(texts: pa.Table, words: pa.Table) -> pa.Table:
    """The texts of one block from its dictionary. A segment's groups tell how many there are, and how many tokens."""
    codes, facts = _unpacked(words["packed"].to_pylist())
    facts = pa.array(facts, pa.string()).take(pa.array(np.argsort(codes)))
    parts = pc.split_pattern(facts, ":", max_splits=4).flatten()
    parts = {c: parts.take(pa.array(np.arange(i, len(parts), 5))) for i, c in enumerate(_FACTS)}
    value = {c: v.cast(pa.int64()).to_numpy() for c, v in parts.items() if c != "groups"}
    value["n_groups"] = pc.count_substring(parts["groups"], "|").to_numpy().astype(np.int64)
    value["n_b"] = pc.count_substring(parts["groups"], ",").to_numpy() + 2 * value["n_groups"] - value["n_a"]
    groups = parts["groups"].to_numpy(zero_copy_only=False) if len(facts) else np.zeros(0, object)
    codes = [_unpack(c) for c in texts["codes"].to_pylist()]
    flat = np.concatenate([np.zeros(0, np.int32), *codes])
    ends = np.cumsum([0, *map(len, codes)])
    out = {"doc_id": texts["doc_id"]} | {c: pa.array(np.diff(np.concatenate([[0], np.cumsum(value[c][flat])])[ends])) for c in _SUMS}
    return pa.table(out | {"groups": pa.array([";".join(groups[k]) for k in codes], pa.string())})


def _compose(texts: pa.Table, words: pa.Table) -> pa.Table:
    out = _composed(texts, words)
    trim()
    return out


def align(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and `groups` (`a1,a2|b1;a3|b2,b3`) of each text."""
    file_a, file_b = Path(a).read_text(encoding="utf-8"), Path(b).read_bytes()
    encoded = materialize(encode(docs, file_a, file_b, block), "zstd")
    found = materialize(align_segments(encoded.filter("segment is not null"), file_a, file_b), "zstd")
    release(docs.sparkSession)
    counts = held(link_counts(found))
    back = (looked_up if counts.count() <= LOOKED_UP else joined)(found, counts)
    texts = encoded.filter("segment is null").select(F.col("block").alias("of_block"), "doc_id", "codes")
    schema = T.StructType([encoded.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in _SUMS), T.StructField("groups", T.StringType())])
    return texts.groupBy("of_block").cogroup(back.groupBy("block")).applyInArrow(_compose, schema)


def digest(found: DataFrame) -> DataFrame:
    sha = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return found.select("doc_id", *_SUMS, sha.alias("groups_sha256"))
