"""Document fingerprints by improbable features.

Every 64-byte window of a text has an entropy. Over the whole corpus rare entropies rank first, windows of little entropy
last. In each run of 64 neighbouring windows the leftmost window of the best rank gains a point; windows that gain enough are
the text's features. A feature's hash sets five bits of a 2048-bit Bloom filter; a filter takes 160 features, then the next
one of the chain begins. Two digests are as alike as their filters' best normalised overlaps: bits in common beyond those
expected by chance, as a share of the most possible, weighted by bits over the digest with fewer filters.

A text shorter than a window has one feature, all of it. Null and empty texts have none and an empty digest: alike to one
another (1), to nothing else (0). Equal texts have equal fingerprints. In `ring` documents follow one another by descending
doc_id, equal ids by a hash of the text and by text, and the first follows the last; a null doc_id stands alone, the empty text follows it. Repeated rows
repeat, extra columns are ignored, an empty table gives an empty result. Texts are read whole, long ones in segments.

The ring is cut into parts of some megabytes by ranges of doc_id, hash and row, so a doc_id or a text of very many rows is no
group of its own. The cuts are quantiles of a sample of at most `SAMPLE` rows; every row is in the part that they say, and ids
are compared as longs. Within a part each row is followed by the next one. What follows a part's last row is the first row of
the next part: these two are found by aggregates over the keys, and their texts by a join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.base import BROADCAST_ROWS, PASS_BYTES, held, materialize, passes, tidy, utf8

WINDOW, RUN, POINTS = 64, 64, 16
FEATURES, BITS = 160, 2048
#: Bytes of text to a task of the ring, about, and parts to a task; rows that the cuts are taken from.
TASK_BYTES, PARTS, SAMPLE = 64 << 20, 3, 1_000_000
LEVELS, LOW = 1001, 334  # entropies of 0 to 6 bits; below 2 bits is little

_SCALE = 1 << 16
_C_LOG = np.array([c * np.log2(c) if c else 0.0 for c in range(WINDOW + 1)])
#: What a byte's arrival adds to the sum of c log c, by its count before; its departure takes away the same by its count after.
_STEP = np.round(np.diff(_C_LOG) * _SCALE).astype(np.int64)
_TOP = int(_C_LOG[WINDOW] * _SCALE)


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy level (0 to 1000) of the window at each position where one fits.

    A byte's count in the window it joins is the number of its equals in the 63 bytes before it, and in the window it leaves,
    in the 63 bytes after it. So 63 comparisons of the text with itself, shifted, give all counts, and a running sum all entropies.
    """
    n = len(data) - WINDOW + 1
    before, after = np.zeros(len(data), np.uint8), np.zeros(len(data), np.uint8)
    for d in range(1, WINDOW):
        same = (data[d:] == data[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = int(np.round(_C_LOG[np.bincount(data[:WINDOW], minlength=256)] * _SCALE).sum())
    moves = _STEP[before[WINDOW:]] - _STEP[after[: n - 1]]
    total = np.concatenate([[first], first + np.cumsum(moves)])
    return np.clip((_TOP - total) * (LEVELS - 1) // _TOP, 0, LEVELS - 1)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts in one buffer with a window of zeros after each; where each begins, and its number of windows."""
    gap = bytes(WINDOW)
    data = np.frombuffer(gap.join([*texts, b""]) + gap, np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(size + WINDOW)[:-1]]) if len(texts) else size
    return data, begin, np.where(size > 0, np.maximum(1, size - WINDOW + 1), 0)


def segments(data: np.ndarray) -> Iterator[tuple[int, int]]:
    for a in range(0, len(data) - WINDOW + 1, PASS_BYTES):
        yield a, min(a + PASS_BYTES, len(data) - WINDOW + 1)


def _place(at: np.ndarray, begin: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number and offset of positions, and whether a window of the text is there."""
    text = np.searchsorted(begin, at, side="right") - 1
    offset = at - begin[text]
    return text, offset, offset < windows[text]


def histogram(texts: list[bytes]) -> np.ndarray:
    """Windows of the texts at each entropy level."""
    data, begin, windows = laid_out(texts)
    total = np.zeros(LEVELS, np.int64)
    for a, b in segments(data):
        if windows.any():
            _, _, ok = _place(np.arange(a, b), begin, windows)
            total += np.bincount(levels(data[a : b + WINDOW - 1])[ok], minlength=LEVELS)
    return total


def ranks(total: np.ndarray) -> np.ndarray:
    """Each level's rank, rare ones first, levels of little entropy last."""
    order = np.lexsort((-np.arange(LEVELS), total, np.arange(LEVELS) < LOW))
    out = np.empty(LEVELS, np.int64)
    out[order] = np.arange(LEVELS)
    return out


def features(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and 64-bit hash of each text's features, in order, repeats left out."""
    data, begin, windows = laid_out(texts)
    need = np.minimum(POINTS, np.maximum(1, (windows - RUN + 1) // 4))
    found, owner = [], []
    for a, b in segments(data) if windows.any() else ():
        # runs that hold a window of a..b-1 begin up to a run earlier and reach up to a run further
        low, high = max(0, a - RUN + 1), min(b + RUN - 1, len(data) - WINDOW + 1)
        at = np.arange(low, high)
        text, offset, ok = _place(at, begin, windows)
        best = np.where(ok, rank[levels(data[low : high + WINDOW - 1])] << 40, 1 << 60) + np.arange(len(at))
        best = np.concatenate([best, np.full(RUN, 1 << 61)])
        width = 1
        while width < RUN:  # the least of each run, by doubling
            best[:-width] = np.minimum(best[:-width], best[width:])
            width *= 2
        runs = ok & ((offset == 0) | (offset + RUN <= windows[text]))
        runs[b - low :] = False
        points = np.bincount(best[: len(at)][runs] & ((1 << 40) - 1), minlength=len(at))
        chosen = np.flatnonzero((points >= need[text]) & ok)
        chosen = chosen[(chosen >= a - low) & (chosen < b - low)]
        found.append(at[chosen])
        owner.append(text[chosen])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, text = np.concatenate(found), np.concatenate(owner)
    words = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at].view("<u8")
    h = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for i in range(WINDOW // 8):
        h = (h ^ words[:, i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    order = np.lexsort((at, h, text))
    again = (np.diff(text[order]) == 0) & (np.diff(h[order]) == 0)
    keep = np.sort(order[np.concatenate([[True], ~again])]) if len(order) else order
    return text[keep], h[keep]


def digests(texts: list[bytes], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bloom filters (a row of 256 bytes each) of all texts in order, and where each text's chain begins (and the end)."""
    text, h = features(texts, rank)
    n = np.bincount(text, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
    chain = np.concatenate([[0], np.cumsum(-(-n // FEATURES))]).astype(np.int64)
    place = np.arange(len(text)) - np.concatenate([[0], np.cumsum(n)])[text]
    bits = np.zeros((chain[-1], BITS), bool)
    for i in range(5):
        bits[chain[text] + place // FEATURES, ((h >> np.uint64(11 * i)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1), chain


def likeness(filters: np.ndarray, chain: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Likeness of the digests `left[i]` and `right[i]`."""
    count = np.bitwise_count(filters).sum(1, dtype=np.int64)
    out = np.zeros(len(left))
    size = np.diff(chain)
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if size[a] == 0 or size[b] == 0:
            out[i] = float(size[a] == size[b])
            continue
        if size[a] > size[b]:
            a, b = b, a
        # the digest with fewer filters against the other; of two equally long ones, both ways
        ways = [(a, b), (b, a)] if size[a] == size[b] > 1 else [(a, b)]
        out[i] = np.mean([_one_way(filters[chain[x] : chain[x + 1]], count[chain[x] : chain[x + 1]], filters[chain[y] : chain[y + 1]], count[chain[y] : chain[y + 1]]) for x, y in ways])
    return out


def _one_way(f: np.ndarray, nf: np.ndarray, g: np.ndarray, ng: np.ndarray) -> float:
    best = np.zeros(len(f))
    for k in range(len(f)):
        common = np.bitwise_count(f[k] & g).sum(1, dtype=np.int64)
        most, chance = np.minimum(nf[k], ng), nf[k] * ng / BITS
        floor = chance + 0.3 * (most - chance)
        best[k] = max(0.0, np.where(most > floor, (common - floor) / np.maximum(most - floor, 1e-9), (common >= most).astype(float)).max())
    return float(min(1.0, (best * nf).sum() / max(1, nf.sum())))


def written(filters: np.ndarray) -> str:
    """A digest as text: its number of filters and their bytes in hex."""
    return f"{len(filters)}:{filters.tobytes().hex()}"


def entropy_ranks(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Ranks of the entropy levels by their number of windows in all of `docs`, and the bytes of all texts."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS + 1, np.int64)  # the last one counts bytes
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            total[LEVELS] += offsets[-1] - offsets[0]
            raw = data.tobytes() if len(offsets) < 2 else data[offsets[0] : offsets[-1]].tobytes()
            at = (offsets - offsets[0]).tolist()
            for a, b in passes(offsets):
                total[:LEVELS] += histogram([raw[at[i] : at[i + 1]] for i in range(a, b)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1)), pa.array(total)], names=["level", "n"])

    total = np.zeros(LEVELS + 1, np.int64)
    for r in docs.select("text").mapInArrow(scan, "level long, n long").groupBy("level").agg(F.sum("n")).collect():
        total[r[0]] = r[1]
    return ranks(total[:LEVELS]), int(total[LEVELS])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its `fingerprint`, one row for each row of `docs`."""
    known = docs.sparkSession.sparkContext.broadcast(entropy_ranks(docs)[0])

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            out = []
            for a, b in passes(offsets):
                filters, chain = digests(texts[a:b], known.value)
                out += [written(filters[chain[i] : chain[i + 1]]) for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(scan, T.StructType([rows.schema["doc_id"], T.StructField("fingerprint", T.StringType())]))


_KEY = np.dtype([("a", "<i8"), ("b", "<i8"), ("c", "<i8")])


def _keys(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), _KEY)
    out["a"], out["b"], out["c"] = a, b, c
    return out


def cuts_of(rows: DataFrame, parts: int) -> np.ndarray:
    """Where the parts but the first begin: keys (a, b, c) at even steps of a sample."""
    want, n = min(20 * parts, SAMPLE), rows.count()
    share = int(min(1.0, want / max(1, n)) * (1 << 32))
    some = rows.filter(F.pmod(F.xxhash64("c", F.lit(3)), F.lit(1 << 32)) < share).select("a", "b", "c").toPandas()  # bounded by SAMPLE, about
    keys = np.sort(_keys(*(some[c].to_numpy(np.int64) for c in "abc")))
    return np.unique(keys[np.linspace(0, len(keys) - 1, parts + 1)[1:-1].astype(np.int64)]) if len(keys) else keys


def ring(docs: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(part, doc_id, text) in the ring's order within each part, parts within partitions; and (doc_id, text, next) of the parts'
    last rows, which the former don't tell what follows them. Rows with a null doc_id are in neither."""
    rows = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # equal rows may be in different parts, as it doesn't matter which of them is where
    rows = rows.select("*", F.bitwise_not(F.col("doc_id").cast("long")).alias("a"), F.xxhash64("text").alias("b"), F.xxhash64(F.monotonically_increasing_id()).alias("c"))
    cuts = docs.sparkSession.sparkContext.broadcast(cuts_of(rows, PARTS * tasks))

    @F.pandas_udf("long")
    def part_of(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, _keys(a.to_numpy(), b.to_numpy(), c.to_numpy()), side="right"))

    placed = rows.withColumn("part", part_of("a", "b", "c"))
    key = F.struct("a", "b", "c")
    ends = held(placed.groupBy("part").agg(F.min(key).alias("head"), F.max(key).alias("tail")))
    every = Window.orderBy("part")  # one row for each part
    first = F.first("head").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    met = held(ends.select("tail", F.coalesce(F.lead("head").over(every), first).alias("head")))
    wanted = met.select(F.col("tail").alias("key")).union(met.select("head")).distinct()
    wanted = F.broadcast(wanted) if met.count() <= BROADCAST_ROWS else wanted
    texts = materialize(rows.withColumn("key", key).join(wanted, "key").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")))
    lasts = met.join(texts.withColumnRenamed("key", "tail"), "tail").join(texts.select(F.col("key").alias("head"), F.col("text").alias("next")), "head")
    dealt = placed.select("part", "doc_id", "text", "b").repartition(tasks, "part").sortWithinPartitions("part", F.desc("doc_id"), "b", "text")
    return dealt.select("part", "doc_id", "text"), lasts.select("doc_id", "text", "next")


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edit_study(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likenesses to the edited text's and the next document's.

    The edited text has its last third (rounded down) of code points replaced by the first as many of the next document's.
    """
    spark = docs.sparkSession
    rank, size = entropy_ranks(docs)
    known = spark.sparkContext.broadcast(rank)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))

    def study(rows: list[tuple[int | None, str, str]], kind: pa.DataType) -> pa.RecordBatch:
        """Rows of (doc_id, text, next text)."""
        edited = []
        for _, text, following in rows:
            cut = len(text) // 3
            edited.append((text[: len(text) - cut] + following[:cut]).encode())
        # the next document is mostly the next row: it is digested once
        texts = [t.encode() for _, t, _ in rows]
        following, others = [], []
        for i, (_, _, f) in enumerate(rows):
            if i + 1 < len(rows) and rows[i + 1][1] is f:
                following.append(i + 1)
            else:
                following.append(2 * len(rows) + len(others))
                others.append(f.encode())
        filters, chain = digests([*texts, *edited, *others], known.value)
        own = np.arange(len(rows))
        fp = [written(filters[chain[i] : chain[i + 1]]) for i in range(2 * len(rows))]
        near_edited, near_next = likeness(filters, chain, own, own + len(rows)), likeness(filters, chain, own, np.array(following, np.int64))
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], kind), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edited]), pa.array(fp[: len(rows)], pa.string()), pa.array(fp[len(rows) :], pa.string()), pa.array(near_edited), pa.array(near_next)],
            names=["doc_id", *(c.split()[0] for c in _OUT.split(", "))],
        )

    @tidy
    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row of a part with the one behind it."""
        within, last, ready, size, kind = None, None, [], 0, None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for part, doc_id, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                part, here = part.as_py(), (doc_id.as_py(), text.as_py())
                if part == within:
                    ready.append((*last, here[1]))
                    size += len(last[1])
                within, last = part, here
                if size >= PASS_BYTES // 2 or len(ready) >= 2000:
                    yield study(ready, kind)
                    ready, size = [], 0
        if ready:
            yield study(ready, kind)

    @tidy
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that say what follows them."""
        for batch in batches:
            for a, b in passes(utf8(batch.column(1))[1], PASS_BYTES // 2):
                part = batch.slice(a, b - a)
                yield study([(i, t or "", n or "") for i, t, n in zip(*(c.to_pylist() for c in part.columns), strict=True)], part.column(0).type)

    inner, lasts = ring(docs, tasks)
    alone = docs.filter("doc_id is null").select("doc_id", "text", F.lit("").alias("next"))
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL(_OUT).fields])
    return inner.mapInArrow(along, schema).union(lasts.mapInArrow(told, schema)).union(alone.mapInArrow(told, schema))
