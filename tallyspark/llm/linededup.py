"""Line dedup: sharded cuckoo filters backed by exact reference-count tables; insertions and deletions are reversible.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased, as a 128-bit hash; a key belongs to one of
the index's shards, of which there are as many as the documents ask for. The exact tables are the postings (of each key and
document how many rows put it there; segments of a folder for each shard) and, of the
keys with `min_docs` references or more, the counts: references and holder, the largest doc_id. Each shard's frequent keys are
in a cuckoo filter too (16-bit tags, four to a bucket, two buckets to a key). To find what documents lose, postings meet their
shard's filter first; what it passes is looked up in the shard's exact counts, so a false positive drops nothing. Postings are
dealt to tasks by shard and a salt of the document, as many salts as the shard's rows ask for, so a line that a third of all
documents share is no group of its own. This runs alike at every size; no filter is collected or broadcast.

Inserting documents adds a segment to the shards of their keys, recounts these keys and puts keys that became frequent into the
shards' filters; deleting documents takes what they put there out of the shards of their keys, recounts, and takes keys that
ceased to be frequent out of the filters. A posting goes when all rows that put it there are gone, so a deletion undoes its
insertion whatever else holds the same doc_id, and whatever came between. What was never inserted takes nothing out. A shard
of `SEGMENTS` segments is written anew as one; a filter that has no room left is built anew from its shard's counts. Shards
without such a key are neither read nor written. An index is a value: the one before an update stays as it was.

A frequent key's lines go from all documents but its holder. Null and empty texts are one empty line, never a key. Keys
count once for a doc_id however many rows or lines repeat them. Rows with a null doc_id hold no key and lose no line. Extra
columns stay. An empty table gives an empty result. Texts are split whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.base import free, materialize, pieces, shared_dir, tidy

MIN_CHARS, MIN_DOCS = 40, 5
#: Documents to a shard of a new index, about, and the fewest shards. A key's shard never changes in an index. A shard's frequent
#: keys, of five postings or more each, are what a task holds.
SHARD_DOCS, SHARDS = 500_000, 16
#: Segments that a shard's postings have at most.
SEGMENTS = 8
#: Parts of a shard's documents that are dealt to tasks apart.
PARTS = 8
#: Postings that a task looks up at once, about.
AT_ONCE = 1 << 19


def key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, if the key has `min_chars` code points."""
    k = line.strip().lower()
    if len(k) < min_chars or not k.isascii() and len(k.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(k)


class Cuckoo:
    """Cuckoo filter over 64-bit hashes: 16-bit tags in buckets of four; a tag's other bucket is its bucket xor the tag's hash."""

    KICKS = 500

    def __init__(self, capacity: int, slots: np.ndarray | None = None):
        size = 1
        while size * 4 * 0.85 < max(1, capacity):
            size *= 2
        self.slots = np.zeros((size, 4), np.uint16) if slots is None else slots.reshape(-1, 4).copy()
        self.mask = len(self.slots) - 1

    @staticmethod
    def tags(hashes: np.ndarray) -> np.ndarray:
        tag = (hashes >> np.uint64(48)).astype(np.uint16)
        return np.where(tag == 0, 1, tag).astype(np.uint16)

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tag = self.tags(hashes)
        first = (hashes & np.uint64(self.mask)).astype(np.int64)
        return tag, first, first ^ self.jump(tag)

    def jump(self, tag: np.ndarray) -> np.ndarray:
        return (tag.astype(np.int64) * 0x5BD1E995 >> 7) & self.mask

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        tag, a, b = self.places(hashes)
        return (self.slots[a] == tag[:, None]).any(1) | (self.slots[b] == tag[:, None]).any(1)

    def insert(self, hashes: np.ndarray) -> bool:
        """False if there was no room for one of them: the filter must then be built anew, larger.

        All that find room in one of their buckets are placed at once; the few others push tags on, one after the other.
        """
        tag, a, b = self.places(hashes)
        self.slots = -np.sort(-self.slots.astype(np.int32), axis=1)  # free slots come last
        for second in (False, True):
            at = b if second else a
            order = np.argsort(at, kind="stable")
            bucket = at[order]
            rank = np.arange(len(bucket)) - np.searchsorted(bucket, bucket)
            slot = (self.slots[bucket] > 0).sum(1) + rank
            fits = slot < 4
            self.slots[bucket[fits], slot[fits]] = tag[order[fits]]
            left = np.sort(order[~fits])
            tag, a, b = tag[left], a[left], b[left]
        self.slots = self.slots.astype(np.uint16)
        return all(self._push(np.uint16(t), int(x)) for t, x in zip(tag, a, strict=True))

    def _push(self, tag: np.uint16, at: int) -> bool:
        for kick in range(self.KICKS):
            slot = kick & 3
            tag, self.slots[at, slot] = self.slots[at, slot], tag
            at ^= int(self.jump(np.array([tag], np.uint16))[0])
            free = np.flatnonzero(self.slots[at] == 0)
            if len(free):
                self.slots[at, free[0]] = tag
                return True
        return False

    def delete(self, hashes: np.ndarray) -> None:
        """Take out hashes that were inserted, one tag each."""
        for tag, a, b in zip(*self.places(hashes), strict=True):
            for place in (int(a), int(b)):
                held = np.flatnonzero(self.slots[place] == tag)
                if len(held):
                    self.slots[place, held[0]] = 0
                    break


def _built(hashes: np.ndarray) -> Cuckoo:
    capacity = len(hashes)
    while not (made := Cuckoo(capacity)).insert(hashes):
        capacity *= 2
    return made


def build_filters(frequent: DataFrame) -> DataFrame:
    """shard and slots: one filter for each shard of the frequent keys (shard, h1)."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [part["shard"].iloc[0]], "slots": [_built(part["h1"].to_numpy().view(np.uint64)).slots.tobytes()]})

    return frequent.select("shard", "h1").groupBy("shard").applyInPandas(build, "shard long, slots binary")


def update_filters(filters: DataFrame, keys: DataFrame) -> DataFrame:
    """The filters after some keys have become frequent (`move` 1) and others have ceased to be (-1). `keys` (shard, h1, move)
    also lists those that stay (0): a filter without room is built anew."""

    def update(old: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        hashes = {m: part.loc[part["move"] == m, "h1"].to_numpy(np.int64).view(np.uint64) for m in (-1, 0, 1)}
        made = Cuckoo(0, np.frombuffer(old["slots"].iloc[0], np.uint16)) if len(old) else None
        if made is not None:
            made.delete(hashes[-1])
        if made is None or not made.insert(hashes[1]):
            made = _built(np.concatenate([hashes[0], hashes[1]]))
        return pd.DataFrame({"shard": [(old if len(old) else part)["shard"].iloc[0]], "slots": [made.slots.tobytes()]})

    return filters.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(update, "shard long, slots binary")


@dataclass
class Table:
    """A table kept by shard: its columns, and the folders of each shard's segments."""

    spark: SparkSession
    schema: T.StructType
    folders: dict[int, tuple[str, ...]] = field(default_factory=dict)

    @classmethod
    def write(cls, rows: DataFrame) -> Table:
        """`rows` (with `shard`) as a new table."""
        spark, path = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/table-{uuid.uuid4().hex}"
        rows.write.partitionBy("shard").parquet(path)
        schema = T.StructType([f for f in rows.schema if f.name != "shard"])
        there = spark.read.schema(T.StructType([*schema, T.StructField("shard", T.LongType())])).parquet(path).select("shard").distinct().collect()  # the shards
        return cls(spark, schema, {r[0]: (f"{path}/shard={r[0]}",) for r in there})

    def read(self, shards: set[int] | None = None) -> DataFrame:
        """The rows of all shards, or of some."""
        paths = [p for s, own in self.folders.items() if shards is None or s in shards for p in own]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replaced(self, shards: set[int], rows: DataFrame) -> Table:
        """The table with other rows in these shards."""
        return Table(self.spark, self.schema, {s: p for s, p in self.folders.items() if s not in shards} | Table.write(rows).folders)

    def joined(self, other: Table) -> Table:
        """The table with the segments of another one too."""
        return Table(self.spark, self.schema, self.folders | {s: self.folders.get(s, ()) + p for s, p in other.folders.items()})


@dataclass
class LineIndex:
    """The exact tables of a corpus' lines, their filters, and what follows from them."""

    postings: Table  # h1, h2, doc_id, n (rows that put the key there, of one segment)
    counts: Table  # h1, h2, refs, holder of the frequent keys
    filters: Table  # slots
    shards: int
    min_chars: int = MIN_CHARS
    min_docs: int = MIN_DOCS

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shards: int | None = None) -> LineIndex:
        shards = shards or max(SHARDS, docs.count() // SHARD_DOCS)
        postings = Table.write(postings_of(docs, min_chars, shards))
        counted = _counted(postings.read()).filter(F.col("refs") >= min_docs)
        counts = Table.write(counted.withColumn("shard", _shard(shards)))
        filters = Table.write(build_filters(counts.read().withColumn("shard", _shard(shards))))
        return cls(postings, counts, filters, shards, min_chars, min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with the lines of `docs` too. A doc_id that it knows gains the lines it lacked."""
        delta = Table.write(postings_of(docs, self.min_chars, self.shards))
        postings = self.postings.joined(delta)
        if full := {s for s in delta.folders if len(postings.folders[s]) >= SEGMENTS}:
            postings = postings.replaced(full, _held(postings, full).withColumn("shard", _shard(self.shards)))
        return self._recounted(postings, delta)

    def delete(self, docs: DataFrame) -> LineIndex:
        """The index without the rows in `docs` (doc_id, and the text that they were inserted with). Without a column `text`
        all shards are looked through for the doc_ids, and all that they hold goes."""
        if "text" in docs.columns:
            delta = Table.write(postings_of(docs, self.min_chars, self.shards))
        else:
            lost = _held(self.postings).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
            delta = Table.write(lost.select("h1", "h2", "doc_id", "n", _shard(self.shards).alias("shard")))
        touched = set(delta.folders)
        less = _held(self.postings, touched).join(delta.read().withColumnRenamed("n", "less"), ["h1", "h2", "doc_id"], "left")
        left = less.select("h1", "h2", "doc_id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n")).filter("n > 0")
        return self._recounted(self.postings.replaced(touched, left.withColumn("shard", _shard(self.shards))), delta)

    def _recounted(self, postings: Table, delta: Table) -> LineIndex:
        """The index over changed postings: the keys of `delta` are counted again, in their shards."""
        touched, shard = set(delta.folders), _shard(self.shards)
        keys = delta.read().select("h1", "h2").distinct()
        now = materialize(_counted(_held(postings, touched).join(keys, ["h1", "h2"], "left_semi")).filter(F.col("refs") >= self.min_docs))
        before = self.counts.read(touched)
        stay = before.join(keys, ["h1", "h2"], "left_anti")
        counts = self.counts.replaced(touched, stay.union(now).withColumn("shard", shard))
        come = now.join(before, ["h1", "h2"], "left_anti").select(shard.alias("shard"), "h1", F.lit(1).alias("move"))
        gone = before.join(keys, ["h1", "h2"], "left_semi").join(now, ["h1", "h2"], "left_anti").select(shard.alias("shard"), "h1", F.lit(-1).alias("move"))
        held = before.join(counts.read(touched), ["h1", "h2"], "left_semi").select(shard.alias("shard"), "h1", F.lit(0).alias("move"))
        filters = self.filters.replaced(touched, update_filters(self.filters_by_shard(touched), held.union(come).union(gone)))
        return LineIndex(postings, counts, filters, self.shards, self.min_chars, self.min_docs)

    def frequent(self) -> DataFrame:
        """The exact counts (h1, h2, refs, holder) of the frequent keys."""
        return self.counts.read()

    def lost(self) -> DataFrame:
        """doc_id, h1 and h2 of the postings whose lines go."""
        spark, shard = self.postings.spark, _shard(self.shards)
        rows = _held(self.postings).select("h1", "h2", "doc_id").withColumn("shard", shard)
        salts = {r[0]: max(1, -(-r[1] // AT_ONCE)) for r in rows.groupBy("shard").count().collect()}  # one for each shard
        parts = F.create_map(*(F.lit(x) for s in salts.items() for x in s)) if salts else F.create_map(F.lit(0), F.lit(1))
        n = F.coalesce(F.element_at(parts, F.col("shard").cast("int")), F.lit(1))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), n).cast("int"))
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        exact = self.counts.read().select(shard.alias("shard"), "h1", "h2", "holder", none("slots", "binary"))
        tags = self.filters_by_shard().select("shard", none("h1", "long"), none("h2", "long"), none("holder", self.counts.schema["holder"].dataType), "slots")
        both = exact.union(tags).withColumn("salt", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)))

        def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
            out = left.select(["doc_id", "h1", "h2"])
            filters = [x for x in right["slots"].to_pylist() if x is not None]
            if not filters:
                return out.slice(0, 0)
            h1 = out["h1"].to_numpy().view(np.uint64)
            out = out.filter(pa.array(Cuckoo(0, np.frombuffer(filters[0], np.uint16)).contains(h1)))
            exact = right.filter(pc.is_valid(right["h1"]))
            holder = exact["holder"].take(_found(*(x[c].to_numpy() for x in (exact, out) for c in ("h1", "h2")))) if len(exact) else None
            gone = pc.less(out["doc_id"], holder) if holder is not None else pa.array([False] * len(out))
            return out.filter(pc.fill_null(gone, False))

        schema = T.StructType([self.postings.schema["doc_id"], T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])
        return salted.groupBy("shard", "salt").cogroup(both.groupBy("shard", "salt")).applyInArrow(look_up, schema)

    def filters_by_shard(self, shards: set[int] | None = None) -> DataFrame:
        """shard and slots of the filters of all shards, or of some."""
        at = F.regexp_extract(F.input_file_name(), r"shard=(\d+)", 1).cast("long")
        return self.filters.read(shards).select(at.alias("shard"), "slots")

    def dropped(self) -> DataFrame:
        """doc_id and the hashes of the keys whose lines it loses."""
        return materialize(self.lost().groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("lost")))

    def clean(self, docs: DataFrame) -> DataFrame:
        """`docs` without the dropped lines, with the columns `n_lines` (before) and `n_dropped`; if `docs` has columns of these
        names, they stay, and the new ones have underscores before their names (`base.free`)."""
        lost, counts = free("lost", docs.columns), [free(c, docs.columns) for c in ("n_lines", "n_dropped")]
        kept = docs.columns
        # both sides are shuffled by doc_id at every size: what is lost grows with the corpus, so it is never broadcast
        joined = docs.join(self.dropped().withColumnRenamed("lost", lost).hint("merge"), "doc_id", "left").select(*kept, lost)
        at, min_chars = kept.index("text"), self.min_chars

        @tidy
        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches):
                texts, lines, gone = [], [], []
                for text, keys in zip(batch.column(at), batch.column(len(kept)), strict=True):
                    parts = (text.as_py() or "").encode().split(b"\n")
                    out = parts
                    if keys.is_valid:
                        drop = {(k["h1"] & _ALL).to_bytes(8, "little") + (k["h2"] & _ALL).to_bytes(8, "little") for k in keys.as_py()}
                        out = [p for p in parts if (h := key(p, min_chars)) is None or h not in drop]
                    texts.append(text.as_py() if len(out) == len(parts) and text.is_valid else b"\n".join(out).decode())
                    lines.append(len(parts))
                    gone.append(len(parts) - len(out))
                columns = [pa.array(texts, batch.column(i).type) if i == at else batch.column(i) for i in range(len(kept))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(gone, pa.int64())], names=[*kept, *counts])

        return joined.mapInArrow(strip, T.StructType([*docs.schema, *(T.StructField(c, T.LongType()) for c in counts)]))


def _shard(shards: int) -> Column:
    return F.pmod("h2", F.lit(shards)).cast("long")


def _found(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.Array:
    """Where each pair of (x, y) is among the pairs of (a, b), which differ; null where it isn't."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    at, end = np.searchsorted(a, x), np.searchsorted(a, x, side="right")
    place = np.full(len(x), -1, np.int64)
    for step in range(int((end - at).max(initial=0))):  # more than one only where halves of keys agree
        here = np.minimum(at + step, len(a) - 1)
        hit = (at + step < end) & (b[here] == y)
        place[hit] = order[here[hit]]
    return pa.array(place, mask=place < 0)


def _held(postings: Table, shards: set[int] | None = None) -> DataFrame:
    """h1, h2, doc_id and n, one row for each key and document; summed up where a shard has several segments."""
    rows = postings.read(shards)
    if all(len(p) == 1 for s, p in postings.folders.items() if shards is None or s in shards):
        return rows
    return rows.groupBy("h1", "h2", "doc_id").agg(F.sum("n").alias("n"))


def _counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.max("doc_id").alias("holder"))


_ALL = (1 << 64) - 1


def postings_of(docs: DataFrame, min_chars: int, shards: int) -> DataFrame:
    """h1, h2, doc_id, n and shard of each key of each document: n rows of `docs` have it."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            hashes, rows = [], []
            for i, text in enumerate(batch.column(1)):
                found = {h for line in (text.as_py() or "").encode().split(b"\n") if (h := key(line, min_chars)) is not None}
                hashes += found
                rows += [i] * len(found)
            halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(0).take(pa.array(rows, pa.int64()))], names=["h1", "h2", "doc_id"])

    rows = docs.filter("doc_id is not null").select("doc_id", "text")
    found = rows.mapInArrow(scan, T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), rows.schema["doc_id"]]))
    # one shuffle, by shard and a part of the documents; a task then writes few folders
    dealt = found.withColumns({"shard": _shard(shards), "_part": F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))}).repartition("shard", "_part")
    return dealt.groupBy("shard", "_part", "h1", "h2", "doc_id").agg(F.count("*").alias("n")).select("h1", "h2", "doc_id", "n", "shard")


def digest(cleaned: DataFrame) -> DataFrame:
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same result by plain joins of all lines.
ORACLE = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
f AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40 AND doc_id IS NOT NULL GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.doc_id, i, line, f.k IS NOT NULL AND l.doc_id <> f.holder AS gone FROM l LEFT JOIN f ON f.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
