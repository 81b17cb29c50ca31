"""SimHash near-duplicates: a segment-popcount embedding, a grid range-join under Manhattan distance, then an exact check.

A fingerprint's embedding counts the set bits of each 2-bit segment: 32 counts of 0 to 2, packed in the 2-bit fields of a
long. So fine a grid keeps chance meetings rare: of n random fingerprints one meets about n / 20 billion others. One differing
bit moves one count by one, so the Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints. Two lattice points within distance 2 share a point within distance 1 of either, so each occupied cell is joined
to its neighbours by emitting itself and its up to 64 neighbours: at most 65 cells meet at a point, whatever the size of a
group of near copies.

The fingerprints of the cells that meet at a point are the candidates, and each is compared with the others there: a link is a
pair of 2 or fewer differing bits. A cell may hold many fingerprints (each count of 1 has two forms). A point of more than
`AT_POINT` is therefore not compared at once but cut finer first, by segments of one bit: its fingerprints meet at the words
within one bit of theirs that embed into the point. At most 65 meet at a word, so each is compared with the smallest of them
only. Either way no link between different fingerprints is lost, and no group's pairs are listed.

Null and empty texts have fingerprint zero, which links like any other. Copies share a fingerprint; links run between
distinct fingerprints. Rows with a null doc_id get a component like others but never name one. Repeated rows repeat. Extra
columns are ignored. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.base import materialize, tidy
from tallyspark.llm.components import components

SEED = 42
#: Fingerprints at a grid point up to which each is compared with the others; a fuller point is cut finer first.
AT_POINT = 64
#: Cells that a task of the range join lays out, about.
CELLS_A_TASK = 20_000
#: Shingle hashes whose bits are counted at once.
_AT_ONCE = 1 << 14


def shingles(text: bytes, words: int = 3) -> np.ndarray:
    """64-bit hashes of the word shingles of `text`, in order (A-Z lower-cased, ASCII white space between words)."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    norm = b" ".join(tokens)
    ends = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32).tolist()
    ends.append(len(norm))
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    last = ends[words - 1 :] or ends[-1:]
    return np.fromiter((digest(norm[s:e], SEED) for s, e in zip(starts, last, strict=False)), "<u8")


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: the bits that more than half of the hashes have."""
    set_bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        set_bits += np.unpackbits(hashes[i : i + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


def simhash(text: bytes, words: int = 3) -> int:
    """Signed 64-bit fingerprint of the word shingles of `text`."""
    return majority(shingles(text, words))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and its signed 64-bit `fingerprint`, one row for each row of `docs`."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [simhash((t.as_py() or "").encode(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fingerprint"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(scan, T.StructType([rows.schema["doc_id"], T.StructField("fingerprint", T.LongType())]))


_LOW = 0x5555555555555555  # the lower bit of each 2-bit field


def cell(fingerprint: str) -> Column:
    """The embedding: set bits of each 2-bit segment, in the 2-bit fields of a long."""
    return F.expr(f"shiftleft({fingerprint} & shiftrightunsigned({fingerprint}, 1) & {_LOW}L, 1) | (({fingerprint} ^ shiftrightunsigned({fingerprint}, 1)) & {_LOW}L)")


def around(point: str) -> Column:
    """A cell and the lattice points at distance 1 of it: 0 and 1 differ in a field's lower bit, 1 and 2 in both."""
    count = f"(shiftrightunsigned({point}, 2 * i) & 3)"
    return F.expr(
        f"concat(array({point}),"
        f" transform(filter(sequence(0, 31), i -> {count} < 2), i -> {point} ^ shiftleft(1L, 2 * i)),"
        f" transform(filter(sequence(0, 31), i -> {count} > 0), i -> {point} ^ shiftleft(3L, 2 * i)))"
    )


def met_points(prints: DataFrame) -> DataFrame:
    """The grid points where cells of `prints` (distinct `fingerprint`, its `cell`) meet: point, the cells (65 at most) and
    their number of fingerprints."""
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-prints.count() // CELLS_A_TASK))
    cells = prints.groupBy("cell").agg(F.count("*").alias("n")).repartition(tasks)  # each becomes some 50 rows
    points = cells.select("cell", "n", F.explode(around("cell")).alias("point"))
    met = points.groupBy("point").agg(F.sum("n").alias("n"), F.collect_list("cell").alias("cells"))
    return materialize(met.filter("n >= 2"))


def near(a: Column, b: Column) -> Column:
    """The exact check."""
    return (a != b) & (F.bit_count(a.bitwiseXOR(b)) <= 2)


def links(prints: DataFrame, at_point: int = AT_POINT) -> DataFrame:
    """Links (a, b) that join all fingerprints of `prints` (distinct `fingerprint`, its `cell`) which chains of 2 or fewer
    differing bits connect; each is real."""
    met = met_points(prints)
    at = met.select("point", "n", F.explode("cells").alias("cell")).join(prints.select("cell", "fingerprint"), "cell")
    few = at.filter(F.col("n") <= at_point).groupBy("point").agg(F.collect_list("fingerprint").alias("all"))
    pairs = few.select(F.explode("all").alias("a"), "all").select("a", F.filter("all", lambda b: near(F.col("a"), b) & (b < F.col("a"))).alias("near"))
    compared = pairs.select("a", F.explode("near").alias("b"))
    words = at.filter(F.col("n") > at_point).select("point", "fingerprint", F.explode(F.expr("concat(array(fingerprint), transform(sequence(0, 63), i -> fingerprint ^ shiftleft(1L, i)))")).alias("word"))
    finer = words.filter(cell("word") == F.col("point")).groupBy("point", "word").agg(F.collect_list("fingerprint").alias("all"))
    starred = finer.select(F.explode("all").alias("a"), F.array_min("all").alias("b")).filter(near(F.col("a"), F.col("b")))
    return compared.union(starred).distinct()


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, `fingerprint` (signed long) and `component_id`: the smallest doc_id reachable over links of 2 or fewer bits."""
    prints = materialize(fingerprints(docs, words))
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    distinct = materialize(distinct.withColumn("cell", cell("fingerprint")))
    found = materialize(components(links(distinct)))
    rooted = materialize(distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint").select("fingerprint", "least", "root"))
    roots = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    moved = rooted.join(roots, "root").select("fingerprint", "component_id")
    of_print = materialize(distinct.join(moved, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "least").alias("component_id")))
    return prints.join(of_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
