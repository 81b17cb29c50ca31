"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least `similarity`, found without a miss.

SimHash links (`simhash.links`, fingerprints of the same shingles) are the first candidates. No radius of fingerprints is
certain, so shared shingles bring the others together: all shingles are put in one order, and two sets that are similar
enough share one of the first n - ceil(similarity * n) + 1 of either (prefix filter). Any order does; here it is the hash,
with shingles that are common in a sample of the texts last, so that a common passage makes no candidates unless it is most
of a text. Every candidate is checked by the exact overlap of the two sets; hashes of 64 bits stand for shingles and sets.

Where a shared shingle stands says more: it can be the first one that two sets share only if what follows it in both is enough
(positional filter), so a passage that comes late in two sets brings them together only if they are that alike.

Texts of equal sets are one node. In a first round each text is checked against the centers of every shingle it shares, one
for each size that it could go with: the node with the fewest shingles of its own, which is the same one for most shingles of
a group. So a large group makes few candidates a text, and whatever is near enough to the group's core is in one component
then. In the second, where a
shingle's texts still lie in several components, texts that no size in the shingle's group could be near enough to are left
aside, and the pairs of the rest between different components that pass the filter are checked; pairs inside a component
need no check. So no link is lost, and a connected group's pairs aren't listed. What is: pairs of texts of one template that
differ in so few words that the order can't tell them from near copies, but are just too far apart. Their number grows with the
square of such a group.

Null and empty texts are copies of each other. Rows with a null doc_id get a component like others but never name one. Rows are
told apart by doc_id and text: those that share both are one document, those that share a doc_id only are two. Extra
columns are ignored. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.base import BROADCAST_ROWS, discard, free, materialize, pieces, release, tidy
from tallyspark.llm.components import components
from tallyspark.llm.simhash import SEED, cell, links, majority, shingles

WORDS, SIMILARITY = 5, 0.8
#: A shingle is common if it is among the first of this many texts of one in `ONE_IN`; the most common ones are put last.
ONE_IN, OFTEN, MOST_COMMON = 16, 4, 1 << 16
#: Counts of a set's sketch.
SKETCH = 128
_E = 1e-9


def shingle_sets(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, common: np.ndarray | None = None) -> DataFrame:
    """A row for each of `docs`: doc_id, `text_hash`, `node` (hash of the set of shingles), `fingerprint`, `n` shingles, how many
    of them aren't in `common` (`rare`), their counts by their last bits (`sketch`, up to 127) and the first of them, those of `common` (sorted) last."""

    @tidy
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            nodes, prints, sizes, rare, sketches, sets = [], [], [], [], [], []
            for text in batch.column(2):
                hashes = shingles((text.as_py() or "").encode(), words)
                own = np.unique(hashes.view("<i8"))
                prints.append(majority(hashes))
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63))
                sizes.append(len(own))
                sketches.append(np.minimum(np.bincount(own & (SKETCH - 1), minlength=SKETCH), 127).astype(np.int8))
                rare.append(len(own))
                if common is not None and len(common) and len(own):
                    often = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
                    own = np.concatenate([own[~often], own[often]])
                    rare[-1] -= int(often.sum())
                sets.append(own[: len(own) - math.ceil(similarity * len(own) - _E) + 1] if len(own) else own)
            columns = [pa.array(nodes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int32()), pa.array(rare, pa.int32()), pa.array(sketches, pa.list_(pa.int8())), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    fields = {"node": T.LongType(), "fingerprint": T.LongType(), "n": T.IntegerType(), "rare": T.IntegerType(), "sketch": T.ArrayType(T.ByteType()), "shingles": T.ArrayType(T.LongType())}
    names = ["doc_id", "text_hash", *fields]
    return rows.mapInArrow(scan, T.StructType([rows.schema["doc_id"], rows.schema["text_hash"], *(T.StructField(k, t) for k, t in fields.items())]))


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """The most common shingles of a sample of the texts, sorted. They only settle an order: none is left out."""
    some = shingle_sets(docs.filter(F.pmod(F.xxhash64("text"), F.lit(ONE_IN)) == 0), words, 0.0)  # all shingles, for any may come first
    counts = some.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"), F.min("node").alias("a"), F.max("node").alias("b"))
    top = counts.filter((F.col("n") >= OFTEN) & (F.col("a") < F.col("b"))).orderBy(F.desc("n"), "shingle").limit(MOST_COMMON)
    return np.sort(top.select("shingle").toPandas()["shingle"].to_numpy(np.int64))


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar enough.

    Two sets differ in at least as many shingles as their counts differ, so pairs whose counts differ too much need no
    look at the texts; the others' texts are brought together, and their shingles are made again and compared.
    """
    ends = [nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.abs(x.cast("int") - y.cast("int"))), F.lit(0), lambda x, y: x + y)
    alike = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - _E
    close = pairs.join(ends[0], "a").join(ends[1], "b").filter(alike & (apart * (1 + similarity) <= (1 - similarity) * (F.col("n_a") + F.col("n_b")) + _E))
    close = materialize(close.select("a", "b"))
    needed = nodes.join(close.select(F.col("a").alias("node")).union(close.select("b")).distinct(), "node", "left_semi")
    needed = materialize(needed.select("node", "text_hash"))
    few = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(few, "text_hash").groupBy("node").agg(F.any_value("text").alias("text"))

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, np.zeros(0, "<u8")  # of the smaller node: a group's pairs mostly share it
        for batch in pieces(batches, 200):
            ok = []
            for a, text_a, text_b in zip(batch.column(0), batch.column(2), batch.column(3), strict=True):
                if last != a.as_py():
                    last, own = a.as_py(), np.unique(shingles((text_a.as_py() or "").encode(), words))
                other = np.unique(shingles((text_b.as_py() or "").encode(), words))
                k = len(np.intersect1d(own, other, assume_unique=True))
                ok.append(k >= similarity * (len(own) + len(other) - k) - _E)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), batch.column(1).filter(pa.array(ok))], names=["a", "b"])

    both = close.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    found = materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long"))
    discard(close, needed)
    release(docs.sparkSession)
    return found


def by_fingerprint(prints: DataFrame) -> DataFrame:
    """Pairs of nodes that share a fingerprint or are linked by two, for `prints` (node, fingerprint)."""
    firsts = materialize(prints.groupBy("fingerprint").agg(F.min("node").alias("least")).withColumn("cell", cell("fingerprint")))
    same = prints.join(firsts, "fingerprint").select(F.col("node").alias("a"), F.col("least").alias("b"))
    ends = [firsts.select(F.col("fingerprint").alias(x), F.col("least").alias(f"node_{x}")) for x in "ab"]
    linked = links(firsts).join(ends[0], "a").join(ends[1], "b").select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return same.union(linked)


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, `text_hash` and `component_id`, one row for each row of `docs`: the smallest doc_id reachable over links of texts
    that are similar enough. `first` marks the document that stands for its component: the smallest doc_id (nulls last), then
    the smallest text_hash."""
    sets = materialize(shingle_sets(docs, words, similarity, common_shingles(docs, words)))
    one = {c: F.min(c).alias(c) for c in ("fingerprint", "n", "text_hash")} | {"sketch": F.any_value("sketch").alias("sketch")}
    document = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("text_hash").alias("text"))
    nodes = materialize(sets.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(document).alias("chief"), *one.values()))
    rows = sets.select("node", F.explode("shingles").alias("shingle"))
    met = rows.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    met = materialize(met.filter("lo < hi").select("shingle"))
    places = sets.select("node", "n", "rare", F.posexplode("shingles").alias("i", "shingle"))
    shared = materialize(places.join(F.broadcast(met) if met.count() <= BROADCAST_ROWS else met, "shingle").distinct())

    def fits(n: str, i: str, m: str, j: str) -> Column:
        """Whether a shingle can be the first that sets of n and m share, at their places i and j (from 0)."""
        n, i, m, j = (F.col(x) for x in (n, i, m, j))
        alike = F.least(n, m) >= similarity * F.greatest(n, m) - _E
        return alike & (F.least(n - i, m - j) >= similarity / (1 + similarity) * (n + m) - _E)

    # a center for each size: similar sets differ by less than a band, so a text meets those of its own and both next bands
    band = F.floor(F.log("n") / F.lit(-math.log(similarity))).cast("int")
    sized = shared.withColumn("band", band)
    centers = sized.groupBy("shingle", "band").agg(F.min(F.struct("rare", "node", "i", "n")).alias("c")).select("shingle", "band", F.col("c.i").alias("j"), F.col("c.node").alias("b"), F.col("c.n").alias("m"))
    near_by = sized.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    stars = near_by.join(centers, ["shingle", "band"]).filter(fits("n", "i", "m", "j")).select(F.col("node").alias("a"), "b")
    pairs = stars.union(by_fingerprint(nodes.select("node", "fingerprint"))).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs)
    sure = verified(docs, nodes, pairs, words, similarity)
    roots = materialize(components(sure))

    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = shared.groupBy("shingle").agg(F.min("n").alias("least"))
    # a text stays if the smallest size that it could go with, in this group, leaves enough behind the shingle
    smallest = F.greatest(F.col("least"), similarity * F.col("n") - _E)
    placed = placed.join(least, "shingle").filter(F.col("n") - F.col("i") >= similarity / (1 + similarity) * (F.col("n") + smallest) - _E)
    placed = materialize(placed.select("shingle", "node", "n", "i", "root"))
    each = placed.groupBy("shingle", "root").agg(F.count("*").alias("k"))
    split = each.groupBy("shingle").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count("*").alias("roots")).filter("roots >= 2")
    open_ = materialize(placed.join(split.select("shingle", "largest"), "shingle"))
    others = open_.filter("root <> largest").select("shingle", F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("n").alias("m"), F.col("i").alias("j"))
    # two texts outside the largest component meet twice: the smaller node is the first then
    apart = (F.col("a_root") != F.col("root")) & ((F.col("root") == F.col("largest")) | (F.col("a") < F.col("node")))
    met_again = others.join(open_, "shingle").filter(apart & fits("n", "i", "m", "j"))
    more = met_again.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"))
    discard(met, shared, placed, open_)
    release(docs.sparkSession)
    found = materialize(components(sure.union(verified(docs, nodes, more, words, similarity))))

    rooted = materialize(nodes.select("node", "least", "chief").join(found, "node", "left").withColumn("root", F.coalesce("root", "node")))
    chiefs = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("chief").alias("chief")))
    of_node = materialize(rooted.select("node", "root").join(chiefs, "root").select("node", "component_id", "chief"))
    discard(pairs, sure, roots, more, found, rooted, chiefs)
    out = sets.select("doc_id", "text_hash", "node").join(of_node, "node")
    first = F.col("chief.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("chief.text") == F.col("text_hash"))
    return out.select("doc_id", "text_hash", "component_id", first.alias("first"))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, all columns, less all but one document of each component: the one that stands for it stays.

    Where several rows share its doc_id and text, one of them stays, by a hash of its columns.
    """
    found = near_copies(docs, words, similarity).groupBy("doc_id", "text_hash").agg(F.bool_or("first").alias("first"), F.count("*").alias("rows"))
    found = materialize(found.filter("not first or rows > 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), F.col("first").alias("_first")))
    of, o = free("_key", docs.columns), free("_other", docs.columns)
    keyed = docs.withColumn(of, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("text")))
    other = found.select(F.struct(F.col("_id").alias("id"), F.col("_text").alias("text")).alias(o), "_first")
    if found.count() <= BROADCAST_ROWS:
        other = F.broadcast(other)
    told = F.col(f"{of}.id").eqNullSafe(F.col(f"{o}.id")) & (F.col(f"{of}.text") == F.col(f"{o}.text"))
    single = keyed.join(other, told, "left_anti")
    again = keyed.join(other.filter("_first"), told, "left_semi")
    plain = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)]
    once = again.groupBy(of).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*plain)).alias("row")).select("row.*")
    return single.select(*docs.columns).union(once)
