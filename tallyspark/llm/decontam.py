"""Benchmark decontamination: size-partitioned MinHash containment search for short items in long documents, then an exact check.

An item is in a document if the document has at least `threshold` of the item's distinct word shingles. Items are partitioned by
the power of two of their number of shingles, and each partition has its own sketch length: one more than its largest item may
miss. An item's sketch holds its smallest shingles, in an order that puts those of the fewest items first and then goes by hash:
so a stock phrase of many items is in a sketch only where an item has little else, and no key of the search is shared by more
items than it must be. A document that contains an item shares at least one value with its sketch, or more where the item is
smaller than its partition's largest: whichever shingles a sketch holds, it can miss no more of them than of the whole item. So
the recall of the search is 1, however long the document. Documents' shingles meet the sketches only. The documents that share
enough values are shingled again, and the exact containment of each found item is counted on the shingles' words. Everything
is DataFrame operations.

Words are runs of letters, digits and marks of the lower-cased text; a shingle is five words. An item of fewer words has one
shingle, all its words, and is in a document that has these words in a row; documents are cut into shingles of that length too
if there is such an item. Null and empty texts have no shingle and meet nothing; in `contained` rows with a null id are left
out, and rows that repeat an id count as one text's shingles; `clean` judges each row by its own text, whatever its id. Extra
columns are ignored. Empty tables give an empty result. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.base import BROADCAST_ROWS, free, held

WORDS, THRESHOLD = 5, 0.8
#: Bytes of items up to which a join's side of them is broadcast.
BROADCAST_BYTES = 64 << 20


def words_of(text: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "), " "), lambda w: w != "")


def _cut(words: str, n: int, each: str, kind: str) -> str:
    """`each` (in i) for all shingles of n words."""
    return f"case when size({words}) >= {n} then transform(sequence(1, size({words}) - {n - 1}), i -> {each}) else cast(array() as array<{kind}>) end"


def shingle_hashes(words: str, n: int, short: Iterable[int] = ()) -> Column:
    """Hashes of the shingles of n words, and of those of the `short` lengths."""
    full = ", ".join(f"element_at({words}, i + {k})" for k in range(n))
    cuts = [_cut(words, n, f"xxhash64({full})", "bigint"), *(_cut(words, k, f"xxhash64(array_join(slice({words}, i, {k}), ' '))", "bigint") for k in short)]
    return F.expr(f"concat({', '.join(cuts)})" if len(cuts) > 1 else cuts[0])


def shingles(words: str, n: int, short: Iterable[int] = ()) -> Column:
    """The same shingles as text."""
    cuts = [_cut(words, k, f"array_join(slice({words}, i, {k}), ' ')", "string") for k in (n, *short)]
    return F.expr(f"concat({', '.join(cuts)})" if len(cuts) > 1 else cuts[0])


def _sized(df: DataFrame, rows: int, size: int = 0) -> DataFrame:
    """`df` as the side of a join that is broadcast if its measured rows and bytes allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def item_shingles(items: DataFrame, n: int, threshold: float) -> DataFrame:
    """item_id, shingle, h, n_item, need (shingles that make containment), in_sketch and hits (values to share)."""
    words = items.filter("item_id is not null").select("item_id", words_of("text").alias("words"))
    whole = F.array_join("words", " ")
    text = F.when(F.size("words").between(1, n - 1), F.array(whole)).otherwise(shingles("words", n))
    hashed = F.when(F.size("words").between(1, n - 1), F.array(F.xxhash64(whole))).otherwise(shingle_hashes("words", n))
    both = words.select("item_id", text.alias("shingle"), hashed.alias("h"))
    both = both.select("item_id", F.explode(F.arrays_zip("shingle", "h")).alias("s"))
    each = both.select("item_id", "s.shingle", "s.h").distinct()
    per = each.groupBy("item_id").agg(F.count("*").alias("n_item"))
    per = per.withColumn("need", F.ceil(F.col("n_item") * threshold - 1e-9).cast("long"))
    # the partition's largest item, and by how much it may fall short
    largest = F.expr("shiftleft(2L, int(floor(log2(n_item)))) - 1")
    length = largest - F.ceil(largest * threshold - 1e-9).cast("long") + 1
    per = per.withColumn("length", F.least("n_item", length))
    per = per.withColumn("hits", F.greatest(F.lit(1).cast("long"), F.col("length") - (F.col("n_item") - F.col("need"))))
    often = each.groupBy("h").agg(F.count("*").alias("items"))
    ranked = each.join(per, "item_id").join(often, "h").withColumn("rank", F.expr("row_number() over (partition by item_id order by items, h, shingle)"))
    return ranked.select("item_id", "shingle", "h", "n_item", "need", "hits", (F.col("rank") <= F.col("length")).alias("in_sketch"))


def contained(docs: DataFrame, items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_item, n_shared (distinct shingles of the item, and those in the document), containment."""
    known = held(item_shingles(items, n, threshold))
    size, length = known.agg(F.count("*"), F.coalesce(F.sum(F.length("shingle") + 64), F.lit(0))).first()
    n_words = F.size(F.split("shingle", " "))
    short = sorted(r[0] for r in known.select(n_words.alias("k")).filter(F.col("k") < n).distinct().collect())  # lengths below n
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", words_of("text").alias("words"))
    hashes = texts.select("doc_id", F.explode(shingle_hashes("words", n, short)).alias("h"))
    sketch = known.filter("in_sketch").select("item_id", "h", "hits")
    met = hashes.join(_sized(sketch, size), "h").groupBy("doc_id", "item_id").agg(F.count_distinct("h").alias("met"), F.first("hits").alias("hits"))
    found = held(met.filter("met >= hits").select("doc_id", "item_id"))
    ids = found.select("doc_id").distinct()
    again = texts.join(_sized(ids, ids.count()), "doc_id", "left_semi").select("doc_id", F.explode(shingles("words", n, short)).alias("shingle"))
    shared = again.join(_sized(known.select("item_id", "shingle", "n_item", "need"), size, length), "shingle")
    shared = shared.groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"), F.first("n_item").alias("n_item"), F.first("need").alias("need"))
    exact = shared.filter("n_shared >= need").join(found, ["doc_id", "item_id"], "left_semi")
    return exact.select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, n: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, in which no item is found."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = held(contained(keyed, items, n, threshold).select("doc_id").distinct())
    of, o = free("_text", docs.columns), free("_found", docs.columns)
    found_, n_found = found.withColumnRenamed("doc_id", o), found.count()
    return docs.withColumn(of, F.xxhash64("text")).join(_sized(found_, n_found), F.col(of) == F.col(o), "left_anti").select(*docs.columns)


#: The same pairs by plain joins of all shingles.
ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
i AS (SELECT item_id, list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}\p{M}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM i),
lengths AS (SELECT DISTINCT least(len(w), 5) AS m FROM i WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda k: array_to_string(w[k:k + m - 1], ' '))) AS s FROM d, lengths WHERE len(w) >= m),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id)
SELECT ds.doc_id, s.item_id, n.n_item, count(*) AS n_shared, count(*) / n.n_item AS containment
FROM ds JOIN s USING (s) JOIN n ON n.item_id = s.item_id
GROUP BY ds.doc_id, s.item_id, n.n_item HAVING count(*) >= ceil(n.n_item * 0.8 - 1e-9)
"""
