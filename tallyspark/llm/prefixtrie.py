"""Conversation prefix trie by pointer jumping.

Each distinct sequence of a conversation's first d turns (role, text) is a node of depth d, from the root (d = 0) that all share.
A prefix is keyed by its depth and a 128-bit digest: the exclusive or of two 64-bit hashes of every turn with its place, so a
long conversation's prefixes are running values over slices of its turns. A node's key without its last turn is its parent's
key, which gives the edges. Sums over subtrees need no walk along the depth: in round k each node hands what its subtree has
gathered within distance 2^k to its ancestor at distance 2^k, and then jumps to its ancestor's ancestor. There are as many
rounds as the depth has binary digits.

Nothing gathers a conversation, a node's members or its children in one task: turns are numbered within parts of a range
partitioning, and counts of earlier parts are added; members are counted in parts before they are shuffled; sums go through
aggregates on the ancestor; joins on a frequent ancestor are left to adaptive skew handling. The ids of the conversations that
end at a node are written out in chunks by as many tasks as there are, and only hashed in order, as a stream.

Turns are ordered by turn (null first), ties by role and text. Null roles and texts are empty. Repeated rows are turns of their
own. Rows with a null conv_id belong to no conversation and are left out. Extra columns are ignored. An empty table has no
conversation, so no root and no rows. Texts are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.base import discard, materialize, tidy

#: Turns of a conversation in one slice of the running digests.
SLICE = 4096
#: Bytes of conversation ids in one chunk.
CHUNK = 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """Turns as conv_id, number (from 1), h1, h2 (hashes of role and text) and chars (code points of the text).

    Equal rows are counted first and laid out last, so that no number of them is sorted or kept together.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))

    @tidy
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            last = []
            for c, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = n if c != conv else at + n
                conv = c
                last.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(last), pa.int32()), pa.array(last, pa.int64())], names=[*batch.schema.names, "part", "last"])

    dealt = counted.repartitionByRange(*order).sortWithinPartitions(*order)
    hashed = dealt.select("conv_id", "n", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "role", "text").alias("h2"), F.length("text").cast("long").alias("chars"))
    local = materialize(hashed.mapInArrow(number, "conv_id long, n long, h1 long, h2 long, chars long, part int, last long"))
    parts = local.groupBy("conv_id", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    found = local.join(offset, ["conv_id", "part"])
    upto = F.col("offset") + F.col("last")
    return found.select("conv_id", F.explode(F.sequence(upto - F.col("n") + 1, upto)).alias("number"), "h1", "h2", "chars")


def rebuilt(conversations: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) with shared beginnings: the first h turns of conversation c are those of c - c % `family`, where
    h = crc32 of c in decimal, modulo `most`; then come its own after its first h.

    The conversations are conv_id alone; the turns are as those of `numbered`.
    """
    turns = materialize(numbered(conversations))
    count = turns.groupBy("conv_id").agg(F.max("number").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % F.lit(most)
    convs = materialize(count.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("head")))
    heads = convs.select(F.col("conv_id").alias("head"), F.col("n").alias("n_head"))
    convs = convs.join(heads, "head", "left").select("conv_id", "h", "head", F.least("h", F.coalesce("n_head", F.lit(0))).alias("taken"))
    firsts = turns.filter(F.col("number") < most).withColumnRenamed("conv_id", "head")
    shared = convs.select("conv_id", "head", "taken").join(firsts, "head").filter("number <= taken")
    own = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("number > h").withColumn("number", F.col("number") - F.col("h") + F.col("taken"))
    columns = ["conv_id", "number", "h1", "h2", "chars"]
    return convs.select("conv_id"), shared.select(columns).union(own.select(columns))


def prefixes(turns: DataFrame, slice_: int = SLICE) -> DataFrame:
    """conv_id, depth, p1, p2 (its digest), q1, q2 (the digest without the last turn) and chars, for every turn."""
    turn = [F.xxhash64(F.lit(s), "number", "h1", "h2") for s in (1, 2)]
    rows = turns.select("conv_id", F.col("number").alias("depth"), "chars", turn[0].alias("t1"), turn[1].alias("t2"), F.floor((F.col("number") - 1) / slice_).alias("slice"))
    whole = rows.groupBy("conv_id", "slice").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    past = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    past = whole.select("conv_id", "slice", *(F.coalesce(F.bit_xor(s).over(past), F.lit(0)).alias(s) for s in ("s1", "s2")))
    upto = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({"u1": F.bit_xor("t1").over(upto), "u2": F.bit_xor("t2").over(upto)}).join(past, ["conv_id", "slice"])
    both = lambda a, b: F.col(a).bitwiseXOR(F.col(b))
    return local.select("conv_id", "depth", "chars", both("u1", "s1").alias("p1"), both("u2", "s2").alias("p2"), "t1", "t2").withColumns({"q1": both("p1", "t1"), "q2": both("p2", "t2")}).drop("t1", "t2")


def ends_digest(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """depth, p1, p2 of the nodes where conversations end, and ends_sha256 of their ids in ascending order."""
    key = ["depth", "p1", "p2"]

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, node, ids, size = TaskContext.get().partitionId(), 0, None, [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in node), pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([",".join(ids).encode()], pa.binary())], names=[*key, "part", "number", "ids"])

        for batch in batches:
            for *here, c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if node is not None and (here != node or size >= chunk):
                    yield flush()
                    number, ids, size = number + 1, [], 0
                node = here
                ids.append(str(c))
                size += len(ids[-1]) + 1
        if ids:
            yield flush()

    @tidy
    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None

        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([f[0][i] for f in found], pa.int64()) for i in range(3)), pa.array([f[1] for f in found])], names=[*key, "ends_sha256"])

        for batch in batches:
            done = []
            for *here, ids in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if here == node:
                    sha.update(b"," + ids)
                else:
                    if node is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = here, hashlib.sha256(ids)
            if done:
                yield out(done)
        if node is not None:
            yield out([(node, sha.hexdigest())])

    order = [*key, "conv_id"]
    written = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, "depth long, p1 long, p2 long, part int, number long, ids binary")
    streamed = written.repartition(*key).sortWithinPartitions(*key, "part", "number").select(*key, "ids")
    return streamed.mapInArrow(hash_, "depth long, p1 long, p2 long, ends_sha256 string")


def gathered(nodes: DataFrame, deepest: int, values: list[str]) -> DataFrame:
    """`nodes` (conv_id, depth, parent and `values`) with each value summed over the node's subtree.

    Before round k a node has the sums within distance 2^k and points to its ancestor at distance 2^k, at a known depth.
    """
    state, step, old = nodes.select("conv_id", "depth", F.col("parent").alias("up"), *values), 1, []
    while step <= deepest:
        handed = state.filter(F.col("depth") >= step).groupBy(F.col("up").alias("conv_id"), (F.col("depth") - step).alias("depth")).agg(*(F.sum(v).alias(f"in_{v}") for v in values))
        summed = state.join(handed, ["conv_id", "depth"], "left").select("conv_id", "depth", "up", *((F.col(v) + F.coalesce(f"in_{v}", F.lit(0))).alias(v) for v in values))
        far = F.col("depth") >= 2 * step
        above = state.filter(F.col("depth") >= step).select(F.col("conv_id").alias("up"), F.col("depth").alias("at"), F.col("up").alias("next"))
        jumped = summed.filter(far).withColumn("at", F.col("depth") - step).join(above, ["up", "at"]).select("conv_id", "depth", F.col("next").alias("up"), *values)
        landed = summed.filter(~far).withColumn("up", F.lit(None).cast("long"))
        state = materialize(jumped.union(landed))
        discard(*old)
        old, step = [state], 2 * step
    return state.drop("up")


def trie(conversations: DataFrame, turns: DataFrame, slice_: int = SLICE, chunk: int = CHUNK) -> DataFrame:
    """One row for each node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    (code points that need not be repeated, over the subtree) and ends_sha256.

    `conversations` has each conv_id once, those without turns too; `turns` are as those of `numbered`, from 1 without gaps.
    """
    key = ["depth", "p1", "p2"]
    of_turn = materialize(prefixes(turns, slice_))
    inner = of_turn.groupBy(key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("p1"), zero.alias("p2"), "conv_id", "n_convs", zero.alias("chars"), zero.alias("q1"), zero.alias("q2"))
    keyed = materialize(root.union(inner.select(root.columns)))
    top = keyed.filter("depth = 0").select("conv_id").first()
    parents = keyed.filter("depth > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    deep = keyed.filter("depth > 1").join(parents, ["depth", "q1", "q2"])
    columns = [*key, "conv_id", "n_convs", "chars", "parent"]
    first: Column = F.when(F.col("depth") == 1, F.lit(top[0] if top else None)).cast("long")
    nodes = materialize(deep.select(columns).union(keyed.filter("depth <= 1").withColumn("parent", first).select(columns)))
    below = nodes.filter("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    told = nodes.join(below, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    told = materialize(told.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}))
    deepest = told.agg(F.max("depth")).first()[0] or 0
    sums = gathered(told.select("conv_id", "depth", "parent", "n_leaves", "saved_tokens"), deepest, ["n_leaves", "saved_tokens"])
    last = of_turn.groupBy("conv_id").agg(F.max_by(F.struct(*key), "depth").alias("at"))
    ends = conversations.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(f"at.{k}", zero).alias(k) for k in key))
    shas = ends_digest(ends, chunk)
    out = told.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(shas, key, "left")
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"))


#: CRC32 in SQL: for each byte of the decimal id, eight halvings with the reflected polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)::BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT)"

ORACLE = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
               FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {_CRC} % 6 AS h, conv_id - conv_id % 100 AS head FROM (SELECT DISTINCT conv_id FROM turns)),
heads AS (SELECT c.conv_id, t.k, t.r, t.x FROM convs c JOIN turns t ON t.conv_id = c.head AND t.k <= c.h),
rest AS (SELECT c.conv_id, t.k - c.h + (SELECT count(*) FROM heads e WHERE e.conv_id = c.conv_id) AS k, t.r, t.x FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.k > c.h),
rebuilt AS (SELECT * FROM heads UNION ALL SELECT * FROM rest),
prefixes AS (SELECT conv_id, k AS depth, length(x) AS chars, md5((list({{'r': r, 'x': x}}) OVER (PARTITION BY conv_id ORDER BY k))::VARCHAR) AS p FROM rebuilt
             UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
nodes AS (SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM prefixes GROUP BY ALL),
up AS (SELECT n.depth, n.p, a.conv_id AS up_id, a.depth AS up_depth FROM nodes n JOIN prefixes q ON q.conv_id = n.conv_id AND q.depth <= n.depth JOIN nodes a ON a.depth = q.depth AND a.p = q.p),
kids AS (SELECT up_id, up_depth, count(*) AS n_children FROM up WHERE depth = up_depth + 1 GROUP BY ALL),
told AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.up_id = n.conv_id AND k.up_depth = n.depth),
sums AS (SELECT u.up_id, u.up_depth, sum((t.n_children = 0)::BIGINT) AS n_leaves, sum((t.n_convs - 1) * t.chars) AS saved_tokens FROM up u JOIN told t ON t.depth = u.depth AND t.p = u.p GROUP BY ALL),
ends AS (SELECT depth, p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, max(depth) AS depth, max_by(p, depth) AS p FROM prefixes GROUP BY conv_id) GROUP BY ALL)
SELECT t.conv_id, t.depth, u.up_id AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM told t JOIN sums s ON s.up_id = t.conv_id AND s.up_depth = t.depth LEFT JOIN up u ON u.depth = t.depth AND u.p = t.p AND u.up_depth = t.depth - 1 LEFT JOIN ends e ON e.depth = t.depth AND e.p = t.p
"""
