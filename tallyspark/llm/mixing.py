"""Mixing sources to target weights: cube-method balanced sampling of documents.

The targets come from the sources' sizes alone. A source's ratio of target to size gives each of its documents whole copies
and a fractional inclusion probability. The flight phase moves the probabilities through the null space of two constraints, the
source's words and its documents, three documents at a time and the largest first, until each is 0 or 1: both totals stay as
they are. It runs over blocks of a source's documents, then over what few fractions the blocks leave (two each at most), in as
many levels as it takes. At the last one a dozen documents of all sizes wait. They and the two that the flight leaves land by a
linear programme over their choices: of all designs that keep every inclusion probability, the one that is expected to miss the
words (and, far less, the documents) by least, from which one choice is drawn. So a document is taken with its probability
throughout. Only where no such design stays near the target (`NEAR`), as in sources of a few documents, is the choice drawn
by rejection instead: by the same probabilities, among the choices that come near enough; if none does, the
largest document is decided first and the others make up for it. A source of no more documents than
wait lands at once.

Blocks and the order in them follow from hashes of doc_id and text, so reruns agree. Null and empty texts have size 0; their
copies take no word. The null source is a source, the last one. A null doc_id is a document like others. Repeated rows are
documents of their own; they are counted first and dealt to blocks like others. Extra columns are ignored. An empty table gives
an empty result. Sources are a table too: no row of theirs is collected.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.base import BROADCAST_ROWS, materialize

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Documents to a block of the flight phase, about.
BLOCK = 1024
#: Documents of a source that wait for the landing.
LANDING = 12
#: The part of a source's target that its landing may be expected to miss.
NEAR = 0.002
#: How often a source that misses it flies and lands anew; the nearest landing stays.
TRIALS = 20
_EDGE = 1e-9
#: Copies of a row that are dealt out together.
_CHUNK = 4096


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`sources` (source, source_size, n) with each one's `target`: its weight's part of `share` of all sizes, stopped at `most`
    times its size, the excess reshared.

    Sources are sorted into ranges, numbered within them and from range to range. A source is full if its part reaches what it
    may have; each round of resharing is one aggregate, and full sources stay full.
    """
    ordered = [F.col("source").isNull(), F.col("source")]
    ranges = materialize(sources.orderBy(*ordered).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").count()  # one row for each task
    before = sizes.select("range", (F.sum("count").over(Window.orderBy("range")) - F.col("count")).alias("before"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*ordered)) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (number % len(weights) + 1).cast("int"))
    ranked = materialize(ranges.join(F.broadcast(before), "range").withColumn("weight", weight).drop("range", "before"))
    size = F.col("source_size")
    full, n_full = F.lit(False), 0
    while True:
        r = ranked.agg(F.sum(size).alias("all"), F.sum(F.when(full, size)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        left, whole = share * (r["all"] or 0) - most * (r["full"] or 0), r["weight"] or 0
        more = full | (F.lit(float(left)) * F.col("weight") >= F.lit(most) * size * F.lit(whole))
        n = ranked.filter(more).count()
        if n == n_full or not whole:
            return ranked.withColumn("target", F.when(full, most * size).otherwise(F.lit(float(left)) * F.col("weight") / F.lit(float(max(whole, 1)))))
        full, n_full = more, n


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Move `p` in place, keeping sum(p) and sum(p * size), until at most two are neither 0 nor 1."""
    mixed = rng.permutation(len(p))
    waiting = [int(i) for i in mixed[np.argsort(size[mixed], kind="stable")] if _EDGE < p[i] < 1 - _EDGE]  # the largest fly first
    held: list[int] = []
    chance = iter(rng.random(3 * len(waiting) + 3).tolist())
    while len(held) + len(waiting) >= 3:
        while len(held) < 3:
            held.append(waiting.pop())
        a, b, c = (float(size[i]) for i in held)
        u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)  # orthogonal to the sizes and to ones
        q = [float(p[i]) for i in held]
        up = min(((1 - x) / v if v > 0 else -x / v) for x, v in zip(q, u, strict=True) if v)
        down = min((x / v if v > 0 else (x - 1) / v) for x, v in zip(q, u, strict=True) if v)
        step = up if next(chance) * (up + down) < down else -down
        for i, x, v in zip(held, q, u, strict=True):
            y = x + step * v
            p[i] = 0.0 if y < _EDGE else 1.0 if y > 1 - _EDGE else y
        held = [i for i in held if 0 < p[i] < 1]


def design(p: np.ndarray, cost: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Chances of all choices of len(p) documents (numbered by their bits) that keep each one's probability p and have the least
    expected cost: a linear programme, by the simplex method.

    It starts from the nested choices of the documents with the largest probabilities.
    """
    q = len(p)
    choice = (np.arange(1 << q)[None, :] >> np.arange(q)[:, None]) & 1
    table = np.vstack([choice, np.ones(1 << q)])
    goal = np.append(p, 1.0)
    basis = np.concatenate([[0], np.cumsum(1 << np.argsort(-p, kind="stable"))])
    for _ in range(rounds):
        columns = table[:, basis]
        reduced = cost - np.linalg.solve(columns.T, cost[basis]) @ table
        enter = int(reduced.argmin())
        if reduced[enter] > -1e-9:
            break
        step = np.linalg.solve(columns, table[:, enter])
        held = np.linalg.solve(columns, goal)
        ratio = np.where(step > 1e-9, held / np.where(step > 1e-9, step, 1), np.inf)
        basis[int(ratio.argmin())] = enter
    out = np.zeros(1 << q)
    out[basis] = np.clip(np.linalg.solve(table[:, basis], goal), 0, None)
    return out / out.sum()


def land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, within: float = np.inf) -> bool:
    """Round the few fractions left by a choice drawn from the design that is expected to miss words and documents by least.

    False if even that one is expected to miss the words by more than `within`. Then the choice is drawn by rejection: each
    document by its own probability, until the words are missed by no more than that, or than the best choice misses them.
    """
    at = np.flatnonzero((p > 0) & (p < 1))
    if not len(at):
        return True
    # equal probabilities tie the programme's steps: they are told apart by less than a millionth
    own = np.clip(p[at] + rng.uniform(-1e-6, 1e-6, len(at)), 1e-7, 1 - 1e-7)
    choice = (np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1
    miss = np.abs((choice - own) @ size[at])
    chances = design(own, miss / max(1.0, size[at].mean()) + 0.01 * np.abs((choice - own).sum(1)))
    good = bool(chances @ miss <= within)
    if not good:
        chances = np.where(miss <= max(within, miss.min()), np.where(choice, own, 1 - own).prod(axis=1), 0.0)
        chances /= chances.sum()
    p[at] = choice[rng.choice(1 << len(at), p=chances)]
    return good


def lead(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> None:
    """Decide the largest open document by its probability and move all others' together, so that the words stay (if they can)."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    first = open_[np.argmax(size[open_])]
    others = open_[open_ != first]
    decided = float(rng.random() < p[first])
    if words := size[others].sum():
        p[others] = np.clip(p[others] + (p[first] - decided) * size[first] / words, 0, 1)
    p[first] = decided


def fly_and_land(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, within: float) -> np.ndarray:
    """0 or 1 for each document of a source's last block. Where the landing misses too much, the largest document leads and
    others wait."""
    best, least = p, np.inf
    for trial in range(TRIALS):
        own = p.copy()
        if trial and ((p > 0) & (p < 1)).any():
            lead(own, size, rng)
        # documents of all sizes wait for the landing, which then has the finer choice
        open_ = np.flatnonzero((own > 0) & (own < 1))
        wait = open_[np.argsort(-size[open_], kind="stable")]
        if len(open_) > LANDING:
            wait = rng.permutation(open_)[:LANDING] if trial else wait[np.unique(np.linspace(0, len(open_) - 1, LANDING).round().astype(int))]
        fly = np.setdiff1d(open_, wait)
        moved = own[fly]
        flight(moved, size[fly], rng)
        own[fly] = moved
        good = land(own, size, rng, within)
        miss = abs(float((own - p) @ size))
        if good or miss < least:
            best, least = own, miss
        if good or miss <= within:
            break
    return best


def _fly(part: pa.Table) -> pa.Table:
    part = part.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("row", "ascending")])
    rng = np.random.default_rng(zlib.crc32(f"{part['source'][0]}:{part['block'][0]}:{len(part)}".encode()))
    p, size = part["p"].to_numpy().copy(), part["size"].to_numpy().astype(float)
    if part["blocks"][0].as_py() > 1:
        flight(p, size, rng)
    else:
        p = fly_and_land(p, size, rng, NEAR * part["target"][0].as_py())
    return part.set_column(part.column_names.index("p"), "p", pa.array(p))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of `docs`."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("doc_id", "text").alias("row"))
    sized = materialize(rows.groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("times")))
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.sum("times").alias("n"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") / block).cast("long"))
    plan = materialize(source_targets(sources, weights, share, most).select(F.col("source").alias("of"), "source_size", "target", ratio.alias("ratio"), blocks.alias("blocks")))
    n_sources, most_blocks = plan.agg(F.count("*"), F.max("blocks")).first()
    plan_df = F.broadcast(plan) if n_sources <= BROADCAST_ROWS else plan
    # the copies of a row, in chunks and then one by one
    sized = sized.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / _CHUNK))))
    first = F.col("_chunk") * _CHUNK
    sized = sized.withColumn("_copy", F.explode(F.sequence(first, F.least(first + _CHUNK, F.col("times")) - 1)))
    sized = sized.withColumn("row", F.when(F.col("times") > 1, F.xxhash64("row", "_copy")).otherwise(F.col("row"))).drop("_chunk", "_copy", "times")
    rows = sized.join(plan_df, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    copies = F.floor(F.col("ratio") + F.lit(_EDGE))
    rows = rows.select(
        "doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), F.greatest(F.col("ratio") - copies, F.lit(0.0)).alias("p"),
        F.pmod(F.xxhash64("row", F.lit(11)), F.col("blocks")).alias("block"), "blocks", "row",
    )
    most_blocks, settled = most_blocks or 1, []
    open_ = rows
    step = block // 2  # each block leaves two fractions at most: so many blocks make one of the next level
    while True:
        flown = open_.groupBy("source", "block").applyInArrow(_fly, rows.schema)
        if most_blocks == 1:
            settled.append(flown)
            break
        flown = materialize(flown)
        settled.append(flown.filter((F.col("p") == 0) | (F.col("p") == 1)))
        most_blocks = -(-most_blocks // step)
        open_ = flown.filter((F.col("p") > 0) & (F.col("p") < 1)).withColumns({"block": F.floor(F.col("block") / step).cast("long"), "blocks": F.ceil(F.col("blocks") / step).cast("long")})
    out = settled[0]
    for x in settled[1:]:
        out = out.union(x)
    copies = (F.col("copies") + F.col("p")).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
