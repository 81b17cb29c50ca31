"""DataFrame helpers that keep hot keys apart: running functions over time slices, interval joins over time cells."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.functions.moments import cell

#: Rows up to which a counted side of a join is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 100_000
#: Rows that a task of `dealt` sorts, about.
TASK_ROWS = 500_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, broadcast if its known number of rows allows it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def dealt(df: DataFrame, keys: list[str], n: int | None = None, rows: int = TASK_ROWS) -> DataFrame:
    """`df` (of `n` rows, or it is counted) hash-partitioned by `keys`, about `rows` rows to a task at any size.

    What follows by these keys, or by more, needs no other shuffle. Spark's own number of partitions is fixed or goes by compressed
    bytes, so a task's rows, and what it sorts, may grow with the table.
    """
    n = df.count() if n is None else n
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // rows)), *keys)


def folder(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below the shared checkpoint folder. A local session gets one of its
    own where none is set; a cluster is told to set it, as its executors don't share a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """`df`, written to the shared folder and read back: computed once for several uses, and its lineage ends there.

    Frames are lazy, so the tables stay until `clear`, which also runs when Python ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    atexit.unregister(clear)
    atexit.register(clear, spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all tables that `written` wrote in this application."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    slice_: Column,
    *,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    last: dict[str, Column] | None = None,
    before: dict[str, Column] | None = None,
    total: dict[str, Column] | None = None,
    peak: dict[str, Column] | None = None,
) -> DataFrame:
    """Running functions of a key's rows in `order`, without gathering the key's rows in one task.

    `slice_` (non-decreasing along `order`) cuts each key's rows into slices. A window runs over each slice alone; what the
    earlier slices hand on is one row each, from an aggregate that is combined before the shuffle. Both sides of the join
    are partitioned by key and slice already, so the rows are shuffled once, and a key with a third of all rows is spread
    over its slices.

    lag, lead: new name -> column, of the neighbouring row. last: the latest value that isn't null, this row's included;
    before: the same without this row. total: the sum up to and with this row. peak: the largest value before this row. Keys
    and slices must not be null.
    """
    lag, lead, last, before, total, peak = (x or {} for x in (lag, lead, last, before, total, peak))
    named = {f"_v{i}": e for i, e in enumerate([*last.values(), *before.values(), *total.values(), *peak.values()])}
    df = df.withColumns({"_slice": slice_, **named})
    value = dict(zip([*(("last", n) for n in last), *(("before", n) for n in before), *(("total", n) for n in total), *(("peak", n) for n in peak)], named, strict=True))
    here = F.struct(*order)
    ends = {f"_lag_{n}": F.max_by(c, here) for n, c in lag.items()} | {f"_lead_{n}": F.min_by(c, here) for n, c in lead.items()}
    for (what, n), v in value.items():
        ends[f"_{what}_{n}"] = F.sum(v) if what == "total" else F.max(v) if what == "peak" else F.max_by(v, F.when(F.col(v).isNotNull(), here))
    each = df.groupBy(*keys, "_slice").agg(*(e.alias(n) for n, e in ends.items()))
    over = Window.partitionBy(*keys).orderBy("_slice")
    past = over.rowsBetween(Window.unboundedPreceding, -1)
    handed = {f"_lag_{n}": F.lag(f"_lag_{n}").over(over) for n in lag} | {f"_lead_{n}": F.lead(f"_lead_{n}").over(over) for n in lead}
    handed |= {f"_{w}_{n}": F.sum(f"_{w}_{n}").over(past) if w == "total" else F.max(f"_{w}_{n}").over(past) if w == "peak" else F.last(f"_{w}_{n}", ignorenulls=True).over(past) for w, n in value}
    carried = each.select(*keys, "_slice", *(e.alias(n) for n, e in handed.items()))

    own = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto, ahead = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(Window.unboundedPreceding, -1)
    local = {f"_own_{n}": F.lag(c).over(own) for n, c in lag.items()} | {f"_next_{n}": F.lead(c).over(own) for n, c in lead.items()}
    local |= {"_first": F.row_number().over(own) == 1} if lag else {}
    local |= {"_final": F.lead(F.lit(1)).over(own).isNull()} if lead else {}
    for (what, n), v in value.items():
        local[f"_in_{what}_{n}"] = F.sum(v).over(upto) if what == "total" else F.max(v).over(ahead) if what == "peak" else F.last(v, ignorenulls=True).over(upto if what == "last" else ahead)
    joined = df.withColumns(local).join(carried, [*keys, "_slice"])
    out = {n: F.when(F.col("_first"), F.col(f"_lag_{n}")).otherwise(F.col(f"_own_{n}")) for n in lag}
    out |= {n: F.when(F.col("_final"), F.col(f"_lead_{n}")).otherwise(F.col(f"_next_{n}")) for n in lead}
    for what, n in value:
        inner, outer = F.col(f"_in_{what}_{n}"), F.col(f"_{what}_{n}")
        out[n] = F.coalesce(inner, F.lit(0)) + F.coalesce(outer, F.lit(0)) if what == "total" else F.greatest(inner, outer) if what == "peak" else F.coalesce(inner, outer)
    kept = [c for c in df.columns if c not in named and c != "_slice"]
    return joined.select(*(F.col(c) for c in kept if c not in out), *(e.alias(n) for n, e in out.items()))


def within(points: DataFrame, at: str, spans: DataFrame, keys: list[str], inside: Column, grain: int, counted: bool = False) -> DataFrame:
    """Points joined with the spans (`start`, `end`) of the same keys that hold them, as `inside` says.

    Spans are laid out over the time cells of `grain` seconds that they touch, so the join is an equi-join on key and cell
    with `inside` left to check: no nested loop, and a hot key is spread over its cells. With `counted`, spans that are few once
    laid out are broadcast, and the points aren't shuffled.
    """
    cells = F.explode(F.sequence(cell("start", grain), cell("end", grain)))
    laid = spans.withColumn("_cell", cells)
    laid = small(laid, laid.count()) if counted else laid
    found = points.withColumn("_cell", cell(at, grain)).join(laid, [*keys, "_cell"])
    return found.filter(inside).drop("_cell")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def first_of(df: DataFrame, keys: list[str], order: list[Column], columns: list[str] | None = None) -> DataFrame:
    """Each key's first row by `order`, by an aggregate that is combined before the shuffle."""
    kept = [c for c in (columns or df.columns) if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*kept), F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)))).alias("_row")).select(*keys, "_row.*")


def ranked(df: DataFrame, keys: list[str], order: list[Column], most: int | None = None, name: str = "rank") -> DataFrame:
    """Rows numbered from 1 within their keys; at most the first `most` of each (Spark then limits groups before the shuffle)."""
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out if most is None else out.filter(F.col(name) <= most)
