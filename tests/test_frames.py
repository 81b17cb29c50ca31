"""Running functions over slices against plain windows; interval joins against nested loops."""

from __future__ import annotations

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions.frames import first_of, ranked, running, within


def test_running_equals_plain_windows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.choice([None, 1, 2, 3]), rng.randrange(100)) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, x int, y int")
    found = running(df, ["k"], ["t"], F.floor(F.col("t") / 7), lag={"p": "x"}, lead={"n": "x"}, last={"l": F.col("x")}, before={"b": F.col("x")}, total={"s": F.col("y")})
    w = Window.partitionBy("k").orderBy("t")
    ahead = w.rowsBetween(Window.unboundedPreceding, -1)
    plain = df.withColumns({"p": F.lag("x").over(w), "n": F.lead("x").over(w), "l": F.last("x", True).over(w), "b": F.last("x", True).over(ahead), "s": F.sum("y").over(w)})
    columns = ["k", "t", "x", "y", "p", "n", "l", "b", "s"]
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(map(tuple, plain.select(columns).collect()), key=repr)


def test_running_takes_structs_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "q"), ("a", 9, None)], "k string, t long, v string")
    found = running(df, ["k"], ["t"], F.col("t"), last={"m": F.when(F.col("v").isNotNull(), F.struct("v"))})
    assert [(r["t"], r["m"] and r["m"]["v"]) for r in found.orderBy("t").collect()] == [(1, None), (2, "q"), (9, "q")]
    assert running(df.limit(0), ["k"], ["t"], F.col("t"), lag={"p": "v"}).count() == 0


def test_interval_joins(spark):
    rng = random.Random(5)
    points = [("a", rng.randrange(10**5)) for _ in range(200)]
    spans = [("a", i, s, s + rng.randrange(20_000)) for i, s in enumerate(rng.randrange(10**5) for _ in range(20))]
    at = lambda c: F.timestamp_seconds(c).cast("timestamp_ntz")
    p = spark.createDataFrame(points, "k string, s long").select("k", "s", at("s").alias("ts"))
    w = spark.createDataFrame(spans, "k string, id int, a long, b long").select("k", "id", at("a").alias("start"), at("b").alias("end"))
    found = within(p, "ts", w, ["k"], (F.col("ts") > F.col("start")) & (F.col("ts") <= F.col("end")), 3600)
    assert sorted((r["s"], r["id"]) for r in found.collect()) == sorted((s, i) for _, s in points for _, i, a, b in spans if a < s <= b)


def test_first_and_ranked(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 5, "z")], "k string, n int, v string")
    assert {tuple(r) for r in first_of(df, ["k"], [F.col("n")]).collect()} == {("a", 1, "x"), ("b", 5, "z")}
    assert {tuple(r) for r in ranked(df, ["k"], [F.desc("n")], 1).select("k", "v", "rank").collect()} == {("a", "y", 1), ("b", "z", 1)}


def test_written_tables_are_removed_with_the_application(spark, tmp_path):
    from pathlib import Path

    from tallyspark.functions import frames

    df = frames.written(spark.range(5))
    folder = Path(frames.folder(spark).removeprefix("file://").removeprefix("file:"))
    assert df.count() == 5 and any(folder.iterdir())
    frames.clear(spark)
    assert not folder.exists()
