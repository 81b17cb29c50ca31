"""A ledger of turns and totals that grows by batches: upserts by bucket, totals revised by signed deltas, days folded.

Two tables of parquet files. `turns` has one row for each message, in buckets of a hash of its id. `totals` has sums by day, chat,
agent, model and so on, in parts of one day. A manifest says which generation of each part is current. A batch reads the
buckets that its ids fall in and the days that it changes, writes these anew and commits both tables by the next manifest, a
small file that appears all at once. So readers see whole batches, other parts are never touched, and a batch costs what it
changes.

A later reading of a message changes its counters, and an earlier record its first dimensions. What leaves the totals is the
message as it was, what enters is the message as it is: the same sums as a full recount of all records, in whatever order and
batches they came.

Each manifest names the batches it holds by stream. A batch that runs again after a failure is skipped if it is there, and
otherwise written over what the failed attempt left. A stream that begins with another checkpoint adds to what there is. Files
of a part that a newer manifest replaced go one manifest later, when its readers are done.

`fold` drops the detail before a day and keeps its totals. A folded day takes no more batches: what comes for it replays what
was counted. `replace_day` counts one day anew and touches no other.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyspark.functions import files
from tallyspark.functions.frames import dealt
from tallyspark.operators.dedup import composite_id
from tallyspark.schema import COUNTERS, TURNS

DIMENSIONS = ("provider", "project", "chat_id", "agent_id", "model", "effort")
#: `most_seq`: the record that the counters are from, for `seq` is the first one's.
_TURN = T.StructType([*TURNS.fields, T.StructField("most_seq", T.LongType())])
_TOTAL = T.StructType([T.StructField("day", T.DateType()), *(T.StructField(d, T.StringType()) for d in DIMENSIONS), *(T.StructField(c, T.LongType()) for c in ("turns", *COUNTERS))])
#: Rows that a task merges, about.
_TASK_ROWS = 200_000
_SCHEMAS = {"turns": _TURN, "totals": _TOTAL}


@dataclass(frozen=True)
class Ledger:
    """A ledger in the folder `path`; `buckets` is fixed by its first batch."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def manifest(self) -> dict:
        """The newest commit: version, buckets, applied (the last batch of each stream), folded (the day before which there is
        no detail), parts (table -> part -> generation), and gone (what it replaced)."""
        folder = f"{self.path}/manifests"
        versions = [int(n) for n in files.names(self.spark, folder) if n.isdigit()]
        if not versions:
            return {"version": 0, "buckets": self.buckets, "applied": {}, "folded": None, "parts": {"turns": {}, "totals": {}}, "gone": []}
        return json.loads(files.read_text(self.spark, f"{folder}/{max(versions)}"))

    def turns(self) -> DataFrame:
        return self._current(self.manifest(), "turns").drop("most_seq")

    def totals(self) -> DataFrame:
        return self._current(self.manifest(), "totals")

    def _folder(self, table: str, generation: int, part: str) -> str:
        return f"{self.path}/{table}/generation={generation}/part={part}"

    def _current(self, manifest: dict, table: str, parts: list[str] | None = None) -> DataFrame:
        """The rows of some parts (of all, by default); those that there are not have none."""
        held = manifest["parts"][table]
        paths = [self._folder(table, held[p], p) for p in (held if parts is None else parts) if p in held]
        return self.spark.read.schema(_SCHEMAS[table]).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMAS[table])

    def _write(self, rows: DataFrame, part: Column, table: str, generation: int) -> None:
        laid = rows.withColumn("part", part.cast("string")).hint("rebalance", "part")  # a large part is split among tasks
        laid.write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/{table}/generation={generation}")

    def _commit(self, before: dict, written: dict[str, list[str]], **changes: object) -> None:
        """The next manifest: `written` parts are of its own generation, or empty and so not there."""
        version = before["version"] + 1
        parts, gone = {t: dict(p) for t, p in before["parts"].items()}, []
        for table, touched in written.items():
            there = set(files.names(self.spark, f"{self.path}/{table}/generation={version}"))
            for p in touched:
                if p in parts[table]:
                    gone.append([table, parts[table].pop(p), p])
                if f"part={p}" in there:
                    parts[table][p] = version
        after = before | {"version": version, "parts": parts, "gone": gone} | changes
        files.put_text(self.spark, f"{self.path}/manifests/{version}", json.dumps(after))
        for table, generation, part in before["gone"]:
            files.remove(self.spark, self._folder(table, generation, part))
        files.remove(self.spark, f"{self.path}/manifests/{version - 2}")

    def _bucket(self, manifest: dict) -> Column:
        return F.pmod(F.xxhash64("msg_id"), F.lit(manifest["buckets"]))

    def apply(self, records: DataFrame, stream: str, number: int) -> None:
        """Merge one batch of turn records."""
        held = self.manifest()
        if held["applied"].get(stream, -1) >= number:
            return
        fresh = _records(records)
        if held["folded"]:
            fresh = fresh.filter(F.col("ts") >= F.lit(held["folded"]).cast("timestamp_ntz"))
        fresh = fresh.persist()
        touched = [str(r[0]) for r in fresh.select(self._bucket(held)).distinct().collect()]
        merged = _merged(self._current(held, "turns", touched), fresh).persist()
        written: dict[str, list[str]] = {}
        if touched:
            generation = held["version"] + 1
            self._write(merged.select(*_TURN.names), self._bucket(held), "turns", generation)
            deltas = _sums(merged.filter("touched").select(F.lit(1).alias("turns"), *_TURN.names).unionByName(merged.filter("touched and old is not null").select(F.lit(-1).alias("turns"), "old.*")))
            deltas = deltas.persist()
            days = [str(r[0]) for r in deltas.select("day").distinct().collect()]
            self._write(_added(self._current(held, "totals", days), deltas), F.col("day"), "totals", generation)
            written = {"turns": touched, "totals": days}
            deltas.unpersist()
        self._commit(held, written, applied=held["applied"] | {stream: number})
        merged.unpersist()
        fresh.unpersist()

    def follow(self, records: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Merge a stream of turn records, batch by batch; what is there now, or as `trigger` says."""
        write = lambda batch, number: self.apply(batch, checkpoint, number)
        return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def fold(self, before: date) -> None:
        """Drop the turns before a day; its totals, and all earlier ones, stay as they are."""
        held = self.manifest()
        if held["folded"] and held["folded"] >= before.isoformat():
            return
        rows = self._current(held, "turns").withColumn("_old", F.col("ts") < F.lit(before.isoformat()).cast("timestamp_ntz"))
        touched = [str(r[0]) for r in rows.filter("_old").select(self._bucket(held)).distinct().collect()]
        if touched:
            left = self._current(held, "turns", touched).filter(F.col("ts") >= F.lit(before.isoformat()).cast("timestamp_ntz"))
            self._write(left, self._bucket(held), "turns", held["version"] + 1)
        self._commit(held, {"turns": touched}, folded=before.isoformat())

    def replace_day(self, day: date, records: DataFrame) -> None:
        """One day's turns and totals as these records have them; a folded day's totals alone."""
        held, generation = self.manifest(), self.manifest()["version"] + 1
        own = F.to_date("ts") == F.lit(day)
        rows = _merged(self._current(held, "turns", []), _records(records).filter(own)).select(*_TURN.names).persist()
        self._write(_sums(rows.withColumn("turns", F.lit(1))), F.col("day"), "totals", generation)
        written = {"totals": [day.isoformat()]}
        if not held["folded"] or day.isoformat() >= held["folded"]:
            there = self._current(held, "turns").filter(own).select("msg_id").unionByName(rows.select("msg_id"))
            touched = [str(r[0]) for r in there.select(self._bucket(held)).distinct().collect()]
            if touched:
                others = self._current(held, "turns", touched).filter(~own)
                self._write(others.unionByName(rows), self._bucket(held), "turns", generation)
            written["turns"] = touched
        self._commit(held, written)
        rows.unpersist()


def _records(records: DataFrame) -> DataFrame:
    rows = records.withColumn("msg_id", composite_id()).withColumn("most_seq", F.col("seq"))
    return rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in _TURN)).filter("ts is not null")


def _merged(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row for each message of both; `touched`: the batch has it; `old`: the message as it was, null if it is new."""
    rows = old.withColumns({"_new": F.lit(False), "_was": F.struct(*_TURN.names)}).unionByName(fresh.withColumns({"_new": F.lit(True), "_was": F.lit(None).cast(_TURN)}))
    own = [c for c in _TURN.names if c not in (*COUNTERS, "msg_id", "most_seq")]
    found = dealt(rows, ["msg_id"], old.count() + fresh.count(), _TASK_ROWS).groupBy("msg_id").agg(  # one shuffle, then one sort: few records repeat
        F.min_by(F.struct(*own), "seq").alias("_first"), F.max_by(F.struct(*COUNTERS, "most_seq"), F.struct(F.col("output"), -F.col("most_seq"))).alias("_most"),
        F.bool_or("_new").alias("touched"), F.first("_was", ignorenulls=True).alias("old"),
    )
    return found.select("msg_id", "_first.*", "_most.*", "touched", "old").select(*_TURN.names, "touched", "old")


def _sums(turns: DataFrame) -> DataFrame:
    """Totals of turns, each counted `turns` times (-1: taken back)."""
    keys = [F.to_date("ts").alias("day"), *DIMENSIONS]
    out = turns.groupBy(*keys).agg(F.sum("turns").alias("n"), *(F.sum(F.col("turns") * F.coalesce(c, F.lit(0))).alias(c) for c in COUNTERS))
    return out.select("day", *DIMENSIONS, F.col("n").cast("long").alias("turns"), *COUNTERS)


def _added(totals: DataFrame, deltas: DataFrame) -> DataFrame:
    """Totals with deltas; what has come to nothing is left out."""
    both = totals.unionByName(deltas).groupBy("day", *DIMENSIONS).agg(*(F.sum(c).alias(c) for c in ("turns", *COUNTERS)))
    return both.filter(" or ".join(f"{c} <> 0" for c in ("turns", *COUNTERS))).select(*_TOTAL.names)
