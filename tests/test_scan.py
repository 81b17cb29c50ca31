"""Growing logs: what is opened, what is read, and how lines are named."""

from __future__ import annotations

import json
import os
import random
from datetime import datetime, timezone

import pytest

from tallyspark.sources import scan

NOW = datetime(2024, 6, 1)


def write(path, data: bytes, at: float | None = None):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    stamp = at if at is not None else NOW.replace(tzinfo=timezone.utc).timestamp() + random.random()
    os.utime(path, (stamp, stamp))


def plain(root):
    """(file, line, value) of whole lines, by Python."""
    out = []
    for path in sorted(root.rglob("*.jsonl")):
        at = 0
        for line in path.read_bytes().split(b"\n")[:-1]:
            if line:
                out.append((str(path), at, line.decode()))
            at += len(line) + 1
    return out


def rows(df):
    return sorted((r.file, r.line, r.value) for r in df.collect())


@pytest.mark.parametrize("range_", [1, 7, 64, 1 << 20])
def test_lines_are_the_same_however_files_are_split(spark, tmp_path, range_):
    rng = random.Random(1)
    for i in range(4):
        write(tmp_path / "logs" / f"p{i % 2}" / f"{i}.jsonl", "\n".join("é" * rng.randrange(0, 30) for _ in range(25)).encode())
    write(tmp_path / "logs" / "p0" / "none.jsonl", b"no newline yet")
    write(tmp_path / "logs" / "p0" / "empty.jsonl", b"")
    write(tmp_path / "logs" / "p0" / "notes.txt", b"no log\n")
    expected = plain(tmp_path / "logs")
    write(tmp_path / "logs" / ".hidden" / "h.jsonl", b"hidden\n")
    assert rows(scan.lines(spark, str(tmp_path / "logs"), range_=range_)) == expected


def test_long_lines_are_looked_back_for(spark, tmp_path):
    write(tmp_path / "a.jsonl", b"x" * (3 * scan.BACK) + b"\n" + b"y" * 10 + b"\n" + b"z" * (2 * scan.BACK) + b"\nrest")
    assert rows(scan.lines(spark, str(tmp_path), range_=scan.BACK // 2)) == plain(tmp_path)


def test_old_and_missing_roots(spark, tmp_path):
    write(tmp_path / "old.jsonl", b"old\n", datetime(2022, 1, 1).timestamp())
    write(tmp_path / "new.jsonl", b"new\n")
    assert [r[2] for r in rows(scan.lines(spark, str(tmp_path), NOW))] == ["new"]
    assert rows(scan.lines(spark, str(tmp_path / "nothing"))) == []


def test_plans_by_marks():
    cutoff = 100
    listed = {"same": [10, 500], "grown": [30, 600], "shrunk": [5, 600], "touched": [10, 700], "new": [8, 500], "old": [9, 50], "old grown": [12, 60]}
    marks = {"same": [10, 500], "grown": [20, 500], "shrunk": [10, 500], "touched": [10, 500], "gone": [10, 500], "old grown": [9, 50]}
    after, pieces = scan.planned(marks, listed, cutoff)
    assert after == listed
    assert sorted(pieces) == [("grown", 20, 30, 600), ("new", 0, 8, 500), ("old grown", 9, 12, 60), ("shrunk", 0, 5, 600)]


class Follower:
    """Runs the stream over what there is, batch after batch, and says which bytes were planned and which lines came."""

    def __init__(self, spark, root, state):
        self.spark, self.root, self.state, self.n = spark, root, state, 0

    def poll(self):
        self.n += 1
        out = str(self.state / "out")
        stream = scan.added_lines(self.spark, str(self.root), str(self.state / "marks"), NOW)
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(self.state / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        got = rows(self.spark.read.schema(scan.SCHEMA).parquet(out))
        return got

    def version(self):
        names = sorted(int(f.stem) for f in (self.state / "marks").glob("*.json"))
        return json.loads((self.state / "marks" / f"{names[-1]}.json").read_text())


def test_a_stream_reads_what_was_added(spark, tmp_path):
    root = tmp_path / "logs"
    write(root / "a.jsonl", b"one\ntwo\nhal")
    write(root / "b.jsonl", b"b1\n")
    write(root / "old.jsonl", b"never\n", datetime(2022, 1, 1).timestamp())
    follow = Follower(spark, root, tmp_path)
    a, b, old = (str(root / f"{x}.jsonl") for x in ("a", "b", "old"))
    assert follow.poll() == [(a, 0, "one"), (a, 4, "two"), (b, 0, "b1")]

    (root / "b.jsonl").chmod(0)  # unchanged: whoever opens it fails, unless it is root
    write(root / "a.jsonl", b"one\ntwo\nhalf done\nfour\n")
    found = follow.poll()
    assert found == [(a, 0, "one"), (a, 4, "two"), (a, 8, "half done"), (a, 18, "four"), (b, 0, "b1")]
    assert [p[:3] for p in follow.version()["pieces"]] == [[a, 11, 23]]  # only what was added is read

    before = follow.version()
    assert follow.poll() == found and follow.version() == before  # nothing new, no batch

    os.utime(a, (2e9, 2e9))  # touched: the mark moves, nothing is read
    assert follow.poll() == found and follow.version()["marks"][a] == [23, 2_000_000_000_000_000] and follow.version()["pieces"] == before["pieces"]

    write(root / "a.jsonl", b"anew\n", 2.1e9)  # shorter: from its start
    assert follow.poll() == sorted([*found, (a, 0, "anew")])

    (root / "b.jsonl").unlink()
    write(root / "old.jsonl", b"never\nbut this\n", 2.2e9)  # consumed unread, then grown
    assert follow.poll() == sorted([*found, (a, 0, "anew"), (old, 6, "but this")])
    assert set(follow.version()["marks"]) == {a, old}
    assert len(list((tmp_path / "marks").glob("*.json"))) <= 2


def test_a_batch_that_runs_again_reads_the_same_bytes(tmp_path):
    root = tmp_path / "logs"
    write(root / "a.jsonl", b"one\ntwo\n")
    options = {"path": str(root), "marks": str(tmp_path / "marks"), "now": NOW.isoformat()}
    first = scan._Marked(options)
    end = first.latestOffset()
    planned = [p.piece for p in first.partitions({"version": 0}, end)]
    write(root / "a.jsonl", b"one\ntwo\nthree\n")
    again = scan._Marked(options)  # after a failure: the version announced before still stands
    assert [p.piece for p in again.partitions({"version": 0}, end)] == planned
    later = again.latestOffset()
    assert [p.piece[1:3] for p in again.partitions(end, later)] == [(8, 14)]
    assert [p.piece[1:3] for p in again.partitions({"version": 0}, later)] == [(0, 8), (8, 14)]  # announced, never run
