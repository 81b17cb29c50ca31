"""What the training-data operators share: tables, checkpoints, folds and Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; bounds the temporaries of a Python worker.
PASS_BYTES = 1 << 20
#: Rows up to which a measured table is broadcast; beyond that the join shuffles.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set, a local session gets one of its own; a cluster is told to set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write `df` to the shared folder and read it back: its lineage ends at files that outlive an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove tables that `materialize` wrote, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if folder.rpartition("/")[2].startswith("table-"):
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished stages: Spark removes them once the driver's garbage is collected. The driver's heap
    shrinks to what is in use, and its Python gives back what it doesn't use."""
    spark.sparkContext._jvm.System.gc()
    trim()


def free(name: str, columns: list[str]) -> str:
    """`name`, with underscores before it until none of `columns` has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def held(df: DataFrame) -> DataFrame:
    """`df`, kept in memory and on the executors' disks for several uses; blocks of a lost executor are made again.

    For results that are small beside their input: unlike a written table it leaves no files, one for each task.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo `parts`; null for a null id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(parts)


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int = 1) -> DataFrame:
    """The rows of about `most` values of `key` at most, chosen by their hash: reruns agree, and nothing is sorted or gathered."""
    n = rows.agg(F.approx_count_distinct(key, 0.01)).first()[0]
    if n <= most:
        return rows
    keep = int(most / n * 1_000_000)
    return rows.filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1_000_000)) < keep)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets.astype(np.int64)


def passes(offsets: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about `most` bytes; a longer text is a range of its own."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


Scan = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trim() -> None:
    """Give memory that this process doesn't use back to the system."""
    pa.default_memory_pool().release_unused()
    if given := getattr(ctypes.CDLL(None), "malloc_trim", None):
        given(0)


def tidy(scan: Scan) -> Scan:
    """`scan`, giving back at its end what its batches held: workers live on and do other tasks beside the executor's heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(batches)
        trim()

    return run


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, without a copy: bounds what Python objects a scan makes at once."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def packed(bucket: np.ndarray, weight: np.ndarray) -> tuple[bytes, bytes]:
    """A sparse vector as two binary cells."""
    return bucket.astype("<i4").tobytes(), weight.astype("<f4").tobytes()


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of `values[start:end]` for each pair; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[starts]
