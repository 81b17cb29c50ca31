"""Small text files on whatever file system Spark reaches: the commits of tables."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if there is no folder."""
    files, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in files.listStatus(p)) if files.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    files, p = _at(spark, path)
    stream = files.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that wasn't there, all at once; an error if somebody else was faster."""
    files, p = _at(spark, path)
    _, part = _at(spark, f"{path}.part")
    stream = files.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.exists(p) or not files.rename(part, p):
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    files, p = _at(spark, path)
    files.delete(p, True)
