"""A training-corpus pipeline: language, repeated lines, near copies, benchmark passages, mix.

Each stage takes (spark, docs, sf_dir) and works on what its predecessor wrote. All but the last return the columns of
`documents`:

1. language ID learns from the rows with a language and drops the documents it rejects (no letter, or no sure language);
2. line dedup takes repeated lines out of the texts, but for their largest doc_id, and recounts n_chars where one went;
3. near-duplicates (five-word shingles, a Jaccard similarity of 0.8 or more) keep one document of each group, the smallest
   doc_id (a null one only if no other is in the group; rows that share a doc_id are told apart by their texts);
4. decontamination drops the documents in which a benchmark item is found;
5. the mix says how often each document is taken to meet its source's target.

Null, empty and repeated rows are treated as each operator says; an empty table passes through all stages. Each stage first lets
the driver give back what the one before it left (`release`).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontam, language, linededup, mixing, nearcopies
from tallyspark.llm.base import free, release, shared_dir, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return language.keep_known(docs, language.train(docs, F.lit(True)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    cleaned = linededup.LineIndex.build(docs).clean(docs)
    dropped = F.col(free("n_dropped", docs.columns)) > 0
    chars = F.when(dropped, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", chars).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return nearcopies.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    release(spark)
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_near_copies),
    ("benchmark decontamination", decontaminate),
    ("source mixing", mix_sources),
]

#: The first stage's trained model can't be said in SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written to the shared folder and read back."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
