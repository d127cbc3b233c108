"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's docs.  All stages but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cadentia.llm import decontaminate, line_dedup, minhash_dedup, quality_rules, source_mixing
from cadentia.llm.common import shared_folder

STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("minhash_dedup", minhash_dedup.stage),
    ("decontaminate", decontaminate.stage),
    ("source_mixing", source_mixing.stage),
]

#: SQL can't express the certified cutoffs' choice and the bisected exponent; tests use a brute-force version.
ORACLE_SQL = None


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, through the shared folder of spark.checkpoint.dir; a stage's rows go once the next one's are written."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}.parquet"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
