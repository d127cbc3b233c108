"""Helpers that the corpus operators share: reading, Arrow kernels, token hashing, checkpoints."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kernels travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__.partition(".")[0]])

#: What an Arrow batch may hold: rows, and bytes, which bound it where documents are long.
BATCH_ROWS, BATCH_BYTES = 100_000, 3 << 20

MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch brings into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there, so a lost executor loses nothing.

    The folder is the one that the cluster names in ``spark.checkpoint.dir``;
    only where that is unset, and executors run in this very process, a
    temporary one is used.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one where it is unset and all runs in one process."""
    sc = spark.sparkContext
    if named := sc.getConf().get("spark.checkpoint.dir"):
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return tempfile.mkdtemp(prefix="cadentia-checkpoint-")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (and more columns), whatever else the input has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def arrow_map(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    tune(df.sparkSession)
    return df.mapInArrow(kernel, schema)


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column without nulls as int64."""
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= MIX1
    x ^= x >> np.uint64(33)
    x *= MIX2
    x ^= x >> np.uint64(33)
    return x


class WordHash(dict):
    """word -> 64-bit hash, each word hashed once; emptied when it has grown large."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def hashed(words: list[bytes], known: WordHash) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and length, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the id's text, modulo n."""
    return F.crc32(column.cast("string")) % n


#: Ids that may be broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``ids`` (written, distinct), without moving the texts where the ids are few."""
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


#: Numbers that one row of a table of counts carries.
STRIP = 1 << 13


def packed_counts(row: np.ndarray) -> bytes:
    """STRIP counts as bytes: places and counts where few are not 0, else all of them."""
    at = np.nonzero(row)[0]
    if len(at) < STRIP // 2 and row.max(initial=0) < 1 << 31:
        return b"\1" + at.astype(np.uint16).tobytes() + row[at].astype(np.int32).tobytes()
    return b"\0" + row.astype(np.int64).tobytes()


def add_counts(total: np.ndarray, data: bytes) -> None:
    if data[0]:
        n = (len(data) - 1) // 6
        total[np.frombuffer(data, np.uint16, n, 1)] += np.frombuffer(data, np.int32, n, 1 + 2 * n)
    else:
        total += np.frombuffer(data, np.int64, -1, 1)


def strips(cells: np.ndarray) -> pa.RecordBatch:
    """A task's table of counts (a multiple of STRIP) as rows; empty strips are left out."""
    rows = cells.reshape(-1, STRIP)
    full = np.nonzero(rows.any(axis=1))[0]
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([packed_counts(rows[i]) for i in full], pa.binary())], names=["strip", "cells"])


def summed(part: DataFrame, size: int) -> np.ndarray:
    """The tasks' tables of ``size`` counts added up; what reaches the driver is one table, whatever the corpus.

    Two steps, so that no task adds up the strips of more than a 64th of the tasks.
    """

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(STRIP, np.int64)
        for x in t.column("cells"):
            add_counts(total, x.as_py())
        return pa.table({"strip": t.column("strip")[:1], "cells": pa.array([packed_counts(total)], pa.binary())})

    schema = "strip int, cells binary"
    half = part.groupBy("strip", F.pmod(F.spark_partition_id(), F.lit(64))).applyInArrow(add, schema)
    out = np.zeros(size, np.int64)
    for r in half.groupBy("strip").applyInArrow(add, schema).toArrow().to_pylist():
        add_counts(out[r["strip"] * STRIP : (r["strip"] + 1) * STRIP], r["cells"])
    return out


def with_rows(docs: DataFrame, side: DataFrame) -> DataFrame:
    """Inner join on doc_id with a narrow table of unique ids, broadcast only where it is counted to be small."""
    small = side.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(side) if small else side, "doc_id")


#: Rows of one key that a join brings to one task, about; a key of more is dealt out in parts.
PART_ROWS = 1000


def hot_keys(rows: DataFrame, key: list[str], size: Column | None = None) -> DataFrame | None:
    """(key, parts) of the keys with more than PART_ROWS of ``rows`` (written), or of that summed ``size``: one for each PART_ROWS rows at most, broadcast only where they are counted to be few; None if there are none."""
    size = F.count("*") if size is None else F.sum(size)
    hot = rows.groupBy(*key).agg(F.ceil(size / PART_ROWS).cast("long").alias("parts")).where("parts > 1")
    n = hot.limit(BROADCAST_IDS + 1).count()
    if not n:
        return None
    hot = durable(hot)
    return F.broadcast(hot) if n <= BROADCAST_IDS else hot


def split_join(rows: DataFrame, side: DataFrame, key: list[str], by: str, hot: DataFrame | None) -> DataFrame:
    """Inner join of ``rows`` with ``side``, whose keys are unique, where one key may hold any share of the rows.

    The rows of a key in ``hot`` (of hot_keys) are dealt to its parts by the
    column ``by``, and its row of ``side`` is repeated once for each part.
    """
    if hot is None:
        return rows.join(side, key)
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = rows.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), parts)).drop("parts")
    repeated = side.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("parts")
    return dealt.join(repeated, [*key, "part"]).drop("part")
