"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ten words.  A table of shifts over two-word blocks
tells how far a cursor may jump; where the shift is zero, the block's bucket
names the patterns to compare with.  Many cursors move in lockstep, one per
piece of text, so each step is one vector operation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, durable, ranges, table, texts, utf8

WINDOW = 10
ROW = "row_number"
#: Windows that are broadcast at once; a larger benchmark is searched in several rounds.
CHUNK_WINDOWS = 500_000
#: Words that one cursor covers.
LANE = 512
NOT_WORD = bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(c for c in NOT_WORD if not 65 <= c <= 90), b"abcdefghijklmnopqrstuvwxyz" + b" " * (len(NOT_WORD) - 26))


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Matcher:
    """Wu-Manber tables for patterns of one length over word numbers (0: a word of no pattern)."""

    def __init__(self, patterns: np.ndarray, items: list[np.ndarray], n_words: int):
        """patterns: distinct, one a row.  items: the item numbers of each."""
        self.m, self.patterns, self.items = patterns.shape[1], patterns, items
        self.block = min(2, self.m)
        self.size = 1 << max(12, int(np.ceil(np.log2(max(2, patterns.size * 4)))))
        self.shift = np.full(self.size, self.m - self.block + 1, np.int32)
        for end in range(self.block, self.m + 1):
            np.minimum.at(self.shift, self.code(patterns[:, end - 2] if self.block == 2 else None, patterns[:, end - 1]), self.m - end)
        code = self.code(patterns[:, -2] if self.block == 2 else None, patterns[:, -1])
        self.order = np.argsort(code, kind="stable")
        self.bucket = np.searchsorted(code[self.order], np.arange(self.size + 1))

    @classmethod
    def of(cls, state: dict) -> Matcher:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def code(self, before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        x = last.astype(np.int64) * 0x9E3779B1
        if before is not None:
            x = x + before.astype(np.int64) * 0x85EBCA77
        return (x ^ x >> 15) & (self.size - 1)

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern number of every occurrence."""
        n, m = len(text), self.m
        if n < m:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        last = np.arange(m - 1, n, LANE, dtype=np.int64)  # each cursor is at the last word of a window
        stop = np.minimum(last + LANE, n)
        ends = []
        while len(last):
            step = self.shift[self.code(text[last - 1] if self.block == 2 else None, text[last])]
            if (hit := step == 0).any():
                ends.append(last[hit])
            last = last + np.maximum(step, 1)
            if not (go := last < stop).all():
                last, stop = last[go], stop[go]
        if not ends:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.concatenate(ends)
        code = self.code(text[at - 1] if self.block == 2 else None, text[at])
        lo, n_in = self.bucket[code], self.bucket[code + 1] - self.bucket[code]
        at, which = np.repeat(at, n_in) - m + 1, self.order[ranges(lo, n_in)]
        for k in range(m):  # direct comparison, word by word
            if not len(at):
                break
            same = text[at + k] == self.patterns[which, k]
            at, which = at[same], which[same]
        return at, which


def tables(rows: list[tuple[int, bytes | str | None]]) -> tuple[dict[bytes, int], list[Matcher], list[int]]:
    """Word numbers, a matcher for each pattern length, and the item ids, of benchmark rows."""
    known: dict[bytes, int] = {}
    windows: dict[int, dict[tuple[int, ...], set[int]]] = {}
    ids: list[int] = []
    for item, text in rows:
        w = [known.setdefault(x, len(known) + 1) for x in words((text or "").encode() if not isinstance(text, bytes) else text)]
        if not w or item is None:
            continue
        m = min(WINDOW, len(w))
        for i in range(len(w) - m + 1):
            windows.setdefault(m, {}).setdefault(tuple(w[i : i + m]), set()).add(len(ids))
        ids.append(item)
    return known, [Matcher(np.array(list(x), np.int32).reshape(len(x), m), [np.array(sorted(s)) for s in x.values()], len(known)) for m, x in sorted(windows.items())], ids


def scan(docs: DataFrame, rows: list[tuple[int, str | None]], keep: tuple[str, ...] = ()) -> tuple[DataFrame, Broadcast]:
    """``docs`` (ROW, doc_id, text) with, for each row, its number of words, the runs of hit words (start * 2**32 + end) and the items found, and columns to ``keep``; and the tables."""
    known, built, ids = tables(rows)
    held = docs.sparkSession.sparkContext.broadcast((known, [vars(m) for m in built], ids))  # plain data: its class may not be installed there

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, plain, ids = held.value
        matchers = [Matcher.of(x) for x in plain]
        get = known.get
        for batch in batches:
            lists = [words(x) for x in utf8(batch, "text")]
            sizes = np.array([len(x) for x in lists], np.int64)
            first = np.concatenate([[0], np.cumsum(sizes + 1)])  # a 0 ends each document
            stream = np.zeros(int(first[-1]) + 1, np.int32)
            for i, x in enumerate(lists):
                stream[first[i] : first[i] + sizes[i]] = np.fromiter((get(w, 0) for w in x), np.int32, len(x))
            runs: list[list[int]] = [[] for _ in lists]
            items: list[set[int]] = [set() for _ in lists]
            for m in matchers:
                at, which = m.find(stream)
                of = np.searchsorted(first, at, "right") - 1
                for d, s, p in zip(of.tolist(), (at - first[of]).tolist(), which.tolist(), strict=True):
                    runs[d].append(s << 32 | s + m.m)
                    items[d].update(m.items[p].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(ROW), batch.column("doc_id"), pa.array(sizes), pa.array([merged(x) for x in runs], pa.list_(pa.int64())), pa.array([sorted(ids[k] for k in x) for x in items], pa.list_(pa.int64())), *(batch.column(c) for c in keep)], names=[ROW, "doc_id", "n_words", "runs", "items", *keep])

    schema = T._parse_datatype_string(f"{ROW} long, doc_id long, n_words long, runs array<long>, items array<long>")
    return arrow_map(docs, kernel, T.StructType([*schema.fields, *(docs.schema[c] for c in keep)])), held


def merged(runs: list[int]) -> list[int]:
    """Overlapping or touching runs joined."""
    out: list[list[int]] = []
    for x in sorted(runs):
        s, e = x >> 32, x & 0xFFFFFFFF
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [s << 32 | e for s, e in out]


def rounds(benchmark: DataFrame, limit: int = CHUNK_WINDOWS) -> tuple[int, Callable[[int], list[tuple[int, str | None]]]]:
    """The number of rounds, and what gives a round's benchmark rows, about ``limit`` windows, dealt by a hash.

    No more than one round's rows are on the driver.  An item id that stands
    in several rows is kept with each; its windows are the rows' windows together.
    """
    n = F.greatest(F.lit(1), F.size(F.split(F.coalesce("text", F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")))
    rows = durable(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("item_row")))
    n_rounds = max(1, -(-(rows.agg(F.sum(n)).head()[0] or 0) // limit))
    return n_rounds, lambda k: [(r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_row"), F.lit(n_rounds)) == k).select("item_id", "text").collect()]


def rescanned(own: DataFrame, n_rounds: int, of: Callable[[int], list[tuple[int, str | None]]]) -> DataFrame:
    """What all rounds find in ``own``, whose ROW is written: every row of the first round, and of the others those with a hit; one round's tables at a time."""
    found = None
    for k in range(n_rounds):
        here, held = scan(own, of(k))
        here = durable(here if found is None else here.where(F.size("runs") > 0))
        held.destroy()
        found = here if found is None else found.unionAll(here)
    return found


def mark(docs: DataFrame, benchmark: DataFrame, limit: int = CHUNK_WINDOWS) -> DataFrame:
    """Per document: words, hit words, items found, and whether any was found.

    Null or wordless texts and items match nothing; with an empty benchmark no
    document is contaminated; rows that repeat a doc_id, or have none, get a
    row each.  Over several rounds a row is known by a number of its own,
    which is written with its text before the first.
    """
    n_rounds, of = rounds(benchmark, limit)
    own = texts(docs)
    if n_rounds == 1:
        all_of, _ = scan(own.withColumn(ROW, F.lit(0).cast("long")), of(0))
    else:
        all_of = rescanned(durable(own.withColumn(ROW, F.monotonically_increasing_id())), n_rounds, of)
        all_of = all_of.groupBy(ROW, "doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = [sum((x & 0xFFFFFFFF) - (x >> 32) for x in merged(r)) for r in batch.column("runs").to_pylist()]
            items = [sorted({str(x) for x in r}) for r in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]), pa.array([x > 0 for x in n_hit], pa.bool_())], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return arrow_map(all_of, kernel, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean(docs: DataFrame, benchmark: DataFrame, limit: int = CHUNK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` without a benchmark window, each judged by its own text, also where a doc_id repeats or is null."""
    n_rounds, of = rounds(benchmark, limit)
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if n_rounds == 1:
        return scan(own.withColumn(ROW, F.lit(0).cast("long")), of(0), ("row",))[0].where(F.size("runs") == 0).select("row.*")
    own = durable(own.withColumn(ROW, F.monotonically_increasing_id()))
    bad = durable(rescanned(own, n_rounds, of).where(F.size("runs") > 0).select(ROW).distinct())
    return own.join(bad, ROW, "left_anti").select("row.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark window."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, CAST(len(w) - m + 2 AS BIGINT))) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)),
hits AS (SELECT doc_id, i, dw.m AS m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
