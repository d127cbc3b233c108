"""Vector codes by parts (product quantisation), with a GNAT over each part's codebook entries.

A tree's split points keep, for every child, the range of distances from the
split point to the child's entries.  A part's distance to a split point then
rules out whole children whose range lies strictly beyond the best distance
known.  Ranges are rounded outwards and all comparisons that decide are between
integer squared distances, so ties go to the lowest index, as by trying all.

Vectors that are null or hold null or non-finite components are left out, as are
those whose length is not a multiple of 16 or not that of the first kept vector,
the one of the smallest vec_id.  Of fewer than 64 vectors the codebooks have as
many entries; rows without a vec_id come last, and rows that share one are
ordered by their vectors; each row has a row of its own in the result.
Components are held within 2**30 / sqrt(dimensions), so that squared distances
fit a long; sums over a label that do not fit are the largest long.  Labels may
be null, which is a label too.  An empty table gives an empty result.  Columns
other than vec_id, embedding and label are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, arrow_map, durable, hot_keys, split_join, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Split points of a node; entries that a leaf holds.
SPLIT, LEAF = 6, 6


def root_down(square: np.ndarray) -> np.ndarray:
    """The integer square root, rounded down; exact for any long."""
    r = np.sqrt(square.astype(np.float64)).astype(np.int64)
    r -= r * r > square
    return r + ((r + 1) * (r + 1) <= square)


def root_up(square: np.ndarray) -> np.ndarray:
    r = root_down(square)
    return r + (r * r < square)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to the one vector ``b``."""
    d = a - b
    return (d * d).sum(axis=1)


class Gnat:
    """A node: its split points (entries themselves), children, and low[i, j] to high[i, j], the distances from split point i to the entries of child j."""

    def __init__(self, entries: np.ndarray, index: np.ndarray | None = None):
        self.entries, self.index = entries, np.arange(len(entries)) if index is None else index
        self.splits = self.index[:0]
        if len(self.index) > max(LEAF, SPLIT):
            self.splits = self.spread()
        rest = np.setdiff1d(self.index, self.splits)
        self.children: list[Gnat | None] = []
        self.leaf = rest if not len(self.splits) else rest[:0]
        if len(self.splits):
            away = np.stack([squares(entries[rest], entries[s]) for s in self.splits])
            nearest = away.argmin(axis=0)
            k = len(self.splits)
            self.low, self.high = np.zeros((k, k), np.int64), np.full((k, k), -1, np.int64)
            for j in range(k):
                mine = nearest == j
                self.children.append(Gnat(entries, rest[mine]) if mine.any() else None)
                if mine.any():
                    self.low[:, j], self.high[:, j] = root_down(away[:, mine].min(axis=1)), root_up(away[:, mine].max(axis=1))

    def spread(self) -> np.ndarray:
        """Split points far from each other: each next one is the entry farthest from those taken."""
        taken = [int(self.index[0])]
        away = squares(self.entries[self.index], self.entries[taken[0]])
        while len(taken) < SPLIT:
            taken.append(int(self.index[away.argmax()]))
            away = np.minimum(away, squares(self.entries[self.index], self.entries[taken[-1]]))
        return np.unique(taken)

    def search(self, points: np.ndarray, rows: np.ndarray, best: np.ndarray, code: np.ndarray) -> int:
        """Better entries for ``rows`` of ``points``; returns the number of distances that were computed."""
        done = 0
        own = points[rows]
        away = []
        for e in self.leaf.tolist() + self.splits.tolist():
            square = squares(own, self.entries[e])
            done += len(rows)
            closer = (square < best[rows]) | ((square == best[rows]) & (e < code[rows]))
            best[rows[closer]], code[rows[closer]] = square[closer], e
            away.append(square)
        if not self.children:
            return done
        down, up = root_down(np.stack(away)), root_up(np.stack(away))
        for j in np.argsort([len(c.index) if c else 0 for c in self.children], kind="stable")[::-1]:
            if self.children[j] is None:
                continue
            radius = root_up(best[rows])
            out = (down > self.high[:, j, None] + radius) | (up + radius < self.low[:, j, None])
            alive = ~out.any(axis=0)
            if alive.any():
                done += self.children[j].search(points, rows[alive], best, code)
        return done


def nearest(tree: Gnat, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lowest of equally near ones, and the squared distance."""
    best, code = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(tree.entries), np.int64)
    # The first entry of all sets a radius whose root stays within a long.
    best[:], code[:] = squares(points, tree.entries[tree.index[0]]), tree.index[0]
    tree.search(points, np.arange(len(points)), best, code)
    return code, best


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and the components as integers (long, floors) of vectors without null or non-finite components."""
    own = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), "label")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    own = own.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % PARTS == 0)).where(good)
    held = F.floor(F.lit(2.0**30) / F.sqrt(F.size("v")))
    return own.select("vec_id", "label", F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, held), -held)).cast("long")).alias("v"))


def first_books(rows: DataFrame) -> np.ndarray | None:
    """(part, entry, component) of the vectors of the smallest ids; None where there is no vector."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(1).select(F.size("v").alias("n")).head()
    if first is None:
        return None
    least = rows.where(F.size("v") == first.n).orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").collect()
    return np.array([r.v for r in least], np.int64).reshape(len(least), PARTS, -1).swapaxes(0, 1)


def over_vectors(rows: DataFrame, books: np.ndarray, yields: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch | None], last: Callable[[], Iterator[pa.RecordBatch]] | None, schema: str) -> DataFrame:
    """Call ``yields`` with each batch, its vectors as (row, part, component), codes and squared distances by (row, part)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b) for b in books]
        for batch in batches:
            points = np.asarray(batch.column("v").flatten(), np.int64).reshape(batch.num_rows, PARTS, -1)
            code, square = np.empty((batch.num_rows, PARTS), np.int64), np.empty((batch.num_rows, PARTS), np.int64)
            for p in range(PARTS):
                code[:, p], square[:, p] = nearest(trees[p], np.ascontiguousarray(points[:, p]))
            if (out := yields(batch, points, code, square)) is not None:
                yield out
        if last:
            yield from last()

    return arrow_map(rows.where(F.size("v") == books.shape[0] * books.shape[2]), kernel, schema)


def updated(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floors of their parts' means; what each task sends is one table of sums."""
    k, width = books.shape[1], books.shape[2]
    total, count = np.zeros((PARTS * k, width), np.int64), np.zeros(PARTS * k, np.int64)

    def add(_: pa.RecordBatch, points: np.ndarray, code: np.ndarray, __: np.ndarray) -> None:
        at = (code + np.arange(PARTS) * k).ravel()
        count[:] += np.bincount(at, minlength=PARTS * k)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) > 0]))
        total[at[order][first]] += np.add.reduceat(points.reshape(len(at), width)[order], first, axis=0)

    def result() -> Iterator[pa.RecordBatch]:
        full = np.flatnonzero(count)
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(count[full], pa.int64()), pa.array(list(total[full]), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    part = over_vectors(rows, books, add, result, "entry int, n long, sums array<long>")
    found = part.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).collect()
    out = books.copy().reshape(PARTS * k, width)
    for r in found:
        out[r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return out.reshape(books.shape)


def fitted(rows: DataFrame) -> np.ndarray | None:
    """The codebooks after all rounds."""
    books = first_books(rows)
    for _ in range(ROUNDS if books is not None else 0):
        books = updated(rows, books)
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of each usable vector."""

    def give(batch: pa.RecordBatch, _: np.ndarray, code: np.ndarray, square: np.ndarray) -> pa.RecordBatch:
        text = [bytes(c).hex() for c in code.astype(np.uint8)]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(square.sum(axis=1), pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return over_vectors(rows, books, give, None, f"vec_id long, label {kind}, code string, error long")


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each usable vector."""
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    rows = durable(usable(vectors))
    books = fitted(rows)
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    out = durable(encoded(rows, books).withColumn("none", F.col("label").isNull()))
    zero = F.lit(0).cast(out.schema["label"].dataType)
    out = out.withColumn("label", F.coalesce("label", zero))
    largest = F.lit(np.iinfo(np.int64).max)
    by = out.groupBy("label", "none").agg(F.least(F.sum(F.col("error").cast("decimal(20,0)")), largest.cast("decimal(20,0)")).cast("long").alias("label_error"))
    if by.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        joined = out.join(F.broadcast(by), ["label", "none"])
    else:
        joined = split_join(out, by, ["label", "none"], "vec_id", hot_keys(out, ["label", "none"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes(table(spark, sf_dir, "embeddings"))


def _assign(k: int) -> str:
    """SQL that gives each part the nearest entry of codebook ``k``."""
    return f"""
a{k} AS (
  SELECT r, v.p AS p, min(list_sum(list_transform(list_zip(v.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + b.e) AS best
  FROM v JOIN b{k} b ON v.p = b.p GROUP BY r, v.p)"""


def _update(k: int) -> str:
    """SQL of the codebook after ``k`` rounds."""
    return f"""
m{k} AS (
  SELECT p, e, list(CAST(((s - ((s % n) + n) % n) // n) AS BIGINT) ORDER BY i) AS x
  FROM (SELECT v.p AS p, best % 64 AS e, i, CAST(sum(v.x[i]) AS BIGINT) AS s, count(*) AS n
        FROM a{k - 1} a JOIN v ON a.r = v.r AND a.p = v.p, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM v))) AS i) GROUP BY ALL) GROUP BY p, e),
b{k} AS (SELECT b.p AS p, b.e AS e, coalesce(m.x, b.x) AS x FROM b{k - 1} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)"""


ORACLE = f"""
WITH g AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT r, p, list_slice(x, p * (len(x) // 16) + 1, (p + 1) * (len(x) // 16)) AS x FROM (SELECT r, x, unnest(range(16)) AS p FROM g)),
b0 AS (SELECT p, r - 1 AS e, x FROM v WHERE r <= 64),
{_assign(0)},{_update(1)},{_assign(1)},{_update(2)},{_assign(2)},
h AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM (SELECT p, e, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM b2)),
c AS (SELECT r, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM g JOIN c USING (r), h
"""
