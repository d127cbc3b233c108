"""Near-duplicate documents by HyperMinHash.

A document's shingle hashes fall into 128 buckets; a bucket keeps only the
leading-zero count and ten mantissa bits of its least hash (16 bits).  Four
registers make a band key.  Documents with equal sets form one class first, so
only different sets meet.  Partners in a band's bucket are screened by the
collision-corrected Jaccard estimate, and what passes is verified on full sets.

A bucket is joined as a star around its least document; only where it then
still holds several components do its members go through an exact prefix
filter.  No group is ever paired with itself in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, arrow_map, durable, hashed, hot_keys, longs, mix, split_join, strips, summed, table, texts, utf8, with_ids, with_rows
from .graph import components
from .setjoin import WORDS, candidates, parities, prefix

REGISTERS, BAND = 128, 4
MANTISSA, EMPTY = 10, 0xFFFF
#: Two different minima share a register if they have as many leading zeros (1 in 3) and the same mantissa.
COLLISION = 2.0**-MANTISSA / 3
#: The screen lets pass what lies within so many standard deviations below the threshold.
SLACK = 6.0
#: Cells of the table of shingle counts that orders shingles by rarity (4 bytes each).
CELLS = 1 << 21
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
TOP = np.uint64(57)


def shingles(text: bytes, width: int, known: WordHash) -> np.ndarray:
    """The document's set: sorted distinct hashes of its shingles."""
    w = hashed(text.lower().split(), known)
    if not len(w):
        return w
    k = min(width, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        h += w[j : len(w) - k + 1 + j] * (ODD[j % 5] + np.uint64(2 * (j // 5)))
    if k < width:
        h += np.uint64(k * int(ODD[4]) & 0xFFFFFFFFFFFFFFFF)
    h = mix(h)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def registers(h: np.ndarray) -> np.ndarray:
    """uint16 registers of a sorted set: leading zeros << 10 | mantissa of each bucket's least hash."""
    edge = np.searchsorted(h, np.arange(REGISTERS, dtype=np.uint64) << TOP)
    full = edge < np.append(edge[1:], len(h))
    v = (h[edge[full]] & np.uint64((1 << 57) - 1)) >> np.uint64(5)  # 52 bits: exact as doubles
    size = np.frexp(v.astype(np.float64))[1]
    mantissa = np.where(size > MANTISSA, v >> np.maximum(size - MANTISSA - 1, 0).astype(np.uint64), v << np.maximum(MANTISSA + 1 - size, 0).astype(np.uint64)) & np.uint64((1 << MANTISSA) - 1)
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[full] = ((52 - size).astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return out


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            n, a, b, regs = [], [], [], []
            for text in utf8(batch, "text"):
                h = shingles(text, width, known)
                n.append(len(h))
                a.append(int(mix(h).sum(dtype=np.uint64).astype(np.int64)))
                b.append(int(mix(h ^ ODD[1]).sum(dtype=np.uint64).astype(np.int64)))
                regs.append(registers(h).tobytes() if len(h) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "n", "set_a", "set_b", "regs"])

    return arrow_map(texts(docs), kernel, "doc_id long, n long, set_a long, set_b long, regs binary")


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, doc_id) for each band that is not empty."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64))
        for batch in batches:
            packed = np.frombuffer(b"".join(batch.column("regs").to_pylist()), np.uint64).reshape(-1, REGISTERS // BAND)
            row, band = np.nonzero(packed != np.uint64(0xFFFFFFFFFFFFFFFF))
            yield pa.RecordBatch.from_arrays([pa.array(mix(packed[row, band] + salt[band]).view(np.int64)), pa.array(longs(batch, "doc_id")[row])], names=["key", "doc_id"])

    return arrow_map(reps.select("doc_id", "regs"), kernel, "key long, doc_id long")


def estimate(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimate and the buckets it rests on; rows of registers."""
    used = ((x != EMPTY) | (y != EMPTY)).sum(axis=1)
    same = ((x == y) & (x != EMPTY)).sum(axis=1)
    return (same / np.maximum(used, 1) - COLLISION) / (1 - COLLISION), used


def near(est: np.ndarray, used: np.ndarray, percent: int) -> np.ndarray:
    p = percent / 100
    return est >= p - SLACK * np.sqrt(p * (1 - p) / np.maximum(used, 1))


def fits(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def both_sides(pairs: DataFrame, side: DataFrame, hot: dict[str, DataFrame | None], *columns: str) -> DataFrame:
    """Pairs (a, b) with columns of both documents; a document of ``hot``, with very many partners, does not meet them in one task."""
    found = pairs
    for own, other in (("b", "a"), ("a", "b")):
        of = side.select(F.col("doc_id").alias(own), *(F.col(c).alias(f"{c}_{own}") for c in columns))
        found = split_join(found, of, [own], other, hot.get(own))
    return found


def screen(pairs: DataFrame, sig: DataFrame, percent: int, hot: dict[str, DataFrame | None]) -> DataFrame:
    """Pairs (a, b) whose sizes and registers allow the threshold, with the estimate."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("regs_a", "regs_b"))
            est, used = estimate(x, y)
            ok = near(est, used, percent) & fits(longs(batch, "n_a"), longs(batch, "n_b"), percent)
            yield pa.RecordBatch.from_arrays([pa.array(longs(batch, "a")[ok]), pa.array(longs(batch, "b")[ok]), pa.array(est[ok])], names=["a", "b", "est"])

    return arrow_map(both_sides(pairs, sig, hot, "n", "regs"), kernel, "a long, b long, est double")


def verify(pairs: DataFrame, docs: DataFrame, width: int, percent: int, hot: dict[str, DataFrame | None]) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    pairs = durable(pairs.select("a", "b"))
    held = with_ids(texts(docs), pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()).dropDuplicates(["doc_id"])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, x = WordHash(), None, np.empty(0, np.uint64)
        for batch in batches:
            ok = []
            for a, s, t in zip(batch.column("a").to_pylist(), utf8(batch, "text_a"), utf8(batch, "text_b"), strict=True):
                if a != last:
                    last, x = a, shingles(s, width, known)
                y = shingles(t, width, known)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = np.array(ok, bool)
            yield pa.RecordBatch.from_arrays([pa.array(longs(batch, "a")[ok]), pa.array(longs(batch, "b")[ok])], names=["a", "b"])

    return arrow_map(both_sides(pairs, held, hot, "text").select("a", "b", "text_a", "text_b"), kernel, "a long, b long")


def across(members: DataFrame, labels: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs from different components, among documents whose bucket still holds several, that may reach the threshold.

    members: (key, doc_id).  Where copies of copies differ much, a bucket holds
    many documents that nearly link, so registers can't tell them apart.  An
    exact prefix filter over these documents' shingles can: the rarest
    shingles of two linked documents meet, and a document's own edits meet
    nobody's.
    """
    at = members.join(labels, members.doc_id == labels.node, "left").select("key", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    split = at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    left = durable(at.join(split, "key", "left_semi").select("doc_id", "label").distinct())
    chosen = with_rows(texts(docs), left).dropDuplicates(["doc_id"]).select("doc_id", "text", "label")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, known = np.zeros(CELLS, np.int64), WordHash()
        for batch in batches:
            for text in utf8(batch, "text"):
                cells[(shingles(text, width, known) % np.uint64(CELLS)).astype(np.int64)] += 1
        yield strips(cells)

    counts = docs.sparkSession.sparkContext.broadcast(np.minimum(summed(arrow_map(chosen, count, "strip int, cells binary"), CELLS), 2**31 - 1).astype(np.int32))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash()
        for batch in batches:
            sets = [shingles(t, width, known) for t in utf8(batch, "text")]
            n = np.array([len(x) for x in sets], np.int64)
            tokens = np.concatenate([np.empty(0, np.uint64), *sets])
            bits = parities(tokens, n)
            token, own, size_at = prefix(tokens, n, counts.value, percent)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(longs(batch, "doc_id")[own]), pa.array(longs(batch, "label")[own]), pa.array(size_at), *(pa.array(bits[own, i]) for i in range(WORDS))], names=["token", "id", "label", "size_at", *(f"p{i}" for i in range(WORDS))])

    return candidates(arrow_map(chosen, entries, "token long, id long, label long, size_at long, " + ", ".join(f"p{i} long" for i in range(WORDS))), percent)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Documents are linked where 100 * |A & B| >= percent * |A | B| over their
    sets of ``width``-word shingles; the component is named by its least
    doc_id.  A text without words (or null) has an empty set, no links and is
    kept; a text of fewer words is one shingle.  Rows that repeat a doc_id
    are one document and get a row each; where their texts differ, the document
    has the links of all of them.  A null doc_id stands alone.
    """
    sig = durable(signatures(docs, width))
    several = sig.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("set_a").alias("lo"), F.max("set_a").alias("hi"))
    if several.where("lo <> hi").isEmpty():
        return linked(docs, sig, width, percent)
    return by_rows(docs, width, percent)


def by_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` where a doc_id has several texts: rows are linked, and then rows of one doc_id are one node."""
    row = F.monotonically_increasing_id()
    rows = durable(texts(docs).select("doc_id", "text", row.alias("row")))
    own = rows.select(F.when(F.col("doc_id").isNotNull(), F.col("row")).alias("doc_id"), "text")
    found = linked(own, durable(signatures(own, width)), width, percent)
    of = rows.where("doc_id is not null").select("row", F.col("doc_id").alias("id"))
    made = durable(found.where("doc_id is not null").join(of, F.col("doc_id") == F.col("row")).select("id", "row", "n_shingles", "component_id"))
    first = made.where("n_shingles > 0").groupBy("id").agg(F.min("row").alias("a"))
    same = made.where("n_shingles > 0").join(first, "id").select("a", F.col("row").alias("b"))
    labels = components(made.select(F.col("component_id").alias("a"), F.col("row").alias("b")).unionAll(same))
    named = made.join(labels, F.col("row") == F.col("node"), "left").withColumn("label", F.coalesce("label", "row"))
    least = named.groupBy("label").agg(F.min("id").alias("least"))
    out = named.join(least, "label").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))
    return out.unionAll(found.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long"), "kept"))


def linked(docs: DataFrame, sig: DataFrame, width: int, percent: int) -> DataFrame:
    """``near_duplicates`` from the signatures (written), where a doc_id has one set."""
    full = sig.where("n > 0 and doc_id is not null")
    same = ["set_a", "set_b", "n"]
    classes = durable(full.groupBy(*same).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = durable(full.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "regs"))
    keys = band_keys(reps)
    shared = keys.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("c")).where("c > 1").select("key", "pivot")
    members = durable(keys.join(shared, "key"))
    star = durable(members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct())
    hot = {"a": hot_keys(star, ["a"])}  # as b a document stands once for each of its bands at most
    first = screen(star, reps, percent, hot).groupBy("b").agg(F.max_by("a", F.struct("est", -F.col("a"))).alias("a"))
    edges = durable(verify(first, docs, width, percent, hot))
    labels = components(edges)
    pairs = durable(across(members.select("key", "doc_id"), labels, docs, width, percent))
    if pairs.limit(1).count():
        hot = {side: hot_keys(pairs, [side]) for side in ("a", "b")}
        more = durable(verify(screen(pairs, reps, percent, hot), docs, width, percent, hot))
        if more.limit(1).count():
            labels = components(edges.unionAll(more))
    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select(*same, F.coalesce("label", "rep").alias("component_id"))
    joined = split_join(full, named, same, "doc_id", hot_keys(classes, same, F.col("copies")))
    alone = sig.where("n = 0 or doc_id is null").withColumn("component_id", F.col("doc_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return joined.unionByName(alone.select(joined.columns)).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the least doc_id."""
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reach FROM w UNION SELECT r.node, e2.b FROM r JOIN e2 ON e2.a = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN c ON c.node = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""
