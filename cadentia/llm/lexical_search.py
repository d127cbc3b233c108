"""Ranked lexical search by geometric blocks of posting lists.

The documents of a partition are indexed a shard at a time.  A term's posting
list is clustered by the likeness of its documents, and each block keeps the
coordinatewise maximum of what its documents gain by each term: a query's sum
over that summary is at least the score of every document of the block.  A block
is skipped only where that sum is below the tenth best score that is known
already; equal sums are looked into.  Lists whose largest gains together stay
below it need no blocks at all.  Everything else is scored in whole, in 64-bit
integers, so the result is that of scoring everything.

A document is a row: rows that share an id are ranked each for itself, a null id
ranks after all others of its score, and null or wordless texts are no documents.
An item is a row of the benchmark, also where ids repeat or are null; null and
wordless items find nothing.  Without documents, or items, the result is empty.
No other columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, durable, longs, mix, ranges, table, texts, utf8

TOP = 10
WORD, BREAK = re.compile(rb"[0-9A-Za-z\x80-\xff]+"), re.compile(rb"[^0-9A-Za-z\x80-\xff]")
#: Bytes whose words are listed at once; a longer text is counted piece by piece.
PIECE = 1 << 20
#: Documents and postings of a shard, documents of a block (about), numbers of a document's sketch.
SHARD_ROWS, SHARD_POSTINGS, BLOCK, SKETCH = 4096, 500_000, 32, 16
#: Summary entries that are made at once.
EXPANDED = 2_000_000
#: Terms of the items that are searched at once, about; more items take more rounds.
ROUND_TERMS = 200_000
#: Documents that are scored first, about, for thresholds to begin with; a bounded sample, on which no result depends.
SEED_ROWS = 20_000
NO_ID = np.iinfo(np.int64).max
FOUND = "item int, doc_id long, score long"


def term_counts(text: bytes) -> Counter:
    """How often each term occurs; only A-Z are lower-cased."""
    out, at = Counter(), 0
    while at < len(text):
        cut = BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        out.update(WORD.findall(text[at:end].lower()))
        at = end
    return out


def item_terms(benchmark: DataFrame) -> DataFrame:
    """item_row, item_id and the different terms of each item that has one."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(term_counts(t)) for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_row"), batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_row", "item_id", "terms"])

    own = benchmark.select(F.monotonically_increasing_id().alias("item_row"), F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(own, kernel, "item_row long, item_id long, terms array<binary>").where("size(terms) > 0")


def vectors(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """Per document with a term: doc_id, n (its terms with repeats) and, for the terms in ``known``, numbers and occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            n, ptr, terms, tf = [], [0], [], []
            for text in utf8(batch, "text"):
                counts = term_counts(text)
                n.append(counts.total())
                mine = sorted((of[t], c) for t, c in counts.items() if t in of)
                terms += [t for t, _ in mine]
                tf += [c for _, c in mine]
                ptr.append(len(terms))
            at = pa.array(ptr, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return arrow_map(texts(docs), kernel, "doc_id long, n long, terms array<int>, tf array<long>").where("n > 0")


def lengths(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The length norm m of each document."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * n_docs // total for x in n], np.int64)
    return 10 + 90 * n * n_docs // total


class Items:
    """The items of a round: the terms of item i are terms[ptr[i]:ptr[i + 1]]; weight of each term, and what the norms need."""

    def __init__(self, lists: list[np.ndarray], weight: np.ndarray, n_docs: int, total: int):
        self.ptr = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
        self.terms = np.concatenate(lists) if lists else np.empty(0, np.int64)
        self.weight, self.n_docs, self.total = weight, n_docs, total

    @classmethod
    def of(cls, state: dict) -> Items:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def shards(self, batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        """The documents of a partition, cut by rows and by postings."""
        for batch in batches:
            ids = longs_or(batch.column("doc_id"), NO_ID)
            lists, tfs = batch.column("terms"), batch.column("tf")
            ptr = np.asarray(lists.offsets, np.int64)
            ptr = ptr - ptr[0]
            term, tf = np.asarray(lists.flatten(), np.int64), np.asarray(tfs.flatten(), np.int64)
            m = np.repeat(lengths(longs(batch, "n"), self.n_docs, self.total), np.diff(ptr))
            gain = self.weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            at = 0
            while at < len(ids):
                end = min(at + SHARD_ROWS, max(at + 1, int(np.searchsorted(ptr, ptr[at] + SHARD_POSTINGS, "right")) - 1), len(ids))
                yield Shard(ids[at:end], ptr[at : end + 1] - ptr[at], term[ptr[at] : ptr[end]], gain[ptr[at] : ptr[end]])
                at = end


def longs_or(column: pa.Array, empty: int) -> np.ndarray:
    return column.fill_null(empty).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def sums(values: np.ndarray, lengths_of: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs, empty ones included."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths_of)
    return total[ends] - total[ends - lengths_of]


def maxima(key: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys (below ``size``), ascending, and the largest value of each; of keys whose values are all 0 none need come."""
    if size <= 4 * len(key):
        out = np.zeros(size, np.int64)
        np.maximum.at(out, key, value)
        key = np.flatnonzero(out)
        return key, out[key]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], np.maximum.reduceat(value[order], first)


class Shard:
    """Documents as rows of gains by term, and the posting lists of their terms."""

    def __init__(self, ids: np.ndarray, ptr: np.ndarray, term: np.ndarray, gain: np.ndarray):
        self.ids, self.ptr, self.gain = ids, ptr, gain
        self.names, self.term = np.unique(term, return_inverse=True)
        order = np.argsort(self.term, kind="stable")
        self.postings = np.repeat(np.arange(len(ids)), np.diff(ptr))[order]
        self.list_ptr = np.searchsorted(self.term[order], np.arange(len(self.names) + 1))
        self.best = np.maximum.reduceat(gain[order], self.list_ptr[:-1]) if len(term) else np.empty(0, np.int64)
        self.sketches: np.ndarray | None = None
        self.n_blocks = self.n_opened = 0

    def local(self, terms: np.ndarray) -> np.ndarray:
        """Numbers here of those of an item's terms that occur."""
        at = np.searchsorted(self.names, terms)
        at[at == len(self.names)] = 0
        return at[self.names[at] == terms] if len(self.names) else at[:0]

    def scores(self, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        n = self.ptr[rows + 1] - self.ptr[rows]
        at = ranges(self.ptr[rows], n)
        return sums(np.where(wanted[self.term[at]], self.gain[at], 0), n)

    def sketch(self) -> np.ndarray:
        """Unit vectors whose products tell likeness: gains projected on hashed signs."""
        if self.sketches is None:
            signs = (mix(self.names[:, None] * SKETCH + np.arange(SKETCH)) & np.uint64(1)).astype(np.float32) * 2 - 1
            out = np.zeros((len(self.ids), SKETCH), np.float32)
            full = np.flatnonzero(np.diff(self.ptr))
            for j in range(SKETCH):
                out[full, j] = np.add.reduceat(self.gain.astype(np.float32) * signs[self.term, j], self.ptr[full])
            self.sketches = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return self.sketches

    def blocks(self, lists: np.ndarray) -> Blocks:
        """Cluster each list about members that stand evenly in it, and keep each block's coordinatewise maxima."""
        owner, block, rows, n_blocks = [], [], [], 0
        for t in lists:
            of = self.postings[self.list_ptr[t] : self.list_ptr[t + 1]]
            k = -(-len(of) // BLOCK)
            mine = np.zeros(len(of), np.int64)
            if k > 1:
                s = self.sketch()
                centres = s[of[np.arange(k) * len(of) // k]]
                _, mine = np.unique((s[of] @ centres.T).argmax(axis=1), return_inverse=True)
            block.append(mine + n_blocks)
            rows.append(of)
            k = int(mine.max()) + 1
            owner.append(np.full(k, t))
            n_blocks += k
        owner, block, rows = np.concatenate(owner), np.concatenate(block), np.concatenate(rows)
        order = np.argsort(block, kind="stable")
        block, rows = block[order], rows[order]
        n = self.ptr[rows + 1] - self.ptr[rows]
        at = ranges(self.ptr[rows], n)
        key, most = maxima(np.repeat(block, n) * len(self.names) + self.term[at], self.gain[at], n_blocks * len(self.names))
        return Blocks(owner, rows, np.searchsorted(block, np.arange(n_blocks + 1)), key % len(self.names), most, np.searchsorted(key // len(self.names), np.arange(n_blocks + 1)))

    def weigh(self, lists: np.ndarray) -> np.ndarray:
        """Entries that the summaries of each list are made of."""
        size = np.diff(self.ptr)
        return np.array([int(size[self.postings[self.list_ptr[t] : self.list_ptr[t + 1]]].sum()) for t in lists], np.int64)


class Blocks:
    """Blocks of several lists: whose each is, its documents, and its summary (terms and maxima)."""

    def __init__(self, owner: np.ndarray, rows: np.ndarray, row_ptr: np.ndarray, term: np.ndarray, most: np.ndarray, ptr: np.ndarray):
        self.owner, self.rows, self.row_ptr, self.term, self.most, self.ptr = owner, rows, row_ptr, term, most, ptr

    def bounds(self, blocks: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """No document of the block scores more."""
        n = self.ptr[blocks + 1] - self.ptr[blocks]
        at = ranges(self.ptr[blocks], n)
        return sums(np.where(wanted[self.term[at]], self.most[at], 0), n)

    def members(self, blocks: np.ndarray) -> np.ndarray:
        return np.unique(self.rows[ranges(self.row_ptr[blocks], self.row_ptr[blocks + 1] - self.row_ptr[blocks])])


class Best:
    """The TOP best documents of each item so far: score, then smaller id; and the score below which none enters."""

    def __init__(self, least: np.ndarray):
        self.least = least.copy()
        self.found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in least]

    def offer(self, item: int, ids: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least[item]
        score, ids = np.concatenate([self.found[item][0], score[good]]), np.concatenate([self.found[item][1], ids[good]])
        order = np.lexsort((ids, -score))[:TOP]
        self.found[item] = score[order], ids[order]
        if len(order) == TOP:
            self.least[item] = max(self.least[item], score[order[-1]])

    def batch(self) -> pa.RecordBatch:
        n = [len(s) for s, _ in self.found]
        ids = np.concatenate([i for _, i in self.found]) if n else np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(n)), n), pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([s for s, _ in self.found]) if n else ids, pa.int64())], names=["item", "doc_id", "score"])


def score_all(shard: Shard, items: Items, best: Best) -> None:
    """Every document of the shard, for thresholds."""
    for i in range(len(items)):
        mine = shard.local(items.terms[items.ptr[i] : items.ptr[i + 1]])
        if len(mine):
            wanted = np.zeros(len(shard.names), bool)
            wanted[mine] = True
            best.offer(i, shard.ids, sums(np.where(wanted[shard.term], shard.gain, 0), np.diff(shard.ptr)))


def search_shard(shard: Shard, items: Items, best: Best) -> None:
    """Bring the documents of the shard that may be among an item's best before it."""
    terms, below, asks = [], [], {}
    for i in range(len(items)):
        mine = shard.local(items.terms[items.ptr[i] : items.ptr[i + 1]])
        mine = mine[np.argsort(shard.best[mine], kind="stable")]
        most = np.cumsum(shard.best[mine])
        terms.append(mine)
        below.append(most)
        for t in mine[most >= best.least[i]]:  # documents in the lists before these alone stay below
            asks.setdefault(int(t), []).append(i)
    if not asks:
        return
    lists = np.fromiter(asks, np.int64, len(asks))
    lists = lists[np.lexsort((lists, -shard.best[lists]))]
    part = np.cumsum(shard.weigh(lists)) // EXPANDED
    seen: dict[int, np.ndarray] = {}
    wanted = np.zeros(len(shard.names), bool)
    for p in np.unique(part):
        blocks = shard.blocks(lists[part == p])
        at = {}
        for b, t in enumerate(blocks.owner.tolist()):
            at.setdefault(t, []).append(b)
        shard.n_blocks += len(blocks.owner)
        for i in sorted({i for t in at for i in asks[t]}):
            mine = [b for t in terms[i][below[i] >= best.least[i]].tolist() if t in at for b in at[t]]
            if not mine:
                continue
            wanted[terms[i]] = True
            mine = np.array(mine)
            mine = mine[blocks.bounds(mine, wanted) >= best.least[i]]
            shard.n_opened += len(mine)
            rows = blocks.members(mine)
            done = seen.setdefault(i, np.zeros(len(shard.ids), bool))
            rows = rows[~done[rows]]
            done[rows] = True
            if len(rows):
                best.offer(i, shard.ids[rows], shard.scores(rows, wanted))
            wanted[terms[i]] = False


def ranked(found: DataFrame) -> DataFrame:
    """The TOP rows of each item with their rank; in two steps, so that no task ranks the finds of all tasks."""

    def top(df: DataFrame, *key: str) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).where(F.col("rank") <= TOP)

    return top(top(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64))), "item", "part"), "item").drop("part")


def pass_over(rows: DataFrame, items: Items, least: np.ndarray, seed: bool) -> DataFrame:
    """The best of each item; a seed scores everything, else blocks are searched."""
    shared = rows.sparkSession.sparkContext.broadcast((dict(items.__dict__), least))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, start = shared.value
        own, best = Items.of(state), Best(start)
        for shard in own.shards(batches):
            (score_all if seed else search_shard)(shard, own, best)
        yield best.batch()

    return ranked(arrow_map(rows, kernel, FOUND))


def search_round(docs: DataFrame, asked: list[list[bytes]]) -> DataFrame:
    """item (number in ``asked``), rank, doc_id and score; ``asked`` has the terms of each item."""
    spark = docs.sparkSession
    known = {t: i for i, t in enumerate(sorted({t for terms in asked for t in terms}))}
    rows = durable(vectors(docs, known))
    n_docs, total = rows.agg(F.count("*"), F.sum("n")).head()
    df = np.zeros(len(known), np.int64)
    counted = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).toArrow()
    df[counted.column("t").to_numpy()] = counted.column("n").to_numpy()
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    items = Items([np.array([known[t] for t in terms], np.int64) for terms in asked], weight, n_docs, total or 1)
    least = np.ones(len(items), np.int64)
    if n_docs:
        sample = rows.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(max(4, n_docs // SEED_ROWS))) == 0)
        for r in pass_over(sample, items, least, True).where(F.col("rank") == TOP).collect():
            least[r["item"]] = max(1, r["score"])
    return pass_over(rows, items, least, False) if n_docs else spark.createDataFrame([], FOUND + ", rank int")


def search(docs: DataFrame, benchmark: DataFrame, round_terms: int = ROUND_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the TOP best documents of each item.

    Items are dealt by hash to rounds of about ``round_terms`` terms; what
    the driver holds of a round is its terms, their counts and a number per item.
    """
    items = durable(item_terms(benchmark))
    n_rounds = math.ceil((items.agg(F.sum(F.size("terms"))).head()[0] or 0) / round_terms)
    out = None
    for k in range(n_rounds):
        mine = items.where(F.pmod(F.xxhash64("item_row"), F.lit(n_rounds)) == k).orderBy("item_row").collect()
        if not mine:
            continue
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], "item int, item_id long")
        found = search_round(docs, [r["terms"] for r in mine]).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = durable(found) if n_rounds > 1 else found
        out = found if out is None else out.unionAll(found)
    return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM dw WHERE len(w) > 0),
s AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (
  SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
c AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // total))) AS gain FROM p JOIN w USING (term), s),
r AS (SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM q JOIN c USING (term) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r QUALIFY rank <= 10
"""
