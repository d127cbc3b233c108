"""Removal of repeated 100-byte strings by longest-previous-factor arrays.

A suffix array of a whole corpus does not fit one task, so anchors deal the
text out first.  Each window of ``length`` bytes owns one anchor: the least
hash among the CORE-byte strings inside it.  Equal windows own equal anchors,
so every match lies within the group of one anchor hash.  A group keeps one
occurrence of each distinct context (the earliest; the others are repeats of
it), and where several contexts differ, their bytes are fetched and one suffix
order over them gives, by previous and next smaller positions, the longest
previous factor of each window: it is a repeat if that reaches ``length``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, durable, longs, mix, ranges, table, texts, utf8
from .tokens import BASE, BYTE, INVERSE, powers

LENGTH = 100
#: Bytes of an anchor.  Longer anchors repeat less by chance; there is one for every (LENGTH - CORE) / 2 bytes.
CORE = 40
#: Text bytes hashed at once, and those whose anchors a task gathers before it drops the repeats within them.
PIECE, GATHER = 2 << 20, 32 << 20
#: Snippet bytes in one suffix order (about a hundred bytes of memory each), or those of one group.
ORDERED = 1 << 20
#: Different contexts of one anchor that one suffix array may hold; larger groups are dealt out window by window.
GROUP = 20_000


class Rolling:
    """Hashes of any substrings of a buffer, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.back = powers(INVERSE, len(data) + 1)

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` values in a row, by their high 32 bits, the last of equals."""
    n = np.uint64(len(x))
    best = (x >> np.uint64(32) << np.uint64(32)) | (n - np.arange(len(x), dtype=np.uint64))
    done = 1
    while done < width:
        step = min(done, width - done)
        best = np.minimum(best[:-step], best[step:])
        done += step
    return (n - (best & np.uint64(0xFFFFFFFF))).astype(np.int64)


def anchors(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, length: int, core: int) -> tuple[np.ndarray, ...]:
    """For each run of windows that own one anchor: row, anchor hash, context hash, first and last window (within the row).

    data: the rows' bytes one after another, row i at first[i], each of ``length`` bytes at least.
    """
    roll = Rolling(data)
    starts = np.arange(len(data) - core + 1)
    rank = roll.of(starts, starts + core)
    at = sliding_min(rank, length - core + 1)  # depends on the window's bytes alone
    windows = ranges(first, sizes - length + 1)
    own = at[windows]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (windows[1:] != windows[:-1] + 1)])
    lo, a = windows[new], own[new]
    hi = windows[np.concatenate([np.nonzero(new)[0][1:], [len(windows)]]) - 1]
    row = np.searchsorted(first, lo, "right") - 1
    context = mix(roll.of(lo, hi + length) ^ mix((a - lo).astype(np.uint64) << np.uint64(32) | (hi - lo).astype(np.uint64)))
    return row, rank[a], context, lo - first[row], hi - first[row]


#: at holds lo << 32 | size: windows lo to lo + size, or, with a null context, bytes lo to lo + size to be removed.
RUNS = "h long, context long, doc_id long, at long"
RUN_NAMES = ["h", "context", "doc_id", "at"]


def run_batch(h: np.ndarray, context: np.ndarray | None, doc: np.ndarray, lo: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    context = pa.nulls(len(doc), pa.int64()) if context is None else pa.array(context)
    return pa.RecordBatch.from_arrays([pa.array(h), context, pa.array(doc), pa.array(lo.astype(np.int64) << 32 | size.astype(np.int64))], names=RUN_NAMES)


def removals(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Intervals joined where they overlap, as rows of RUNS."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    if len(doc):
        span = int(hi.max()) + 2
        row = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
        reach = np.maximum.accumulate(row * span + hi)
        new = np.concatenate([[True], (row * span + lo)[1:] > reach[:-1]])
        last = np.concatenate([np.nonzero(new)[0][1:], [len(doc)]]) - 1
        doc, lo, hi = doc[new], lo[new], reach[last] - row[last] * span
    return run_batch(mix(doc.view(np.uint64)).view(np.int64), None, doc, lo, hi - lo)


def distinct_runs(parts: list[list[np.ndarray]], length: int) -> Iterator[pa.RecordBatch]:
    """The earliest run of each context within a task; the others are repeats of it."""
    h, context, doc, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((lo, doc, context, h))
    h, context, doc, lo, hi = (x[order] for x in (h, context, doc, lo, hi))
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (context[1:] != context[:-1])])
    rep = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    again = ~new & ((doc != doc[rep]) | (lo != lo[rep]))
    kept = [x[new] for x in (h, context, doc, lo, hi - lo)]
    for i in range(0, len(kept[0]), 100_000):
        yield run_batch(*(x[i : i + 100_000] for x in kept))
    yield removals(doc[again], lo[again], hi[again] + length)


def local_runs(docs: DataFrame, length: int, core: int) -> DataFrame:
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        gathered = 0
        pieces: list[tuple[int, int, bytes]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if pieces:
                sizes = np.array([len(p[2]) for p in pieces], np.int64)
                row, h, context, lo, hi = anchors(np.frombuffer(b"".join(p[2] for p in pieces), np.uint8), np.cumsum(sizes) - sizes, sizes, length, core)
                doc, base = np.array([p[0] for p in pieces], np.int64)[row], np.array([p[1] for p in pieces], np.int64)[row]
                parts.append([h.view(np.int64), context.view(np.int64), doc, (lo + base).astype(np.int32), (hi + base).astype(np.int32)])
                pieces.clear()
                size = 0

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), strict=True):
                if doc is None or len(text) < length:
                    continue
                for at in range(0, len(text) - length + 1, PIECE):
                    pieces.append((doc, at, text[at : at + PIECE + length - 1]))
                    size += len(pieces[-1][2])
                    gathered += len(pieces[-1][2])
                    if size >= PIECE:
                        flush()
            if gathered >= GATHER:
                flush()
                yield from distinct_runs(parts, length)
                parts, gathered = [], 0
        flush()
        if parts:
            yield from distinct_runs(parts, length)

    return arrow_map(texts(docs), kernel, RUNS)


def shared_runs(runs: DataFrame, length: int) -> DataFrame:
    """Of all tasks' runs: repeats of an earlier equal context as removals, and one run of each context whose anchor has several.

    The rows come sorted, so a task keeps one row between batches, however
    large the group of an anchor is.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the first run of the last context
        sent = several = False  # whether it was given out; whether its anchor has had another context
        for batch in batches:
            done = batch.column("context").is_null()
            if done.true_count:
                yield batch.filter(done)
                batch = batch.filter(batch.column("context").is_valid())
            if not batch.num_rows:
                continue
            cols = [batch.column(n).to_numpy() for n in RUN_NAMES]
            if held is not None:
                cols = [np.concatenate([k, c]) for k, c in zip(held, cols, strict=True)]
            h, context, doc, at = cols
            n = len(h)
            new_h = np.concatenate([[True], h[1:] != h[:-1]])
            new = new_h | np.concatenate([[True], context[1:] != context[:-1]])
            rep = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            again = ~new & ((doc != doc[rep]) | (at != at[rep]))
            if again.any():
                lo = at[again] >> 32
                yield removals(doc[again], lo, lo + (at[again] & 0xFFFFFFFF) + length)
            group = np.cumsum(new_h) - 1
            many = np.bincount(group, weights=new) >= 2
            if held is not None and several:
                many[0] = True
            give = new & many[group]
            if held is not None and sent:
                give[0] = False
            if give.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[give]) for c in cols], names=RUN_NAMES)
            k = int(rep[-1])
            several = bool(many[-1])
            sent = several
            held = [c[k : k + 1] for c in cols]

    return arrow_map(runs.repartition("h").sortWithinPartitions("h", "context", "doc_id", "at"), kernel, RUNS)


def ranked(x: np.ndarray) -> np.ndarray:
    """Order-preserving dense ranks."""
    order = np.argsort(x, kind="stable")
    up = np.concatenate([[0], np.cumsum(x[order[1:]] != x[order[:-1]])])
    out = np.empty(len(x), np.int64)
    out[order] = up
    return out


def suffix_levels(data: np.ndarray, reach: int) -> list[tuple[int, np.ndarray]]:
    """(width, ranks of the ``width`` bytes at each position), by prefix doubling from 8 bytes to ``reach`` at least.

    The last ranks are the suffix order as far as any common prefix matters.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(data)
    have = np.zeros(n, np.uint64)
    for k in range(8):
        have = have << np.uint64(8) | padded[k : n + k]
    rank, width = ranked(have), 8
    out = [(width, rank.astype(np.int32))]
    while width < reach:
        after = np.concatenate([rank[width:] + 1, np.zeros(min(width, n), np.int64)])[:n]
        rank = ranked(rank * np.int64(n + 1) + after)
        width *= 2
        out.append((width, rank.astype(np.int32)))
    return out


def common_prefix(data: np.ndarray, levels: list[tuple[int, np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes at x and y, as far as the widest level sees."""
    size, n = np.zeros(len(x), np.int64), len(data)

    def step(width: int, values: np.ndarray, going: np.ndarray) -> np.ndarray:
        i, j = x + size, y + size
        same = going & (i + width <= n) & (j + width <= n)
        same[same] = values[i[same]] == values[j[same]]
        size[same] += width
        return same

    for width, rank in reversed(levels):
        step(width, rank, np.ones(len(x), bool))
    going = np.ones(len(x), bool)
    for _ in range(7):
        going = step(1, data, going)
    return size


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """Index of the previous smaller value, -1 if none, by pointer jumping."""
    out = np.arange(len(x)) - 1
    todo = np.arange(len(x))
    while len(todo):
        todo = todo[out[todo] >= 0]
        todo = todo[x[out[todo]] >= x[todo]]
        out[todo] = out[out[todo]]
    return out


def previous_factor(data: np.ndarray, levels: list[tuple[int, np.ndarray]], start: np.ndarray, stop: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Longest previous factor of the suffixes at ``start``, each within its own snippet, which ends at ``stop``.

    In suffix order the earlier suffix with the longest common prefix is next
    to a suffix among those with smaller positions: the previous or the next
    smaller position.
    """
    order = np.lexsort((position, levels[-1][1][start]))
    p = position[order]
    before = nearest_smaller(p)
    after = len(p) - 1 - nearest_smaller(p[::-1])[::-1]
    out = np.zeros(len(p), np.int64)
    for other in (before, after):
        here = np.flatnonzero((other >= 0) & (other < len(p)))
        i, j = order[here], order[other[here]]
        common = np.minimum(common_prefix(data, levels, start[i], start[j]), np.minimum(stop[i] - start[i], stop[j] - start[j]))
        out[i] = np.maximum(out[i], common)
    return out


def repeats(h: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, snippets: list[bytes], length: int) -> pa.RecordBatch:
    """Windows whose longest previous factor within the group of their anchor reaches ``length``, from one suffix order."""
    sizes = np.array([len(x) for x in snippets], np.int64)
    first = np.cumsum(sizes) - sizes
    count = (hi - lo + 1).astype(np.int64)
    starts = ranges(first, count)
    row = np.repeat(np.arange(len(count)), count)
    at = lo[row] + (starts - first[row])
    data = np.frombuffer(b"".join(snippets), np.uint8)
    order = np.lexsort((at, doc[row]))
    d, a = doc[row][order], at[order]
    position = np.empty(len(order), np.int64)
    position[order] = np.concatenate([[0], np.cumsum((d[1:] != d[:-1]) | (a[1:] != a[:-1]))])
    hit = previous_factor(data, suffix_levels(data, 2 * length), starts, (first + sizes)[row], position) >= length
    return removals(doc[row][hit], at[hit], at[hit] + length)


def compared(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Removals among the runs whose anchor has several contexts."""
    large = wanted.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("h", F.lit(True).alias("large"))
    asked = wanted.join(large, "h", "left").groupBy("doc_id").agg(F.collect_list(F.struct("h", "at", F.coalesce("large", F.lit(False)).alias("large"))).alias("asked"))

    def asks(batch: pa.RecordBatch, large: bool) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(h, doc_id, lo, hi, bytes) of the runs asked for; rows without any pass by."""
        batch = batch.filter(batch.column("asked").is_valid())
        for doc, text, asked in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), batch.column("asked").to_pylist(), strict=True):
            for x in asked:
                lo = x["at"] >> 32
                hi = lo + (x["at"] & 0xFFFFFFFF)
                if x["large"] == large and hi + length <= len(text):  # else of another row of the same doc_id
                    yield x["h"], doc, lo, hi, text[lo : hi + length]

    def snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*asks(batch, False), strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["h", "doc_id", "lo", "hi", "bytes"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window by itself, its bytes' hash as its key."""
        for batch in batches:
            parts = []
            for _, doc, lo, hi, data in asks(batch, True):
                k = np.arange(hi - lo + 1)
                parts.append((Rolling(np.frombuffer(data, np.uint8)).of(k, k + length).view(np.int64), np.full(len(k), doc), lo + k))
            cols = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "doc_id", "lo"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The batches in slices of about ORDERED bytes of snippets."""
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ORDERED, "right")))
                yield batch.slice(at, to - at)
                at = to

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; whole groups are gathered up to ORDERED bytes, or one group."""
        parts: list[tuple] = []
        size = 0

        def solved(p: list[tuple]) -> pa.RecordBatch:
            h, doc, lo, hi = (np.concatenate([x[i] for x in p]) for i in range(4))
            return repeats(h, doc, lo.astype(np.int64), hi.astype(np.int64), [b for x in p for b in x[4]], length)

        for batch in slices(batches):
            h = longs(batch, "h")
            rows = (h, longs(batch, "doc_id"), longs(batch, "lo"), longs(batch, "hi"), batch.column("bytes").to_pylist())
            parts.append(rows)
            size += sum(map(len, rows[4]))
            if size > ORDERED:
                whole = tuple(np.concatenate([x[i] for x in parts]) for i in range(4))
                snippets = [b for x in parts for b in x[4]]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last group may go on
                if cut:
                    yield solved([(*(c[:cut] for c in whole), snippets[:cut])])
                parts = [(*(c[cut:] for c in whole), snippets[cut:])]
                size = sum(map(len, parts[0][4]))
        if parts:
            yield solved(parts)

    # a left join, so that this shuffle of the texts is the one that the result needs, and is made once
    told = texts(docs).join(asked, "doc_id", "left")
    fetched = arrow_map(told, snippets, "h long, doc_id long, lo int, hi int, bytes binary")
    by_suffix = arrow_map(fetched.repartition("h").sortWithinPartitions("h"), solve, RUNS).select("doc_id", "at")
    windows = durable(arrow_map(told, single, "h long, doc_id long, lo long")) if large.limit(1).count() else docs.sparkSession.createDataFrame([], "h long, doc_id long, lo long")
    earliest = windows.groupBy("h").agg(F.min(F.struct("doc_id", "lo")).alias("e"), F.count("*").alias("n")).where("n > 1").select("h", F.col("e.doc_id").alias("e_doc"), F.col("e.lo").alias("e_lo"))
    by_window = windows.join(earliest, "h").where("doc_id <> e_doc or lo <> e_lo").select("doc_id", (F.shiftleft("lo", 32) + length).alias("at"))
    return by_suffix.unionAll(by_window)


def remove_repeats(docs: DataFrame, length: int = LENGTH, core: int = CORE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every row.

    A byte goes if a ``length``-byte string that covers it starts earlier too:
    in a smaller doc_id, or earlier in the same text.  Null text is empty;
    shorter texts lose nothing; a row with a null doc_id has no place in the
    order and is left whole; rows that repeat a doc_id are one document and
    lose the same bytes.
    """
    found = durable(shared_runs(local_runs(docs, length, core), length))
    cut = found.where("context is null").select("doc_id", "at").unionAll(compared(found.where("context is not null").select("h", "doc_id", "at"), docs, length))
    spans = cut.groupBy("doc_id").agg(F.collect_list("at").alias("spans"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            column = batch.column("spans")
            at_all = column.flatten().to_numpy(zero_copy_only=False)
            lows = at_all >> 32
            highs = lows + (at_all & 0xFFFFFFFF)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            for text, e, k in zip(utf8(batch, "text"), ends.tolist(), sizes.tolist(), strict=True):
                n_spans, at, kept = 0, 0, []
                if k:
                    lo, hi = lows[e - k : e], highs[e - k : e]
                    order = np.argsort(lo, kind="stable")
                    lo, reach = lo[order], np.maximum.accumulate(hi[order])
                    new = np.concatenate([[True], lo[1:] > reach[:-1]])
                    stops = reach[np.concatenate([np.nonzero(new)[0][1:], [k]]) - 1]
                    for s, t in zip(lo[new].tolist(), np.minimum(stops, len(text)).tolist(), strict=True):
                        if s < t:
                            kept.append(text[at:s])
                            n_spans, at = n_spans + 1, t
                kept.append(text[at:])
                rest = b"".join(kept)
                out.append((len(text), len(text) - len(rest), n_spans, hashlib.sha256(rest).hexdigest(), rest))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return arrow_map(texts(docs).join(spans, "doc_id", "left"), kernel, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
