"""Line dedup by an exact set-similarity join.

A line's tokens are ordered by rarity, so two lines that are similar enough
share a token among the first few of each (prefix filter).  Lines that meet in
a token are screened by length and position, before they are paired, and by a
bitmap of parities, which are exact bounds; the likeliest earlier lines are
verified on their token sets.  Lines with equal sets form one class first, and
only classes are joined.  A line goes if an equal or similar line stands
earlier, in a smaller doc_id or higher up in the same text.

A line whose likeliest partners fail, though it has others, is looked up once
more: such lines are broadcast in blocks of bounded size, and every line of
the corpus is compared with those whose prefix it meets.  So each step gives
rows in proportion to lines, whatever the size of a group.

Rarity comes from counts of all tokens of all documents, kept in a table of a
fixed number of cells; any order gives the same result, as long as all use it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, arrow_map, durable, longs, mix, ranges, strips, summed, table, texts, utf8
from .setjoin import by_line, overlap
from .tokens import Words

PERCENT = 80
#: Cells of the table of counts (4 bytes each), a power of 2.
CELLS = 1 << 20
#: Tokens that a task gathers before it drops the repeated lines among them; a line counts as three at least.
GATHER = 2_000_000
#: Bytes of text whose words a task takes at once.
PIECE_BYTES = 1 << 17
#: Likeliest earlier sets that a token's group names for a line, unless the first is near beyond doubt.
LIKELIEST = 3
#: Tokens of open lines in one broadcast block (8 bytes each).
BLOCK_TOKENS = 1_000_000
SALT = np.uint64(0xA0761D6478BD642F)


def cells_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(CELLS - 1)).view(np.int64)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PIECE_BYTES, whose arrays stay in a core's cache."""
    for batch in batches:
        rows = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def token_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences of tokens by cell, over all documents; CELLS numbers, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.int64)
        for batch in pieces(batches):
            np.add.at(cells, cells_of(Words(batch.column("text")).hash), 1)
        yield strips(cells)

    return np.minimum(summed(arrow_map(texts(docs), count, "strip int, cells binary"), CELLS), 2**31 - 1).astype(np.int32)


class Sought:
    """Some tokens, to be found among very many."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.marked = np.unique(tokens), np.zeros(CELLS, bool)
        self.marked[cells_of(tokens)] = True

    def held(self, h: np.ndarray) -> np.ndarray:
        """Which of the hashes are of these tokens."""
        at = np.flatnonzero(self.marked[cells_of(h)])
        return at[self.tokens[np.minimum(np.searchsorted(self.tokens, h[at]), len(self.tokens) - 1)] == h[at]]


class Lines:
    """The lines with a word: row, number, and their distinct tokens in order of rarity, one line after another.

    Given ``sought``, only lines that have one of its tokens.
    """

    def __init__(self, column: pa.Array, counts: np.ndarray, sought: Sought | None = None):
        w = Words(column)
        row = w.rows()
        number = w.lines(row)
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        of = np.cumsum(new) - 1
        h = w.hash
        if sought is not None:
            use = np.zeros(int(new.sum()), bool)
            use[of[sought.held(h)]] = True
            use = use[of]
            row, number, new, h = row[use], number[use], new[use], h[use]
            of = np.cumsum(new) - 1
        order = by_line(of, h, counts[cells_of(h)])
        of, h = of[order], h[order]
        once = np.ones(len(h), bool)
        once[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
        self.row, self.number = row[new], number[new]
        self.tokens = h[once]
        self.size = np.bincount(of[once], minlength=len(self.row)).astype(np.int64)
        self.start = np.cumsum(self.size) - self.size


def class_ids(h: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each set's id in three parts: a sum of hashes, and the parities of 128 groups of tokens."""
    if not len(start):
        return tuple(np.empty(0, np.int64) for _ in range(3))
    m = mix(h ^ SALT)
    bit, upper = np.uint64(1) << (m >> np.uint64(58)), (m & np.uint64(1)).astype(bool)
    low, high = (np.bitwise_xor.reduceat(np.where(use, bit, np.uint64(0)), start).view(np.int64) for use in (~upper, upper))
    return np.add.reduceat(mix(h), start).view(np.int64), low, high


def line_key(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(doc.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + line.astype(np.uint64))


def prefix_sizes(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set's prefix; 0 for sets so small that they are similar to none but their equals."""
    return np.where(100 * n >= percent * (n + 1), n - -(-percent * n // 100) + 1, 0)


def largest_partner(n: np.ndarray, place: np.ndarray, percent: int) -> np.ndarray:
    """The largest size with which a set of ``n`` tokens can be similar if their first common token is at ``place``."""
    return np.minimum(100 * n // percent, (n - place) * (100 + percent) // percent - n)


def keys_of(lines: DataFrame) -> np.ndarray:
    """Sorted hashes of lines (doc_id, line) that are counted to be few."""
    t = lines.select("doc_id", "line").toArrow()
    return np.unique(line_key(t.column("doc_id").to_numpy(), t.column("line").to_numpy()))


def unused(docs: DataFrame, name: str) -> str:
    """``name``, or one like it that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def with_lines(docs: DataFrame, side: DataFrame, name: str) -> DataFrame:
    """``docs`` with the numbers of their lines that are in ``side`` (doc_id, line; written, distinct) as a list, empty or null for none.

    Up to BROADCAST_IDS lines, counted first, go to the executors as hashes of
    64 bits and no text moves; more are joined by shuffle.
    """
    if side.limit(BROADCAST_IDS + 1).count() > BROADCAST_IDS:
        return docs.join(side.groupBy("doc_id").agg(F.collect_list("line").alias(name)), "doc_id", "left").select(*docs.columns, name)
    held = docs.sparkSession.sparkContext.broadcast(keys_of(side))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = held.value
        for batch in batches:
            doc = batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            size = pc.count_substring(batch.column("text"), "\n").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            size[~batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)] = 0
            line = ranges(np.zeros(len(size), np.int64), size)
            row = np.repeat(np.arange(len(size)), size)
            key = line_key(doc[row], line)
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=len(size)))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(line[hit]))], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])
    return arrow_map(docs, kernel, schema)


#: A row's size tells what it is: a prefix token of a set (its size, 1 or more), a set's first line in a task, or a line found to repeat.
FIRST, REPEAT = 0, -1
ENTRY = ["token", "at", "sa", "sb", "sc", "doc_id", "line"]


def entries(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """Rows (token, size and place, set, doc_id, line) for the rarest tokens of each set, from its first line in each task.

    That line is a row by itself, and the task's other lines of the set are
    repeats of it.  ``at`` is (size + 1) << 32 | place.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)

    def rows(token, size, place, sa, sb, sc, doc, line) -> pa.RecordBatch:
        at = (np.asarray(size, np.int64) + 1) << 32 | place
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(np.broadcast_to(c, len(doc)), np.int64)) for c in (token, at, sa, sb, sc, doc, line)], names=ENTRY)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = held.value
        kept: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            """The gathered sets in order of lines; of each only the first goes on."""
            if not kept:
                return
            sa, sb, sc, doc, line, n, h = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            start = np.cumsum(n) - n
            order = np.lexsort((line, doc, sc, sb, sa))
            a, b, c = sa[order], sb[order], sc[order]
            new = np.ones(len(order), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
            lead, rest = order[new], order[~new]
            of = order[new][np.cumsum(new) - 1][~new]
            rest = rest[(doc[rest] != doc[of]) | (line[rest] != line[of])]
            yield rows(line_key(doc[rest], line[rest]).view(np.int64), REPEAT, 0, 0, 0, 0, doc[rest], line[rest])
            yield rows(mix(sa[lead].view(np.uint64) ^ SALT).view(np.int64), FIRST, 0, sa[lead], sb[lead], sc[lead], doc[lead], line[lead])
            length = prefix_sizes(n[lead], percent)
            for k in range(0, len(lead), 25_000):
                some, m = lead[k : k + 25_000], length[k : k + 25_000]
                own, at = np.repeat(some, m), ranges(np.zeros(len(m), np.int64), m)
                yield rows(h[start[own] + at].view(np.int64), n[own], at, sa[own], sb[own], sc[own], doc[own], line[own])

        gathered = 0
        for batch in pieces(batches):
            batch = batch.filter(batch.column("doc_id").is_valid())
            x = Lines(batch.column("text"), counted)
            kept.append([*class_ids(x.tokens, x.start), longs(batch, "doc_id")[x.row], x.number, x.size, x.tokens])
            gathered += max(len(x.tokens), 3 * len(x.size))
            if gathered > GATHER:
                yield from flush()
                gathered = 0
        yield from flush()

    return arrow_map(texts(docs), kernel, ", ".join(f"{c} long" for c in ENTRY))


FOUND = "doc_id long, line long, e_doc long, e_line long, more long"


def matches(entered: DataFrame, percent: int) -> DataFrame:
    """For each set that may have similar earlier ones, the likeliest of each token's group.

    Rows: (doc_id, line) of the set's first line, (e_doc, e_line) of an earlier
    set's, and the number of other earlier sets of the group (told once a group
    and line).  Lines whose set stands earlier have no e_doc.
    """
    names = ["doc_id", "line", "e_doc", "e_line", "more"]

    def out(doc, line, e_doc, e_line, more) -> pa.RecordBatch:
        big = lambda x: pa.nulls(len(doc), pa.int64()) if x is None else pa.array(x)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line), big(e_doc), big(e_line), pa.array(more)], names=names)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by token, size, place, set, line; of a group that goes on, only rows that can meet the next size are held."""
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [longs(batch, c) for c in ENTRY]
            held = 0
            if rest is not None:
                held = len(rest[0])
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            token, at, sa, sb, sc, doc, line = cols
            size = (at >> 32) - 1
            same = np.zeros(len(token), bool)  # the same set from another task: it comes after the earliest
            same[1:] = (token[1:] == token[:-1]) & (at[1:] == at[:-1]) & (sa[1:] == sa[:-1]) & (sb[1:] == sb[:-1]) & (sc[1:] == sc[:-1]) & (size[1:] != REPEAT)
            gone = (size == REPEAT) | (same & (size == FIRST))
            gone[:held] = False
            if gone.any():
                # a row that repeats the very line it stands for is another row of one document
                lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(token))))
                told = gone & ((size == REPEAT) | (doc != doc[lead]) | (line != line[lead]))
                yield out(doc[told], line[told], None, None, np.zeros(int(told.sum()), np.int64))
            go = ~same & (size != REPEAT)
            held -= int((~go[:held]).sum())
            token, at, sa, sb, sc, doc, line = cols = [x[go] for x in cols]
            size, place = size[go], at & 0xFFFFFFFF
            total, reach = len(token), largest_partner(size, place, percent)
            low, high = sb.view(np.uint64), sc.view(np.uint64)
            least, likely, count = np.full((LIKELIEST, total), 1 << 30), np.full((LIKELIEST, total), -1), np.zeros(total, np.int64)
            sure = np.zeros(total, bool)
            active, d = np.nonzero(size > FIRST)[0], 1
            while len(active):
                active = active[active + d < total]
                other = active + d
                near = (token[other] == token[active]) & (size[other] <= reach[active])
                active, other = active[near], other[near]  # sorted by size: who is out of reach stays so
                i, j = active[other >= held], other[other >= held]
                need = overlap(size[i], size[j], percent)
                ok = size[j] - place[j] >= need
                i, j, need = i[ok], j[ok], need[ok]
                apart = np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j])
                most = size[i] + size[j] - 2 * need
                ok = apart <= most
                i, j, apart, most = i[ok], j[ok], apart[ok], most[ok]
                forward = (doc[i] < doc[j]) | ((doc[i] == doc[j]) & (line[i] < line[j]))
                for late, early, use in ((j, i, forward), (i, j, ~forward)):
                    late, early, far = late[use], early[use], apart[use]  # a row is late once here
                    count[late] += 1
                    sure[late[2 * far <= most[use]]] = True
                    for k in range(LIKELIEST):
                        better = far < least[k, late]
                        to = late[better]
                        far[better], least[k, to] = least[k, to], far[better]
                        early[better], likely[k, to] = likely[k, to], early[better]
                d += 1
            k = np.nonzero(count)[0]
            for rank in range(LIKELIEST):
                if rank:
                    k = k[(likely[rank, k] >= 0) & ~sure[k]]
                if len(k):
                    e = likely[rank, k]
                    given = np.minimum(np.where(sure[k], 1, LIKELIEST), count[k])
                    yield out(doc[k], line[k], doc[e], line[e], count[k] - given if rank == 0 else np.zeros(len(k), np.int64))
            if total:
                keep = (token == token[-1]) & (reach >= size[-1])
                keep[-1] = True
                rest = [c[keep] for c in cols]

    ordered = entered.repartition("token").sortWithinPartitions(*ENTRY)
    return arrow_map(ordered, kernel, FOUND)


def fetched(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, line, tokens) of the lines asked for (written, distinct): sorted hashes of their sets."""
    near = with_lines(texts(docs), wanted, "lines").where(F.size("lines") > 0)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, line, found = [], [], []
            for d, t, asked in zip(batch.column("doc_id").to_pylist(), utf8(batch, "text"), batch.column("lines").to_pylist(), strict=True):
                lines = t.split(b"\n")
                for j in asked:
                    if j < len(lines):
                        doc.append(d)
                        line.append(j)
                        found.append(lines[j])
            w = Words(pa.array(found, pa.binary()))
            tokens = [np.unique(w.hash[a:b]).tobytes() for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(line, pa.int64()), pa.array(tokens, pa.binary())], names=["doc_id", "line", "tokens"])

    return arrow_map(near, fetch, "doc_id long, line long, tokens binary").dropDuplicates(["doc_id", "line"])


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs of lines (doc_id, line, e_doc, e_line) whose token sets reach the threshold."""
    wanted = durable(pairs.select("doc_id", "line").union(pairs.select("e_doc", "e_line")).distinct())
    sets = fetched(wanted, docs)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(batch.column("tokens").to_pylist(), batch.column("e_tokens").to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["doc_id", "line"])

    other = sets.select(F.col("doc_id").alias("e_doc"), F.col("line").alias("e_line"), F.col("tokens").alias("e_tokens"))
    return arrow_map(pairs.select("doc_id", "line", "e_doc", "e_line").join(sets, ["doc_id", "line"]).join(other, ["e_doc", "e_line"]), check, "doc_id long, line long")


def blocks(open_: DataFrame, docs: DataFrame, limit: int) -> Iterator[list[np.ndarray]]:
    """Open lines (doc, line, size, tokens) in blocks of at most ``limit`` tokens or one line."""
    held, size = [], 0
    for r in durable(fetched(open_, docs)).toLocalIterator():
        n = len(r.tokens) // 8
        if held and size + n > limit:
            yield block_of(held)
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield block_of(held)


def block_of(rows: list) -> list[np.ndarray]:
    return [np.array([r.doc_id for r in rows], np.int64), np.array([r.line for r in rows], np.int64), np.array([len(r.tokens) // 8 for r in rows], np.int64), np.frombuffer(b"".join(bytes(r.tokens) for r in rows), np.uint64)]


def looked_up(docs: DataFrame, block: list[np.ndarray], counts: np.ndarray, percent: int) -> DataFrame:
    """The block's lines that have a similar earlier line anywhere: each line of the corpus meets those with a common prefix token."""
    held = docs.sparkSession.sparkContext.broadcast((block, counts))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (doc, number, n, sets), counted = held.value
        start = np.cumsum(n) - n
        owner = np.repeat(np.arange(len(n)), n)
        ordered = sets[by_line(owner, sets, counted[cells_of(sets)])]
        length = prefix_sizes(n, percent)
        own = np.repeat(np.arange(len(n)), length)
        place = ranges(np.zeros(len(n), np.int64), length)
        token = ordered[start[own] + place]
        by = np.argsort(token, kind="stable")
        token, own, place = token[by], own[by], place[by]
        _, low, high = (x.view(np.uint64) for x in class_ids(sets, start))
        done = np.zeros(len(n), bool)
        sought = Sought(token)
        for batch in pieces(batches):
            batch = batch.filter(batch.column("doc_id").is_valid())
            x = Lines(batch.column("text"), counted, sought)
            docs_of = longs(batch, "doc_id")[x.row]
            _, x_low, x_high = (v.view(np.uint64) for v in class_ids(x.tokens, x.start))
            size = prefix_sizes(x.size, percent)
            line = np.repeat(np.arange(len(size)), size)
            at = ranges(np.zeros(len(size), np.int64), size)
            key = x.tokens[x.start[line] + at]
            lo, hi = np.searchsorted(token, key), np.searchsorted(token, key, "right")
            met = hi > lo
            line, at, lo, hi = line[met], at[met], lo[met], hi[met]
            for k in range(0, len(line), 10_000):
                some = slice(k, k + 10_000)
                times = hi[some] - lo[some]
                a, a_at = np.repeat(line[some], times), np.repeat(at[some], times)
                e = ranges(lo[some], times)
                b, b_at = own[e], place[e]
                need = overlap(x.size[a], n[b], percent)
                apart = np.bitwise_count(x_low[a] ^ low[b]).astype(np.int64) + np.bitwise_count(x_high[a] ^ high[b])
                ok = ~done[b] & (np.minimum(x.size[a] - a_at, n[b] - b_at) >= need) & (apart <= x.size[a] + n[b] - 2 * need) & ((docs_of[a] < doc[b]) | ((docs_of[a] == doc[b]) & (x.number[a] < number[b])))
                for i, j in np.unique(np.stack([b[ok], a[ok]], axis=1), axis=0).tolist():
                    if not done[i]:
                        done[i] = similar(sets[start[i] : start[i] + n[i]], np.sort(x.tokens[x.start[j] : x.start[j] + x.size[j]]), percent)
        yield pa.RecordBatch.from_arrays([pa.array(doc[done]), pa.array(number[done])], names=["doc_id", "line"])

    return arrow_map(texts(docs), kernel, "doc_id long, line long").distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, line) of every line with an equal or similar one before it, written to the shared folder.

    The likeliest earlier sets of each line are verified first; a line for
    which they fail and that has others is looked up among all lines, so copies
    don't meet in all pairs and no match is missed.
    """
    counts = token_counts(docs)
    found = durable(matches(entries(docs, counts, percent), percent))
    repeats = found.where("e_doc is null").select("doc_id", "line")
    tries = durable(found.where("e_doc is not null").groupBy("doc_id", "line", "e_doc", "e_line").agg(F.sum("more").alias("more")))
    hit = durable(verified(tries, docs, percent).distinct())
    open_ = durable(tries.where("more > 0").select("doc_id", "line").distinct().join(hit, ["doc_id", "line"], "left_anti"))
    for block in blocks(open_, docs, block_tokens):
        hit = hit.unionAll(durable(looked_up(docs, block, counts, percent)))
    return durable(repeats.unionAll(hit).distinct())


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and kept (text) of every row.

    A line's set is its lower-cased words; sets A and B are similar where
    100 * |A & B| >= percent * |A | B|.  Null text has no lines; lines without
    a word stay; a row with a null doc_id is left
    whole; rows that repeat a doc_id lose the same lines.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, absent, gone in zip(utf8(batch, "text"), batch.column("text").is_null().to_pylist(), batch.column("gone").to_pylist(), strict=True):
                lines = [] if absent else text.split(b"\n")
                drop = set(gone or ())
                kept = [x for j, x in enumerate(lines) if j not in drop] if drop else lines
                rest = b"\n".join(kept)
                out.append((len(lines), len(lines) - len(kept), hashlib.sha256(rest).hexdigest(), rest.decode()))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string()], strict=True))], names=["doc_id", "n_lines", "n_removed", "kept_sha256", "kept"])

    told = with_lines(texts(docs), removed_lines(docs, percent), "gone").select("doc_id", "text", "gone")
    return arrow_map(told, kernel, "doc_id long, n_lines long, n_removed long, kept_sha256 string, kept string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated lines; one that has no word left goes."""
    gone = unused(docs, "gone")
    told = with_lines(docs, removed_lines(docs), gone).withColumn(gone, F.when(F.size(gone) > 0, F.col(gone)))
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(gone, i.cast("long")), x)), lambda x: x.isNotNull()), "\n")
    out = told.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)).where(F.col(gone).isNull() | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)
