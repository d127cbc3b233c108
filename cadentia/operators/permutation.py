"""Permutation tests over participants, with label permutations as a dimension of the rows' arrays.

A permutation is a bijection of the participants' places (places run through
the panels one after another), computed for each place on its own, so nothing
is sorted, collected or broadcast for it, whatever the number of participants.
Draw 0 is the table as it is.  Draws come in blocks; within a block a row
carries arrays over its draws, and what meets in a shuffle are sums by stem,
panel and draw.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .durable import durable
from .inference import step_up
from .ordering import dense_places, running

#: Draws of a block; trials of a stem, and participants with all their trials, that one task holds at a time, about.
BLOCK, SHARD, PEOPLE = 2_000, 8_000, 1_000
#: Rows whose arrays a kernel works on at once.
STEP = 64
ROUNDS = 6
#: Elements that are worked on at once and stay near; sizes of a half for which 16 bits of a hash are even.
NEAR, NARROW = 1 << 15, 1 << 12
#: Places whose panels are looked up in a table; those of more are searched for.
TABLE = 1 << 20
#: Bounds of the classes of a period ratio, in order: double, matched, half (fixed values); then other and unclear.
RATIOS = ((0.35, 0.65), (0.80, 1.25), (1.75, 2.25))
MATCHED, N_CLASSES = 1, 5
#: Other panels that a reference period needs.
OTHERS = 3
#: A statistic that falls short of the observed one by rounding alone reaches it.
CLOSE = 1e-12


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ x >> np.uint64(33)


@dataclass(frozen=True)
class Labels:
    """Panel numbers of places under every draw; ``sizes`` are the panels', in the order of the places."""

    sizes: tuple[int, ...]
    seed: int

    def moved(self, place: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Where each draw (columns) puts each place (rows): a Feistel network over a * b places, walked until it ends within those there are."""
        n = sum(self.sizes)
        a = max(2, int(np.ceil(np.sqrt(n))))
        b = max(2, -(-n // a))
        keys = scrambled(scrambled(draws.astype(np.uint64) + np.uint64(self.seed << 20))[:, None] + np.arange(ROUNDS, dtype=np.uint64)).astype(np.uint32)

        def shift(half: np.ndarray, other: np.ndarray, key: np.ndarray, size: int, h: np.ndarray) -> None:
            """Add to ``half``, modulo its size, what the other half and the key name; 32 bits, in place."""
            np.add(other, key, out=h)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0xC2B2AE35)
            if size <= NARROW:
                h >>= np.uint32(16)
                h *= np.uint32(size)
                h >>= np.uint32(16)
            else:
                h[...] = np.multiply(h, np.uint64(size), dtype=np.uint64) >> np.uint64(32)
            half += h
            np.minimum(half, np.subtract(half, np.uint32(size), out=h), out=half)  # below 0 wraps around

        def once(x: np.ndarray, key: np.ndarray) -> np.ndarray:
            left, right = np.empty(np.broadcast_shapes(x.shape, key.shape[1:]), np.uint32), np.empty(np.broadcast_shapes(x.shape, key.shape[1:]), np.uint32)
            left[...], right[...] = x // b, x % b
            h = np.empty_like(left)
            for r in range(0, ROUNDS, 2):
                shift(left, right, key[r], a, h)
                shift(right, left, key[r + 1], b, h)
            return left.astype(np.int64) * b + right if n > 1 << 31 else (left * np.uint32(b) + right).astype(np.int64)

        place = place.astype(np.int64)
        out, keys = np.empty((len(place), len(draws)), np.int64), np.ascontiguousarray(keys.T)
        rows = max(1, NEAR // max(1, len(draws)))
        for i in range(0, len(place), rows):
            out[i : i + rows] = once(place[i : i + rows, None], keys)
        flat = out.reshape(-1)
        far = np.flatnonzero(flat >= n)
        while len(far):
            flat[far] = once(flat[far], keys[:, far % len(draws)])
            far = far[flat[far] >= n]
        out[:, draws == 0] = place[:, None]
        return out

    def of(self, place: np.ndarray, draws: np.ndarray) -> np.ndarray:
        ends = np.cumsum(self.sizes)
        if len(ends) == 2:
            return (self.moved(place, draws) >= ends[0]).astype(np.int64)
        if ends[-1] > TABLE:
            return np.searchsorted(ends, self.moved(place, draws), side="right")
        return np.repeat(np.arange(len(ends)), self.sizes)[self.moved(place, draws)]


def placed(units: DataFrame, unit: str, group: str) -> tuple[DataFrame, list, tuple[int, ...]]:
    """(unit, group, panel number, place) of distinct units, and the groups in order with their sizes, a number for each group."""
    each = units.select(unit, group).distinct()
    sizes = {r[0]: r[1] for r in each.groupBy(group).count().collect()}
    names = sorted(sizes, key=str)
    if not names:
        return each.select(unit, group, F.lit(0).alias("panel_no"), F.lit(0).cast("long").alias("place")), [], ()
    number = F.lit(len(names) - 1)
    for i, n in enumerate(names):
        number = F.when(F.col(group).eqNullSafe(F.lit(n)), i).otherwise(number)
    keyed = each.withColumn("panel_no", number).withColumn("key", F.format_string("%06d %s", F.col("panel_no"), F.col(unit).cast("string")))
    places = dense_places(keyed, "key", "place").select("key", (F.col("place") - 1).cast("long").alias("place"))
    return keyed.join(places, "key").drop("key"), names, tuple(sizes[n] for n in names)


def blocks(n_draws: int) -> list[tuple[int, int]]:
    """First draw and the one after the last of each block; draw 0 and ``n_draws`` permutations."""
    return [(i, min(i + BLOCK, n_draws + 1)) for i in range(0, n_draws + 1, BLOCK)]


def in_blocks(rows: DataFrame, n_draws: int) -> DataFrame:
    return rows.withColumn("block", F.explode(F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("stop")) for a, b in blocks(n_draws))))).select("*", "block.*").drop("block")


def draws_of(t: pa.Table) -> np.ndarray:
    return np.arange(t.column("first")[0].as_py(), t.column("stop")[0].as_py())


def floats(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy().astype(float)


def array_of(t: pa.Table, name: str, shape: tuple[int, ...]) -> np.ndarray:
    """The one row's array."""
    return np.frombuffer(t.column(name)[0].as_py(), np.float64).reshape(shape)


def row_of(t: pa.Table, keys: Sequence[str], **arrays: np.ndarray) -> pa.Table:
    """One row: keys as in ``t``, and arrays of doubles as bytes."""
    return pa.table({**{k: t.column(k)[:1] for k in keys}, **{k: pa.array([np.ascontiguousarray(v, np.float64).tobytes()], pa.binary()) for k, v in arrays.items()}})


def added(rows: DataFrame, keys: dict[str, str], *columns: str) -> DataFrame:
    """Arrays of doubles summed by key."""

    def kernel(t: pa.Table) -> pa.Table:
        out = {}
        for c in columns:
            total = None
            for x in t.column(c):
                v = np.frombuffer(x.as_buffer(), np.float64)
                total = v.copy() if total is None else np.add(total, v, out=total)
            out[c] = total
        return row_of(t, list(keys), **out)

    return rows.groupBy(*keys).applyInArrow(kernel, ", ".join([f"{k} {v}" for k, v in keys.items()] + [f"{c} binary" for c in columns]))


DRAWS = {"first": "int", "stop": "int"}


def statistics(sums: DataFrame, n_groups: int, width: int) -> DataFrame:
    """(draw, statistic): between-group sums of squares from group sums and sizes, whose rows (any number to a block) are added up in two steps."""
    part = added(sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16))), DRAWS | {"part": "int"}, "sums", "counts")

    def kernel(t: pa.Table) -> pa.Table:
        draws = draws_of(t)
        s, n = array_of(t, "sums", (len(draws), n_groups, width)), array_of(t, "counts", (len(draws), n_groups))
        grand = s.sum(axis=1) / np.maximum(n.sum(axis=1), 1)[:, None]
        apart = ((s / np.maximum(n, 1)[..., None] - grand[:, None]) ** 2).sum(axis=2)
        return pa.table({"draw": draws.astype(np.int32), "statistic": (n * apart).sum(axis=1)})

    return added(part, DRAWS, "sums", "counts").groupBy("first", "stop").applyInArrow(kernel, "draw int, statistic double")


def p_value(stats: DataFrame, *keys: str) -> DataFrame:
    """observed, permutations and p = (those that reach it + 1) / (permutations + 1) from (keys, draw, statistic); a key has a number for each draw."""
    out = stats.groupBy(*keys).agg(F.max(F.when(F.col("draw") == 0, F.col("statistic"))).alias("observed"), F.collect_list(F.when(F.col("draw") > 0, F.col("statistic"))).alias("drawn"))
    reach = F.size(F.filter("drawn", lambda x: x >= F.col("observed") * (1 - CLOSE) - CLOSE))
    return out.select(*keys, "observed", F.size("drawn").cast("long").alias("permutations"), ((reach + 1) / (F.size("drawn") + 1)).alias("p"))


def group_sums(labels: Labels, place: np.ndarray, x: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the rows of x, and their numbers, by draw and panel."""
    k = len(labels.sizes)
    total, n = np.zeros((x.shape[1], len(draws) * k)), np.zeros(len(draws) * k)
    for i in range(0, len(place), STEP):
        at = (labels.of(place[i : i + STEP], draws) + np.arange(len(draws)) * k).ravel()
        n += np.bincount(at, minlength=len(n))
        for j, c in enumerate(x.T):
            total[j] += np.bincount(at, np.repeat(c[i : i + STEP], len(draws)), minlength=len(n))
    return total.T.reshape(len(draws), k, x.shape[1]), n.reshape(len(draws), k)


def first_sums(labels: Labels, place: np.ndarray, x: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Sums of the rows of x that each draw puts into the first of two groups."""
    total = np.zeros((len(draws), x.shape[1]))
    for i in range(0, len(place), STEP):
        total += (labels.of(place[i : i + STEP], draws) == 0).T.astype(float) @ x[i : i + STEP]
    return total


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over all cores: there are few, and each takes much work, so sizes in bytes say nothing of it."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "place")


def shared_out(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows by key, in several parts for each core: a key's few rows take much work."""
    return rows.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def permutation_test(vectors: DataFrame, group: str, columns: Sequence[str], permutations: int, seed: int, unit: str = "participant") -> DataFrame:
    """Share of label permutations whose between-group statistic reaches the observed one: observed, permutations, p.

    vectors: one row for each unit.  Each task sums its own rows under all
    draws; only sums by draw and group are shuffled.
    """
    units, names, sizes = placed(vectors, unit, group)
    if not names:
        return vectors.sparkSession.createDataFrame([], "observed double, permutations long, p double")
    labels = Labels(sizes, seed)
    rows = vectors.join(units.select(unit, "place"), unit).select("place", F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for b in batches:
            place, x = b.column("place").to_numpy(), np.array(b.column("x").to_pylist(), float).reshape(-1, len(columns))
            for first, stop in blocks(permutations):
                s, n = group_sums(labels, place, x, np.arange(first, stop))
                have = total.setdefault(first, [0, 0, stop])
                have[0], have[1] = have[0] + s, have[1] + n
        for first, (s, n, stop) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([stop], pa.int32()), pa.array([s.tobytes()]), pa.array([n.tobytes()])], names=["first", "stop", "sums", "counts"])

    sums = rows.mapInArrow(kernel, "first int, stop int, sums binary, counts binary")
    return p_value(statistics(sums, len(names), len(columns)))


def pairwise_tests(vectors: DataFrame, group: str, columns: Sequence[str], permutations: int, seed: int, unit: str = "participant") -> DataFrame:
    """The test for every pair of groups, labels permuted within the pair, with differences of means and step-up q values.

    One pass: a unit's row adds to the sums of each pair that its group is
    in.  A row for each pair: group_a, group_b, n_a, n_b, observed, p, q and
    a difference a - b for each column.
    """
    vectors = durable(vectors)
    units, names, sizes = placed(vectors, unit, group)
    k = len(names)
    schema = "a int, b int, draw int, statistic double, diff array<double>"
    rows = vectors.join(units.select(unit, "place", "panel_no"), unit).select("panel_no", "place", F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    rows = spread(rows)
    starts = np.cumsum([0, *sizes])
    pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
    labels = {(a, b): Labels((sizes[a], sizes[b]), seed + 1 + a * k + b) for a, b in pairs}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, list] = {}
        for batch in batches:
            panel, place, x = batch.column("panel_no").to_numpy(), batch.column("place").to_numpy(), np.array(batch.column("x").to_pylist(), float).reshape(-1, len(columns))
            for a, b in pairs:
                mine = (panel == a) | (panel == b)
                if not mine.any():
                    continue
                local = np.where(panel[mine] == a, place[mine] - starts[a], place[mine] - starts[b] + sizes[a])
                for first, stop in blocks(permutations):
                    have = total.setdefault((a, b, first, stop), [0, 0])
                    have[0], have[1] = have[0] + first_sums(labels[a, b], local, x[mine], np.arange(first, stop)), have[1] + x[mine].sum(axis=0)
        for (a, b, first, stop), (s, every) in total.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (a, b, first, stop)), pa.array([s.tobytes()]), pa.array([every.tobytes()])], names=["a", "b", "first", "stop", "sums", "every"])

    def finish(t: pa.Table) -> pa.Table:
        draws, own = draws_of(t), [t.column(c)[0].as_py() for c in "ab"]
        n, every = np.array([sizes[i] for i in own], float), array_of(t, "every", (len(columns),))
        s = array_of(t, "sums", (len(draws), len(columns)))
        mean = np.stack([s, every - s], axis=1) / n[:, None]
        value = (n * ((mean - (every / n.sum())) ** 2).sum(axis=2)).sum(axis=1)
        return pa.table({"a": np.full(len(draws), own[0], np.int32), "b": np.full(len(draws), own[1], np.int32), "draw": draws.astype(np.int32), "statistic": value, "diff": pa.array([(mean[0, 0] - mean[0, 1]).tolist() if d == 0 else None for d in draws], pa.list_(pa.float64()))})

    keys = {"a": "int", "b": "int"} | DRAWS
    sums = added(rows.mapInArrow(kernel, "a int, b int, first int, stop int, sums binary, every binary"), keys, "sums", "every")
    stats = durable(sums.groupBy(*keys).applyInArrow(finish, schema))
    p = durable(p_value(stats, "a", "b").withColumn("family", F.lit(0)))
    tests = step_up(p, ["family"], "p").join(stats.where("draw = 0").select("a", "b", "diff"), ["a", "b"])
    name, size = (F.array(*map(F.lit, x)) if x else F.array() for x in ([str(n) for n in names], [int(s) for s in sizes]))
    at = lambda column, of: F.get(of, F.col(column))
    return tests.select(at("a", name).alias(f"{group}_a"), at("b", name).alias(f"{group}_b"), at("a", size).cast("long").alias("n_a"), at("b", size).cast("long").alias("n_b"), "observed", "permutations", "p", "q", *(F.get("diff", F.lit(j)).alias(f"{c}_a_minus_b") for j, c in enumerate(columns)))


BINS, PER_SECOND = 600, 20


def sampled_coherence(taps: DataFrame, keys: Sequence[str], n: int, draws: int, seed: int, least_taps: int = 2) -> DataFrame:
    """Mean coherence of ``draws`` samples of ``n`` participants of each key: keys, istc and draws; null and 0 where fewer have ``least_taps`` taps.

    A participant is a set of 100 ms bins, one row; which draws it is in comes
    from its place among its key's participants, so rows are not repeated for
    the draws, and tasks send counts by draw and bin.
    """
    bins = F.sequence(F.ceil((F.col("tap_us") - 50_000) / 50_000.0), F.floor((F.col("tap_us") + 50_000) / 50_000.0))
    units = taps.groupBy(*keys, "participant").agg(F.count("*").alias("taps"), F.array_distinct(F.flatten(F.collect_list(bins))).alias("bins")).where(F.col("taps") >= least_taps)
    units = units.withColumn("bins", F.filter("bins", lambda b: (b >= 0) & (b < BINS)))
    size = units.groupBy(*keys).agg(F.count("*").alias("of")).where(F.col("of") >= n)
    cell = F.to_json(F.struct(*keys)).alias("cell")
    rows = running(units.join(size, list(keys)), keys, "participant", F.lit(1), "place").select(cell, "of", "place", "bins")
    columns = np.arange(1, draws + 1)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["cell", "counts"])
            held.clear()
            return out

        for b in batches:
            for name, of, place, own in zip(*(b.column(c).to_pylist() for c in ("cell", "of", "place", "bins")), strict=True):
                if name not in held and len(held) >= STEP:
                    yield given()
                total = held.setdefault(name, np.zeros((draws, BINS)))
                labels = Labels((n, of - n), (seed + zlib.crc32(name.encode())) & 0xFFFFFFFF)
                chosen = np.flatnonzero(labels.of(np.array([place]), columns)[0] == 0)
                total[chosen[:, None], np.array(own, np.int64)[None]] += 1
        yield given()

    def means(t: pa.Table) -> pa.Table:
        most = array_of(t, "counts", (draws, BINS // PER_SECOND, PER_SECOND)).max(axis=2)
        return pa.table({"cell": t.column("cell")[:1], "istc": [float(most.mean())]})

    found = added(rows.mapInArrow(kernel, "cell string, counts binary"), {"cell": "string"}, "counts").groupBy("cell").applyInArrow(means, "cell string, istc double")
    every = taps.select(*keys).distinct().withColumn("cell", F.to_json(F.struct(*keys)))
    return every.join(found, "cell", "left").select(*keys, "istc", F.when(F.col("istc").isNotNull(), draws).otherwise(0).cast("long").alias("draws"))


def other_middles(values: np.ndarray) -> np.ndarray:
    """For each entry the median of the row's other finite entries, of OTHERS at least; rows are sorted once, and an entry's own place is stepped over."""
    order = np.argsort(values, axis=1, kind="stable")
    row = np.take_along_axis(values, order, axis=1)
    n = np.isfinite(values).sum(axis=1)[:, None]
    own = np.argsort(order, axis=1, kind="stable")  # place of each entry in its sorted row
    left = n - np.isfinite(values)
    pick = []
    for at in ((left - 1) // 2, left // 2):
        at = np.where(np.isfinite(values) & (at >= own), at + 1, at)
        pick.append(np.take_along_axis(row, np.clip(at, 0, values.shape[1] - 1), axis=1))
    return np.where(left >= OTHERS, (pick[0] + pick[1]) / 2, np.nan)


def class_of(ratio: np.ndarray) -> np.ndarray:
    out = np.where(np.isfinite(ratio) & (ratio > 0), 3, 4)
    for c, (low, high) in enumerate(RATIOS):
        out[(ratio >= low) & (ratio <= high)] = c
    return out


def reference_periods(trials: DataFrame, labels: Labels, n_draws: int) -> DataFrame:
    """(stem_id, first, stop, reference): per draw and panel the median of the other panels' median periods.

    A stem's periods are cut into slices of values; a slice needs to know how
    many of each draw and panel lie below it to find the medians that fall in it.
    """
    k = len(labels.sizes)
    rows = trials.where(F.col("period_us").isNotNull() & ~F.isnan(F.col("period_us").cast("double"))).select("stem_id", "place", F.col("period_us").cast("double").alias("period_us"))
    size = rows.groupBy("stem_id").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("slices"), F.percentile_approx("period_us", F.array(*(F.lit(i / 64) for i in range(1, 64))), 10_000).alias("cuts"))
    below = F.size(F.filter("cuts", lambda c: c < F.col("period_us")))
    sliced = in_blocks(rows.join(size, "stem_id").select("stem_id", "place", "period_us", F.floor(below * F.least("slices", F.lit(64)) / 64).cast("int").alias("slice")), n_draws)
    keys = ["stem_id", "first", "stop"]

    def counted(t: pa.Table) -> pa.Table:
        draws, place = draws_of(t), t.column("place").to_numpy()
        n = np.zeros(len(draws) * k)
        for i in range(0, len(place), STEP):
            n += np.bincount((labels.of(place[i : i + STEP], draws) + np.arange(len(draws)) * k).ravel(), minlength=len(n))
        return row_of(t, [*keys, "slice"], n=n)

    def summed_up(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("slice").to_numpy(), kind="stable")
        n = np.stack([np.frombuffer(t.column("n")[int(i)].as_py(), np.float64) for i in order])
        before, total = np.cumsum(n, axis=0) - n, n.sum(axis=0)
        return pa.table({**{c: t.column(c).take(pa.array(order)) for c in [*keys, "slice"]}, "before": pa.array([x.tobytes() for x in before], pa.binary()), "total": pa.array([total.tobytes()] * len(order), pa.binary())})

    def middles(t: pa.Table, known: pa.Table) -> pa.Table:
        draws = draws_of(t)
        order = np.argsort(floats(t, "period_us"), kind="stable")
        place, value = t.column("place").to_numpy()[order], floats(t, "period_us")[order]
        seen, total = array_of(known, "before", (len(draws), k)).copy(), array_of(known, "total", (len(draws), k))
        want = np.stack([(total + 1) // 2, total // 2 + 1])
        found = np.full((2, len(draws), k), np.nan)
        column = np.arange(len(draws))
        for i in range(len(place)):  # a row of draws at a time
            label = labels_at[i % STEP] if i % STEP else (labels_at := labels.of(place[i : i + STEP], draws))[0]
            seen[column, label] += 1
            now = seen[column, label]
            for w in (0, 1):
                hit = want[w, column, label] == now
                found[w, column[hit], label[hit]] = value[i]
        return row_of(t, keys, found=found)

    def others(t: pa.Table) -> pa.Table:
        draws = draws_of(t)
        found = np.full((2, len(draws), k), np.nan)
        for x in t.column("found"):
            np.fmax(found, np.frombuffer(x.as_py(), np.float64).reshape(found.shape), out=found)
        return row_of(t, keys, reference=other_middles((found[0] + found[1]) / 2))

    key_types = "stem_id string, first int, stop int"
    sliced = shared_out(sliced, [*keys, "slice"])
    n = sliced.groupBy(*keys, "slice").applyInArrow(counted, f"{key_types}, slice int, n binary")
    known = n.groupBy(*keys).applyInArrow(summed_up, f"{key_types}, slice int, before binary, total binary")
    found = sliced.groupBy(*keys, "slice").cogroup(shared_out(known, [*keys, "slice"]).groupBy(*keys, "slice")).applyInArrow(middles, f"{key_types}, found binary")
    return found.groupBy(*keys).applyInArrow(others, f"{key_types}, reference binary")


class Stem:
    """Trials of a shard of one stem under a block of draws: labels, ratio classes and directions of taps."""

    def __init__(self, t: pa.Table, refs: pa.Table, labels: Labels):
        self.draws, self.labels, self.k = draws_of(t), labels, len(labels.sizes)
        self.place, self.period = t.column("place").to_numpy(), floats(t, "period_us")
        self.t, self.reference = t, array_of(refs, "reference", (len(self.draws), self.k)) if refs.num_rows else np.full((len(self.draws), self.k), np.nan)

    def steps(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Rows, their labels and their classes, a few rows at a time; columns are draws."""
        for i in range(0, len(self.place), STEP):
            rows = slice(i, i + STEP)
            label = self.labels.of(self.place[rows], self.draws)
            yield rows, label, class_of(self.period[rows, None] / self.reference[np.arange(len(self.draws)), label])


def over_stems(trials: DataFrame, refs: DataFrame, labels: Labels, n_draws: int, kernel: Callable[[Stem, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Call ``kernel`` with each shard of each stem's trials and the stem's row of ``refs``, for each block of draws."""
    size = trials.groupBy("stem_id").agg(F.ceil(F.count("*") / SHARD).cast("long").alias("shards"))
    dealt = in_blocks(trials.join(size, "stem_id").withColumn("shard", F.pmod("place", "shards").cast("int")).drop("shards"), n_draws)
    spread = refs.join(size, "stem_id").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1))).drop("shards")
    keys = ["stem_id", "first", "stop", "shard"]

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()

    def both(t: pa.Table, r: pa.Table) -> pa.Table:
        return kernel(Stem(t, r, labels), r) if t.num_rows else empty

    return shared_out(dealt, keys).groupBy(*keys).cogroup(shared_out(spread, keys).groupBy(*keys)).applyInArrow(both, schema)


KEYS = ["stem_id", "first", "stop"]
KEY_TYPES = {"stem_id": "string"} | DRAWS
HEAD = "stem_id string, first int, stop int"


def metrical_statistics(trials: DataFrame, refs: DataFrame, labels: Labels, n_draws: int) -> DataFrame:
    """(draw, statistic) of participants' residual class shares, with references and classes of each draw's own panels.

    A participant's mean residual is linear in its trials, so a panel's sum
    needs, per stem and class, only the trials' number and their weights (one
    over the participant's number of trials).
    """
    k = len(labels.sizes)

    def cells(s: Stem, _: pa.Table) -> pa.Table:
        d = len(s.draws)
        weight, n = np.zeros(d * k * N_CLASSES), np.zeros(d * N_CLASSES)
        own = floats(s.t, "weight")
        for rows, label, kind in s.steps():
            column = np.arange(d)
            weight += np.bincount((((column * k + label) * N_CLASSES) + kind).ravel(), np.repeat(own[rows], d), minlength=len(weight))
            n += np.bincount((column * N_CLASSES + kind).ravel(), minlength=len(n))
        return row_of(s.t, KEYS, weight=weight, n=n)

    def residuals(t: pa.Table) -> pa.Table:
        d = len(draws_of(t))
        w, n = array_of(t, "weight", (d, k, N_CLASSES)), array_of(t, "n", (d, N_CLASSES))
        mean = n / n.sum(axis=1, keepdims=True)
        return row_of(t, ["first", "stop"], sums=w - w.sum(axis=2, keepdims=True) * mean[:, None])

    found = over_stems(trials, refs, labels, n_draws, cells, f"{HEAD}, weight binary, n binary")
    sums = added(found, KEY_TYPES, "weight", "n").groupBy(*KEYS).applyInArrow(residuals, "first int, stop int, sums binary")
    return sized(sums, labels, N_CLASSES)


def sized(sums: DataFrame, labels: Labels, width: int) -> DataFrame:
    """(draw, statistic) where every draw has the panels' own sizes."""
    k, sizes = len(labels.sizes), np.array(labels.sizes, float)
    part = added(sums.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16))), DRAWS | {"part": "int"}, "sums")

    def kernel(t: pa.Table) -> pa.Table:
        draws = draws_of(t)
        s = array_of(t, "sums", (len(draws), k, width))
        apart = ((s / sizes[:, None] - s.sum(axis=1, keepdims=True) / sizes.sum()) ** 2).sum(axis=2)
        return pa.table({"draw": draws.astype(np.int32), "statistic": apart @ sizes})

    return added(part, DRAWS, "sums").groupBy("first", "stop").applyInArrow(kernel, "draw int, statistic double")


class Turns:
    """Directions of trials' taps at many periods: sums of unit vectors, taken at a few frequencies and interpolated between them.

    A sum is a smooth function of the frequency.  With the middle of the taps'
    times as origin it turns by ``half`` at most within half the band of the
    frequencies, so Chebyshev points some more than that give it to rounding.
    Where there are no more periods than points these are the periods.
    """

    def __init__(self, periods: np.ndarray, taps: list[np.ndarray]):
        every = np.concatenate([*taps, np.zeros(0)])
        self.middle = (every.min() + every.max()) / 2 if len(every) else 0.0
        self.periods = np.where(np.isfinite(periods) & (periods > 0), periods, np.nan)
        known = np.unique(self.periods[np.isfinite(self.periods)])
        frequency = 1 / self.periods
        low, high = (1 / known[-1], 1 / known[0]) if len(known) else (1.0, 1.0)
        half = np.pi * (high - low) * (np.ptp(every) / 2 if len(every) else 0.0)
        n = int(half + 12 * np.cbrt(half)) + 6
        if len(known) <= n:
            self.nodes = 1 / known
            self.weights = (self.periods.reshape(-1)[:, None] == known).astype(float)
        else:
            angle = np.pi * (2 * np.arange(n) + 1) / (2 * n)
            self.nodes = (low + high) / 2 + (high - low) / 2 * np.cos(angle)
            apart = frequency.reshape(-1)[:, None] - self.nodes
            with np.errstate(divide="ignore", invalid="ignore"):
                w = (-1.0) ** np.arange(n) * np.sin(angle) / apart
                w /= w.sum(axis=1, keepdims=True)
            on = np.flatnonzero((apart == 0).any(axis=1))
            w[on] = apart[on] == 0
            self.weights = np.nan_to_num(w)
        carrier = np.exp(2j * np.pi * np.nan_to_num(self.middle * frequency))
        self.carrier = np.where(np.isfinite(self.periods), carrier, 0)

    def at_nodes(self, taps: list[np.ndarray]) -> np.ndarray:
        """Rows are trials, columns the real, then the imaginary parts."""
        out = np.zeros((len(taps), 2 * len(self.nodes)))
        n = np.array([len(t) for t in taps])
        some = np.flatnonzero(n)
        if len(some) and len(self.nodes):
            turn = 2 * np.pi * (np.concatenate(taps) - self.middle)[:, None] * self.nodes
            out[some] = np.add.reduceat(np.hstack([np.cos(turn), np.sin(turn)]), (np.cumsum(n) - n)[some], axis=0)
        return out


def taps_of(t: pa.Table) -> list[np.ndarray]:
    return [np.asarray(x or [], float) for x in t.column("taps").to_pylist()]


def phase_vectors(trials: DataFrame, refs: DataFrame, labels: Labels, n_draws: int) -> DataFrame:
    """(first, stop, sums, counts), any number of rows to a block: by panel, participants' mean residual (sin, cos) of their matched trials' phases, and how many have one.

    A phase is the direction of a trial's taps at the period of the panel's
    reference, against the mean of the other panels' unit directions.  A task
    has all trials of some participants; the stems' means, known only at the
    end, are taken off the panels' sums.
    """
    k = len(labels.sizes)

    def pooled(s: Stem, _: pa.Table) -> pa.Table:
        d = len(s.draws)
        taps = taps_of(s.t)
        turns = Turns(s.reference, taps)
        m = len(turns.nodes)
        total = np.zeros((d * k, 2 * m))
        for i in range(0, len(taps), STEP):
            label = np.ascontiguousarray(labels.of(s.place[i : i + STEP], s.draws).astype(np.int32).T)
            x = turns.at_nodes(taps[i : i + STEP])
            for j in range(0, d, STEP):
                one = (label[j : j + STEP, None] == np.arange(k, dtype=np.int32)[:, None]).astype(float)
                total[j * k : (j + STEP) * k] += one.reshape(-1, len(x)) @ x
        total = total.reshape(d, k, 2, m)
        weights = turns.weights.reshape(d, k, m).transpose(0, 2, 1)
        v = (total[:, :, 0] @ weights + 1j * (total[:, :, 1] @ weights)).transpose(0, 2, 1) * turns.carrier[..., None]
        return row_of(s.t, KEYS, pooled=np.ascontiguousarray(v).view(np.float64))

    def angles(t: pa.Table) -> pa.Table:
        d = len(draws_of(t))
        v = array_of(t, "pooled", (d, k, k, 2))
        v = v[..., 0] + 1j * v[..., 1]
        size = np.abs(v)
        unit = np.where(np.isfinite(size) & (size > 0), v / np.where(size > 0, size, 1), 0)
        unit[:, np.arange(k), np.arange(k)] = 0
        some = (unit != 0).sum(axis=2)
        return row_of(t, KEYS, angle=np.where(some > 0, np.angle(unit.sum(axis=2)), np.nan))

    def matched(own: pa.Table, row: pa.Table, place: np.ndarray, draws: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For some places at a time those that have a trial of the stem, (sin, cos) and whether it counts, over draws."""
        reference, angle = (array_of(row, c, (len(draws), k)) for c in ("reference", "angle"))
        at, period, taps = own.column("place").to_numpy(), floats(own, "period_us"), taps_of(own)
        turns, column = Turns(reference, taps), np.arange(len(draws))
        back = np.where(np.isfinite(angle), turns.carrier * np.exp(-1j * np.nan_to_num(angle)), 0)
        m = len(turns.nodes)
        weights = np.ascontiguousarray(turns.weights.T)
        for i in range(0, len(place), STEP):
            mine = np.flatnonzero(np.isin(at, place[i : i + STEP]))
            mine = mine[np.argsort(at[mine])]
            label = labels.of(at[mine], draws)
            cell = column * k + label
            x = turns.at_nodes([taps[j] for j in mine])
            z = np.empty(cell.shape, complex)
            for j in range(0, len(draws), STEP):  # of the panels' columns each draw's own is taken
                some = cell[:, j : j + STEP] - j * k
                of = weights[:, j * k : (j + STEP) * k]
                z.real[:, j : j + STEP], z.imag[:, j : j + STEP] = (np.take_along_axis(y @ of, some, axis=1) for y in (x[:, :m], x[:, m:]))
            size = np.abs(z)
            ok = (class_of(period[mine, None] / reference.reshape(-1)[cell]) == MATCHED) & np.isfinite(angle.reshape(-1)[cell]) & (size > 0)
            u = np.where(ok, z * back.reshape(-1)[cell] / np.where(size > 0, size, 1), 0)
            yield np.isin(place[i : i + STEP], at[mine]), np.stack([u.imag, u.real]), ok

    def people(t: pa.Table, r: pa.Table) -> pa.Table:
        if not t.num_rows or not r.num_rows:
            return schema.empty_table()
        draws = draws_of(t)
        d, names = len(draws), r.column("stem_id").to_pylist()
        place, stem = np.unique(t.column("place").to_numpy()), np.array(t.column("stem_id").to_pylist())
        parts = [matched(t.filter(pa.array(stem == n)), r.slice(j, 1), place, draws) for j, n in enumerate(names)]
        sums, counts = np.zeros((2, d * k)), np.zeros(d * k)
        total, n, shares = np.zeros((len(names), 2, d)), np.zeros((len(names), d)), np.zeros((len(names), d * k))
        for i, found in enumerate(zip(*parts, strict=True)):
            at = (labels.of(place[i * STEP : (i + 1) * STEP], draws) + np.arange(d) * k)
            own, of = np.zeros((2, *at.shape)), np.zeros(at.shape)
            for has, v, ok in found:
                own[:, has] += v
                of[has] += ok
            share = 1 / np.maximum(of, 1)
            for c in (0, 1):
                sums[c] += np.bincount(at.ravel(), (own[c] * share).ravel(), d * k)
            counts += np.bincount(at.ravel(), (of > 0).ravel(), d * k)
            for j, (has, v, ok) in enumerate(found):
                total[j] += v.sum(axis=1)
                n[j] += ok.sum(axis=0)
                shares[j] += np.bincount(at[has].ravel(), (ok * share[has]).ravel(), d * k)
        out = [("", sums.T, counts, np.zeros(0), np.zeros(0)), *((s, np.zeros(0), shares[j], total[j], n[j]) for j, s in enumerate(names))]
        head = [pa.array([t.column(c)[0].as_py()] * len(out), pa.int32()) for c in DRAWS]
        return pa.table([pa.array([i > 0 for i in range(len(out))]), pa.array([o[0] for o in out]), *head, *(pa.array([np.ascontiguousarray(o[c]).tobytes() for o in out], pa.binary()) for c in range(1, 5))], schema=schema)

    def off(t: pa.Table) -> pa.Table:
        """What the stem's mean takes off the panels' sums."""
        d = len(draws_of(t))
        mean = array_of(t, "total", (2, d)) / np.maximum(array_of(t, "n", (d,)), 1)
        return row_of(t, ["first", "stop"], sums=-array_of(t, "counts", (d, k))[..., None] * mean.T[:, None], counts=np.zeros((d, k)))

    all_of = added(over_stems(trials, refs, labels, n_draws, pooled, f"{HEAD}, pooled binary"), KEY_TYPES, "pooled")
    refs = durable(refs.join(all_of.groupBy(*KEYS).applyInArrow(angles, f"{HEAD}, angle binary"), KEYS))
    layout = "of_stem boolean, stem_id string, first int, stop int, sums binary, counts binary, total binary, n binary"
    schema = to_arrow_schema(_parse_datatype_string(layout))
    shards = max(1, -(-sum(labels.sizes) // PEOPLE))
    dealt = in_blocks(trials.withColumn("shard", F.pmod("place", F.lit(shards)).cast("int")), n_draws)
    spread_refs = refs.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    keys = ["first", "stop", "shard"]
    found = durable(shared_out(dealt, keys).groupBy(*keys).cogroup(shared_out(spread_refs, keys).groupBy(*keys)).applyInArrow(people, layout))
    means = added(found.where("of_stem"), KEY_TYPES, "counts", "total", "n").groupBy(*KEYS).applyInArrow(off, "first int, stop int, sums binary, counts binary")
    return found.where("not of_stem").select(*DRAWS, "sums", "counts").unionAll(means)


def phase_statistics(people: DataFrame, labels: Labels) -> DataFrame:
    """(draw, statistic) of participants' mean residual (sin, cos), over those who have one; people: rows of ``phase_vectors``."""
    return statistics(people, len(labels.sizes), 2)


def rebuilt_permutation(trials: DataFrame, permutations: int, seed: int) -> DataFrame:
    """Panel labels of participants permuted, and everything that depends on them rebuilt each time: references, classes, phases, residuals.

    trials: stem_id, participant, panel (one for each participant), period_us
    (may be null) and taps_us, one row for each stem and participant.  Rows:
    outcome (metrical_choice, circular_phase), observed, permutations, p.
    """
    spark = trials.sparkSession
    people, names, sizes = placed(trials, "participant", "panel")
    if not names:
        return spark.createDataFrame([], "outcome string, observed double, permutations long, p double")
    labels = Labels(sizes, seed)
    share = trials.groupBy("participant").agg((1.0 / F.count("*")).alias("weight"))
    rows = trials.join(people.select("participant", "place"), "participant").join(share, "participant").select(F.col("stem_id").cast("string").alias("stem_id"), "place", F.col("period_us").cast("double").alias("period_us"), "weight", F.col("taps_us").alias("taps"))
    rows = durable(rows)
    refs = durable(reference_periods(rows, labels, permutations))
    a = p_value(metrical_statistics(rows.drop("taps"), refs, labels, permutations)).select(F.lit("metrical_choice").alias("outcome"), "*")
    b = p_value(phase_statistics(phase_vectors(rows, refs, labels, permutations), labels)).select(F.lit("circular_phase").alias("outcome"), "*")
    return a.unionAll(b)
