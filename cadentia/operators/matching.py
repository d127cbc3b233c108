"""Nearest-event joins and what is scored from them.

Neither a range join nor a cross join: both sides are united and a window
carries the last event of the other side forward and the next one back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ratio_class
from .durable import durable

#: Rows whose sets of beats a kernel works on at once.
SETS = 1_000


def nearest(events: DataFrame, beats: DataFrame, keys: list[str], start_us: int = 0, stop_us: int = 30_000_000, slice_us: int = 2_000_000) -> DataFrame:
    """Each event (``t_us``) with its nearest beat and the signed distance ``off_us``; ties take the earlier beat.

    events keep their columns; beats: keys and ``beat_us``.  Time is cut into
    slices, so that a key's events are not one task's; what lies beyond start
    and stop goes with the first and the last slice.  A beat stands in each
    slice from its predecessor's to its successor's, so every event meets both
    its neighbours.  Two running frames, forward and back, carry them.
    """
    extra = [c for c in events.columns if c not in (*keys, "t_us")]
    at = lambda t: F.floor(F.greatest(F.lit(start_us), F.least(F.lit(stop_us), t)) / slice_us)
    order = Window.partitionBy(*keys).orderBy("beat_us")
    first, last = at(F.coalesce(F.lag("beat_us").over(order), F.lit(start_us))), at(F.coalesce(F.lead("beat_us").over(order), F.lit(stop_us)))
    placed = beats.select(*keys, F.col("beat_us").alias("t_us"), F.col("beat_us").alias("beat"), first.alias("first"), last.alias("last"))
    dealt = placed.withColumn("slice", F.explode(F.sequence("first", "last"))).drop("first", "last")
    u = events.select(*keys, "t_us", F.lit(None).cast(beats.schema["beat_us"].dataType).alias("beat"), at(F.col("t_us")).alias("slice"), *extra).unionByName(dealt, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "slice")
    before = F.max("beat").over(w.orderBy("t_us").rangeBetween(Window.unboundedPreceding, 0))
    after = F.min("beat").over(w.orderBy(F.desc("t_us")).rangeBetween(Window.unboundedPreceding, 0))
    u = u.withColumns({"before": before, "after": after}).where("beat is null")
    pick = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull() | (F.col("t_us") - F.col("before") <= F.col("after") - F.col("t_us")), F.col("before")).otherwise(F.col("after"))
    return u.withColumn("nearest_us", pick).withColumn("off_us", F.col("t_us") - F.col("nearest_us")).select(*keys, "t_us", *extra, "nearest_us", "off_us")


def hit_rates(events: DataFrame, beats: DataFrame, keys: list[str], tolerance_us: int, by: list[str]) -> DataFrame:
    """Hits within the tolerance, rate, mean and deviation of the asynchrony (0 for a single hit) per ``by``."""
    n = nearest(events, beats, keys)
    hit = F.coalesce(F.abs("off_us") <= tolerance_us, F.lit(False))
    off = F.when(hit, F.col("off_us"))
    return n.groupBy(*by).agg(F.count("*").alias("n_taps"), F.count_if(hit).alias("n_hits"), F.avg(off).alias("mean_off_us"), F.when(F.count_if(hit) == 1, F.lit(0.0)).otherwise(F.stddev_samp(off)).alias("sd_off_us"))


def alignment(events: DataFrame, beats: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """Pooled over a stem: hit share, signed and absolute mean, median, sample deviation and root mean square of the distance."""
    n = nearest(events, beats, keys)
    d = F.col("off_us")
    return n.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.abs(d) <= tolerance_us, 1.0).otherwise(0.0)).alias("hit_rate"),
        F.avg(d).alias("mean_us"),
        F.avg(F.abs(d)).alias("mean_abs_us"),
        F.median(F.abs(d)).alias("median_abs_us"),
        F.stddev_samp(d).alias("sd_us"),
        F.sqrt(F.avg(d.cast("double") * d.cast("double"))).alias("rms_us"),
    )


def f_measure(predicted: DataFrame, reference: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """Precision, recall and F of two beat sets, nearest and not exclusive; null where a side is empty.

    predicted and reference: keys and ``beat_us``.
    """
    as_events = lambda x: x.select(*keys, F.col("beat_us").alias("t_us"))
    share = lambda a, b, name: nearest(as_events(a), b, keys).groupBy(*keys).agg(F.count("*").alias(f"n_{name}"), F.count_if(F.abs("off_us") <= tolerance_us).alias(f"hit_{name}"))
    m = share(predicted, reference, "predicted").join(share(reference, predicted, "reference"), keys)
    p, r = F.col("hit_predicted") / F.col("n_predicted"), F.col("hit_reference") / F.col("n_reference")
    return m.select(*keys, "n_predicted", "n_reference", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f"))


def verified_peaks(computed: DataFrame, released: DataFrame, keys: list[str], same_us: int = 1_000, step_us: int = 5_100) -> DataFrame:
    """How each key's computed peaks agree with released ones, place by place: n_computed, n_released, worst_us and outcome.

    equal: as many, none farther than ``same_us``; one_step: none farther than
    ``step_us``; else differing, as is a key that was not released.  Keys that
    were not computed have no row.  computed and released: keys and ``tap_us``.
    """
    w = Window.partitionBy(*keys).orderBy("tap_us")
    a, b = (d.select(*keys, F.row_number().over(w).alias("place"), F.col("tap_us").alias(n)) for d, n in ((computed, "a_us"), (released, "b_us")))
    by = a.join(b, [*keys, "place"], "full").groupBy(*keys).agg(F.count("a_us").alias("n_computed"), F.count("b_us").alias("n_released"), F.max(F.abs(F.col("a_us") - F.col("b_us"))).alias("worst_us"))
    like = F.col("n_computed") == F.col("n_released")
    outcome = F.when(like & (F.col("worst_us") <= same_us), "equal").when(like & (F.col("worst_us") <= step_us), "one_step").otherwise("differing")
    return by.where("n_computed > 0").withColumn("outcome", outcome)


def stage_alignments(raw: DataFrame, clean: DataFrame, beats: DataFrame, peaks_of, tolerance_us: int = 70_000) -> DataFrame:
    """Alignment with the reference at the six stages from taps to peaks: stem_id, stage and what ``alignment`` tells.

    raw and clean: stem_id and ``tap_us`` of pooled taps.  Stages: both pools,
    the peaks of either, and the peaks of either pool's taps that hit a beat.
    ``peaks_of`` gives (stem_id, tap_us) of the peaks of pools named by stem_id.
    """
    pools = raw.select(F.lit("raw").alias("pool"), "stem_id", "tap_us").unionAll(clean.select(F.lit("clean"), "stem_id", "tap_us"))
    near = nearest(pools.withColumnRenamed("tap_us", "t_us"), beats, ["stem_id"])
    hits = near.where(F.abs("off_us") <= tolerance_us).select(F.concat(F.lit("hits_"), "pool").alias("pool"), "stem_id", F.col("t_us").alias("tap_us"))
    sets = pools.unionAll(hits).select(F.concat_ws("\u001f", "pool", "stem_id").alias("stem_id"), "tap_us")
    name = F.split("stem_id", "\u001f")
    peaks = peaks_of(sets).select(name[0].alias("pool"), name[1].alias("stem_id"), "tap_us")
    events = pools.select(F.concat_ws("_", F.lit("pooled"), "pool", F.lit("taps")).alias("stage"), "stem_id", F.col("tap_us").alias("t_us"))
    events = events.unionAll(peaks.select(F.concat(F.lit("peaks_from_"), "pool"), "stem_id", "tap_us"))
    keyed = beats.select("stem_id", "beat_us").join(events.select("stem_id", "stage").distinct(), "stem_id")
    return alignment(events, keyed, ["stem_id", "stage"], tolerance_us)


def middle_intervals(beats: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Median interval between neighbouring beats, null for a single one."""
    gap = F.col("beat_us") - F.lag("beat_us").over(Window.partitionBy(*keys).orderBy("beat_us"))
    return beats.select(*keys, gap.alias("gap")).groupBy(*keys).agg(F.median("gap").alias(name))


def best_shift(predicted: DataFrame, reference: DataFrame, keys: list[str], tolerance_us: int = 70_000, reach_us: int = 250_000, step_us: int = 5_000, most_ratio: float = 1.1) -> DataFrame:
    """The shift of the prediction at which most reference beats have one within the tolerance; of equals the smallest.

    No shift (0, and no hits) where a side has one beat, or where the median
    intervals differ by more than ``most_ratio``; the smallest of all where no
    shift hits.  A pair of beats names its shifts by arithmetic, and only
    beats of neighbouring slices of time are paired.
    """
    width, most = reach_us + tolerance_us, reach_us // step_us
    a = reference.select(*keys, F.col("beat_us").alias("t"), F.floor(F.col("beat_us") / width).alias("slice"))
    b = predicted.select(*keys, F.col("beat_us").alias("p"), F.floor(F.col("beat_us") / width).alias("own"))
    b = b.withColumn("slice", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    first = F.greatest(F.lit(-most), F.ceil((F.col("t") - tolerance_us - F.col("p")) / step_us))
    last = F.least(F.lit(most), F.floor((F.col("t") + tolerance_us - F.col("p")) / step_us))
    near = a.join(b, [*keys, "slice"]).select(*keys, "t", first.alias("first"), last.alias("last")).where("first <= last")
    hits = near.select(*keys, "t", F.explode(F.sequence("first", "last")).alias("n")).distinct().groupBy(*keys, "n").agg(F.count("*").alias("hits"))
    top = hits.groupBy(*keys).agg(F.max(F.struct("hits", (-F.col("n")).alias("back"))).alias("top"))
    own = middle_intervals(predicted, keys, "own").join(middle_intervals(reference, keys, "other"), keys)
    like = F.coalesce((F.col("own") > 0) & (F.col("other") > 0) & (F.greatest("own", "other") / F.least("own", "other") <= most_ratio), F.lit(False))
    shift = F.when(~like, 0).otherwise(F.coalesce(-F.col("top.back") * step_us, F.lit(-most * step_us))).cast("int")
    return own.join(top, keys, "left").select(*keys, shift.alias("shift_us"), F.when(like, F.coalesce("top.hits", F.lit(0))).otherwise(0).cast("long").alias("hits"))


def phase_aligned_f(predicted: DataFrame, reference: DataFrame, keys: list[str], tolerance_us: int = 70_000) -> DataFrame:
    """F before and after the best shift."""
    shift = best_shift(predicted, reference, keys, tolerance_us).select(*keys, "shift_us")
    moved = predicted.join(shift, keys).select(*keys, (F.col("beat_us") + F.col("shift_us")).alias("beat_us"))
    before, after = (f_measure(x, reference, keys, tolerance_us).select(*keys, F.col("f").alias(n)) for x, n in ((predicted, "f"), (moved, "f_aligned")))
    return before.join(after, keys).join(shift, keys)


def near_pairs(a: DataFrame, b: DataFrame, keys: list[str], tolerance_us: int) -> DataFrame:
    """All (keys, a_us, b_us) within the tolerance; a and b: keys and ``beat_us``.  Slices as wide as the tolerance meet their neighbours."""
    width = max(tolerance_us, 1)
    x = a.select(*keys, F.col("beat_us").alias("a_us"), F.floor(F.col("beat_us") / width).alias("slice"))
    y = b.select(*keys, F.col("beat_us").alias("b_us"), F.floor(F.col("beat_us") / width).alias("own"))
    y = y.withColumn("slice", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    return x.join(y, [*keys, "slice"]).where(F.abs(F.col("a_us") - F.col("b_us")) <= tolerance_us).drop("slice")


def greedy_pairs(a: DataFrame, b: DataFrame, keys: list[str], tolerance_us: int = 70_000) -> DataFrame:
    """One-to-one pairs by growing distance, then the earlier a, then the earlier b: (keys, a_us, b_us).

    What taking the nearest pair of all again and again would find is found
    in rounds: a pair that comes first for both its beats is taken, wherever
    else pairs are left, and the pairs of taken beats go.  Beats of one side
    are distinct times.
    """
    order = F.struct(F.abs(F.col("a_us") - F.col("b_us")).alias("d"), "a_us", "b_us")
    left = durable(near_pairs(a, b, keys, tolerance_us).withColumn("order", order))
    taken = None
    while True:
        first = [F.min("order").over(Window.partitionBy(*keys, c)) for c in ("a_us", "b_us")]
        now = durable(left.withColumns({"first_a": first[0], "first_b": first[1]}).where((F.col("order") == F.col("first_a")) & (F.col("order") == F.col("first_b"))).select(*keys, "a_us", "b_us"))
        taken = now if taken is None else taken.unionAll(now)
        if now.isEmpty():
            return taken
        left = durable(left.join(now.select(*keys, "a_us"), [*keys, "a_us"], "left_anti").join(now.select(*keys, "b_us"), [*keys, "b_us"], "left_anti"))


def maximum_matching(a: DataFrame, b: DataFrame, keys: list[str], tolerance_us: int = 70_000) -> DataFrame:
    """Sizes per key: n_a, n_b and n_maximum, the most one-to-one pairs within the tolerance.

    A sweep over time matches each beat with the earliest one of the other
    side that still waits.  Where no beat of either side comes for longer than
    the tolerance nothing waits, so runs between such gaps are swept apart.
    """
    u = a.select(*keys, "beat_us", F.lit(0).alias("side")).unionAll(b.select(*keys, "beat_us", F.lit(1).alias("side")))
    w = Window.partitionBy(*keys).orderBy("beat_us", "side")
    gap = F.coalesce(F.col("beat_us") - F.lag("beat_us").over(w) > tolerance_us, F.lit(True))
    runs = u.withColumn("gap", gap).withColumn("run", F.sum(F.col("gap").cast("int")).over(w))
    events = runs.groupBy(*keys, "run").agg(F.count_if(F.col("side") == 0).alias("n_a"), F.count_if(F.col("side") == 1).alias("n_b"), F.array_sort(F.collect_list(F.struct("beat_us", "side"))).alias("events"))
    state = lambda n, side, waits: F.struct(n.cast("long").alias("n"), side.cast("int").alias("side"), waits.alias("waits"))

    def step(acc, e):
        waits = F.filter(acc["waits"], lambda t: t >= e["beat_us"] - tolerance_us)
        match = (acc["side"] != e["side"]) & (F.size(waits) > 0)
        kept = F.when(acc["side"] == e["side"], F.concat(waits, F.array(e["beat_us"]))).when(match, F.slice(waits, 2, F.greatest(F.size(waits) - 1, F.lit(0)))).otherwise(F.array(e["beat_us"]))
        return state(acc["n"] + match.cast("long"), F.when(match, acc["side"]).otherwise(e["side"]), kept)

    none = F.array().cast(f"array<{dict(u.dtypes)['beat_us']}>")
    swept = events.withColumn("_matched", F.aggregate("events", state(F.lit(0), F.lit(0), none), step)["n"])
    return swept.groupBy(*keys).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.sum("_matched").alias("n_maximum"))


def matchings(reference: DataFrame, estimate: DataFrame, keys: list[str], tolerance_us: int = 70_000) -> DataFrame:
    """Sizes of the greedy and of the maximum matching, F by the latter, and the greedy pairs' median offset, for keys with beats on either side."""
    g = greedy_pairs(reference, estimate, keys, tolerance_us).groupBy(*keys).agg(F.count("*").alias("n_greedy"), (F.median(F.col("b_us") - F.col("a_us")) / 1_000_000).alias("median_offset_s"))
    m = maximum_matching(reference, estimate, keys, tolerance_us)
    f = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), 2 * F.col("n_maximum") / (F.col("n_a") + F.col("n_b"))).otherwise(0.0)
    return m.join(g, keys, "left").select(*keys, F.coalesce("n_greedy", F.lit(0)).alias("n_greedy"), "n_maximum", f.alias("f_maximum"), "median_offset_s")


def compared_grids(reference: DataFrame, estimate: DataFrame, keys: list[str], start_us: int = 10_000_000, stop_us: int = 25_000_000, tolerance_us: int = 70_000) -> DataFrame:
    """Two grids of each key within a window: F by the maximum matching, median intervals, their ratio and class, circular phase, greedy pairs' median distance.

    F is null where a side is empty; the phase, in cycles of the reference, is
    that of grids of one rate alone.  A key of one side has a row too.
    """
    inside = F.col("beat_us").between(start_us, stop_us)
    x, y = (d.where(inside).select(*keys, "beat_us") for d in (reference, estimate))
    every = reference.select(*keys).unionAll(estimate.select(*keys)).distinct()
    f = maximum_matching(x, y, keys, tolerance_us).select(*keys, F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), 2 * F.col("n_maximum") / (F.col("n_a") + F.col("n_b"))).alias("f"))
    p, q = (middle_intervals(d, keys, n) for d, n in ((x, "p"), (y, "q")))
    g = greedy_pairs(x, y, keys, tolerance_us).groupBy(*keys).agg((F.median(F.abs(F.col("b_us") - F.col("a_us"))) / 1000).alias("median_abs_offset_ms"))
    ratio = F.when(F.col("p") > 0, F.col("q") / F.col("p"))
    out = every.join(p, keys, "left").join(q, keys, "left").join(f, keys, "left").join(g, keys, "left").withColumns({"ratio": ratio, "relation": ratio_class(ratio)})
    turn = 2 * 3.141592653589793 * F.col("off_us") / F.col("p")
    near = nearest(y.select(*keys, F.col("beat_us").alias("t_us")), x, keys).join(out.where("relation = 'matched'").select(*keys, "p"), keys)
    phase = near.groupBy(*keys).agg((F.atan2(F.avg(F.sin(turn)), F.avg(F.cos(turn))) / (2 * 3.141592653589793)).alias("phase_offset"))
    return out.join(phase, keys, "left").select(*keys, "f", (F.col("p") / 1e6).alias("reference_period_s"), (F.col("q") / 1e6).alias("estimate_period_s"), "ratio", "relation", "phase_offset", "median_abs_offset_ms")


class Sets:
    """Two sorted sets of whole numbers for each row, ``a`` and ``b``, laid end to end."""

    def __init__(self, a: pa.ListArray, b: pa.ListArray):
        self.n = len(a)
        self.sizes = [pc.list_value_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
        self.row = [np.repeat(np.arange(self.n), k) for k in self.sizes]
        self.value = [pc.list_flatten(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
        self.start = [np.cumsum(k) - k for k in self.sizes]

    def place(self, side: int, row: np.ndarray, t: np.ndarray, how: str) -> np.ndarray:
        """Where t belongs in the row's set of ``side``; rows are kept apart by more than any value's reach."""
        own = self.value[side]
        low = min(own.min(initial=0), t.min(initial=0))
        span = max(own.max(initial=0), t.max(initial=0)) - low + 1
        return np.searchsorted(self.row[side] * span + (own - low), row * span + (t - low), side=how)

    def distance(self, side: int, row: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Of t to the nearest of the row's set of ``side``, which is not empty."""
        after = self.place(side, row, t, "left")
        first, own = self.start[side][row], self.value[side]
        last = first + self.sizes[side][row] - 1
        return np.minimum(abs(t - own[np.clip(after, first, last)]), abs(t - own[np.clip(after - 1, first, last)]))

    def share(self, near: np.ndarray, side: int) -> np.ndarray:
        """Share of each row's set of ``side`` that is near."""
        return np.bincount(self.row[side], near, self.n) / self.sizes[side]

    def middle(self, row: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Median of each row's values."""
        n = np.bincount(row, minlength=self.n)
        v, start = v[np.lexsort((v, row))], np.cumsum(n) - n
        out = np.full(self.n, np.nan)
        some = n > 0
        out[some] = (v[(start + (n - 1) // 2)[some]] + v[(start + n // 2)[some]]) / 2
        return out

    def interval(self, side: int) -> np.ndarray:
        same = self.row[side][1:] == self.row[side][:-1]
        return self.middle(self.row[side][1:][same], np.diff(self.value[side])[same])

    def shift(self, tolerance: int, reach: int, step: int, most_ratio: float) -> np.ndarray:
        """``best_shift`` of a to b.  The shifts that bring a value of a to one of b are a run; a later value's run starts lower, so it adds what lies under the run before."""
        most = reach // step
        row, t = self.row[1], self.value[1]
        low, high = self.place(0, row, t - reach - tolerance, "left"), self.place(0, row, t + reach + tolerance, "right")
        n = high - low
        of = np.repeat(np.arange(len(t)), n)
        at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        apart = t[of] - self.value[0][at]
        first, last = np.maximum(-most, -((tolerance - apart) // step)), np.minimum(most, (apart + tolerance) // step)
        again = np.flatnonzero(of[1:] == of[:-1]) + 1
        last[again] = np.minimum(last[again], first[again - 1] - 1)
        ok, width = first <= last, 2 * most + 2
        cell = row[of[ok]] * width + most
        ends = np.bincount(cell + first[ok], minlength=self.n * width) - np.bincount(cell + last[ok] + 1, minlength=self.n * width)
        best = (np.cumsum(ends.reshape(self.n, width), axis=1)[:, :-1].argmax(axis=1) - most) * step
        x, y = self.interval(0), self.interval(1)
        like = (x > 0) & (y > 0)
        like[like] = np.maximum(x, y)[like] / np.minimum(x, y)[like] <= most_ratio
        return np.where(like, best, 0)


def variant_metrics(beats: DataFrame, reference: DataFrame, tolerance_us: int = 70_000, wide_us: int = 120_000, reach_us: int = 250_000, step_us: int = 5_000, most_ratio: float = 1.1) -> DataFrame:
    """Each variant of each stem's beats against its reference: a row for each variant and stem.

    beats: variant, stem_id, beat_us; reference: stem_id, beat_us.  F at both
    tolerances, F after the best shift and that shift, the median distance of
    the reference beats that are hit, and how many beats lie in 30 s and in its
    middle.  Stems without a reference have no row.  A row carries a variant's
    and its stem's beats, so they are shuffled once for all metrics, and not
    at all where they lie by stem already.
    """
    sets = lambda d, name, *keys: d.where("beat_us is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.col("beat_us").cast("long"))).alias(name))
    rows = sets(beats, "own", "stem_id", "variant").join(sets(reference, "ref", "stem_id"), "stem_id").select("variant", "stem_id", "own", "ref")
    metrics = {"f": "double", "f_wide": "double", "f_aligned": "double", "shift_ms": "double", "median_off_ms": "double", "n_30s": "bigint", "n_10_25": "bigint"}

    def f_of(s: Sets, a: np.ndarray, b: np.ndarray, within: int) -> np.ndarray:
        p, r = s.share(a <= within, 0), s.share(b <= within, 1)
        return np.where(p + r > 0, 2 * p * r / np.where(p + r > 0, p + r, 1), 0.0)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SETS):
                b = batch.slice(i, SETS)
                s = Sets(b.column("own"), b.column("ref"))
                own, ref = s.value
                to_ref, to_own = s.distance(1, s.row[0], own), s.distance(0, s.row[1], ref)
                shift = s.shift(tolerance_us, reach_us, step_us, most_ratio)
                moved, met = s.distance(1, s.row[0], own + shift[s.row[0]]), s.distance(0, s.row[1], ref - shift[s.row[1]])
                hit = to_own <= tolerance_us
                off = s.middle(s.row[1][hit], to_own[hit]) / 1000
                inside = lambda low, high: pa.array(np.bincount(s.row[0][(own >= low) & (own <= high)], minlength=s.n))  # noqa: B023, E731
                out = [pa.array(x) for x in (f_of(s, to_ref, to_own, tolerance_us), f_of(s, to_ref, to_own, wide_us), f_of(s, moved, met, tolerance_us), shift / 1000)]
                yield pa.RecordBatch.from_arrays([b.column("variant"), b.column("stem_id"), *out, pa.array(off, mask=np.isnan(off)), inside(0, 30_000_000), inside(10_000_000, 25_000_000)], names=["variant", "stem_id", *metrics])

    return rows.mapInArrow(kernel, ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes[:2], *metrics.items()]))


def by_corpus(metrics: DataFrame, corpora: DataFrame, metric: str = "f") -> DataFrame:
    """Mean and median of a metric for each corpus and variant; corpora: stem_id, corpus."""
    return metrics.join(corpora, "stem_id").groupBy("corpus", "variant").agg(F.count(metric).alias("n_stems"), F.avg(metric).alias(f"mean_{metric}"), F.median(metric).alias(f"median_{metric}"))


def against_baselines(metrics: DataFrame, variant: str, metric: str = "f") -> DataFrame:
    """(baseline, stem_id, difference) of one variant's metric less each other's, over stems that have both."""
    one = metrics.where(F.col("variant") == variant).select("stem_id", F.col(metric).alias("_own"))
    return metrics.where(F.col("variant") != variant).join(one, "stem_id").select(F.col("variant").alias("baseline"), "stem_id", (F.col("_own") - F.col(metric)).alias("difference")).where("difference is not null")
