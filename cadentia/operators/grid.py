"""Periodic grids over events: scoring, refinement, repair, and runs of steady intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Stems whose peaks a kernel works on at once.
STEMS = 500


def grid_points(params: DataFrame, start_us: int = 0, stop_us: int = 30 * SECOND) -> DataFrame:
    """phi + k * T within the window, for rows with ``period_us`` and ``phase_us``."""
    k0 = F.ceil((start_us - F.col("phase_us")) / F.col("period_us").cast("double"))
    k1 = F.floor((stop_us - F.col("phase_us")) / F.col("period_us").cast("double"))
    return params.withColumn("k", F.explode(F.sequence(k0, k1))).withColumn("beat_us", F.col("phase_us") + F.col("k") * F.col("period_us"))


def stems_of(peaks: DataFrame) -> DataFrame:
    """(stem_id, taps): a row for each stem with its peaks; no shuffle where they lie by stem already."""
    return peaks.where("tap_us is not null").groupBy("stem_id").agg(F.collect_list(F.col("tap_us").cast("long")).alias("taps"))


def some_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows of ``stems_of`` at a time, and each peak's row and time."""
    for batch in batches:
        for i in range(0, batch.num_rows, STEMS):
            b = batch.slice(i, STEMS)
            taps = b.column("taps")
            n = pc.list_value_length(taps).to_numpy(zero_copy_only=False)
            yield b, np.repeat(np.arange(len(n)), n), pc.list_flatten(taps).to_numpy(zero_copy_only=False)


def grid_scores(peaks: DataFrame, first_us: int, step_us: int, n_periods: int, n_phases: int, stop_us: int = 30 * SECOND, curve: DataFrame | None = None, curve_step_us: int = 5_000, peak_weight: float = 0.5, counted: int = 0) -> DataFrame:
    """For each stem, period and phase (a share j of n of the period, rounded down) the share of the stem's peaks within 0.12 T + 20 ms of the grid; the nearest point comes by arithmetic.

    With a ``curve`` (stem_id, g from 0 on, y) also the mean of the scaled curve on the
    grid's points, and the score: that mean and ``peak_weight`` of the share,
    or -1 where there are less than two points.  With ``counted`` the curve is
    the stem's peaks in each of so many steps.  A stem is one row until its
    grids are written out.
    """
    rows, types = stems_of(peaks), dict(peaks.dtypes)
    if curve is not None:
        rows = rows.join(curve.where("g >= 0").groupBy("stem_id").agg(F.collect_list(F.struct(F.col("g").cast("long").alias("g"), F.col("y").cast("double").alias("y"))).alias("curve")), "stem_id")
    given = curve is not None
    dense = given or counted > 0
    grids = [(t, t * j // n_phases) for t in range(first_us, first_us + step_us * n_periods, step_us) for j in range(n_phases)]

    def curves(b: pa.RecordBatch, row: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled curves, a row for each stem, and where each ends."""
        if not given:
            g = x // curve_step_us
            ok = (g >= 0) & (g < counted)
            y = np.bincount(row[ok] * counted + g[ok], minlength=b.num_rows * counted).reshape(-1, counted).astype(float)
            ends = np.full(b.num_rows, counted)
        else:
            c = b.column("curve")
            n, flat = pc.list_value_length(c).to_numpy(zero_copy_only=False), pc.list_flatten(c)
            of, g = np.repeat(np.arange(len(n)), n), flat.field("g").to_numpy()
            ends = np.zeros(len(n), np.int64)
            np.maximum.at(ends, of, g + 1)
            y = np.zeros((len(n), ends.max(initial=1)))
            y[of, g] = flat.field("y").to_numpy(zero_copy_only=False)
        return y / (y.max(axis=1, keepdims=True) + 1e-12), ends

    def density(y: np.ndarray, ends: np.ndarray, t: int, phi: int) -> tuple[np.ndarray, int]:
        points = np.arange(phi % t, stop_us + 1, t)
        g, part = points // curve_step_us, points % curve_step_us / curve_step_us
        at, after = (np.minimum(i, y.shape[1] - 1) for i in (g, g + 1))
        inside = np.where(part == 0, g, g + 1) < ends[:, None]
        value = np.where(inside, y[:, at] + (y[:, after] - y[:, at]) * part, 0.0)
        return value.sum(axis=1) / max(len(points), 1), len(points)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, x in some_stems(batches):
            n = np.bincount(row, minlength=b.num_rows)
            y = curves(b, row, x) if dense else None
            for t, phi in grids:
                k = np.clip(np.rint((x - phi) / t), -(phi // t), (stop_us - phi) // t).astype(np.int64)
                near = np.bincount(row, abs(x - (phi + k * t)) <= 0.12 * t + 20_000, b.num_rows).astype(np.int64)
                out = {"stem_id": b.column("stem_id"), "period_us": np.full(len(n), t), "phase_us": np.full(len(n), phi), "n": n, "n_near": near, "coverage": near / n}
                if dense:
                    mean, points = density(*y, t, phi)
                    out |= {"density": mean, "score": mean + peak_weight * (near / n) if points >= 2 else np.full(len(n), -1.0)}
                yield pa.RecordBatch.from_pydict(out)

    return rows.mapInArrow(kernel, f"stem_id {types['stem_id']}, period_us long, phase_us long, n long, n_near long, coverage double" + (", density double, score double" if dense else ""))


def coverage_search(peaks: DataFrame, first_us: int = 280_000, step_us: int = 8_151, n_periods: int = 120, n_phases: int = 240, stop_us: int = 30 * SECOND) -> DataFrame:
    """The grid that has most of a stem's peaks within 0.12 T + 20 ms of a point of the window: stem_id, period_us, phase (of n_phases), n_near.

    Of equals the first period, then the first phase.  A peak is near a run of
    phases, whose ends come by arithmetic, and a running sum over the ends
    counts the peaks of every phase.  A stem is one row, so what is shuffled
    are its peaks.  Phases are exact shares of the period, and all comparisons
    are between integers.
    """
    n = n_phases

    def counts(row: np.ndarray, x: np.ndarray, stems: int, t: int) -> np.ndarray:
        """Peaks near the grid, by stem and phase."""
        reach = 12 * t + 2_000_000  # 100 times the tolerance
        ok = 100 * x + reach >= 0
        row, x = row[ok], x[ok]
        low, high = (np.maximum(0, (100 * x + d) // (100 * t)) for d in (-reach, reach))
        ends = np.zeros(stems * (n + 1), np.int64)
        for i in range(int((high - low).max(initial=-1)) + 1):
            k = low + i
            start = 100 * (x - k * t)
            first = np.maximum(0, -(n * (reach - start) // (100 * t)))  # the least j with 100 * t * j >= n * (start - reach)
            last = np.minimum(np.minimum(n * (start + reach) // (100 * t), n * (stop_us - k * t) // t), n - 1)
            some = (k <= high) & (first <= last)
            at = row[some] * (n + 1)
            ends += np.bincount(at + first[some], minlength=len(ends)) - np.bincount(at + last[some] + 1, minlength=len(ends))
        return np.cumsum(ends.reshape(stems, n + 1), axis=1)[:, :n]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, row, x in some_stems(batches):
            best = np.stack([np.full(b.num_rows, v) for v in (-1, 0, 0)])
            for t in range(first_us, first_us + step_us * n_periods, step_us):
                near = counts(row, x, b.num_rows, t)
                j = near.argmax(axis=1)
                now = np.stack([near[np.arange(b.num_rows), j], np.full(b.num_rows, t), j])
                best = np.where(now[0] > best[0], now, best)
            yield pa.RecordBatch.from_pydict({"stem_id": b.column("stem_id"), "period_us": best[1], "phase": best[2].astype(np.int32), "n_near": best[0]})

    return stems_of(peaks).mapInArrow(kernel, f"stem_id {dict(peaks.dtypes)['stem_id']}, period_us long, phase int, n_near long")


def refine(peaks: DataFrame, params: DataFrame, fraction: float = 0.15, rounds: int = 3) -> DataFrame:
    """Least-squares period and phase over the peaks near the grid, refitted ``rounds`` times.

    A stem with fewer than three peaks near, or a period under 0.1 s, keeps its last fit.
    """
    fit = params.select("stem_id", F.col("period_us").cast("double").alias("period"), F.col("phase_us").cast("double").alias("phase"))
    for _ in range(rounds):
        p = peaks.join(fit, "stem_id")
        k = F.rint((F.col("tap_us") - F.col("phase")) / F.col("period"))
        p = p.withColumn("k", k).where(F.abs(F.col("tap_us") - F.col("phase") - F.col("k") * F.col("period")) <= fraction * F.col("period"))
        y = F.col("tap_us").cast("double")
        new = p.groupBy("stem_id").agg(F.count("*").alias("n"), F.regr_slope(y, "k").alias("slope"), F.regr_intercept(y, "k").alias("intercept"))
        ok = (F.col("n") >= 3) & (F.col("slope") >= 0.1 * SECOND)
        fit = fit.join(new, "stem_id", "left").select("stem_id", F.when(ok, F.col("slope")).otherwise(F.col("period")).alias("period"), F.when(ok, F.col("intercept")).otherwise(F.col("phase")).alias("phase"))
    return fit


def snap(beats: DataFrame, near: DataFrame, period_us: str = "period_us") -> DataFrame:
    """Beats moved 45 % of the way to a peak within 0.12 T; near has ``nearest_us`` for each beat."""
    d = F.col("nearest_us") - F.col("t_us")
    return near.withColumn("snapped_us", F.when(F.abs(d) <= 0.12 * F.col(period_us), F.col("t_us") + 0.45 * d).otherwise(F.col("t_us").cast("double")))


def fill_gaps(beats: DataFrame, period_us: int | None = None) -> DataFrame:
    """Beats put into gaps of more than 1.4 periods, evenly, where that leaves at least 0.75 of a period."""
    w = Window.partitionBy("stem_id").orderBy("beat_us")
    b = beats.withColumn("gap", F.lead("beat_us").over(w) - F.col("beat_us"))
    p = F.median("gap").over(Window.partitionBy("stem_id")) if period_us is None else F.lit(float(period_us))
    b = b.withColumn("period", p)
    n = F.greatest(F.lit(1), (F.rint(F.col("gap") / F.col("period")) - 1).cast("int"))
    b = b.withColumn("n", F.when((F.col("gap") > 1.4 * F.col("period")) & (F.col("gap") / (n + 1) >= 0.75 * F.col("period")), n).otherwise(0))
    added = b.where("n > 0").select("stem_id", "beat_us", "gap", "n", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select("stem_id", (F.col("beat_us") + F.col("gap") * F.col("i") / (F.col("n") + 1)).alias("beat_us"), F.lit(True).alias("added"))
    return b.select("stem_id", F.col("beat_us").cast("double").alias("beat_us"), F.lit(False).alias("added")).unionAll(added)


def steady_runs(beats: DataFrame, least: int = 6, most_cv: float = 0.15) -> DataFrame:
    """The run of at least ``least`` beats, varying by ``most_cv`` at most, with the highest n * exp(-cv / 0.05) per stem; n counts beats.

    Prefix sums give any run's variation in closed form; of equal scores the
    shortest, then the earliest.  Pairs are of one stem's grid only, whose
    length the 30 s window bounds.  A stem without such a run has no row.
    """
    w = Window.partitionBy("stem_id").orderBy("beat_us")
    d = beats.withColumn("ioi", (F.col("beat_us") - F.lag("beat_us").over(w)) / 1000.0).where("ioi is not null")
    d = d.withColumns({"i": F.row_number().over(w), "s1": F.sum("ioi").over(w), "s2": F.sum(F.col("ioi") * F.col("ioi")).over(w)})
    a = d.select("stem_id", F.col("i").alias("i0"), (F.col("s1") - F.col("ioi")).alias("a1"), (F.col("s2") - F.col("ioi") * F.col("ioi")).alias("a2"))
    b = d.select("stem_id", F.col("i").alias("i1"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    k = F.col("i1") - F.col("i0") + 1
    mean = (F.col("b1") - F.col("a1")) / k
    cv = F.sqrt(F.greatest(F.lit(0.0), (F.col("b2") - F.col("a2")) / k - mean * mean)) / mean
    runs = a.join(b, "stem_id").where(k + 1 >= least).select("stem_id", F.col("i0").alias("first"), (k + 1).alias("n"), cv.alias("cv")).where(F.col("cv") <= most_cv)
    runs = runs.withColumn("score", F.col("n") * F.exp(-F.col("cv") / 0.05))
    top = Window.partitionBy("stem_id").orderBy(F.desc(F.round("score", 9)), "n", "first")
    return runs.withColumn("r", F.row_number().over(top)).where("r = 1").drop("r")


def bimodal_score(peaks: DataFrame, period_us: DataFrame) -> DataFrame:
    """Largest gap between sorted intervals under 0.9 T, over T; 0 below eight peaks or three such intervals."""
    w = Window.partitionBy("stem_id").orderBy("tap_us")
    d = peaks.withColumn("ioi", F.col("tap_us") - F.lag("tap_us").over(w)).join(period_us, "stem_id")
    n = d.groupBy("stem_id").agg(F.count("*").alias("n_peaks"), F.count_if(F.col("ioi") < 0.9 * F.col("period_us")).alias("n_short"))
    s = d.where(F.col("ioi") < 0.9 * F.col("period_us"))
    v = Window.partitionBy("stem_id").orderBy("ioi")
    g = s.withColumn("gap", F.col("ioi") - F.lag("ioi").over(v)).groupBy("stem_id").agg((F.max("gap") / F.max("period_us")).alias("score"))
    return n.join(g, "stem_id", "left").select("stem_id", "n_peaks", "n_short", F.when((F.col("n_peaks") >= 8) & (F.col("n_short") >= 3), F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("score"))


def bimodal_strength(peaks: DataFrame, period_us: DataFrame) -> DataFrame:
    """Intervals near half or double the period, against those near the period itself."""
    w = Window.partitionBy("stem_id").orderBy("tap_us")
    r = (peaks.withColumn("ioi", F.col("tap_us") - F.lag("tap_us").over(w)).where("ioi is not null").join(period_us, "stem_id")).withColumn("r", F.col("ioi") / F.col("period_us"))
    open_in = lambda a, b: F.count_if((F.col("r") > a) & (F.col("r") < b))
    c = r.groupBy("stem_id").agg(open_in(0.40, 0.60).alias("n_half"), open_in(1.70, 2.30).alias("n_double"), open_in(0.85, 1.15).alias("n_base"))
    s = F.try_divide(F.greatest("n_half", "n_double"), F.col("n_base"))
    return c.withColumn("strength", s).withColumn("flag", F.coalesce(s >= 0.40, F.lit(False)))


def phase_groups(peaks: DataFrame, threshold_us: DataFrame) -> DataFrame:
    """Peaks labelled A or B by runs of short intervals: inside a run every other one starts a pair."""
    w = Window.partitionBy("stem_id").orderBy("tap_us")
    d = peaks.join(threshold_us, "stem_id").withColumn("after", F.lead("tap_us").over(w) - F.col("tap_us"))
    d = d.withColumn("short", F.coalesce(F.col("after") <= F.col("threshold_us"), F.lit(False)))
    d = d.withColumn("run", F.sum(F.when(F.col("short"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    place = Window.partitionBy("stem_id", F.coalesce("run", F.lit(0))).orderBy("tap_us")
    return d.withColumn("i", F.row_number().over(place)).select("stem_id", "tap_us", F.when(F.col("i") % 2 == 1, "A").otherwise("B").alias("phase_group"))


def bimodality_audit(peaks: DataFrame, period_us: DataFrame, least_gap: float = 0.12, least_group: int = 4) -> DataFrame:
    """Each stem's bimodal score, whether its peaks split in two phase groups, and the groups.

    peaks: stem_id, tap_us; period_us: stem_id, period_us.  A stem splits where
    its largest gap between sorted short intervals reaches ``least_gap`` of the
    period and both groups, told apart at the middle of that gap (the first of
    equals), have ``least_group`` peaks.  Rows: stem_id, period_us, n_peaks,
    score, is_bimodal, phase_delta_us (0 without a split), n_a, n_b.
    """
    scores = bimodal_score(peaks, period_us)
    w = Window.partitionBy("stem_id").orderBy("tap_us")
    d = peaks.withColumn("ioi", F.col("tap_us") - F.lag("tap_us").over(w)).join(period_us, "stem_id").where(F.col("ioi") < 0.9 * F.col("period_us"))
    before = F.lag("ioi").over(Window.partitionBy("stem_id").orderBy("ioi"))
    gaps = d.select("stem_id", "ioi", before.alias("before")).where("before is not null")
    middle = gaps.groupBy("stem_id").agg((F.max_by(F.col("before") + F.col("ioi"), F.struct(F.col("ioi") - F.col("before"), -F.col("ioi"))) / 2.0).alias("threshold_us"))
    found = scores.join(middle, "stem_id", "left").withColumn("apart", F.col("score") >= least_gap)
    groups = phase_groups(peaks, found.where("apart").select("stem_id", "threshold_us")).groupBy("stem_id").agg(F.count_if(F.col("phase_group") == "A").alias("a"), F.count_if(F.col("phase_group") == "B").alias("b"))
    out = found.join(groups, "stem_id", "left").join(period_us, "stem_id")
    split = F.coalesce((F.col("a") >= least_group) & (F.col("b") >= least_group), F.lit(False))
    zero = lambda c: F.when(split, F.col(c)).otherwise(0)
    return out.select("stem_id", "period_us", "n_peaks", "score", split.alias("is_bimodal"), zero("threshold_us").cast("double").alias("phase_delta_us"), zero("a").cast("long").alias("n_a"), zero("b").cast("long").alias("n_b"))


def interpolated(points: DataFrame, curve: DataFrame, step_us: int, name: str = "y") -> DataFrame:
    """Points with the value at ``t_us`` of their stem's curve, which is linear between grid points and 0 outside.

    curve: stem_id, g (each index of the grid) and y; point g lies at g * step_us.
    It is divided by its greatest value.  A point meets one row of the curve, so
    nothing is joined by range.
    """
    top = F.max("y").over(Window.partitionBy("stem_id")) + 1e-12
    after = F.lead("y").over(Window.partitionBy("stem_id").orderBy("g"))
    c = curve.select("stem_id", "g", (F.col("y") / top).alias("_y"), (after / top).alias("_next"))
    at = points.withColumns({"g": F.floor(F.col("t_us") / step_us), "_part": F.pmod(F.col("t_us"), F.lit(step_us)) / step_us})
    value = F.when(F.col("_part") == 0, F.col("_y")).otherwise(F.col("_y") + (F.col("_next") - F.col("_y")) * F.col("_part"))
    return at.join(c, ["stem_id", "g"], "left").withColumn(name, F.coalesce(value, F.lit(0.0))).drop("g", "_part", "_y", "_next")


def placement_cost(beats: DataFrame, weights: tuple[float, float, float]) -> DataFrame:
    """Cost of each stem's beats: squared misses of the wanted interval, less density, plus squared distances to peaks.

    beats: stem_id, t_us, target_us (the interval wanted before this beat),
    density, off_us (to the nearest peak; null where a stem has none).  In
    seconds.  A stem with one beat costs a million.
    """
    w = Window.partitionBy("stem_id").orderBy("t_us")
    d = beats.withColumn("miss", (F.col("t_us") - F.lag("t_us").over(w) - F.col("target_us")) / SECOND)
    off = F.col("off_us") / SECOND
    parts = d.groupBy("stem_id").agg(F.count("*").alias("n_beats"), F.avg(F.col("miss") * F.col("miss")).alias("c_interval"), (-F.avg("density")).alias("c_density"), F.coalesce(F.avg(off * off), F.lit(0.0)).alias("c_peaks"))
    cost = sum((F.col(c) * v for c, v in zip(("c_interval", "c_density", "c_peaks"), weights, strict=True)), F.lit(0.0))
    return parts.withColumn("cost", F.when(F.col("n_beats") < 2, 1e6).otherwise(cost))


def nudged(beats: DataFrame, start_us: int = 0, stop_us: int = 30 * SECOND, share: float = 0.05) -> DataFrame:
    """Inner beats moved toward the middle of their neighbours, by ``share`` of the median interval at most.

    Rows: stem_id, i, beat_us, nudged_us and cv, the variation of the new
    intervals.  A stem of fewer than four beats, or one in which an interval
    would fall under half the median, stays as it is, with no cv.
    """
    stem = Window.partitionBy("stem_id")
    w = stem.orderBy("beat_us")
    b = beats.select("stem_id", F.col("beat_us").cast("double").alias("beat_us"))
    b = b.withColumns({"i": F.row_number().over(w).cast("long"), "before": F.lag("beat_us").over(w), "after": F.lead("beat_us").over(w)})
    b = b.withColumns({"n": F.count("*").over(stem), "period": F.median(F.col("beat_us") - F.col("before")).over(stem)})
    cap = share * F.col("period")
    by = F.greatest(-cap, F.least(cap, (F.col("before") + F.col("after")) / 2 - F.col("beat_us")))
    inside = lambda x: F.greatest(F.lit(float(start_us)), F.least(F.lit(float(stop_us)), x))
    b = b.withColumn("moved", inside(F.when(F.col("before").isNull() | F.col("after").isNull(), F.col("beat_us")).otherwise(F.col("beat_us") + by)))
    places = b.select("stem_id", "moved", F.row_number().over(stem.orderBy("moved")).cast("long").alias("i"), (F.col("moved") - F.lag("moved").over(stem.orderBy("moved"))).alias("ioi"))
    b = b.drop("moved", "before", "after").join(places, ["stem_id", "i"])
    ok = (F.col("n") >= 4) & (F.min("ioi").over(stem) >= 0.5 * F.col("period"))
    return b.select("stem_id", "i", "beat_us", F.when(ok, F.col("moved")).otherwise(F.col("beat_us")).alias("nudged_us"), F.when(ok, F.stddev_pop("ioi").over(stem) / F.avg("ioi").over(stem)).alias("cv"))
