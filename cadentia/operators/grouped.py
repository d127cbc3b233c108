"""Kernels applied per group through Arrow: peaks, consensus grids, matchings, metrics, resampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import cascade as grids
from ..kernels import matching, periods, signal
from . import matching as nearby
from . import timing
from .durable import durable
from .permutation import added, array_of, scrambled

SECOND = 1_000_000.0


def one(t: pa.Table, column: str):
    return t.column(column)[0].as_py()


def density_peaks(density: DataFrame, step_us: int = 5_000, distance: int = 30, least_prominence: float = 0.10, least_width: float = 0.0) -> DataFrame:
    """Peaks of each stem's curve; density: (stem_id, g, density), missing points are 0."""

    def kernel(t: pa.Table) -> pa.Table:
        g, d = t.column("g").to_numpy(), t.column("density").to_numpy()
        y = np.zeros(int(g.max()) + 1)
        y[g] = d
        p = signal.pick_peaks(y, distance, least_prominence, least_width)
        return pa.table({"stem_id": [one(t, "stem_id")] * len(p), "peak_index": np.arange(len(p), dtype=np.int32), "tap_us": p.astype(np.int64) * step_us, "height": y[p] / y.max() if len(p) else y[p]})

    return density.select("stem_id", F.col("g").cast("long").alias("g"), "density").groupBy("stem_id").applyInArrow(kernel, "stem_id string, peak_index int, tap_us long, height double")


def consensus(peaks: DataFrame, params: grids.Params = grids.Params()) -> DataFrame:
    """Each stem's grid: beats, period, variation, and the path and scores of the cascade."""

    def kernel(t: pa.Table) -> pa.Table:
        f = grids.cascade(np.sort(t.column("tap_us").to_numpy() / SECOND), params)
        return pa.table({"stem_id": [one(t, "stem_id")], "beats_us": pa.array([np.rint(f.beats * SECOND).astype(np.int64)], pa.list_(pa.int64())), "period_s": [grids.middle_interval(f.beats)], "cv": [grids.cv(f.beats)], "label": [f.label], "path": ["->".join(f.path)], "scores": pa.array([list(f.scores.items())], pa.map_(pa.string(), pa.float64()))})

    return peaks.select("stem_id", "tap_us").groupBy("stem_id").applyInArrow(kernel, "stem_id string, beats_us array<long>, period_s double, cv double, label string, path string, scores map<string,double>")


def annotator_consensus(annotations: DataFrame, least: int = 3, params: grids.Params = grids.Params()) -> DataFrame:
    """Each stem's grid from its annotators' times, as ``consensus`` has it: rounded to 1 ms, cleaned by annotator, pooled.

    annotations: stem_id, annotator, times (seconds).  An annotator with fewer
    than ``least`` times within the window, before or after cleaning, is left out.
    """
    ms = F.round(F.col("t") * 1000).cast("long") * 1000
    taps = annotations.select("stem_id", F.col("annotator").alias("participant"), F.explode("times").alias("t")).where("t is not null").select("stem_id", "participant", ms.alias("tap_us"))
    enough = lambda d: d.groupBy("stem_id", "participant").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("stem_id", "participant")
    inside = timing.clipped(taps, round(params.start * 1e6), round(params.stop * 1e6))
    clean = timing.cleaned_fast(inside.join(enough(inside), ["stem_id", "participant"], "left_semi"))
    clean = clean.join(enough(clean), ["stem_id", "participant"], "left_semi")
    return consensus(density_peaks(timing.pooled_density(clean)), params)


def consensus_sweep(peaks: DataFrame, variants: dict[str, grids.Params]) -> DataFrame:
    """(stem_id, variant, beats_us): each stem's grid under each set of parameters; a stem and a variant are one task's row of work."""
    shared = dict(variants)
    each = peaks.select("stem_id", "tap_us", F.explode(F.array(*map(F.lit, shared))).alias("variant"))

    def kernel(t: pa.Table) -> pa.Table:
        x = np.sort(t.column("tap_us").to_numpy() / SECOND)
        beats = grids.cascade(x, shared[one(t, "variant")]).beats if len(x) >= 3 else np.empty(0)
        return pa.table({"stem_id": [one(t, "stem_id")], "variant": [one(t, "variant")], "beats_us": pa.array([np.rint(beats * SECOND).astype(np.int64)], pa.list_(pa.int64()))})

    return each.groupBy("stem_id", "variant").applyInArrow(kernel, "stem_id string, variant string, beats_us array<long>")


#: What is varied, one at a time, in the sensitivity analysis (fixed values).
VARIANTS = {
    "T_steps_80": {"periods": 80},
    "T_steps_160": {"periods": 160},
    "phi_steps_160": {"phases": 160},
    "phi_steps_320": {"phases": 320},
    "peak_weight_025": {"peak_weight": 0.25},
    "peak_weight_075": {"peak_weight": 0.75},
    "snap_weight_025": {"snap_share": 0.25},
    "snap_weight_065": {"snap_share": 0.65},
    "snap_max_008": {"snap_reach": 0.08},
    "snap_max_016": {"snap_reach": 0.16},
    "bimodal_008": {"bimodal": 0.08},
    "bimodal_012": {"bimodal": 0.12},
    "ioi_min_023": {"ioi_min": 0.23},
    "ioi_min_033": {"ioi_min": 0.33},
}


def sensitivity(peaks: DataFrame, variants: dict[str, dict] = VARIANTS) -> DataFrame:
    """Each stem's grid under each variant against its default grid: stem_id, variant, n_beats and what ``compared_grids`` tells."""
    made = durable(consensus_sweep(peaks, {"default": grids.Params()} | {k: grids.Params(**v) for k, v in variants.items()}))
    beats = made.select("stem_id", "variant", F.explode("beats_us").alias("beat_us"))
    default = beats.where("variant = 'default'").select("stem_id", "beat_us", F.explode(F.array(*map(F.lit, variants))).alias("variant"))
    found = nearby.compared_grids(default, beats.where("variant <> 'default'"), ["stem_id", "variant"])
    return made.where("variant <> 'default'").select("stem_id", "variant", F.size("beats_us").alias("n_beats")).join(found, ["stem_id", "variant"], "left")


def sampled_groups(taps: DataFrame, sizes: list[int], reps: int, seed: int) -> DataFrame:
    """Taps of two disjoint samples (group A and B) of n participants of each stem with 2 n at least, by an order of hashes: stem_id, n, rep, group, tap_us.

    Only the taps of who is drawn are repeated.
    """
    units = taps.select("stem_id", "participant").distinct()
    drawn = units.withColumn("n", F.explode(F.array(*map(F.lit, sizes)))).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    cell = Window.partitionBy("stem_id", "n", "rep")
    drawn = drawn.withColumns({"place": F.row_number().over(cell.orderBy(F.xxhash64("participant", "n", "rep", F.lit(seed)), "participant")), "of": F.count("*").over(cell)})
    drawn = drawn.where((F.col("place") <= 2 * F.col("n")) & (2 * F.col("n") <= F.col("of")))
    return taps.join(drawn.select("stem_id", "participant", "n", "rep", F.when(F.col("place") <= F.col("n"), "A").otherwise("B").alias("group")), ["stem_id", "participant"]).select("stem_id", "n", "rep", "group", "tap_us")


def final_grid_reliability(taps: DataFrame, sizes: list[int], reps: int, seed: int) -> DataFrame:
    """Grids of samples of n participants against the stem's whole grid, and of disjoint samples against each other.

    Every sample goes from taps to peaks to a grid as a stem does, under a
    name of its own.  Rows: comparison, stem_id, n, rep, group, and what
    ``compared_grids`` tells.
    """
    part = F.concat_ws("\u001f", "stem_id", "n", "rep", "group")
    samples = sampled_groups(taps, sizes, reps, seed).select(part.alias("stem_id"), "tap_us")
    whole = taps.select(F.concat_ws("\u001f", "stem_id", F.lit("0"), F.lit("0"), F.lit("all")).alias("stem_id"), "tap_us")
    made = consensus(density_peaks(timing.pooled_density(samples.unionAll(whole))))
    name = F.split("stem_id", "\u001f")
    beats = durable(made.select(name[0].alias("stem_id"), name[1].cast("int").alias("n"), name[2].cast("int").alias("rep"), name[3].alias("group"), F.explode("beats_us").alias("beat_us")))
    subset = beats.where("group <> 'all'")
    cells = subset.select("stem_id", "n", "rep", "group").distinct()
    keys = ["stem_id", "n", "rep", "group"]
    against = beats.where("group = 'all'").select("stem_id", "beat_us").join(cells, "stem_id")
    one_way = nearby.compared_grids(against, subset, keys).withColumn("comparison", F.lit("subsample_vs_full"))
    a, b = (subset.where(F.col("group") == g).drop("group") for g in "AB")
    both = nearby.compared_grids(a, b, keys[:3]).withColumns({"group": F.lit("AB"), "comparison": F.lit("independent_n_vs_n")})
    return one_way.unionByName(both)


def reliability_summary(rows: DataFrame) -> DataFrame:
    """Per comparison and n: stems, repetitions, F averaged by stem, shares at the matched rate, and medians of phase and timing offsets."""
    stem = rows.groupBy("comparison", "n", "stem_id").agg(F.avg("f").alias("f"))
    by = stem.groupBy("comparison", "n").agg(F.count("*").alias("n_stems"), F.avg("f").alias("mean_f"), F.median("f").alias("median_f"))
    rest = rows.groupBy("comparison", "n").agg(F.count_distinct("rep").alias("n_repetitions"), F.avg((F.col("relation") == "matched").cast("double")).alias("matched_share"), F.median(F.abs("phase_offset")).alias("median_abs_phase"), F.median("median_abs_offset_ms").alias("median_abs_offset_ms"))
    return by.join(rest, ["comparison", "n"])


def paired(reference: DataFrame, estimate: DataFrame, key: str, kernel, schema: str) -> DataFrame:
    """Kernel over (key, sorted seconds of the reference, of the estimate); both have key and ``beat_us``."""

    def both(k: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (np.sort(t.column("beat_us").to_numpy() / SECOND) for t in (a, b))
        return kernel(k[0].as_py(), x, y)

    return reference.select(key, "beat_us").groupBy(key).cogroup(estimate.select(key, "beat_us").groupBy(key)).applyInArrow(both, schema)


def beat_metrics(reference: DataFrame, estimate: DataFrame, key: str = "stem_id", trim_s: float = 5.0) -> DataFrame:
    """Long rows (key, metric, value) after the first ``trim_s`` seconds."""

    def kernel(k, x: np.ndarray, y: np.ndarray) -> pa.Table:
        m = matching.all_metrics(x[x >= trim_s], y[y >= trim_s])
        return pa.table({key: [k] * len(m), "metric": list(m), "value": list(m.values())})

    return paired(reference, estimate, key, kernel, f"{key} string, metric string, value double")


def poisson(*parts) -> Column:
    """A Poisson(1) number from a hash of the parts."""
    u = (F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    steps, total, term = [], 0.0, float(np.exp(-1))
    for k in range(12):
        total += term
        steps.append(total)
        term /= k + 1
    weight = sum(((u > s).cast("int") for s in steps), F.lit(0))
    return weight


def numbered(rows: DataFrame, name: str = "copy") -> DataFrame:
    """Equal rows told apart by a number among themselves, the same in every run."""
    each = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    return each.withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n")


def drawn_sums(rows: DataFrame, keys: list[str], own: str, columns: list[str], draws: int, seed: int) -> DataFrame:
    """(cell, sums): for each key, as JSON, the weighted sums of the columns and of 1 under every draw; draw 0 weighs each row 1.

    A row's weight in a draw is a Poisson(1) number from its number ``own`` and
    the draw, so rows are not repeated: tasks add them up, and only sums are shuffled.
    """
    cell = F.to_json(F.struct(*keys)) if keys else F.lit("{}")
    number = np.arange(1, draws + 1, dtype=np.uint64) + np.uint64(seed << 20)
    each, width = scrambled(number), len(columns) + 1

    def kernel(batches):
        steps = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 12)]))
        held: dict[str, np.ndarray] = {}

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["cell", "sums"])
            held.clear()
            return out

        for b in batches:
            for name, h, x in zip(*(b.column(c).to_pylist() for c in ("cell", "own", "x")), strict=True):
                if name not in held and len(held) >= 64:
                    yield given()
                u = (scrambled(each ^ np.uint64(h & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)).astype(float) / float(1 << 53)
                weight = np.concatenate([[1.0], np.searchsorted(steps, u)])
                total = held.setdefault(name, np.zeros((width, draws + 1)))
                total += np.array([*x, 1.0])[:, None] * weight
        yield given()

    made = rows.select(cell.alias("cell"), F.col(own).alias("own"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
    return added(made.mapInArrow(kernel, "cell string, sums binary"), {"cell": "string"}, "sums")


def percentiles(values: np.ndarray) -> tuple[float | None, float | None, int]:
    """The 95 % interval of the draws that have a value, and their number."""
    values = values[np.isfinite(values)]
    return (*np.percentile(values, [2.5, 97.5]).tolist(), len(values)) if len(values) else (None, None, 0)


def keyed(found: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``found`` with its cells' keys instead of their JSON."""
    return rows.select(*keys).distinct().withColumn("cell", F.to_json(F.struct(*keys)) if keys else F.lit("{}")).join(found, "cell").drop("cell")


def bootstrap_mean(rows: DataFrame, keys: list[str], value: str, draws: int, seed: int) -> DataFrame:
    """Percentile interval of the mean by a Poisson bootstrap over rows with a value; equal rows have weights of their own.

    A draw in which all weights of a small group are 0 has no mean and is not counted.
    """
    d = numbered(rows).where(F.col(value).isNotNull())
    d = d.withColumn("_own", F.xxhash64(*rows.columns, "copy"))

    def kernel(t: pa.Table) -> pa.Table:
        total, weight = array_of(t, "sums", (2, draws + 1))[:, 1:]
        with np.errstate(invalid="ignore", divide="ignore"):
            lo, hi, n = percentiles(total / weight)
        return pa.table({"cell": t.column("cell")[:1], "lo": pa.array([lo], pa.float64()), "hi": pa.array([hi], pa.float64()), "draws": pa.array([n], pa.int64())})

    found = drawn_sums(d, keys, "_own", [value], draws, seed).groupBy("cell").applyInArrow(kernel, "cell string, lo double, hi double, draws long")
    return keyed(found, rows, keys).select(*keys, "lo", "hi", "draws")


def bootstrap_shares(rows: DataFrame, keys: list[str], unit: str, flags: list[str], draws: int, seed: int) -> DataFrame:
    """Shares of categories with percentile intervals, units (participants) drawn whole; rows: keys, unit and 0/1 flags."""
    own = rows.groupBy(*keys, unit).agg(F.count("*").alias("_total"), *(F.sum(c).alias(c) for c in flags)).withColumn("_own", F.xxhash64(*keys, unit))

    def kernel(t: pa.Table) -> pa.Table:
        sums = array_of(t, "sums", (len(flags) + 2, draws + 1))
        with np.errstate(invalid="ignore", divide="ignore"):
            share = sums[: len(flags)] / sums[len(flags)]
        lo, hi, n = zip(*(percentiles(x[1:]) for x in share), strict=True)
        return pa.table({"cell": [one(t, "cell")] * len(flags), "category": flags, "share": pa.array(share[:, 0], pa.float64(), from_pandas=True), "lo": pa.array(lo, pa.float64()), "hi": pa.array(hi, pa.float64()), "draws": pa.array(n, pa.int64())})

    found = drawn_sums(own, keys, "_own", [*flags, "_total"], draws, seed).groupBy("cell").applyInArrow(kernel, "cell string, category string, share double, lo double, hi double, draws long")
    return keyed(found, rows, keys).select(*keys, "category", "share", "lo", "hi", "draws")


def bootstrap_median(rows: DataFrame, keys: list[str], value: str, draws: int, seed: int) -> DataFrame:
    """Percentile interval of the median by a Poisson bootstrap: weights are frequencies of an exact percentile."""
    d = numbered(rows.select(*keys, value)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("weight", F.when(F.col("draw") == 0, 1).otherwise(poisson("draw", *keys, value, "copy", F.lit(seed))))
    m = d.where("weight > 0").groupBy(*keys, "draw").agg(F.percentile(value, F.lit(0.5), F.col("weight")).alias("median"))
    boot = F.when(F.col("draw") > 0, F.col("median"))
    return m.groupBy(*keys).agg(F.max(F.when(F.col("draw") == 0, F.col("median"))).alias("median"), F.percentile(boot, F.lit(0.025)).alias("lo"), F.percentile(boot, F.lit(0.975)).alias("hi"), F.count(boot).alias("draws"))


def convergence(taps: DataFrame, sizes: list[int], reps: int, seed: int, start_s: float = 10.0, stop_s: float = 25.0) -> DataFrame:
    """Samples of n participants against all, and disjoint samples against each other: density correlation, peak F, peak offset.

    taps: stem_id, participant, tap_us.  A row for each stem, size, repetition
    and comparison.  Samples are orders of a hash of participant, repetition
    and seed.  Means of densities are densities of weighted taps, so a sample
    is one pass over a stem's taps, which are copied once for 20 repetitions of all sizes.
    """
    own = taps.groupBy("stem_id", "participant").agg(F.collect_list(F.col("tap_us").cast("long")).alias("taps"))
    blocks = own.withColumn("block", F.explode(F.array(*map(F.lit, range(0, reps, 20)))))

    def kernel(t: pa.Table) -> pa.Table:
        first = one(t, "block")
        lists = t.column("taps").to_pylist()
        who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        sec = np.array([x for taps in lists for x in taps]) / SECOND
        order = np.argsort(t.column("participant").to_numpy(), kind="stable")
        out = []
        whole = signal.participant_density(sec, who, np.ones(len(lists)))
        for n in sizes:
            for rep in range(first, min(first + 20, reps)) if n <= len(lists) else ():
                drawn = order[np.random.default_rng([seed, n, rep]).permutation(len(lists))]
                pick = lambda a, b: np.isin(np.arange(len(lists)), drawn[a:b]).astype(float)  # noqa: B023, E731
                half = signal.participant_density(sec, who, pick(0, n))
                out.append((n, "subsample_vs_full", rep, *signal.compared(whole, half, start_s, stop_s)))
                if 2 * n <= len(lists):
                    out.append((n, "independent_n_vs_n", rep, *signal.compared(half, signal.participant_density(sec, who, pick(n, 2 * n)), start_s, stop_s)))
        cols = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table({"stem_id": pa.array([one(t, "stem_id")] * len(out), pa.string()), "n": pa.array(cols[0], pa.int32()), "comparison": pa.array(cols[1], pa.string()), "rep": pa.array(cols[2], pa.int32()), **{k: pa.array(c, pa.float64(), from_pandas=True) for k, c in zip(("density_r", "peak_f", "offset_ms"), cols[3:], strict=True)}})

    return blocks.groupBy("stem_id", "block").applyInArrow(kernel, "stem_id string, n int, comparison string, rep int, density_r double, peak_f double, offset_ms double")


def estimated_periods(peaks: DataFrame) -> DataFrame:
    """Period of each stem's peaks by autocorrelation, and refined over candidates, multiples and phases."""

    def kernel(t: pa.Table) -> pa.Table:
        x = np.sort(t.column("tap_us").to_numpy() / SECOND)
        rough, found = periods.by_autocorrelation(x)
        period, phase = periods.estimate(x)
        return pa.table({"stem_id": [one(t, "stem_id")], "acf_period_s": [rough], "n_candidates": pa.array([len(found)], pa.int32()), "period_s": [period], "phase_s": [phase]})

    return peaks.select("stem_id", "tap_us").groupBy("stem_id").applyInArrow(kernel, "stem_id string, acf_period_s double, n_candidates int, period_s double, phase_s double")


def levels_of(reference: DataFrame, estimate: DataFrame, key: str = "stem_id", start_s: float = 10.0, stop_s: float = 25.0) -> DataFrame:
    """F, and the shares tracked at the annotated and at any metrical level, untrimmed within the window."""

    def kernel(k, x: np.ndarray, y: np.ndarray) -> pa.Table:
        x, y = (v[(v >= start_s) & (v <= stop_s)] for v in (x, y))
        _, cmlt, _, amlt = matching.continuity(x, y)
        return pa.table({key: [k], "f": [matching.f_measure(x, y)], "cmlt": [cmlt], "amlt": [amlt]})

    return paired(reference, estimate, key, kernel, f"{key} string, f double, cmlt double, amlt double")
