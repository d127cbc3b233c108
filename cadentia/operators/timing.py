"""Operators on event times: cleaning, intervals, coherence, densities.

Times are whole microseconds (``tap_us``), so that differences and medians are
exact; keys are ``stem_id`` (the group) and ``participant``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
TRIAL = ("stem_id", "participant")
#: Cleaning: interior taps with an interval beyond median + MAD_FACTOR * 1.4826 * MAD go, in this many passes.
MAD_FACTOR, MAD_SCALE, PASSES, LEAST_TAPS = 3.5, 1.4826, 3, 4


def clipped(taps: DataFrame, start_us: int = 0, stop_us: int = 30 * SECOND) -> DataFrame:
    """Closed window, one row per distinct time of a trial."""
    return taps.where(F.col("tap_us").between(start_us, stop_us)).dropDuplicates([*TRIAL, "tap_us"])


def with_intervals(taps: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """``ioi``: the time since the previous tap of the same trial."""
    w = Window.partitionBy(*keys).orderBy("tap_us")
    return taps.withColumn("ioi", F.col("tap_us") - F.lag("tap_us").over(w))


def clean_pass(taps: DataFrame) -> DataFrame:
    """One pass of the interval filter; each window reuses the trial's partitioning."""
    by = Window.partitionBy(*TRIAL)
    order = by.orderBy("tap_us")
    t = taps.withColumns({"before": F.col("tap_us") - F.lag("tap_us").over(order), "after": F.lead("tap_us").over(order) - F.col("tap_us"), "n": F.count("*").over(by)})
    t = t.withColumn("mid", F.median("before").over(by))
    t = t.withColumn("mad", F.median(F.abs(F.col("before") - F.col("mid"))).over(by) + 0.001)
    limit = F.col("mid") + MAD_FACTOR * MAD_SCALE * F.col("mad")
    bad = (F.col("n") >= LEAST_TAPS) & (F.col("mad") >= 1.0) & F.col("before").isNotNull() & F.col("after").isNotNull() & ((F.col("before") > limit) | (F.col("after") > limit))
    return t.where(~F.coalesce(bad, F.lit(False))).drop("before", "after", "n", "mid", "mad")


def cleaned(taps: DataFrame) -> DataFrame:
    """Three passes; a pass that finds nothing changes nothing, so stopping early is not needed."""
    out = clipped(taps)
    for _ in range(PASSES):
        out = clean_pass(out)
    return out


def clean_array(t: np.ndarray) -> np.ndarray:
    """The same filter on one trial's sorted distinct times."""
    for _ in range(PASSES):
        if len(t) < LEAST_TAPS:
            break
        d = np.diff(t).astype(float)
        mid = np.median(d)
        mad = np.median(np.abs(d - mid)) + 0.001
        if mad < 1.0:
            break
        high = d > mid + MAD_FACTOR * MAD_SCALE * mad
        bad = np.zeros(len(t), bool)
        bad[1:-1] = high[:-1] | high[1:]
        if not bad.any():
            break
        t = t[~bad]
    return t


def cleaned_fast(taps: DataFrame) -> DataFrame:
    """As ``cleaned``: one shuffle by trial, and a kernel that walks the sorted rows, holding one trial at a time."""
    columns = ["stem_id", "participant", "tap_us"]
    rows = clipped(taps).select(*columns).repartition(*(F.col(c) for c in TRIAL)).sortWithinPartitions(*TRIAL, "tap_us")
    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, now]) if rest is not None else now
            done, rest = split_last(rest)
            if done is not None:
                yield from done.take(kept(done)).to_batches()
        if rest is not None and rest.num_rows:
            yield from rest.take(kept(rest)).to_batches()

    def bounds(t: pa.Table) -> np.ndarray:
        stem, who = (t.column(c).combine_chunks().dictionary_encode().indices.to_numpy() for c in TRIAL)
        return np.nonzero(np.concatenate([[True], (stem[1:] != stem[:-1]) | (who[1:] != who[:-1])]))[0]

    def split_last(t: pa.Table) -> tuple[pa.Table | None, pa.Table]:
        b = bounds(t)
        return (t.slice(0, int(b[-1])), t.slice(int(b[-1]))) if len(b) > 1 else (None, t)

    def kept(t: pa.Table) -> np.ndarray:
        us, b, out = t.column("tap_us").to_numpy(), bounds(t), []
        for s, e in zip(b, np.append(b[1:], len(us)), strict=True):
            out.append(s + np.nonzero(np.isin(us[s:e], clean_array(us[s:e])))[0])
        return np.concatenate(out) if out else np.empty(0, np.int64)

    return rows.mapInArrow(kernel, schema)


def interval_stats(taps: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Taps, median interval and its variation (population deviation over mean), per trial."""
    t = with_intervals(taps, keys)
    return t.groupBy(*keys).agg(F.count("*").alias("n_taps"), F.median("ioi").alias("median_ioi_us"), F.when(F.count("ioi") >= 2, F.stddev_pop("ioi") / F.avg("ioi")).alias("cv"))


def trial_descriptives(taps: DataFrame, keys: Sequence[str] = TRIAL) -> DataFrame:
    """Taps, median interval in seconds and variation of each trial; a single interval varies by 0, a single tap by nothing."""
    t = with_intervals(taps, keys)
    cv = F.when(F.avg("ioi") > 0, F.stddev_pop("ioi") / F.avg("ioi"))
    return t.groupBy(*keys).agg(F.count("*").alias("n_taps"), (F.median("ioi") / SECOND).alias("median_ioi_s"), cv.alias("ioi_cv"))


def descriptives_by(trials: DataFrame, group: str) -> DataFrame:
    """Trials and participants of each group, and what their descriptives are on the whole; trials: as ``trial_descriptives`` gives them, with the group."""
    return trials.groupBy(group).agg(F.count("*").alias("n_trials"), F.count_distinct("participant").alias("n_participants"), F.avg("n_taps").alias("mean_n_taps"), F.median("median_ioi_s").alias("median_ioi_s"), F.avg("ioi_cv").alias("mean_ioi_cv"))


def described(rows: DataFrame, value: str) -> DataFrame:
    """One row: number, mean, sample deviation, least, quartiles (interpolated) and greatest."""
    q = [F.percentile(value, F.lit(p)).alias(f"p{round(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return rows.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("least"), *q, F.max(value).alias("greatest"))


def tempo(taps: DataFrame, least_ioi_us: int = 50_000) -> DataFrame:
    """Beats a minute from the median of intervals over ``least_ioi_us``."""
    t = with_intervals(taps).where(F.col("ioi") > least_ioi_us)
    return t.groupBy(*TRIAL).agg((60.0 * SECOND / F.median("ioi")).alias("bpm"))


def tempo_gate(taps: DataFrame, bpm: DataFrame, tolerance: float) -> DataFrame:
    """Trials whose tempo lies within ``tolerance`` of their stem's; bpm: (stem_id, target)."""
    return tempo(taps).join(bpm, "stem_id").where(F.abs(F.col("bpm") - F.col("target")) / F.col("target") <= tolerance)


def coherence(taps: DataFrame, keys: Sequence[str] = ("stem_id",), least_taps: int = 0, least_participants: int = 0) -> DataFrame:
    """Mean over 30 seconds of the most participants in one 100 ms bin, bins every 50 ms, both ends closed.

    A tap is dealt to its two or three bins by arithmetic: no range join.
    """
    if least_taps:
        enough = taps.groupBy(*keys, "participant").agg(F.count("*").alias("n")).where(F.col("n") >= least_taps).drop("n")
        taps = taps.join(enough, [*keys, "participant"], "left_semi")
    bins = F.sequence(F.ceil((F.col("tap_us") - 50_000) / 50_000.0), F.floor((F.col("tap_us") + 50_000) / 50_000.0))
    hits = taps.select(*keys, "participant", F.explode(bins).alias("bin")).where("bin between 0 and 599").distinct()
    per_bin = hits.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    per_second = per_bin.groupBy(*keys, F.floor(F.col("bin") / 20).alias("second")).agg(F.max("n").alias("n"))
    out = per_second.groupBy(*keys).agg((F.sum("n") / 30.0).alias("istc"))
    who = taps.groupBy(*keys).agg(F.count_distinct("participant").alias("n_participants"))
    out = who.join(out, list(keys), "left")
    return out.withColumn("istc", F.when(F.col("n_participants") >= least_participants, F.coalesce("istc", F.lit(0.0)))) if least_participants else out.withColumn("istc", F.coalesce("istc", F.lit(0.0)))


def pooled_density(taps: DataFrame, step_us: int = 5_000, width_us: int = 80_000, reach: int = 8, stop_us: int = 30 * SECOND) -> DataFrame:
    """Sum of Gaussian densities (per second) of all taps of a stem on a regular grid.

    Taps meet only grid points within ``reach`` widths; equal tap times are
    counted first, so the fan-out follows distinct times, not taps.
    """
    counted = taps.groupBy("stem_id", "tap_us").agg(F.count("*").alias("n"))
    first = F.greatest(F.lit(0), F.ceil((F.col("tap_us") - reach * width_us) / float(step_us)).cast("int"))
    last = F.least(F.lit(stop_us // step_us), F.floor((F.col("tap_us") + reach * width_us) / float(step_us)).cast("int"))
    z = (F.col("g") * step_us - F.col("tap_us")) / float(width_us)
    near = counted.select("stem_id", "tap_us", "n", F.explode(F.sequence(first, last)).alias("g"))
    norm = 1.0 / (width_us / SECOND * np.sqrt(2 * np.pi))
    return near.groupBy("stem_id", "g").agg((F.sum(F.col("n") * F.exp(-0.5 * z * z)) * float(norm)).alias("density"))


def local_maxima(density: DataFrame) -> DataFrame:
    """Grid points higher than the one before and not lower than the one after."""
    w = Window.partitionBy("stem_id").orderBy("g")
    d = density.withColumns({"before": F.lag("density").over(w), "after": F.lead("density").over(w)})
    return d.where((F.col("density") > F.col("before")) & (F.col("density") >= F.col("after"))).select("stem_id", "g", "density")


def tap_histogram(taps: DataFrame, step_us: int = 5_000) -> DataFrame:
    """Per stem and 5 ms bin: the participants' normalised histograms added up."""
    own = taps.groupBy(*TRIAL, F.floor(F.col("tap_us") / step_us).alias("bin")).agg(F.count("*").alias("n"))
    total = Window.partitionBy(*TRIAL)
    return own.withColumn("share", F.col("n") / F.sum("n").over(total)).groupBy("stem_id", "bin").agg(F.sum("n").alias("n_taps"), F.sum("share").alias("weight"))


def train_autocorrelation(events: DataFrame, step_us: int = 5_000, max_lag: int = 400) -> DataFrame:
    """Pairs of occupied bins at each lag; an equi-join on 2 s blocks, never all pairs."""
    b = events.select("stem_id", F.floor(F.col("tap_us") / step_us).cast("int").alias("bin")).distinct()
    left = b.select("stem_id", "bin", F.explode(F.array(F.floor(F.col("bin") / max_lag), F.floor(F.col("bin") / max_lag) + 1)).alias("block"))
    right = b.select("stem_id", F.col("bin").alias("later"), F.floor(F.col("bin") / max_lag).alias("block"))
    lag = F.col("later") - F.col("bin")
    pairs = left.join(right, ["stem_id", "block"]).where(lag.between(0, max_lag)).groupBy("stem_id", lag.alias("lag")).agg(F.count("*").alias("n_pairs"))
    return pairs.withColumn("acf", F.col("n_pairs") / F.max("n_pairs").over(Window.partitionBy("stem_id")))
