"""Operators along one stem's events: local periods, one event for each grid line, clip offsets, majority grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000
IOI_MIN, IOI_MAX = 280_000, 1_250_000


def local_intervals(peaks: DataFrame, period: DataFrame, samples: int = 60, stop_us: int = 30 * SECOND, reach_us: int = 3 * SECOND, smooth: int = 7, spread: float = 0.25) -> DataFrame:
    """Local interval at evenly spaced times: the median within ``reach_us`` on either side, smoothed, and held near the global period.

    An interval is dealt to the samples that see both its ends, by arithmetic.
    Intervals from 0.4 to 2.5 periods count, and two of them are needed;
    elsewhere the period stands.  Beyond the ends the smoothing repeats the
    first and the last sample.
    """
    step = stop_us / (samples - 1.0)
    w = Window.partitionBy("stem_id").orderBy("tap_us")
    d = peaks.withColumn("before", F.lag("tap_us").over(w)).where("before is not null").withColumn("ioi", F.col("tap_us") - F.col("before"))
    first = F.greatest(F.lit(0), F.ceil((F.col("tap_us") - reach_us) / step)).cast("int")
    last = F.least(F.lit(samples - 1), F.floor((F.col("before") + reach_us) / step)).cast("int")
    d = d.join(period, "stem_id").where(F.col("ioi").between(0.4 * F.col("period_us"), 2.5 * F.col("period_us")))
    near = d.where(first <= last).select("stem_id", "ioi", F.explode(F.sequence(first, last)).alias("i"))
    local = near.groupBy("stem_id", "i").agg(F.median("ioi").alias("mid"), F.count("*").alias("n")).where("n >= 2")
    grid = period.select("stem_id", "period_us", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("i"))
    x = grid.join(local, ["stem_id", "i"], "left").withColumn("x", F.coalesce("mid", F.col("period_us").cast("double")))
    half, every = smooth // 2, Window.partitionBy("stem_id").orderBy("i")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("x").over(every.rowsBetween(-half, half))
    total = total + F.greatest(F.lit(0), half - F.col("i")) * F.first("x").over(whole) + F.greatest(F.lit(0), F.col("i") + half - (samples - 1)) * F.last("x").over(whole)
    p = F.col("period_us")
    return x.select("stem_id", "i", F.greatest((1 - spread) * p, F.least((1 + spread) * p, total / smooth)).alias("local_us"))


def one_per_line(events: DataFrame) -> DataFrame:
    """Of the events at one grid line (stem_id, period_us, phase_us, tap_us) the nearest to it, the earlier of two."""
    k = F.rint((F.col("tap_us") - F.col("phase_us")) / F.col("period_us"))
    e = events.withColumn("k", k.cast("long")).withColumn("off", F.abs(F.col("tap_us") - (F.col("phase_us") + k * F.col("period_us"))))
    return e.groupBy("stem_id", "k").agg(F.min(F.struct("off", "tap_us")).alias("e")).select("stem_id", "k", F.col("e.tap_us").alias("tap_us"))


def majority_grid(peaks: DataFrame, tolerance_us: int = 40_000, phases: int = 36, least_share: float = 0.35) -> DataFrame:
    """Each stem's period and phase with the most peaks near, over candidates from the intervals' percentiles; of equals the shortest period, then phase.

    Only stems of three peaks, and of grids that three peaks and
    ``least_share`` of them agree on, have a row.
    """
    w = Window.partitionBy("stem_id").orderBy("tap_us")
    d = peaks.withColumn("ioi", F.col("tap_us") - F.lag("tap_us").over(w))
    near = F.when(F.col("ioi").between(0.35 * IOI_MIN, 2.5 * IOI_MAX), F.col("ioi"))
    base = d.groupBy("stem_id").agg(F.percentile(near, F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias("q"), F.median("ioi").alias("mid"), F.count("*").alias("n")).where("n >= 3")
    tried = F.array_distinct(F.filter(F.flatten(F.transform("q", lambda x: F.array(x * 0.5, x, x * 2.0))), lambda x: x.between(IOI_MIN, IOI_MAX)))
    lone = F.array(F.greatest(F.lit(float(IOI_MIN)), F.least(F.lit(float(IOI_MAX)), F.col("mid"))))
    grids = base.select("stem_id", "n", F.explode(F.when(F.size(F.coalesce(tried, F.array().cast("array<double>"))) > 0, tried).otherwise(lone)).alias("period_us")).select("stem_id", "n", "period_us", F.explode(F.sequence(F.lit(0), F.lit(phases - 1))).alias("j"))
    grids = grids.withColumn("phase_us", F.col("j") * (F.col("period_us") / phases))
    off = F.abs(F.col("tap_us") - (F.col("phase_us") + F.rint((F.col("tap_us") - F.col("phase_us")) / F.col("period_us")) * F.col("period_us")))
    scored = peaks.join(grids, "stem_id").groupBy("stem_id", "n", "period_us", "j", "phase_us").agg(F.count_if(off <= tolerance_us).alias("score"))
    best = scored.groupBy("stem_id", "n").agg(F.max_by(F.struct("period_us", "phase_us", "score"), F.struct("score", -F.col("period_us"), -F.col("j"))).alias("b"))
    return best.select("stem_id", "n", "b.*").where(F.col("score") >= F.greatest(F.lit(3.0), least_share * F.col("n")))


def majority_peaks(peaks: DataFrame, tolerance_us: int = 40_000) -> DataFrame:
    """The peaks on the majority grid, one for each of its lines; all of a stem that has none."""
    grid = majority_grid(peaks, tolerance_us)
    p = peaks.join(grid, "stem_id", "left")
    off = F.abs(F.col("tap_us") - (F.col("phase_us") + F.rint((F.col("tap_us") - F.col("phase_us")) / F.col("period_us")) * F.col("period_us")))
    return one_per_line(p.where(off <= tolerance_us)).select("stem_id", "tap_us").unionAll(p.where("period_us is null").select("stem_id", "tap_us"))


def following(events: DataFrame, beats: DataFrame, keys: list[str]) -> DataFrame:
    """Each event (``t_us``) with the first beat at or after it; slices of two seconds of the beats' own time."""
    slice_us = 2 * SECOND
    w = Window.partitionBy(*keys).orderBy("beat_us")
    b = beats.withColumn("from_us", F.coalesce(F.lag("beat_us").over(w) + 1, F.least(F.lit(0).cast("long"), F.col("beat_us")) - 40 * SECOND))
    dealt = b.withColumn("slice", F.explode(F.sequence(F.floor(F.col("from_us") / slice_us), F.floor(F.col("beat_us") / slice_us)))).select(*keys, "slice", F.col("beat_us").alias("t_us"), F.col("beat_us").alias("beat"))
    extra = [c for c in events.columns if c not in (*keys, "t_us")]
    u = events.select(*keys, F.floor(F.col("t_us") / slice_us).alias("slice"), "t_us", F.lit(None).cast("long").alias("beat"), *extra).unionByName(dealt, allowMissingColumns=True)
    after = F.min("beat").over(Window.partitionBy(*keys, "slice").orderBy(F.desc("t_us")).rangeBetween(Window.unboundedPreceding, 0))
    return u.withColumn("after_us", after).where("beat is null").select(*keys, "t_us", *extra, "after_us")


def clip_offset(local: DataFrame, upstream: DataFrame, keys: list[str], tolerance_us: int = 30_000, clip_us: int = 30 * SECOND, slack_us: int = 10_000) -> DataFrame:
    """Where a clip starts in its source: of the starts that put the clip's first beat on a source beat, the one that matches most beats; the earliest of equals.

    local and upstream: keys and ``beat_us``.  A clip beat matches if a source
    beat of the clip lies nearer than the tolerance.
    """
    first = local.groupBy(*keys).agg(F.min("beat_us").alias("first_us"))
    starts = upstream.join(first, keys).select(*keys, (F.col("beat_us") - F.col("first_us")).alias("start_us")).where("start_us >= -500000")
    tried = local.join(starts, keys).select(*keys, "start_us", (F.col("beat_us") + F.col("start_us")).alias("at_us"))
    events = tried.withColumn("t_us", F.greatest(F.col("at_us") - tolerance_us + 1, F.col("start_us") - slack_us))
    hit = F.col("after_us") <= F.least(F.col("at_us") + tolerance_us - 1, F.col("start_us") + clip_us + slack_us)
    counted = following(events, upstream, keys).groupBy(*keys, "start_us").agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("n_match"))
    return counted.groupBy(*keys).agg(F.max_by(F.struct("start_us", "n_match"), F.struct("n_match", -F.col("start_us"))).alias("b")).select(*keys, "b.*")


def median_offset(near: DataFrame, keys: list[str], tolerance_us: int = 150_000, consistent_us: int = 20_000) -> DataFrame:
    """Median signed distance of the events within the tolerance, and whether it is consistent; near: as ``matching.nearest`` gives it."""
    d = F.when(F.abs("off_us") <= tolerance_us, F.col("off_us"))
    m = near.groupBy(*keys).agg(F.median(d).alias("median_off_us"), F.count(d).alias("n_near"))
    return m.withColumn("consistent", F.coalesce(F.abs("median_off_us") >= consistent_us, F.lit(False)))


def circular_offset(near: DataFrame, keys: list[str], period: str) -> DataFrame:
    """Mean direction, in cycles of the period, of the events' distances to their nearest beat."""
    a = F.col("off_us") / F.col(period) * 2 * 3.141592653589793
    return near.groupBy(*keys).agg((F.atan2(F.avg(F.sin(a)), F.avg(F.cos(a))) / (2 * 3.141592653589793)).alias("phase_offset"))
