"""Nearest joins, matchings, metrics, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import grid as G
from ..operators import grouped
from ..operators import matching as M
from .mapping import ESTS, REFS, TAPPED_ESTS, TAPPED_REFS, TAPS, estimates, references, tapped_estimates, tapped_references, taps
from .registry import query

R6 = "round_even(({}) * 1e6, 0) / 1e6"
NEAR = "(SELECT {cols}, {t} AS t_us, arg_min(b.beat_us, abs({t} - b.beat_us) * 100000000 + b.beat_us) AS nearest_us FROM {a} a JOIN {b} b ON a.stem_id = b.stem_id GROUP BY ALL)"
TAP_NEAR = f"WITH {TAPS}, {TAPPED_REFS}, n AS {NEAR.format(cols='a.stem_id, a.participant, a.event_id', t='a.tap_us', a='taps', b='refs')}"


def tap_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taps(spark, sf_dir).select("stem_id", "participant", "event_id", F.col("tap_us").alias("t_us"))


@query(f"{TAP_NEAR} SELECT stem_id, event_id, nearest_us, t_us - nearest_us AS off_us FROM n")
def hit_miss_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest reference beat of every tap, the earlier of two equally near."""
    return M.nearest(tap_events(spark, sf_dir), tapped_references(spark, sf_dir), ["stem_id"]).select("stem_id", "event_id", "nearest_us", "off_us")


@query(f"{TAP_NEAR}, h AS (SELECT *, CASE WHEN abs(t_us - nearest_us) <= 70000 THEN t_us - nearest_us END AS off FROM n) SELECT stem_id, participant, count(*) AS n_taps, count(off) AS n_hits, {R6.format('avg(off)')} AS mean_off_us, {R6.format('CASE WHEN count(off) = 1 THEN 0.0 ELSE stddev_samp(off) END')} AS sd_off_us FROM h GROUP BY 1, 2")
def trial_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = M.hit_rates(tap_events(spark, sf_dir), tapped_references(spark, sf_dir), ["stem_id"], 70_000, ["stem_id", "participant"])
    return h.withColumns({c: X.half_even(F.col(c), 6) for c in ("mean_off_us", "sd_off_us")})


ALIGN = f"count(*) AS n, {R6.format('avg(CASE WHEN abs(t_us - nearest_us) <= 70000 THEN 1.0::DOUBLE ELSE 0 END)')} AS hit_rate, {R6.format('avg(t_us - nearest_us)')} AS mean_us, {R6.format('avg(abs(t_us - nearest_us))')} AS mean_abs_us, median(abs(t_us - nearest_us)) AS median_abs_us, round_even(stddev_samp(t_us - nearest_us) * 1e3, 0) / 1e3 AS sd_us, round_even(sqrt(avg(CAST(t_us - nearest_us AS DOUBLE) * (t_us - nearest_us))) * 1e3, 0) / 1e3 AS rms_us"


def rounded_alignment(a: DataFrame) -> DataFrame:
    return a.withColumns({c: X.half_even(F.col(c), 6) for c in ("hit_rate", "mean_us", "mean_abs_us")} | {c: X.half_even(F.col(c), 3) for c in ("sd_us", "rms_us")})


@query(f"{TAP_NEAR} SELECT stem_id, {ALIGN} FROM n GROUP BY 1")
def tap_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_alignment(M.alignment(tap_events(spark, sf_dir), tapped_references(spark, sf_dir), ["stem_id"], 70_000))


@query(f"WITH {ESTS}, n AS {NEAR.format(cols='a.stem_id, a.k', t='a.beat_us', a='ests', b='refs')} SELECT stem_id, {ALIGN} FROM n GROUP BY 1")
def peak_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = estimates(spark, sf_dir).select("stem_id", F.col("beat_us").alias("t_us"))
    return rounded_alignment(M.alignment(e, references(spark, sf_dir), ["stem_id"], 70_000))


def f_sql(tolerance: int) -> str:
    a, b = NEAR.format(cols="a.stem_id, a.k", t="a.beat_us", a="ests", b="refs"), NEAR.format(cols="a.stem_id, a.k", t="a.beat_us", a="refs", b="ests")
    return f"WITH {ESTS}, p AS (SELECT stem_id, count(*) AS n_predicted, count(*) FILTER (abs(t_us - nearest_us) <= {tolerance}) / count(*)::DOUBLE AS prec FROM {a} GROUP BY 1), r AS (SELECT stem_id, count(*) AS n_reference, count(*) FILTER (abs(t_us - nearest_us) <= {tolerance}) / count(*)::DOUBLE AS rec FROM {b} GROUP BY 1) SELECT stem_id, n_predicted, n_reference, {R6.format('prec')} AS precision, {R6.format('rec')} AS recall, {R6.format('CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END')} AS f FROM p JOIN r USING (stem_id)"


def f_rounded(spark: SparkSession, sf_dir: str, tolerance: int) -> DataFrame:
    f = M.f_measure(estimates(spark, sf_dir), references(spark, sf_dir), ["stem_id"], tolerance)
    return f.withColumns({c: X.half_even(F.col(c), 6) for c in ("precision", "recall", "f")})


@query(f_sql(70_000))
def f_measure_70(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f_rounded(spark, sf_dir, 70_000)


@query(f_sql(120_000))
def f_measure_120(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f_rounded(spark, sf_dir, 120_000)


MID = "SELECT stem_id, median(ioi) AS m, count(*) AS n FROM (SELECT stem_id, beat_us - lag(beat_us) OVER (PARTITION BY stem_id ORDER BY beat_us) AS ioi FROM {0}) GROUP BY 1"
SHIFT = f"WITH {ESTS}, s AS (SELECT stem_id, r.k, shift_us, min(abs(e.beat_us + shift_us - r.beat_us)) AS d FROM ests e JOIN refs r USING (stem_id), (SELECT unnest(range(-250000, 250001, 5000)) AS shift_us) GROUP BY ALL), c AS (SELECT stem_id, shift_us, count(*) FILTER (d <= 70000) AS hits FROM s GROUP BY ALL), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem_id ORDER BY hits DESC, shift_us) AS r FROM c) WHERE r = 1), shifts AS (SELECT stem_id, CAST(CASE WHEN ok THEN shift_us ELSE 0 END AS INTEGER) AS shift_us, CASE WHEN ok THEN hits ELSE 0 END AS hits FROM (SELECT b.*, coalesce(x.m > 0 AND y.m > 0 AND greatest(x.m, y.m) / least(x.m, y.m)::DOUBLE <= 1.1::DOUBLE, false) AS ok FROM best b JOIN ({MID.format('ests')}) x USING (stem_id) JOIN ({MID.format('refs')}) y USING (stem_id)))"


@query(f"{SHIFT} SELECT stem_id, shift_us, hits FROM shifts")
def phase_aligned_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.best_shift(estimates(spark, sf_dir), references(spark, sf_dir), ["stem_id"])


MOVED = SHIFT + ", moved AS (SELECT stem_id, beat_us + shift_us AS beat_us FROM ests JOIN shifts USING (stem_id)), " + ", ".join(f"{n} AS (SELECT p.stem_id, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f FROM (SELECT stem_id, avg((d <= 70000)::INT) AS prec FROM (SELECT a.stem_id, a.beat_us, min(abs(a.beat_us - b.beat_us)) AS d FROM {t} a JOIN refs b USING (stem_id) GROUP BY 1, 2) GROUP BY 1) p JOIN (SELECT stem_id, avg((d <= 70000)::INT) AS rec FROM (SELECT a.stem_id, a.beat_us, min(abs(a.beat_us - b.beat_us)) AS d FROM refs a JOIN {t} b USING (stem_id) GROUP BY 1, 2) GROUP BY 1) q USING (stem_id))" for n, t in (("f0", "ests"), ("f1", "moved")))


@query(f"{MOVED} SELECT stem_id, {R6.format('f0.f')} AS f, {R6.format('f1.f')} AS f_aligned, shift_us FROM f0 JOIN f1 USING (stem_id) JOIN shifts USING (stem_id)")
def phase_aligned_f(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = M.phase_aligned_f(estimates(spark, sf_dir), references(spark, sf_dir), ["stem_id"])
    return f.withColumns({c: X.half_even(F.col(c), 6) for c in ("f", "f_aligned")})


PERIODS = f"WITH {ESTS}, pr AS (SELECT stem_id, median(ioi) AS ref_us FROM (SELECT stem_id, beat_us - lag(beat_us) OVER (PARTITION BY stem_id ORDER BY beat_us) AS ioi FROM refs) GROUP BY 1), pe AS (SELECT stem_id, median(ioi) * (CASE WHEN stem_id LIKE '%3' THEN 2.0 WHEN stem_id LIKE '%7' THEN 0.5 ELSE 1.0 END) AS est_us FROM (SELECT stem_id, beat_us - lag(beat_us) OVER (PARTITION BY stem_id ORDER BY beat_us) AS ioi FROM ests) GROUP BY 1)"


def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(b: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("stem_id").orderBy("beat_us")
        return b.withColumn("ioi", F.col("beat_us") - F.lag("beat_us").over(w)).groupBy("stem_id").agg(F.median("ioi").alias(name))

    e = of(estimates(spark, sf_dir), "est_us").withColumn("est_us", F.col("est_us") * F.when(F.col("stem_id").endswith("3"), 2.0).when(F.col("stem_id").endswith("7"), 0.5).otherwise(1.0))
    return of(references(spark, sf_dir), "ref_us").join(e, "stem_id")


@query(f"{PERIODS} SELECT stem_id, ref_us, est_us, {R6.format('est_us / ref_us')} AS ratio, CASE WHEN abs(est_us / ref_us - 1) <= 0.05 THEN 'same' WHEN abs(est_us / ref_us - 0.5) <= 0.05 THEN 'double' WHEN abs(est_us / ref_us - 2) <= 0.10 THEN 'half' WHEN abs(est_us / ref_us - 1.5) <= 0.05 OR abs(est_us / ref_us - 2.0::DOUBLE / 3) <= 0.05 THEN 'triplet/2' ELSE 'other' END AS relation, CASE WHEN est_us / ref_us BETWEEN 0.35 AND 0.65 THEN 'double' WHEN est_us / ref_us BETWEEN 0.80 AND 1.25 THEN 'matched' WHEN est_us / ref_us BETWEEN 1.75 AND 2.25 THEN 'half' ELSE 'other' END AS panel_class, CASE WHEN abs(log2(est_us / ref_us)) < 0.15 THEN 'match' WHEN abs(log2(est_us / ref_us) - 1) < 0.15 THEN 'half' WHEN abs(log2(est_us / ref_us) + 1) < 0.15 THEN 'double' ELSE 'other_flip' END AS octave, abs(est_us - 280000) <= 1000 OR abs(est_us - 1250000) <= 1000 AS at_bound FROM pr JOIN pe USING (stem_id)")
def period_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period ratio in the three classifications, and whether the period lies at a search bound."""
    r = F.col("est_us") / F.col("ref_us")
    at = (F.abs(F.col("est_us") - 280_000) <= 1000) | (F.abs(F.col("est_us") - 1_250_000) <= 1000)
    return periods(spark, sf_dir).select("stem_id", "ref_us", "est_us", X.half_even(r, 6).alias("ratio"), X.metric_relation(F.col("ref_us"), F.col("est_us")).alias("relation"), X.ratio_class(r).alias("panel_class"), X.octave_class(r).alias("octave"), at.alias("at_bound"))


SHORT = f"WITH {ESTS}, p AS (SELECT stem_id, beat_us + (k % 3) * 130000 AS tap_us FROM ests), d AS (SELECT stem_id, tap_us, tap_us - lag(tap_us) OVER (PARTITION BY stem_id ORDER BY tap_us) AS ioi FROM p), t AS (SELECT stem_id, 400000 + 50000 * ord AS period_us FROM stems)"


def uneven_peaks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    peaks = estimates(spark, sf_dir).select("stem_id", (F.col("beat_us") + (F.col("k") % 3) * 130_000).alias("tap_us"))
    period = references(spark, sf_dir).groupBy("stem_id").agg((400_000 + 50_000 * F.max("ord")).alias("period_us"))
    return peaks, period


@query(f"{SHORT}, s AS (SELECT d.stem_id, period_us, ioi, ioi - lag(ioi) OVER (PARTITION BY d.stem_id ORDER BY ioi) AS gap FROM d JOIN t USING (stem_id) WHERE ioi < 0.9 * period_us), g AS (SELECT stem_id, count(*) AS n_short, max(gap) / max(period_us)::DOUBLE AS score FROM s GROUP BY 1), n AS (SELECT stem_id, count(*) AS n_peaks FROM p GROUP BY 1) SELECT stem_id, n_peaks, coalesce(n_short, 0) AS n_short, {R6.format('CASE WHEN n_peaks >= 8 AND n_short >= 3 THEN coalesce(score, 0) ELSE 0 END')} AS score FROM n LEFT JOIN g USING (stem_id)")
def bimodal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bimodal_score(*uneven_peaks(spark, sf_dir)).withColumn("score", X.half_even(F.col("score"), 6))


@query(f"{SHORT}, c AS (SELECT stem_id, count(*) FILTER (ioi / period_us::DOUBLE > 0.4 AND ioi / period_us::DOUBLE < 0.6) AS n_half, count(*) FILTER (ioi / period_us::DOUBLE > 1.7 AND ioi / period_us::DOUBLE < 2.3) AS n_double, count(*) FILTER (ioi / period_us::DOUBLE > 0.85 AND ioi / period_us::DOUBLE < 1.15) AS n_base FROM d JOIN t USING (stem_id) WHERE ioi IS NOT NULL GROUP BY 1) SELECT stem_id, n_half, n_double, n_base, {R6.format('CASE WHEN n_base > 0 THEN greatest(n_half, n_double) / n_base::DOUBLE END')} AS strength, coalesce(n_base > 0 AND greatest(n_half, n_double) / n_base::DOUBLE >= 0.4, false) AS flag FROM c")
def bimodal_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bimodal_strength(*uneven_peaks(spark, sf_dir)).withColumn("strength", X.half_even(F.col("strength"), 6))


@query(f"{SHORT}, a AS (SELECT stem_id, tap_us, coalesce(lead(tap_us) OVER (PARTITION BY stem_id ORDER BY tap_us) - tap_us <= 500000, false) AS short FROM p), r AS (SELECT *, coalesce(sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY stem_id ORDER BY tap_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM a), i AS (SELECT stem_id, row_number() OVER (PARTITION BY stem_id, run ORDER BY tap_us) AS i FROM r) SELECT stem_id, CASE WHEN i % 2 = 1 THEN 'A' ELSE 'B' END AS phase_group, count(*) AS n FROM i GROUP BY ALL")
def bimodal_split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    peaks, period = uneven_peaks(spark, sf_dir)
    t = period.select("stem_id", F.lit(500_000).alias("threshold_us"))
    return G.phase_groups(peaks, t).groupBy("stem_id", "phase_group").agg(F.count("*").alias("n"))


COVER = "g AS (SELECT 300000 + 50000 * i AS period_us, (300000 + 50000 * i) * j // 12 AS phase_us FROM (SELECT unnest(range(12)) AS i), (SELECT unnest(range(12)) AS j)), x AS (SELECT stem_id, period_us, phase_us, beat_us, greatest(ceil(-phase_us / period_us::DOUBLE), least(floor((30000000 - phase_us) / period_us::DOUBLE), round_even((beat_us - phase_us) / period_us::DOUBLE, 0))) AS k FROM ests, g), cov AS (SELECT stem_id, period_us, phase_us, count(*) AS n, count(*) FILTER (abs(beat_us - (phase_us + k * period_us)) <= 0.12 * period_us + 20000) AS n_near FROM x GROUP BY ALL)"
COUNTED = "cells AS (SELECT s.stem_id, g, count(e.beat_us)::DOUBLE AS y FROM (SELECT stem_id, unnest(range(0, 300)) AS g FROM stems) s LEFT JOIN ests e ON e.stem_id = s.stem_id AND floor(e.beat_us / 100000.0::DOUBLE) = g GROUP BY 1, 2), cv AS (SELECT stem_id, g, y / (max(y) OVER (PARTITION BY stem_id) + 1e-12) AS y, lead(y) OVER (PARTITION BY stem_id ORDER BY g) / (max(y) OVER (PARTITION BY stem_id) + 1e-12) AS later FROM cells), pt AS (SELECT stem_id, period_us, phase_us, phase_us + unnest(range(0, CAST(floor((30000000 - phase_us) / period_us::DOUBLE) AS BIGINT) + 1)) * period_us AS t FROM (SELECT DISTINCT stem_id FROM ests), g), den AS (SELECT pt.stem_id, period_us, phase_us, avg(coalesce(CASE WHEN t % 100000 = 0 THEN y ELSE y + (later - y) * (t % 100000) / 100000.0::DOUBLE END, 0)) AS density FROM pt LEFT JOIN cv ON cv.stem_id = pt.stem_id AND cv.g = t // 100000 GROUP BY ALL)"


@query(f"WITH {ESTS}, {COVER}, {COUNTED} SELECT stem_id, period_us, phase_us, n, n_near, {R6.format('n_near / n::DOUBLE')} AS coverage, {R6.format('density')} AS density, {R6.format('density + 0.5 * n_near / n::DOUBLE')} AS score FROM cov JOIN den USING (stem_id, period_us, phase_us)")
def grid_score_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole scores of 144 grids: density on the grid, from counts in steps of 100 ms, and share of peaks near it."""
    peaks = estimates(spark, sf_dir).select("stem_id", F.col("beat_us").alias("tap_us"))
    s = G.grid_scores(peaks, 300_000, 50_000, 12, 12, curve_step_us=STEP, counted=300)
    return s.withColumns({c: X.half_even(F.col(c), 6) for c in ("coverage", "density", "score")})


@query(f"WITH {ESTS}, g AS (SELECT 280000 + 8151 * i AS t, j FROM (SELECT unnest(range(120)) AS i), (SELECT unnest(range(240)) AS j)), x AS (SELECT stem_id, t, j, 240 * beat_us - t * j AS d, (7200000000 - t * j) // (240 * t) AS top FROM ests, g), c AS (SELECT stem_id, t, j, count(*) FILTER (5 * abs(d - 240 * t * greatest(0, least(top, CAST(round(d / (240.0::DOUBLE * t)) AS BIGINT)))) <= 144 * t + 24000000) AS n_near FROM x GROUP BY ALL) SELECT stem_id, CAST(t AS BIGINT) AS period_us, CAST(j AS INTEGER) AS phase, CAST(n_near AS BIGINT) AS n_near FROM (SELECT *, row_number() OVER (PARTITION BY stem_id ORDER BY n_near DESC, t, j) AS r FROM c) WHERE r = 1")
def coverage_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of 120 periods and 240 phases by the share of peaks near the grid."""
    return G.coverage_search(estimates(spark, sf_dir).select("stem_id", F.col("beat_us").alias("tap_us")))


def refine_sql() -> str:
    out = [f"WITH {ESTS}, f0 AS (SELECT stem_id, CAST(410000 + 50000 * ord AS DOUBLE) AS period, CAST(90000 * ord AS DOUBLE) AS phase FROM stems)"]
    for i in range(3):
        out.append(f"n{i} AS (SELECT stem_id, count(*) AS n, regr_slope(CAST(beat_us AS DOUBLE), k) AS slope, regr_intercept(CAST(beat_us AS DOUBLE), k) AS inter FROM (SELECT e.stem_id, beat_us, period, phase, round_even((beat_us - phase) / period, 0) AS k FROM ests e JOIN f{i} USING (stem_id)) WHERE abs(beat_us - phase - k * period) <= 0.15 * period GROUP BY 1), f{i + 1} AS (SELECT stem_id, CASE WHEN n >= 3 AND slope >= 100000 THEN slope ELSE period END AS period, CASE WHEN n >= 3 AND slope >= 100000 THEN inter ELSE phase END AS phase FROM f{i} LEFT JOIN n{i} USING (stem_id))")
    return ", ".join(out) + " SELECT stem_id, round_even(period, 2) AS period_us, round_even(phase, 1) AS phase_us FROM f3"


@query(refine_sql())
def ls_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = references(spark, sf_dir).groupBy("stem_id").agg((410_000 + 50_000 * F.max("ord")).alias("period_us"), (90_000 * F.max("ord")).alias("phase_us"))
    peaks = estimates(spark, sf_dir).select("stem_id", F.col("beat_us").alias("tap_us"))
    return G.refine(peaks, start).select("stem_id", X.half_even(F.col("period"), 2).alias("period_us"), X.half_even(F.col("phase"), 1).alias("phase_us"))


@query(f"WITH {ESTS}, n AS {NEAR.format(cols='a.stem_id, a.ord, a.k', t='a.beat_us', a='refs', b='ests')} SELECT stem_id, k, round_even(CASE WHEN abs(nearest_us - t_us) <= 0.12 * (400000 + 50000 * ord) THEN t_us + 0.45::DOUBLE * (nearest_us - t_us) ELSE t_us END, 3) AS snapped_us FROM n")
def snap_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    beats = references(spark, sf_dir).select("stem_id", "k", (400_000 + 50_000 * F.col("ord")).alias("period_us"), F.col("beat_us").alias("t_us"))
    near = M.nearest(beats, estimates(spark, sf_dir), ["stem_id"])
    return G.snap(beats, near).select("stem_id", "k", X.half_even(F.col("snapped_us"), 3).alias("snapped_us"))


@query(f"WITH {REFS}, b AS (SELECT stem_id, beat_us FROM refs WHERE k % 7 NOT IN (3, 4)), g AS (SELECT *, lead(beat_us) OVER (PARTITION BY stem_id ORDER BY beat_us) - beat_us AS gap FROM b), p AS (SELECT stem_id, median(gap) AS period FROM g GROUP BY 1), n AS (SELECT stem_id, beat_us, gap, greatest(1, CAST(round_even(gap / period, 0) AS INTEGER) - 1) AS n, period FROM g JOIN p USING (stem_id)), a AS (SELECT stem_id, beat_us, gap, n, unnest(range(1, n + 1)) AS i FROM n WHERE gap > 1.4 * period AND gap / (n + 1)::DOUBLE >= 0.75 * period) SELECT stem_id, round_even(CAST(beat_us AS DOUBLE), 3) AS beat_us, false AS added FROM b UNION ALL SELECT stem_id, round_even(beat_us + gap * i / (n + 1)::DOUBLE, 3), true FROM a")
def fill_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = references(spark, sf_dir).where("k % 7 not in (3, 4)").select("stem_id", "beat_us")
    return G.fill_gaps(b).withColumn("beat_us", X.half_even(F.col("beat_us"), 3))


@query(f"WITH {ESTS}, m AS (SELECT stem_id, k, (beat_us + lead(beat_us) OVER (PARTITION BY stem_id ORDER BY beat_us)) / 2.0::DOUBLE AS mid_us FROM refs) SELECT m.stem_id, m.k, round_even(mid_us, 1) AS mid_us, min(abs(mid_us - e.beat_us)) <= 90000 AS supported FROM m JOIN ests e USING (stem_id) WHERE mid_us IS NOT NULL GROUP BY ALL")
def midpoint_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("stem_id").orderBy("beat_us")
    m = references(spark, sf_dir).withColumn("mid", (F.col("beat_us") + F.lead("beat_us").over(w)) / 2).where("mid is not null")
    events = m.select("stem_id", "k", F.col("mid").alias("t_us"))
    beats = estimates(spark, sf_dir).select("stem_id", F.col("beat_us").cast("double").alias("beat_us"))
    near = M.nearest(events, beats, ["stem_id"])
    return near.select("stem_id", "k", X.half_even(F.col("t_us"), 1).alias("mid_us"), (F.abs("off_us") <= 90_000).alias("supported"))


@query(f"WITH {ESTS}, d AS (SELECT stem_id, beat_us, (beat_us - lag(beat_us) OVER (PARTITION BY stem_id ORDER BY beat_us)) / 1000.0::DOUBLE AS ioi FROM ests), i AS (SELECT stem_id, ioi, row_number() OVER (PARTITION BY stem_id ORDER BY beat_us) AS i FROM d WHERE ioi IS NOT NULL), r AS (SELECT a.stem_id, a.i AS first, b.i - a.i + 2 AS n, stddev_pop(c.ioi) / avg(c.ioi) AS cv FROM i a JOIN i b ON a.stem_id = b.stem_id AND b.i - a.i + 1 >= 5 JOIN i c ON c.stem_id = a.stem_id AND c.i BETWEEN a.i AND b.i GROUP BY ALL), s AS (SELECT *, n * exp(-cv / 0.05) AS score FROM r WHERE cv <= 0.15) SELECT stem_id, CAST(first AS INTEGER) AS first, CAST(n AS INTEGER) AS n, round_even(cv, 5) AS cv FROM (SELECT *, row_number() OVER (PARTITION BY stem_id ORDER BY round(score, 9) DESC, n, first) AS k FROM s) WHERE k = 1")
def confident_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.steady_runs(estimates(spark, sf_dir)).select("stem_id", F.col("first").cast("int").alias("first"), F.col("n").cast("int").alias("n"), X.half_even(F.col("cv"), 5).alias("cv"))


NEAR_PAIRS = "pr AS (SELECT r.stem_id, r.beat_us AS a, e.beat_us AS b, abs(r.beat_us - e.beat_us) AS d FROM refs r JOIN ests e USING (stem_id) WHERE abs(r.beat_us - e.beat_us) <= 70000), g AS (SELECT stem_id, [a] AS ua, [b] AS ub FROM pr QUALIFY row_number() OVER (PARTITION BY stem_id ORDER BY d, a, b) = 1 UNION ALL (SELECT g.stem_id, list_append(ua, pr.a) AS ua, list_append(ub, pr.b) AS ub FROM g JOIN pr ON g.stem_id = pr.stem_id WHERE NOT list_contains(ua, pr.a) AND NOT list_contains(ub, pr.b) QUALIFY row_number() OVER (PARTITION BY g.stem_id ORDER BY d, a, b) = 1)), gp AS (SELECT stem_id, unnest(ua) AS a_us, unnest(ub) AS b_us FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY stem_id ORDER BY len(ua) DESC) = 1))"


@query(f"WITH RECURSIVE {ESTS}, {NEAR_PAIRS} SELECT stem_id, a_us, b_us FROM gp")
def greedy_match_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.greedy_pairs(references(spark, sf_dir), estimates(spark, sf_dir), ["stem_id"])


SWEEP = "li AS (SELECT * FROM (SELECT stem_id, list(beat_us ORDER BY beat_us) AS x FROM refs GROUP BY 1) JOIN (SELECT stem_id, list(beat_us ORDER BY beat_us) AS y FROM ests GROUP BY 1) USING (stem_id)), sw AS (SELECT stem_id, 1 AS i, 1 AS j, 0 AS n FROM li UNION ALL SELECT sw.stem_id, i + (abs(x[i] - y[j]) <= 70000 OR x[i] < y[j])::INT, j + (abs(x[i] - y[j]) <= 70000 OR x[i] > y[j])::INT, n + (abs(x[i] - y[j]) <= 70000)::INT FROM sw JOIN li ON sw.stem_id = li.stem_id WHERE i <= len(x) AND j <= len(y))"


@query(f"WITH RECURSIVE {ESTS}, {NEAR_PAIRS}, {SWEEP}, ng AS (SELECT stem_id, count(*) AS n_greedy, {R6.format('median(b_us - a_us) / 1e6::DOUBLE')} AS median_offset_s FROM gp GROUP BY 1), nm AS (SELECT sw.stem_id, CAST(max(n) AS BIGINT) AS n_maximum, any_value(len(x) + len(y)) AS total FROM sw JOIN li USING (stem_id) GROUP BY 1) SELECT stem_id, coalesce(n_greedy, 0) AS n_greedy, n_maximum, {R6.format('2 * n_maximum / total::DOUBLE')} AS f_maximum, median_offset_s FROM nm LEFT JOIN ng USING (stem_id)")
def greedy_and_maximum_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.matchings(references(spark, sf_dir), estimates(spark, sf_dir), ["stem_id"])
    return m.withColumns({c: X.half_even(F.col(c), 6) for c in ("f_maximum", "median_offset_s")})


@query()
def beat_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped.beat_metrics(references(spark, sf_dir), estimates(spark, sf_dir))


STEP = 100_000
CURVE = f"curve AS (SELECT s.stem_id, g, count(t.tap_us)::DOUBLE AS y FROM (SELECT stem_id, unnest(range(0, 300)) AS g FROM stems) s LEFT JOIN taps t ON t.stem_id = s.stem_id AND t.tap_us // {STEP} = g GROUP BY 1, 2), slopes AS (SELECT stem_id, g, y / (max(y) OVER (PARTITION BY stem_id) + 1e-12) AS y, lead(y) OVER (PARTITION BY stem_id ORDER BY g) / (max(y) OVER (PARTITION BY stem_id) + 1e-12) AS later FROM curve)"
VALUE = f"CASE WHEN g IS NULL THEN 0 WHEN e.beat_us % {STEP} = 0 THEN y ELSE coalesce(y + (later - y) * (e.beat_us % {STEP}) / {STEP}.0::DOUBLE, 0) END"
AT = f"placed AS (SELECT e.stem_id, e.k, e.beat_us, {VALUE} AS density FROM ests e LEFT JOIN slopes l ON l.stem_id = e.stem_id AND l.g = floor(e.beat_us / {STEP}.0::DOUBLE))"


def density_at_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated beats with the density of taps there, from counts in steps of 100 ms."""
    every = tapped_references(spark, sf_dir).select("stem_id").distinct().withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(299).cast("long"))))
    n = taps(spark, sf_dir).groupBy("stem_id", F.floor(F.col("tap_us") / STEP).alias("g")).agg(F.count("*").alias("n"))
    curve = every.join(n, ["stem_id", "g"], "left").select("stem_id", "g", F.coalesce("n", F.lit(0)).cast("double").alias("y"))
    return G.interpolated(tapped_estimates(spark, sf_dir).select("stem_id", "k", F.col("beat_us").alias("t_us")), curve, STEP, "density")


@query(f"WITH {TAPS}, {TAPPED_ESTS}, {CURVE}, {AT} SELECT stem_id, k, beat_us AS t_us, round_even(density * 1e9, 0) / 1e9 AS density FROM placed")
def interpolated_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_at_beats(spark, sf_dir).withColumn("density", X.half_even(F.col("density"), 9))


@query(f"WITH {TAPS}, {TAPPED_ESTS}, {CURVE}, {AT}, near AS {NEAR.format(cols='a.stem_id, a.k', t='a.beat_us', a='ests', b='refs')}, d AS (SELECT a.stem_id, a.beat_us, density, (t_us - nearest_us) / 1e6::DOUBLE AS off, (a.beat_us - lag(a.beat_us) OVER w) AS ioi FROM placed a JOIN near n ON n.stem_id = a.stem_id AND n.k = a.k WINDOW w AS (PARTITION BY a.stem_id ORDER BY a.beat_us)), m AS (SELECT stem_id, median(ioi) AS target FROM d GROUP BY 1), c AS (SELECT stem_id, count(*) AS n_beats, avg(((ioi - target) / 1e6::DOUBLE) ** 2) AS c_interval, -avg(density) AS c_density, avg(off * off) AS c_peaks FROM d JOIN m USING (stem_id) GROUP BY 1) SELECT stem_id, n_beats, {R6.format('c_interval')} AS c_interval, {R6.format('c_density')} AS c_density, {R6.format('c_peaks')} AS c_peaks, {R6.format('CASE WHEN n_beats < 2 THEN 1e6 ELSE 2.0 * c_interval + 0.3 * c_density + 0.3 * c_peaks END')} AS cost FROM c")
def placement_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a free placement would minimise, for the estimated beats; the wanted interval is their median."""
    at = M.nearest(density_at_beats(spark, sf_dir), tapped_references(spark, sf_dir), ["stem_id"])
    w = Window.partitionBy("stem_id")
    gap = F.col("t_us") - F.lag("t_us").over(w.orderBy("t_us"))
    c = G.placement_cost(at.withColumn("gap", gap).withColumn("target_us", F.median("gap").over(w)), (2.0, 0.3, 0.3))
    return c.withColumns({n: X.half_even(F.col(n), 6) for n in ("c_interval", "c_density", "c_peaks", "cost")})


@query(f"WITH {ESTS}, b AS (SELECT stem_id, beat_us, row_number() OVER w AS i, lag(beat_us) OVER w AS before, lead(beat_us) OVER w AS later FROM ests WINDOW w AS (PARTITION BY stem_id ORDER BY beat_us)), p AS (SELECT stem_id, count(*) AS n, median(beat_us - before) AS period FROM b GROUP BY 1), m AS (SELECT stem_id, greatest(0, least(30000000, CASE WHEN before IS NULL OR later IS NULL THEN beat_us ELSE beat_us + greatest(-0.05::DOUBLE * period, least(0.05::DOUBLE * period, (before + later) / 2.0::DOUBLE - beat_us)) END)) AS moved FROM b JOIN p USING (stem_id)), o AS (SELECT stem_id, moved, row_number() OVER w AS i, moved - lag(moved) OVER w AS ioi FROM m WINDOW w AS (PARTITION BY stem_id ORDER BY moved)), f AS (SELECT stem_id, min(ioi) AS least_ioi, stddev_pop(ioi) / avg(ioi) AS cv FROM o GROUP BY 1) SELECT b.stem_id, b.i, CAST(b.beat_us AS DOUBLE) AS beat_us, round_even(CASE WHEN n >= 4 AND least_ioi >= 0.5 * period THEN moved ELSE b.beat_us END, 3) AS nudged_us, CASE WHEN n >= 4 AND least_ioi >= 0.5 * period THEN {R6.format('cv')} END AS cv FROM b JOIN p USING (stem_id) JOIN o ON o.stem_id = b.stem_id AND o.i = b.i JOIN f ON f.stem_id = b.stem_id")
def nudged_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = G.nudged(estimates(spark, sf_dir))
    return n.withColumns({"nudged_us": X.half_even(F.col("nudged_us"), 3), "cv": X.half_even(F.col("cv"), 6)})
