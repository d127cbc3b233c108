"""Stage reports, local periods, majority grids, clip offsets; kernels of periods, comparison and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import grid as G
from ..operators import grouped, local
from ..operators import inference as S
from ..operators import matching as M
from ..operators import timing as T
from ..operators.durable import durable
from .beat_queries import MID, NEAR, NEAR_PAIRS, SHORT, SWEEP, uneven_peaks
from .mapping import ESTS, REFS, TAPPED_ESTS, TAPPED_REFS, TAPS, estimates, references, stems, table, tapped_estimates, tapped_references, taps
from .panel_queries import panel_periods, trial_periods
from .registry import query
from .timing_queries import CLEAN, distinct_taps, find_peaks

R6 = "round_even(({}) * 1e6, 0) / 1e6"
STAGES = ("raw", "clean", "peaks", "peaks_shifted")


def stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, stem_id, t_us): raw taps, cleaned taps, and two sets of peaks."""
    raw = distinct_taps(spark, sf_dir).select(F.lit("raw").alias("stage"), "stem_id", F.col("tap_us").alias("t_us"))
    clean = T.cleaned_fast(taps(spark, sf_dir).select("stem_id", "participant", "tap_us")).select(F.lit("clean").alias("stage"), "stem_id", F.col("tap_us").alias("t_us"))
    e = tapped_estimates(spark, sf_dir)
    return raw.unionAll(clean).unionAll(e.select(F.lit("peaks"), "stem_id", "beat_us")).unionAll(e.select(F.lit("peaks_shifted"), "stem_id", F.col("beat_us") + 30_000))


def stage_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent of events within 70 ms of a reference beat, and their mean distance, per stem and stage; one nearest join for all stages."""
    n = M.nearest(stage_events(spark, sf_dir), tapped_references(spark, sf_dir), ["stem_id"])
    return n.groupBy("stem_id", "stage").agg(F.avg(F.when(F.abs("off_us") <= 70_000, 100.0).otherwise(0.0)).alias("percent"), F.avg(F.abs("off_us")).alias("distance_us"))


STAGED = f"WITH {CLEAN}, {TAPPED_ESTS}, ev AS (SELECT 'raw' AS stage, stem_id, tap_us AS t FROM t0 UNION ALL SELECT 'clean', stem_id, tap_us FROM t3 UNION ALL SELECT 'peaks', stem_id, beat_us FROM ests UNION ALL SELECT 'peaks_shifted', stem_id, beat_us + 30000 FROM ests), u AS (SELECT DISTINCT stem_id, t FROM ev), nu AS {NEAR.format(cols='a.stem_id, a.t', t='a.t', a='u', b='refs')}, n AS (SELECT stage, ev.stem_id, t_us, nearest_us FROM ev JOIN nu ON ev.stem_id = nu.stem_id AND ev.t = nu.t), sa AS (SELECT stem_id, stage, avg(CASE WHEN abs(t_us - nearest_us) <= 70000 THEN 100.0::DOUBLE ELSE 0 END) AS percent, avg(abs(t_us - nearest_us)) AS distance_us FROM n GROUP BY 1, 2)"


@query(f"{STAGED} SELECT stage, count(*) AS n_stems, {R6.format('avg(percent)')} AS percent, round_even(avg(distance_us), 3) AS distance_us FROM sa GROUP BY 1")
def stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = stage_alignment(spark, sf_dir)
    return a.groupBy("stage").agg(F.count("*").alias("n_stems"), X.half_even(F.avg("percent"), 6).alias("percent"), X.half_even(F.avg("distance_us"), 3).alias("distance_us"))


@query(f"{STAGED}, w AS (SELECT stem_id, max(percent) FILTER (stage = 'raw') AS raw, max(percent) FILTER (stage = 'clean') AS clean FROM sa GROUP BY 1) SELECT stem_id, {R6.format('raw')} AS raw, {R6.format('clean')} AS clean, clean < 42 OR raw - clean > 12 AS outlier FROM w")
def outlier_stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = stage_alignment(spark, sf_dir).groupBy("stem_id").pivot("stage", ["raw", "clean"]).agg(F.first("percent"))
    return w.select("stem_id", X.half_even(F.col("raw"), 6).alias("raw"), X.half_even(F.col("clean"), 6).alias("clean"), ((F.col("clean") < 42) | (F.col("raw") - F.col("clean") > 12)).alias("outlier"))


@query(f"{STAGED}, v AS (SELECT stem_id, stage, {R6.format('percent')} AS percent FROM sa) SELECT stem_id, max(percent) FILTER (stage = 'raw') AS raw, max(percent) FILTER (stage = 'clean') AS clean, max(percent) FILTER (stage = 'peaks') AS peaks, max(percent) FILTER (stage = 'peaks_shifted') AS peaks_shifted FROM v GROUP BY ROLLUP (stem_id)")
def variant_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide, a column for each variant, with the best of all stems below."""
    a = stage_alignment(spark, sf_dir).withColumn("percent", X.half_even(F.col("percent"), 6))
    return a.rollup("stem_id").agg(*(F.max(F.when(F.col("stage") == s, F.col("percent"))).alias(s) for s in STAGES))


@query(f"WITH {CLEAN}, r AS (SELECT stem_id, participant, count(*) AS n FROM t0 GROUP BY 1, 2), k AS (SELECT stem_id, participant, count(*) AS m FROM t3 GROUP BY 1, 2), d AS (SELECT stem_id, greatest(n - m, 0) AS gone FROM r JOIN k USING (stem_id, participant)) SELECT stem_id, {R6.format('avg(gone)')} AS mean_removed, median(gone) AS median_removed, {R6.format('avg(CASE WHEN gone > 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS share_touched FROM d GROUP BY 1")
def cleaning_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = taps(spark, sf_dir).select("stem_id", "participant", "tap_us")
    size = lambda d, name: d.groupBy("stem_id", "participant").agg(F.count("*").alias(name))
    d = size(T.clipped(raw), "n").join(size(T.cleaned_fast(raw), "m"), ["stem_id", "participant"]).withColumn("gone", F.greatest(F.col("n") - F.col("m"), F.lit(0)))
    return d.groupBy("stem_id").agg(X.half_even(F.avg("gone"), 6).alias("mean_removed"), F.median("gone").alias("median_removed"), X.half_even(F.avg(F.when(F.col("gone") > 0, 1.0).otherwise(0.0)), 6).alias("share_touched"))


@query(f"WITH {CLEAN}, {TAPPED_REFS}, ev AS (SELECT 'raw' AS variant, stem_id, participant, tap_us FROM t0 UNION ALL SELECT 'clean', stem_id, participant, tap_us FROM t3), u AS (SELECT DISTINCT stem_id, tap_us FROM ev), nu AS {NEAR.format(cols='a.stem_id, a.tap_us', t='a.tap_us', a='u', b='refs')}, h AS (SELECT variant, ev.stem_id, participant, count(*) FILTER (abs(t_us - nearest_us) <= 70000) / count(*)::DOUBLE AS rate, avg(CASE WHEN abs(t_us - nearest_us) <= 70000 THEN t_us - nearest_us END) AS mean_off FROM ev JOIN nu ON ev.stem_id = nu.stem_id AND ev.tap_us = nu.tap_us GROUP BY 1, 2, 3) SELECT stem_id, variant, count(*) AS n_trials, {R6.format('avg(rate)')} AS hit_rate, round_even(avg(mean_off), 3) AS mean_off_us FROM h GROUP BY 1, 2")
def stimulus_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials, mean hit rate and mean asynchrony (of trials with a hit) for each stimulus and variant."""
    raw = taps(spark, sf_dir).select("stem_id", "participant", "tap_us")
    ev = T.clipped(raw).withColumn("variant", F.lit("raw")).unionByName(T.cleaned_fast(raw).withColumn("variant", F.lit("clean"))).withColumnRenamed("tap_us", "t_us")
    h = M.hit_rates(ev, tapped_references(spark, sf_dir), ["stem_id"], 70_000, ["variant", "stem_id", "participant"])
    return h.groupBy("stem_id", "variant").agg(F.count("*").alias("n_trials"), X.half_even(F.avg(F.col("n_hits") / F.col("n_taps")), 6).alias("hit_rate"), X.half_even(F.avg("mean_off_us"), 3).alias("mean_off_us"))


LOCAL = "WITH {ests}, p AS (SELECT stem_id, beat_us AS tap_us FROM ests), pd AS (SELECT stem_id, 400000 + 50000 * ord AS period_us FROM stems), i AS (SELECT unnest(range(0, 60)) AS i), d AS (SELECT stem_id, tap_us, lag(tap_us) OVER (PARTITION BY stem_id ORDER BY tap_us) AS before FROM p), l AS (SELECT d.stem_id, i, median(tap_us - before) AS mid FROM d JOIN pd USING (stem_id), i WHERE before >= i * (30000000 / 59.0::DOUBLE) - 3000000 AND tap_us <= i * (30000000 / 59.0::DOUBLE) + 3000000 AND tap_us - before BETWEEN 0.4 * period_us AND 2.5 * period_us GROUP BY 1, 2 HAVING count(*) >= 2), x AS (SELECT pd.stem_id, i.i, period_us, coalesce(mid, period_us)::DOUBLE AS x FROM pd, i LEFT JOIN l ON l.stem_id = pd.stem_id AND l.i = i.i), s AS (SELECT a.stem_id, a.i, any_value(a.period_us) AS p, sum(b.x) / 7 AS m FROM x a, (SELECT unnest(range(-3, 4)) AS o) JOIN x b ON b.stem_id = a.stem_id AND b.i = greatest(0, least(59, a.i + o)) GROUP BY 1, 2)"


@query(LOCAL.format(ests=ESTS) + " SELECT stem_id, CAST(i AS INTEGER) AS i, round_even(greatest(0.75 * p, least(1.25 * p, m)), 3) AS local_us FROM s")
def smoothed_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local interval along each stem, smoothed and bounded."""
    peaks = estimates(spark, sf_dir).select("stem_id", F.col("beat_us").alias("tap_us"))
    period = references(spark, sf_dir).groupBy("stem_id").agg((400_000 + 50_000 * F.max("ord")).alias("period_us"))
    return local.local_intervals(peaks, period).withColumn("local_us", X.half_even(F.col("local_us"), 3))


MAJOR = "WITH {ests}, p AS (SELECT stem_id, beat_us + (k % 3) * 130000 AS tap_us FROM ests), d AS (SELECT stem_id, tap_us - lag(tap_us) OVER (PARTITION BY stem_id ORDER BY tap_us) AS ioi FROM p), q AS (SELECT stem_id, quantile_cont(ioi, [0.2, 0.5, 0.8]) FILTER (ioi BETWEEN 98000 AND 3125000) AS q, count(*) AS n FROM d GROUP BY 1), c AS (SELECT DISTINCT stem_id, n, x * m AS period_us FROM (SELECT stem_id, n, unnest(q) AS x FROM q), (SELECT unnest([0.5::DOUBLE, 1, 2]) AS m) WHERE x * m BETWEEN 280000 AND 1250000), g AS (SELECT c.*, j, j * (period_us / 36) AS phase_us FROM c, (SELECT unnest(range(0, 36)) AS j)), s AS (SELECT g.stem_id, n, period_us, j, phase_us, count(*) FILTER (abs(tap_us - (phase_us + round_even((tap_us - phase_us) / period_us, 0) * period_us)) <= 40000) AS score FROM g JOIN p USING (stem_id) GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY stem_id ORDER BY score DESC, period_us, j) AS r FROM s) WHERE r = 1)"


@query(MAJOR.format(ests=ESTS) + " SELECT stem_id, n, round_even(period_us, 3) AS period_us, round_even(phase_us, 3) AS phase_us, score FROM b WHERE score >= greatest(3, 0.35 * n)")
def majority_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid that most peaks lie near, over candidate periods and phases."""
    g = local.majority_grid(uneven_peaks(spark, sf_dir)[0])
    return g.select("stem_id", "n", X.half_even(F.col("period_us"), 3).alias("period_us"), X.half_even(F.col("phase_us"), 3).alias("phase_us"), "score")


@query(MAJOR.format(ests=ESTS) + ", o AS (SELECT p.stem_id, tap_us, round_even((tap_us - phase_us) / period_us, 0) AS k, abs(tap_us - (phase_us + round_even((tap_us - phase_us) / period_us, 0) * period_us)) AS off FROM p JOIN b USING (stem_id) WHERE score >= greatest(3, 0.35 * n)) SELECT stem_id, tap_us FROM (SELECT *, row_number() OVER (PARTITION BY stem_id, k ORDER BY off, tap_us) AS r FROM o WHERE off <= 40000) WHERE r = 1 UNION ALL SELECT stem_id, tap_us FROM p WHERE stem_id NOT IN (SELECT stem_id FROM o)")
def majority_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks on the majority grid, one a line; all of them where there is none."""
    return local.majority_peaks(uneven_peaks(spark, sf_dir)[0])


@query(f"WITH {REFS}, l AS (SELECT stem_id, k, beat_us - 6000000 + (k * 7919) % 21000 - 10500 AS beat_us FROM refs WHERE beat_us BETWEEN 6000000 AND 21000000), f AS (SELECT stem_id, min(beat_us) AS f FROM l GROUP BY 1), c AS (SELECT stem_id, beat_us - f AS start_us FROM refs JOIN f USING (stem_id) WHERE beat_us - f >= -500000), m AS (SELECT c.stem_id, start_us, count(*) FILTER (EXISTS (SELECT 1 FROM refs u WHERE u.stem_id = c.stem_id AND u.beat_us BETWEEN start_us - 10000 AND start_us + 30010000 AND abs(u.beat_us - start_us - l.beat_us) < 30000)) AS n_match FROM c JOIN l ON l.stem_id = c.stem_id GROUP BY 1, 2) SELECT stem_id, start_us, n_match FROM (SELECT *, row_number() OVER (PARTITION BY stem_id ORDER BY n_match DESC, start_us) AS r FROM m) WHERE r = 1")
def clip_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a clip starts in its source."""
    r = references(spark, sf_dir)
    clip = r.where("beat_us between 6000000 and 21000000").select("stem_id", (F.col("beat_us") - 6_000_000 + (F.col("k") * 7919) % 21_000 - 10_500).alias("beat_us"))
    return local.clip_offset(clip, r.select("stem_id", "beat_us"), ["stem_id"])


WINDOWED = f"WITH {ESTS}, rw AS (SELECT * FROM refs WHERE beat_us BETWEEN 10000000 AND 25000000), ew AS (SELECT stem_id, k, beat_us + 17000 AS beat_us FROM ests WHERE beat_us + 17000 BETWEEN 10000000 AND 25000000), n AS {NEAR.format(cols='a.stem_id, a.k', t='a.beat_us', a='ew', b='rw')}, pd AS (SELECT stem_id, 400000 + 50000 * ord AS period_us FROM stems)"


def windowed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """References, and estimates 17 ms late, from 10 to 25 s."""
    e = estimates(spark, sf_dir).select("stem_id", (F.col("beat_us") + 17_000).alias("beat_us"))
    inside = F.col("beat_us").between(10_000_000, 25_000_000)
    return references(spark, sf_dir).where(inside).select("stem_id", "beat_us"), e.where(inside)


@query(f"{WINDOWED} SELECT stem_id, median(CASE WHEN abs(t_us - nearest_us) <= 150000 THEN t_us - nearest_us END) AS median_off_us, count(*) FILTER (abs(t_us - nearest_us) <= 150000) AS n_near, coalesce(abs(median(CASE WHEN abs(t_us - nearest_us) <= 150000 THEN t_us - nearest_us END)) >= 20000, false) AS consistent FROM n GROUP BY 1")
def median_signed_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, est = windowed(spark, sf_dir)
    return local.median_offset(M.nearest(est.select("stem_id", F.col("beat_us").alias("t_us")), ref, ["stem_id"]), ["stem_id"])


@query(f"{WINDOWED} SELECT stem_id, {R6.format('atan2(avg(sin(2 * pi() * (t_us - nearest_us) / period_us)), avg(cos(2 * pi() * (t_us - nearest_us) / period_us))) / (2 * pi())')} AS phase_offset FROM n JOIN pd USING (stem_id) GROUP BY 1")
def circular_grid_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase of one grid against another of the same rate."""
    ref, est = windowed(spark, sf_dir)
    period = references(spark, sf_dir).groupBy("stem_id").agg((400_000 + 50_000 * F.max("ord")).alias("period_us"))
    near = M.nearest(est.select("stem_id", F.col("beat_us").alias("t_us")), ref, ["stem_id"]).join(period, "stem_id")
    return local.circular_offset(near, ["stem_id"], "period_us").withColumn("phase_offset", X.half_even(F.col("phase_offset"), 6))


@query(f"{WINDOWED}, b AS {NEAR.format(cols='a.stem_id, a.k', t='a.beat_us', a='rw', b='ew')}, p AS (SELECT stem_id, count(*) FILTER (abs(t_us - nearest_us) <= 50000) / count(*)::DOUBLE AS p, avg(CASE WHEN abs(t_us - nearest_us) <= 50000 THEN t_us - nearest_us END) AS off FROM n GROUP BY 1), r AS (SELECT stem_id, count(*) FILTER (abs(t_us - nearest_us) <= 50000) / count(*)::DOUBLE AS r FROM b GROUP BY 1) SELECT stem_id, {R6.format('CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END')} AS f, round_even(off, 3) AS mean_off_us FROM p JOIN r USING (stem_id)")
def alignment_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F at 50 ms with the mean offset of what matches."""
    ref, est = windowed(spark, sf_dir)
    off = F.when(F.abs("off_us") <= 50_000, F.col("off_us"))
    near = M.nearest(est.select("stem_id", F.col("beat_us").alias("t_us")), ref, ["stem_id"]).groupBy("stem_id").agg(X.half_even(F.avg(off), 3).alias("mean_off_us"))
    return M.f_measure(est, ref, ["stem_id"], 50_000).select("stem_id", X.half_even(F.col("f"), 6).alias("f")).join(near, "stem_id")


@query()
def period_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods by autocorrelation, and refined."""
    return grouped.estimated_periods(uneven_peaks(spark, sf_dir)[0])


CUT = f"WITH RECURSIVE {ESTS}, rw AS (SELECT * FROM refs WHERE beat_us BETWEEN 10000000 AND 25000000), ew AS (SELECT * FROM ests WHERE beat_us BETWEEN 10000000 AND 25000000), {NEAR_PAIRS}, {SWEEP}".replace("FROM refs r JOIN ests e", "FROM rw r JOIN ew e").replace("AS x FROM refs", "AS x FROM rw").replace("AS y FROM ests", "AS y FROM ew")


@query(f"{CUT}, fm AS (SELECT sw.stem_id, 2 * max(n) / any_value(len(x) + len(y))::DOUBLE AS f FROM sw JOIN li USING (stem_id) GROUP BY 1), gm AS (SELECT stem_id, median(abs(b_us - a_us)) / 1000.0::DOUBLE AS off FROM gp GROUP BY 1), rp AS ({MID.format('rw')}), ep AS ({MID.format('ew')}), cp AS (SELECT a.stem_id, x.m AS p, y.m AS q, y.m / x.m AS ratio FROM (SELECT DISTINCT stem_id FROM stems) a LEFT JOIN rp x USING (stem_id) LEFT JOIN ep y USING (stem_id)), nr AS {NEAR.format(cols='a.stem_id, a.k', t='a.beat_us', a='ew', b='rw')}, ph AS (SELECT stem_id, atan2(avg(sin(2 * pi() * (t_us - nearest_us) / p)), avg(cos(2 * pi() * (t_us - nearest_us) / p))) / (2 * pi()) AS phase FROM nr JOIN cp USING (stem_id) WHERE ratio BETWEEN 0.80 AND 1.25 GROUP BY 1) SELECT stem_id, {R6.format('f')} AS f, p / 1e6 AS reference_period_s, q / 1e6 AS estimate_period_s, {R6.format('ratio')} AS ratio, CASE WHEN ratio IS NULL OR ratio <= 0 THEN 'unclear' WHEN ratio BETWEEN 0.35 AND 0.65 THEN 'double' WHEN ratio BETWEEN 0.80 AND 1.25 THEN 'matched' WHEN ratio BETWEEN 1.75 AND 2.25 THEN 'half' ELSE 'other' END AS relation, {R6.format('phase')} AS phase_offset, {R6.format('off')} AS median_abs_offset_ms FROM cp LEFT JOIN fm USING (stem_id) LEFT JOIN gm USING (stem_id) LEFT JOIN ph USING (stem_id)")
def grid_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stem's estimated beats against its grid, from 10 to 25 s."""
    c = M.compared_grids(references(spark, sf_dir), estimates(spark, sf_dir), ["stem_id"])
    return c.withColumns({k: X.half_even(F.col(k), 6) for k in ("f", "ratio", "phase_offset", "median_abs_offset_ms")})


@query()
def six_stage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From taps to peaks of hits: means over stems at each stage."""
    raw = distinct_taps(spark, sf_dir).select("stem_id", "tap_us")
    clean = T.cleaned_fast(taps(spark, sf_dir).select("stem_id", "participant", "tap_us")).select("stem_id", "tap_us")
    a = M.stage_alignments(raw, clean, tapped_references(spark, sf_dir), lambda pools: grouped.density_peaks(T.pooled_density(pools)))
    return a.groupBy("stage").agg(F.count("*").alias("n_stems"), F.avg("hit_rate").alias("hit_rate"), F.avg("mean_abs_us").alias("mean_abs_us"), F.avg("median_abs_us").alias("median_abs_us"))


RELEASED = f"WITH {ESTS}, rel AS (SELECT stem_id, CASE WHEN ord = 1 THEN beat_us ELSE beat_us + (k % 3) * CASE WHEN ord = 2 THEN 400 WHEN ord = 3 THEN 2500 ELSE 4000 END END AS tap_us FROM ests JOIN stems USING (stem_id) WHERE NOT (ord = 5 AND k % 9 = 0)), ra AS (SELECT stem_id, row_number() OVER (PARTITION BY stem_id ORDER BY beat_us) AS i, beat_us AS a FROM ests), rb AS (SELECT stem_id, row_number() OVER (PARTITION BY stem_id ORDER BY tap_us) AS i, tap_us AS b FROM rel), rv AS (SELECT stem_id, count(a) AS n_computed, count(b) AS n_released, max(abs(a - b)) AS worst_us FROM ra FULL JOIN rb USING (stem_id, i) GROUP BY 1)"


@query(f"{RELEASED} SELECT stem_id, n_computed, n_released, worst_us, CASE WHEN n_computed = n_released AND worst_us <= 1000 THEN 'equal' WHEN n_computed = n_released AND worst_us <= 5100 THEN 'one_step' ELSE 'differing' END AS outcome FROM rv WHERE n_computed > 0")
def peak_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks against a released set that is the same, a step off, farther off, or short of some."""
    e = estimates(spark, sf_dir).join(references(spark, sf_dir).select("stem_id", "ord").distinct(), "stem_id")
    step = F.when(F.col("ord") == 1, 0).when(F.col("ord") == 2, 400).when(F.col("ord") == 3, 2_500).otherwise(4_000)
    released = e.where("not (ord = 5 and k % 9 = 0)").select("stem_id", (F.col("beat_us") + (F.col("k") % 3) * step).alias("tap_us"))
    return M.verified_peaks(e.select("stem_id", F.col("beat_us").alias("tap_us")), released, ["stem_id"])


@query("WITH " + TAPS + ", t0 AS (SELECT DISTINCT stem_id, participant, panel, tap_us FROM taps), d AS (SELECT *, tap_us - lag(tap_us) OVER (PARTITION BY stem_id, participant, panel ORDER BY tap_us) AS ioi FROM t0), t AS (SELECT stem_id, participant, panel, count(*) AS n, median(ioi) / 1e6 AS m, CASE WHEN avg(ioi) > 0 THEN stddev_pop(ioi) / avg(ioi) END AS cv FROM d GROUP BY 1, 2, 3) SELECT panel, count(*) AS n_trials, count(DISTINCT participant) AS n_participants, " + R6.format("avg(n)") + " AS mean_n_taps, " + R6.format("median(m)") + " AS median_ioi_s, " + R6.format("avg(cv)") + " AS mean_ioi_cv FROM t GROUP BY 1")
def panel_descriptives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tapping of each panel's trials on the whole."""
    t = T.clipped(taps(spark, sf_dir).select("stem_id", "participant", "panel", "tap_us"))
    d = T.descriptives_by(T.trial_descriptives(t, ("stem_id", "participant", "panel")), "panel")
    return d.withColumns({c: X.half_even(F.col(c), 6) for c in ("mean_n_taps", "median_ioi_s", "mean_ioi_cv")})


@query(f"WITH {ESTS}, n AS (SELECT count(*) AS n FROM ests GROUP BY stem_id) SELECT count(*) AS n, {R6.format('avg(n)')} AS mean, {R6.format('stddev_samp(n)')} AS std, min(n) AS least, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75, max(n) AS greatest FROM n")
def beats_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many beats the stems have."""
    d = T.described(estimates(spark, sf_dir).groupBy("stem_id").agg(F.count("*").alias("k")), "k")
    return d.withColumns({c: X.half_even(F.col(c), 6) for c in ("mean", "std")})


AUDIT = SHORT + ", s AS (SELECT d.stem_id, period_us, ioi, lag(ioi) OVER (PARTITION BY d.stem_id ORDER BY ioi) AS before FROM d JOIN t USING (stem_id) WHERE ioi < 0.9 * period_us), g AS (SELECT stem_id, count(*) AS n_short, max(ioi - before) / max(period_us)::DOUBLE AS gap, arg_max((before + ioi) / 2.0::DOUBLE, (ioi - before) * 1e9::DOUBLE - ioi) AS threshold FROM s GROUP BY 1), n AS (SELECT stem_id, count(*) AS n_peaks FROM p GROUP BY 1), sc AS (SELECT stem_id, n_peaks, CASE WHEN n_peaks >= 8 AND n_short >= 3 THEN coalesce(gap, 0) ELSE 0 END AS score, threshold FROM n LEFT JOIN g USING (stem_id)), a AS (SELECT p.stem_id, tap_us, coalesce(lead(tap_us) OVER (PARTITION BY p.stem_id ORDER BY tap_us) - tap_us <= threshold, false) AS short FROM p JOIN sc USING (stem_id) WHERE score >= 0.12), r AS (SELECT *, coalesce(sum(CASE WHEN short THEN 0 ELSE 1 END) OVER (PARTITION BY stem_id ORDER BY tap_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM a), i AS (SELECT stem_id, row_number() OVER (PARTITION BY stem_id, run ORDER BY tap_us) AS i FROM r), c AS (SELECT stem_id, count(*) FILTER (i % 2 = 1) AS a, count(*) FILTER (i % 2 = 0) AS b, count(*) FILTER (i % 2 = 1) >= 4 AND count(*) FILTER (i % 2 = 0) >= 4 AS ok FROM i GROUP BY 1)"


@query(f"{AUDIT} SELECT stem_id, period_us, n_peaks, {R6.format('score')} AS score, coalesce(ok, false) AS is_bimodal, CASE WHEN ok THEN threshold ELSE 0 END AS phase_delta_us, CASE WHEN ok THEN a ELSE 0 END AS n_a, CASE WHEN ok THEN b ELSE 0 END AS n_b FROM sc JOIN t USING (stem_id) LEFT JOIN c USING (stem_id)")
def bimodality_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stem's peaks, and whether they come in two phase groups."""
    return G.bimodality_audit(*uneven_peaks(spark, sf_dir)).withColumn("score", X.half_even(F.col("score"), 6))


VARIANTS = f"WITH {ESTS}, v AS (SELECT 'crowd' AS variant, stem_id, k, beat_us FROM ests UNION ALL SELECT 'late', stem_id, k, beat_us + 45000 FROM ests UNION ALL SELECT 'sparse', stem_id, k, beat_us FROM ests WHERE k % 4 <> 0), sh AS (SELECT variant, stem_id, r.k, shift_us, min(abs(e.beat_us + shift_us - r.beat_us)) AS d FROM v e JOIN refs r USING (stem_id), (SELECT unnest(range(-250000, 250001, 5000)) AS shift_us) GROUP BY ALL), hc AS (SELECT variant, stem_id, shift_us, count(*) FILTER (d <= 70000) AS hits FROM sh GROUP BY ALL), hb AS (SELECT * FROM hc QUALIFY row_number() OVER (PARTITION BY variant, stem_id ORDER BY hits DESC, shift_us) = 1), vm AS (SELECT variant, stem_id, median(ioi) AS m FROM (SELECT variant, stem_id, beat_us - lag(beat_us) OVER (PARTITION BY variant, stem_id ORDER BY beat_us) AS ioi FROM v) GROUP BY 1, 2), rm AS (SELECT stem_id, median(ioi) AS m FROM (SELECT stem_id, beat_us - lag(beat_us) OVER (PARTITION BY stem_id ORDER BY beat_us) AS ioi FROM refs) GROUP BY 1), sf AS (SELECT b.variant, b.stem_id, CASE WHEN coalesce(x.m > 0 AND y.m > 0 AND greatest(x.m, y.m) / least(x.m, y.m)::DOUBLE <= 1.1::DOUBLE, false) THEN shift_us ELSE 0 END AS shift_us FROM hb b JOIN vm x USING (variant, stem_id) JOIN rm y ON y.stem_id = b.stem_id), w AS (SELECT v.*, beat_us + shift_us AS moved FROM v JOIN sf USING (variant, stem_id)), pd AS (SELECT w.variant, w.stem_id, w.k, min(abs(w.beat_us - r.beat_us)) AS d, min(abs(w.moved - r.beat_us)) AS dm FROM w JOIN refs r USING (stem_id) GROUP BY ALL), rd AS (SELECT w.variant, w.stem_id, r.k, min(abs(w.beat_us - r.beat_us)) AS d, min(abs(w.moved - r.beat_us)) AS dm FROM w JOIN refs r USING (stem_id) GROUP BY ALL), pf AS (SELECT variant, stem_id, avg((d <= 70000)::INT) AS p, avg((d <= 120000)::INT) AS pw, avg((dm <= 70000)::INT) AS pm FROM pd GROUP BY 1, 2), rf AS (SELECT variant, stem_id, avg((d <= 70000)::INT) AS r, avg((d <= 120000)::INT) AS rw, avg((dm <= 70000)::INT) AS rm, median(CASE WHEN d <= 70000 THEN d END) / 1000 AS med FROM rd GROUP BY 1, 2), nn AS (SELECT variant, stem_id, count(*) FILTER (beat_us BETWEEN 0 AND 30000000) AS n_30s, count(*) FILTER (beat_us BETWEEN 10000000 AND 25000000) AS n_10_25 FROM v GROUP BY 1, 2), mt AS (SELECT variant, stem_id, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f, CASE WHEN pw + rw > 0 THEN 2 * pw * rw / (pw + rw) ELSE 0 END AS f_wide, CASE WHEN pm + rm > 0 THEN 2 * pm * rm / (pm + rm) ELSE 0 END AS f_aligned, shift_us / 1000.0::DOUBLE AS shift_ms, med AS median_off_ms, n_30s, n_10_25 FROM pf JOIN rf USING (variant, stem_id) JOIN sf USING (variant, stem_id) JOIN nn USING (variant, stem_id))"


def metrics_of_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = estimates(spark, sf_dir).repartition("stem_id")
    late, sparse = F.col("beat_us") + 45_000, F.when(F.col("k") % 4 != 0, F.col("beat_us"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), b.alias("beat_us")) for n, b in (("crowd", F.col("beat_us")), ("late", late), ("sparse", sparse)))))
    v = e.select("stem_id", each.alias("v")).select("v.variant", "stem_id", "v.beat_us")
    return M.variant_metrics(v, references(spark, sf_dir))


@query(f"{VARIANTS} SELECT variant, stem_id, {R6.format('f')} AS f, {R6.format('f_wide')} AS f_wide, {R6.format('f_aligned')} AS f_aligned, shift_ms, {R6.format('median_off_ms')} AS median_off_ms, n_30s, n_10_25 FROM mt")
def variant_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of metrics of every stem and variant."""
    return metrics_of_variants(spark, sf_dir).withColumns({c: X.half_even(F.col(c), 6) for c in ("f", "f_wide", "f_aligned", "median_off_ms")})


@query(f"{VARIANTS} SELECT 'c' || ord AS corpus, variant, count(f) AS n_stems, {R6.format('avg(f)')} AS mean_f, {R6.format('median(f)')} AS median_f FROM mt JOIN stems USING (stem_id) GROUP BY 1, 2")
def variants_by_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median F of each corpus and variant; a corpus is a tempo."""
    corpora = stems(spark, sf_dir).select("stem_id", F.concat(F.lit("c"), "ord").alias("corpus"))
    m = M.by_corpus(metrics_of_variants(spark, sf_dir), corpora)
    return m.withColumns({c: X.half_even(F.col(c), 6) for c in ("mean_f", "median_f")})


@query()
def variant_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first variant's F against each other's: signed ranks over stems, and step-up q values; each step is kept, as the next reads it several times."""
    m = durable(metrics_of_variants(spark, sf_dir).select("variant", "stem_id", "f"))
    d = durable(M.against_baselines(m, "crowd").withColumn("difference", F.round("difference", 9)))
    w = durable(S.wilcoxon_p(d, ["baseline"], "difference"))
    return S.step_up(w.withColumn("family", F.lit(0)), ["family"], "p").drop("family")


@query()
def parameter_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fourteen variants of the search against the default: mean F, and the share of stems at its rate."""
    s = grouped.sensitivity(find_peaks(spark, sf_dir))
    return s.groupBy("variant").agg(F.count("*").alias("n_stems"), F.avg("f").alias("mean_f"), F.min("f").alias("least_f"), F.avg((F.col("relation") == "matched").cast("double")).alias("matched_share"))


@query()
def final_grid_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids of samples of cleaned trials against the whole and against each other."""
    t = T.cleaned_fast(taps(spark, sf_dir).select("stem_id", "participant", "tap_us")).select("stem_id", "participant", "tap_us")
    return grouped.reliability_summary(grouped.final_grid_reliability(t, [5, 10, 20, 30, 50], 1, 20260717))


@query()
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structured divergences of a consensus from its reference: counts, periods, class, phase, bimodality, scores."""
    ref, est = windowed(spark, sf_dir)

    def of(b: DataFrame, n: str, m: str) -> DataFrame:
        w = Window.partitionBy("stem_id").orderBy("beat_us")
        return b.withColumn("ioi", F.col("beat_us") - F.lag("beat_us").over(w)).groupBy("stem_id").agg(F.count("*").alias(n), (F.median("ioi") / 1e6).alias(m))

    p = of(est, "n_consensus", "consensus_s").join(of(ref, "n_reference", "reference_s"), "stem_id")
    near = local.median_offset(M.nearest(est.select("stem_id", F.col("beat_us").alias("t_us")), ref, ["stem_id"]), ["stem_id"])
    strength = G.bimodal_strength(est.select("stem_id", F.col("beat_us").alias("tap_us")), p.select("stem_id", (F.col("consensus_s") * 1e6).alias("period_us"))).select("stem_id", "strength", F.col("flag").alias("bimodal"))
    ratio, octave = F.col("consensus_s") / F.col("reference_s"), X.octave_class(F.col("consensus_s") / F.col("reference_s"))
    rows = p.join(near, "stem_id").join(strength, "stem_id").join(grouped.levels_of(ref, est), "stem_id")
    return rows.select("stem_id", "n_consensus", "n_reference", *(X.half_even(F.col(c), 4).alias(c) for c in ("consensus_s", "reference_s")), X.half_even(ratio, 3).alias("ratio"), octave.alias("octave"), X.half_even(F.col("median_off_us") / 1000, 1).alias("phase_ms"), (F.col("consistent") & (octave == "match")).alias("phase_shifted"), X.half_even(F.col("strength"), 3).alias("strength"), "bimodal", *(X.half_even(F.col(c), 3).alias(c) for c in ("f", "cmlt", "amlt")))


@query()
def convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of tappers against all and against each other: 100 repetitions for each size."""
    c = grouped.convergence(taps(spark, sf_dir), [5, 10, 15, 20, 30, 40, 50, 70, 90], 100, 20260717)
    per_stem = c.groupBy("comparison", "n", "stem_id").agg(*(F.avg(x).alias(x) for x in ("density_r", "peak_f", "offset_ms")))
    return per_stem.groupBy("comparison", "n").agg(F.count("*").alias("n_stems"), *(F.avg(x).alias(f"mean_{x}") for x in ("density_r", "peak_f", "offset_ms")), F.median("density_r").alias("median_density_r"))


@query()
def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of period classes per panel with intervals over participants: 10,000 draws."""
    t = trial_periods(spark, sf_dir).withColumn("c", X.ratio_class(F.col("period_us") / 1_000_000))
    flags = ["double", "matched", "half", "other"]
    rows = t.select("panel", "participant", *((F.col("c") == c).cast("int").alias(c) for c in flags))
    return grouped.bootstrap_shares(rows, ["panel"], "participant", flags, 10_000, 20260728)


@query()
def median_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians with intervals: 20,000 draws."""
    return grouped.bootstrap_median(panel_periods(spark, sf_dir).select("stem_id", "panel", F.col("period_us").cast("double").alias("period_us")), ["stem_id"], "period_us", 20_000, 20260718)


@query()
def rank_test_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilcoxon, Mann-Whitney, Kruskal-Wallis and Spearman with their p."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    early = F.col("year") < 1996
    d = o.groupBy("o_orderpriority", "o_custkey").agg(F.round(F.avg(F.when(early, F.col("o_totalprice"))) - F.avg(F.when(~early, F.col("o_totalprice"))), 2).alias("d"))
    c = table(spark, sf_dir, "customer").withColumn("v", F.floor(F.col("c_acctbal") / 10))
    n = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    return S.with_p(S.wilcoxon_p(d, ["o_orderpriority"], "d"), S.mann_whitney_p(o, ["o_orderpriority"], early, "o_totalprice"), S.kruskal(c, "c_mktsegment", "v"), S.spearman(c.join(n, "c_custkey"), ["c_mktsegment"], "c_acctbal", "n_orders"))
