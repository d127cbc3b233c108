"""Cleaning, intervals, coherence, densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import grouped
from ..operators import timing as T
from .mapping import TAPS, taps
from .registry import query

DISTINCT = TAPS + ", t0 AS (SELECT DISTINCT stem_id, participant, panel, tap_us FROM taps)"


def passes(source: str) -> str:
    """Three cleaning passes in DuckDB, t0 to t3."""
    out = [source]
    for i in range(3):
        out.append(
            f"d{i} AS (SELECT *, tap_us - lag(tap_us) OVER o AS before, lead(tap_us) OVER o - tap_us AS after, count(*) OVER (PARTITION BY stem_id, participant) AS n FROM t{i} WINDOW o AS (PARTITION BY stem_id, participant ORDER BY tap_us))"
            f", m{i} AS (SELECT stem_id, participant, median(before) AS mid FROM d{i} GROUP BY 1, 2)"
            f", a{i} AS (SELECT d{i}.stem_id, d{i}.participant, any_value(mid) AS mid, median(abs(before - mid)) + 0.001 AS mad FROM d{i} JOIN m{i} USING (stem_id, participant) GROUP BY 1, 2)"
            f", t{i + 1} AS (SELECT stem_id, participant, panel, tap_us FROM d{i} JOIN a{i} USING (stem_id, participant) WHERE NOT coalesce(n >= 4 AND mad >= 1.0 AND before IS NOT NULL AND after IS NOT NULL AND (before > mid + 3.5 * 1.4826 * mad OR after > mid + 3.5 * 1.4826 * mad), false))"
        )
    return ", ".join(out)


CLEAN = passes(DISTINCT)
BINS = "b AS (SELECT DISTINCT {keys}, participant, unnest(range(CAST(ceil((tap_us - 50000) / 50000.0) AS BIGINT), CAST(floor((tap_us + 50000) / 50000.0) AS BIGINT) + 1)) AS bin FROM {source}), c AS (SELECT {keys}, bin, count(*) AS n FROM b WHERE bin BETWEEN 0 AND 599 GROUP BY ALL), s AS (SELECT {keys}, bin // 20 AS sec, max(n) AS n FROM c GROUP BY ALL)"


def distinct_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.clipped(taps(spark, sf_dir).select("stem_id", "participant", "panel", "tap_us"))


@query(f"WITH {TAPS} SELECT stem_id, count(*) AS n_taps, count(DISTINCT participant) AS n_participants, count(DISTINCT panel) AS n_panels FROM taps GROUP BY stem_id")
def trial_counts_per_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taps(spark, sf_dir).groupBy("stem_id").agg(F.count("*").alias("n_taps"), F.count_distinct("participant").alias("n_participants"), F.count_distinct("panel").alias("n_panels"))


@query(f"WITH {TAPS}, n AS (SELECT stem_id, participant, count(*) AS n FROM taps GROUP BY 1, 2) SELECT stem_id, count(*) AS n_trials, min(n) AS least, median(n) AS middle, max(n) AS most, count(*) FILTER (n < 10) AS n_short FROM n GROUP BY 1")
def trial_size_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = taps(spark, sf_dir).groupBy("stem_id", "participant").agg(F.count("*").alias("n"))
    return n.groupBy("stem_id").agg(F.count("*").alias("n_trials"), F.min("n").alias("least"), F.median("n").alias("middle"), F.max("n").alias("most"), F.count_if(F.col("n") < 10).alias("n_short"))


@query(f"WITH {CLEAN}, r AS (SELECT stem_id, count(*) AS n_raw FROM t0 GROUP BY 1), k AS (SELECT stem_id, count(*) AS n_clean FROM t3 GROUP BY 1) SELECT stem_id, n_raw, n_clean, n_raw - n_clean AS n_removed FROM r JOIN k USING (stem_id)")
def mad_clean_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taps left by the interval filter; the one-shuffle kernel does it, and the windowed form is its twin in tests."""
    raw = taps(spark, sf_dir).select("stem_id", "participant", "tap_us")
    r = T.clipped(raw).groupBy("stem_id").agg(F.count("*").alias("n_raw"))
    k = T.cleaned_fast(raw).groupBy("stem_id").agg(F.count("*").alias("n_clean"))
    return r.join(k, "stem_id").select("stem_id", "n_raw", "n_clean", (F.col("n_raw") - F.col("n_clean")).alias("n_removed"))


@query(f"WITH {CLEAN} SELECT stem_id, participant, tap_us FROM t3")
def mad_clean_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.cleaned(distinct_taps(spark, sf_dir)).select("stem_id", "participant", "tap_us")


@query(f"WITH {DISTINCT}, d AS (SELECT *, tap_us - lag(tap_us) OVER (PARTITION BY stem_id, participant ORDER BY tap_us) AS ioi FROM t0) SELECT stem_id, participant, count(*) AS n_taps, median(ioi) AS median_ioi_us, round_even(CASE WHEN count(ioi) >= 2 THEN stddev_pop(ioi) / avg(ioi) END * 1e6, 0) / 1e6 AS cv FROM d GROUP BY 1, 2")
def trial_ioi_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.interval_stats(distinct_taps(spark, sf_dir)).withColumn("cv", X.half_even(F.col("cv"), 6))


@query(f"WITH {DISTINCT}, d AS (SELECT *, tap_us - lag(tap_us) OVER (PARTITION BY stem_id, participant ORDER BY tap_us) AS ioi FROM t0) SELECT stem_id, participant, round_even(60000000.0::DOUBLE / median(ioi) * 1e6, 0) / 1e6 AS bpm FROM d WHERE ioi > 50000 GROUP BY 1, 2")
def trial_bpm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tempo(distinct_taps(spark, sf_dir)).withColumn("bpm", X.half_even(F.col("bpm"), 6))


@query(f"WITH {DISTINCT}, d AS (SELECT *, tap_us - lag(tap_us) OVER (PARTITION BY stem_id, participant ORDER BY tap_us) AS ioi FROM t0), b AS (SELECT stem_id, participant, 60000000.0::DOUBLE / median(ioi) AS bpm FROM d WHERE ioi > 50000 GROUP BY 1, 2) SELECT stem_id, participant FROM b WHERE abs(bpm - 40) / 40 <= 0.25")
def tempo_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = distinct_taps(spark, sf_dir)
    target = t.select("stem_id").distinct().withColumn("target", F.lit(40.0))
    return T.tempo_gate(t, target, 0.25).select("stem_id", "participant")


@query(f"WITH {DISTINCT}, d AS (SELECT *, tap_us - lag(tap_us) OVER (PARTITION BY stem_id, participant ORDER BY tap_us) AS ioi FROM t0) SELECT stem_id, participant, count(*) AS n, median(ioi) AS period_us FROM d WHERE ioi BETWEEN 150000 AND 3000000 GROUP BY 1, 2 HAVING count(*) >= 2")
def trial_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period of a trial from intervals of 0.15 to 3 s, two at least."""
    d = T.with_intervals(distinct_taps(spark, sf_dir)).where(F.col("ioi").between(150_000, 3_000_000))
    return d.groupBy("stem_id", "participant").agg(F.count("*").alias("n"), F.median("ioi").alias("period_us")).where("n >= 2")


@query(f"WITH {CLEAN}, {BINS.format(keys='stem_id', source='t3')} SELECT stem_id, count(DISTINCT participant) AS n_participants, (SELECT round_even(sum(n) / 30.0::DOUBLE * 1e6, 0) / 1e6 FROM s WHERE s.stem_id = t3.stem_id) AS istc FROM t3 GROUP BY stem_id")
def istc_per_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of the cleaned taps."""
    clean = T.cleaned_fast(taps(spark, sf_dir).select("stem_id", "participant", "tap_us"))
    return T.coherence(clean).withColumn("istc", X.half_even(F.col("istc"), 6))


@query(f"WITH {TAPS}, {BINS.format(keys='stem_id, panel', source='taps')}, i AS (SELECT stem_id, panel, sum(n) / 30.0::DOUBLE AS istc FROM s GROUP BY ALL), w AS (SELECT stem_id, panel, count(DISTINCT participant) AS n_participants FROM taps GROUP BY ALL) SELECT stem_id, panel, n_participants, round_even(istc * 1e6, 0) / 1e6 AS istc, round_even(istc / n_participants * 1e6, 0) / 1e6 AS istc_fraction FROM w JOIN i USING (stem_id, panel)")
def istc_per_stem_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.coherence(taps(spark, sf_dir), ("stem_id", "panel"))
    return c.select("stem_id", "panel", "n_participants", X.half_even(F.col("istc"), 6).alias("istc"), X.half_even(F.col("istc") / F.col("n_participants"), 6).alias("istc_fraction"))


@query(f"WITH {TAPS}, e AS (SELECT * FROM taps WHERE (stem_id, participant) IN (SELECT (stem_id, participant) FROM taps GROUP BY stem_id, participant HAVING count(*) >= 5)), {BINS.format(keys='stem_id', source='e')}, w AS (SELECT stem_id, count(DISTINCT participant) AS n_participants FROM e GROUP BY ALL) SELECT stem_id, n_participants, CASE WHEN n_participants >= 5 THEN (SELECT round_even(sum(n) / 30.0::DOUBLE * 1e6, 0) / 1e6 FROM s WHERE s.stem_id = w.stem_id) END AS istc FROM w")
def istc_min5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five taps a participant and five participants at least."""
    return T.coherence(taps(spark, sf_dir), least_taps=5, least_participants=5).withColumn("istc", X.half_even(F.col("istc"), 6))


@query(f"WITH {TAPS}, g AS (SELECT stem_id, unnest(range(greatest(0, CAST(ceil((tap_us - 640000) / 5000.0) AS BIGINT)), least(6000, CAST(floor((tap_us + 640000) / 5000.0) AS BIGINT)) + 1)) AS g, tap_us FROM taps) SELECT stem_id, CAST(g AS INTEGER) AS g, round_even(sum(exp(-0.5 * ((g * 5000 - tap_us) / 80000.0::DOUBLE) * ((g * 5000 - tap_us) / 80000.0::DOUBLE))) / (0.08 * sqrt(2 * pi())) * 1e4, 0) / 1e4 AS density FROM g GROUP BY ALL")
def kde_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled density of all taps on the 5 ms grid."""
    return T.pooled_density(taps(spark, sf_dir)).withColumn("density", X.half_even(F.col("density"), 4))


@query(f"WITH {TAPS}, g AS (SELECT stem_id, unnest(range(greatest(0, CAST(ceil((tap_us - 640000) / 5000.0) AS BIGINT)), least(6000, CAST(floor((tap_us + 640000) / 5000.0) AS BIGINT)) + 1)) AS g, tap_us FROM taps), k AS (SELECT stem_id, g, sum(exp(-0.5 * ((g * 5000 - tap_us) / 80000.0::DOUBLE) * ((g * 5000 - tap_us) / 80000.0::DOUBLE))) AS y FROM g GROUP BY ALL), m AS (SELECT *, lag(y) OVER (PARTITION BY stem_id ORDER BY g) AS a, lead(y) OVER (PARTITION BY stem_id ORDER BY g) AS b FROM k) SELECT stem_id, count(*) AS n_maxima FROM m WHERE y > a AND y >= b GROUP BY 1")
def kde_local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.local_maxima(T.pooled_density(taps(spark, sf_dir))).groupBy("stem_id").agg(F.count("*").alias("n_maxima"))


@query(f"WITH {TAPS}, h AS (SELECT stem_id, participant, tap_us // 5000 AS bin, count(*) AS n FROM taps GROUP BY ALL), w AS (SELECT *, n / sum(n) OVER (PARTITION BY stem_id, participant)::DOUBLE AS share FROM h) SELECT stem_id, bin, CAST(sum(n) AS BIGINT) AS n_taps, round_even(sum(share) * 1e6, 0) / 1e6 AS weight FROM w GROUP BY ALL")
def kde_participant_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.tap_histogram(taps(spark, sf_dir)).withColumn("weight", X.half_even(F.col("weight"), 6))


@query(f"WITH {TAPS}, b AS (SELECT DISTINCT stem_id, tap_us // 5000 AS bin FROM taps), p AS (SELECT x.stem_id, CAST(y.bin - x.bin AS INTEGER) AS lag, count(*) AS n_pairs FROM b x JOIN b y ON x.stem_id = y.stem_id AND y.bin - x.bin BETWEEN 0 AND 400 GROUP BY ALL) SELECT *, round_even(n_pairs / (max(n_pairs) OVER (PARTITION BY stem_id))::DOUBLE, 9) AS acf FROM p")
def acf_peak_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs at each lag, and their share of those at lag 0, which is the largest."""
    return T.train_autocorrelation(taps(spark, sf_dir)).withColumn("acf", X.half_even(F.col("acf"), 9))


@query()
def find_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of each stem's pooled density: apart by 150 ms, prominent by a tenth."""
    return grouped.density_peaks(T.pooled_density(T.cleaned_fast(taps(spark, sf_dir).select("stem_id", "participant", "tap_us"))))


@query()
def cascade_beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus grid of each stem, from taps to beats."""
    c = grouped.consensus(find_peaks(spark, sf_dir))
    return c.select("stem_id", F.size("beats_us").alias("n_beats"), F.get("beats_us", F.lit(0)).alias("first_us"), "period_s", "cv", "label", "path", F.element_at("scores", "post_ge").alias("score_extended"))
