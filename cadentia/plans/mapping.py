"""The star-schema test tables read as timing data.

``events`` stands for taps (group = event type, participant = user, panel =
user modulo 10, time = microseconds within half a minute); reference
beats are grids of a user's (or, where taps are compared, a group's) tempo, and
estimated ones a user's events about its grid, in whole microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import dense_places


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("participant"), F.col("event_type").alias("stem_id"), (F.col("user_id") % 10).cast("int").alias("panel"), F.pmod(us, F.lit(30_000_000)).alias("tap_us"), "value", "props"
    )


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stem for each user, of one of five tempi."""
    return table(spark, sf_dir, "events").where("user_id is not null").select(F.concat(F.lit("u"), "user_id").alias("stem_id"), (F.col("user_id") % 5 + 1).alias("ord")).distinct()


def tapped_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stem for each event type, as the taps have it, and its ordinal."""
    return dense_places(table(spark, sf_dir, "events").select(F.col("event_type").alias("stem_id")), "stem_id", "ord")


def grid_of(stems: DataFrame) -> DataFrame:
    """400 ms and 50 ms more for each ordinal."""
    beat = F.col("ord") * 100_000 + F.col("k") * (400_000 + 50_000 * F.col("ord"))
    return stems.select("stem_id", "ord", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(74).cast("long"))).alias("k")).select("stem_id", "ord", "k", beat.alias("beat_us")).where("beat_us < 30000000")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_of(stems(spark, sf_dir))


def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events about the grid: of those nearest to a beat the first, its distance scaled to 120 ms at most; beats without one are lost."""
    tap, period, phase = F.col("tap_us"), 400_000 + 50_000 * F.col("ord"), 100_000 * F.col("ord")
    t = taps(spark, sf_dir).where("participant is not null").select("tap_us", F.concat(F.lit("u"), "participant").alias("stem_id"), (F.col("participant") % 5 + 1).alias("ord"))
    t = t.where(tap >= phase).select("stem_id", period.alias("period"), phase.alias("phase"), F.floor((tap - phase + period / 2) / period).alias("k"), "tap_us")
    grid = F.col("phase") + F.col("k") * F.col("period")
    apart = F.floor(((F.col("tap_us") - grid) + F.col("period")) * 240_000 / F.col("period")) - 240_000
    return t.select("stem_id", "k", (grid + apart).cast("long").alias("beat_us")).groupBy("stem_id", "k").agg(F.min("beat_us").alias("beat_us"))


def tapped_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_of(tapped_stems(spark, sf_dir))


def tapped_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid of the taps' stems with every eleventh beat lost and up to 120 ms of jitter."""
    r = tapped_references(spark, sf_dir).where("k % 11 <> 0")
    return r.select("stem_id", "k", (F.col("beat_us") + (F.col("k") * 7919 + F.col("ord") * 104_729) % 240_000 - 120_000).alias("beat_us"))


#: The same views in DuckDB.
TAPS = "taps AS (SELECT event_id, user_id AS participant, event_type AS stem_id, CAST(user_id % 10 AS INTEGER) AS panel, epoch_us(ts) % 30000000 AS tap_us, value, props FROM events)"
GRID = "refs AS (SELECT stem_id, ord, k, 100000 * ord + k * (400000 + 50000 * ord) AS beat_us FROM stems, (SELECT unnest(range(0, 75)) AS k) WHERE 100000 * ord + k * (400000 + 50000 * ord) < 30000000)"
STEMS = "stems AS (SELECT DISTINCT 'u' || user_id AS stem_id, user_id % 5 + 1 AS ord FROM events WHERE user_id IS NOT NULL)"
REFS = f"{STEMS}, {GRID}"
ESTS = REFS + ", ets AS (SELECT 'u' || user_id AS stem_id, 400000 + 50000 * (user_id % 5 + 1) AS period, 100000 * (user_id % 5 + 1) AS phase, epoch_us(ts) % 30000000 AS t FROM events WHERE user_id IS NOT NULL), eks AS (SELECT *, CAST(floor((t - phase + period / 2) / period) AS BIGINT) AS k FROM ets WHERE t >= phase), ests AS (SELECT stem_id, k, min(phase + k * period + CAST(floor((t - (phase + k * period) + period) * 240000 / period) AS BIGINT) - 240000) AS beat_us FROM eks GROUP BY 1, 2)"
#: The stems of the taps, with the same names, for queries that join taps and beats.
TAPPED_REFS = f"stems AS (SELECT event_type AS stem_id, row_number() OVER (ORDER BY event_type) AS ord FROM (SELECT DISTINCT event_type FROM events)), {GRID}"
TAPPED_ESTS = TAPPED_REFS + ", ests AS (SELECT stem_id, k, beat_us + (k * 7919 + ord * 104729) % 240000 - 120000 AS beat_us FROM refs WHERE k % 11 <> 0)"
