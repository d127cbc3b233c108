"""Cohort comparisons: leave-one-panel-out references, choices, residuals, circular summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def other_panels_median(values: DataFrame, value: str) -> DataFrame:
    """For each (stem, panel): the median over the stem's other panels.

    The join is over aggregates: a row for each stem and panel.
    """
    o = values.select("stem_id", F.col("panel").alias("other"), F.col(value).alias("v"))
    return values.join(o, "stem_id").where("panel <> other").groupBy("stem_id", "panel", value).agg(F.median("v").alias("reference"), F.count("v").alias("n_other"))


def circular(values: DataFrame, keys: Sequence[str], cycles: str) -> DataFrame:
    """Mean direction (cycles in [-1/2, 1/2)) and resultant length of phases in cycles."""
    a = F.col(cycles) * 2 * 3.141592653589793
    m = values.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.cos(a)).alias("re"), F.avg(F.sin(a)).alias("im"))
    return m.select(*keys, "n", (F.atan2("im", "re") / (2 * 3.141592653589793)).alias("mean_phase"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("resultant"))


def other_panels_direction(vectors: DataFrame) -> DataFrame:
    """Mean of the other panels' unit vectors, each panel with equal weight; vectors: stem_id, panel, re, im."""
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    u = vectors.where(size > 0).select("stem_id", "panel", (F.col("re") / size).alias("re"), (F.col("im") / size).alias("im"))
    o = u.select("stem_id", F.col("panel").alias("other"), F.col("re").alias("x"), F.col("im").alias("y"))
    m = u.join(o, "stem_id").where("panel <> other").groupBy("stem_id", "panel").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return m.select("stem_id", "panel", (F.atan2("y", "x") / (2 * 3.141592653589793)).alias("reference_phase"))


def phases_to_other_panels(trials: DataFrame, references: DataFrame, low: float = 0.80, high: float = 1.25) -> DataFrame:
    """stem_id, participant, panel, phase_sin and phase_cos of trials whose period matches their panel's reference.

    A trial's phase is the direction of its taps (taps_us) at the reference
    period, against the mean of the other panels' unit directions at that
    period; references: stem_id, panel, reference, a row for each stem and panel.
    """
    turn = 2 * 3.141592653589793 * F.col("tap_us") / F.col("reference")
    sums = (F.sum(F.cos(turn)).alias("re"), F.sum(F.sin(turn)).alias("im"))
    size = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    taps = trials.select("stem_id", "participant", "panel", F.explode("taps_us").alias("tap_us"))
    other = references.withColumnRenamed("panel", "own")
    pooled = taps.join(other, "stem_id").where("panel <> own").groupBy("stem_id", "own", "panel").agg(*sums).where(size > 0)
    angle = pooled.groupBy("stem_id", F.col("own").alias("panel")).agg(F.atan2(F.sum(F.col("im") / size), F.sum(F.col("re") / size)).alias("angle"))
    near = trials.join(references, ["stem_id", "panel"]).where((F.col("period_us") / F.col("reference")).between(low, high)).select("stem_id", "participant", "panel", "reference")
    own = taps.join(near, ["stem_id", "participant", "panel"]).groupBy("stem_id", "participant", "panel").agg(*sums).where(size > 0)
    a = F.atan2("im", "re") - F.col("angle")
    return own.join(angle, ["stem_id", "panel"]).select("stem_id", "participant", "panel", F.sin(a).alias("phase_sin"), F.cos(a).alias("phase_cos"))


def proportions(rows: DataFrame, key: str, category: str, categories: Sequence[str]) -> DataFrame:
    """Row-normalised contingency table in a fixed order of columns."""
    t = rows.groupBy(key).pivot(category, list(categories)).count().na.fill(0)
    total = sum((F.col(c) for c in categories), F.lit(0))
    return t.select(key, *((F.col(c) / total).alias(f"p_{c}") for c in categories), total.cast("long").alias("n"))


def one_hot(rows: DataFrame, category: str, categories: Sequence[str]) -> DataFrame:
    return rows.withColumns({f"is_{c}": (F.col(category) == c).cast("double") for c in categories})


def participant_residuals(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each participant's mean of values from which the stem's mean is taken."""
    w = Window.partitionBy("stem_id")
    r = rows.select("stem_id", "participant", "panel", *((F.col(c) - F.avg(c).over(w)).alias(c) for c in columns))
    return r.groupBy("participant", "panel").agg(*(F.avg(c).alias(c) for c in columns))


def between_groups(vectors: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Sum over groups of n * squared distance of the group's mean from the grand mean."""
    g = vectors.groupBy(group).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in columns))
    total = g.agg(F.sum("n").alias("all"), *(F.sum(c).alias(f"t_{c}") for c in columns))
    d = sum((F.pow(F.col(c) / F.col("n") - F.col(f"t_{c}") / F.col("all"), 2) for c in columns), F.lit(0.0))
    return g.crossJoin(F.broadcast(total)).agg(F.sum(F.col("n") * d).alias("statistic"), F.count("*").alias("n_groups"))
