"""Cohorts, statistics, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import grouped
from ..operators import inference as S
from ..operators import panels as P
from ..operators import permutation
from ..operators import timing as T
from .mapping import TAPS, table, taps
from .registry import query

R6 = "round_even(({}) * 1e6, 0) / 1e6"
CLASSES = ["double", "matched", "half", "other", "unclear"]
PERIOD = f"WITH {TAPS}, t0 AS (SELECT DISTINCT stem_id, participant, panel, tap_us FROM taps), d AS (SELECT *, tap_us - lag(tap_us) OVER (PARTITION BY stem_id, participant ORDER BY tap_us) AS ioi FROM t0), tp AS (SELECT stem_id, participant, panel, median(ioi) AS period_us FROM d WHERE ioi BETWEEN 150000 AND 3000000 GROUP BY ALL HAVING count(*) >= 2), pp AS (SELECT stem_id, panel, median(period_us) AS period_us FROM tp GROUP BY ALL), lo AS (SELECT a.stem_id, a.panel, any_value(a.period_us) AS period_us, median(b.period_us) AS reference, count(*) AS n_other FROM pp a JOIN pp b ON a.stem_id = b.stem_id AND a.panel <> b.panel GROUP BY 1, 2), tr AS (SELECT stem_id, participant, panel, tp.period_us, tp.period_us / reference AS ratio FROM tp JOIN lo USING (stem_id, panel)), cl AS (SELECT *, CASE WHEN ratio BETWEEN 0.35 AND 0.65 THEN 'double' WHEN ratio BETWEEN 0.80 AND 1.25 THEN 'matched' WHEN ratio BETWEEN 1.75 AND 2.25 THEN 'half' WHEN ratio IS NULL OR ratio <= 0 THEN 'unclear' ELSE 'other' END AS class FROM tr)"


def trial_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.clipped(taps(spark, sf_dir).select("stem_id", "participant", "panel", "tap_us"))
    d = T.with_intervals(t).where(F.col("ioi").between(150_000, 3_000_000))
    return d.groupBy("stem_id", "participant", "panel").agg(F.median("ioi").alias("period_us"), F.count("*").alias("n")).where("n >= 2").drop("n")


def panel_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trial_periods(spark, sf_dir).groupBy("stem_id", "panel").agg(F.median("period_us").alias("period_us"))


@query(f"{PERIOD} SELECT stem_id, panel, period_us, reference, n_other FROM lo")
def lopo_reference_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each panel's period against the median of the other panels'."""
    return P.other_panels_median(panel_periods(spark, sf_dir), "period_us")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = lopo_reference_period(spark, sf_dir).select("stem_id", "panel", "reference")
    return trial_periods(spark, sf_dir).join(ref, ["stem_id", "panel"]).withColumn("ratio", F.col("period_us") / F.col("reference")).withColumn("class", X.ratio_class(F.col("ratio")))


@query(f"{PERIOD} SELECT panel, " + ", ".join(f"count(*) FILTER (class = '{c}') / count(*)::DOUBLE AS p_{c}" for c in CLASSES) + ", count(*) AS n FROM cl GROUP BY 1")
def panel_choice_proportions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.proportions(classified(spark, sf_dir), "panel", "class", CLASSES)


RESID = PERIOD + ", x AS (SELECT participant, panel, " + ", ".join(f"(class = '{c}')::INT - avg((class = '{c}')::INT) OVER (PARTITION BY stem_id) AS is_{c}" for c in CLASSES) + " FROM cl), v AS (SELECT participant, panel, " + ", ".join(f"avg(is_{c}) AS is_{c}" for c in CLASSES) + " FROM x GROUP BY 1, 2)"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.participant_residuals(P.one_hot(classified(spark, sf_dir), "class", CLASSES), [f"is_{c}" for c in CLASSES])


@query(f"{RESID} SELECT participant, panel, " + ", ".join(f"round_even(is_{c} * 1e6, 0) / 1e6 + 0.0 AS is_{c}" for c in CLASSES) + " FROM v")
def residual_participant_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).withColumns({f"is_{c}": X.half_even(F.col(f"is_{c}"), 6) + F.lit(0.0) for c in CLASSES})


@query(f"{RESID}, g AS (SELECT panel, count(*) AS n, " + ", ".join(f"avg(is_{c}) AS m_{c}" for c in CLASSES) + " FROM v GROUP BY 1), a AS (SELECT " + ", ".join(f"avg(is_{c}) AS t_{c}" for c in CLASSES) + " FROM v) SELECT round_even(sum(n * (" + " + ".join(f"(m_{c} - t_{c}) * (m_{c} - t_{c})" for c in CLASSES) + ")) * 1e6, 0) / 1e6 AS statistic, count(*) AS n_groups FROM g, a")
def between_group_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = P.between_groups(vectors(spark, sf_dir), "panel", [f"is_{c}" for c in CLASSES])
    return b.select(X.half_even(F.col("statistic"), 6).alias("statistic"), "n_groups")


CIRC = f"WITH {TAPS}, v AS (SELECT stem_id, panel, count(*) AS n, avg(cos(tap_us % 500000 / 500000.0::DOUBLE * 2 * pi())) AS re, avg(sin(tap_us % 500000 / 500000.0::DOUBLE * 2 * pi())) AS im FROM taps GROUP BY 1, 2)"


@query(f"{CIRC} SELECT stem_id, panel, n, round_even(atan2(im, re) / (2 * pi()) * 1e6, 0) / 1e6 AS mean_phase, round_even(sqrt(re * re + im * im) * 1e6, 0) / 1e6 AS resultant FROM v")
def panel_circular_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = taps(spark, sf_dir).withColumn("cycles", (F.col("tap_us") % 500_000) / 500_000.0)
    return P.circular(t, ["stem_id", "panel"], "cycles").withColumns({c: X.half_even(F.col(c), 6) for c in ("mean_phase", "resultant")})


@query(f"{CIRC}, u AS (SELECT stem_id, panel, re / sqrt(re * re + im * im) AS re, im / sqrt(re * re + im * im) AS im FROM v WHERE sqrt(re * re + im * im) > 0) SELECT a.stem_id, a.panel, round_even(atan2(avg(b.im), avg(b.re)) / (2 * pi()) * 1e6, 0) / 1e6 AS reference_phase FROM u a JOIN u b ON a.stem_id = b.stem_id AND a.panel <> b.panel GROUP BY 1, 2")
def lopo_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("tap_us") % 500_000) / 500_000.0 * 2 * 3.141592653589793
    v = taps(spark, sf_dir).groupBy("stem_id", "panel").agg(F.avg(F.cos(a)).alias("re"), F.avg(F.sin(a)).alias("im"))
    return P.other_panels_direction(v).withColumn("reference_phase", X.half_even(F.col("reference_phase"), 6))


@query(f"{PERIOD}, m AS (SELECT stem_id, avg(period_us) AS every, count(*) AS k, sum(period_us) AS s FROM pp GROUP BY 1) SELECT stem_id, panel, {R6.format('period_us - (s - period_us) / (k - 1)')} AS delta FROM pp JOIN m USING (stem_id) WHERE k > 1")
def own_vs_other_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel's value less the mean of the others', from sums: no join of panels with panels."""
    p = panel_periods(spark, sf_dir)
    m = p.groupBy("stem_id").agg(F.sum("period_us").alias("s"), F.count("*").alias("k")).where("k > 1")
    return p.join(m, "stem_id").select("stem_id", "panel", X.half_even(F.col("period_us") - (F.col("s") - F.col("period_us")) / (F.col("k") - 1), 6).alias("delta"))


RANK = "(rank() OVER ({p} ORDER BY {x}) + (count(*) OVER ({q}) - 1) / 2.0::DOUBLE)"


@query("WITH c AS (SELECT o_orderpriority, o_custkey, avg(CASE WHEN year(o_orderdate) < 1996 THEN o_totalprice END) - avg(CASE WHEN year(o_orderdate) >= 1996 THEN o_totalprice END) AS d FROM orders GROUP BY 1, 2), r AS (SELECT *, (rank() OVER (PARTITION BY o_orderpriority ORDER BY abs(round(d, 2))) + (count(*) OVER (PARTITION BY o_orderpriority, abs(round(d, 2))) - 1) / 2.0::DOUBLE) AS k FROM c WHERE round(d, 2) <> 0) SELECT o_orderpriority, count(*) AS n, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN k ELSE 0 END) AS w_minus FROM r GROUP BY 1")
def wilcoxon_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    early = F.year("o_orderdate") < 1996
    c = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.round(F.avg(F.when(early, F.col("o_totalprice"))) - F.avg(F.when(~early, F.col("o_totalprice"))), 2).alias("d"))
    return S.wilcoxon(c, ["o_orderpriority"], "d").select("o_orderpriority", "n", "w_plus", "w_minus")


@query("WITH r AS (SELECT l_returnflag, l_linestatus = 'F' AS f, (rank() OVER (PARTITION BY l_returnflag, l_shipmonth ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_shipmonth, l_quantity) - 1) / 2.0::DOUBLE) AS k, l_shipmonth FROM (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem)) SELECT l_returnflag, CAST(l_shipmonth AS INTEGER) AS m, count(*) FILTER (f) AS n_first, count(*) FILTER (NOT f) AS n_second, coalesce(sum(k) FILTER (f), 0) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0::DOUBLE AS u FROM r GROUP BY 1, 2")
def mannwhitney_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").withColumn("m", F.month("l_shipdate"))
    return S.mann_whitney(t, ["l_returnflag", "m"], F.col("l_linestatus") == "F", "l_quantity").drop("ties")


@query("WITH r AS (SELECT c_mktsegment, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS k FROM (SELECT c_mktsegment, CAST(floor(c_acctbal / 10) AS BIGINT) AS v FROM customer)), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM r GROUP BY v)), g AS (SELECT count(*) AS m, sum(k) AS s FROM r GROUP BY c_mktsegment), q AS (SELECT sum(s * s / m) AS q, count(*) AS k, sum(m)::BIGINT AS n FROM g) SELECT k, n, round_even(((12.0::DOUBLE / (n::DOUBLE * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n))) * 1e6, 0) / 1e6 AS h FROM q, t")
def kruskal_h(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "customer").select("c_mktsegment", F.floor(F.col("c_acctbal") / 10).alias("v"))
    return S.kruskal(t, "c_mktsegment", "v").select("k", "n", X.half_even(F.col("h"), 6).alias("h"))


@query("WITH r AS (SELECT c_mktsegment, (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE) AS x, (rank() OVER (PARTITION BY c_mktsegment ORDER BY n) + (count(*) OVER (PARTITION BY c_mktsegment, n) - 1) / 2.0::DOUBLE) AS y FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) SELECT c_mktsegment, count(*) AS n, round_even(corr(x, y) * 1e6, 0) / 1e6 AS rho FROM r GROUP BY 1")
def spearman_rho(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))
    t = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"))
    return S.spearman(t, ["c_mktsegment"], "c_acctbal", "n_orders").withColumn("rho", X.half_even(F.col("rho"), 6))


@query("WITH p AS (SELECT c_mktsegment, c_custkey, abs(c_acctbal) / 20000 AS p FROM customer), r AS (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS m, row_number() OVER (PARTITION BY c_mktsegment ORDER BY p, c_custkey) AS k FROM p) SELECT c_mktsegment, c_custkey, p, round_even(least(1.0::DOUBLE, min(p * m / k) OVER (PARTITION BY c_mktsegment ORDER BY k DESC ROWS UNBOUNDED PRECEDING)) * 1e6, 0) / 1e6 AS q FROM r")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests are the accounts of a segment."""
    t = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", (F.abs("c_acctbal") / 20000).alias("p"))
    return S.step_up(t, ["c_mktsegment"], "p").withColumn("q", X.half_even(F.col("q"), 6))


D = "WITH s AS (SELECT l_returnflag, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, avg(l_extendedprice) FILTER (f) AS m1, avg(l_extendedprice) FILTER (NOT f) AS m2, var_samp(l_extendedprice) FILTER (f) AS v1, var_samp(l_extendedprice) FILTER (NOT f) AS v2 FROM (SELECT *, l_discount < 0.05 AS f FROM lineitem) GROUP BY 1), d AS (SELECT *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM s), e AS (SELECT l_returnflag, n1, n2, d, sqrt((n1 + n2) / (n1 * n2)::DOUBLE + d * d / (2.0 * (n1 + n2))) AS se FROM d)"


@query(f"{D} SELECT l_returnflag, n1, n2, {R6.format('d')} AS d, {R6.format('se')} AS se FROM e")
def cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.cohens_d(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_discount") < 0.05, "l_extendedprice")
    return d.select("l_returnflag", "n1", "n2", X.half_even(F.col("d"), 6).alias("d"), X.half_even(F.col("se"), 6).alias("se"))


@query(f"{D}, m AS (SELECT count(*) AS k, sum(d / (se * se)) / sum(1 / (se * se)) AS d, sqrt(1 / sum(1 / (se * se))) AS se FROM e) SELECT k, {R6.format('d')} AS d, {R6.format('se')} AS se, {R6.format('d / se')} AS z, {R6.format('d - 1.96 * se')} AS lo, {R6.format('d + 1.96 * se')} AS hi FROM m")
def meta_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.cohens_d(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.col("l_discount") < 0.05, "l_extendedprice")
    return S.fixed_effect_meta(d).withColumns({c: X.half_even(F.col(c), 6) for c in ("d", "se", "z", "lo", "hi")})


CELLS = "WITH c AS (SELECT c_nationkey AS r, c_mktsegment AS s, avg(c_acctbal) AS y, (c_nationkey * 7 + length(c_mktsegment) * 3) % 5 AS x FROM customer GROUP BY c_nationkey, c_mktsegment), ok AS (SELECT r FROM c GROUP BY r HAVING count(*) = 5), b AS (SELECT * FROM c WHERE r IN (SELECT r FROM ok)), w AS (SELECT r, s, x - avg(x) OVER (PARTITION BY r) - avg(x) OVER (PARTITION BY s) + avg(x) OVER () AS x, y - avg(y) OVER (PARTITION BY r) - avg(y) OVER (PARTITION BY s) + avg(y) OVER () AS y FROM b), f AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx, count(*) AS n, count(DISTINCT r) AS g, count(DISTINCT s) AS k FROM w), u AS (SELECT r, sum(x * (y - beta * x)) AS u FROM w, f GROUP BY r)"


@query(f"{CELLS} SELECT any_value(n) AS n, {R6.format('any_value(beta)')} AS beta, {R6.format('sqrt(any_value(g) / (any_value(g) - 1.0::DOUBLE) * (any_value(n) - 1.0::DOUBLE) / (any_value(n) - any_value(g) - any_value(k)) * sum(u * u)) / any_value(xx)')} AS se FROM u, f")
def fixed_effect_beta(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("r"), F.col("c_mktsegment").alias("s")).agg(F.avg("c_acctbal").alias("y"))
    c = c.withColumn("x", ((F.col("r") * 7 + F.length("s") * 3) % 5).cast("double"))
    ok = c.groupBy("r").agg(F.count("*").alias("k")).where("k = 5").select("r")
    e = S.two_way_effect(c.join(ok, "r", "left_semi"), "r", "s", "x", "y")
    return e.select("n", X.half_even(F.col("beta"), 6).alias("beta"), X.half_even(F.col("se"), 6).alias("se"))


@query()
def fixed_effect_ragged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effect over all suppliers' months, of which few are complete."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    c = l.groupBy(F.col("l_suppkey").alias("r"), F.date_trunc("quarter", "l_shipdate").alias("s")).agg(F.avg("l_extendedprice").alias("y"), F.avg("l_discount").alias("x"))
    e = S.two_way_effect(c, "r", "s", "x", "y")
    return e.select("n", *(X.half_even(F.col(k), 6).alias(k) for k in ("beta", "se", "z", "lo", "hi", "p")))


@query()
def small_sample_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed-rank and rank-sum tests of each nation's suppliers and customers, which are few."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit(True).alias("supplier"), F.col("s_acctbal").alias("balance"))
    b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit(False).alias("supplier"), F.col("c_acctbal").alias("balance"))
    w = S.wilcoxon_p(a, ["nation"], "balance", 3).select("nation", F.lit("signed_rank").alias("test"), "n", F.col("w_plus").alias("value"), "median_difference", "method", "p", "p_greater")
    u = S.mann_whitney_p(a.unionAll(b), ["nation"], F.col("supplier"), "balance")
    return w.unionAll(u.select("nation", F.lit("rank_sum"), F.col("n_first") + F.col("n_second"), "u", F.lit(None).cast("double"), "method", F.lit(None).cast("double"), "p_greater"))


@query()
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation.permutation_test(vectors(spark, sf_dir), "panel", [f"is_{c}" for c in CLASSES], 9_999, 20260717)


@query()
def panel_pairwise_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of panels: 9,999 permutations within the pair, and step-up q values."""
    return permutation.pairwise_tests(vectors(spark, sf_dir), "panel", [f"is_{c}" for c in CLASSES], 9_999, 20260717)


PAIRS = RESID + ", g AS (SELECT panel, count(*) AS n, " + ", ".join(f"avg(is_{c}) AS m_{c}" for c in CLASSES) + " FROM v GROUP BY 1)"


@query(f"{PAIRS} SELECT CAST(a.panel AS VARCHAR) AS panel_a, CAST(b.panel AS VARCHAR) AS panel_b, a.n AS n_a, b.n AS n_b, round_even((a.n * b.n / (a.n + b.n)::DOUBLE) * (" + " + ".join(f"pow(a.m_{c} - b.m_{c}, 2)" for c in CLASSES) + ") * 1e6, 0) / 1e6 AS observed FROM g a JOIN g b ON a.panel < b.panel")
def panel_pairwise_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs' observed statistics, as the tests report them."""
    t = permutation.pairwise_tests(vectors(spark, sf_dir), "panel", [f"is_{c}" for c in CLASSES], 0, 20260717)
    return t.select("panel_a", "panel_b", "n_a", "n_b", X.half_even(F.col("observed"), 6).alias("observed"))


def trials_with_taps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem_id, participant, panel, period_us and the trial's taps."""
    t = T.clipped(taps(spark, sf_dir).select("stem_id", "participant", "panel", "tap_us"))
    own = t.groupBy("stem_id", "participant", "panel").agg(F.collect_list("tap_us").alias("taps_us"))
    return trial_periods(spark, sf_dir).join(own, ["stem_id", "participant", "panel"])


@query()
def rebuilt_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that depends on panels rebuilt in each of 9,999 permutations."""
    return permutation.rebuilt_permutation(trials_with_taps(spark, sf_dir), 9_999, 20260720)


PHASE = PERIOD + ", r3 AS (SELECT stem_id, panel, reference FROM lo WHERE n_other >= 3), tt AS (SELECT t.* FROM t0 t JOIN tp USING (stem_id, participant, panel)), z AS (SELECT t.stem_id, r.panel AS own, t.panel AS other, sum(cos(2 * pi() * tap_us / reference)) AS re, sum(sin(2 * pi() * tap_us / reference)) AS im FROM tt t JOIN r3 r ON t.stem_id = r.stem_id AND t.panel <> r.panel GROUP BY 1, 2, 3), an AS (SELECT stem_id, own AS panel, atan2(sum(im / sqrt(re * re + im * im)), sum(re / sqrt(re * re + im * im))) AS angle FROM z WHERE sqrt(re * re + im * im) > 0 GROUP BY 1, 2), dv AS (SELECT t.stem_id, participant, t.panel, atan2(sum(sin(2 * pi() * tap_us / reference)), sum(cos(2 * pi() * tap_us / reference))) AS a FROM tt t JOIN r3 USING (stem_id, panel) GROUP BY 1, 2, 3), ph AS (SELECT dv.stem_id, dv.participant, dv.panel, sin(a - angle) AS s, cos(a - angle) AS c FROM dv JOIN an USING (stem_id, panel) JOIN (SELECT stem_id, participant, tp.period_us / reference AS ratio FROM tp JOIN r3 USING (stem_id, panel)) q ON q.stem_id = dv.stem_id AND q.participant = dv.participant WHERE ratio BETWEEN 0.80 AND 1.25), rs AS (SELECT participant, panel, s - avg(s) OVER (PARTITION BY stem_id) AS s, c - avg(c) OVER (PARTITION BY stem_id) AS c FROM ph), pv AS (SELECT participant, panel, avg(s) AS s, avg(c) AS c FROM rs GROUP BY 1, 2), gp AS (SELECT panel, count(*) AS n, avg(s) AS s, avg(c) AS c FROM pv GROUP BY 1), al AS (SELECT avg(s) AS s, avg(c) AS c FROM pv)"


@query(f"{PHASE} SELECT round_even(sum(n * (pow(gp.s - al.s, 2) + pow(gp.c - al.c, 2))) * 1e6, 0) / 1e6 AS statistic, count(*) AS n_groups FROM gp, al")
def phase_group_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between-panel statistic of participants' residual phases against the other panels' direction."""
    t = trials_with_taps(spark, sf_dir)
    ref = lopo_reference_period(spark, sf_dir).where("n_other >= 3").select("stem_id", "panel", "reference")
    v = P.phases_to_other_panels(t, ref)
    b = P.between_groups(P.participant_residuals(v, ["phase_sin", "phase_cos"]), "panel", ["phase_sin", "phase_cos"])
    return b.select(X.half_even(F.col("statistic"), 6).alias("statistic"), "n_groups")


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel_periods(spark, sf_dir).withColumn("period_s", F.col("period_us") / 1e6).select("stem_id", "panel", "period_s")
    return grouped.bootstrap_mean(p, ["stem_id"], "period_s", 2_000, 20260718)


@query()
def subsample_istc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coherence of equal numbers of participants, drawn by hash: 500 draws of seven."""
    return permutation.sampled_coherence(taps(spark, sf_dir).select("stem_id", "panel", "participant", "tap_us"), ["stem_id", "panel"], 7, 500, 20260720)
