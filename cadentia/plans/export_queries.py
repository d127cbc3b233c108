"""Exports, checks, small joins and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import exports as E
from ..operators import grid as G
from ..operators import inference as S
from ..operators.ordering import running
from .mapping import REFS, TAPS, references, table, taps
from .registry import query

R6 = "round_even(({}) * 1e6, 0) / 1e6"


@query("SELECT event_id, CAST(len(v) AS INTEGER) AS n_taps, v[1] AS first_s FROM (SELECT event_id, CASE WHEN event_id % 6 IN (0, 3, 4) THEN [] ELSE list_sort(list_filter([((event_id % 40000) + 1500.5::DOUBLE - 2000) / 1000, ((event_id % 40000)::DOUBLE - 2000) / 1000], lambda x: x >= 0 AND x <= 30)) END AS v FROM events)")
def aligned_taps_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of six kinds: failed, plain, encoded twice, bad text, null, and without a flag."""
    o = (F.col("event_id") % 40_000).cast("double")
    inner = F.to_json(F.struct(F.array(o + 1500.5, o).alias("resp_onsets_aligned")))
    onsets = F.concat(F.lit('{"failed": '), F.when(F.col("event_id") % 6 == 0, "true").otherwise("false"), F.lit(', "extracted_onsets": '), inner, F.lit("}"))
    twice = F.to_json(F.struct(F.lit(False).alias("failed"), inner.alias("extracted_onsets")))
    bare = F.concat(F.lit('{"extracted_onsets": '), inner, F.lit("}"))
    k = F.col("event_id") % 6
    text = F.when(k <= 1, onsets).when(k == 2, twice).when(k == 3, F.lit('{"failed": fal')).when(k == 5, bare)
    return table(spark, sf_dir, "events").select("event_id", E.aligned_taps(text).alias("v")).select("event_id", F.size("v").alias("n_taps"), F.get("v", F.lit(0)).alias("first_s"))


@query(f"WITH {TAPS} SELECT stem_id, count(*) AS n FROM taps WHERE (CASE event_id % 3 WHEN 0 THEN false WHEN 1 THEN true END) = false GROUP BY 1")
def strict_not_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("event_id") % 3 == 0, False).when(F.col("event_id") % 3 == 1, True)
    return taps(spark, sf_dir).where(E.strictly_not_failed(flag)).groupBy("stem_id").agg(F.count("*").alias("n"))


@query(f"WITH {TAPS} SELECT event_id, round_even((tap_us / 1000.0::DOUBLE) / 1000.0::DOUBLE - 2.0::DOUBLE, 9) AS tap_s FROM taps")
def ms_to_s_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taps(spark, sf_dir).select("event_id", X.half_even(E.ms_to_s(F.col("tap_us") / 1000.0, 2.0), 9).alias("tap_s"))


@query("SELECT o_orderkey, CASE WHEN contains(o_orderpriority, 'HI') THEN 'HH' WHEN contains(o_orderpriority, 'U') THEN 'UU' WHEN contains(o_orderpriority, 'M') THEN 'MM' WHEN contains(o_orderpriority, 'GENT') THEN 'GG' END AS country FROM orders")
def batch_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First key contained, in the order of the mapping."""
    return table(spark, sf_dir, "orders").select("o_orderkey", E.first_match(F.col("o_orderpriority"), [("HI", "HH"), ("U", "UU"), ("M", "MM"), ("GENT", "GG")]).alias("country"))


@query("WITH a AS (SELECT l_orderkey, l_partkey, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, l_partkey, CAST(round(sum(l_quantity)) AS BIGINT) + CASE WHEN l_orderkey % 50 = 0 THEN 1 ELSE 0 END AS p FROM lineitem GROUP BY 1, 2) SELECT count(*) AS n, count(*) FILTER (q = p) AS n_same FROM a JOIN b USING (l_orderkey, l_partkey)")
def composite_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two derivations of one table joined on both keys; both sides share one shuffle."""
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.sum("l_quantity").alias("s"))
    left = a.select("l_orderkey", "l_partkey", F.col("s").cast("long").alias("q"))
    right = a.select("l_orderkey", "l_partkey", (F.round("s").cast("long") + F.when(F.col("l_orderkey") % 50 == 0, 1).otherwise(0)).alias("p"))
    return left.join(right, ["l_orderkey", "l_partkey"]).agg(F.count("*").alias("n"), F.count_if(F.col("q") == F.col("p")).alias("n_same"))


@query("WITH r AS (SELECT c_custkey, c_acctbal AS balance, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal / 3 END AS third FROM customer), n AS (SELECT c_custkey, c_acctbal + CASE WHEN c_custkey % 10 = 0 THEN 0.01 ELSE 0 END AS balance, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal / 3 END AS third FROM customer) SELECT 'balance' AS \"column\", count(*) AS n_rows, count(*) FILTER (coalesce(abs(r.balance - n.balance) <= 1e-9, r.balance IS NULL AND n.balance IS NULL)) AS n_same FROM r JOIN n USING (c_custkey) UNION ALL SELECT 'third', count(*), count(*) FILTER (coalesce(abs(r.third - n.third) <= 1e-9, r.third IS NULL AND n.third IS NULL)) FROM r JOIN n USING (c_custkey)")
def tolerance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k, b = table(spark, sf_dir, "customer"), F.col("c_custkey"), F.col("c_acctbal")
    released = c.select("c_custkey", b.alias("balance"), F.when(k % 4 != 0, b / 3).alias("third"))
    computed = c.select("c_custkey", (b + F.when(k % 10 == 0, 0.01).otherwise(0)).alias("balance"), F.when(k % 8 != 0, b / 3).alias("third"))
    return E.agreement(released, computed, ["c_custkey"], ["balance", "third"])


@query("SELECT n_nationkey, n_name, n_suppliers::DOUBLE AS n_suppliers, CAST(NULL AS DOUBLE) AS cv FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def optional_left_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One optional table is there, one is not."""
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").cast("double").alias("n_suppliers"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return E.left_if(E.left_if(n, s, ["n_nationkey"], {"n_suppliers": "double"}), None, ["n_nationkey"], {"cv": "double"})


@query("SELECT c_custkey, CAST(count(o_orderkey) AS INTEGER) AS n, coalesce(min(o_orderkey), -1) AS first_key FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def lookup_default_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key that the map lacks has an empty array."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    j = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<bigint>")))
    return j.select("c_custkey", F.size("keys").alias("n"), F.coalesce(F.get("keys", F.lit(0)), F.lit(-1)).alias("first_key"))


@query(f"WITH m AS (SELECT c_mktsegment AS k, avg(c_acctbal) AS v FROM customer GROUP BY 1) SELECT a.k AS first, b.k AS second, {R6.format('a.v - b.v')} AS difference FROM m a JOIN m b ON a.k < b.k")
def panel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of panels on their means: a row for each panel is joined, not its members."""
    m = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("v"))
    return E.group_pairs(m, "c_mktsegment", "v").withColumn("difference", X.half_even(F.col("difference"), 6))


@query("WITH m AS (SELECT o_orderpriority, o_custkey, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2) SELECT o_orderpriority, round_even(avg(v), 4) AS mean_of_means, round_even(median(v), 4) AS median_of_means, count(*) AS n FROM m GROUP BY 1")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.avg("o_totalprice").alias("v"))
    return m.groupBy("o_orderpriority").agg(X.half_even(F.avg("v"), 4).alias("mean_of_means"), X.half_even(F.median("v"), 4).alias("median_of_means"), F.count("*").alias("n"))


@query("WITH m AS (SELECT l_quantity AS n, avg(l_extendedprice) AS m, l_returnflag AS g FROM lineitem GROUP BY 1, 3) SELECT g, min(CASE WHEN m >= 30000 THEN n END) AS knee FROM m GROUP BY 1")
def first_size_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least size whose mean reaches a threshold."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("n")).agg(F.avg("l_extendedprice").alias("m"))
    return m.groupBy("g").agg(F.min(F.when(F.col("m") >= 30_000, F.col("n"))).alias("knee"))


@query(f"SELECT l_returnflag, l_linestatus, count(*) AS n, {R6.format('CASE WHEN count(*) >= 5 AND stddev_pop(l_discount) > 0 THEN corr(l_quantity, l_discount) END')} AS r FROM lineitem GROUP BY 1, 2")
def guarded_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson's r, null below five rows or without variation."""
    return S.guarded_corr(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_discount").withColumn("r", X.half_even(F.col("r"), 6))


@query(f"WITH c AS (SELECT o_orderpriority AS g, o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS a, avg(o_totalprice) FILTER (o_orderstatus <> 'F') AS b FROM orders GROUP BY 1, 2) SELECT g, count(*) AS n, {R6.format('avg(a)')} AS mean_a, {R6.format('avg(b)')} AS mean_b, {R6.format('stddev_samp(a) / sqrt(count(*))')} AS se_a, {R6.format('avg(a - b) / stddev_samp(a - b)')} AS dz FROM c WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def paired_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of pairs, their standard error, and the standardised mean difference."""
    early = F.col("o_orderstatus") == "F"
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("g"), "o_custkey").agg(F.avg(F.when(early, F.col("o_totalprice"))).alias("a"), F.avg(F.when(~early, F.col("o_totalprice"))).alias("b"))
    return S.paired(c, ["g"], "a", "b").withColumns({k: X.half_even(F.col(k), 6) for k in ("mean_a", "mean_b", "se_a", "dz")})


@query("SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 9 END AS place FROM orders")
def mapped_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sorted by a stated order of labels."""
    p = F.col("o_orderpriority")
    place = F.when(p == "5-LOW", 0).when(p == "1-URGENT", 1).when(p == "3-MEDIUM", 2).otherwise(9)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", place.alias("place")).orderBy("place", "o_orderkey")


@query("SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat(c_custkey, '|20260717')), c_custkey) AS place FROM customer")
def seeded_block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random but reproducible order within blocks, from a digest of id and seed."""
    c = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit("|20260717"))).alias("digest"))
    return running(c, ["c_mktsegment"], "digest", F.lit(1), "before").select("c_mktsegment", "c_custkey", (F.col("before") + 1).cast("long").alias("place"))


@query("WITH o(label, place) AS (VALUES ('R', 1), ('X', 2), ('N', 3), ('A', 4)), n AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) SELECT label, place, n::DOUBLE AS n FROM o LEFT JOIN n ON l_returnflag = label")
def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed order of labels; one that has no row is null."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").cast("double").alias("n"))
    order = spark.createDataFrame([("R", 1), ("X", 2), ("N", 3), ("A", 4)], "label string, place int")
    return order.join(n, "label", "left").select("label", "place", "n").orderBy("place")


@query(f"WITH {TAPS}, n AS (SELECT stem_id, panel, count(*) AS n FROM taps GROUP BY 1, 2) SELECT stem_id, count(*) + 1 AS n_keys, coalesce(max(n) FILTER (panel = 3), 0) AS n_three, -1 AS n_extra, coalesce(max(n) FILTER (panel = 77), 0) AS n_absent FROM n GROUP BY 1")
def count_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as a map: merged with another, read with a default."""
    n = taps(spark, sf_dir).groupBy("stem_id", "panel").agg(F.count("*").alias("n"))
    m = n.groupBy("stem_id").agg(F.map_from_entries(F.collect_list(F.struct("panel", "n"))).alias("m"))
    m = m.withColumn("m", F.map_concat("m", F.create_map(F.lit(-5), F.lit(-1).cast("long"))))
    get = lambda k: F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0))
    return m.select("stem_id", F.size("m").cast("long").alias("n_keys"), get(3).alias("n_three"), get(-5).cast("int").alias("n_extra"), get(77).alias("n_absent"))


@query(f"WITH {REFS} SELECT stem_id, k, CAST(round_even(beat_us * 44100 / 1000000.0::DOUBLE, 0) AS BIGINT) AS sample, CAST(round_even(beat_us * 44100 / 1000000.0::DOUBLE, 0) AS BIGINT) + 529 AS last_sample FROM refs")
def click_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each beat's click of 12 ms starts and ends at 44.1 kHz."""
    s = F.rint(F.col("beat_us") * 44_100 / 1e6).cast("long")
    return references(spark, sf_dir).select("stem_id", "k", s.alias("sample"), (s + 529).alias("last_sample"))


@query("SELECT l_orderkey % 100 AS stem, l_linenumber AS block, round_even(max(abs(l_extendedprice)) / max(max(abs(l_extendedprice))) OVER (PARTITION BY l_orderkey % 100), 9) AS envelope FROM lineitem GROUP BY 1, 2")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest magnitude of each block over that of the whole."""
    e = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 100).alias("stem"), F.col("l_linenumber").alias("block")).agg(F.max(F.abs("l_extendedprice")).alias("e"))
    return e.select("stem", "block", X.half_even(F.col("e") / F.max("e").over(Window.partitionBy("stem")), 9).alias("envelope"))


@query(f"WITH {TAPS}, d AS (SELECT participant, tap_us, tap_us - lag(tap_us) OVER (PARTITION BY participant ORDER BY tap_us) AS ioi FROM taps) SELECT participant, count(*) FILTER (tap_us % 6 < 5) < 5 AS marker_failed, count(*) > 20 AND coalesce(median(ioi), 9999) <> 9999 AS tapping_ok FROM d GROUP BY 1")
def marker_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers fail below five detected; free tapping needs more than twenty taps and an interval that is no sentinel."""
    w = Window.partitionBy("participant").orderBy("tap_us")
    d = taps(spark, sf_dir).select("participant", "tap_us", (F.col("tap_us") - F.lag("tap_us").over(w)).alias("ioi"))
    mid = F.coalesce(F.median("ioi"), F.lit(9999.0))
    return d.groupBy("participant").agg((F.count_if(F.col("tap_us") % 6 < 5) < 5).alias("marker_failed"), ((F.count("*") > 20) & (mid != 9999)).alias("tapping_ok"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'no_audio' WHEN n = 0 THEN 'no_beats' WHEN n < 3 THEN 'too_few_beats' ELSE 'rendered' END AS status FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)")
def render_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job table whose rows say why they are skipped."""
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    j = table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left")
    status = F.when(F.col("c_custkey") % 5 == 0, "no_audio").when(F.coalesce("n", F.lit(0)) == 0, "no_beats").when(F.col("n") < 3, "too_few_beats").otherwise("rendered")
    return j.select("c_custkey", status.alias("status"))


@query(f"WITH {TAPS} SELECT stem_id, count(*) FILTER (tap_us BETWEEN 10000000 AND 25000000) AS n_window, count(*) AS n_all, round_even(avg(CASE WHEN tap_us BETWEEN 10000000 AND 25000000 THEN 1.0::DOUBLE ELSE 0 END), 9) AS share FROM taps GROUP BY 1")
def window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the listening window and in all."""
    inside = F.col("tap_us").between(10_000_000, 25_000_000)
    return taps(spark, sf_dir).groupBy("stem_id").agg(F.count_if(inside).alias("n_window"), F.count("*").alias("n_all"), X.half_even(F.avg(F.when(inside, 1.0).otherwise(0.0)), 9).alias("share"))


@query("SELECT doc_id, len(string_split(source, 'e')) AS n_parts, string_split(source, 'e')[-1] AS last_part, concat_ws(' -> ', lang, source, 'end') AS path, json_object('lang', lang, 'n', n_chars)::VARCHAR AS record FROM documents")
def labels_and_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text taken apart and put together, and a row as JSON."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.size(F.split("source", "e")).cast("long").alias("n_parts"), F.element_at(F.split("source", "e"), -1).alias("last_part"), F.concat_ws(" -> ", "lang", "source", F.lit("end")).alias("path"), F.to_json(F.struct("lang", F.col("n_chars").alias("n")), {"ignoreNullFields": "false"}).alias("record"))


@query(f"WITH {REFS}, p AS (SELECT stem_id, beat_us, 400000 + 50000 * ord AS period_us, 100000 * ord AS phase_us FROM refs) SELECT stem_id, CAST(period_us AS BIGINT) AS period_us, count(*) AS n, CAST(max(abs(beat_us - (phase_us + round_even((beat_us - phase_us) / period_us::DOUBLE, 0) * period_us))) AS DOUBLE) AS worst_us FROM p GROUP BY 1, 2")
def isochronous_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids made from period and phase, and how far the references lie off them."""
    r = references(spark, sf_dir).select("stem_id", "beat_us", (400_000 + 50_000 * F.col("ord")).alias("period_us"), (100_000 * F.col("ord")).alias("phase_us"))
    made = G.grid_points(r.select("stem_id", "period_us", "phase_us").distinct(), 0, 29_999_999).where("k >= 0").select("stem_id", "beat_us")
    off = F.abs(F.col("beat_us") - (F.col("phase_us") + F.rint((F.col("beat_us") - F.col("phase_us")) / F.col("period_us")) * F.col("period_us")))
    return r.join(made, ["stem_id", "beat_us"]).groupBy("stem_id", F.col("period_us").cast("long").alias("period_us")).agg(F.count("*").alias("n"), F.max(off).cast("double").alias("worst_us"))
