"""Rank tests, effect sizes, fixed-effect models, step-up correction: the statistics as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import exact, periods
from .durable import durable
from .ordering import least_from_here, running, running_total


def ranks(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``counts`` (keys, value, c: how often it occurs, and more) with the average rank of the value within its keys."""
    return running(counts, keys, value, F.col("c"), "_below").withColumn("rank", F.col("_below") + (F.col("c") + 1) / 2.0).drop("_below")


def wilcoxon(pairs: DataFrame, keys: Sequence[str], difference: str) -> DataFrame:
    """Signed ranks of the differences that are not 0: W+ and W-, their number, and the sum of t ** 3 - t over ties; zeros are counted beside."""
    d = F.col(difference)
    c = pairs.where(d != 0).groupBy(*keys, F.abs(d).alias("_size")).agg(F.count("*").alias("c"), F.count_if(d > 0).alias("up"))
    t = F.col("c").cast("double")
    r = ranks(c, keys, "_size").groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("up")).alias("w_plus"), F.sum(F.col("rank") * (F.col("c") - F.col("up"))).alias("w_minus"), F.sum(t * t * t - t).alias("ties"))
    return r.join(pairs.groupBy(*keys).agg(F.count_if(d == 0).alias("zeros"), F.median(d).alias("median_difference")), list(keys))


def mann_whitney(rows: DataFrame, keys: Sequence[str], first: Column, value: str) -> DataFrame:
    """U of the rows where ``first`` holds, against the others, and the sum of t ** 3 - t over ties; rows without a value, or that are neither, do not count."""
    c = rows.withColumn("_first", first).where(F.col("_first").isNotNull() & F.col(value).isNotNull())
    c = c.groupBy(*keys, value).agg(F.count("*").alias("c"), F.count_if("_first").alias("of_first"))
    t = F.col("c").cast("double")
    a = ranks(c, keys, value).groupBy(*keys).agg(F.sum("of_first").alias("n_first"), (F.sum("c") - F.sum("of_first")).alias("n_second"), F.sum(F.col("rank") * F.col("of_first")).alias("rank_sum"), F.sum(t * t * t - t).alias("ties"))
    return a.select(*keys, "n_first", "n_second", (F.col("rank_sum") - F.col("n_first") * (F.col("n_first") + 1) / 2.0).alias("u"), "ties")


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """H over the groups with the correction for ties; ranks come from counts of distinct values, summed range by range."""
    v = rows.groupBy(value).agg(F.count("*").alias("c"))
    v = running_total(v, value, "c", "below").withColumn("rank", F.col("below") + (F.col("c") + 1) / 2.0)
    total = v.agg(F.sum("c").alias("n"), F.sum(F.pow(F.col("c").cast("double"), 3) - F.col("c")).alias("ties"))
    g = rows.join(v, value).groupBy(group).agg(F.count("*").alias("m"), F.sum("rank").alias("s")).agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.count("*").alias("k"))
    n = F.col("n").cast("double")
    return g.crossJoin(F.broadcast(total)).select("k", "n", ((12.0 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))).alias("h"))


def spearman(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Correlation of average ranks over rows that have both."""
    r = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    for c, name in ((x, "rx"), (y, "ry")):
        of = ranks(r.groupBy(*keys, c).agg(F.count("*").alias("c")), keys, c).select(*keys, c, F.col("rank").alias(name))
        r = r.join(of, [*keys, c])
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def step_up(tests: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """Benjamini-Hochberg q: the least p * m / rank from here up, at most 1.

    Tests of equal p share their q, that of the last of them, so q belongs to
    a value of p; a test without p has no q and does not count.
    """
    c = tests.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("_c"))
    m = c.groupBy(*keys).agg(F.sum("_c").alias("_m"))
    v = running(c, keys, p, F.col("_c"), "_below").join(m, list(keys))
    q = least_from_here(v, keys, p, F.col(p) * F.col("_m") / (F.col("_below") + F.col("_c")), "q")
    return tests.join(q.select(*keys, p, F.least(F.lit(1.0), F.col("q")).alias("q")), [*keys, p], "left").select(*tests.columns, "q")


def cohens_d(rows: DataFrame, keys: Sequence[str], first: Column, value: str) -> DataFrame:
    """Difference of means over the pooled deviation, and its standard error."""
    r = rows.withColumn("first", first)
    a, b = F.when(F.col("first"), F.col(value)), F.when(~F.col("first"), F.col(value))
    s = r.groupBy(*keys).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2"))
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    s = s.withColumn("d", F.try_divide(F.col("m1") - F.col("m2"), pooled))
    return s.withColumn("se", F.sqrt(F.try_divide(F.col("n1") + F.col("n2"), F.col("n1") * F.col("n2")) + F.try_divide(F.col("d") * F.col("d"), 2.0 * (F.col("n1") + F.col("n2")))))


def fixed_effect_meta(effects: DataFrame) -> DataFrame:
    """Inverse-variance mean of effects (d, se), its error, z and 95 % interval."""
    w = 1.0 / (F.col("se") * F.col("se"))
    m = effects.agg(F.count("*").alias("k"), (F.sum(w * F.col("d")) / F.sum(w)).alias("d"), F.sqrt(1.0 / F.sum(w)).alias("se"))
    return m.select("k", "d", "se", (F.col("d") / F.col("se")).alias("z"), (F.col("d") - 1.96 * F.col("se")).alias("lo"), (F.col("d") + 1.96 * F.col("se")).alias("hi"))


def two_way_effect(cells: DataFrame, row: str, column: str, x: str, y: str, close: float = 1e-13) -> DataFrame:
    """Coefficient of x on y with fixed effects of rows and columns, its error clustered by row, z, p (normal) and 95 % interval.

    The cells may be ragged.  Row effects go out by means; column effects
    solve what is left, a system as wide as there are columns, by conjugate
    gradients, whose every step is two sums over the cells.  A complete table
    needs one step.  Rows of one cell only say nothing and are harmless.
    """
    c = cells.where(F.col(row).isNotNull() & F.col(column).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    c = durable(c.select(F.col(row).alias("r"), F.col(column).alias("c"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))

    def swept(values: DataFrame) -> DataFrame:
        """x and y of cells without their rows' means."""
        mean = values.groupBy("r").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
        return values.join(mean, "r").select("r", "c", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))

    def by_column(values: DataFrame, a: str, b: str) -> DataFrame:
        return swept(values).groupBy("c").agg(F.sum("x").alias(a), F.sum("y").alias(b))

    zero = F.lit(0.0)
    s = durable(by_column(c, "rx", "ry").select("c", zero.alias("bx"), zero.alias("by"), "rx", "ry", F.col("rx").alias("px"), F.col("ry").alias("py")))
    square = lambda df: df.agg(F.sum(F.col("rx") * F.col("rx")).alias("x"), F.sum(F.col("ry") * F.col("ry")).alias("y"), F.count("*").alias("n")).head()
    size = c.agg(F.sum(F.col("x") * F.col("x")).alias("x"), F.sum(F.col("y") * F.col("y")).alias("y")).head()
    now = square(s)
    for _ in range(2 * (now.n or 0) + 10):
        if all((now[k] or 0.0) <= (close**2) * (size[k] or 0.0) for k in "xy"):
            break
        q = by_column(c.select("r", "c").join(s.select("c", F.col("px").alias("x"), F.col("py").alias("y")), "c"), "qx", "qy")
        t = durable(s.join(q, "c"))
        dot = t.agg(F.sum(F.col("px") * F.col("qx")).alias("x"), F.sum(F.col("py") * F.col("qy")).alias("y")).head()
        step = {k: now[k] / dot[k] if dot[k] else 0.0 for k in "xy"}
        t = t.select("c", "px", "py", *((F.col(f"b{k}") + step[k] * F.col(f"p{k}")).alias(f"b{k}") for k in "xy"), *((F.col(f"r{k}") - step[k] * F.col(f"q{k}")).alias(f"r{k}") for k in "xy"))
        before, now = now, square(t)
        turn = {k: now[k] / before[k] if before[k] else 0.0 for k in "xy"}
        s = durable(t.select("c", "bx", "by", "rx", "ry", *((F.col(f"r{k}") + turn[k] * F.col(f"p{k}")).alias(f"p{k}") for k in "xy")))
    left = durable(swept(c.join(s.select("c", "bx", "by"), "c").select("r", "c", (F.col("x") - F.col("bx")).alias("x"), (F.col("y") - F.col("by")).alias("y"))))
    sizes = left.groupBy("r").agg(F.count("*").alias("k")).agg(F.count("*").alias("g"), F.sum("k").alias("n"))
    fit = left.agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.count_distinct("c").alias("columns")).crossJoin(F.broadcast(sizes)).withColumn("beta", F.try_divide("xy", "xx"))  # one row
    score = left.crossJoin(F.broadcast(fit.select("beta"))).groupBy("r").agg(F.sum(F.col("x") * (F.col("y") - F.col("beta") * F.col("x"))).alias("u")).agg(F.sum(F.col("u") * F.col("u")).alias("meat"))
    g, n = F.col("g").cast("double"), F.col("n").cast("double")
    factor = F.try_divide(g, g - 1) * F.try_divide(n - 1, n - g - F.col("columns"))
    out = fit.crossJoin(F.broadcast(score)).select("n", "beta", F.try_divide(F.sqrt(factor * F.col("meat")), F.col("xx")).alias("se"))
    out = out.withColumn("z", F.try_divide("beta", "se")).withColumns({"lo": F.col("beta") - 1.959963984540054 * F.col("se"), "hi": F.col("beta") + 1.959963984540054 * F.col("se")})
    return with_normal_p(out, "z")


def guarded_corr(rows: DataFrame, keys: Sequence[str], x: str, y: str, least: int = 5) -> DataFrame:
    """Pearson's r per group; null below ``least`` rows or where a side does not vary."""
    enough = (F.count("*") >= least) & (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.when(enough, F.corr(x, y)).alias("r"))


def paired(rows: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Over rows that have both: means, the first one's standard error, and the mean difference over its deviation."""
    d = F.col(a) - F.col(b)
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), (F.stddev_samp(a) / F.sqrt(F.count("*"))).alias("se_a"), F.try_divide(F.avg(d), F.stddev_samp(d)).alias("dz"))


def with_normal_p(rows: DataFrame, z: str) -> DataFrame:
    """Two-sided normal p of a column."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [None if v is None or v != v else 2 * periods.normal_tail(abs(v)) for v in b.column(z).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, "p"])

    return rows.mapInArrow(kernel, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", p double")


#: Where nulls are counted out: untied differences up to the first number; the smaller of two untied groups up to the second (fixed values).
EXACT_PAIRS, EXACT_GROUP = 50, 8


def wilcoxon_p(pairs: DataFrame, keys: Sequence[str], difference: str, least: int = 5) -> DataFrame:
    """Signed-rank test of each key with ``least`` rows: n, w_plus, w_minus, median_difference, method, p (two-sided) and p_greater.

    Without zeros and ties, and up to EXACT_PAIRS differences, p is counted
    out; else it is the normal one, with the variance for ties.
    """
    w = wilcoxon(pairs, keys, difference).where(F.col("n") + F.col("zeros") >= least)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            method, two, one = [], [], []
            for n, up, ties, zeros in zip(*(b.column(c).to_pylist() for c in ("n", "w_plus", "ties", "zeros")), strict=True):
                if n <= EXACT_PAIRS and not ties and not zeros:
                    lower, upper = exact.tails(exact.signed_rank_counts(n), round(up))
                    method.append("exact")
                else:
                    upper = periods.normal_tail((up - n * (n + 1) / 4) / (n * (n + 1) * (2 * n + 1) / 24 - ties / 48) ** 0.5)
                    lower = 1 - upper
                    method.append("normal")
                two.append(min(1.0, 2 * min(lower, upper)))
                one.append(upper)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(method, pa.string()), pa.array(two, pa.float64()), pa.array(one, pa.float64())], names=[*b.schema.names, "method", "p", "p_greater"])

    out = w.mapInArrow(kernel, ", ".join(f"{n} {t}" for n, t in w.dtypes) + ", method string, p double, p_greater double")
    return out.select(*keys, "n", "w_plus", "w_minus", "median_difference", "method", "p", "p_greater")


def mann_whitney_p(rows: DataFrame, keys: Sequence[str], first: Column, value: str) -> DataFrame:
    """Whether the first group is the larger, per key: n_first, n_second, u, method and p_greater.

    Without ties, and with at most EXACT_GROUP rows in the smaller group, p is
    counted out; else it is normal, with ties and continuity.  A key without rows in
    one of the groups has no p.
    """
    u = mann_whitney(rows, keys, first, value)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            method, p = [], []
            for n, m, x, ties in zip(*(b.column(c).to_pylist() for c in ("n_first", "n_second", "u", "ties")), strict=True):
                spread = n * m / 12 * ((n + m + 1) - ties / max((n + m) * (n + m - 1), 1))
                small = min(n, m) <= EXACT_GROUP and not ties
                method.append("exact" if small else "normal")
                if not n or not m:
                    p.append(None)
                elif small:
                    p.append(exact.tails(exact.rank_sum_counts(n, m), round(x))[1])
                else:
                    p.append(periods.normal_tail((x - n * m / 2 - 0.5) / spread**0.5) if spread > 0 else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(method, pa.string()), pa.array(p, pa.float64())], names=[*b.schema.names, "method", "p_greater"])

    return u.mapInArrow(kernel, ", ".join(f"{n} {t}" for n, t in u.dtypes) + ", method string, p_greater double").drop("ties")


def with_p(w: DataFrame, u: DataFrame, h: DataFrame, r: DataFrame) -> DataFrame:
    """One table of tests (test, group, n, value, p): of wilcoxon_p (two-sided), mann_whitney_p (one-sided), kruskal (chi-square) and spearman (Student's t)."""
    own = lambda df, *names: next(c for c in df.columns if c not in names)
    group = lambda df, *names: F.col(own(df, *names)).cast("string").alias("group")
    w = w.select(F.lit("wilcoxon").alias("test"), group(w), "n", F.col("w_plus").alias("value"), F.lit(None).cast("long").alias("freedom"), "p")
    u = u.select(F.lit("mann_whitney").alias("test"), group(u), (F.col("n_first") + F.col("n_second")).alias("n"), F.col("u").alias("value"), F.lit(None).cast("long").alias("freedom"), F.col("p_greater").alias("p"))
    h = h.select(F.lit("kruskal").alias("test"), F.lit("all").alias("group"), F.col("n").cast("long").alias("n"), F.col("h").alias("value"), (F.col("k") - 1).alias("freedom"), F.lit(None).cast("double").alias("p"))
    t = F.try_divide(F.col("rho") * F.sqrt(F.col("n") - 2.0), F.sqrt(1 - F.col("rho") * F.col("rho")))
    r = r.select(F.lit("spearman").alias("test"), group(r, "n", "rho"), "n", t.alias("value"), (F.col("n") - 2).alias("freedom"), F.lit(None).cast("double").alias("p"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = []
            for test, freedom, x, had in zip(*(b.column(c).to_pylist() for c in ("test", "freedom", "value", "p")), strict=True):
                if freedom is None or freedom < 1 or x is None or x != x:
                    p.append(had)
                else:
                    p.append(periods.chi_square_tail(x, freedom) if test == "kruskal" else min(1.0, 2 * periods.student_tail(abs(x), freedom)))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(p, pa.float64())], names=["test", "group", "n", "value", "p"])

    return w.unionAll(u).unionAll(h).unionAll(r).mapInArrow(kernel, "test string, group string, n long, value double, p double")
