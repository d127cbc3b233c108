"""Rank tests, ragged effects, shifts and runs against enumeration and plain loops."""

import itertools
import math

import numpy as np
import pytest

from cadentia.kernels import exact, periods
from cadentia.operators import grid, matching
from cadentia.operators import inference as S
from cadentia.operators.inference import F


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_signed_ranks_are_counted_out(n):
    sums = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=n)]
    for w in range(n * (n + 1) // 2 + 1):
        lower, upper = exact.tails(exact.signed_rank_counts(n), w)
        assert lower == pytest.approx(np.mean([s <= w for s in sums]), abs=1e-12) and upper == pytest.approx(np.mean([s >= w for s in sums]), abs=1e-12)


@pytest.mark.parametrize("n,m", [(1, 1), (2, 3), (4, 4), (5, 2), (3, 7)])
def test_rank_sums_are_counted_out(n, m):
    values = [sum(places) - n * (n - 1) // 2 for places in itertools.combinations(range(n + m), n)]
    for u in range(n * m + 1):
        lower, upper = exact.tails(exact.rank_sum_counts(n, m), u)
        assert lower == pytest.approx(np.mean([v <= u for v in values]), abs=1e-12) and upper == pytest.approx(np.mean([v >= u for v in values]), abs=1e-12)


def test_large_counts():
    ways = exact.signed_rank_counts(50)
    assert ways.sum() == 2.0**50 and (ways == ways[::-1]).all()
    assert exact.rank_sum_counts(8, 30).sum() == math.comb(38, 8)


def average_ranks(x):
    return [sum(v < y for v in x) + (sum(v == y for v in x) + 1) / 2 for y in x]


def test_ranks_over_ranges(spark):
    """Ties, a value that holds most rows, and several keys."""
    rng = np.random.default_rng(1)
    rows = [(k, float(v), bool(rng.random() < 0.4)) for k in "ab" for v in np.where(rng.random(150) < 0.5, 3, np.round(rng.normal(0, 4, 150), 1))]
    d = spark.createDataFrame(rows, "k string, d double, f boolean")
    w = {r.k: r for r in S.wilcoxon(d, ["k"], "d").collect()}
    u = {r.k: r for r in S.mann_whitney(d, ["k"], F.col("f"), "d").collect()}
    for k in "ab":
        own = [r for r in rows if r[0] == k]
        x = [r[1] for r in own if r[1] != 0]
        ranks = average_ranks([abs(v) for v in x])
        assert w[k].w_plus == sum(r for r, v in zip(ranks, x, strict=True) if v > 0) and w[k].w_minus == sum(r for r, v in zip(ranks, x, strict=True) if v < 0)
        assert (w[k].n, w[k].zeros) == (len(x), len(own) - len(x))
        n1 = sum(r[2] for r in own)
        assert u[k].u == sum(r for r, o in zip(average_ranks([o[1] for o in own]), own, strict=True) if o[2]) - n1 * (n1 + 1) / 2
        ties = lambda v: sum(c**3 - c for c in (v.count(y) for y in set(v)))
        assert w[k].ties == ties([abs(v) for v in x]) and u[k].ties == ties([o[1] for o in own])


def test_signed_rank_p(spark):
    rng = np.random.default_rng(2)
    small = [("small", float(x)) for x in rng.permutation([1.5, -2.5, 3.5, 4.5, -0.5, 6.5, 7.5])]
    tied = [("tied", float(x)) for x in [1, 1, -1, 2, 3, 3]]
    zero = [("zero", float(x)) for x in [0, 1, 2, 3, 4, 5]]
    few = [("few", 1.0)] * 4
    got = {r.k: r for r in S.wilcoxon_p(spark.createDataFrame(small + tied + zero + few, "k string, d double"), ["k"], "d").collect()}
    assert set(got) == {"small", "tied", "zero"}
    x = [v for _, v in small]
    ranks = average_ranks([abs(v) for v in x])
    w = sum(r for r, v in zip(ranks, x, strict=True) if v > 0)
    every = [sum(r for r, s in zip(ranks, signs, strict=True) if s) for signs in itertools.product([0, 1], repeat=7)]
    assert got["small"].method == "exact" and got["small"].p_greater == pytest.approx(np.mean([s >= w for s in every]))
    assert got["small"].p == pytest.approx(min(1, 2 * min(np.mean([s >= w for s in every]), np.mean([s <= w for s in every]))))
    assert got["small"].median_difference == pytest.approx(np.median(x))
    assert got["tied"].method == got["zero"].method == "normal"
    z = (got["zero"].w_plus - 5 * 6 / 4) / math.sqrt(5 * 6 * 11 / 24)
    assert got["zero"].n == 5 and got["zero"].p_greater == pytest.approx(periods.normal_tail(z))


def test_rank_sum_p(spark):
    a, b = [1.1, 5.2, 7.3], [0.4, 2.5, 3.6, 4.7, 9.8, 6.9]
    rows = [("x", v, True) for v in a] + [("x", v, False) for v in b] + [("one", 1.0, True)] + [("tie", 1.0, i < 2) for i in range(5)]
    got = {r.k: r for r in S.mann_whitney_p(spark.createDataFrame(rows, "k string, v double, f boolean"), ["k"], F.col("f"), "v").collect()}
    u = sum(x > y for x in a for y in b)
    every = [sum(p) - 3 for p in itertools.combinations(range(9), 3)]
    assert got["x"].u == u and got["x"].method == "exact" and got["x"].p_greater == pytest.approx(np.mean([v >= u for v in every]))
    assert got["one"].p_greater is None and got["tie"].method == "normal" and got["tie"].p_greater is None


def test_step_up(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, float(np.round(rng.random() ** 2, 2))) for k in "ab" for i in range(60)] + [("a", 99, None)]
    got = {(r.k, r.i): r.q for r in S.step_up(spark.createDataFrame(rows, "k string, i int, p double"), ["k"], "p").collect()}
    assert len(got) == len(rows) and got["a", 99] is None
    for k in "ab":
        own = sorted(r[2] for r in rows if r[0] == k and r[2] is not None)
        for r in rows:
            if r[0] == k and r[2] is not None:
                assert got[k, r[1]] == pytest.approx(min(1, min(p * len(own) / (j + 1) for j, p in enumerate(own) if p >= r[2])))


def dense_effect(rows):
    """Least squares with a dummy for every row and column, and the clustered error."""
    rs, cs = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    z = np.array([[r[2]] + [r[0] == v for v in rs] + [r[1] == v for v in cs[1:]] for r in rows], float)
    y = np.array([r[3] for r in rows])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    bread, e = np.linalg.pinv(z.T @ z), y - z @ beta
    scores = np.array([sum(z[i] * e[i] for i, r in enumerate(rows) if r[0] == v) for v in rs])
    n, g, k = len(rows), len(rs), z.shape[1]
    cov = bread @ (scores.T @ scores) @ bread * g / (g - 1) * (n - 1) / (n - k)
    return beta[0], math.sqrt(cov[0, 0])


@pytest.mark.parametrize("share", [1.0, 0.7, 0.35])
def test_ragged_effects(spark, share):
    rng = np.random.default_rng(int(10 * share))
    rows = [(f"r{i}", j, float(rng.random() < 0.3), float(rng.normal(i % 3 + 2 * j, 1))) for i in range(25) for j in range(6) if rng.random() < share or j == i % 6]
    rows += [("lone", 2, 1.0, 40.0), (None, 1, 1.0, 1.0), ("r1", None, 1.0, 1.0), ("r2", 9, None, 2.0)]
    got = S.two_way_effect(spark.createDataFrame(rows, "r string, c int, x double, y double").repartition(3), "r", "c", "x", "y").first()
    beta, se = dense_effect([r for r in rows if None not in r])
    assert got.beta == pytest.approx(beta, rel=1e-8) and got.se == pytest.approx(se, rel=1e-8)
    assert got.p == pytest.approx(2 * periods.normal_tail(abs(beta / se)), rel=1e-6) and got.hi - got.lo == pytest.approx(2 * 1.959964 * se, rel=1e-5)


def test_effect_of_nothing(spark):
    assert S.two_way_effect(spark.createDataFrame([], "r string, c int, x double, y double"), "r", "c", "x", "y").first().beta is None


def test_best_shift(spark):
    rng = np.random.default_rng(5)
    cases = {"even": (np.arange(40) * 500_000 + 60_000, np.arange(40) * 500_000), "faster": (np.arange(40) * 430_000, np.arange(40) * 500_000), "single": (np.array([5]), np.arange(9) * 500_000), "far": (np.arange(9) * 500_000 + 20_000_000, np.arange(9) * 500_000)}
    for i in range(6):
        r = np.sort(rng.choice(28_000_000, 50, replace=False))
        cases[f"r{i}"] = (np.unique(np.sort(r[rng.random(50) < 0.9]) + rng.integers(-150_000, 150_000)), r)
    frame = lambda side: spark.createDataFrame([(k, int(t)) for k, v in cases.items() for t in v[side]], "stem_id string, beat_us long")
    got = {r.stem_id: (r.shift_us, r.hits) for r in matching.best_shift(frame(0), frame(1), ["stem_id"]).collect()}
    for k, (p, t) in cases.items():
        gap = [float(np.median(np.diff(v))) if len(v) > 1 else 0 for v in (p, t)]
        if min(gap) <= 0 or max(gap) / min(gap) > 1.1:
            assert got[k] == (0, 0)
            continue
        hits = [(sum(min(abs(p + s - x)) <= 70_000 for x in t), s) for s in range(-250_000, 250_001, 5_000)]
        most = max(h for h, _ in hits)
        assert got[k] == (min(s for h, s in hits if h == most), most)


def test_steady_runs(spark):
    rng = np.random.default_rng(6)
    beats = {f"s{i}": np.cumsum(np.where(rng.random(18) < 0.3, rng.integers(200_000, 900_000, 18), 500_000 + rng.integers(-20_000, 20_000, 18))) for i in range(8)}
    beats["wild"] = np.cumsum(np.array([200_000, 900_000] * 8))
    got = {r.stem_id: (r.first, r.n) for r in grid.steady_runs(spark.createDataFrame([(k, int(t)) for k, v in beats.items() for t in v], "stem_id string, beat_us long")).collect()}
    for k, b in beats.items():
        best = (-1.0, None)
        for n in range(6, len(b) + 1):
            for i in range(len(b) - n + 1):
                d = np.diff(b[i : i + n] / 1e6)
                cv = d.std() / d.mean()
                if cv <= 0.15 and n * math.exp(-cv / 0.05) > best[0] + 1e-9:
                    best = (n * math.exp(-cv / 0.05), (i + 1, n))
        assert got.get(k) == best[1]


def test_variant_metrics_of_odd_sets(spark):
    """Against the operators that join beats one by one: single, far, equal, dense and negative beats."""
    rng = np.random.default_rng(15)
    cases = {"even": (np.arange(40) * 500_000 + 60_000, np.arange(40) * 500_000), "single": (np.array([5]), np.arange(9) * 500_000), "both": (np.array([5]), np.array([80_000])), "far": (np.arange(9) * 500_000 + 40_000_000, np.arange(9) * 500_000), "twice": (np.repeat(np.arange(9) * 550_000, 2), np.arange(9) * 500_000), "early": (np.arange(9) * 550_000 - 2_000_000, np.arange(9) * 500_000 - 2_100_000)}
    for i in range(8):
        r = np.sort(rng.choice(28_000_000, 60, replace=False))
        cases[f"r{i}"] = (np.sort(r[rng.random(60) < 0.9] + rng.integers(-200_000, 200_000)), r)
        cases[f"d{i}"] = tuple(np.sort(rng.choice(3_000_000, 60, replace=False)) for _ in range(2))
    beats = spark.createDataFrame([("v", k, int(t)) for k, v in cases.items() for t in v[0]] + [("w", "even", 7), ("v", "none", 1), ("v", "even", None)], "variant string, stem_id string, beat_us long").repartition(3)
    refs = spark.createDataFrame([(k, int(t)) for k, v in cases.items() for t in v[1]] + [("other", 3)], "stem_id string, beat_us long").repartition(3)
    got = {(r.variant, r.stem_id): r for r in matching.variant_metrics(beats, refs).collect()}
    assert set(got) == {("v", k) for k in cases} | {("w", "even")}
    mine = beats.where("variant = 'v' and beat_us is not null").drop("variant")
    for r in matching.phase_aligned_f(mine, refs, ["stem_id"]).collect():
        m = got["v", r.stem_id]
        assert (m.f, m.f_aligned, m.shift_ms) == (pytest.approx(r.f), pytest.approx(r.f_aligned), r.shift_us / 1000)
    for r in matching.f_measure(mine, refs, ["stem_id"], 120_000).collect():
        assert got["v", r.stem_id].f_wide == pytest.approx(r.f)
    for k, (a, b) in cases.items():
        d = abs(b[:, None] - a[None]).min(axis=1)
        want = float(np.median(d[d <= 70_000])) / 1000 if (d <= 70_000).any() else None
        m = got["v", k]
        assert (m.median_off_ms, m.n_30s, m.n_10_25) == (want, ((a >= 0) & (a <= 30_000_000)).sum(), ((a >= 10_000_000) & (a <= 25_000_000)).sum())


def test_variant_metrics_shuffle_once(spark):
    """Beats that lie by stem are not shuffled again, and those of the reference once."""
    beats = spark.createDataFrame([("v", "a", 1)], "variant string, stem_id string, beat_us long").repartition("stem_id")
    plan = matching.variant_metrics(beats, spark.createDataFrame([("a", 1)], "stem_id string, beat_us long"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Join") == 1 and plan.count("Window") == 0


def test_corpora_are_not_read_off_the_grids(spark, tmp_path):
    """A stem names its corpus; its grid of beats is made once, for the metrics."""
    from cadentia.plans import stage_queries as Q

    plan = Q.variants_by_corpus(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(") == 2 and plan.count("Exchange hashpartitioning") <= 6


def test_variant_tests_take_the_metrics_once(spark, monkeypatch):
    from cadentia.plans import stage_queries as Q

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(v, f"s{i}", i / 10 + j * (i % 3) / 50) for i in range(12) for j, v in enumerate(("crowd", "late", "sparse"))], "variant string, stem_id string, f double")
    monkeypatch.setattr(Q, "metrics_of_variants", lambda *_: rows.mapInArrow(counted, rows.schema))
    assert {r.baseline for r in Q.variant_tests(spark, "").collect()} == {"late", "sparse"}
    assert seen.value == 36
